"""The store: ledger tables as files that reports can prune, with sums per month, and batches added.

Items carry what reports would look up for each of them from entries and matches: two joins between
large tables, made when items are stored instead of in every report. They lie by company, year of
date and `open_year`, the last year at whose start an item may still be shown as open: the year its match
is complete, ALWAYS_OPEN for unmatched third-party items and NEVER_OPEN for other unmatched ones. So
a report reads the years it covers and, of the years before, what is still open. Within a partition
they are sorted by account, so that files' statistics let account filters skip them.

The `rollup` holds sums of the items per account, journal, partner, state, month and month of match:
openings are summed from it instead of from the history.

Everything is written under a version; a manifest, written last and by one task, lists the folders of that
version. Readers take the latest manifest, so a store changes all at once or not at all. A batch rewrites
only partitions in which an item changes, and adds folders for new items; all other folders stay listed.
`write_tables` of a store read back makes one folder of many.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas as S
from ledgerloom.sources.staging import CODEC, at_least, staged, tasks_for
from ledgerloom.sources.tables import (
    LedgerTables, check_table, prepare, with_entry_columns)

ITEMS, ROLLUP = "account_move_line", "rollup"
PARTS = ("company_id", "date_year", "open_year")
ROWS_PER_FILE = 4_000_000
# Columns that items are looked up by besides the order they lie in: Bloom filters, of the smaller of
# two sizes where a file's values fit, or dictionaries where a file has few values. Readers skip what
# lacks a value. Every value goes into a filter of each size still possible, so more sizes take longer.
_LOOKUPS = {"parquet.bloom.filter.adaptive.enabled": "true",
            "parquet.bloom.filter.candidates.number": "2",
            "parquet.bloom.filter.max.bytes": str(1 << 20),
            **{f"parquet.bloom.filter.enabled#{c}": "true"
               for c in ("partner_id", "move_id", "move_name", "full_reconcile_id")}}
_CELL = ("account_id", "journal_id", "partner_id", "parent_state", "month", "matched", "match_month")
_MANIFEST = "name string, folder string, company_id bigint, date_year int, open_year int"


def _rollup_schema(scale: int) -> T.StructType:
    money = T.DecimalType(28, scale)
    kinds = dict(zip(_CELL, (T.LongType(),) * 3 + (
        T.StringType(), T.DateType(), T.BooleanType(), T.DateType())))
    return T.StructType([T.StructField(n, k) for n, k in (
        *kinds.items(), *[(c, money) for c in S.FLOWS], ("company_id", T.LongType()))]
        + list(S.STORE_COLUMNS))


# -- manifests -----------------------------------------------------------------------------------

def _commit(spark: SparkSession, path: str, version: int, rows: Iterable[Row]) -> None:
    """List the folders of a version. One task writes one file, which appears at once."""
    (spark.createDataFrame(list(rows), _MANIFEST).coalesce(1)
     .write.parquet(f"{path}/manifest/version={version}"))


def _manifest(spark: SparkSession, path: str) -> tuple[int, list[Row]]:
    """The latest version and its folders: a row per table and partition, not per file."""
    rows = spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{path}/manifest")
    version = rows.agg(F.max("version")).first()[0]
    return version, rows.where(F.col("version") == version).drop("version").collect()


def _folder(version: int, part: Row) -> str:
    def value(x: int | None) -> str:
        return "__HIVE_DEFAULT_PARTITION__" if x is None else str(x)
    return "/".join([f"version={version}", *[f"{c}={value(part[c])}" for c in PARTS]])


# -- items -----------------------------------------------------------------------------------------

def open_year(third_party: Column) -> Column:
    """The last year at whose start an item may be shown as open."""
    return (F.when(F.col("full_reconcile_id").isNotNull(), F.year("last_match_date"))
            .when(third_party, S.ALWAYS_OPEN).otherwise(S.NEVER_OPEN).cast("int"))


def _placed(items: DataFrame, accounts: DataFrame) -> DataFrame:
    """Prepared items with the years they lie under."""
    third = accounts.select(F.col("id").alias("account_id"), F.lit(True).alias("_third")).where(
        F.col("type_third_parties").isin(*S.THIRD_PARTIES))
    return (items.drop("date_year", "open_year").join(third, "account_id", "left")
            .withColumns({"date_year": F.year("date"),
                          "open_year": open_year(F.coalesce("_third", F.lit(False)))})
            .drop("_third"))


def _write_items(items: DataFrame, path: str, version: int, rows_per_file: int,
                 tasks: int | None) -> list[Row]:
    """Write items and their sums under a version; the folders written.

    Items are range-partitioned with their unique id as the last key: a company, year or account of any
    size is cut into even files, with filters for lookups by partner, entry and match. `tasks` grows
    with the items, so that no task sorts more than fits its memory. Sums are written as they were
    grouped, as a few of them in each task and partition serve readers as well as long files.
    """
    spark = items.sparkSession
    spread = (*PARTS, "account_id", "date", "id")
    target = f"{path}/{ITEMS}/version={version}"
    many = () if tasks is None else (tasks,)
    writer = items.repartitionByRange(*many, *spread).sortWithinPartitions(*spread).write
    writer = writer.option("maxRecordsPerFile", rows_per_file).options(compression=CODEC, **_LOOKUPS)
    writer.partitionBy(*PARTS).parquet(target)
    written = spark.read.schema(items.schema).parquet(target)
    month = F.trunc("date", "month")
    cells = (written.where(F.col("display_type").isNull())
             .groupBy(*PARTS, "account_id", "journal_id", "partner_id", "parent_state",
                      month.alias("month"), F.col("full_reconcile_id").isNotNull().alias("matched"),
                      F.trunc("last_match_date", "month").alias("match_month"))
             .agg(*[F.sum(c).alias(c) for c in S.FLOWS]))
    schema = _rollup_schema(S.money_scale(items))
    cells = S.conform(cells, schema).sortWithinPartitions(*PARTS, "account_id", "partner_id", "month")
    (cells.write.option("compression", CODEC).partitionBy(*PARTS)
     .parquet(f"{path}/{ROLLUP}/version={version}"))
    parts = written.select(*PARTS).distinct().collect()
    summed = spark.read.schema(schema).parquet(f"{path}/{ROLLUP}/version={version}")
    return [Row(name=name, folder=_folder(version, p), **p.asDict()) for name, found in (
        (ITEMS, parts), (ROLLUP, summed.select(*PARTS).distinct().collect())) for p in found]


def _table_row(name: str, folder: str) -> Row:
    return Row(name=name, folder=folder, company_id=None, date_year=None, open_year=None)


def write_tables(tables: LedgerTables, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Store the tables under a new folder, for `read_store` and `add_to_store`."""
    spark = tables.spark
    tasks = tasks_for(spark, tables.items.count())
    with at_least(spark, tasks):
        items = _placed(prepare(tables, tasks).items, tables["account_account"])
        rows = _write_items(items, path, 1, rows_per_file, tasks)
    rows.append(_table_row("scale", str(S.money_scale(tables.items))))
    for name in S.TABLES:
        if name != ITEMS:
            tables[name].write.option("compression", CODEC).parquet(f"{path}/{name}/version=1")
            rows.append(_table_row(name, "version=1"))
    _commit(spark, path, 1, rows)


def read_store(spark: SparkSession, path: str) -> LedgerTables:
    """The latest version of a store. No file is opened for its schema: the manifest has the decimal
    places of the amounts, and the rest is known."""
    return _read(spark, path)[0]


def _read(spark: SparkSession, path: str) -> tuple[LedgerTables, int, list[Row]]:
    version, rows = _manifest(spark, path)

    def read(name: str, schema: T.StructType) -> DataFrame:
        folders = [f"{path}/{name}/{r.folder}" for r in rows if r.name == name]
        if not folders:
            return spark.createDataFrame([], schema)
        return (spark.read.option("basePath", f"{path}/{name}").schema(schema).parquet(*folders)
                .select(*schema.names))

    scale = int(next(r.folder for r in rows if r.name == "scale"))
    items = T.StructType(
        [T.StructField(f.name, T.DecimalType(18, scale) if f.dataType == S.MONEY else f.dataType)
         for f in S.TABLES[ITEMS]] + [*S.PREPARED_COLUMNS, *S.STORE_COLUMNS])
    schemas = {**S.TABLES, ITEMS: items, ROLLUP: _rollup_schema(scale)}
    return LedgerTables({n: read(n, s) for n, s in schemas.items()}), version, rows


def _match_key() -> Column:
    """An item's match; unmatched items get negative numbers, which no match has, so that joins do not
    send them all to one task."""
    return F.coalesce("full_reconcile_id", -1 - F.pmod(F.xxhash64("id"), F.lit(1 << 20)))


# -- batches ----------------------------------------------------------------------------------------

def add_to_store(spark: SparkSession, path: str, batch: Mapping[str, DataFrame],
                 matches: DataFrame | None = None, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Fold a batch into the store, as if all had been stored at once.

    batch has, by table, new rows and new states of old ones: new items only, entries and all other
    tables by id. matches (id, full_reconcile_id) match items of the store, or unmatch them with a
    null. An item changes if it is matched, if its match gets or loses another, if its entry changes, or
    if its account becomes or ceases to be a third party's; partitions with such items are rewritten.
    """
    tables, version, listed = _read(spark, path)
    version += 1
    merged = {}
    for name in S.TABLES:
        if name != ITEMS and name in batch:
            given = check_table(name, batch[name])
            merged[name] = tables[name].join(given, "id", "left_anti").unionByName(given)
    now, old = tables.with_frames(**merged), tables.items
    matched = (old.select("id").limit(0).withColumn("_match", F.lit(None).cast("bigint"))
               if matches is None else matches.select(
                   F.col("id").cast("bigint"), F.col("full_reconcile_id").cast("bigint").alias("_match")))
    matched = matched.withColumn("_rematched", F.lit(True))
    entries = (check_table("account_move", batch["account_move"]) if "account_move" in batch
               else tables["account_move"].limit(0))
    entries = entries.select(F.col("id").alias("move_id"), F.col("state").alias("_state"),
                             F.col("name").alias("_name"), F.lit(True).alias("_entered"))
    third = F.coalesce(F.col("type_third_parties").isin(*S.THIRD_PARTIES), F.lit(False))
    turned = (now["account_account"].select("id", third.alias("a"))
              .join(tables["account_account"].select("id", third.alias("b")), "id", "left")
              .where(~F.col("a").eqNullSafe(F.coalesce("b", F.lit(False))))
              .select(F.col("id").alias("account_id"), F.lit(True).alias("_turned")))

    def changed(rows: DataFrame) -> DataFrame:
        """Rows of the store with what the batch says of each of them."""
        return (rows.join(matched, "id", "left").join(entries, "move_id", "left")
                .join(turned, "account_id", "left"))

    new = None
    if ITEMS in batch:
        new = LedgerTables({ITEMS: check_table(ITEMS, batch[ITEMS]), "account_move": now["account_move"]})
        new = with_entry_columns(new).items.drop("last_match_date", "date_year", "open_year")
    # matches whose items change: the last date of all their items has to be found again
    direct = changed(old.select("id", "move_id", "account_id", "full_reconcile_id", *PARTS))
    touched = direct.where("_rematched").select(
        "company_id", F.explode(F.array("full_reconcile_id", "_match")).alias("_k"))
    if new is not None:
        touched = touched.unionByName(new.select("company_id", F.col("full_reconcile_id").alias("_k")))
    touched = staged(touched.where("_k IS NOT NULL").distinct().withColumn("_touched", F.lit(True)))
    key = ["company_id", "_k"]
    affected = direct.withColumn("_k", _match_key()).join(touched, key, "left").where(
        "_rematched OR _entered OR _turned OR _touched")
    parts = {tuple(r) for r in affected.select(*PARTS).distinct().collect()}

    gone = [r for r in listed if r.name == ITEMS and (r.company_id, r.date_year, r.open_year) in parts]
    folders = [f"{path}/{ITEMS}/{r.folder}" for r in gone]
    if folders:
        again = (spark.read.option("basePath", f"{path}/{ITEMS}").schema(old.schema).parquet(*folders))
        again = changed(again.drop("version")).withColumns({
            "full_reconcile_id": F.when(F.col("_rematched"), F.col("_match")).otherwise(
                F.col("full_reconcile_id")),
            "parent_state": F.when(F.col("_entered"), F.col("_state")).otherwise(F.col("parent_state")),
            "move_name": F.when(F.col("_entered"), F.col("_name")).otherwise(F.col("move_name"))})
        again = again.select(*[c for c in old.columns if c not in ("date_year", "open_year")])
        rows = again if new is None else again.unionByName(new, allowMissingColumns=True)
    elif new is None:
        rows = old.limit(0).drop("date_year", "open_year")
    else:
        rows = new.withColumn("last_match_date", F.lit(None).cast("date"))
    rows = staged(rows.withColumn("_k", _match_key()).join(touched, key, "left"))
    tasks = tasks_for(spark, rows.count())
    dates = (rows.where("_touched").groupBy(*key).agg(F.max("date").alias("_last")))
    last = (F.when(F.col("_touched"), F.col("_last"))
            .when(F.col("full_reconcile_id").isNotNull(), F.col("last_match_date")))
    rows = rows.join(dates, key, "left").withColumn("last_match_date", last).drop("_k", "_touched", "_last")

    written = _write_items(_placed(rows, now["account_account"]), path, version, rows_per_file, tasks)
    for name, frame in merged.items():
        frame.write.parquet(f"{path}/{name}/version={version}")
        written.append(_table_row(name, f"version={version}"))
    stay = [r for r in listed if r.name not in merged
            and (r.name not in (ITEMS, ROLLUP) or (r.company_id, r.date_year, r.open_year) not in parts)]
    _commit(spark, path, version, [*stay, *written])
