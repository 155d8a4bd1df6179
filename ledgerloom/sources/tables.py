"""The ledger's input tables: reading, checking and preparing them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas as S
from ledgerloom.sources.staging import tasks_for


@dataclass(frozen=True)
class LedgerTables:
    """Input tables by name. `items` is the fact; all others describe it."""

    frames: dict[str, DataFrame] = field(repr=False)
    _known: dict[str, Any] = field(default_factory=dict, repr=False, compare=False)
    #: of prepared tables: the same as extracted, where a report selects rows before it joins them
    extract: LedgerTables | None = field(default=None, repr=False, compare=False)
    #: whether items get their entry's columns from a report, for the rows it has selected
    late: bool = False

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]

    def __contains__(self, name: str) -> bool:
        return name in self.frames

    @property
    def items(self) -> DataFrame:
        return self.frames["account_move_line"]

    @property
    def spark(self) -> SparkSession:
        return self.items.sparkSession

    def currency(self, company_id: int) -> tuple[int | None, Decimal | None]:
        """Id and rounding of a company's currency: one row, looked up once."""
        def find() -> tuple[int | None, Decimal | None]:
            row = (self["res_company"].where(F.col("id") == company_id).alias("c")
                   .join(self["res_currency"].alias("r"), F.col("c.currency_id") == F.col("r.id"))
                   .select("r.id", "r.rounding").first())
            return (row.id, row.rounding) if row else (None, None)
        return self.known(f"currency {company_id}", find)

    def known(self, key: str, find: Callable[[], Any]) -> Any:
        """A small fact about the tables, found once."""
        if key not in self._known:
            self._known[key] = find()
        return self._known[key]

    def tasks(self) -> int | None:
        """Tasks for a shuffle of the items, by the number of entries, which have a few items each and are
        counted without the joins that prepared items come from."""
        return self.known("tasks", lambda: tasks_for(self.spark, self["account_move"].count())
                          if "account_move" in self else None)

    @property
    def rollup(self) -> DataFrame | None:
        """Sums of the items per month, of a store."""
        return self.frames.get("rollup")

    def with_frames(self, **frames: DataFrame) -> "LedgerTables":
        """Tables with some replaced. A store's sums, and the columns it is pruned by, hold for its
        own items and accounts only, so they go with these."""
        kept = self.frames
        if self.rollup is not None and {"account_move_line", "account_account"} & set(frames):
            kept = {n: f for n, f in kept.items() if n != "rollup"}
            items = frames.get("account_move_line", self.items)
            frames = {**frames, "account_move_line": items.drop("open_year")}
        return replace(self, frames={**kept, **frames}, _known={}, extract=None, late=False)


def check_table(name: str, df: DataFrame) -> DataFrame:
    """Check a table against its schema and select its columns.

    Reads nothing: only column names and types are looked at. Numbers of another width are
    cast; amounts must be decimals, so that no figure passes through binary floats.
    """
    expected = {f.name: f.dataType for f in S.TABLES[name]}
    actual = {f.name: f.dataType for f in df.schema}
    missing = [c for c in expected if c not in actual]
    if missing:
        raise ValueError(f"{name} lacks columns {missing}")
    columns = []
    for column, kind in expected.items():
        given = actual[column]
        if kind == S.MONEY:
            if not isinstance(given, T.DecimalType):
                raise ValueError(f"{name}.{column} must be a decimal, not {given.simpleString()}")
            columns.append(F.col(column))
        elif given == kind:
            columns.append(F.col(column))
        elif isinstance(given, T.StringType) != isinstance(kind, T.StringType):
            raise ValueError(
                f"{name}.{column} must be {kind.simpleString()}, not {given.simpleString()}")
        else:
            columns.append(F.col(column).cast(kind).alias(column))
    if name == "account_move_line":
        extra = [f.name for f in (*S.PREPARED_COLUMNS, *S.STORE_COLUMNS)]
        columns += [F.col(c) for c in extra if c in actual]
    return df.select(*columns)


def load_tables(read: Callable[[str], DataFrame]) -> LedgerTables:
    """Load every table with `read(name)`: files, a catalog or JDBC alike, for example
    ``load_tables(spark.table)`` or ``load_tables(lambda n: spark.read.jdbc(url, n))``."""
    return LedgerTables({name: check_table(name, read(name)) for name in S.TABLES})


def read_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> LedgerTables:
    """Read the tables from one folder each under `path`."""
    return load_tables(lambda name: spark.read.format(fmt).load(f"{path}/{name}"))


def fold_account_types(accounts: DataFrame, types: DataFrame,
                       unaffected_type_id: int) -> DataFrame:
    """Bring the separate account-type table of a raw extract into the accounts."""
    kinds = types.select(F.col("id").alias("user_type_id"), "include_initial_balance")
    return (accounts.join(kinds, "user_type_id", "left")
            .withColumn("is_unaffected_earnings",
                        F.col("user_type_id") == F.lit(unaffected_type_id))
            .drop("user_type_id"))


def with_entry_columns(tables: LedgerTables) -> LedgerTables:
    """Items with their entry's state and name."""
    wanted = {"parent_state": "state", "move_name": "name"}
    missing = {new: old for new, old in wanted.items() if new not in tables.items.columns}
    if not missing:
        return tables
    entries = tables["account_move"].select(
        F.col("id").alias("move_id"), *[F.col(old).alias(new) for new, old in missing.items()])
    return tables.with_frames(account_move_line=tables.items.join(entries, "move_id", "left"))


def with_match_date(tables: LedgerTables, tasks: int | None = None) -> LedgerTables:
    """Items with `last_match_date`, the date of the last item in their match. Every rule about
    matches compares this date with a report's dates, so it serves all reports.

    Unmatched items, the majority, go around the join: in it, their null key would put them all
    into one task. `tasks` is for a whole load, where the session's number is too few: its items are
    dealt by match once, and the date is found beside them. A report's filters would not reach below that.
    """
    items = tables.items
    if "last_match_date" in items.columns:
        return tables
    keys = ["company_id", "full_reconcile_id"]
    matched = F.col("full_reconcile_id").isNotNull()
    if tasks is not None:
        last = F.max("date").over(Window.partitionBy(*keys))
        # without a company an item is in no match, as in a join by these keys
        dated = items.where(matched).withColumn(
            "last_match_date", F.when(F.col("company_id").isNotNull(), last))
    else:
        dates = items.where(matched).groupBy(*keys).agg(F.max("date").alias("last_match_date"))
        dated = items.where(matched).join(dates, keys, "left")
    return tables.with_frames(account_move_line=dated.unionByName(
        items.where(~matched).withColumn("last_match_date", F.lit(None).cast("date"))))


def prepare(tables: LedgerTables, tasks: int | None = None) -> LedgerTables:
    """Tables as reports want them: items with their entry's state and name and the last date
    in their match. A lazy step for an extract that is reported on once; `write_tables` does
    it for a store. A single report joins the rows it selects instead of all items (`extract`)."""
    done = with_match_date(with_entry_columns(tables), tasks)
    found = {"parent_state", "move_name", "last_match_date"}
    if tasks is not None or found & set(tables.items.columns):
        return done
    return replace(done, extract=replace(tables, late=True))
