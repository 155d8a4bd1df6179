"""Report lines labelled and shaped for export, and the writer of stored reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.functions.columns import (
    analytic_label, blank_zero, code_and_name, optional_code_and_name, sum0)
from ledgerloom.operators.matching import matching_label
from ledgerloom.operators.objects import section_heading
from ledgerloom.options import ReportOptions
from ledgerloom.sources.staging import CODEC, at_least, shared_folder, staged
from ledgerloom.sources.tables import LedgerTables

DETAIL_TYPES = S.BODY_TYPES
AGED_DETAIL_TYPES = (S.INIT_LINE, S.LINE)


def write_lines(lines: DataFrame, path: str) -> None:
    """Store lines by report. A report written again replaces itself and nothing else."""
    (lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("report_id").parquet(path))


def lines_of(lines: DataFrame, types: tuple[str, ...], object_id: int | None = None) -> DataFrame:
    """Lines of some types, of all objects or one."""
    lines = lines.where(F.col("line_type").isin(*types))
    return lines if object_id is None else lines.where(F.col("report_object_id") == object_id)


def view_lines(lines: DataFrame) -> DataFrame:
    """The interactive listing: everything but totals."""
    return lines.where(~F.col("line_type").isin(S.TOTAL, S.SUPER_TOTAL))


def line_rank() -> Column:
    """Position of a line type in its section; the type's tag starts with it."""
    return F.substring("line_type", 1, 1).cast("int")


def _display_keys() -> list[Column]:
    return [F.col("object_name"), F.col("report_object_id"), line_rank(), F.col("date"),
            F.col("move_line_id").asc_nulls_first()]


def display_order(df: DataFrame) -> DataFrame:
    """Sort for display: sections by object name, then by kind of line, date and item. The
    last column is unique, so the sort spreads over tasks whatever the size of a section."""
    return df.orderBy(*_display_keys())


def with_position(df: DataFrame) -> DataFrame:
    """Rows with `position`, their number in display order from 1.

    Rows are sorted into ranges, kept, and counted per range; only the counts meet in a window.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    (df.repartitionByRange(*_display_keys()).sortWithinPartitions(*_display_keys())
     .withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
     .write.option("compression", CODEC).parquet(path))
    rows = spark.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    offsets = ranges.select("_range", (F.coalesce(F.sum("_n").over(before), F.lit(0))
                                       - F.col("_first") + 1).alias("_offset"))
    return (rows.join(offsets, "_range")
            .withColumn("position", F.col("_row") + F.col("_offset"))
            .drop("_range", "_row", "_offset"))


def stamp_lines(lines: DataFrame, user_id: int, created: Column | None = None) -> DataFrame:
    """Lines with who made them and when, for storing."""
    created = F.current_timestamp() if created is None else created
    return lines.withColumns({"create_uid": F.lit(user_id).cast("bigint"), "create_date": created})


def join_optional(lines: DataFrame, table: DataFrame, key: str, when: Column | None = None) -> DataFrame:
    """Left join on a key many lines do not have.

    `table` has the key as its first column. Lines without one get a negative number made
    from the line itself instead: no id is negative, so they still find nothing, but are not
    all sent to the one task of the null key. With `when`, lines it excludes are not joined, nor shuffled.
    """
    if when is not None:
        wanted = F.coalesce(when & F.col(key).isNotNull(), F.lit(False))
        return join_optional(lines.where(wanted), table, key).unionByName(
            lines.where(~wanted), allowMissingColumns=True)
    has_key = F.col(key).isNotNull()
    spread = -1 - F.pmod(F.xxhash64("account_id", "partner_id", "move_line_id"), F.lit(1 << 20))
    keyed = lines.withColumn("_key", F.when(has_key, F.col(key)).otherwise(spread))
    first, *rest = table.columns
    return keyed.join(table.withColumnRenamed(first, "_key"), "_key", "left").drop("_key")


def labelled_lines(lines: DataFrame, tables: LedgerTables, options: ReportOptions) -> DataFrame:
    """Lines with the codes, names and labels exports show."""
    o = options

    def table(name: str, **columns: str) -> DataFrame:
        return tables[name].select(
            F.col("id").alias(f"_{name}_id"), *[F.col(c).alias(n) for n, c in columns.items()])

    out = lines.drop("move_name") if "account_move" in tables and not _has_names(tables) else lines
    # tables that may be large come first, so that lines are not shuffled with the names of small ones
    out = join_optional(out, table("account_full_reconcile", match_name="name"),
                        "full_reconcile_id", when=F.col("reconciled"))
    if "move_name" not in out.columns:
        out = join_optional(out, table("account_move", move_name="name"), "move_id")
    out = join_optional(out, table("res_partner", p_ref="ref", p_name="name",
                                   partner_name="display_name"), "partner_id")
    out = join_optional(out, table("account_account", a_code="code", a_name="name"), "account_id")
    out = join_optional(out, table("account_journal", j_code="code", j_name="name"), "journal_id")
    out = join_optional(out, table("account_analytic_account", an_code="code", an_name="name"),
                        "analytic_account_id")
    out = join_optional(out, table("res_currency", currency="name"), "currency_id")
    code, name = {"account": ("a_code", "a_name"), "journal": ("j_code", "j_name"),
                  "analytic": ("an_code", "an_name"), "partner": ("p_ref", "p_name")}[o.report_type]
    label = matching_label(F.col("reconciled"), F.col("full_reconcile_id"), F.col("match_name"))
    # every row but the grand total has its object's key, so its name was joined above
    named = code_and_name if o.report_type in ("account", "journal") else optional_code_and_name
    return out.select(
        "report_id", "report_object_id", named(F.col(code), F.col(name)).alias("object_name"),
        "line_type", "view_type",
        F.col(code).alias("code"), F.col(name).alias("name"),
        "j_code", "a_code", "a_name", "an_code", "an_name",
        *S.AGE_COLUMNS, "credit", "debit", "cumul_balance", "balance",
        F.col("item_name").alias("displayed_name"), "move_name",
        F.col("item_ref").alias("displayed_ref"), "partner_name", "date", "date_maturity",
        "amount_currency", "currency", label.alias("matching_number"),
        "account_id", "partner_id", "move_line_id")


def _has_names(tables: LedgerTables) -> bool:
    return "move_name" in tables.items.columns


def date_text(date: str | Column, pattern: str) -> Column:
    return F.date_format(date, pattern)


def line_label(form: str, pattern: str = "MM/dd/yyyy") -> Column:
    """The date cell. Workbooks mark every opening row; statements only summed ones, and they
    name compacted and total rows. `form`: workbook, statement, aged."""
    date, kind = date_text("date", pattern), F.col("line_type")
    if form == "workbook":
        return F.when(F.col("view_type") == "init", "INIT").otherwise(date)
    if form == "aged":
        return F.when(F.col("view_type") == "total", "Total").otherwise(date)
    return (F.when(kind == S.INIT, "INIT").when(kind == S.COMPACT, "Compact")
            .when(F.col("view_type") == "total", "Total").otherwise(date))


def foreign_amount() -> tuple[Column, Column]:
    """Amount in foreign currency and the currency; both empty if there is none."""
    shown = F.coalesce(F.col("amount_currency") != 0, F.lit(False))
    return F.when(shown, F.col("amount_currency")), F.when(shown, F.col("currency"))


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).alias(column)


_SORT = ("report_id", "report_object_id", "object_name", "line_type", "move_line_id")


def pivot_rows(labelled: DataFrame, pattern: str = "MM/dd/yyyy") -> DataFrame:
    """Every detail line of all objects with its labels, in 15 columns (and sort keys)."""
    amount, currency = foreign_amount()
    return lines_of(labelled, DETAIL_TYPES).select(
        *_SORT, line_label("workbook", pattern).alias("date_label"),
        F.col("j_code").alias("journal"), F.col("a_code").alias("account"),
        F.col("a_name").alias("account_name"),
        analytic_label(F.col("an_code"), F.col("an_name")).alias("analytic"),
        F.col("move_name").alias("entry"), F.col("displayed_ref").alias("ref"),
        F.col("displayed_name").alias("name"), F.col("partner_name").alias("partner"),
        date_text("date_maturity", pattern).alias("due_date"), _zero("debit"), _zero("credit"),
        F.coalesce(F.col("cumul_balance"), F.lit(0)).alias("balance"),
        amount.alias("amount_currency"), currency.alias("currency"),
        F.col("matching_number").alias("match"), "date")


def aged_pivot_rows(labelled: DataFrame, pattern: str = "MM/dd/yyyy") -> DataFrame:
    """Every open item of an aged balance with its labels, in 16 columns (and sort keys)."""
    return lines_of(labelled, AGED_DETAIL_TYPES).select(
        *_SORT, date_text("date", pattern).alias("date_label"),
        F.col("j_code").alias("journal"), F.col("a_code").alias("account"),
        F.col("a_name").alias("account_name"), F.col("move_name").alias("entry"),
        F.col("displayed_name").alias("ref"), F.col("partner_name").alias("partner"),
        date_text("date_maturity", pattern).alias("due_date"),
        *[_zero(c) for c in (*S.AGE_COLUMNS, "balance")],
        F.col("matching_number").alias("match"), "date")


def section_rows(labelled: DataFrame, tables: LedgerTables, o: ReportOptions) -> DataFrame:
    """Per object a heading, its detail lines and column totals; objects without lines are
    left out. `section_part` orders the parts of a section. The balance, which runs, has no
    total outside aged balances.

    Labelled lines are made once and staged, then read twice: as they are, and summed per object; heading
    and totals are two rows of one sum.
    """
    aged = o.ledger_type == "aged"
    with at_least(labelled.sparkSession, tables.tasks()):
        rows = staged(aged_pivot_rows(labelled) if aged else pivot_rows(labelled))
    sums = (*S.AGE_COLUMNS, "balance") if aged else ("debit", "credit")
    per_object = (rows.where(F.col("report_object_id").isNotNull())
                  .groupBy("report_object_id", "object_name")
                  .agg(*[sum0(c).alias(c) for c in sums])
                  .withColumnRenamed("report_object_id", "object_id"))
    part = F.explode(F.array(F.lit("0_heading"), F.lit("2_totals")))
    headed = section_heading(per_object, tables, o).withColumn("section_part", part)
    totals = F.col("section_part") == "2_totals"
    edges = headed.select(
        F.col("object_id").alias("report_object_id"), "object_name", "section_part",
        F.when(~totals, F.col("heading")).alias("heading"),
        *[F.when(totals, F.col(c)).alias(c) for c in sums])
    body = rows.withColumn("section_part", F.lit("1_line"))
    return body.unionByName(edges, allowMissingColumns=True).withColumn(
        "report_id", F.lit(o.report_id).cast("bigint"))


def summary_rows(labelled: DataFrame) -> DataFrame:
    """A trial balance: code, name, debit, credit, balance per object."""
    return lines_of(labelled, (S.TOTAL,)).select(
        "report_object_id", "object_name", "code", "name", *S.FLOWS)


def aged_summary_rows(labelled: DataFrame) -> DataFrame:
    """An aged balance's summary: code, name, ages and total per partner."""
    return lines_of(labelled, (S.TOTAL,)).select(
        "report_object_id", "object_name", "code", "name",
        *[_zero(c) for c in S.AGE_COLUMNS], _zero("balance").alias("total"))


def statement_rows(labelled: DataFrame, o: ReportOptions,
                   pattern: str = "MM/dd/yyyy") -> DataFrame:
    """The printed statement: the grand total on top, then each object's lines and total, with
    zero amounts left blank. A trial balance prints its totals alone."""
    aged = o.ledger_type == "aged"
    amounts = (*S.AGE_COLUMNS,) if aged else ("debit", "credit")
    total = F.col("view_type") == "total"
    grand = F.col("line_type") == S.SUPER_TOTAL
    types = (S.TOTAL, S.SUPER_TOTAL) if o.summary else S.LINE_TYPES
    # In aged statements only period lines carry labels; elsewhere totals alone lack them.
    labelled_row = F.col("view_type") == "normal" if aged else ~total

    def text(column: str | Column) -> Column:
        return F.when(labelled_row, F.col(column) if isinstance(column, str) else column)

    balance = F.col("balance") if aged or o.summary else F.when(
        grand, F.col("balance")).otherwise(F.col("cumul_balance"))
    visible = (labelled_row | total) if aged else F.lit(True)
    common = [
        F.when(grand, 0).otherwise(1).alias("block"), *_SORT,
        F.when(grand, "Total").when(F.lit(o.summary), F.col("object_name")).otherwise(
            line_label("aged" if aged else "statement", pattern)).alias("label"),
        text("j_code").alias("journal"), text("a_code").alias("account"),
        text("move_name").alias("entry"),
        text(date_text("date_maturity", pattern)).alias("due_date"),
        *[F.when(visible, F.when(grand, F.col(c)).otherwise(blank_zero(F.col(c)))).alias(c)
          for c in amounts],
        F.when(visible, balance).alias("balance"),
        F.when(~total, F.col("matching_number")).alias("match"), "date"]
    if not aged:
        amount, _ = foreign_amount()
        common += [
            text(analytic_label(F.col("an_code"), F.col("an_name"))).alias("analytic"),
            text("displayed_ref").alias("ref"), text("partner_name").alias("partner"),
            F.when(F.col("view_type") == "normal", amount).alias("amount_currency")]
    return lines_of(labelled, types).select(*common)
