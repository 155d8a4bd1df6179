"""Totals per object and for the report, and sums over line listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.functions.columns import age_of, net_opening, round_to, sum0
from ledgerloom.operators.history import past
from ledgerloom.operators.lines import line_pred, scope, started, with_needed_dates
from ledgerloom.operators.objects import unaffected_id, whole_company
from ledgerloom.operators.opening import (
    balance_sheet, opening_group, opening_pred, prior_result, prior_seed, significant_opening)
from ledgerloom.operators.scan import currency_columns, in_states
from ledgerloom.options import OBJECT_COLUMNS, ReportOptions
from ledgerloom.sources.tables import LedgerTables


def report_sums(tables: LedgerTables, o: ReportOptions) -> DataFrame:
    """All that a report sums up, from one pass over the items.

    Every item is opening, line, compacted or nothing, and a line has an age. Sums per object
    (and account, where openings are kept apart by account), kind and age take all items up at
    once, before any row is shuffled; openings, carried balances, compacted lines and totals
    work on these few sums. The result of prior years is of the kind `prior`: from the same pass
    where the report covers the whole company, else from one of its own. Where a store has sums
    per month, openings and prior results come from these, and the pass reads lines only.
    """
    compact = o.compact_account and o.ledger_type == "general"
    until = o.date_to
    if o.ledger_type == "open":
        until = o.day_before
    elif o.has_opening:
        until = max(o.date_to, o.day_before)
    group = opening_group(o) if o.has_opening else [o.object_column]
    prior_to = unaffected_id(tables, o) if whole_company(o) else None
    whole, summed = prior_to is not None, tables.rollup is not None and o.has_opening
    covered = ~F.coalesce("deprecated", F.lit(False)) if whole else F.lit(True)
    age = age_of(F.col("date_maturity"), F.lit(o.date_to)).alias("age")
    line = F.when(covered & line_pred(tables, o), "line")
    if compact:
        line = line.when(covered & started(o) & (F.col("date") <= F.lit(o.date_to))
                         & F.coalesce("compacted", F.lit(False)), "compact")
    opened = F.when(covered & ~started(o) & opening_pred(o), "opening")
    prior = ~started(o) & ~balance_sheet() if whole else F.lit(False)
    items = with_needed_dates(scope(tables, o, until, whole=whole), tables, o,
                              flags=False, openings=o.has_opening)
    if summed:
        before = scope(past(tables, o), o, o.day_before, whole=whole)
        rows = items.select(*group, *S.FLOWS, line.alias("kind"), F.lit(False).alias("prior"), age)
        rows = rows.unionByName(before.select(
            *group, *S.FLOWS, opened.alias("kind"), prior.alias("prior"),
            F.lit(None).cast("string").alias("age")))
    else:
        kind = F.coalesce(line, opened) if o.has_opening else line
        entry = ["move_id"] if tables.late else []
        rows = items.select(*group, *S.FLOWS, kind.alias("kind"), prior.alias("prior"), age, *entry)
    rows = rows.where(F.col("kind").isNotNull() | F.col("prior"))
    # only lines have an age
    rows = rows.withColumn("age", F.when(F.col("kind") == "line", F.col("age")))
    if tables.late:
        rows = in_states(rows, tables, o.states)
    parts = (rows
             .groupBy(*group, "kind", "age", "prior")
             .agg(*[F.sum(c).alias(c) for c in S.FLOWS]))
    if prior_to is not None:
        # A result account that is a third party's counts in both ways.
        result = f"named_struct('account_id', {prior_to}L, 'kind', 'prior', 'age', NULL)"
        return (parts.select(*S.FLOWS, F.explode(F.array_compact(F.array(
                    F.expr("IF(kind IS NULL, NULL, named_struct("
                           "'account_id', account_id, 'kind', kind, 'age', age))"),
                    F.expr(f"IF(prior, {result}, NULL)")))).alias("part"))
                .select("part.*", *S.FLOWS)
                .unionByName(prior_seed(tables, prior_to), allowMissingColumns=True))
    parts = parts.drop("prior")
    if o.report_type == "account" and o.has_opening and not whole_company(o):
        parts = parts.unionByName(
            prior_result(tables, o).withColumn("kind", F.lit("prior")), allowMissingColumns=True)
    return parts


def object_parts(sums: DataFrame, tables: LedgerTables, o: ReportOptions) -> DataFrame:
    """What each object's total is made of, from the report's sums. Small openings are dropped as
    they are from the report."""
    group = opening_group(o) if o.has_opening else [o.object_column]

    def total(column: str, condition: str) -> Column:
        return F.expr(f"coalesce(sum({column}) FILTER (WHERE {condition}), 0)")

    listed = "kind IN ('line', 'compact')"
    sums = sums.groupBy(*group).agg(
        *[total(c, "kind = 'opening'").alias(c) for c in S.FLOWS],
        *[total(c, "kind = 'prior'").alias(f"prior_{c}") for c in S.FLOWS],
        *[total(c, listed).alias(f"listed_{c}") for c in S.FLOWS],
        *[total("balance", f"kind = 'line' AND age = '{c}'").alias(c) for c in S.AGE_COLUMNS],
        F.expr("bool_or(kind <> 'opening')").alias("listed"))
    if not o.has_opening:
        return sums.select(
            F.col(o.object_column).alias("report_object_id"),
            *[F.col(f"listed_{c}").alias(c) for c in S.FLOWS], *S.AGE_COLUMNS)
    keep = significant_opening(tables, o)

    def opened(prefix: str) -> dict[str, Column]:
        flows = [F.col(f"{prefix}{c}") for c in S.FLOWS]
        return dict(zip(S.FLOWS, [*net_opening(*flows, o.init_balance_history), flows[-1]]))

    own, result = opened(""), opened("prior_")
    return sums.where(keep | F.col("listed")).select(
        F.col(o.object_column).alias("report_object_id"),
        *[(F.when(keep, own[c]).otherwise(0) + result[c] + F.col(f"listed_{c}")).alias(c)
          for c in S.FLOWS],
        *S.AGE_COLUMNS)


def total_rows(parts: DataFrame, o: ReportOptions) -> DataFrame:
    """Totals per object and the grand total, from one roll-up of the objects' parts.

    A row of nothing is added first, so an empty report still has its grand total of zero.
    """
    nothing = parts.sparkSession.range(1).select(
        F.lit(None).cast("bigint").alias("report_object_id"))
    seeded = parts.unionByName(nothing, allowMissingColumns=True)
    whole = F.grouping("report_object_id") == 1
    totals = (seeded.rollup("report_object_id").agg(
        whole.alias("is_grand"), *[sum0(c).alias(c) for c in S.AMOUNTS])
        .where(F.col("is_grand") | F.col("report_object_id").isNotNull()))
    return _tag(totals, F.col("is_grand"), o)


def _tag(totals: DataFrame, is_grand: Column, o: ReportOptions) -> DataFrame:
    return totals.withColumns({
        "report_id": F.lit(o.report_id).cast("bigint"),
        "line_type": F.when(is_grand, S.SUPER_TOTAL).otherwise(S.TOTAL),
        "view_type": F.lit("total"), "date": F.lit(o.date_from),
        "cumul_balance": F.col("balance"), o.object_column: F.col("report_object_id")})


def round_totals(totals: DataFrame) -> DataFrame:
    """Round totals to the currency's smallest unit. The running balance stays as it is."""
    return totals.withColumns({c: round_to(F.col(c), F.col("rounding")) for c in S.AMOUNTS})


def report_totals(tables: LedgerTables, o: ReportOptions,
                  sums: DataFrame | None = None) -> DataFrame:
    """Rounded totals of a report, from its sums; without them, straight from the items."""
    sums = report_sums(tables, o) if sums is None else sums
    parts = object_parts(sums, tables, o)
    return round_totals(total_rows(parts, o).withColumns(currency_columns(tables, o)))


def object_totals(lines: DataFrame, o: ReportOptions) -> DataFrame:
    """Total per object over lines of any kind but totals."""
    totals = (lines.where(F.col("line_type").isin(*S.BODY_TYPES)
                          & F.col("report_object_id").isNotNull())
              .groupBy("report_object_id")
              .agg(*[sum0(c).alias(c) for c in S.AMOUNTS],
                   F.max("company_currency_id").alias("company_currency_id")))
    return _tag(totals, F.lit(False), o)


def grand_total(totals: DataFrame, o: ReportOptions) -> DataFrame:
    """One row over the objects' totals; zeros if there are none."""
    whole = totals.where(F.col("line_type") == S.TOTAL).agg(
        *[sum0(c).alias(c) for c in S.AMOUNTS],
        F.max("company_currency_id").alias("company_currency_id"))
    return _tag(whole.withColumn("report_object_id", F.lit(None).cast("bigint")),
                F.lit(True), o)


def group_lines(lines: DataFrame, by: str) -> DataFrame:
    """Lines summed by account, partner, journal or analytic account. Running balances cannot
    be summed: a group's is its debit less its credit."""
    if by not in OBJECT_COLUMNS.values():
        raise ValueError(f"lines are grouped by one of {tuple(OBJECT_COLUMNS.values())}")
    return (lines.groupBy(by).agg(F.count(F.lit(1)).alias("line_count"),
                                  *[sum0(c).alias(c) for c in S.AMOUNTS])
            .withColumn("cumul_balance", F.col("debit") - F.col("credit")))


def listing_footer(lines: DataFrame, aged: bool = False) -> DataFrame:
    """Sums under a line listing: debit and credit, or ages and balance."""
    columns = (*S.AGE_COLUMNS, "balance") if aged else ("debit", "credit")
    return lines.agg(*[sum0(c).alias(c) for c in columns])


def section_totals(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column totals per object and (object null, `is_sheet`) for all of them."""
    return (lines.where(F.col("report_object_id").isNotNull())
            .rollup("report_object_id")
            .agg((F.grouping("report_object_id") == 1).alias("is_sheet"),
                 *[sum0(c).alias(c) for c in columns]))
