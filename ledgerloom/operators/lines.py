"""Detail lines of a report, and the one-line form of compacted accounts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.functions.columns import age_buckets, exceeds, sum0
from ledgerloom.operators.matching import (
    match_dates, open_at_start, reconciled_flag, with_match_dates)
from ledgerloom.operators.running import running_balance
from ledgerloom.operators.scan import (
    account_settings, currency_columns, dated, in_states, move_lines, select_accounts, with_entries)
from ledgerloom.options import ReportOptions
from ledgerloom.sources.tables import LedgerTables


def started(o: ReportOptions) -> Column:
    return F.col("date") >= F.lit(o.date_from)


def opening_line_pred(o: ReportOptions) -> Column:
    """Items from before the start shown one by one: third-party items still open then."""
    third_party = F.coalesce(F.col("type_third_parties").isin(*S.THIRD_PARTIES), F.lit(False))
    return third_party & open_at_start(o)


def shown(o: ReportOptions) -> Column:
    """Which items by date and openness: a journal ledger has no opening, an open ledger
    nothing but its opening."""
    if o.report_type == "journal":
        return started(o)
    if o.ledger_type == "open":
        return ~started(o) & opening_line_pred(o)
    return started(o) | opening_line_pred(o)


def line_pred(tables: LedgerTables, o: ReportOptions) -> Column:
    """Whether an item is a detail line of the report."""
    _, rounding = tables.currency(o.company_id)
    pred = (F.col("date") <= F.lit(o.date_to)) & exceeds("balance", rounding) & shown(o)
    if o.compact_account:
        pred = pred & ~F.coalesce("compacted", F.lit(False))
    if not o.reconciled:
        pred = pred & ~reconciled_flag(o)
    return pred


def scope(tables: LedgerTables, o: ReportOptions, until: dt.date,
          whole: bool = False) -> DataFrame:
    """Items of the report up to a date, with their account's settings: the input of lines
    and totals alike. Dates, journals and states are filtered in the scan; states that items are to get
    late, by whoever asks for the items. `whole` takes the company's other accounts as well."""
    since = o.date_from if o.report_type == "journal" else None
    items = dated(move_lines(tables, o), since=since, until=until)
    items = items.where(F.col(o.object_column).isNotNull())
    if "open_year" in items.columns:
        items = _still_open(items, o)
    accounts = select_accounts(tables, o)
    if whole:
        accounts = account_settings(tables).where(F.col("company_id") == o.company_id).drop(
            "company_id", "group_id")
    if not tables.late:
        items = in_states(items, tables, o.states)
    return items.join(accounts, "account_id")


def _still_open(items: DataFrame, o: ReportOptions) -> DataFrame:
    """Items of a store without those that cannot be a line: of the years before the start, only what
    is open then, and only what is open at the end where matched items are not shown."""
    items = items.where((F.col("date_year") >= o.date_from.year)
                        | (F.col("open_year") >= o.date_from.year))
    if not o.reconciled and o.report_type == "partner":
        items = items.where(F.col("open_year") >= o.date_to.year)
    return items


def with_needed_dates(items: DataFrame, tables: LedgerTables, o: ReportOptions, *,
                      flags: bool, openings: bool) -> DataFrame:
    """Items with the match dates the report's rules will look at, and no others.

    Items before the start need to know whether their match reaches the start, be it for the
    lines or for the `openings`. Whether it reaches past the end matters for the lines' flag
    (`flags`) and where only open items are shown; if the latter, that alone decides, as what
    reaches past the end reaches the start as well.
    """
    past_end_only = not openings and (
        o.report_type == "journal" or (not o.reconciled and o.date_from <= o.date_to))
    if past_end_only and (flags or not o.reconciled):
        return with_match_dates(
            items, F.lit(True), match_dates(tables, o, since=o.date_to + dt.timedelta(days=1)))
    if past_end_only and "last_match_date" not in items.columns:
        return items.withColumn("last_match_date", F.lit(None).cast("date"))
    # Plain accounts are summed or listed before the start whatever their matches.
    before_start = ~started(o) & ~F.coalesce(F.col("type_third_parties") == "no", F.lit(False))
    needed = F.lit(True) if flags or not o.reconciled else before_start
    return with_match_dates(items, needed, match_dates(tables, o, since=o.date_from))


def detail_lines(tables: LedgerTables, o: ReportOptions,
                 carried: DataFrame | None = None) -> DataFrame:
    """Items of the report as lines, with age columns and running balance. `carried` is the
    opening balance per object; the balance runs on from it."""
    until = min(o.date_to, o.day_before) if o.ledger_type == "open" else o.date_to
    items = with_needed_dates(scope(tables, o, until), tables, o, flags=True, openings=False)
    kept = items.where(line_pred(tables, o)).select(
        "account_id", "partner_id", "journal_id", "analytic_account_id", "move_id",
        F.col("id").alias("move_line_id"), "date", "date_maturity", *S.FLOWS,
        "full_reconcile_id", reconciled_flag(o).alias("reconciled"), "amount_currency",
        "currency_id", F.col("name").alias("item_name"), F.col("ref").alias("item_ref"),
        *[c for c in ("move_name", "parent_state") if c in items.columns])
    if tables.late:
        kept = with_entries(kept, tables, o.states)
    key = o.running_column
    lines = running_balance(kept, key, carried if key == o.object_column else None)
    # What follows from other columns is added after the shuffle the running balance needs.
    return lines.withColumns({
        "report_id": F.lit(o.report_id),
        "line_type": F.when(started(o), S.LINE).otherwise(S.INIT_LINE),
        "view_type": F.when(started(o), "normal").otherwise("init"),
        "report_object_id": F.col(o.object_column),
        **age_buckets(F.col("date_maturity"), F.col("balance"), F.lit(o.date_to)),
        **currency_columns(tables, o)})


def compact_lines(sums: DataFrame, tables: LedgerTables, o: ReportOptions,
                  carried: DataFrame | None = None) -> DataFrame:
    """One line per compacted account with the period's sums, from those of the report; matched and
    small items count."""
    rows = (sums.where("kind = 'compact'").groupBy("account_id")
            .agg(*[sum0(c).alias(c) for c in S.FLOWS])
            .withColumns({"report_object_id": F.col("account_id"),
                          **currency_columns(tables, o)}))
    before = F.lit(0)
    if carried is not None:
        rows = rows.join(carried.withColumnRenamed("balance", "_before"),
                         "report_object_id", "left")
        before = F.coalesce("_before", F.lit(0))
    return rows.withColumns({
        "report_id": F.lit(o.report_id), "line_type": F.lit(S.COMPACT),
        "view_type": F.lit("normal"), "date": F.lit(o.date_from),
        "cumul_balance": before + F.col("balance")})
