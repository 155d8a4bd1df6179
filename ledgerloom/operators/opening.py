"""Opening balances: what stood before the report's start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.functions.columns import exceeds, net_opening, sum0
from ledgerloom.operators.history import past
from ledgerloom.operators.matching import match_dates, open_at_start, with_match_dates
from ledgerloom.operators.objects import unaffected_account
from ledgerloom.operators.scan import (
    account_settings, company_items, currency_columns, dated, in_states, move_lines, select_accounts)
from ledgerloom.options import ReportOptions
from ledgerloom.sources.tables import LedgerTables


def opening_group(o: ReportOptions) -> list[str]:
    """One opening per account, or per account of each partner."""
    return ["account_id"] if o.report_type == "account" else ["partner_id", "account_id"]


def balance_sheet() -> Column:
    return F.col("include_initial_balance").eqNullSafe(True)


def opening_pred(o: ReportOptions) -> Column:
    """Items that are summed up in the opening rather than shown one by one. Together with
    the items open at the start and the profit and loss of prior years they are all items
    before the start, each once."""
    settled = F.col("full_reconcile_id").isNotNull() & ~open_at_start(o)
    summed = F.coalesce(F.col("type_third_parties") == "no", F.lit(False)) | settled
    if o.compact_account:
        summed = summed | F.coalesce("compacted", F.lit(False))
    return balance_sheet() & summed


def significant_opening(tables: LedgerTables, o: ReportOptions) -> Column:
    """Openings to keep: with history also those that net to zero but had movements."""
    _, rounding = tables.currency(o.company_id)
    balance = exceeds("balance", rounding)
    return exceeds("debit", rounding) | balance if o.init_balance_history else balance


def opening_row(df: DataFrame, o: ReportOptions) -> DataFrame:
    """Tag sums as opening lines, dated at the report's start."""
    debit, credit = net_opening(
        F.col("debit"), F.col("credit"), F.col("balance"), o.init_balance_history)
    return df.withColumns({
        "report_id": F.lit(o.report_id), "line_type": F.lit(S.INIT), "view_type": F.lit("init"),
        "date": F.lit(o.date_from), "debit": debit, "credit": credit,
        "cumul_balance": F.col("balance"), "reconciled": F.lit(False)})


def prior_result(tables: LedgerTables, o: ReportOptions) -> DataFrame:
    """Result of prior years: all profit and loss before the start, as one sum (account_id and
    flows) of the unaffected-earnings account. Journals and chosen accounts do not limit it, and
    it is there even when it is zero. No row if the report does not cover that account."""
    accounts = account_settings(tables).where(
        (F.col("company_id") == o.company_id) & ~balance_sheet())
    before = dated(company_items(past(tables, o), o).where(F.col("display_type").isNull()),
                   until=o.day_before)
    result = (in_states(before, tables, o.states)
              .join(accounts.select("account_id"), "account_id", "left_semi")
              .groupBy("company_id").agg(*[F.sum(c).alias(c) for c in S.FLOWS]))
    account = unaffected_account(tables, o).withColumn("company_id", F.lit(o.company_id))
    return account.join(result, "company_id", "left").select(
        "account_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in S.FLOWS])


def unaffected_earnings(tables: LedgerTables, o: ReportOptions) -> DataFrame:
    """The result of prior years as one opening line, if the report covers its account."""
    joined = prior_result(tables, o).withColumns(
        {"report_object_id": F.col("account_id"), **currency_columns(tables, o)})
    return opening_row(joined, o)


def opening(tables: LedgerTables, o: ReportOptions) -> DataFrame:
    """Opening lines of balance-sheet accounts, per account or per partner and account."""
    items = dated(move_lines(past(tables, o), o), until=o.day_before)
    items = in_states(items, tables, o.states).join(select_accounts(tables, o), "account_id")
    items = items.where(balance_sheet() & F.col(o.object_column).isNotNull())
    # Plain accounts are summed whatever their matches: only third parties need the dates.
    third_party = ~F.coalesce(F.col("type_third_parties") == "no", F.lit(False))
    items = with_match_dates(items, third_party, match_dates(tables, o, since=o.date_from))
    group = opening_group(o)
    sums = items.where(opening_pred(o)).groupBy(*group).agg(
        *[sum0(c).alias(c) for c in S.FLOWS])
    sums = sums.where(significant_opening(tables, o)).withColumns(currency_columns(tables, o))
    return opening_row(sums.withColumn("report_object_id", F.col(o.object_column)), o)


def opening_key(o: ReportOptions) -> Column:
    """The opening's group as text: `-account`, or `partner-account`."""
    account = F.col("account_id").cast("string")
    if o.report_type == "account":
        return F.concat(F.lit("-"), account)
    return F.concat(F.col("partner_id").cast("string"), F.lit("-"), account)


def openings(tables: LedgerTables, o: ReportOptions, sums: DataFrame) -> DataFrame | None:
    """All opening lines the ledger has, from the report's sums; None if it has none. Openings and
    the result of prior years are lines of their own, also for one account."""
    if not o.has_opening:
        return None
    group = opening_group(o)
    rows = (sums.where(F.col("kind").isin("opening", "prior")).groupBy(*group, "kind")
            .agg(*[sum0(c).alias(c) for c in S.FLOWS])
            .where((F.col("kind") == "prior") | significant_opening(tables, o)).drop("kind"))
    return opening_row(rows.withColumns(
        {"report_object_id": F.col(o.object_column), **currency_columns(tables, o)}), o)


def prior_seed(tables: LedgerTables, unaffected: int | None) -> DataFrame:
    """An empty result of prior years, so that it is there even if nothing was posted."""
    return tables.spark.range(0 if unaffected is None else 1).select(
        F.lit(unaffected).cast("bigint").alias("account_id"), F.lit("prior").alias("kind"))


def opening_per_object(rows: DataFrame) -> DataFrame:
    """Opening balance per object: an object may have several opening lines."""
    return rows.groupBy("report_object_id").agg(sum0("balance").alias("balance"))
