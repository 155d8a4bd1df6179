"""Scans and selections: which items and which accounts a report is about."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.options import ReportOptions
from ledgerloom.sources.staging import staged
from ledgerloom.sources.tables import LedgerTables

def keep_ids(df: DataFrame, column: str, ids: Sequence[int] | DataFrame) -> DataFrame:
    """Rows whose `column` is one of `ids`; all rows if an empty list is given.

    A list travels as literals, which reach the file scan as a pushed filter. Ids that are
    data themselves come as a frame of one column and are a semi join.
    """
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")
    return df.where(F.col(column).isin(list(ids))) if ids else df


def company_items(tables: LedgerTables, o: ReportOptions) -> DataFrame:
    """Items of the report's company."""
    return tables.items.where(F.col("company_id") == F.lit(o.company_id))


def move_lines(tables: LedgerTables, o: ReportOptions) -> DataFrame:
    """Real items (no notes or section headings) of the company, within the report's journals
    and, where its ledger has them, partners or analytic accounts."""
    items = company_items(tables, o).where(F.col("display_type").isNull())
    items = keep_ids(items, "journal_id", o.journal_ids)
    if o.report_type == "partner":
        items = keep_ids(items, "partner_id", o.partner_ids)
    if o.report_type == "analytic":
        items = keep_ids(items, "analytic_account_id", o.analytic_account_ids)
    return items


def dated(items: DataFrame, since: dt.date | None = None,
          until: dt.date | None = None) -> DataFrame:
    """Items dated from `since` up to `until`, both included. Where the items are stored by
    year, the years are given too, so that files of other years are not listed."""
    by_year = "date_year" in items.columns
    if since is not None:
        items = items.where(F.col("date") >= F.lit(since))
        items = items.where(F.col("date_year") >= since.year) if by_year else items
    if until is not None:
        items = items.where(F.col("date") <= F.lit(until))
        items = items.where(F.col("date_year") <= until.year) if by_year else items
    return items


def in_states(items: DataFrame, tables: LedgerTables, states: Sequence[str]) -> DataFrame:
    """Items of entries in the given states. Items stored with their entry's state are just
    filtered; others are joined with the entries."""
    if "parent_state" in items.columns:
        return items.where(F.col("parent_state").isin(list(states)))
    entries = tables["account_move"].where(F.col("state").isin(list(states)))
    if tables.late:
        return items.join(entries.select(F.col("id").alias("move_id")), "move_id")
    return items.join(entries.select(F.col("id").alias("move_id")), "move_id", "left_semi")


def with_entries(items: DataFrame, tables: LedgerTables, states: Sequence[str]) -> DataFrame:
    """Items of entries in the given states, with their entry's state and name."""
    entries = tables["account_move"].where(F.col("state").isin(list(states)))
    return items.join(entries.select(F.col("id").alias("move_id"), F.col("name").alias("move_name"),
                                     F.col("state").alias("parent_state")), "move_id")


_SETTINGS = ("type_third_parties", "include_initial_balance", "is_unaffected_earnings",
             "compacted", "deprecated", "group_id")


def account_settings(tables: LedgerTables) -> DataFrame:
    """Accounts of all companies with the columns reports decide by."""
    return tables["account_account"].select(F.col("id").alias("account_id"), "company_id",
                                            *_SETTINGS)


def with_currency(accounts: DataFrame, tables: LedgerTables) -> DataFrame:
    """Accounts with their company's currency and its rounding."""
    companies = tables["res_company"].select(
        F.col("id").alias("company_id"), F.col("currency_id").alias("company_currency_id"))
    currencies = tables["res_currency"].select(
        F.col("id").alias("company_currency_id"), "rounding")
    return (accounts.join(companies, "company_id", "left")
            .join(currencies, "company_currency_id", "left"))


def account_group_paths(tables: LedgerTables) -> DataFrame:
    """Every account group (id) with its path: the ids from its root down to itself.

    Found by pointer doubling: in each round a group takes over the path of the group its own path hangs
    on, so paths double and rounds grow with the logarithm of the tree's depth. A group lies below
    another if its path has that one's id. Made once per set of tables.
    """
    def find() -> DataFrame:
        rows = staged(tables["account_group"].select(
            "id", F.array("id").alias("path"), F.col("parent_id").alias("up")))
        longest = rows.count()
        while not rows.where("up IS NOT NULL").isEmpty():
            if not rows.where(F.size("path") > longest).isEmpty():
                raise ValueError("account groups lie below themselves")
            above = rows.select(F.col("id").alias("up"), F.col("path").alias("above"),
                                F.col("up").alias("further"))
            path = F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("above", "path"))
            rows = staged(rows.join(above, "up", "left").select(
                "id", path.alias("path"), F.col("further").alias("up")))
        return rows.select("id", "path")
    return tables.known("account group paths", find)


def account_group_closure(tables: LedgerTables) -> DataFrame:
    """Pairs (group_id, member_id): every account group with itself and all groups below it."""
    return account_group_paths(tables).select(
        F.explode("path").alias("group_id"), F.col("id").alias("member_id"))


def account_group_subtree(tables: LedgerTables, group_ids: Sequence[int]) -> DataFrame:
    """The given account groups and all groups below them, as one column `group_id`."""
    chosen = F.array(*[F.lit(i).cast("bigint") for i in group_ids])
    return account_group_paths(tables).where(F.arrays_overlap("path", chosen)).select(
        F.col("id").alias("group_id"))


def third_party_kinds(result_selection: str) -> tuple[str, ...]:
    return S.THIRD_PARTIES if result_selection == "customer_supplier" else (result_selection,)


def select_accounts(tables: LedgerTables, o: ReportOptions) -> DataFrame:
    """The accounts a report covers, with their settings. Nothing selected means no rows."""
    accounts = account_settings(tables).where(
        (F.col("company_id") == o.company_id) & ~F.coalesce("deprecated", F.lit(False)))
    if o.report_type == "partner":
        accounts = accounts.where(
            F.col("type_third_parties").isin(*third_party_kinds(o.result_selection)))
    accounts = keep_ids(accounts, "account_id", o.account_select_ids)
    if o.account_group_ids:
        accounts = accounts.join(
            account_group_subtree(tables, o.account_group_ids), "group_id", "left_semi")
    return accounts.drop("company_id", "deprecated", "group_id")


def currency_columns(tables: LedgerTables, o: ReportOptions) -> dict[str, Column]:
    """The report's currency and its rounding, as constants filters can be pushed with."""
    currency, rounding = tables.currency(o.company_id)
    return {"company_currency_id": F.lit(currency).cast("bigint"),
            "rounding": F.lit(rounding).cast("decimal(18,6)")}


def enrich(items: DataFrame, tables: LedgerTables) -> DataFrame:
    """Items with their account's settings and their entry's state and name."""
    accounts = account_settings(tables).drop("company_id", "deprecated", "group_id")
    out = items.join(accounts, "account_id", "left")
    missing = {"parent_state": "state", "move_name": "name"}
    missing = {new: old for new, old in missing.items() if new not in items.columns}
    if missing:
        entries = tables["account_move"].select(
            F.col("id").alias("move_id"), *[F.col(o).alias(n) for n, o in missing.items()])
        out = out.join(entries, "move_id", "left")
    return out


def eligible_partners(partners: DataFrame) -> DataFrame:
    """Partners that can be chosen for a report: companies, and anyone without a parent."""
    return partners.where(F.coalesce("is_company", F.lit(False)) | F.col("parent_id").isNull())
