"""Searching stored or fresh report lines."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.tables import LedgerTables

EQUALITY_COLUMNS = ("date", "account_id", "analytic_account_id", "partner_id", "journal_id",
                    "line_type")


def search_lines(lines: DataFrame, tables: LedgerTables, *, move_name: str | None = None,
                 state: str | None = None, unreconciled: bool = False,
                 third_party: str | None = None, **equals: Any) -> DataFrame:
    """Lines whose entry's name contains a text (in any case), whose entry is in a state, that
    are not matched though their account is, that belong to supplier or customer accounts, or
    that have given values. Conditions add up; each one only keeps lines, so it is a filter or
    a semi join."""
    unknown = set(equals) - set(EQUALITY_COLUMNS)
    if unknown:
        raise ValueError(f"cannot search by {sorted(unknown)}")
    for column, value in equals.items():
        lines = lines.where(F.col(column) == F.lit(value))
    if unreconciled:
        lines = lines.where(F.col("full_reconcile_id").isNull() & (F.col("balance") != 0))

    accounts = tables["account_account"]
    if unreconciled:
        accounts = accounts.where("reconcile")
    if third_party:
        accounts = accounts.where(F.col("type_third_parties") == third_party)
    if unreconciled or third_party:
        lines = lines.join(accounts.select(F.col("id").alias("account_id")), "account_id",
                           "left_semi")

    # Lines of prepared items carry their entry's name and state; others are looked up.
    own = "parent_state" in tables.items.columns and "move_name" in tables.items.columns
    entries = lines if own else tables["account_move"]
    name, in_state = ("move_name", "parent_state") if own else ("name", "state")
    if move_name:
        pattern = "".join(f"\\{c}" if c in "\\%_" else c for c in move_name)
        entries = entries.where(F.col(name).ilike(f"%{pattern}%"))
    if state:
        entries = entries.where(F.col(in_state) == state)
    if own:
        return entries
    if move_name or state:
        lines = lines.join(entries.select(F.col("id").alias("move_id")), "move_id", "left_semi")
    return lines
