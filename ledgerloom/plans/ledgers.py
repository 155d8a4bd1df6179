"""The six ledgers, in detail or as trial balances."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame

from ledgerloom import schemas as S
from ledgerloom.operators.lines import compact_lines, detail_lines
from ledgerloom.operators.opening import opening_per_object, openings
from ledgerloom.operators.totals import report_sums, report_totals
from ledgerloom.options import ReportOptions
from ledgerloom.sources.staging import at_least, staged
from ledgerloom.sources.tables import LedgerTables


def ledger(tables: LedgerTables, options: ReportOptions, today: dt.date | None = None,
           totals: bool = True) -> DataFrame:
    """All lines of a report: openings, items, compacted accounts and totals; for a trial balance
    (`summary`) the totals alone.

    Rows carry no order; see `display_order`. A trial balance is one lazy plan. Otherwise the
    report's sums are made first, in one pass over the items, and staged: openings, balances
    carried, compacted accounts and totals are read from them. A second pass stages the detail
    rows by ranges of their running balance. What is returned reads staged files only. Both passes
    have as many tasks as the ledger's size asks for. Items that are only prepared for this report are joined
    with entries and matches after its rows are selected.
    """
    o = options.normalise(today)
    tables = tables.extract or tables
    schema = S.line_schema(S.money_scale(tables.items))
    if o.summary:
        return S.conform(report_totals(tables, o), schema)
    spark, tasks = tables.spark, tables.tasks()
    with at_least(spark, tasks):
        sums = staged(report_sums(tables, o)) if totals or o.has_opening else None
    rows = openings(tables, o, sums)
    carried = None if rows is None else opening_per_object(rows)
    parts = [] if rows is None else [rows]
    with at_least(spark, tasks):
        parts.append(detail_lines(tables, o, carried))
    if o.compact_account:
        parts.append(compact_lines(sums, tables, o, carried))
    if totals:
        parts.append(report_totals(tables, o, sums))
    return reduce(DataFrame.unionByName, [S.conform(p, schema) for p in parts])


def _ledger_of(kind: str, tables: LedgerTables, options: ReportOptions | None,
               changes: dict[str, Any]) -> DataFrame:
    return ledger(tables, replace(options or ReportOptions(), ledger_type=kind, **changes))


def general_ledger(tables: LedgerTables, options: ReportOptions | None = None,
                   **changes: Any) -> DataFrame:
    """Items by account, after the openings of balance-sheet accounts."""
    return _ledger_of("general", tables, options, changes)


def partner_ledger(tables: LedgerTables, options: ReportOptions | None = None,
                   **changes: Any) -> DataFrame:
    """Items of receivable and payable accounts by partner; `reconciled=False` shows open
    items only, as of the report's end."""
    return _ledger_of("partner", tables, options, changes)


def journal_ledger(tables: LedgerTables, options: ReportOptions | None = None,
                   **changes: Any) -> DataFrame:
    """Items of the period by journal, without openings."""
    return _ledger_of("journal", tables, options, changes)


def open_ledger(tables: LedgerTables, options: ReportOptions | None = None,
                **changes: Any) -> DataFrame:
    """What stood at the start, by account: openings and open items."""
    return _ledger_of("open", tables, options, changes)


def aged_balance(tables: LedgerTables, options: ReportOptions | None = None,
                 **changes: Any) -> DataFrame:
    """Open items by partner, spread over columns by how long they are due."""
    return _ledger_of("aged", tables, options, changes)


def analytic_ledger(tables: LedgerTables, options: ReportOptions | None = None,
                    **changes: Any) -> DataFrame:
    """Items by analytic account. The running balance runs per journal by default; pass
    `running_by="analytic_account_id"` to have it run per analytic account."""
    return _ledger_of("analytic", tables, options, changes)


def trial_balance(tables: LedgerTables, options: ReportOptions,
                  today: dt.date | None = None) -> DataFrame:
    """Totals only, of any ledger."""
    return ledger(tables, replace(options, summary=True), today)
