"""Double-entry ledgers on Spark DataFrames."""

from ledgerloom.options import ReportOptions, overlay, report_dim
from ledgerloom.plans.ledgers import (
    aged_balance, analytic_ledger, general_ledger, journal_ledger, ledger, open_ledger,
    partner_ledger, trial_balance)
from ledgerloom.plans.multi import (
    load_reports, run_ledgers, run_reports, run_trial_balances, write_reports)
from ledgerloom.sources.store import add_to_store, read_store, write_tables
from ledgerloom.sources.tables import LedgerTables, load_tables, read_tables

__all__ = [
    "LedgerTables", "ReportOptions", "add_to_store", "aged_balance", "analytic_ledger", "general_ledger",
    "journal_ledger", "ledger", "load_reports", "load_tables", "open_ledger", "overlay",
    "partner_ledger", "read_store", "read_tables",
    "report_dim", "run_ledgers", "run_reports", "run_trial_balances",
    "trial_balance", "write_reports", "write_tables"]
