"""The reports registered as queries, by name."""

from __future__ import annotations

import datetime as dt

from ledgerloom.options import ReportOptions

TODAY = dt.date(1998, 12, 31)
_YEAR = {"date_from": dt.date(1998, 1, 1), "date_to": TODAY}
_BOTH = {**_YEAR, "result_selection": "customer_supplier"}

CASES: dict[str, ReportOptions] = {
    "general_ledger_detail": ReportOptions("general", **_YEAR),
    "general_ledger_trial_balance": ReportOptions("general", **_YEAR, summary=True),
    "general_ledger_net": ReportOptions("general", **_YEAR, init_balance_history=False),
    "general_ledger_compact": ReportOptions("general", **_YEAR, compact_account=True),
    "general_ledger_compact_trial_balance": ReportOptions(
        "general", **_YEAR, compact_account=True, summary=True, init_balance_history=False),
    "general_ledger_all_moves": ReportOptions("general", **_YEAR, target_move="all"),
    "general_ledger_account_group": ReportOptions("general", **_YEAR, account_group_ids=(4, 60)),
    "general_ledger_selected": ReportOptions(
        "general", **_YEAR, account_select_ids=(1200, 5120, 40103, 41107, 70701),
        journal_ids=(1, 3)),
    "general_ledger_all_time": ReportOptions("general", summary=True),
    "partner_ledger_detail": ReportOptions("partner", **_BOTH),
    "partner_ledger_open_items": ReportOptions("partner", **_BOTH, reconciled=False),
    "partner_ledger_trial_balance": ReportOptions("partner", **_BOTH, summary=True),
    "partner_ledger_open_trial_balance": ReportOptions(
        "partner", **_BOTH, reconciled=False, init_balance_history=False, summary=True),
    "partner_ledger_selected": ReportOptions(
        "partner", **_YEAR, result_selection="customer", partner_ids=tuple(range(2, 120, 2))),
    "journal_ledger_detail": ReportOptions("journal", **_YEAR),
    "journal_ledger_trial_balance": ReportOptions("journal", **_YEAR, summary=True),
    "open_ledger": ReportOptions("open", **_YEAR),
    "open_ledger_trial_balance": ReportOptions("open", **_YEAR, summary=True),
    "aged_balance_detail": ReportOptions("aged", date_to=TODAY, result_selection="customer"),
    "aged_balance_suppliers": ReportOptions("aged", date_to=TODAY),
    "aged_balance_summary": ReportOptions(
        "aged", date_to=TODAY, result_selection="customer_supplier", summary=True),
    "analytic_ledger_detail": ReportOptions("analytic", **_YEAR),
    "analytic_ledger_by_account": ReportOptions(
        "analytic", **_YEAR, running_by="analytic_account_id",
        analytic_account_ids=(101, 102, 107)),
    "analytic_ledger_trial_balance": ReportOptions("analytic", **_YEAR, summary=True),
}


def nation_report(n: int) -> ReportOptions:
    """The saved report of a nation key, as `samples.nation_reports` makes it."""
    return ReportOptions(
        ledger_type=("general", "partner", "journal", "open", "aged", "analytic")[n % 6],
        report_id=n + 1, summary=True,
        target_move="posted" if n % 2 == 0 else "all", reconciled=n % 4 != 1,
        result_selection=("customer", "supplier", "customer_supplier")[n % 3],
        compact_account=n % 5 == 0, init_balance_history=n % 7 != 1,
        date_from=None if n % 7 == 6 else dt.date(1996 + n % 4, 1, 1),
        date_to=None if n % 8 == 7 else dt.date(1997 + n % 4, 6 + n % 6, 15),
        journal_ids=(1, 3) if n % 9 == 4 else (),
        partner_ids=tuple(range(1, 101)) if n % 10 == 3 else (),
        account_select_ids=(5120, 40103, 41107, 60702, 1200) if n == 9 else (),
        account_group_ids=(4, 60) if n % 12 == 0 else (),
        analytic_account_ids=(101, 102, 103) if n == 11 else ())
