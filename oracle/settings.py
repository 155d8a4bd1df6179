"""What each kind of report shows, stated anew for the expected results.

One row per ledger, as plain values; nothing is taken from the engine's own rules but the fields in
which a case is written down.
"""

from __future__ import annotations

import datetime as dt
from types import SimpleNamespace

# ledger: what it is grouped by, whether it has openings, whether matched items may be hidden
# ("as asked", always shown, or always hidden), partner lists, compaction, and the column its
# running balance runs along.
LEDGERS = {
    "general": ("account", True, "shown", False, True, "account_id"),
    "open": ("account", True, "shown", False, False, "account_id"),
    "partner": ("partner", True, "asked", True, False, "partner_id"),
    "aged": ("partner", False, "hidden", True, False, "partner_id"),
    "journal": ("journal", False, "shown", False, False, "journal_id"),
    "analytic": ("analytic", False, "shown", False, False, "journal_id")}


def settled(case, today: dt.date) -> SimpleNamespace:
    """The settings a case comes to."""
    kind, opening, matched, by_partner, compacts, runs = LEDGERS[case.ledger_type]
    aged = case.ledger_type == "aged"
    first, last = dt.date(1970, 1, 1), dt.date(2099, 1, 1)
    return SimpleNamespace(
        ledger_type=case.ledger_type, report_type=kind, has_opening=opening,
        reconciled={"shown": True, "hidden": False}.get(matched, case.reconciled),
        partner_ids=case.partner_ids if by_partner else (),
        compact_account=compacts and case.compact_account,
        running_column=case.running_by or runs,
        states=["posted"] + ["draft"] * (case.target_move == "all"),
        date_from=first if aged or case.date_from is None else case.date_from,
        date_to=case.date_to or (today if aged else last),
        report_id=case.report_id, summary=case.summary, result_selection=case.result_selection,
        init_balance_history=case.init_balance_history, journal_ids=case.journal_ids,
        account_select_ids=case.account_select_ids, account_group_ids=case.account_group_ids,
        analytic_account_ids=case.analytic_account_ids)
