"""A small ledger with one item pair per rule."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from ledgerloom.schemas import TABLES, conform
from ledgerloom.sources.tables import LedgerTables, check_table

SALES, BANK = 1, 3
UNAFFECTED, BANKACC, RECEIVABLE, PAYABLE, REVENUE, EXPENSE, OLD, COMPACTED, OTHER_REC = (
    100, 512, 411, 401, 707, 607, 419, 513, 412)


def d(text: str | None) -> dt.date | None:
    return dt.date.fromisoformat(text) if text else None


# id, account, journal, partner, analytic, match, date, due, balance, state, display
ITEMS = [
    (1, RECEIVABLE, SALES, 1, None, None, "2023-03-01", "2023-04-01", "100.00", "posted", None),
    (2, RECEIVABLE, SALES, 1, None, 1, "2023-05-01", "2023-06-01", "50.00", "posted", None),
    (3, RECEIVABLE, BANK, 1, None, 1, "2023-05-20", None, "-50.00", "posted", None),
    (4, RECEIVABLE, SALES, 2, None, 2, "2023-11-01", "2023-12-01", "70.00", "posted", None),
    (5, RECEIVABLE, BANK, 2, None, 2, "2024-02-01", "2024-02-01", "-70.00", "posted", None),
    (6, RECEIVABLE, SALES, 2, None, 3, "2024-06-01", "2024-12-31", "80.00", "posted", None),
    (7, RECEIVABLE, BANK, 2, None, 3, "2025-01-15", None, "-80.00", "posted", None),
    (8, RECEIVABLE, SALES, 3, None, 4, "2024-03-01", "2024-04-01", "30.00", "posted", None),
    (9, RECEIVABLE, BANK, 3, None, 4, "2024-04-01", None, "-30.00", "posted", None),
    (10, BANKACC, BANK, None, None, None, "2023-05-20", None, "50.00", "posted", None),
    (11, REVENUE, SALES, None, 9, None, "2023-03-01", None, "-220.00", "posted", None),
    (12, EXPENSE, SALES, None, None, None, "2023-07-01", None, "45.00", "posted", None),
    (13, RECEIVABLE, SALES, 3, None, None, "2024-08-01", None, "11.00", "draft", None),
    (14, REVENUE, SALES, None, None, None, "2024-03-01", None, "0.00", "posted", "line_note"),
    (15, REVENUE, SALES, None, 9, None, "2024-03-02", None, "0.00", "posted", None),
    (16, OLD, SALES, 3, None, None, "2024-03-03", "2024-03-03", "5.00", "posted", None),
    (17, COMPACTED, BANK, None, None, None, "2024-03-04", None, "21.00", "posted", None),
    (18, COMPACTED, BANK, None, None, None, "2024-04-04", None, "-4.00", "posted", None),
    (19, OTHER_REC, SALES, None, None, None, "2024-05-05", "2024-05-05", "9.00", "posted", None),
    (20, REVENUE, SALES, None, 9, None, "2024-06-01", None, "-80.00", "posted", None),
    (22, BANKACC, BANK, None, None, None, "2024-02-01", None, "70.00", "posted", None),
    (21, BANKACC, BANK, None, None, None, "2024-02-01", None, "-20.00", "posted", None),
    (23, BANKACC, BANK, None, None, None, "2024-01-01", None, "1.00", "posted", None),
    (24, COMPACTED, BANK, None, None, None, "2023-04-04", None, "100.00", "posted", None),
    (25, COMPACTED, BANK, None, None, None, "2023-04-05", None, "-100.00", "posted", None),
    (26, PAYABLE, SALES, 4, None, None, "2024-01-05", "2025-01-01", "-1.00", "posted", None),
    (27, PAYABLE, SALES, 4, None, None, "2024-01-05", "2024-12-31", "-2.00", "posted", None),
    (28, PAYABLE, SALES, 4, None, None, "2024-01-05", "2024-12-01", "-4.00", "posted", None),
    (29, PAYABLE, SALES, 4, None, None, "2024-01-05", "2024-11-01", "-8.00", "posted", None),
    (30, PAYABLE, SALES, 4, None, None, "2024-01-05", "2024-10-02", "-16.00", "posted", None),
    (31, PAYABLE, SALES, 4, None, None, "2024-01-05", "2024-09-02", "-32.00", "posted", None),
    (32, PAYABLE, SALES, 4, None, None, "2024-01-05", None, "-64.00", "posted", None),
    (33, PAYABLE, SALES, 4, None, None, "2024-01-05", "2024-09-03", "-128.00", "posted", None),
]

ACCOUNTS = [  # id, code, name, kind, opening, unaffected, compacted, deprecated, reconcile, group
    (UNAFFECTED, "100", "Result", "no", True, True, False, False, False, 1),
    (BANKACC, "512", "Bank", "no", True, False, None, False, False, 2),
    (RECEIVABLE, "411", "Customers", "customer", True, False, False, False, True, 3),
    (OTHER_REC, "412", "Other customers", "customer", True, False, False, False, True, 3),
    (PAYABLE, "401", "Suppliers", "supplier", True, False, False, False, True, 3),
    (REVENUE, "707", "Revenue", "no", False, False, False, False, False, 4),
    (EXPENSE, "607", "Expense", "no", None, False, False, False, False, 4),
    (OLD, "419", "Old", "customer", True, False, False, True, True, None),
    (COMPACTED, "513", "Petty cash", "no", True, False, True, False, False, 2),
]


def make(spark, extra=(), company: int = 1, rounding: str = "0.01") -> LedgerTables:
    rows, moves = [], []
    for (id_, acc, jrn, par, ana, match, date, due, bal, state, disp) in [*ITEMS, *extra]:
        bal = Decimal(bal)
        rows.append((id_, id_ * 10, company, acc, jrn, par, ana, match, d(date), d(due),
                     max(bal, Decimal(0)), max(-bal, Decimal(0)), bal,
                     bal * 2 if id_ == 1 else None, 2 if id_ == 1 else None, disp,
                     f"item {id_}", None))
        moves.append((id_ * 10, state, f"M/{id_}"))
    frames = {
        "account_move_line": spark.createDataFrame(rows, TABLES["account_move_line"]),
        "account_move": spark.createDataFrame(moves, TABLES["account_move"]),
        "account_account": spark.createDataFrame(
            [(a[0], company, *a[1:]) for a in ACCOUNTS], TABLES["account_account"]),
        "account_group": spark.createDataFrame(
            [(1, None, "all"), (2, 1, "cash"), (3, 1, "third"), (4, None, "results")],
            TABLES["account_group"]),
        "account_journal": spark.createDataFrame(
            [(SALES, "SAL", "Sales"), (BANK, "BNK", "Bank")], TABLES["account_journal"]),
        "res_partner": spark.createDataFrame(
            [(1, "P1", "Ann", "Ann Ltd", True, None), (2, None, "Bob", "Bob", False, None),
             (3, None, "Cy", "Cy", False, 1), (4, "P4", "Di", "Di", None, None)],
            TABLES["res_partner"]),
        "account_analytic_account": spark.createDataFrame(
            [(9, None, "Project")], TABLES["account_analytic_account"]),
        "account_full_reconcile": spark.createDataFrame(
            [(i, f"A{i}") for i in range(1, 5)], TABLES["account_full_reconcile"]),
        "res_currency": spark.createDataFrame(
            [(1, "USD", Decimal(rounding), 2), (2, "EUR", Decimal("0.01"), 2)],
            TABLES["res_currency"]),
        "res_company": spark.createDataFrame([(company, "Co", 1, 31, 12)], TABLES["res_company"]),
    }
    return LedgerTables({n: check_table(n, f) for n, f in frames.items()})


YEAR = {"date_from": d("2024-01-01"), "date_to": d("2024-12-31")}
