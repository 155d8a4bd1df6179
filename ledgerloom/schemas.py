"""Table schemas, line tags and option values.

Tables keep the column names of the accounting system they are extracted from,
so an extract can be read without renaming. Amounts are decimals throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

_STR, _BOOL, _INT, _LONG, _DATE = (
    T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.DateType())
_IDS = T.ArrayType(T.LongType())


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


TABLES: dict[str, T.StructType] = {
    "account_move_line": _schema(
        id=_LONG, move_id=_LONG, company_id=_LONG, account_id=_LONG, journal_id=_LONG,
        partner_id=_LONG, analytic_account_id=_LONG, full_reconcile_id=_LONG,
        date=_DATE, date_maturity=_DATE, debit=MONEY, credit=MONEY, balance=MONEY,
        amount_currency=MONEY, currency_id=_LONG, display_type=_STR, name=_STR, ref=_STR),
    "account_move": _schema(id=_LONG, state=_STR, name=_STR),
    "account_account": _schema(
        id=_LONG, company_id=_LONG, code=_STR, name=_STR, type_third_parties=_STR,
        include_initial_balance=_BOOL, is_unaffected_earnings=_BOOL, compacted=_BOOL,
        deprecated=_BOOL, reconcile=_BOOL, group_id=_LONG),
    "account_group": _schema(id=_LONG, parent_id=_LONG, name=_STR),
    "account_journal": _schema(id=_LONG, code=_STR, name=_STR),
    "res_partner": _schema(
        id=_LONG, ref=_STR, name=_STR, display_name=_STR, is_company=_BOOL, parent_id=_LONG),
    "account_analytic_account": _schema(id=_LONG, code=_STR, name=_STR),
    "account_full_reconcile": _schema(id=_LONG, name=_STR),
    "res_currency": _schema(
        id=_LONG, name=_STR, rounding=T.DecimalType(18, 6), decimal_places=_INT),
    "res_company": _schema(
        id=_LONG, name=_STR, currency_id=_LONG, fiscalyear_last_day=_INT,
        fiscalyear_last_month=_INT),
}

# What reports look up for each item elsewhere: its entry's state and name, and the last date
# in its match. Items stored with these columns need no join for them.
PREPARED_COLUMNS = _schema(parent_state=_STR, move_name=_STR, last_match_date=_DATE)

# What a store is partitioned by besides the company: the year of the date, and the last year at
# whose start the item may still be shown as open.
STORE_COLUMNS = _schema(date_year=_INT, open_year=_INT)
NEVER_OPEN, ALWAYS_OPEN = 0, 9999

REPORT_CONFIG = _schema(
    report_id=_LONG, company_id=_LONG, name=_STR, ledger_type=_STR, summary=_BOOL,
    target_move=_STR, reconciled=_BOOL, result_selection=_STR, compact_account=_BOOL,
    init_balance_history=_BOOL, date_from=_DATE, date_to=_DATE, journal_ids=_IDS,
    partner_ids=_IDS, account_select_ids=_IDS, account_group_ids=_IDS,
    analytic_account_ids=_IDS)

FISCAL_PERIODS = _schema(company_id=_LONG, name=_STR, date_from=_DATE, date_to=_DATE)

OUTBOUND_MESSAGE = _schema(
    message_id=_LONG, provider=_STR, message=_STR, numbers=T.ArrayType(_STR))
OUTBOUND_ACCOUNT = _schema(
    provider=_STR, endpoint=_STR, application_key=_STR, application_secret=_STR,
    consumer_key=_STR, sms_account=_STR, sender=_STR)
OUTBOUND_REPLY = _schema(message_id=_LONG, total_credits_removed=T.DoubleType())

# They must equal the stored data and the documented reports.
INIT, INIT_LINE, LINE, COMPACT, TOTAL, SUPER_TOTAL = (
    "0_init", "1_init_line", "2_line", "3_compact", "4_total", "5_super_total")
LINE_TYPES = (INIT, INIT_LINE, LINE, COMPACT, TOTAL, SUPER_TOTAL)
BODY_TYPES = (INIT, INIT_LINE, LINE, COMPACT)
LEDGER_TYPES = ("general", "partner", "journal", "open", "aged", "analytic")
TARGET_MOVES = ("posted", "all")
RESULT_SELECTIONS = ("customer", "supplier", "customer_supplier")
THIRD_PARTIES = ("supplier", "customer")
FIRST_DATE, LAST_DATE = "1970-01-01", "2099-01-01"

AGE_COLUMNS = ("current", "age_30_days", "age_60_days", "age_90_days", "age_120_days", "older")
AGE_EDGES = (30, 60, 90, 120)
FLOWS = ("debit", "credit", "balance")
AMOUNTS = FLOWS + AGE_COLUMNS


def line_schema(scale: int = 2) -> T.StructType:
    """The ledger line: one schema for every kind of row."""
    money = T.DecimalType(28, scale)
    return _schema(
        report_id=_LONG, line_type=_STR, view_type=_STR, report_object_id=_LONG,
        account_id=_LONG, partner_id=_LONG, journal_id=_LONG, analytic_account_id=_LONG,
        move_id=_LONG, move_line_id=_LONG, date=_DATE, date_maturity=_DATE,
        debit=money, credit=money, balance=money, cumul_balance=money,
        current=money, age_30_days=money, age_60_days=money, age_90_days=money,
        age_120_days=money, older=money,
        full_reconcile_id=_LONG, reconciled=_BOOL,
        amount_currency=money, currency_id=_LONG, company_currency_id=_LONG,
        item_name=_STR, item_ref=_STR, move_name=_STR, parent_state=_STR)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select exactly the schema's columns, cast; columns not there become null."""
    given = set(df.columns)
    return df.selectExpr(*[
        f"CAST({f'`{f.name}`' if f.name in given else 'NULL'} AS {f.dataType.simpleString()}) "
        f"AS `{f.name}`" for f in schema])


def money_scale(items: DataFrame) -> int:
    """Decimal places of the ledger's amounts (two unless the extract has more)."""
    kind = items.schema["balance"].dataType
    return kind.scale if isinstance(kind, T.DecimalType) else MONEY.scale
