"""Report options: one record per report, and the same rules over a table of them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.schemas import FIRST_DATE, LAST_DATE

# The ledgers' names and what each one is grouped by.
LEDGER_NAMES = {
    "general": "General Ledger", "partner": "Partner Ledger", "journal": "Journal Ledger",
    "open": "Open Ledger", "aged": "Aged Balance", "analytic": "Analytic Ledger"}
REPORT_TYPES = {
    "general": "account", "open": "account", "partner": "partner", "aged": "partner",
    "journal": "journal", "analytic": "analytic"}
OBJECT_COLUMNS = {
    "account": "account_id", "partner": "partner_id", "journal": "journal_id",
    "analytic": "analytic_account_id"}

# The saved settings that may be laid over a report's options.
SAVED_FIELDS = (
    "name", "ledger_type", "summary", "amount_currency", "reconciled", "partner_ids",
    "account_select_ids", "analytic_account_ids", "init_balance_history", "journal_ids",
    "date_from", "date_to", "target_move", "result_selection", "compact_account",
    "account_group_ids")
ID_LISTS = ("journal_ids", "partner_ids", "account_select_ids", "account_group_ids",
            "analytic_account_ids")


@dataclass(frozen=True)
class ReportOptions:
    """What one report shows. Empty id lists mean "all"."""

    ledger_type: str = "general"
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    report_id: int = 1
    company_id: int = 1
    name: str = "Standard Report"
    summary: bool = False
    target_move: str = "posted"
    reconciled: bool = True
    result_selection: str = "supplier"
    compact_account: bool = False
    init_balance_history: bool = True
    journal_ids: tuple[int, ...] = ()
    partner_ids: tuple[int, ...] = ()
    account_select_ids: tuple[int, ...] = ()
    account_group_ids: tuple[int, ...] = ()
    analytic_account_ids: tuple[int, ...] = ()
    amount_currency: bool = False  # kept with the settings; no figure depends on it
    # The analytic ledger's running balance runs per journal unless told otherwise.
    running_by: str | None = None

    def __post_init__(self) -> None:
        for value, allowed in ((self.ledger_type, S.LEDGER_TYPES),
                               (self.target_move, S.TARGET_MOVES),
                               (self.result_selection, S.RESULT_SELECTIONS)):
            if value not in allowed:
                raise ValueError(f"{value!r} is not one of {allowed}")

    @property
    def report_type(self) -> str:
        return REPORT_TYPES[self.ledger_type]

    @property
    def object_column(self) -> str:
        return OBJECT_COLUMNS[self.report_type]

    @property
    def states(self) -> tuple[str, ...]:
        return ("posted",) if self.target_move == "posted" else ("posted", "draft")

    @property
    def report_name(self) -> str:
        return LEDGER_NAMES[self.ledger_type] + (" Balance" if self.summary else "")

    @property
    def has_opening(self) -> bool:
        return self.ledger_type in ("general", "open", "partner")

    @property
    def day_before(self) -> dt.date:
        return self.date_from - dt.timedelta(days=1)

    @property
    def running_column(self) -> str:
        if self.running_by:
            return self.running_by
        return self.object_column if self.report_type in ("account", "partner") else "journal_id"

    def normalise(self, today: dt.date | None = None) -> "ReportOptions":
        """Force the options a ledger fixes, and fill open dates."""
        forced: dict[str, Any] = {}
        if self.ledger_type != "general":
            forced["compact_account"] = False
        if self.ledger_type not in ("partner", "aged"):
            forced.update(reconciled=True, partner_ids=())
        date_from, date_to = self.date_from, self.date_to
        if self.ledger_type == "aged":
            forced["reconciled"] = False
            date_from, date_to = None, date_to or today or dt.date.today()
        return replace(
            self, **forced,
            date_from=date_from or dt.date.fromisoformat(FIRST_DATE),
            date_to=date_to or dt.date.fromisoformat(LAST_DATE))


def overlay(options: ReportOptions, saved: dict[str, Any]) -> ReportOptions:
    """Lay saved settings over options. Only non-empty values apply, so a saved
    False or empty list never switches anything off."""
    known = {f.name for f in fields(ReportOptions)}
    values = {k: v for k, v in saved.items() if k in SAVED_FIELDS and k in known and v}
    return replace(options, **{k: tuple(v) if k in ID_LISTS else v for k, v in values.items()})


def overlay_reports(reports: DataFrame, defaults: DataFrame) -> DataFrame:
    """`overlay` over tables: each report's saved values where non-empty, otherwise the
    company's default row (`defaults`, one row per company_id)."""
    columns = [f.name for f in S.REPORT_CONFIG if f.name not in ("report_id", "company_id")]

    def non_empty(name: str) -> Column:
        saved = F.col(f"s.{name}")
        if name in ID_LISTS:
            return F.when(F.size(saved) > 0, saved)
        if dict(reports.dtypes)[name] == "boolean":
            return F.when(saved, saved)
        if dict(reports.dtypes)[name] == "string":
            return F.when(saved != "", saved)
        return saved

    return (reports.alias("s").join(defaults.alias("d"), "company_id", "left")
            .select("s.report_id", "company_id",
                    *[F.coalesce(non_empty(c), F.col(f"d.{c}")).alias(c) for c in columns]))


def report_type_column(ledger_type: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in REPORT_TYPES.items() for x in pair])
    return kinds[ledger_type]


def normalise_reports(reports: DataFrame, today: dt.date | Column) -> DataFrame:
    """`ReportOptions.normalise` over a table of reports, plus `report_type`."""
    today = today if isinstance(today, Column) else F.lit(today)
    kind = F.col("ledger_type")
    third_party, aged = kind.isin("partner", "aged"), kind == "aged"
    no_ids = F.array().cast("array<bigint>")
    filled = reports.select(*[
        F.coalesce(F.col(c), no_ids).alias(c) if c in ID_LISTS else F.col(c)
        for c in reports.columns])
    return filled.select(
        *[c for c in filled.columns if c not in
          ("reconciled", "compact_account", "partner_ids", "date_from", "date_to",
           "summary", "target_move", "result_selection", "init_balance_history")],
        report_type_column(kind).alias("report_type"),
        F.coalesce("summary", F.lit(False)).alias("summary"),
        F.coalesce("target_move", F.lit("posted")).alias("target_move"),
        F.coalesce("result_selection", F.lit("supplier")).alias("result_selection"),
        F.coalesce("init_balance_history", F.lit(True)).alias("init_balance_history"),
        F.when(aged, False).when(~third_party, True)
         .otherwise(F.coalesce("reconciled", F.lit(True))).alias("reconciled"),
        F.when(kind == "general", F.coalesce("compact_account", F.lit(False)))
         .otherwise(False).alias("compact_account"),
        F.when(third_party, F.col("partner_ids")).otherwise(no_ids).alias("partner_ids"),
        F.coalesce(F.when(~aged, F.col("date_from")), F.lit(FIRST_DATE).cast("date"))
         .alias("date_from"),
        F.coalesce(F.col("date_to"), F.when(aged, today), F.lit(LAST_DATE).cast("date"))
         .alias("date_to"))


def report_dim(reports: DataFrame, companies: DataFrame, currencies: DataFrame,
               printed_at: Column | None = None) -> DataFrame:
    """One row per report for headings: name, company, currency, dates and wording."""
    names = F.create_map(*[F.lit(x) for pair in LEDGER_NAMES.items() for x in pair])
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"),
                         "currency_id")
    cur = currencies.select(F.col("id").alias("currency_id"), F.col("name").alias("currency"))
    return (reports.join(c, "company_id", "left").join(cur, "currency_id", "left").select(
        "report_id",
        F.concat(names[F.col("ledger_type")],
                 F.when(F.col("summary"), " Balance").otherwise("")).alias("report_name"),
        "company", "currency", "date_from", "date_to",
        F.when(F.col("target_move") == "all", "All Entries")
         .otherwise("All Posted Entries").alias("target_moves"),
        F.when(F.col("reconciled"), "With Reconciled Entries")
         .otherwise("Only UnReconciled Entries").alias("matching"),
        (F.current_timestamp() if printed_at is None else printed_at).alias("print_time")))


def options_of(row: dict[str, Any]) -> ReportOptions:
    """A config-table row as options."""
    known = {f.name for f in fields(ReportOptions)}
    values = {k: v for k, v in row.items() if k in known and v is not None}
    return ReportOptions(**{k: tuple(v) if k in ID_LISTS else v for k, v in values.items()})
