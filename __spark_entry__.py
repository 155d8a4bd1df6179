"""

Every query works on the ledger derived from the given tables (or, for messages and saved
reports, directly on them). Amounts are computed as decimals and shown as doubles; dates and
flags are shown as text, so that both engines' results compare value by value.
"""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas as S
from ledgerloom.functions.calendar import fill_dates, fiscal_periods, month_range
from ledgerloom.operators.matching import match_flags
from ledgerloom.operators.objects import report_objects
from ledgerloom.operators.opening import (
    opening, opening_key, opening_per_object, openings, unaffected_earnings)
from ledgerloom.operators.scan import (
    account_group_closure, eligible_partners, enrich, move_lines)
from ledgerloom.operators.totals import (
    grand_total, group_lines, listing_footer, object_totals, report_sums, section_totals)
from ledgerloom.options import ReportOptions, normalise_reports, overlay_reports, report_dim
from ledgerloom.outbound import messages as sms
from ledgerloom.plans.ledgers import ledger
from ledgerloom.plans.multi import (
    load_reports, run_ledgers, run_reports, run_trial_balances)
from ledgerloom.sinks import exports
from ledgerloom.sinks.search import search_lines
from ledgerloom.sources import samples
from ledgerloom.sources.staging import shared_folder
from ledgerloom.sources.tables import prepare
from ledgerloom.sources.trade import derive_tables, stored_tables, three_decimal_tables
from oracle import queries as oracle
from oracle.cases import CASES, TODAY
from oracle.ledger_sql import LINE, TOTAL


try:
    import corpus_pipeline
    from ledgerloom.llm import queries as corpus
except ModuleNotFoundError as missing:
    # without the corpus operators, or a library they need, the ledger queries still work
    if missing.name not in ("corpus_pipeline", "ledgerloom.llm"):
        warnings.warn(f"corpus queries are left out: {missing}", stacklevel=1)
    corpus = None


def flat(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns as they are compared: decimals as doubles, dates and flags as text."""
    def column(name: str):
        kind = df.schema[name].dataType
        if isinstance(kind, T.DecimalType):
            return F.col(name).cast("double").alias(name)
        if isinstance(kind, (T.DateType, T.BooleanType)):
            return F.col(name).cast("string").alias(name)
        return F.col(name)
    return df.select(*[column(c) for c in columns or df.columns])


def _case(name: str) -> ReportOptions:
    return CASES[name].normalise(TODAY)


def _ledger(name: str, spark: SparkSession, path: str, stored=stored_tables) -> DataFrame:
    o = CASES[name]
    return flat(ledger(stored(spark, path), o, TODAY), TOTAL if o.summary else LINE)


def _objects(name: str, spark: SparkSession, path: str) -> DataFrame:
    objects = report_objects(stored_tables(spark, path), _case(name))
    return flat(objects, ["object_id", "name", "account_id", "partner_id", "journal_id",
                          "analytic_account_id"])


def _opening(name: str, spark: SparkSession, path: str) -> DataFrame:
    o = _case(name)
    rows = opening(stored_tables(spark, path), o).withColumn("group_key", opening_key(o))
    return flat(rows, ["report_object_id", "account_id", "group_key", "date", "debit", "credit",
                       "balance", "cumul_balance"])


def _opening_per_object(spark: SparkSession, path: str) -> DataFrame:
    tables, o = stored_tables(spark, path), _case("general_ledger_detail")
    return flat(opening_per_object(openings(tables, o, report_sums(tables, o))))


def _unaffected(name: str, spark: SparkSession, path: str) -> DataFrame:
    return flat(unaffected_earnings(stored_tables(spark, path), _case(name)),
                ["report_object_id", "account_id", "date", "debit", "credit", "balance"])


def _match_dates(spark: SparkSession, path: str) -> DataFrame:
    return flat(match_flags(stored_tables(spark, path), _case("general_ledger_detail")))


def _move_lines(spark: SparkSession, path: str) -> DataFrame:
    o = replace(_case("general_ledger_detail"), journal_ids=(1, 3))
    return flat(move_lines(stored_tables(spark, path), o).groupBy("journal_id", "account_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("debit").alias("debit"),
        F.sum("credit").alias("credit"), F.max("date").alias("date")))


def _enriched(spark: SparkSession, path: str) -> DataFrame:
    tables = stored_tables(spark, path)
    items = enrich(tables.items.drop("parent_state", "move_name", "last_match_date"), tables)
    return flat(items.groupBy(
        "type_third_parties", "include_initial_balance", "parent_state",
        F.substring("move_name", 1, 4).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("balance").alias("balance")))


def _joined(name: str, spark: SparkSession, path: str) -> DataFrame:
    """A ledger over items as extracted, prepared in the same plan."""
    tables, o = stored_tables(spark, path), CASES[name]
    bare = tables.with_frames(
        account_move_line=tables.items.drop("parent_state", "move_name", "last_match_date"))
    return flat(ledger(prepare(bare), o, TODAY), TOTAL if o.summary else LINE)


def _eligible(spark: SparkSession, path: str) -> DataFrame:
    return eligible_partners(derive_tables(spark, path)["res_partner"]).select("id", "ref", "name")


def _group_balances(spark: SparkSession, path: str) -> DataFrame:
    tables = stored_tables(spark, path)
    sums = tables.items.groupBy("account_id").agg(F.sum("debit").alias("debit"),
                                                  F.sum("credit").alias("credit"))
    groups = tables["account_account"].select(
        F.col("id").alias("account_id"), F.col("group_id").alias("member_id"))
    return flat(account_group_closure(tables).join(groups, "member_id").join(sums, "account_id")
                .groupBy("group_id").agg(F.sum("debit").alias("debit"),
                                         F.sum("credit").alias("credit")))


def _daily(spark: SparkSession, path: str) -> DataFrame:
    return stored_tables(spark, path).items.groupBy("company_id", "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("debit").alias("debit"))


def _fiscal_periods(spark: SparkSession, path: str) -> DataFrame:
    companies = stored_tables(spark, path)["res_company"]
    stored = fiscal_periods(companies, dt.date(1997, 6, 30), n=1)
    periods = fiscal_periods(companies, dt.date(2000, 6, 30), n=4, stored=stored)
    days = _daily(spark, path).withColumnRenamed("date", "day")
    return flat(days.join(periods, "company_id")
                .where(F.col("day").between(F.col("date_from"), F.col("date_to")))
                .groupBy("name", "date_from", "date_to")
                .agg(F.sum("n").alias("n"), F.sum("debit").alias("debit")))


def _fiscal_months(spark: SparkSession, path: str) -> DataFrame:
    companies = stored_tables(spark, path)["res_company"]
    months = fiscal_periods(companies, dt.date(2000, 6, 30)).select(
        "company_id", "date_from", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    first, last = month_range(F.col("date_from"), F.col("month"))
    months = months.select("company_id", first.alias("first_day"), last.alias("last_day"))
    days = _daily(spark, path).withColumnRenamed("date", "day")
    return flat(days.join(months, "company_id")
                .where(F.col("day").between(F.col("first_day"), F.col("last_day")))
                .groupBy("first_day", "last_day")
                .agg(F.sum("n").alias("n"), F.sum("debit").alias("debit")))


def _object_totals(spark: SparkSession, path: str) -> DataFrame:
    o = _case("general_ledger_detail")
    lines = ledger(stored_tables(spark, path), o, totals=False)
    return flat(object_totals(lines, o), ["report_object_id", *S.AMOUNTS, "cumul_balance"])


def _grand_total(spark: SparkSession, path: str) -> DataFrame:
    o = _case("partner_ledger_detail")
    lines = ledger(stored_tables(spark, path), o, totals=False)
    return flat(grand_total(object_totals(lines, o), o), [*S.AMOUNTS, "cumul_balance"])


def _lines_grouped(by: str, name: str, spark: SparkSession, path: str) -> DataFrame:
    lines = exports.view_lines(ledger(stored_tables(spark, path), CASES[name], totals=False))
    return flat(group_lines(lines, by))


def _footer(name: str, spark: SparkSession, path: str) -> DataFrame:
    lines = exports.view_lines(ledger(stored_tables(spark, path), CASES[name], totals=False))
    return flat(listing_footer(lines, aged=CASES[name].ledger_type == "aged"))


def _search(spark: SparkSession, path: str, **conditions) -> DataFrame:
    tables = stored_tables(spark, path)
    lines = exports.view_lines(ledger(tables, CASES["general_ledger_all_moves"], totals=False))
    return flat(search_lines(lines, tables, **conditions),
                ["line_type", "account_id", "move_id", "move_line_id", "date", "balance"])


def _labelled(name: str, spark: SparkSession, path: str,
              stored=stored_tables) -> tuple[DataFrame, ReportOptions]:
    tables, o = stored(spark, path), _case(name)
    return exports.labelled_lines(ledger(tables, o), tables, o), o


def _matching_labels(spark: SparkSession, path: str) -> DataFrame:
    labelled, _ = _labelled("partner_ledger_detail", spark, path)
    return flat(exports.lines_of(labelled, (S.INIT_LINE, S.LINE)),
                ["line_type", "move_line_id", "code", "name", "partner_name", "matching_number"])


def _pivot(name: str, spark: SparkSession, path: str, stored=stored_tables) -> DataFrame:
    labelled, o = _labelled(name, spark, path, stored)
    aged = o.ledger_type == "aged"
    rows = exports.aged_pivot_rows(labelled) if aged else exports.pivot_rows(labelled)
    return flat(rows, oracle.AGED_PIVOT if aged else oracle.PIVOT)


def _sections(name: str, spark: SparkSession, path: str, stored=stored_tables) -> DataFrame:
    labelled, o = _labelled(name, spark, path, stored)
    tables = stored(spark, path)
    rows = exports.section_rows(labelled, tables, o)
    return flat(rows, oracle.AGED_SECTION if o.ledger_type == "aged" else oracle.SECTION)


def _statement(name: str, spark: SparkSession, path: str) -> DataFrame:
    labelled, o = _labelled(name, spark, path)
    return flat(exports.statement_rows(labelled, o),
                oracle.AGED_STATEMENT if o.ledger_type == "aged" else oracle.STATEMENT)


def _summary(name: str, spark: SparkSession, path: str, stored=stored_tables) -> DataFrame:
    labelled, o = _labelled(name, spark, path, stored)
    rows = (exports.aged_summary_rows if o.ledger_type == "aged" else exports.summary_rows)(labelled)
    return flat(rows)


def _sheet_totals(spark: SparkSession, path: str) -> DataFrame:
    labelled, _ = _labelled("partner_ledger_detail", spark, path)
    return flat(section_totals(exports.pivot_rows(labelled), ("debit", "credit")))


def _ordered(name: str, spark: SparkSession, path: str) -> DataFrame:
    labelled, _ = _labelled(name, spark, path)
    # what is ordered is stored, so only what is shown and sorted by is
    shown = labelled.select("object_name", "report_object_id", "line_type", "date", "move_line_id")
    return flat(exports.with_position(shown),
                ["position", "object_name", "line_type", "date", "move_line_id"])


def _stored_lines(spark: SparkSession, path: str) -> DataFrame:
    tables, folder = stored_tables(spark, path), shared_folder(spark)
    for i, name in enumerate(oracle.STORED, 1):
        exports.write_lines(ledger(tables, replace(_case(name), report_id=i)), folder)
    lines = spark.read.parquet(folder)
    return flat(lines.withColumn("report_id", F.col("report_id").cast("bigint")),
                ["report_id", *LINE])


def _stamped(spark: SparkSession, path: str) -> DataFrame:
    lines = ledger(stored_tables(spark, path), replace(_case("journal_ledger_detail"), report_id=7))
    stamped = exports.stamp_lines(lines, 42, F.lit("1998-12-31 12:00:00"))
    return flat(stamped, ["report_id", "line_type", "move_line_id", "journal_id", "debit",
                          "company_currency_id", "create_uid", "create_date"])


def _company_reports(spark: SparkSession, path: str) -> DataFrame:
    """Saved reports of one company, dated by the fiscal period and month they name."""
    k, year = F.col("report_id"), (F.col("report_id") % 4 + 1997).cast("string")
    saved = samples.customer_reports(spark, path, plain=True).withColumns({
        "company_id": k % 2 + 1,
        "period_name": F.when(k % 3 != 0, F.concat(F.lit("01/01/"), year, F.lit(" - 12/31/"), year)),
        "month": F.when(k % 5 == 0, (k % 12 + 1).cast("int"))})
    # neither companies nor partners nor currencies are made from documents, so none are stored for them
    periods = fiscal_periods(derive_tables(spark, path)["res_company"], dt.date(2000, 6, 30))
    return flat(fill_dates(load_reports(saved, 1), periods).select(
        "report_id", "company_id", "ledger_type", "date_from", "date_to"))


def _report_options(spark: SparkSession, path: str) -> DataFrame:
    saved, defaults = samples.customer_reports(spark, path), samples.default_reports(spark)
    reports = normalise_reports(overlay_reports(saved, defaults), TODAY)
    return flat(reports.select(
        "report_id", "name", "ledger_type", "report_type", "summary", "target_move",
        "reconciled", "result_selection", "compact_account", "init_balance_history",
        "date_from", "date_to", F.size("journal_ids").alias("journals"),
        F.size("partner_ids").alias("partners")))


def _report_dim(spark: SparkSession, path: str) -> DataFrame:
    tables = derive_tables(spark, path)
    reports = normalise_reports(samples.customer_reports(spark, path, plain=True), TODAY)
    dim = report_dim(reports, tables["res_company"], tables["res_currency"],
                     F.lit("1998-12-31 12:00:00"))
    return flat(dim)


def _multi(spark: SparkSession, path: str) -> DataFrame:
    rows = run_trial_balances(stored_tables(spark, path), samples.nation_reports(spark, path),
                              TODAY)
    return flat(rows, ["report_id", *TOTAL])


def _multi_detail(spark: SparkSession, path: str) -> DataFrame:
    """All lines of one saved report per nation, of all kinds, in one job."""
    reports = samples.nation_reports(spark, path).withColumn("summary", F.lit(False))
    return flat(run_ledgers(stored_tables(spark, path), reports, TODAY), ["report_id", *LINE])


def _side_by_side(spark: SparkSession, path: str) -> DataFrame:
    options = [replace(CASES[n], report_id=i) for i, n in enumerate(oracle.SIDE_BY_SIDE, 1)]
    return flat(run_reports(stored_tables(spark, path), options, TODAY), ["report_id", *LINE])


def _recipients(spark: SparkSession, path: str) -> DataFrame:
    return sms.clean_numbers(samples.recipients(spark, path))


def _routes(spark: SparkSession, path: str) -> DataFrame:
    messages, accounts = samples.outbound_messages(spark, path), samples.outbound_accounts(spark)
    rejected = sms.rejected_accounts(accounts).select(
        "provider", F.array_join("missing_settings", ",").alias("missing_settings"))
    return (sms.route(messages, accounts).join(rejected, "provider", "left")
            .select("message_id", "provider", "route", "missing_settings"))


def _jobs(spark: SparkSession, path: str) -> DataFrame:
    jobs = sms.send_jobs(
        samples.outbound_messages(spark, path), samples.outbound_accounts(spark),
        sms.clean_numbers(samples.recipients(spark, path)))
    return jobs


def _receivers(spark: SparkSession, path: str) -> DataFrame:
    return sms.job_receivers(
        samples.outbound_messages(spark, path), samples.outbound_accounts(spark),
        sms.clean_numbers(samples.recipients(spark, path)))


def _replies(spark: SparkSession, path: str) -> DataFrame:
    return flat(sms.classify_replies(samples.outbound_replies(spark, path)))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"report_objects_{kind}": partial(_objects, case) for kind, case in oracle.OBJECTS.items()},
    "match_dates": _match_dates,
    "move_lines": _move_lines,
    "enriched_items": _enriched,
    "eligible_partners": _eligible,
    "account_group_subtree": _group_balances,
    "unaffected_earnings": partial(_unaffected, "general_ledger_detail"),
    "unaffected_earnings_net": partial(_unaffected, "general_ledger_net"),
    "opening_account": partial(_opening, "general_ledger_detail"),
    "opening_account_net": partial(_opening, "general_ledger_net"),
    "opening_account_compact": partial(_opening, "general_ledger_compact"),
    "opening_partner": partial(_opening, "partner_ledger_detail"),
    "opening_per_object": _opening_per_object,
    **{name: partial(_ledger, name) for name in CASES},
    **{f"{name}_joined": partial(_joined, name) for name in oracle.JOINED},
    "object_totals": _object_totals,
    "grand_total": _grand_total,
    "lines_grouped": partial(_lines_grouped, "account_id", "general_ledger_detail"),
    "lines_grouped_partner": partial(_lines_grouped, "partner_id", "partner_ledger_detail"),
    "listing_footer": partial(_footer, "general_ledger_detail"),
    "listing_footer_aged": partial(_footer, "aged_balance_detail"),
    "lines_search": partial(_search, move_name="rcv/1", state="posted"),
    "lines_search_drafts": partial(_search, state="draft", journal_id=1, third_party="customer"),
    "lines_search_unreconciled": partial(
        _search, unreconciled=True, third_party="supplier", line_type="2_line"),
    "matching_labels": _matching_labels,
    "pivot_export": partial(_pivot, "general_ledger_compact"),
    "pivot_export_analytic": partial(_pivot, "analytic_ledger_detail"),
    "aged_pivot_export": partial(_pivot, "aged_balance_detail"),
    "section_export": partial(_sections, "partner_ledger_detail"),
    "section_export_analytic": partial(_sections, "analytic_ledger_detail"),
    "aged_section_export": partial(_sections, "aged_balance_detail"),
    "summary_export": partial(_summary, "general_ledger_trial_balance"),
    "aged_summary_export": partial(_summary, "aged_balance_summary"),
    "statement_export": partial(_statement, "general_ledger_compact"),
    "statement_export_summary": partial(_statement, "journal_ledger_trial_balance"),
    "aged_statement_export": partial(_statement, "aged_balance_detail"),
    "sheet_totals": _sheet_totals,
    "pivot_export_three_decimals": partial(
        _pivot, "general_ledger_compact", stored=three_decimal_tables),
    "section_export_three_decimals": partial(
        _sections, "partner_ledger_detail", stored=three_decimal_tables),
    "aged_summary_export_three_decimals": partial(
        _summary, "aged_balance_summary", stored=three_decimal_tables),
    "general_trial_balance_three_decimals": partial(
        _ledger, "general_ledger_trial_balance", stored=three_decimal_tables),
    "ordered_export": partial(_ordered, "general_ledger_detail"),
    "stored_report_lines": _stored_lines,
    "stamped_lines": _stamped,
    "company_reports": _company_reports,
    "fiscal_periods": _fiscal_periods,
    "fiscal_months": _fiscal_months,
    "report_options": _report_options,
    "report_dim": _report_dim,
    "multi_report_trial_balance": _multi,
    "multi_report_detail": _multi_detail,
    "reports_side_by_side": _side_by_side,
    "outbound_recipients": _recipients,
    "outbound_routes": _routes,
    "outbound_jobs": _jobs,
    "outbound_job_receivers": _receivers,
    "outbound_replies": _replies,
}


def entry(spark: SparkSession) -> DataFrame:
    """Trial balance of the general ledger for one year."""
    return _QUERIES["general_ledger_trial_balance"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | ({**corpus.QUERIES, "pipeline": corpus_pipeline.run} if corpus else {})


def oracle_sql() -> dict[str, str]:
    return oracle.statements() | (corpus.ORACLE if corpus else {})
