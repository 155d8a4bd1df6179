"""Options, periods, schema checks and messages."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from handmade import d, make
from ledgerloom import ReportOptions, load_tables, overlay
from ledgerloom.functions.calendar import fill_dates, fiscal_periods, month_range
from ledgerloom.options import normalise_reports
from ledgerloom.outbound import messages as sms
from ledgerloom.schemas import OUTBOUND_ACCOUNT, OUTBOUND_MESSAGE, OUTBOUND_REPLY, REPORT_CONFIG
from ledgerloom.sources.tables import check_table, fold_account_types


def test_each_ledger_forces_its_options():
    base = dict(reconciled=False, compact_account=True, partner_ids=(1,),
                date_from=d("2024-01-01"), date_to=None)
    today = d("2024-05-05")
    made = {k: ReportOptions(ledger_type=k, **base).normalise(today)
            for k in ("general", "open", "partner", "aged", "journal", "analytic")}
    assert [k for k, o in made.items() if o.compact_account] == ["general"]
    assert {k for k, o in made.items() if not o.reconciled} == {"partner", "aged"}
    assert {k for k, o in made.items() if o.partner_ids} == {"partner", "aged"}
    assert made["aged"].date_from == d("1970-01-01") and made["aged"].date_to == today
    assert made["general"].date_to == d("2099-01-01")
    assert {k for k, o in made.items() if o.has_opening} == {"general", "open", "partner"}


def test_table_and_record_rules_are_the_same(spark):
    today = d("2024-05-05")
    kinds = ("general", "open", "partner", "aged", "journal", "analytic")
    options = [ReportOptions(ledger_type=k, report_id=i, reconciled=i % 2 == 0, compact_account=True,
                             partner_ids=(1, 2), date_from=d("2024-01-01"))
               for i, k in enumerate(kinds)]
    rows = [(o.report_id, 1, o.name, o.ledger_type, False, "posted", o.reconciled, "supplier",
             True, True, o.date_from, None, None, [1, 2], None, None, None) for o in options]
    table = normalise_reports(spark.createDataFrame(rows, REPORT_CONFIG), today)
    for row in table.collect():
        o = options[row.report_id].normalise(today)
        assert (row.report_type, row.reconciled, row.compact_account, row.date_from, row.date_to,
                tuple(row.partner_ids), row.journal_ids) == (
            o.report_type, o.reconciled, o.compact_account, o.date_from, o.date_to,
            o.partner_ids, [])


def test_saved_empty_values_do_not_override():
    o = ReportOptions("partner", reconciled=True, journal_ids=(1,))
    same = overlay(o, {"reconciled": False, "journal_ids": [], "name": ""})
    assert same == o
    assert overlay(o, {"ledger_type": "aged", "journal_ids": [2]}) == ReportOptions(
        "aged", reconciled=True, journal_ids=(2,))


def test_unknown_values_are_rejected():
    with pytest.raises(ValueError):
        ReportOptions("monthly")


def test_fiscal_periods(spark):
    companies = spark.createDataFrame(
        [(1, 31, 12), (2, 30, 6), (3, 29, 2), (4, None, 0)],
        "id bigint, fiscalyear_last_day int, fiscalyear_last_month int")
    rows = fiscal_periods(companies, d("2024-05-05")).collect()
    got = {(r.company_id, r.date_from, r.date_to) for r in rows}
    assert len(rows) == 16
    assert (1, d("2024-01-01"), d("2024-12-31")) in got
    assert (1, d("2021-01-01"), d("2021-12-31")) in got
    assert (2, d("2023-07-01"), d("2024-06-30")) in got
    assert (3, d("2023-03-01"), d("2024-02-29")) in got and (3, d("2022-03-01"), d("2023-02-28")) in got
    assert (4, d("2024-01-01"), d("2024-12-31")) in got
    periods = fiscal_periods(companies, d("2024-05-05"))
    assert fiscal_periods(companies, d("2025-05-05"), stored=periods).count() == 4
    assert {r.name for r in rows if r.company_id == 2} >= {"07/01/2023 - 06/30/2024"}


def test_month_of_period(spark):
    start = F.lit(dt.date(2023, 7, 1))
    plain = month_range(start, F.lit(2))
    inside = month_range(start, F.lit(2), within_period=True)
    row = spark.range(1).select(*plain, *inside).first()
    assert tuple(row) == (d("2023-02-01"), d("2023-02-28"), d("2024-02-01"), d("2024-02-29"))


def test_period_fills_dates(spark):
    companies = spark.createDataFrame([(1, 31, 12)],
                                      "id bigint, fiscalyear_last_day int, fiscalyear_last_month int")
    periods = fiscal_periods(companies, d("2024-05-05"))
    name = "01/01/2023 - 12/31/2023"
    reports = spark.createDataFrame(
        [(1, "general", name, None), (1, "general", name, 2), (1, "aged", name, None)],
        "company_id bigint, ledger_type string, period_name string, month int").withColumns(
        {"date_from": F.lit(None).cast("date"), "date_to": F.lit(None).cast("date")})
    got = sorted((r.ledger_type, r.month or 0, r.date_from, r.date_to)
                 for r in fill_dates(reports, periods).collect())
    assert got == [("aged", 0, None, None), ("general", 0, d("2023-01-01"), d("2023-12-31")),
                   ("general", 2, d("2023-02-01"), d("2023-02-28"))]


def test_tables_are_checked(spark):
    frames = make(spark).frames
    assert load_tables(frames.__getitem__).items.columns == frames["account_move_line"].columns
    with pytest.raises(ValueError, match="lacks"):
        check_table("account_journal", spark.createDataFrame([(1,)], "id bigint"))
    with pytest.raises(ValueError, match="decimal"):
        check_table("account_move_line",
                    frames["account_move_line"].withColumn("debit", F.col("debit").cast("double")))
    with pytest.raises(ValueError, match="string"):
        check_table("account_move", frames["account_move"].withColumn("state", F.lit(1)))


def test_account_types_are_folded_in(spark):
    accounts = spark.createDataFrame([(1, 7), (2, 8)], "id bigint, user_type_id bigint")
    types = spark.createDataFrame([(7, True), (8, None)],
                                  "id bigint, include_initial_balance boolean")
    rows = {r.id: r for r in fold_account_types(accounts, types, 7).collect()}
    assert rows[1].is_unaffected_earnings and rows[1].include_initial_balance
    assert not rows[2].is_unaffected_earnings and rows[2].include_initial_balance is None


def test_numbers(spark):
    raw = ["+33 1 23 45 67 89", "(33)1-23-45-67-89", "+33 1 23 45 67 89", "123456",
           "1234567890123456", "+33^123456", "0-123-456"]
    df = spark.createDataFrame([(1, "p", "hi", raw), (2, "p", "hi", [])], OUTBOUND_MESSAGE)
    assert sorted(r.number for r in sms.clean_numbers(df).collect()) == [
        "+33123456789", "+33^123456", "0123456", "33123456789"]


def test_jobs_and_their_receivers(spark, tmp_path):
    accounts = spark.createDataFrame(
        [("p", "e", "k", "s", "c", "acc", "Me"), ("q", "e", "k", "", "c", "acc", "Me")],
        OUTBOUND_ACCOUNT)
    many = [f"0{n:08d}" for n in range(100)]
    df = spark.createDataFrame(
        [(1, "p", "hi", many), (2, "p", "ho", many[:3]), (3, "q", "hi", many[:3]),
         (4, "other", "hi", many[:3]), (5, "p", "none", ["1"])], OUTBOUND_MESSAGE)
    jobs = sms.send_jobs(df, accounts)
    counts = {j.message_id: j.receiver_count for j in jobs.collect()}
    assert counts == {1: 100, 2: 3, 5: 0}
    receivers = sms.job_receivers(df, accounts)
    assert sorted(tuple(r) for r in receivers.collect()) == sorted(
        [(1, "p", n) for n in many] + [(2, "p", n) for n in many[:3]])
    one = [json.loads(j.job) for j in jobs.collect() if j.message_id == 2]
    assert one == [{"charset": "UTF-8", "coding": "7bit", "message": "ho", "noStopClause": True,
                    "priority": "high", "senderForResponse": False, "validityPeriod": 2880,
                    "sender": "Me"}]
    path = str(tmp_path / "outbox")
    sms.write_outbox(jobs, receivers, path)
    assert spark.read.parquet(f"{path}/jobs").count() == 3
    assert spark.read.parquet(f"{path}/receivers").count() == 103
    assert sms.rejected_accounts(accounts).first().missing_settings == ["application_secret"]
    routes = {r.message_id: r.route for r in sms.route(df, accounts).collect()}
    assert routes == {1: "p", 2: "p", 3: "q", 4: "default", 5: "p"}


def test_replies(spark):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, 1.0)], OUTBOUND_REPLY)
    got = {r.message_id: (r.success, r.error) for r in sms.classify_replies(df).collect()}
    assert got == {1: (False, "insufficient credit"), 2: (False, "insufficient credit"),
                   3: (True, None)}
