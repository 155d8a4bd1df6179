"""Work and memory of storing grow no faster than the items."""

import contextlib
import datetime
import glob
import io
import os
import re

from pyspark.sql import functions as F

import __spark_entry__ as driver
from ledgerloom import ReportOptions, ledger, read_store, write_tables
from ledgerloom import schemas as S
from ledgerloom.operators import running
from ledgerloom.plans import multi
from ledgerloom.sources import samples, staging, trade
from ledgerloom.sources.tables import LedgerTables, with_match_date
from ledgerloom.sources.trade import derive_tables, documents, stored_tables, three_decimal_tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_items_are_made_by_code_the_jvm_compiles(spark):
    """The JVM interprets methods over 8,000 bytes, many times slower."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        printed = io.StringIO()
        with contextlib.redirect_stdout(printed):
            derive_tables(spark, SF).items.explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", printed.getvalue())]
    assert sizes and max(sizes) < 8000


def test_kept_documents_are_derived_once(spark):
    kept, lazy = derive_tables(spark, SF, keep=True), derive_tables(spark, SF)
    for name in ("account_move_line", "account_move", "account_full_reconcile"):
        plan = kept[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "o_orderkey" not in plan
        assert sorted(map(str, kept[name].collect())) == sorted(map(str, lazy[name].collect()))


def test_tasks_grow_with_the_items(spark, tmp_path, monkeypatch):
    tables = derive_tables(spark, SF)
    monkeypatch.setattr(staging, "ROWS_PER_TASK", 1000)
    assert staging.tasks_for(spark, 1000) is None
    write_tables(tables, str(tmp_path / "s"))
    parts = {os.path.basename(f).split("-")[1] for f in glob.glob(
        f"{tmp_path}/s/account_move_line/**/*.parquet", recursive=True)}
    assert len(parts) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert read_store(spark, str(tmp_path / "s")).items.count() == tables.items.count()


def _exchanges(frame):
    """What is shuffled in a plan, by operator."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_bills_are_dealt_out_once(spark):
    """Sums per bill and numbers of bills share one shuffle of the lines; nothing is sorted before it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(100 << 20))
    try:
        assert _exchanges(documents(spark, SF).where("NOT is_sale")) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_whole_load_finds_match_dates_with_one_shuffle(spark):
    """Also for items of several companies, of none, and without a match, under one match number."""
    day = [datetime.date(2020, 1, n) for n in range(1, 8)]
    rows = [(1, 1, 7, day[0]), (2, 1, 7, day[4]), (3, 2, 7, day[6]), (4, None, 7, day[5]),
            (5, 1, None, day[3]), (6, 1, 8, None), (7, 1, 9, day[1]), (7, 1, 9, day[1])]
    items = spark.createDataFrame(
        rows, "id bigint, company_id bigint, full_reconcile_id bigint, date date")
    tables = LedgerTables({"account_move_line": items})
    joined = with_match_date(tables).items
    loaded = with_match_date(tables, 4).items.select(*joined.columns)
    assert sorted(map(str, loaded.collect())) == sorted(map(str, joined.collect()))
    assert {r.id: r.last_match_date for r in loaded.collect()} == {
        1: day[4], 2: day[4], 3: day[6], 4: None, 5: None, 6: None, 7: day[1]}
    assert _exchanges(loaded.select("*")) == 1


def test_kept_documents_are_read_by_many_tasks(spark, monkeypatch):
    """A document grows to several wide items: a file of many documents must not be one task."""
    monkeypatch.setattr(trade, "DOCUMENTS_GROUP", 4096)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    kept = derive_tables(spark, SF, keep=True)
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        usual = kept["account_full_reconcile"].rdd.getNumPartitions()
        with staging.at_least(spark, 60):
            assert spark.conf.get("spark.sql.shuffle.partitions") == "60"
            parts = kept["account_full_reconcile"].select("*").rdd.glom().map(len).collect()
        with staging.at_least(spark, None):
            assert spark.conf.get("spark.sql.shuffle.partitions") == before
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    filled = [n for n in parts if n]
    assert len(filled) > usual and sum(filled) == kept["account_full_reconcile"].count()


def test_stored_sums_add_up_and_files_are_compressed(spark, tmp_path):
    """The sums per month are those of the items, however their rows are dealt to files."""
    tables = derive_tables(spark, SF)
    write_tables(tables, str(tmp_path / "s"))
    stored = read_store(spark, str(tmp_path / "s"))
    flows = [F.sum(c).cast("decimal(28,2)") for c in S.FLOWS]
    assert stored.rollup.agg(*flows).first() == tables.items.where(
        "display_type IS NULL").agg(*flows).first()
    assert all(".zstd." in os.path.basename(f) for f in glob.glob(
        f"{tmp_path}/s/**/*.parquet", recursive=True) if "manifest" not in f)


def test_a_report_is_run_without_storing_all_items(spark, tmp_path, monkeypatch):
    """Only documents and accounts are written before a report, once for both ledgers; the report is that
    of a store."""
    written = []
    monkeypatch.setattr(trade, "_stored", {})
    monkeypatch.setattr(staging, "shared_folder", lambda _: written.append(
        str(tmp_path / str(len(written)))) or written[-1])
    tables, thousandths = stored_tables(spark, SF), three_decimal_tables(spark, SF)
    assert len(written) == 2 and tables is stored_tables(spark, SF)
    assert sum(spark.read.parquet(f).count() for f in written) < tables.items.count() / 2
    assert S.money_scale(thousandths.items) == 3
    write_tables(tables, str(tmp_path / "s"))
    stored = read_store(spark, str(tmp_path / "s"))
    for kind, changes in (("partner", {"reconciled": False}), ("general", {"compact_account": True})):
        o = ReportOptions(kind, date_from=datetime.date(1997, 3, 5),
                          date_to=datetime.date(1998, 6, 15), **changes)
        a, b = ledger(tables, o), ledger(stored, o)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_tasks_of_a_report_grow_with_the_ledger(spark, monkeypatch):
    """Ranges of lines too: their number was the session's, whatever the number of lines."""
    ranges = []
    monkeypatch.setattr(running, "staged_ranges", lambda rows, *order: ranges.append(
        staging.staged_ranges(rows, *order)) or ranges[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = []
        for rows_per_task in (500_000, 500):
            monkeypatch.setattr(staging, "ROWS_PER_TASK", rows_per_task)
            lines = ledger(derive_tables(spark, SF), ReportOptions(
                "general", date_from=datetime.date(1994, 1, 1), date_to=datetime.date(1998, 6, 15)))
            found.append(sorted(map(str, lines.collect())))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    usual, more = (r.select(staging.RANGE).distinct().count() for r in ranges)
    assert usual <= int(spark.conf.get("spark.sql.shuffle.partitions")) < more
    assert found[0] == found[1]


def test_code_too_large_to_compile_is_not_run_as_one_method(spark, monkeypatch):
    """Detail rows of the ledger in thousandths were one method of 8,047 bytes, which the JVM interprets."""
    limit, found = "spark.sql.codegen.hugeMethodLimit", []
    usual = spark.conf.get(limit)
    monkeypatch.setattr(running, "staged_ranges", lambda rows, *order: found.append(
        int(spark.conf.get(limit))) or staging.staged_ranges(rows, *order))
    o = ReportOptions("partner", date_from=datetime.date(1998, 1, 1), result_selection="customer_supplier")
    ledger(three_decimal_tables(spark, SF), o)
    assert found == [8000] and spark.conf.get(limit) == usual


def test_reports_about_no_items_store_no_documents(spark, monkeypatch):
    written = []
    monkeypatch.setattr(trade, "_stored", {})
    monkeypatch.setattr(staging, "staged", lambda df, **_: written.append(df) or df)
    monkeypatch.setattr(trade, "staged", staging.staged)
    for name in ("report_dim", "company_reports", "eligible_partners"):
        assert driver.queries()[name](spark, SF).count() > 0
    assert not written


def test_tasks_of_many_trial_balances_grow_with_the_ledger(spark, monkeypatch):
    """Items of all reports met in the session's number of tasks; each pair was added to some twenty sums."""
    tasks, plans = [], []
    monkeypatch.setattr(multi, "staged", lambda df: (
        tasks.append(int(spark.conf.get("spark.sql.shuffle.partitions"))),
        plans.append(df._jdf.queryExecution().optimizedPlan().toString()), staging.staged(df))[-1])
    monkeypatch.setattr(staging, "ROWS_PER_TASK", 500)
    tables, reports = derive_tables(spark, SF), samples.nation_reports(spark, SF)
    balances = multi.run_trial_balances(tables, reports, datetime.date(1998, 12, 31))
    assert tasks[-1] == tables.tasks() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_item = plans[-1].split("Aggregate [")[2].split("\n")[0]
    assert len(re.findall(r"sum\(", per_item)) == len(S.FLOWS)
    assert balances.select("report_id").distinct().count() == reports.count()


def test_lines_of_many_reports_lie_side_by_side(spark, monkeypatch):
    """Ranges were by report first, an item's lines far apart, in as few tasks as its entries ask for."""
    found = []
    monkeypatch.setattr(running, "staged_ranges", lambda rows, *order: found.append(
        (order, rows, int(spark.conf.get("spark.sql.shuffle.partitions")))) or staging.staged_ranges(rows, *order))
    monkeypatch.setattr(staging, "ROWS_PER_TASK", 500)
    tables = derive_tables(spark, SF)
    reports = samples.nation_reports(spark, SF).withColumn("summary", F.lit(False))
    multi.run_ledgers(tables, reports, datetime.date(1998, 12, 31))
    (order, rows, tasks), = found
    assert order[0] == "_key" and order[-1] == "report_id"
    assert "_amount" not in rows.columns and dict(rows.dtypes)["balance"] == "decimal(18,2)"
    assert tasks >= rows.where("_is_row = 1").count() / 500 > 2 * tables.tasks()


def test_running_sums_of_rows_alike_but_for_their_report(spark):
    """Reports, keys and null keys that share ranges, with openings wider than the rows' amounts."""
    n, wide = 3000, 10 ** 20
    rows = [(r, None if k == 3 else k, i * 7919 % n // 50, i, i % 13 - 5)
            for i in range(n) for k in (i % 7,) for r in range(1, 6) if (i + r) % 3]
    start = [(r, k, r * wide + (k or 0)) for r in (1, 2, 9) for k in (0, None, 5)]
    df = spark.createDataFrame(rows, "r int, k int, day int, id int, v int").withColumn(
        "v", F.col("v").cast("decimal(18,2)"))
    carried = spark.createDataFrame([(r, k, str(v)) for r, k, v in start], "r int, k int, v string").withColumn(
        "v", F.col("v").cast("decimal(28,2)"))
    so_far, expected = {(r, k): v for r, k, v in start}, {}
    for r, k, _, i, v in sorted(rows, key=lambda x: (x[2], x[3])):
        so_far[r, k] = expected[r, i] = so_far.get((r, k), 0) + v
    for last in ([], ["r"]):
        got = running.running_sum(df, ["r", "k"], ["day", "id"], "v", "total", carried, last=last)
        assert {(x.r, x.id): int(x.total) for x in got.collect()} == expected and got.count() == len(rows)
        assert got.columns == [*df.columns, "total"]


def test_entries_are_counted_without_being_made(spark):
    """A report counts them to choose its tasks: that made all their numbers and names."""
    documents = spark.createDataFrame(
        [(1, True, "F"), (2, True, "P"), (3, True, "O"), (4, True, None), (1, False, "F"), (2, False, "P")],
        "k bigint, is_sale boolean, st string")
    entries = trade._entries(documents)
    assert sorted(map(tuple, entries.collect())) == [
        (4, "posted", "SAL/1"), (5, "posted", "RCV/1"), (6, "posted", "PUR/1"), (7, "posted", "PAY/1"),
        (8, "draft", "SAL/2"), (10, "posted", "PUR/2"), (12, "posted", "SAL/3"), (16, "posted", "SAL/4")]
    plan = entries.groupBy().count()._jdf.queryExecution().optimizedPlan().toString()
    assert "/" not in plan and "*" not in plan
