"""Each rule of the ledgers, on the hand-made items."""

from dataclasses import replace
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from handmade import (
    BANKACC, COMPACTED, OTHER_REC, RECEIVABLE, UNAFFECTED, YEAR, d, make)
from ledgerloom import (
    ReportOptions, aged_balance, analytic_ledger, general_ledger, journal_ledger, ledger,
    open_ledger, partner_ledger, read_store, run_ledgers, run_trial_balances, trial_balance,
    write_reports, write_tables)
from ledgerloom.operators import running
from ledgerloom.operators.opening import opening, openings, unaffected_earnings
from ledgerloom.operators.running import running_balance
from ledgerloom.operators.scan import (
    account_group_closure, account_group_subtree, eligible_partners, select_accounts)
from ledgerloom.operators.totals import (
    grand_total, group_lines, object_totals, report_sums)
from ledgerloom.plans import ledgers, multi
from ledgerloom.schemas import AMOUNTS, REPORT_CONFIG, conform
from ledgerloom.sinks import exports
from ledgerloom.sinks.search import search_lines
from ledgerloom.sources.staging import staged_ranges
from ledgerloom.sources.tables import prepare


@pytest.fixture(scope="module")
def tables(spark):
    t = make(spark)
    return t.with_frames(**{n: f.cache() for n, f in t.frames.items()})


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "ledger")
    write_tables(tables, path)
    return read_store(spark, path)


def ids(lines, kind):
    return sorted(r.move_line_id for r in lines.where(F.col("line_type") == kind).collect())


@pytest.fixture(scope="module")
def general(tables):
    return general_ledger(tables, **YEAR).cache()


def test_openings_and_open_items_split_the_past(general):
    # 2 and 3 settle each other before the start: summed; 1 is open, 4 is paid in the period.
    assert ids(general, "1_init_line") == [1, 4]
    opened = {r.account_id: r for r in general.where("line_type = '0_init'").collect()}
    assert set(opened) == {RECEIVABLE, BANKACC, COMPACTED, UNAFFECTED}
    assert (opened[RECEIVABLE].debit, opened[RECEIVABLE].credit) == (D(50), D(50))
    assert opened[BANKACC].balance == D(50)
    # Revenue and the expense account without an opening flag; not limited to chosen accounts.
    assert opened[UNAFFECTED].balance == D("-175.00")
    assert (opened[UNAFFECTED].debit, opened[UNAFFECTED].credit) == (D(45), D(220))


def test_period_lines(general):
    lines = ids(general, "2_line")
    assert 13 not in lines, "draft"
    assert 14 not in lines and 15 not in lines, "note and zero items"
    assert 16 not in lines, "deprecated account"
    assert 7 not in lines, "after the end"
    assert {5, 6, 8, 9, 17, 18, 19, 20, 21, 22, 23} <= set(lines)


def test_drafts_only_on_request(tables):
    assert 13 in ids(general_ledger(tables, **YEAR, target_move="all"), "2_line")


def test_matching_flags_and_labels(tables, general):
    o = ReportOptions(**YEAR).normalise()
    rows = {r.move_line_id: r for r in exports.labelled_lines(general, tables, o)
            .where("move_line_id is not null").collect()}
    flags = {r.move_line_id: r.reconciled for r in general.where("move_line_id > 0").collect()}
    assert flags[4] and flags[5] and not flags[6] and not flags[1]
    assert rows[4].matching_number == "A2"
    assert rows[6].matching_number == "*", "matched only after the end"
    assert rows[1].matching_number == ""
    assert rows[1].move_name == "M/1" and rows[1].partner_name == "Ann Ltd"
    assert rows[1].currency == "EUR"


def test_running_balance_is_by_date_then_id(general):
    bank = {r.move_line_id: r.cumul_balance for r in
            general.where(f"account_id = {BANKACC} and line_type = '2_line'").collect()}
    assert bank == {23: D(51), 21: D(31), 22: D(101)}


def test_opening_per_account_is_not_lost_in_running_balance(general):
    last = general.where(f"account_id = {RECEIVABLE} and line_type = '2_line'").agg(
        F.max_by("cumul_balance", F.struct("date", "move_line_id"))).first()[0]
    total = general.where(f"account_id = {RECEIVABLE} and line_type = '4_total'").first().balance
    assert last == total


def test_compaction(tables):
    lines = general_ledger(tables, **YEAR, compact_account=True).cache()
    assert not {17, 18} & set(ids(lines, "2_line"))
    row = lines.where("line_type = '3_compact'").first()
    assert (row.account_id, row.debit, row.credit, row.balance, row.cumul_balance) == (
        COMPACTED, D(21), D(4), D(17), D(17))


def test_net_opening(tables):
    # 100 in and 100 out of the petty cash: kept with history, gone without.
    o = ReportOptions(**YEAR).normalise()
    gross = {r.account_id: r for r in opening(tables, o).collect()}
    assert (gross[COMPACTED].debit, gross[COMPACTED].credit) == (D(100), D(100))
    net = replace(o, init_balance_history=False)
    assert {r.account_id for r in opening(tables, net).collect()} == {BANKACC}
    row = unaffected_earnings(tables, net).first()
    assert (row.debit, row.credit) == (D(0), D(175))


def test_unaffected_earnings_only_if_covered(tables):
    o = ReportOptions(**YEAR, account_select_ids=(BANKACC,)).normalise()
    assert unaffected_earnings(tables, o).count() == 0
    o = replace(o, account_select_ids=(UNAFFECTED,), journal_ids=(3,))
    assert unaffected_earnings(tables, o).first().balance == D("-175.00")
    o = replace(o, date_from=d("2000-01-01"))
    assert unaffected_earnings(tables, o).first().balance == 0
    lines = ledger(tables, o)
    assert lines.where("line_type = '4_total'").count() == 1


@pytest.mark.parametrize("changes", [
    {}, {"init_balance_history": False, "compact_account": True},
    {"account_select_ids": (UNAFFECTED, BANKACC)}])
def test_openings_are_both_kinds_together(tables, changes):
    o = ReportOptions(**YEAR, **changes).normalise()
    columns = ["account_id", "debit", "credit", "balance", "report_object_id"]
    both = opening(tables, o).select(*columns).union(unaffected_earnings(tables, o).select(*columns))
    assert sorted(openings(tables, o, report_sums(tables, o)).select(*columns).collect()) == sorted(both.collect())


def test_third_party_result_account_counts_twice(tables, spark):
    """A third-party account outside the balance sheet is in the result and open as well."""
    accounts = tables["account_account"].withColumn(
        "include_initial_balance",
        F.when(F.col("id") == OTHER_REC, False).otherwise(F.col("include_initial_balance")))
    t = make(spark, [(90, OTHER_REC, 1, 1, None, None, "2023-02-02", None, "7.00", "posted", None)])
    t = t.with_frames(account_account=accounts)
    lines = general_ledger(t, **YEAR).cache()
    assert 90 in ids(lines, "1_init_line")
    assert lines.where("line_type = '0_init' and account_id = 100").first().balance == D(-168)
    body = object_totals(lines, ReportOptions(**YEAR).normalise())
    assert sorted(body.select("report_object_id", "balance").collect()) == sorted(
        lines.where("line_type = '4_total'").select("report_object_id", "balance").collect())


def test_partner_ledger(tables):
    lines = partner_ledger(tables, **YEAR, result_selection="customer").cache()
    assert ids(lines, "1_init_line") == [1, 4]
    assert 19 not in ids(lines, "2_line"), "no partner"
    assert {r.report_object_id for r in lines.where("line_type = '4_total'").collect()} == {1, 2, 3}
    bob = {r.move_line_id: r.cumul_balance for r in
           lines.where("partner_id = 2 and move_line_id is not null").collect()}
    assert bob == {4: D(70), 5: D(0), 6: D(80)}


def test_open_items_do_not_change_with_later_matches(tables, spark):
    """An old open-items report is the same after a later payment is matched."""
    def report(t):
        rows = partner_ledger(t, date_from=d("2024-01-01"), date_to=d("2024-12-31"),
                              reconciled=False, result_selection="customer")
        return sorted(ids(rows, "1_init_line") + ids(rows, "2_line"))
    assert report(tables) == [1, 6]
    paid = make(spark, [(91, RECEIVABLE, 3, 1, None, 9, "2025-02-02", None, "-100.00",
                         "posted", None)])
    matched = paid.items.withColumn("full_reconcile_id", F.when(F.col("id") == 1, 9)
                                    .otherwise(F.col("full_reconcile_id")))
    assert report(paid.with_frames(account_move_line=matched)) == [1, 6]


def test_journal_ledger_has_no_opening(tables):
    kinds = {r.line_type for r in journal_ledger(tables, **YEAR).collect()}
    assert kinds == {"2_line", "4_total", "5_super_total"}


def test_open_ledger_has_no_period(tables):
    lines = open_ledger(tables, **YEAR).cache()
    assert ids(lines, "2_line") == [] and ids(lines, "1_init_line") == [1, 4]
    assert lines.where("line_type = '0_init'").count() == 4


def test_analytic_ledger(tables):
    lines = analytic_ledger(tables, **YEAR).cache()
    assert ids(lines, "2_line") == [20]
    assert lines.where("line_type = '4_total'").first().analytic_account_id == 9


def test_age_bucket_edges(tables):
    row = aged_balance(tables, date_to=d("2024-12-31")).where("line_type = '4_total'").first()
    assert (row.current, row.age_30_days, row.age_60_days, row.age_90_days, row.age_120_days,
            row.older) == (D(-1), D(-2), D(-4), D(-8), D(-16) + D(-128), D(-32))
    # The item without a due date is in the balance and in no bucket.
    assert row.balance - sum(row[c] for c in AMOUNTS[3:]) == D(-64)


def test_aged_balance_keeps_items_paid_after_the_end(tables):
    lines = aged_balance(tables, date_to=d("2024-12-31"), result_selection="customer")
    assert ids(lines, "2_line") == [1, 6]


ALL = [ReportOptions(**YEAR, ledger_type=k, result_selection="customer_supplier", **c)
       for k in ("general", "partner", "journal", "open", "aged", "analytic")
       for c in ({}, {"init_balance_history": False, "target_move": "all"},
                 {"compact_account": True, "reconciled": False, "journal_ids": (1,)})]


@pytest.mark.parametrize("options", ALL[::2], ids=lambda o: f"{o.ledger_type}-{o.target_move}")
def test_totals_agree_with_lines(tables, options):
    o = options.normalise()
    lines = ledger(tables, o).cache()
    columns = ["report_object_id", *AMOUNTS, "cumul_balance"]
    direct = lines.where("line_type = '4_total'").select(*columns)
    summed = object_totals(lines, o)
    assert sorted(direct.collect()) == sorted(summed.select(*columns).collect())
    whole = lines.where("line_type = '5_super_total'").select(*columns).collect()
    assert whole == grand_total(summed, o).select(*columns).collect()
    lines.unpersist()


@pytest.mark.parametrize("options", ALL[1::4], ids=lambda o: f"{o.ledger_type}-{o.target_move}")
def test_stored_tables_give_the_same(tables, stored, options):
    a = ledger(prepare(tables), options)
    b = ledger(stored, options)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_all_reports_at_once_equal_single_ones(tables, stored):
    from ledgerloom.schemas import REPORT_CONFIG
    spark = tables.spark
    reports = [replace(o, report_id=i) for i, o in enumerate(ALL, 1)]
    rows = [(o.report_id, 1, o.name, o.ledger_type, True, o.target_move, o.reconciled,
             o.result_selection, o.compact_account, o.init_balance_history, o.date_from,
             o.date_to, list(o.journal_ids), [], [], [], []) for o in reports]
    table = spark.createDataFrame(rows, REPORT_CONFIG)
    for t in (tables, stored):
        many = run_trial_balances(t, table, d("2024-12-31")).drop("company_currency_id").cache()
        for o in reports[t is stored::6]:
            one = trial_balance(t, o).drop("company_currency_id")
            got = many.where(F.col("report_id") == o.report_id)
            assert got.exceptAll(one).count() == 0 and one.exceptAll(got).count() == 0


def test_empty_report_has_a_zero_total(tables):
    lines = ledger(tables, ReportOptions(**YEAR, account_select_ids=(999,)))
    rows = lines.collect()
    assert [r.line_type for r in rows] == ["5_super_total"] and rows[0].balance == 0


def test_other_company_sees_nothing(tables):
    assert ledger(tables, ReportOptions(**YEAR, company_id=2)).count() == 1


def test_coarse_currency_rounding(spark):
    t = make(spark, [(92, BANKACC, 3, None, None, None, "2024-09-09", None, "0.02", "posted", None),
                     (93, BANKACC, 3, None, None, None, "2024-09-10", None, "0.03", "posted", None)],
             rounding="0.05")
    lines = general_ledger(t, **YEAR).cache()
    assert 92 not in ids(lines, "2_line") and 93 in ids(lines, "2_line")
    total = lines.where(f"line_type = '4_total' and account_id = {BANKACC}").first()
    assert total.balance == D("101.05") and total.cumul_balance == D("101.03")


def test_group_subtree_and_selection(tables):
    assert {r.group_id for r in account_group_subtree(tables, [1]).collect()} == {1, 2, 3}
    o = ReportOptions(**YEAR, account_group_ids=(2,)).normalise()
    assert {r.account_id for r in select_accounts(tables, o).collect()} == {BANKACC, COMPACTED}


def test_a_chain_of_groups_and_a_cycle(spark, tables):
    def groups(rows):
        frame = spark.createDataFrame(rows, "id bigint, parent_id bigint, name string")
        return tables.with_frames(account_group=frame)

    chain = groups([(i, i - 1 if i > 1 else None, "g") for i in range(1, 501)] + [(600, 999, "orphan")])
    below = {r.group_id for r in account_group_subtree(chain, [250, 600]).collect()}
    assert below == {*range(250, 501), 600}
    pairs = account_group_closure(chain).where("member_id = 500").count()
    assert pairs == 500
    with pytest.raises(ValueError):
        account_group_subtree(groups([(1, 2, "a"), (2, 1, "b")]), [1])


def test_eligible_partners(tables):
    assert {r.id for r in eligible_partners(tables["res_partner"]).collect()} == {1, 2, 4}


def test_search(tables, general):
    found = search_lines(general, tables, move_name="m/2", account_id=BANKACC)
    assert ids(found, "2_line") == [21, 22, 23]
    assert ids(search_lines(general, tables, move_name="m_2"), "2_line") == []
    assert 6 not in ids(search_lines(general, tables, unreconciled=True), "2_line")
    assert ids(search_lines(general, tables, third_party="customer", line_type="1_init_line"),
               "1_init_line") == [1, 4]
    with pytest.raises(ValueError):
        search_lines(general, tables, colour="red")


def test_grouped_lines_have_their_own_balance(general):
    row = (group_lines(exports.view_lines(general), "account_id")
           .where(f"account_id = {BANKACC}").first())
    assert row.cumul_balance == row.debit - row.credit == D(101)


def test_sections_and_statement(tables, general):
    o = ReportOptions(**YEAR).normalise()
    labelled = exports.labelled_lines(general, tables, o)
    rows = exports.section_rows(labelled, tables, o).where(
        f"report_object_id = {BANKACC}").collect()
    assert sorted(r.section_part for r in rows) == ["0_heading"] + ["1_line"] * 4 + ["2_totals"]
    assert [r.heading for r in rows if r.section_part == "0_heading"] == ["512 Bank"]
    statement = exports.statement_rows(labelled, o).collect()
    assert [r.label for r in statement if r.block == 0] == ["Total"]
    assert {r.label for r in statement if r.line_type == "0_init"} == {"INIT"}
    assert all(r.credit is None for r in statement if r.move_line_id == 22)
    order = [(r.object_name, r.line_type) for r in exports.display_order(labelled).collect()]
    named = [x for x in order if x[0]]
    assert named == sorted(named)


def test_stored_reports_replace_only_themselves(spark, general, tmp_path):
    path = str(tmp_path / "lines")
    exports.write_lines(general, path)
    exports.write_lines(general.withColumn("report_id", F.lit(2)), path)
    exports.write_lines(general.limit(3), path)
    counts = {r.report_id: r["count"] for r in
              spark.read.parquet(path).groupBy("report_id").count().collect()}
    assert counts == {1: 3, 2: general.count()}


@pytest.fixture
def many_ranges(spark):
    """Ranges of a few rows: small partitions are not put together."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_running_balance_over_many_ranges(spark, many_ranges):
    test_running_balance_by_brute_force(spark)


def test_ledgers_over_many_ranges(tables, general, many_ranges):
    again = general_ledger(tables, **YEAR)
    assert again.exceptAll(general).count() == 0 and general.exceptAll(again).count() == 0


def test_ranges_of_a_hot_key_are_even(spark, many_ranges):
    """All rows have one key and one day; ids are sparse. They are shuffled once, into even ranges."""
    ids = spark.range(20_000).select((F.col("id") * F.col("id") * 7919 % 10**12).alias("id")).distinct()
    ranges = staged_ranges(ids.select(F.lit(1).alias("k"), F.lit("d").alias("day"), "id"), "k", "day", "id")
    sizes = [r["count"] for r in ranges.groupBy("_range").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 3 * sum(sizes) / len(sizes)
    assert not spark.sql("SHOW TABLES").where("tableName LIKE 'staged_%'").count()
    plan = ranges.groupBy("_range", "k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_reports_scan_the_items_three_times(spark, stored, monkeypatch):
    """For lines' sums, for the start's month and for detail rows; exports read what is staged."""
    plans = []

    def recorded(write):
        def run(df, *args):
            plans.append(df)
            return write(df, *args)
        return run

    def scans(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return sum("FileScan" in line and "/account_move_line/" in line for line in plan.splitlines())

    spark.conf.set("spark.sql.maxMetadataValueLength", "1000")
    monkeypatch.setattr(ledgers, "staged", recorded(ledgers.staged))
    monkeypatch.setattr(running, "staged_ranges", recorded(running.staged_ranges))
    for options in (ReportOptions("general", **YEAR), ReportOptions("general", **YEAR, compact_account=True),
                    ReportOptions("partner", **YEAR, result_selection="customer_supplier"),
                    ReportOptions("open", **YEAR), ReportOptions("journal", **YEAR)):
        plans.clear()
        lines = ledger(stored, options)
        o = options.normalise()
        labelled = exports.labelled_lines(lines, stored, o)
        assert [scans(p) for p in plans] == [2 if o.has_opening else 1, 1]
        for final in (lines, exports.pivot_rows(labelled), exports.section_rows(labelled, stored, o)):
            assert scans(final) == 0


def test_running_balance_by_brute_force(spark):
    """Hot key, hot day, null key: the same as a plain running sum."""
    import random
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), d(f"2024-01-0{rng.choice([1, 1, 1, 2, 3])}"),
             D(rng.randint(-9999, 9999)) / 100) for i in rng.sample(range(1000), 300)]
    expected, carried = {}, {1: D("10.00"), 2: D("-3.00")}
    for key in (1, 2, None):
        total = carried.get(key, D(0))
        for i, k, date, amount in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            total += amount
            expected[i] = total
    df = spark.createDataFrame(
        rows, "move_line_id bigint, account_id bigint, date date, balance decimal(18,2)")
    start = spark.createDataFrame(list(carried.items()),
                                  "report_object_id bigint, balance decimal(18,2)")
    out = running_balance(df.repartition(7), "account_id", start)
    assert {r.move_line_id: r.cumul_balance for r in out.collect()} == expected


def test_rows_and_partitions_do_not_matter(tables, general):
    shuffled = tables.with_frames(
        account_move_line=tables.items.repartition(5, F.rand(7)))
    again = general_ledger(shuffled, **YEAR)
    assert again.exceptAll(general).count() == 0 and general.exceptAll(again).count() == 0


def test_balance_sheet_closing_is_next_opening(tables):
    closing = general_ledger(tables, **YEAR).where(
        f"line_type = '4_total' and account_id = {BANKACC}").first().balance
    o = ReportOptions(date_from=d("2025-01-01")).normalise()
    nxt = opening(tables, o).where(f"account_id = {BANKACC}").first().balance
    assert closing == nxt


@pytest.mark.parametrize("scale", [0, 3])
def test_amounts_of_any_scale(tables, tmp_path, scale):
    """Store, lines and exports keep the amounts' decimal places."""
    factor = D("0.1") if scale == 3 else D(1)
    kind = f"decimal(18,{scale})"
    amounts = ("debit", "credit", "balance", "amount_currency")
    items = tables.items.withColumns({c: (F.col(c) * factor).cast(kind) for c in amounts})
    changed = tables.with_frames(account_move_line=items)
    write_tables(changed, str(tmp_path / "store"))
    again = read_store(tables.spark, str(tmp_path / "store"))
    assert again.items.schema["balance"].dataType.simpleString() == kind
    lines = ledger(again, ReportOptions(**YEAR))
    o = ReportOptions(**YEAR).normalise()
    debit = lines.where("line_type < '4'").agg(F.sum("debit")).first()[0]
    labelled = exports.labelled_lines(lines, again, o)
    assert exports.pivot_rows(labelled).agg(F.sum("debit")).first()[0] == debit
    sections = exports.section_rows(labelled, again, o).where("section_part = '2_totals'")
    assert sections.agg(F.sum("debit")).first()[0] == debit
    a, b = ledger(prepare(changed), ReportOptions(**YEAR)), lines
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ids_as_a_frame(tables):
    from ledgerloom.operators.scan import keep_ids
    wanted = tables.spark.createDataFrame([(BANKACC,), (BANKACC,)], "any bigint")
    kept = keep_ids(tables.items, "account_id", wanted)
    assert kept.count() == keep_ids(tables.items, "account_id", [BANKACC]).count() > 0
    assert keep_ids(tables.items, "account_id", ()).count() == tables.items.count()


def test_many_reports_meet_items_without_nested_loops(spark, stored, monkeypatch):
    """Scans of the items do not grow with the reports, and rows meet by equal keys only."""
    plans = []

    def recorded(write):
        def run(df, *args):
            plans.append(df)
            return write(df, *args)
        return run

    monkeypatch.setattr(multi, "staged", recorded(multi.staged))
    monkeypatch.setattr(running, "staged_ranges", recorded(running.staged_ranges))
    spark.conf.set("spark.sql.maxMetadataValueLength", "1000")

    def scans(n):
        plans.clear()
        rows = [(i, 1, ("general", "partner", "journal", "aged")[i % 4], d(f"2024-0{i % 9 + 1}-01"))
                for i in range(1, n + 1)]
        reports = conform(spark.createDataFrame(
            rows, "report_id long, company_id long, ledger_type string, date_from date"), REPORT_CONFIG)
        plans.append(run_ledgers(stored, reports, d("2024-12-31")))
        plans.append(run_trial_balances(stored, reports, d("2024-12-31")))
        text = "\n".join(p._jdf.queryExecution().executedPlan().toString() for p in plans)
        assert "NestedLoop" not in text and "CartesianProduct" not in text
        return sum("FileScan" in x and "/account_move_line/" in x for x in text.splitlines())

    assert scans(2) == scans(9) == 5


def test_saved_reports_are_written_in_one_job(spark, tables, tmp_path):
    rows = [(1, 1, "general", False), (2, 1, "partner", True), (3, 1, "journal", False)]
    reports = conform(spark.createDataFrame(
        rows, "report_id long, company_id long, ledger_type string, summary boolean"), REPORT_CONFIG)
    path = str(tmp_path / "lines")
    write_reports(tables, reports, path, d("2024-12-31"))
    stored_lines = spark.read.parquet(path)
    for i, _, kind, summary in rows:
        one = ledger(prepare(tables), ReportOptions(kind, report_id=i, summary=summary))
        got = stored_lines.where(f"report_id = {i}").select(
            *[F.col(c).cast(t) for c, t in one.dtypes])
        assert got.exceptAll(one).count() == 0 and one.exceptAll(got).count() == 0


def test_items_prepared_for_one_report_are_joined_late(spark, tables, monkeypatch):
    """Entries met all items twice, and all their columns once; they meet the rows that a report selected."""
    bare = tables.with_frames(account_move_line=tables.items.drop("parent_state", "move_name", "last_match_date"))
    found = []
    monkeypatch.setattr(running, "staged_ranges", lambda rows, *order: found.append(rows) or staged_ranges(rows, *order))
    entries = tables["account_move"]
    for repeated in (bare, bare.with_frames(account_move=entries.unionByName(entries.where("id % 2 = 0")))):
        late = prepare(repeated)
        whole = late.with_frames()                     # the same items, joined before a report selects rows
        assert late.extract is not None and whole.extract is None
        for options in (ReportOptions("general", **YEAR), ReportOptions("general", **YEAR, compact_account=True),
                        ReportOptions("partner", **YEAR, reconciled=False), ReportOptions("journal", **YEAR),
                        ReportOptions("open", **YEAR), ReportOptions("partner", **YEAR, summary=True)):
            a, b = ledger(late, options), ledger(whole, options)
            # running balances of rows that are alike have no order of their own
            a, b = (x.drop("cumul_balance") for x in (a, b))
            assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert {"move_name", "parent_state"} <= set(found[0].columns)


def test_names_of_matches_are_joined_to_reconciled_lines_alone(general, tables):
    """All lines were shuffled for them, with the names of accounts and journals."""
    o = ReportOptions("general", **YEAR).normalise()
    labelled = exports.labelled_lines(general, tables, o)
    plan = labelled._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert labelled.count() == general.count()
    unions = [i for i, x in enumerate(plan) if x.lstrip(" :+-").startswith("Union")]
    joins = [i for i, x in enumerate(plan) if "Join LeftOuter" in x]
    assert unions and min(joins) < min(unions) < max(joins)
