"""The store: layout, sums per month, pruning, batches."""

import glob
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from handmade import YEAR, d, make
from ledgerloom import (
    ReportOptions, add_to_store, aged_balance, general_ledger, ledger, partner_ledger, read_store,
    trial_balance, write_tables)
from ledgerloom import schemas as S
from ledgerloom.operators.opening import opening, unaffected_earnings
from ledgerloom.sources.tables import prepare
from ledgerloom.sources.trade import derive_tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables(spark):
    t = derive_tables(spark, SF)
    return t.with_frames(**{n: f.cache() for n, f in t.frames.items()})


@pytest.fixture(scope="module")
def store(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "ledger")
    write_tables(tables, path)
    return path


@pytest.fixture(scope="module")
def direct(tables):
    t = prepare(tables)
    return t.with_frames(account_move_line=t.items.cache())


def same(a, b, columns=None):
    columns = columns or a.columns
    x, y = (sorted(map(str, f.select(*columns).collect())) for f in (a, b))
    assert x == y


@pytest.mark.parametrize("start, changes", [
    (date(1998, 1, 1), {}), (date(1997, 5, 17), {"init_balance_history": False}),
    (date(1996, 2, 29), {"target_move": "all", "journal_ids": (1, 3)})])
def test_openings_equal_the_direct_form(spark, store, direct, start, changes):
    """Also where the report starts inside a month, and for one account's or partner's openings."""
    stored = read_store(spark, store)
    assert stored.rollup is not None and direct.rollup is None
    for kind in ("general", "partner"):
        o = ReportOptions(kind, date_from=start, date_to=date(1998, 6, 15),
                          result_selection="customer_supplier", **changes).normalise()
        same(opening(stored, o), opening(direct, o))
        if kind == "general":
            same(unaffected_earnings(stored, o), unaffected_earnings(direct, o))
        same(trial_balance(stored, o), trial_balance(direct, o))


def test_ledgers_equal_the_direct_form(spark, store, direct):
    stored = read_store(spark, store)
    inside = dict(date_from=date(1997, 5, 17), date_to=date(1997, 11, 3))
    for o in (ReportOptions("general", **inside, compact_account=True), ReportOptions("open", **inside),
              ReportOptions("partner", **inside, reconciled=False, result_selection="customer_supplier"),
              ReportOptions("aged", date_to=date(1997, 8, 20))):
        same(ledger(stored, o), ledger(direct, o))


def spoil(path, keep):
    """Make files unreadable whose partition is not to be kept; how many of each there are."""
    files = glob.glob(f"{path}/version=*/*/*/*/*.parquet")
    gone = [f for f in files if not keep(dict(p.split("=") for p in f.split("/") if "=" in p))]
    for f in gone:
        with open(f, "wb") as out:
            out.write(b"none")
    return len(gone), len(files)


def test_history_is_not_read(spark, tables, direct, tmp_path):
    """A report of 1998 still works when all that was closed before 1998 is gone."""
    path = str(tmp_path / "store")
    write_tables(tables, path)
    gone, files = spoil(f"{path}/account_move_line",
                        lambda p: int(p["date_year"]) >= 1998 or int(p["open_year"]) >= 1998)
    assert 6 <= gone < files
    stored = read_store(spark, path)
    for o in (ReportOptions("general", **YEAR_98), ReportOptions("partner", **YEAR_98),
              ReportOptions("general", **YEAR_98, summary=True)):
        same(ledger(stored, o), ledger(direct, o))
    o = ReportOptions("aged", date_to=date(1998, 12, 31), result_selection="customer")
    same(ledger(stored, o), ledger(direct, o))


YEAR_98 = dict(date_from=date(1998, 1, 1), date_to=date(1998, 12, 31))


def test_other_accounts_or_items_leave_the_sums_aside(spark, store):
    stored = read_store(spark, store)
    assert "open_year" in stored.items.columns
    for name in ("account_account", "account_move_line"):
        changed = stored.with_frames(**{name: stored[name]})
        assert changed.rollup is None and "open_year" not in changed.items.columns
    assert stored.with_frames(res_partner=stored["res_partner"]).rollup is not None


def folders(path):
    return set(glob.glob(f"{path}/*/version=*/*/*/*/*.parquet"))


def stored_rows(spark, path):
    t = read_store(spark, path)
    cells = t.rollup.groupBy(*[c for c in t.rollup.columns if c not in S.FLOWS]).agg(
        *[F.sum(c).cast("decimal(28,2)").alias(c) for c in S.FLOWS])
    return {n: sorted(map(str, f.select(sorted(f.columns)).collect()))
            for n, f in {**t.frames, "rollup": cells}.items()}


def test_a_batch_equals_storing_everything(spark, tables, tmp_path):
    """New items, new matches of old items, an unmatched item, changed entries, another account type."""
    whole, path = str(tmp_path / "whole"), str(tmp_path / "parts")
    cut = F.col("date") >= F.lit(date(1998, 4, 1))
    items = tables.items.cache()
    # matches completed by new items are not known yet; in the old part their items are unmatched
    late = items.where(cut).select("full_reconcile_id").where("full_reconcile_id IS NOT NULL").distinct()
    late = late.withColumn("late", F.lit(True)).cache()
    old = items.where(~cut).join(late, "full_reconcile_id", "left")
    first = old.withColumn("full_reconcile_id", F.when(F.col("late").isNull(), F.col("full_reconcile_id")))
    entries = tables["account_move"].withColumn("state", F.lit("draft")).where("id % 5 = 0").unionByName(
        tables["account_move"].where("id % 5 <> 0"))
    old_entries = entries.join(items.where(~cut).select(F.col("move_id").alias("id")), "id", "left_semi")
    accounts = tables["account_account"]
    other = accounts.withColumn("type_third_parties", F.when(
        F.col("id") == 41103, "no").when(F.col("id") == 70702, "customer").otherwise(
        F.col("type_third_parties")))
    drop = items.where(~cut & F.col("full_reconcile_id").isNotNull()).join(
        late, "full_reconcile_id", "left_anti").agg(F.min("id")).first()[0]
    write_tables(tables.with_frames(
        account_move_line=first.select(*items.columns).drop("parent_state", "move_name"),
        account_move=old_entries, account_account=other), path)
    before = folders(path)
    matches = (old.where("late").select("id", "full_reconcile_id")
               .unionByName(spark.createDataFrame([(drop, None)], "id long, full_reconcile_id long")))
    batch = {"account_move_line": items.where(cut).drop("parent_state", "move_name"),
             "account_move": tables["account_move"].join(
                 items.where(cut).select(F.col("move_id").alias("id")), "id", "left_semi").unionByName(
                 tables["account_move"].where("id % 5 = 0")).distinct(),
             "account_account": accounts}
    add_to_store(spark, path, batch, matches)
    expected = items.withColumn("full_reconcile_id", F.when(F.col("id") != drop, F.col("full_reconcile_id")))
    write_tables(tables.with_frames(
        account_move_line=expected.drop("parent_state", "move_name")), whole)
    assert stored_rows(spark, path) == stored_rows(spark, whole)
    assert before <= folders(path), "files of the version before stay for its readers"


def test_a_batch_leaves_other_partitions(spark, tables, tmp_path):
    """One more item and one match: files of other years and open years keep their names."""
    path = str(tmp_path / "store")
    write_tables(tables, path)
    items = read_store(spark, path).items
    one = items.where("account_id = 41101 AND open_year = 9999 AND date_year = 1998").first()
    newest = items.agg(F.max("id")).first()[0]
    new = tables.items.where(F.col("id") == one.id).withColumns({
        "id": F.lit(newest + 1), "date": F.lit(date(1998, 12, 30)), "full_reconcile_id": F.lit(77_000_000)})
    used = set(read_store(spark, path).items.inputFiles())
    add_to_store(spark, path, {"account_move_line": new.drop("parent_state", "move_name")},
                 spark.createDataFrame([(one.id, 77_000_000)], "id long, full_reconcile_id long"))
    again = read_store(spark, path)
    now = set(again.items.inputFiles())
    assert {f for f in used - now} == {f for f in used if "date_year=1998/open_year=9999" in f}
    rows = again.items.where("full_reconcile_id = 77000000").collect()
    assert {(r.id, r.last_match_date, r.open_year) for r in rows} == {
        (one.id, date(1998, 12, 30), 1998), (newest + 1, date(1998, 12, 30), 1998)}
    assert again.items.count() == items.count() + 1
    # a batch that never came to its manifest is not seen
    os.makedirs(f"{path}/manifest/version=3/_temporary")
    assert set(read_store(spark, path).items.inputFiles()) == now


def test_the_handmade_ledger_through_batches(spark, tmp_path):
    """Item by item of the hand-made ledger: half first, the rest as a batch."""
    t = prepare(make(spark))
    half = F.col("id") % 2 == 0
    path = str(tmp_path / "store")
    write_tables(t.with_frames(account_move_line=t.items.where(half)), path)
    add_to_store(spark, path, {"account_move_line": t.items.where(~half)})
    stored = read_store(spark, path)
    same(general_ledger(stored, **YEAR), general_ledger(t, **YEAR))
    same(partner_ledger(stored, **YEAR, reconciled=False), partner_ledger(t, **YEAR, reconciled=False))
    same(aged_balance(stored, date_to=d("2024-12-31")), aged_balance(t, date_to=d("2024-12-31")))


def test_files_are_cut_by_rows(spark, tables, tmp_path):
    write_tables(tables, str(tmp_path / "s"), rows_per_file=500)
    t = read_store(spark, str(tmp_path / "s"))
    sizes = [r["count"] for r in t.items.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 500 and sum(sizes) == tables.items.count()


def rows_read(df):
    """Rows that the scans of the items gave, by the executed plan's own counters."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            found += plan.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_lookups_by_partner_entry_and_match_skip_files(spark, tables, tmp_path):
    """Selections by columns the items do not lie by read a small share of them."""
    path = str(tmp_path / "store")
    write_tables(tables, path, rows_per_file=100)
    items = read_store(spark, path).items
    whole = rows_read(items.select("id", "balance"))
    assert whole == tables.items.count()
    one = items.where("open_year = 1997 AND account_id BETWEEN 41100 AND 41199").orderBy("id").first()
    for column, most in (("partner_id", 0.7), ("move_name", 0.25), ("full_reconcile_id", 0.25)):
        chosen = items.where(F.col(column) == one[column]).select("id", "balance")
        assert 0 < rows_read(chosen) < most * whole, column
