import hashlib
import re
from collections import Counter

import pytest
from conftest import odd_documents, sentence

from ledgerloom.llm import decontaminate as d


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        k = min(window, len(iw))
        if not k:
            continue
        grams = {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i:i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add("" if item is None else str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


ITEMS = [(1, sentence(1, 30)), (2, sentence(3, 6000)[400:2500]), (10, "Alpha BETA-gamma"), (3, None),
         (4, ""), (5, "..."), (None, sentence(17, 80)[50:300]), (7, sentence(1, 30)),
         (7, sentence(1, 30)), (8, "no gap no"), (9, sentence(15, 9)), (12, "x" * 5000),
         (13, "世界 你好 " * 7), (14, " ".join(["gap no gap"] * 9))]


@pytest.mark.parametrize("block_words", [100_000, 40])
def test_against_brute_force(spark, odd, block_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = d.match_benchmark(odd, items, block_words=block_words)
    assert got.columns == odd.columns + ["_n_words", "_n_hit", "item_ids", "hit_words"]
    rows = Counter((r.doc_id, r.text, r._n_words, r._n_hit, tuple(r.item_ids))
                   for r in got.collect())
    expected = Counter()
    for i, text, *_ in odd_documents():
        n, hit, _, _, _ = brute(text, ITEMS)
        found = sorted({"" if k is None else str(k) for k, t in ITEMS if brute(text, [(k, t)])[2]})
        expected[(i, text, n, hit, tuple(found))] += 1
    assert rows == expected


def test_long_item_is_cut_without_loss(spark):
    text = sentence(5, 9000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert d.contamination_report(docs, items).first().n_hit == 9000


def test_no_items_and_no_documents(spark, odd, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in d.contamination_report(odd, empty).collect()} == {0}
    assert d.contamination_report(none, spark.createDataFrame(ITEMS, empty.schema)).count() == 0


def test_removal(spark):
    leak = sentence(1, 20)
    docs = spark.createDataFrame(
        [(1, f"Before, {leak.upper()}! after"), (2, leak), (3, "clean  text\n"), (4, None),
         (5, sentence(2, 200) + "\n" + leak)], "doc_id long, text string")
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    got = {r.doc_id: r.text for r in d.remove_benchmark(docs, items, max_coverage=0.95).collect()}
    assert got == {1: "Before, after", 3: "clean  text\n", 4: None, 5: sentence(2, 200) + "\n"}


def test_registered_query(spark):
    from ledgerloom.llm import queries
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    expected = {r.doc_id: brute(r.text, items) for r in docs}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op1_decontamination(spark, path).collect()}
    assert got == expected and any(x[4] for x in expected.values())
