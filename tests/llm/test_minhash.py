import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import odd_documents, sentence

from ledgerloom.llm import minhash
from ledgerloom.llm.components import connected_components

LEAST = float("-inf")


def shingles(text, size):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    order = [LEAST if i is None else i for i, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), float("inf")), order[i])
    return Counter((rows[i][0], len(sets[i]), None if least[find(i)] == LEAST else least[find(i)],
                    order[i] == least[find(i)]) for i in range(len(rows)))


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def near_copies():
    """Chains of small edits, a large group around one text, pairs near the threshold."""
    rnd, rows = random.Random(9), []
    for base in range(12):
        words = sentence(50 + base, 120).split()
        for _ in range(12):
            rows.append(" ".join(words))
            words = list(words)
            for _ in range(rnd.randint(0, 6)):
                words[rnd.randrange(len(words))] = f"edit{rnd.randrange(9999)}"
    hub = sentence(99, 150).split()
    for i in range(400):
        words = list(hub)
        for _ in range(rnd.choice([1, 2, 3, 4, 6])):
            words[rnd.randrange(len(words))] = f"hub{i}x{rnd.randrange(9999)}"
        rows.append(" ".join(words).upper() if i % 7 == 0 else " ".join(words))
    rows += [sentence(500 + i, rnd.randint(1, 80)) for i in range(100)] + [" ".join(hub)] * 5
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, size, percent, monkeypatch):
    monkeypatch.setattr(minhash, "NODE", 40)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(minhash.near_duplicates(docs, shingle=size, percent=percent)) == brute(
        rows, size, percent)


def test_odd_documents(odd, none):
    got = minhash.near_duplicates(odd, shingle=3, percent=85)
    assert result(got) == brute([r[:2] for r in odd_documents()], 3, 85)
    assert minhash.near_duplicates(none).count() == 0


def test_intersections():
    rnd = random.Random(3)
    sets = [np.unique(np.array(rnd.sample(range(900), rnd.randint(1, 700)), np.uint64))
            for _ in range(40)]
    got = minhash.intersections(sets, slice(5, 25))
    assert got.astype(int).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[5:25]]
    assert minhash.intersections([sets[0]], slice(0, 1)).tolist() == [[0.0]]


def test_components(spark):
    links = [(i + 1, i) for i in range(0, 60)] + [(100, 105), (105, 103), (200, 200), (7, 3)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(61)} | {
        (100, 100), (103, 100), (105, 100)}
    assert len(got) == 64
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_registered_query(spark):
    from ledgerloom.llm import queries
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert result(queries.op9_chosen_path(spark, path)) == brute(rows, 3, 85)


def test_words_that_a_polynomial_confuses(spark):
    """Two texts that differ in long words of one pattern share no more than the rest."""
    def pattern(n, a, b):
        return "".join(a if bin(i).count("1") % 2 else b for i in range(n))

    words = sentence(77, 12).split()
    rows = [(i, " ".join([*words[:4], pattern(1024, a, b), *words[4:8], pattern(2048, b, a), *words[8:]]))
            for i, (a, b) in enumerate([("x", "y"), ("y", "x")])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85)
    assert all(r.kept for r in got.collect())
