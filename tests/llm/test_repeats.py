import random
from collections import Counter

import numpy as np
import pytest
from brute_repeats import repeated_bytes, repeated_words
from conftest import odd_documents, sentence

from ledgerloom.llm import anchors, rlz, suffix_dedup, suffix_sort
from ledgerloom.llm.suffix_sort import Suffixes


def rows_of(df, n):
    return Counter((r.doc_id, *tuple(r)[1:n]) for r in df.collect())


def mixed_documents():
    """Passages that documents share, whole and in part, shifted, nested, overlapping, periodic."""
    rnd, rows = random.Random(4), []
    passages = [sentence(100 + i, rnd.randint(30, 120)).split() for i in range(12)]
    for i in range(160):
        words = []
        for _ in range(rnd.randint(0, 5)):
            if rnd.random() < 0.5:
                words += sentence(1000 + i * 10 + len(words), rnd.randint(1, 40)).split()
            else:
                p = rnd.choice(passages)
                a = rnd.randint(0, len(p) - 1)
                words += p[a:a + rnd.randint(1, 90)]
        if rnd.random() < 0.1:
            words += ["tick"] * rnd.randint(1, 100)
        if rnd.random() < 0.1:
            words += ["é", "tock"] * rnd.randint(1, 60)
        rows.append((i, rnd.choice([" ", "  ", "\n"]).join(words)))
    return rows + [(160 + i, rows[i][1]) for i in range(0, 40, 3)] + [(3, rows[3][1]), (None, rows[8][1])]


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(mixed_documents(), "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("sizes", [(4 << 20, 32 << 20), (3000, 4000)])
def test_words_against_brute_force(mixed, sizes):
    rows = mixed_documents()
    got = rlz.rlz_report(mixed, chunk_bytes=sizes[0], bucket_bytes=sizes[1])
    assert rows_of(got, 4) == Counter((i, *x) for (i, _), x in
                                      zip(rows, repeated_words(rows, 35), strict=True))


@pytest.mark.parametrize("sizes", [(4 << 20, 32 << 20), (3000, 4000)])
def test_bytes_against_brute_force(mixed, sizes):
    rows = mixed_documents()
    got = suffix_dedup.suffix_report(mixed, chunk_bytes=sizes[0], bucket_bytes=sizes[1])
    assert rows_of(got, 5) == Counter((i, *x) for (i, _), x in
                                      zip(rows, repeated_bytes(rows, 50), strict=True))


def test_odd_documents(odd, none):
    rows = [r[:2] for r in odd_documents()]
    assert rows_of(rlz.rlz_report(odd), 4) == Counter(
        (i, *x) for (i, _), x in zip(rows, repeated_words(rows, 35), strict=True))
    assert rows_of(suffix_dedup.suffix_report(odd), 5) == Counter(
        (i, *x) for (i, _), x in zip(rows, repeated_bytes(rows, 50), strict=True))
    assert rlz.rlz_report(none).count() == suffix_dedup.suffix_report(none).count() == 0


def test_text_without_duplicates(spark):
    shared = sentence(5, 30)
    docs = spark.createDataFrame([(1, "en", f"é {shared} one", 0), (2, None, f"two {shared}", 0),
                                  (3, "x", None, 1)], "doc_id long, chunk string, text string, ord int")
    got = suffix_dedup.remove_duplicate_bytes(docs)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} == {
        (1, "en", f"é {shared} one", 0), (2, None, "two", 0), (3, "x", None, 1)}


def test_long_rows_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 300)
    rng = np.random.default_rng(1)
    values = anchors.mix(rng.integers(0, 50, 5000).astype(np.uint64))
    first = np.array([0, 10, 10, 4000, 4030, 5000])
    g = anchors.segments(values, first, 35, 6)
    starts = [i for b, e in zip(g.begin, g.end) for i in range(b, e)]
    assert sorted(starts) == [i for a, b in zip(first[:-1], first[1:]) for i in range(a, b - 34)]
    assert all(first[r] <= b and e + 34 <= first[r + 1] for r, b, e in zip(g.row, g.begin, g.end))


def test_suffix_sort():
    rng = np.random.default_rng(3)
    for t in range(40):
        n, symbols = rng.integers(1, 150), rng.integers(0, 2 + t % 3, 400).astype(np.uint8)
        group = np.sort(rng.integers(0, 1 + n // 8, n))
        place, size = rng.integers(0, 300, n), rng.integers(1, 100, n)
        order = Suffixes(symbols).sort(group, place, size)
        keys = [(group[i], bytes(symbols[place[i]:place[i] + size[i]])) for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(n))


def test_suffixes_with_zeros_and_long_agreements():
    """Zero bytes against ends of suffixes, and agreements longer than what is compared as numbers."""
    rng = np.random.default_rng(5)
    for t in range(40):
        symbols = np.tile(rng.integers(0, 2, rng.integers(1, 90)), 12).astype(np.uint8) * (1 + t % 2)
        n = 120
        group, place = np.sort(rng.integers(0, 1 + t % 3, n)), rng.integers(0, len(symbols), n)
        size = np.minimum(rng.integers(0, 150, n), len(symbols) - place)
        order = Suffixes(symbols).sort(group, place, size)
        keys = [(group[i], bytes(symbols[place[i]:place[i] + size[i]]), i) for i in range(n)]
        assert [keys[i] for i in order] == sorted(keys)


def common_line(n):
    """A block of one group: n segments of a common line in contexts of their own."""
    rng = np.random.default_rng(n)
    line, size = rng.integers(97, 123, 22).astype(np.uint8), 78
    rows = [np.concatenate([rng.integers(97, 99, 28), line, rng.integers(97, 99, 28)]) for _ in range(n)]
    return anchors.Block(np.zeros(n, np.int64), np.arange(n) * 3 % n, np.zeros(n, bool), np.arange(n) * size,
                         np.full(n, size), np.full(n, 28), np.concatenate(rows).astype(np.uint8))


def test_a_common_line_in_many_contexts(monkeypatch):
    """Its windows are sorted without a comparison by hashes, in passes of bounded size."""
    def never(*_):
        raise AssertionError("windows that bytes decide were compared by hashes")

    block, window, passes = common_line(300), 50, []
    monkeypatch.setattr(suffix_sort, "PASS_WINDOWS", 1000)
    monkeypatch.setattr(Suffixes, "less", never)
    for segment, start, number in suffix_sort.block_windows(block, window):
        passes.append(number)
        assert (number == segment * 29 + start).all()
    assert max(map(len, passes)) <= 1000 and sorted(np.concatenate(passes)) == list(range(300 * 29))
    got = suffix_dedup.judge_for(window)(block)
    windows = [bytes(block.symbols[b + s:b + s + window]) for b in block.begin for s in range(29)]
    least = {}
    for w, low in zip(windows, np.repeat(block.low, 29), strict=True):
        least[w] = min(least.get(w, low), low)
    assert got.tolist() == [least[w] for w in windows]


def test_collisions_are_verified():
    s = Suffixes(np.array([1, 2, 3, 1, 2, 4], np.uint8))
    n = s.verified(np.array([0, 0]), np.array([3, 3]), np.array([3, 2]))
    assert n.tolist() == [2, 2]


@pytest.mark.parametrize("query, brute, n", [("op4_relative_lempel_ziv", repeated_words, 4),
                                             ("op6_suffix_sort", repeated_bytes, 5)])
def test_registered_queries(spark, query, brute, n):
    from ledgerloom.llm import queries
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    expected = Counter((i, *x) for (i, _), x in zip(rows, brute(rows, 35 if n == 4 else 50), strict=True))
    assert rows_of(queries.QUERIES[query](spark, path), n) == expected
    assert any(k[2] for k in expected)


def test_words_that_a_polynomial_confuses(spark):
    """Texts of 35 words that differ in one long word only: nothing is removed."""
    def pattern(a, b):
        return "".join(a if bin(i).count("1") % 2 else b for i in range(1024))

    words = sentence(78, 34)
    rows = [(0, f"{words} {pattern('x', 'y')}"), (1, f"{words} {pattern('y', 'x')}")]
    report = rlz.rlz_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.n_removed for r in report.collect()] == [0, 0]
