import hashlib
import zlib

import pytest
from conftest import sentence
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import periods
from ledgerloom.llm.queries import QUERIES


def lyndon_lengths(symbols, reverse):
    """The longest Lyndon word at i ends where the next lesser suffix begins."""
    t = [-s for s in symbols] if reverse else symbols
    return [next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t)) - i for i in range(len(t))]


def all_runs(words, min_length, min_periods):
    """Maximal stretches for every period, each under its smallest one."""
    found = {}
    for q in range(1, len(words) // min_periods + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_periods * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def numbered(words):
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return [number[w] for w in words], len(number)


@st.composite
def repetitive(draw):
    word = st.integers(0, draw(st.integers(0, 3)))
    out = []
    for _ in range(draw(st.integers(1, 4))):
        out += draw(st.lists(word, min_size=1, max_size=8)) * draw(st.integers(1, 6))
    return out


@settings(max_examples=400, deadline=None)
@given(repetitive(), st.booleans(), st.sampled_from([(2, 2), (6, 3), (24, 3), (5, 4)]))
def test_against_brute_force(words, reverse, least):
    symbols, kinds = numbered(words)
    assert periods.lyndon_array(symbols, kinds, reverse) == lyndon_lengths(symbols, reverse)
    assert periods.word_runs(symbols, kinds, *least) == all_runs(symbols, *least)


def test_long_rows_of_one_word_and_of_fibonacci_words():
    one = [0] * 50_000
    assert periods.word_runs(one, 1, 24, 3) == [(0, 50_000, 1)]
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    assert periods.word_runs(b, 2, 24, 3) == all_runs(b, 24, 3)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    words = [w.decode() for w in words]
    runs = all_runs(words, 24, 3)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return (len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(collapsed(words, runs).encode()).hexdigest())


def test_report_on_odd_rows(spark, odd, none):
    more = [(100 + i, " ".join([sentence(i, i % 7 + 1)] * (i + 2)) + "  " + sentence(i, 5)) for i in range(40)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = periods.run_report(periods.repeat_tails(docs)).collect()
    rows = docs.collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(
        map(str, ((r.doc_id, *expected(r.doc_id, r.text)) for r in rows)))
    assert any(r.n_runs > 1 for r in got) and any(r.n_runs == 0 for r in got)
    assert periods.run_report(periods.repeat_tails(none)).collect() == []


def test_operator_keeps_columns_and_gives_runs(spark, odd):
    docs = odd.withColumnRenamed("kept", "runs")
    out = periods.collapse_runs(docs, min_length=6, min_periods=2)
    assert out.columns == ["doc_id", "lang", "n_words", "runs", "n_hit", "collapsed", "_runs"]
    row = out.where("doc_id = 7").first()
    words = docs.where("doc_id = 7").first().text.split()
    runs = all_runs(words, 6, 2)
    assert [tuple(r) for r in row["_runs"]] == runs and runs
    assert row.collapsed == collapsed(words, runs)
    with pytest.raises(ValueError):
        periods.collapse_runs(docs, min_periods=1)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_lyndon_runs"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 4000").collect()
    assert docs and all(got[d.doc_id] == expected(d.doc_id, d.text) for d in docs)
    assert sum(v[0] > 0 for v in got.values()) > len(got) / 20
