import re
from collections import Counter

import numpy as np
from conftest import odd_documents

from ledgerloom.llm import quality
from ledgerloom.llm.common import range_hashes


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered |= set(range(i, i + 5))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup,
            len(covered))


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_counts_and_base_rules(spark, odd):
    got = quality.quality_rules(odd, labels_of(spark, []), keep_text=True)
    assert got.columns[:6] == odd.columns and got.columns[-1] == "_kept"
    rows = Counter(tuple(r[c] for c in ("doc_id", "text", "_n_words", "word_chars", "n_symbols",
                                        "n_dup_lines", "n_repeat_words", "base_failed", "_kept"))
                   for r in got.collect())
    expected = Counter()
    for i, text, *_ in odd_documents():
        c = brute(text)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        expected[(i, text, *c, failed, not failed)] += 1
    assert rows == expected


def test_empty(spark, none):
    assert quality.quality_rules(none, labels_of(spark, [(1, 1, 0)])).count() == 0


def test_forest_rejects_what_labels_call_bad(spark):
    good = [(i, " ".join(f"w{i}x{j} of plain prose" for j in range(20))) for i in range(80)]
    bad = [(i, " ".join(f"W{i}X{j}!! ## $$ SHOUT{j}" for j in range(20))) for i in range(80, 95)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = labels_of(spark, [(i, int(i < 80), 0) for i in range(0, 95, 2)]
                       + [(3, None, 0), (None, 1, 0), (999, 0, 0), (0, 1, 0)])
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs, labels, keep_text=False).collect()}
    assert got == {i: i < 80 for i in range(95)}


def test_calibrate():
    assert quality.calibrate(np.array([.1, .2, .8]), np.array([True, True, True])) == np.inf
    assert quality.calibrate(np.array([.1, .2, .8]), np.array([True, True, False])) == 0.5
    assert quality.calibrate(np.array([]), np.array([], bool)) == np.inf


def test_registered_query(spark):
    from ledgerloom.llm import queries
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for r in queries.op2_isolation_forest(spark, path).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                r.n_repeat_words) == brute(texts.pop(r.doc_id))
        assert not (r.base_failed and r.kept)
    assert not texts


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 else b for i in range(n))


def test_lines_and_words_that_a_polynomial_confuses():
    """Thue-Morse texts collide under polynomials modulo 2**64, whatever the base."""
    for n in (8, 16, 64, 128, 1024, 4096):
        x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
        h = range_hashes(np.frombuffer((x + y + x).encode(), np.uint8),
                         np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert h[0] == h[2] != h[1]
        text = "\n".join([x, y, x]).encode()
        out = quality.statistics(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert out["n_dup_lines"].tolist() == [1]


def test_hashes_of_ranges_are_their_bytes(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000, dtype=np.uint8)
    starts = rng.integers(0, 3800, 3000)
    ends = starts + rng.integers(0, 100, 3000)
    h = range_hashes(data, starts, ends)
    texts = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    by_text = dict(zip(texts, h.tolist()))
    assert all(by_text[t] == x for t, x in zip(texts, h.tolist()))
    assert len(set(by_text.values())) == len(by_text)


def test_all_labelled_documents_count(spark, monkeypatch):
    """More documents than the trees draw: the threshold still comes from all of them."""
    texts = ["w x y z of the plain prose in here and so on", "W! X! Y! Z! ## $$ %% !! A!! B!! C!! D!!"]
    docs = spark.createDataFrame([(i, texts[i % 3 == 0]) for i in range(300)],
                                 "doc_id long, text string")
    labels = labels_of(spark, [(i, int(i % 3 > 0), 0) for i in range(300)])
    seen = []
    calibrate = quality.calibrate
    monkeypatch.setattr(quality, "calibrate", lambda s, g, b: (
        seen.append((int(g.sum()), int(b.sum()))), calibrate(s, g, b))[1])
    forest = quality.fit_quality(docs, labels, trees=8, subsample=16)
    assert seen == [(200, 100)] and forest.feature.shape[0] == 8
    rows = quality.score_quality(docs, forest, keep_text=False).collect()
    assert {r.doc_id for r in rows if not r.kept} == set(range(0, 300, 3))
