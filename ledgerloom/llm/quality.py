"""Quality rules: statistics of each text, and an isolation forest that finds anomalous documents.

Each text gives a row of rule statistics (share of symbols, of repeated lines, of capitals, ...).
An isolation forest (random splits, Liu et al. 2008) is fitted on the statistics of the labelled
documents: each of its trees, as the method has it, draws SUBSAMPLE of all of them; few splits on
the way to a leaf mean an anomaly. The threshold on the score is calibrated on all labelled
documents. Statistics and scores cover every document.

Defined results: a null or empty text has no words and fails the base rules; null labels and
labels of unknown documents are ignored; contradicting labels of one document count as the lowest;
without labels of both kinds there is no threshold and only the base rules reject. Repeated rows are
judged one by one, in any number. Columns of documents pass through; a new column whose name is
taken gets underscores before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import (
    SPACES, free_name, mix, range_hashes, save, ship, slices, text_buffer, word_ranges)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
TREES = 128
SUBSAMPLE = 256
SEED = 7
STEPS = np.array([0.2, 0.5, 0.2, 0.2, 10.0])

_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return np.diff(sums[offsets])


def _byte_class(characters) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_CLASSES = {
    "symbols": _byte_class(SYMBOLS), "upper": _byte_class(range(65, 91)),
    "exclaims": _byte_class(b"!?"), "spaces": SPACES,
    "leads": np.array([(b & 0xC0) != 0x80 for b in range(256)])}


def repeated_words(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per row the words inside windows of which the row has another equal one."""
    n, rows = len(hashes), np.diff(first)
    if n < window:
        return np.zeros(len(rows), np.int64)
    row = np.repeat(np.arange(len(rows)), rows)
    keys = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + hashes[k:n - window + 1 + k]
    keys = mix(keys) + row[:len(keys)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    whole = np.flatnonzero(row[:len(keys)] == row[window - 1:])
    keys = keys[whole]
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = whole[twice]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return _per_row(np.cumsum(edge)[:n] > 0, first)


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per text; those of COUNTS and what the features need besides."""
    out = {name: _per_row(table[data], offsets) for name, table in _CLASSES.items()}
    starts, ends, first = word_ranges(data, offsets)
    out["n_words"] = np.diff(first)
    out["word_chars"] = out.pop("leads") - out.pop("spaces")
    out["n_symbols"] = out.pop("symbols")
    out["n_repeat_words"] = repeated_words(range_hashes(data, starts, ends), first)
    l_starts, l_ends, l_first = word_ranges(data, offsets, _NEWLINE)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACES[data], out=solid[1:])
    full = solid[l_ends] > solid[l_starts]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(l_first))[full]
    lines = range_hashes(data, l_starts, l_ends)[full]
    order = np.lexsort((lines, row))
    again = (lines[order][1:] == lines[order][:-1]) & (row[order][1:] == row[order][:-1])
    n = len(offsets) - 1
    out["lines"] = np.bincount(row, minlength=n)
    out["n_dup_lines"] = np.bincount(row[order][1:][again], minlength=n)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics as the forest sees them: one row per text.

    In steps: ordinary texts, which differ by less, then share leaves and have long paths. Repeated
    words are left to the base rule, which has a limit for them.
    """
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    raw = np.column_stack([
        s["n_symbols"] / words, s["n_dup_lines"] / np.maximum(s["lines"], 1),
        s["upper"] / chars, s["exclaims"] / words, s["word_chars"] / words])
    return np.rint(raw / STEPS)


# -- the forest --------------------------------------------------------------------------------------

def _mean_depth(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n values in a binary tree."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649) - 2 * (safe - 1) / safe,
                    np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    feature: np.ndarray  # per tree and node, -1 for leaves; children of i are 2i+1 and 2i+2
    split: np.ndarray
    path: np.ndarray
    size: int
    threshold: float = np.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[at]
                down = 2 * at + 1 + (x[rows, f] >= split[at])
                at = np.where(f >= 0, down, at)
            total += path[at]
        return 2.0 ** (-total / len(self.feature) / float(_mean_depth(self.size)))


def fit_forest(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE,
               seed: int = SEED, apart: bool = False) -> Forest:
    """`apart`: x is in random order and has rows of its own for each tree; else trees draw from x."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(x))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 ** (depth + 1) - 1
    forest = Forest(np.full((trees, nodes), -1), np.zeros((trees, nodes)),
                    np.zeros((trees, nodes)), max(size, 2))
    for t in range(trees):
        drawn = np.arange(t * size, (t + 1) * size) if apart else rng.choice(
            len(x), size, replace=False)
        todo = [(0, 0, drawn)]
        while todo:
            node, level, rows = todo.pop()
            low, high = x[rows].min(0), x[rows].max(0)
            wide = np.flatnonzero(high > low)
            if level == depth or len(rows) < 2 or not len(wide):
                forest.path[t, node] = level + float(_mean_depth(len(rows)))
                continue
            f = rng.choice(wide)
            cut = rng.uniform(low[f], high[f])
            right = x[rows, f] >= cut
            if right.all():
                cut = high[f]
                right = x[rows, f] >= cut
            forest.feature[t, node], forest.split[t, node] = f, cut
            todo += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return forest


def calibrate(scores: np.ndarray, good: np.ndarray, bad: np.ndarray | None = None) -> float:
    """The score above which documents are rejected: the one with the most right verdicts.

    good says which are good or, together with `bad`, how many good and bad ones have a score. Infinite unless both labels occur and rejecting beats keeping everything.
    """
    bad = ~good if bad is None else bad
    if not len(scores) or not bad.any() or not good.any():
        return float("inf")
    order = np.argsort(scores, kind="stable")
    s, g, b = scores[order], good[order], bad[order]
    right = np.where(np.append(s[1:] > s[:-1], True), np.cumsum(g) + b.sum() - np.cumsum(b), -1)
    best = len(s) - 1 - int(np.argmax(right[::-1]))
    if best == len(s) - 1:
        return float("inf")
    return float((s[best] + s[best + 1]) / 2)


# -- Spark -----------------------------------------------------------------------------------------

def _base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
                text: str = "text", trees: int = TREES, subsample: int = SUBSAMPLE) -> Forest | None:
    """Forest and threshold from all labelled documents that pass the base rules; None if none does.

    Texts give their statistics where they are; only these meet the labels. Trees together draw
    trees * subsample documents, those with the least hash, so no more come to the driver; for the
    threshold all labelled documents are scored, and counted per score, of which there are few as
    statistics are in steps.
    """
    ship(docs.sparkSession)
    known = (labels.where(F.col(id_column).isNotNull() & F.col("quality").isNotNull())
             .groupBy(F.col(id_column).alias("id")).agg(F.min("quality").alias("quality")))
    small = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = statistics(*text_buffer(batch.column("text")))
            ok = ~_base_failed(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").filter(pa.array(ok)),
                 pa.array(list(features(s)[ok]), pa.list_(pa.float64()))], ["id", "x"])

    x_type = T.StructField("x", T.ArrayType(T.DoubleType()))
    judged = save(small.mapInArrow(rows, T.StructType([small.schema["id"], x_type]))
                  .groupBy("id").agg(F.min("x").alias("x")).join(known, "id"))
    drawn = judged.orderBy(F.xxhash64("id"), "id").limit(trees * subsample)
    apart = judged.count() > trees * subsample
    got = (drawn if apart else drawn.orderBy("id")).select("x").toArrow()
    if not got.num_rows:
        return None
    forest = fit_forest(np.array(got["x"].to_pylist()), trees, subsample, apart=apart)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("x").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shared.value.scores(x)), batch.column("good")], ["score", "good"])

    counts = (judged.select("x", (F.col("quality") > 0).alias("good"))
              .mapInArrow(scored, "score double, good boolean").groupBy("score")
              .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
              .toArrow())
    forest.threshold = calibrate(*(np.array(counts[c]) for c in ("score", "good", "bad")))
    return forest


def score_quality(docs: DataFrame, forest: Forest | None, text: str = "text",
                  keep_text: bool = True) -> DataFrame:
    """Every row of docs with the counts, base_failed, anomaly (the score) and kept."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    kinds = {**{c: T.LongType() for c in COUNTS}, "base_failed": T.BooleanType(),
             "anomaly": T.DoubleType(), "kept": T.BooleanType()}
    passed = [c for c in docs.columns if keep_text or c != text]
    names = {c: free_name(docs.select(passed), c) for c in kinds}
    schema = T.StructType([docs.schema[c] for c in passed]
                          + [T.StructField(names[c], k) for c, k in kinds.items()])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text):
            s = statistics(*text_buffer(batch.column(batch.schema.get_field_index(text))))
            failed = _base_failed(s)
            score = model.scores(features(s)) if model else np.zeros(len(failed))
            limit = model.threshold if model else np.inf
            new = [*(pa.array(s[c].astype(np.int64)) for c in COUNTS), pa.array(failed),
                   pa.array(score), pa.array(~failed & (score <= limit))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in passed] + new,
                passed + list(names.values()))

    return docs.mapInArrow(rows, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
                  text: str = "text", keep_text: bool = True) -> DataFrame:
    forest = fit_quality(docs, labels, id_column, text)
    return score_quality(docs, forest, text, keep_text)
