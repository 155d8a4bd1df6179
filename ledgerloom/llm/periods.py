"""Periodic runs of words, by Baier grouping.

A run is a stretch of consecutive words with a smallest period q that no neighbouring word extends. By
the theorem on runs, every run holds a root that is the longest Lyndon word at its place under some order
of the words or under the reverse of that order. So the Lyndon arrays of both orders name all
candidates, and extending each of them as far as words q apart are equal gives all runs.

The arrays come straight from the first phase of Baier's suffix sorting. A document is a row of blocks, at
first one per word; blocks of equal words form a group, and groups stand in order. The greatest group is
taken: each of its blocks is the longest Lyndon word at its place. A maximal row of k such blocks is
hung onto the block before it; blocks of one group with the same k form a new group right above their
old one, more blocks above fewer. No suffix is ever compared, and every block is taken once.

Defined results: a null or empty text, or one of white space, has no words and no runs; repeated rows are
judged alike; columns pass through, a new column whose name is taken gets underscores before it.
Memory is in proportion to the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import free_name, ship, slices

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_RUN = pa.struct([pa.field(c, pa.int64()) for c in RUN.names])


def lyndon_array(symbols: list[int], kinds: int, reverse: bool = False) -> list[int]:
    """Length of the longest Lyndon word at each place; symbols are 0 .. kinds - 1, all present.

    reverse turns the order of symbols round; a proper prefix is less than the whole under both.
    """
    n = len(symbols)
    length = [1] * n
    before, after = list(range(-1, n)), list(range(1, n + 2))
    group = [*symbols, -1]                       # by the first word of a block; -1: taken, or the end
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, s in enumerate(symbols):
        members[s].append(i)
    alive = list(map(len, members))
    down, up = list(range(-1, kinds - 1)), list(range(1, kinds + 1))
    if reverse:
        down, up = up, down
        down[-1] = -1
    top = 0 if reverse else kinds - 1

    def raise_blocks(old: int, blocks: list[int]) -> None:
        """Move some blocks of a group to a new group right above it."""
        if len(blocks) == alive[old]:
            return                               # all of them: the group itself stands for the new one
        new, above = len(alive), up[old]
        alive[old] -= len(blocks)
        alive.append(len(blocks))
        members.append(blocks)
        for i in blocks:
            group[i] = new
        down.append(old)
        up.append(above)
        up[old] = down[above] = new

    while top >= 0:
        here = members[top]
        if len(here) == 1:
            i = here[0]
            if group[i] == top:
                u, end = before[i], after[i]
                length[i] = end - i
                before[end] = u
                if u >= 0:
                    after[u] = end
                    if alive[group[u]] > 1:
                        raise_blocks(group[u], [u])
        elif alive[top]:
            hung: dict[int, dict[int, list[int]]] = {}
            for i in here:
                if group[i] != top:
                    continue
                u = before[i]
                if u >= 0 and group[u] == top:
                    continue                     # its row is taken from the row's first block
                end, k = i, 0
                while group[end] == top:
                    nxt = after[end]
                    length[end] = nxt - end
                    group[end] = -1
                    end = nxt
                    k += 1
                before[end] = u
                if u >= 0:
                    after[u] = end
                    hung.setdefault(group[u], {}).setdefault(k, []).append(u)
            for old, by_count in hung.items():
                for k in sorted(by_count, reverse=True):
                    raise_blocks(old, by_count[k])
        top = down[top]
    return length


def agreement(words: np.ndarray, a: int, b: int) -> int:
    """How many words from a and b (a < b) on are equal."""
    n, limit, step = 0, len(words) - b, 16
    while n < limit:
        differ = np.flatnonzero(words[a + n:a + n + step][:limit - n] != words[b + n:b + n + step])
        if len(differ):
            return n + int(differ[0])
        n += step
        step *= 4
    return limit


def word_runs(symbols: list[int], kinds: int, min_length: int,
              min_periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of enough words and periods, by start, then period."""
    n = len(symbols)
    words = np.array(symbols, np.int64)
    back = words[::-1]
    place = np.arange(n)
    found: list[tuple[int, int, int]] = []
    roots = []
    for reverse in (False, True):
        period = np.array(lyndon_array(symbols, kinds, reverse), np.int64)
        # a run of that many periods has a root followed by min_periods - 2 equal periods and a word
        last = place + (min_periods - 1) * period
        at = place[last < n]
        q = period[at]
        at, q = (x[words[at] == words[at + q]] for x in (at, q))
        at, q = (x[words[at + (min_periods - 2) * q] == words[at + (min_periods - 1) * q]]
                 for x in (at, q))
        roots.append(np.stack([q, at]))
    q, at = np.concatenate(roots, axis=1)
    order = np.lexsort((at, q))
    last, end = 0, 0
    for p, i in zip(q[order].tolist(), at[order].tolist(), strict=True):
        if p == last and i + p <= end:
            continue                             # lies in the run found before
        right = i + p + agreement(words, i, i + p)
        start = i - agreement(back, n - i - p, n - i)
        if right - start >= max(min_length, min_periods * p):
            found.append((start, right - start, p))
            last, end = p, right
    return sorted(found, key=lambda r: (r[0], r[2]))


def judge(text: bytes, min_length: int, min_periods: int) -> tuple[bytes, list]:
    """The text without what repeats a run's first period, words joined by one space; and its runs."""
    words = text.split()                         # splits bytes at 0x20 and 0x09 to 0x0D
    if len(words) < min_length:
        return b" ".join(words), []
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return b" ".join(words), []
    runs = word_runs(list(map(number.__getitem__, words)), len(number), min_length, min_periods)
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        words = compress(words, keep.tolist())
    return b" ".join(words), runs


def collapse_runs(docs: DataFrame, text: str = "text", min_length: int = 24,
                  min_periods: int = 3) -> DataFrame:
    """docs without text but with `collapsed`, the words that stay joined by one space, and `runs`.

    runs are (start, length, period) in words from 0, of at least min_length words and min_periods
    periods (2 or more), by start, then period. Words after the first period of any run go.
    """
    if min_periods < 2 or min_length < 2:
        raise ValueError("runs have two periods at least")
    ship(docs.sparkSession)
    passed = [c for c in docs.columns if c != text]
    names = [free_name(docs.select(passed), c) for c in ("collapsed", "runs")]
    schema = T.StructType([docs.schema[c] for c in passed]
                          + [T.StructField(names[0], T.StringType()),
                             T.StructField(names[1], T.ArrayType(RUN))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
            texts, sizes, flat = [], [0], []
            for value in column:
                collapsed, runs = judge(value.as_py() or b"", min_length, min_periods)
                texts.append(collapsed)
                flat += runs
                sizes.append(len(flat))
            parts = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in passed]
                + [pa.array(texts, pa.binary()).cast(pa.string()),
                   pa.ListArray.from_arrays(pa.array(sizes, pa.int32()),
                                            pa.StructArray.from_arrays(parts, fields=list(_RUN)))],
                passed + names)

    return docs.mapInArrow(rows, schema)


# -- the registered query's rows ---------------------------------------------------------------------

def repeat_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs; in a tenth of them, by a checksum of the id, the words from some place on
    repeat the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    docs = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    a = F.pmod("g", n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod("g", F.lit(8))))).cast("int")
    docs = docs.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")),
                                    F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    repeated = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), n)
    return docs.select("doc_id", F.when(n > 0, F.array_join(repeated, " "))
                       .otherwise(F.col("text")).alias("text"))


def _before(a: Column, b: Column) -> Column:
    """-1 where run a has the greater exact exponent, or starts earlier, or has the shorter period."""
    left, right = a["length"] * b["period"], b["length"] * a["period"]
    first = (left > right) | ((left == right) & ((a["start"] < b["start"]) | (
        (a["start"] == b["start"]) & (a["period"] < b["period"]))))
    return F.when(first, -1).otherwise(1)


def run_report(docs: DataFrame, min_length: int = 24, min_periods: int = 3) -> DataFrame:
    """Per row of docs (doc_id, text): the number of runs, the one of greatest exponent, and digests of
    all runs and of the collapsed text."""
    judged = collapse_runs(docs.select("doc_id", "text"), "text", min_length, min_periods)
    judged = judged.withColumn("best", F.get(F.array_sort("runs", _before), F.lit(0)))
    line = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n")))
    best = F.col("best")
    return judged.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
