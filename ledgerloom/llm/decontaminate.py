"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. The automaton holds
every word sequence of the items; a document streams through it once, and at each word the length
of the longest match that ends there is known. Words inside a match of `window` words (or inside a
whole item that is shorter) are hit.

The items are the stated query set. They are cut into pieces that overlap by window - 1 words, so
that no window is lost, and dealt by hash over blocks of about `block_words` words. Each block has
an automaton of its own; a pass over the documents takes up to BLOCKS_PER_PASS of them, which bounds
what is broadcast and what a task holds. Documents are never shuffled.

Defined results: a null or empty text has no words; an item without words has no window; a null
item_id counts as one more id, shown as the empty string; repeated items count once; without items
nothing is hit. Every row of documents gives one row, repeated ones too. Columns of documents pass
through; a new column whose name is taken gets underscores before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import LOWER, free_name, save, ship, slices, text_buffer

WINDOW = 10
BLOCK_WORDS = 100_000
PIECE_WORDS = 4_096
BLOCKS_PER_PASS = 4


def _word_table() -> bytes:
    """Translation that lower-cases A-Z and turns every other ASCII separator into a space."""
    table = LOWER.copy()
    for b in range(128):
        if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122):
            table[b] = 32
    return table.tobytes()


WORDS = _word_table()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers."""

    words: dict[bytes, int]
    step: dict[int, int]        # state * len(words) + word -> state
    link: list[int]
    length: list[int]
    windows: dict[int, list[str]]  # state of a window -> items that have it
    window_state: list[int]     # the window that a match of the state ends with, or -1
    short_state: list[list[int]]  # whole short items that a match of the state ends with
    shortest: int               # words of the shortest window


def build_automaton(pieces: list[tuple[str, bool, list[bytes]]], window: int) -> Automaton:
    """pieces: item, whether the piece is a whole item shorter than window, and its words."""
    words: dict[bytes, int] = {}
    for _, _, piece in pieces:
        for w in piece:
            words.setdefault(w, len(words))
    n = len(words)
    step, link, length, out = {}, [-1], [0], [[]]

    def state(size: int) -> int:
        link.append(-1)
        length.append(size)
        out.append([])
        return len(link) - 1

    def clone(p: int, q: int, word: int) -> int:
        copy = state(length[p] + 1)
        out[copy] = list(out[q])
        for w in out[q]:
            step[copy * n + w] = step[q * n + w]
        link[copy], link[q] = link[q], copy
        while p >= 0 and step.get(p * n + word) == q:
            step[p * n + word] = copy
            p = link[p]
        return copy

    def extend(last: int, word: int) -> int:
        q = step.get(last * n + word)
        if q is not None:
            return q if length[q] == length[last] + 1 else clone(last, q, word)
        new, p = state(length[last] + 1), last
        while p >= 0 and p * n + word not in step:
            step[p * n + word] = new
            out[p].append(word)
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = step[p * n + word]
            link[new] = q if length[q] == length[p] + 1 else clone(p, q, word)
        return new

    ends = []
    for _, _, piece in pieces:
        last = 0
        for w in piece:
            last = extend(last, words[w])
        ends.append(last)

    def window_of(s: int, size: int) -> int:
        """The state of the last `size` words of a match that ends in s."""
        while s > 0 and length[link[s]] >= size:
            s = link[s]
        return s if s > 0 and length[s] >= size else -1

    windows: dict[int, set[str]] = {}
    short: dict[int, set[str]] = {}
    for (item, whole, piece), end in zip(pieces, ends, strict=True):
        if whole:
            short.setdefault(end, set()).add(item)
            continue
        s = 0
        for i, w in enumerate(piece):
            s = step[s * n + words[w]]
            if i + 1 >= window:
                windows.setdefault(window_of(s, window), set()).add(item)
    order = sorted(range(len(link)), key=length.__getitem__)
    chains: list[list[int]] = [[] for _ in link]
    for s in order[1:]:
        chains[s] = chains[link[s]] + [s] if s in short else chains[link[s]]
    found = {s: sorted(items) for s, items in (windows | short).items()}
    return Automaton(
        words, step, link, length, found, [window_of(s, window) for s in range(len(link))], chains,
        min([window] + [length[s] for s in short]))


def scan(a: Automaton, words: list[bytes], window: int,
         edges: list[tuple[int, int]], items: set[str]) -> None:
    """Add the hits of one document: windows as [begin, end) in words, and the items."""
    n = len(a.words)
    ids = np.fromiter((a.words.get(w, -1) for w in words), np.int64, len(words))
    known = np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])
    turn = np.flatnonzero(np.diff(known))
    runs = turn.reshape(-1, 2)
    # an unknown word puts the automaton back to its start; runs below the shortest window can't hit
    step, link, length = a.step, a.link, a.length
    for begin, stop in runs[runs[:, 1] - runs[:, 0] >= a.shortest].tolist():
        s = size = 0
        for at, word in enumerate(ids[begin:stop].tolist(), begin + 1):
            t = step.get(s * n + word)
            while t is None and s > 0:
                s = link[s]
                size = length[s]
                t = step.get(s * n + word)
            if t is None:
                continue
            s, size = t, size + 1
            if size >= window:
                edges.append((at - window, at))
                items.update(a.windows[a.window_state[s]])
            for c in a.short_state[s]:
                if length[c] <= size:
                    edges.append((at - length[c], at))
                    items.update(a.windows[c])


def automaton_blocks(benchmark: DataFrame, item_id: str, text: str, window: int,
                     block_words: int) -> Iterator[Automaton]:
    """One automaton after the other; each block comes to the driver alone."""
    lower = F.regexp_replace(
        F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    items = (benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
                              F.filter(F.split(lower, " "), lambda w: w != "").alias("words"))
             .where(F.size("words") > 0))
    stride = PIECE_WORDS
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window), F.lit(stride))
    pieces = (items.withColumn("start", F.explode(starts))
              .select("item", (F.size("words") < window).alias("whole"),
                      F.slice("words", F.col("start") + 1, F.lit(stride + window - 1)).alias("words"))
              .distinct())
    total = pieces.select(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // block_words)
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(max(blocks, 1))))
    for block in range(blocks):
        rows = pieces.where(F.col("block") == block).select("item", "whole", "words").collect()
        if rows:
            yield build_automaton(sorted((r[0], r[1], [w.encode() for w in r[2]]) for r in rows),
                                  window)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                    block_words: int = BLOCK_WORDS, keep_text: bool = True) -> DataFrame:
    """Each row of docs with n_words, n_hit, item_ids (sorted) and hit_words, [begin, end) in words."""
    if window < 1 or window > PIECE_WORDS:
        raise ValueError("window out of range")
    ship(docs.sparkSession)
    passed = [c for c in docs.columns if keep_text or c != text]
    names = [free_name(docs, c) for c in ("n_words", "n_hit", "item_ids", "hit_words")]
    todo, out = [], None
    for automaton in automaton_blocks(benchmark, item_id, item_text, window, block_words):
        if len(todo) == BLOCKS_PER_PASS:
            out = save(_match(docs if out is None else out, out is None, todo, text, window, names))
            todo = []
        todo.append(automaton)
    out = _match(docs if out is None else out, out is None, todo, text, window, names)
    return out.select(*[F.col(f"`{c}`") for c in passed + names])


def _match(docs: DataFrame, first: bool, automata: list[Automaton], text: str, window: int,
           names: list[str]) -> DataFrame:
    """One pass over all documents; a later pass adds to what the earlier ones found."""
    shared = docs.sparkSession.sparkContext.broadcast(automata)
    kinds = [T.LongType(), T.LongType(), T.ArrayType(T.StringType()),
             T.ArrayType(T.ArrayType(T.LongType()))]
    passed = docs.columns if first else docs.columns[:-len(names)]
    schema = T.StructType([docs.schema[c] for c in passed]
                          + [T.StructField(c, k) for c, k in zip(names, kinds, strict=True)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            n = batch.num_rows
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
            items: list[set[str]] = [set() for _ in range(n)]
            spans: list[list[list[int]]] = [[] for _ in range(n)]
            if not first:
                items = [set(x) for x in batch.column(batch.num_columns - 2).to_pylist()]
                spans = batch.column(batch.num_columns - 1).to_pylist()
            counts, hits = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i in range(n):
                words = words_of(data[offsets[i]:offsets[i + 1]].tobytes())
                edges: list[tuple[int, int]] = []
                for a in shared.value:
                    scan(a, words, window, edges, items[i])
                if edges:
                    spans[i] = merged(edges + spans[i])
                counts[i], hits[i] = len(words), sum(e - b for b, e in spans[i])
            new = [pa.array(counts), pa.array(hits),
                   pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                   pa.array(spans, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(batch.columns[:len(passed)] + new, passed + names)

    return docs.mapInArrow(rows, schema)


def merged(spans: list) -> list[list[int]]:
    """Disjoint ascending spans that cover the same positions."""
    out: list[list[int]] = []
    for begin, end in sorted(map(tuple, spans)):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                     window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """Documents without the matched spans; those of which more than max_coverage is hit go whole.

    A span reaches from its first word to the end of its last; the separators after it go as well.
    Documents without a hit stay as they are, byte by byte.
    """
    found = match_benchmark(docs, benchmark, text, window=window)
    n_words, n_hit, _, spans = found.columns[-4:]
    kept = found.where(F.col(n_hit) <= F.col(n_words) * F.lit(max_coverage))
    at = kept.columns.index(spans)
    schema = docs.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = schema.names.index(text)
        for batch in slices(batches, text):
            columns = list(batch.columns[:len(schema)])
            hit = np.flatnonzero(np.array(pa.compute.list_value_length(batch.column(at))) > 0)
            if len(hit):
                values = columns[where].to_pylist()
                for i in hit.tolist():
                    values[i] = without_words(values[i], batch.column(at)[i].as_py())
                columns[where] = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(rows, schema)


def without_words(text: str, spans: list[list[int]]) -> str:
    """The text without the given spans of words."""
    data = text.encode()
    places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(WORDS))]
    out, at = [], 0
    for begin, end in spans:
        out.append(data[at:places[begin][0]])
        at = places[end][0] if end < len(places) else len(data)
    return b"".join([*out, data[at:]]).decode()


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    small = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    found = match_benchmark(small, benchmark, keep_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
