"""Bring together the text segments that may hold equal windows, in blocks of bounded size.

A window is `window` consecutive symbols (bytes or words) of one document. Its anchor is the least of
its grams of `gram` symbols, by a hash, the leftmost if equal. Equal windows have equal anchors at
equal places, so all windows of the corpus that are equal to each other meet at their anchor. The
consecutive windows with the same anchor make a segment; it is known by the anchor's hash h and a hash
s of its content.

The documents are written once into a table bucketed by chunk (a few MB of consecutive rows), which
later steps join with what they learned without shuffling texts again:

1. each chunk lists its distinct (h, s), merged before the shuffle, dealt by hash of h into buckets;
2. a bucket finds the h that occur twice; where their segments differ, one chunk per distinct segment is
   asked for the content (equal segments are one text, however many there are);
3. a bucket's content is the block that the caller's method works on: it judges each window of each
   distinct segment against all others of the block;
4. verdicts go back to the chunks that have the segment, and each chunk marks its documents.

A passage that many documents share is one row per chunk and one text per bucket. Its distinct contexts meet
in one task, which takes their windows a few distances to the anchor at a time: time and memory of such a task
grow with the contexts, no faster. h and s are kept to 48 bits each: 96 bits tell segments apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import (
    BASE, BASE_INVERSE, free_name, input_bytes, mix, powers, save, ship, text_buffer)

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
PIECE = 1 << 20
PLACE_BITS = 22
ENTRY_WINDOWS = 1 << 21
MASK48 = np.uint64((1 << 48) - 1)
NO_ORDER = -(1 << 63)


class PrefixHashes:
    """Hash of any range of values from prefix sums of value * BASE**place, modulo 2**64."""

    _step = 1 << 12
    _low, _low_inverse = powers(BASE, _step), powers(BASE_INVERSE, _step)

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        high = powers(pow(BASE, self._step, 1 << 64), len(values) // self._step + 1)
        self.high_inverse = powers(pow(BASE_INVERSE, self._step, 1 << 64),
                                   len(values) // self._step + 1)
        for i, at in enumerate(range(0, len(values), self._step)):
            part = values[at:at + self._step]
            self.sums[at + 1:at + 1 + len(part)] = part * (self._low[:len(part)] * high[i])
        np.cumsum(self.sums, out=self.sums)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = (self._low_inverse[begin & (self._step - 1)]
                   * self.high_inverse[begin // self._step])
        return (self.sums[end] - self.sums[begin]) * inverse


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive values."""
    n, size = len(x) - width + 1, 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size:width - size + n])


@dataclass
class Segments:
    """Windows with starts begin to end (exclusive) of a row; anchor is the place of their gram."""

    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    anchor: np.ndarray
    h: np.ndarray
    s: np.ndarray


def segments(values: np.ndarray, first: np.ndarray, window: int, gram: int) -> Segments:
    """Segments of rows of symbols; row r has the symbols first[r] to first[r + 1]. Places are global."""
    parts: list[tuple] = []
    rows, step = len(first) - 1, PIECE
    r = 0
    while r < rows:
        last = max(r + 1, int(np.searchsorted(first, first[r] + step, side="right")) - 1)
        for at in range(int(first[r]), max(int(first[last]) - window + 1, int(first[r])),
                        step if last == r + 1 else 1 << 62):
            stop = min(int(first[last]), at + step + window - 1) if last == r + 1 else int(first[last])
            inner = np.clip(first[r:last + 1] - at, 0, stop - at)
            part = _segments(values[at:stop], inner, window, gram)
            parts.append((part[0] + r, part[1] + at, part[2] + at, part[3] + at, *part[4:]))
        r = last
    if not parts:
        empty = np.zeros(0, np.int64)
        return Segments(empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    return Segments(*[np.concatenate(p) for p in zip(*parts, strict=True)])


def _segments(values: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple:
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = PrefixHashes(values)
    grams = np.arange(n - gram + 1)
    order = mix(prefix.of(grams, grams + gram))
    bits = np.uint64((1 << PLACE_BITS) - 1)  # the same for all pieces, so that equals have one anchor
    key = (order & ~bits) | grams.astype(np.uint64)
    place = (sliding_min(key, window - gram + 1) & bits).astype(np.int64)
    inside = np.zeros(len(place) + 1, np.int64)
    low = first[:-1]
    high = np.maximum(first[1:] - window + 1, low)
    low, high = np.minimum(low, len(place)), np.minimum(high, len(place))
    np.add.at(inside, low, 1)
    np.add.at(inside, high, -1)
    inside = np.cumsum(inside)[:-1] > 0
    cut = np.ones(len(place), bool)
    cut[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    cut[low[low < len(place)]] = True
    begin = np.flatnonzero(cut & inside)
    ends = np.flatnonzero(np.append(cut, True) | np.append(~inside, True))
    end = ends[np.searchsorted(ends, begin, side="right")]
    anchor = place[begin]
    row = np.searchsorted(first, begin, side="right") - 1
    s = mix(prefix.of(begin, end + window - 1) + (anchor - begin).astype(np.uint64)
            * np.uint64(0x9E3779B97F4A7C15) + (end - begin).astype(np.uint64))
    return row, begin, end, anchor, mix(order[anchor]) & MASK48, s & MASK48


# -- packed columns ----------------------------------------------------------------------------------

def pack48(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack_near(x: np.ndarray) -> bytes:
    """Integers as offsets from the least, in as few bytes as hold them."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    kind = next(k for k in ("<u2", "<u4", "<u8") if high - low < 1 << 8 * int(k[2]))
    return low.to_bytes(8, "little", signed=True) + kind.encode() + (
        x.astype(np.uint64) - np.uint64(low & (2**64 - 1))).astype(kind).tobytes()


def unpack_near(data: bytes) -> np.ndarray:
    low = int.from_bytes(data[:8], "little", signed=True)
    offsets = np.frombuffer(data, data[8:11].decode(), offset=11).astype(np.uint64)
    return (offsets + np.uint64(low & (2**64 - 1))).astype(np.int64)


def binary_rows(schema: pa.Schema, columns: dict) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def spark_schema(schema: pa.Schema) -> T.StructType:
    kinds = {pa.int64(): T.LongType(), pa.int32(): T.IntegerType(), pa.binary(): T.BinaryType()}
    return T.StructType([T.StructField(f.name, kinds[f.type]) for f in schema])


LISTED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("h", pa.binary()),
                    ("s", pa.binary()), ("low", pa.binary()), ("many", pa.binary())])
SHARED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()),
                    ("h", pa.binary()), ("s", pa.binary()), ("low", pa.binary()),
                    ("many", pa.binary())])
CONTENT = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("s", pa.binary()),
                     ("sizes", pa.binary()), ("anchors", pa.binary()), ("symbols", pa.binary())])
VERDICT = pa.schema([("chunk", pa.int64()), ("h", pa.binary()), ("s", pa.binary()),
                     ("runs", pa.binary())])


@dataclass
class Block:
    """The distinct segments of a bucket whose h others have too; grouped by h, content in symbols."""

    group: np.ndarray      # number of h
    low: np.ndarray        # least document order that has the segment
    many: np.ndarray       # whether several documents (or places) have it
    begin: np.ndarray      # of the content in symbols
    size: np.ndarray
    anchor: np.ndarray     # place of the anchor in the content
    symbols: np.ndarray


@dataclass(frozen=True)
class Method:
    """What a caller looks for."""

    window: int
    gram: int
    #: bytes and offsets of texts -> symbols to hash (uint64) and per row its first symbol
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    kind: str              # numpy type of symbols in content
    #: whether equal windows of one document, and which document is first, matter
    ordered: bool
    #: Block -> per window of each segment, in order: least order of its equals (ordered), or whether
    #: the segment's window is elsewhere in the block (0 or 1)
    judge: Callable[[Block], np.ndarray]
    #: hashed symbols -> symbols as content
    content: Callable[[np.ndarray], np.ndarray]


def _split_by(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Equal values of an ascending array."""
    if len(bucket):
        edges = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(bucket)], strict=True):
            yield int(bucket[a]), slice(a, b)


def _chunk_segments(m: Method, table: pa.Table
                    ) -> tuple[Segments, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a chunk, its symbols, the order of its rows, and each row's first symbol."""
    values, first = m.symbols(*text_buffer(table.column("text")))
    found = segments(values, first, m.window, m.gram)
    return found, values, np.asarray(table.column("ord")), first


def list_segments(m: Method, buckets: int):
    def one(table: pa.Table) -> pa.Table:
        g, _, order, _ = _chunk_segments(m, table)
        chunk = table.column("chunk")[0].as_py()
        bucket = (g.h % np.uint64(buckets)).astype(np.int64)
        doc = order[g.row] if m.ordered else np.arange(len(g.row))
        by = np.lexsort((doc, g.s, g.h, bucket))
        h, s, doc, bucket = g.h[by], g.s[by], doc[by], bucket[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(h)) - 1 if len(h) else at
        many = (doc[last] > doc[at]).astype(np.uint8)
        low = doc[at] if m.ordered else np.zeros(len(at), np.int64)
        h, s, bucket = h[at], s[at], bucket[at]
        out = {f.name: [] for f in LISTED}
        for b, part in _split_by(bucket):
            row = (b, chunk, pack48(h[part]), pack48(s[part]), pack_near(low[part]),
                   np.packbits(many[part]).tobytes())
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return binary_rows(LISTED, out)
    return one


def _entries(table: pa.Table) -> tuple[np.ndarray, ...]:
    """chunk, h, s, low and many of all rows of a bucket."""
    if not table.num_rows:
        e = np.zeros(0, np.int64)
        return e, e.astype(np.uint64), e.astype(np.uint64), e, e.astype(np.uint8)
    columns = {c: table.column(c).to_pylist() for c in ("chunk", "h", "s", "low", "many")}
    sizes = [len(x) // 6 for x in columns["h"]]
    many = [np.unpackbits(np.frombuffer(x, np.uint8))[:n]
            for x, n in zip(columns["many"], sizes, strict=True)]
    return (np.repeat(np.array(columns["chunk"], np.int64), sizes),
            np.concatenate([unpack48(x) for x in columns["h"]]),
            np.concatenate([unpack48(x) for x in columns["s"]]),
            np.concatenate([unpack_near(x) for x in columns["low"]]), np.concatenate(many))


def share_segments(table: pa.Table) -> pa.Table:
    """Of a bucket: the listed segments whose h occurs twice, and who is to send the content."""
    chunk, h, s, low, many = _entries(table)
    by = np.lexsort((chunk, low, s, h))
    chunk, h, s, low, many = chunk[by], h[by], s[by], low[by], many[by]
    new_h = np.ones(len(h), bool)
    new_h[1:] = h[1:] != h[:-1]
    new_s = new_h.copy()
    new_s[1:] |= s[1:] != s[:-1]
    group = np.cumsum(new_h) - 1
    entries = np.bincount(group)
    often = np.bincount(group, many)
    distinct = np.bincount(group, new_s)
    shared = ((entries > 1) | (often > 0))[group] if len(h) else new_h
    asked = shared & new_s & (distinct > 1)[group] if len(h) else new_h
    out = {f.name: [] for f in SHARED}
    bucket = table.column("bucket")[0].as_py()
    for kind, wanted in ((0, shared), (1, asked)):
        index = np.flatnonzero(wanted)
        index = index[np.argsort(chunk[index], kind="stable")]
        for c, part in _split_by(chunk[index]):
            i = index[part]
            row = (bucket, c, kind, pack48(h[i]), pack48(s[i]), pack_near(low[i]),
                   np.packbits(many[i]).tobytes())
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
    return binary_rows(SHARED, out)


def _match(h: np.ndarray, s: np.ndarray, g: Segments) -> np.ndarray:
    """For each segment of g the index of its (h, s) among the given ones, or -1."""
    if not len(h):
        return np.full(len(g.h), -1)
    key = mix(h) + s
    by = np.argsort(key)
    at = np.minimum(np.searchsorted(key[by], mix(g.h) + g.s), len(h) - 1)
    found = by[at]
    return np.where((h[found] == g.h) & (s[found] == g.s), found, -1)


def send_content(m: Method):
    def one(table: pa.Table, asked: pa.Table) -> pa.Table:
        out = {f.name: [] for f in CONTENT}
        if table.num_rows and asked.num_rows:
            g, values, _, _ = _chunk_segments(m, table)
            width = np.dtype(m.kind).itemsize
            buckets, parts, kinds = (asked.column(c).to_pylist() for c in ("bucket", "h", "s"))
            # all buckets' segments are looked up at once: work doesn't grow with the number of buckets
            hs, ss = (np.concatenate([unpack48(x) for x in column]) for column in (parts, kinds))
            index = _match(hs, ss, g)
            found = np.full(len(hs), -1)
            hit = np.flatnonzero(index >= 0)
            found[index[hit]] = hit
            ends = np.cumsum([len(h) // 6 for h in parts])
            for bucket, h, s, stop in zip(buckets, parts, kinds, ends.tolist(), strict=True):
                places = found[stop - len(h) // 6:stop]
                begin, end = g.begin[places], g.end[places] + m.window - 1
                size = end - begin
                total = np.cumsum(size)
                where = np.arange(total[-1]) + np.repeat(begin - (total - size), size)
                blob = m.content(values[where]).astype(m.kind).tobytes()
                assert len(blob) == total[-1] * width
                row = (bucket, h, s, size.astype("<u2").tobytes(),
                       (g.anchor[places] - begin).astype("<u2").tobytes(), blob)
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
        return binary_rows(CONTENT, out)
    return one


def _join(parts: list[bytes], kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(p, kind) for p in parts]) if parts else np.zeros(0, kind)


def judge_block(m: Method):
    def one(shared: pa.Table, content: pa.Table) -> pa.Table:
        out = {f.name: [] for f in VERDICT}
        chunk, h, s, low, many = _entries(shared)
        if not len(h):
            return binary_rows(VERDICT, out)
        by = np.lexsort((low, s, h))
        chunk, h, s, low, many = chunk[by], h[by], s[by], low[by], many[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        segment = np.cumsum(new) - 1              # number of the distinct segment of an entry
        d_h, d_s, d_low = h[new], s[new], low[new]
        entries = np.bincount(segment)
        d_many = (entries > 1) | (np.bincount(segment, many) > 0)
        # segments without content are alone under their h: all their windows are like them
        c_h = np.concatenate([unpack48(x) for x in content.column("h").to_pylist()] or [h[:0]])
        c_s = np.concatenate([unpack48(x) for x in content.column("s").to_pylist()] or [h[:0]])
        size = _join(content.column("sizes").to_pylist(), "<u2").astype(np.int64)
        anchor = _join(content.column("anchors").to_pylist(), "<u2").astype(np.int64)
        symbols = _join(content.column("symbols").to_pylist(), m.kind)
        begin = np.cumsum(size) - size
        order = np.lexsort((c_s, c_h))
        c_h, c_s, size, anchor, begin = (x[order] for x in (c_h, c_s, size, anchor, begin))
        here = Segments(*[np.zeros(0, np.int64)] * 4, d_h, d_s)
        index = _match(c_h, c_s, here)             # content of a distinct segment, or -1
        of = np.full(len(c_h), -1)
        of[index[index >= 0]] = np.flatnonzero(index >= 0)
        group = np.cumsum(np.append(True, c_h[1:] != c_h[:-1])) - 1 if len(c_h) else c_h
        judged = (m.judge(Block(group, d_low[of], d_many[of], begin, size, anchor, symbols))
                  if len(c_h) else np.zeros(0, np.int64))
        windows = size - m.window + 1
        w_begin = np.cumsum(windows) - windows
        runs = _entry_runs(m, segment, low, many, d_low, d_many, index, judged, w_begin, windows)
        entry, start, length, mode = runs
        by = np.lexsort((entry, chunk[entry]))
        entry, start, length, mode = entry[by], start[by], length[by], mode[by]
        for c, part in _split_by(chunk[entry]):
            e = entry[part]
            triple = np.column_stack([start[part], length[part], mode[part]]).astype("<u2")
            row = (c, pack48(h[e]), pack48(s[e]), triple.tobytes())
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return binary_rows(VERDICT, out)
    return one


def _entry_runs(m, segment, low, many, d_low, d_many, index, judged, w_begin, windows):
    """Per entry the runs of windows that its chunk has to mark: entry, start, length, mode.

    Mode 1 marks all documents of the chunk that have the segment, mode 2 all but the first.
    Length 0 stands for the whole segment.
    """
    alone = index[segment] < 0
    if m.ordered:
        whole = np.where(d_low[segment] < low, 1, np.where(many > 0, 2, 0))
    else:
        whole = d_many[segment].astype(np.int64)
    e = np.flatnonzero(alone & (whole > 0))
    out = [(e, np.zeros_like(e), np.zeros_like(e), whole[e])]
    e = np.flatnonzero(~alone)
    ends = np.cumsum(windows[index[segment[e]]])
    # a few at a time: a segment that very many chunks have has as many entries
    cuts = np.flatnonzero(np.diff(ends // ENTRY_WINDOWS)) + 1
    for e in np.split(e, cuts) if len(e) else ():
        c = index[segment[e]]
        n = windows[c]
        owner = np.repeat(np.arange(len(e)), n)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        value = judged[w_begin[c][owner] + inner]
        if m.ordered:
            mode = np.where(value < low[e][owner], 1, np.where(many[e][owner] > 0, 2, 0))
        else:
            mode = ((value > 0) | d_many[segment[e]][owner]).astype(np.int64)
        cut = np.ones(len(owner), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (mode[1:] != mode[:-1])
        at = np.flatnonzero(cut)
        length = np.append(at[1:], len(owner)) - at
        keep = mode[at] > 0
        at, length = at[keep], length[keep]
        out.append((e[owner[at]], inner[at], length, mode[at]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def mark_documents(m: Method, finish: Callable):
    """finish(table, values, first, edges) -> rows; edges marks symbols: its running sum above 0."""
    def one(table: pa.Table, verdict: pa.Table) -> pa.Table:
        g, values, order, first = _chunk_segments(m, table)
        edges = np.zeros(len(values) + 1, np.int64)
        if verdict.num_rows:
            h = np.concatenate([unpack48(x) for x in verdict.column("h").to_pylist()])
            s = np.concatenate([unpack48(x) for x in verdict.column("s").to_pylist()])
            runs = _join(verdict.column("runs").to_pylist(), "<u2").reshape(-1, 3).astype(np.int64)
            by = np.lexsort((runs[:, 0], s, h))
            h, s, runs = h[by], s[by], runs[by]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
            at = np.flatnonzero(new)
            count = np.append(at[1:], len(h)) - at
            index = _match(h[at], s[at], g)
            mine = np.flatnonzero(index >= 0)
            n = count[index[mine]]
            owner = np.repeat(mine, n)
            run = runs[np.repeat(at[index[mine]], n) + np.arange(int(n.sum()))
                       - np.repeat(np.cumsum(n) - n, n)]
            low = np.full(len(at), np.iinfo(np.int64).max)
            np.minimum.at(low, index[mine], order[g.row[mine]])
            apply = (run[:, 2] == 1) | (order[g.row[owner]] > low[index[owner]])
            owner, run = owner[apply], run[apply]
            length = np.where(run[:, 1] == 0, g.end[owner] - g.begin[owner], run[:, 1])
            start = g.begin[owner] + run[:, 0]
            np.add.at(edges, start, 1)
            np.add.at(edges, start + length + m.window - 1, -1)
        return finish(table, values, first, edges)
    return one


def bucketed_chunks(docs: DataFrame, id_column: str, text: str, chunk_bytes: int,
                    buckets: int) -> tuple[DataFrame, str, str, str]:
    """docs with chunk, ord and text, written as a table bucketed by chunk; its name and new columns."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    at, order = free_name(docs, "chunk"), free_name(docs, "ord")
    prepared = docs.withColumn(order, F.coalesce(F.col(f"`{id_column}`").cast("bigint"),
                                                 F.lit(NO_ORDER)))
    schema = T.StructType([T.StructField(at, T.LongType()), *prepared.schema.fields])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
            sizes = np.array(pa.compute.binary_length(column).fill_null(0), np.int64) + 16
            ends = used + np.cumsum(sizes)
            used = int(ends[-1]) if len(ends) else used
            yield pa.RecordBatch.from_arrays(
                [pa.array(base + (ends - sizes) // chunk_bytes), *batch.columns], schema.names)

    name = f"corpus_{uuid.uuid4().hex}"
    (prepared.mapInArrow(number, schema).write.option("compression", "zstd")
     .bucketBy(buckets, at).saveAsTable(name))
    return spark.table(name), name, at, order


def mark_repeats(docs: DataFrame, m: Method, finish: Callable,
                 result: T.StructType, id_column: str = "doc_id", text: str = "text",
                 chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """finish's rows for every row of docs. Tables and columns beside text and id are passed to it."""
    spark = docs.sparkSession
    ship(spark)
    parts = max(spark.sparkContext.defaultParallelism, 12,
                -(-input_bytes(docs, text) // bucket_bytes))
    stored, name, at, order = bucketed_chunks(docs, id_column, text, chunk_bytes, parts)
    small = stored.select(F.col(at).alias("chunk"), F.col(order).alias("ord"),
                          F.col(f"`{text}`").alias("text"))
    listed = small.groupBy("chunk").applyInArrow(list_segments(m, parts), spark_schema(LISTED))
    shared = listed.groupBy("bucket").applyInArrow(share_segments, spark_schema(SHARED))
    shared_name = f"corpus_{uuid.uuid4().hex}"
    (shared.write.option("compression", "zstd").bucketBy(parts, "bucket").saveAsTable(shared_name))
    shared = spark.table(shared_name)
    asked = shared.where("kind = 1").select("chunk", "bucket", "h", "s")
    content = (small.groupBy("chunk").cogroup(asked.groupBy("chunk"))
               .applyInArrow(send_content(m), spark_schema(CONTENT)))
    verdict = (shared.where("kind = 0").groupBy("bucket").cogroup(content.groupBy("bucket"))
               .applyInArrow(judge_block(m), spark_schema(VERDICT)))
    whole = stored.withColumnsRenamed({at: "chunk", order: "ord", text: "text"}) \
        if (at, order, text) != ("chunk", "ord", "text") else stored
    out = save(whole.groupBy("chunk").cogroup(verdict.groupBy("chunk"))
               .applyInArrow(mark_documents(m, finish), result))
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"DROP TABLE {shared_name}")
    return out
