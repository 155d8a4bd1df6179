"""Near-duplicates by SimHash fingerprints, with pigeonring filtering.

A fingerprint has a bit for each of 64 places, set where over half of the text's shingle hashes have it.
Fingerprints are linked at `most` or fewer differing bits. They are cut into segments on a ring. If two
differ in at most t bits over m segments, then from some segment on, every chain of l consecutive
segments differs in at most l * t / m bits. While that is below 1, segments are equal: so candidates
share a start and the longest chain that must be equal, and meet by its value. The chains after it
prune them before the full distance is taken.

Equal fingerprints are one element, however many documents have them. Elements of a meeting place are
compared in one task, at most NODE of them; only links that join them come out, fewer than elements.
In a place with more, the bits that the chain leaves open are cut into parts, of which all but t are
equal: elements meet again under each choice of t parts to be left out, which leaves so few open bits
that such a place cannot hold more than 2 ** OPEN different elements. Nothing is capped.

Defined results: a text without words has fingerprint zero and is linked like any other; fewer words than
a shingle make one shingle; null ids come first (component_id is null where only they are reachable);
repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import LOWER, save, ship, slices, text_buffer
from ledgerloom.llm.components import connected_components

BITS = 64
SEED = 42
SEGMENTS = 5
NODE = 2048
OPEN = 10
SALT = 32
LEAST = -(1 << 63)


# -- fingerprints ----------------------------------------------------------------------------------

def fingerprint(text: bytes, size: int) -> int:
    """Fingerprint of lower-cased text by its shingles of `size` words, repeats included."""
    words = text.split()                         # splits bytes at 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in
                  map(b" ".join, zip(*[words[k:] for k in range(size)]))], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


_PRINTS = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "f", "salt")])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, f, salt) of every row of docs (doc_id, text); f holds the 64 bits as a signed number.

    Rows alike in f are spread by their salt where they are grouped or joined.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_buffer(batch.column("text"))
            data = LOWER[data].tobytes()
            prints = np.array([fingerprint(data[a:b], size) for a, b in
                               zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints.view(np.int64)),
                 pa.array(np.arange(len(prints)) % SALT)], _PRINTS.names)
    return docs.mapInArrow(rows, _PRINTS)


# -- meeting places ----------------------------------------------------------------------------------

class Ring:
    """Segments of a fingerprint and the budgets of chains of them."""

    def __init__(self, most: int, segments: int = SEGMENTS):
        if not 0 <= most < segments <= BITS:
            raise ValueError("more segments than differing bits are needed")
        self.most, self.segments = most, segments
        edges = [BITS * k // segments for k in range(segments + 1)]
        self.masks = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:])]
        #: chains of so many segments have a budget below 1: they are equal
        self.equal = max(n for n in range(1, segments + 1) if n * most < segments)

    def chain(self, start: int, n: int) -> int:
        """Mask of n segments from start on."""
        return sum(self.masks[(start + k) % self.segments] for k in range(n))

    def budget(self, n: int) -> int:
        return n * self.most // self.segments

    def open_parts(self, start: int) -> list[int]:
        """Masks that cut the bits outside the equal chain, so that any `most` of them are few bits."""
        chain = self.chain(start, self.equal)
        bits = [b for b in range(BITS) if not chain >> b & 1]
        width = max(1, OPEN // max(1, self.most))
        return [sum(1 << b for b in bits[at:at + width]) for at in range(0, len(bits), width)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")


def meetings(elements: DataFrame, ring: Ring) -> DataFrame:
    """(place, start, f): every element at each chain that must be equal to those of its partners."""
    chains = F.array(*[F.struct(F.lit(s).alias("start"),
                                F.col("f").bitwiseAND(_signed(ring.chain(s, ring.equal))).alias("v"))
                       for s in range(ring.segments)])
    rows = elements.select("f", F.explode(chains).alias("c"))
    return rows.select(F.xxhash64("c.start", "c.v").alias("place"), "c.start", "f")


def sized(rows: DataFrame) -> DataFrame:
    """Rows of places that have several, with their number n. A place's rows are spread over SALT parts."""
    rows = save(rows.withColumn("salt", F.pmod(F.xxhash64("f"), F.lit(SALT))))
    parts = rows.groupBy("place", "salt").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("place").agg(F.sum("n").alias("n")).where("n > 1")
    return save(rows.join(parts.drop("n").join(sizes, "place"), ["place", "salt"])
                .select("place", "start", "f", "n"))


def branched(rows: DataFrame, ring: Ring) -> DataFrame:
    """Rows of large places, each under all choices of parts that may differ."""
    choices = []
    for start in range(ring.segments):
        parts = ring.open_parts(start)
        masks = [(1 << BITS) - 1 - sum(left) for left in combinations(parts, min(ring.most, len(parts)))]
        choices.append(F.array(*map(_signed, masks)))
    mask = F.element_at(F.array(*choices), F.col("start") + 1)
    rows = rows.select("start", "f", F.posexplode(mask).alias("choice", "mask"))
    return rows.select(F.xxhash64("start", "choice", F.col("f").bitwiseAND(F.col("mask"))).alias("place"),
                       "start", "f")


# -- comparing --------------------------------------------------------------------------------------

def joined(f: np.ndarray, start: int, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join the elements f of one place, pruned chain by chain."""
    n = len(f)
    root = np.arange(n)
    a_out, b_out = [], []
    step = max(1, (1 << 20) // n)
    checks = [(np.uint64(ring.chain(start, k)), ring.budget(k))
              for k in range(ring.equal, ring.segments + 1)]
    for at in range(0, n, step):
        part = f[at:at + step, None] ^ f[None, :]
        mask, budget = checks[1] if len(checks) > 1 else checks[0]
        a, b = np.nonzero(np.bitwise_count(part & mask) <= budget)
        a += at
        later = a < b
        a, b = a[later], b[later]
        for mask, budget in checks:
            near = np.bitwise_count((f[a] ^ f[b]) & mask) <= budget
            a, b = a[near], b[near]
        for x, y in zip(a.tolist(), b.tolist()):
            if root[x] != root[y]:
                a_out.append(x)
                b_out.append(y)
                root[root == root[y]] = root[x]
    return np.array(a_out, np.int64), np.array(b_out, np.int64)


def compared(rows: DataFrame, ring: Ring) -> DataFrame:
    """Links (a, b) found in the places of rows (place, start, f); places fit a task."""
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _then_none(batches):
            if batch is not None:
                columns = [np.asarray(batch.column(c)) for c in ("place", "start", "f")]
                rest = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns)]
            if rest is None or not len(rest[0]):
                continue
            place, start, f = rest
            edges = np.flatnonzero((place[1:] != place[:-1]) | (start[1:] != start[:-1])) + 1
            stops = [*edges.tolist(), len(place)]
            if batch is not None:
                stops.pop()                      # the last place may go on
            at, a, b = 0, [], []
            for stop in stops:
                if stop - at > 1:
                    here = f[at:stop].view(np.uint64)
                    x, y = joined(here, int(start[at]), ring)
                    a.append(here[x])
                    b.append(here[y])
                at = stop
            rest = [x[at:] for x in rest]
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])
    return (rows.repartition("place").sortWithinPartitions("place", "start").select("place", "start", "f")
            .mapInArrow(links, "a bigint, b bigint"))


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def similar_prints(elements: DataFrame, most: int, segments: int = SEGMENTS,
                   node: int = NODE) -> DataFrame:
    """Links (a, b) of distinct fingerprints f that join all that differ in at most `most` bits."""
    ring = Ring(most, segments)
    if not most:
        return elements.select(F.col("f").alias("a"), F.col("f").alias("b")).limit(0)
    rows = sized(meetings(elements, ring))
    links = compared(rows.where(F.col("n") <= node), ring)
    large = rows.where(F.col("n") > node)
    if large.isEmpty():
        return links
    return links.unionByName(compared(branched(large, ring), ring))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3,
                    most: int = 2, segments: int = SEGMENTS, node: int = NODE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the least id that can be reached over fingerprints of at most `most` differing bits.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    prints = save(fingerprints(docs, shingle))
    parts = save(prints.groupBy("f", "salt").agg(
        F.min(F.coalesce("doc_id", F.lit(LEAST))).alias("doc")))
    elements = save(parts.groupBy("f").agg(F.min("doc").alias("doc")))
    links = save(similar_prints(elements, most, segments, node).distinct())
    roots = connected_components(links)
    found = save(elements.join(roots.withColumnRenamed("node", "f"), "f", "left")
                 .select("f", "doc", F.coalesce("root", "f").alias("root")))
    first = found.groupBy("root").agg(F.min("doc").alias("first"))
    component = found.join(first, "root").select("f", "first")
    component = parts.select("f", "salt").join(component, "f")
    return prints.join(component, ["f", "salt"]).select(
        "doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        F.nullif("first", F.lit(LEAST)).alias("component_id"))
