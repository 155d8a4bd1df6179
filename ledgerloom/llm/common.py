"""Helpers that the corpus operators share: tables in the shared folder, text as byte arrays, hashes.

Texts are handled as UTF-8 bytes in numpy arrays; a null text counts as empty. Hashes are the same in
every process, so that work lost with an executor gives equal values again.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 18


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    context = spark.sparkContext
    if getattr(context, "_corpus_package", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "corpus_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(path)
    context._corpus_package = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; where that is unset, under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/corpus_scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def save(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df clashes with it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def input_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts; sets numbers of partitions, never results."""
    return df.select(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0


# -- text as arrays ------------------------------------------------------------------------------

def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str,
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of about limit bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = np.array(pa.compute.binary_length(column).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


# -- hashes ----------------------------------------------------------------------------------------

SHORT = 64
_SEED = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_rng = np.random.Generator(np.random.PCG64(0x5EED))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1 << 40, 1 << 62)) * 8 + 3
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base & (2**64 - 1)), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range.

    Eight bytes after the other are mixed in, so ranges of equal length that differ within eight bytes
    never have one hash, and no pattern of letters makes others collide. Ranges over SHORT bytes have
    a digest's first 64 bits.
    """
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) + _SEED)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))    # the eight bytes from each place
    rest = np.flatnonzero((sizes > 0) & (sizes <= SHORT))
    at = starts[rest]
    while len(rest):
        left = ends[rest] - at
        out[rest] = mix(out[rest] ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
        go_on = left > 8
        rest, at = rest[go_on], at[go_on] + 8
    for i in np.flatnonzero(sizes > SHORT).tolist():
        digest = hashlib.blake2b(data[starts[i]:ends[i]].data, digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_ranges(data: np.ndarray, offsets: np.ndarray,
                gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per row the index of its first word (one more at the end).

    gaps says of each byte value whether it separates words; a word never crosses rows.
    """
    inside = ~gaps[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside
    closes[:-1] &= ~inside[1:] if len(inside) > 1 else True
    return _cut_at_rows(data, offsets, gaps, opens, closes)


def _cut_at_rows(data, offsets, gaps, opens, closes):
    """Rows that touch (no gap byte between them) still end and begin words."""
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    if len(inner):
        word = ~gaps[data[inner]]
        opens[inner[word]] = True
        word = ~gaps[data[inner - 1]]
        closes[inner[word] - 1] = True
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)
