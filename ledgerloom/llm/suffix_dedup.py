"""Suffix-array dedup of bytes: a later document loses what an earlier one has.

Every byte inside a string of `window` bytes that also starts in a document with a smaller id goes.
Segments that may share strings meet in blocks (anchors.py); each block's suffixes are sorted by
mergesort with hash comparisons (suffix_sort.py), and neighbours that agree over the whole window,
verified byte by byte, are one string, whose least document id decides.

Defined results: a null or empty text has no bytes and stays as it is; a null id counts as smaller
than all others; rows with the same id don't affect each other; texts shorter than the window stay;
an empty table gives no rows. If bytes go from inside a character, what is left of it is removed
too when the result is asked for as text. Columns of documents pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.anchors import BUCKET_BYTES, CHUNK_BYTES, Block, Method, mark_repeats
from ledgerloom.llm.common import BYTE_VALUES
from ledgerloom.llm.suffix_sort import Suffixes, aligned_order, block_windows

WINDOW = 50
GRAM = 22


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_VALUES[data], offsets


def byte_content(values: np.ndarray) -> np.ndarray:
    return _BYTE_OF[np.searchsorted(_SORTED, values)]


_SORTED = np.sort(BYTE_VALUES)
_BYTE_OF = np.argsort(BYTE_VALUES).astype(np.uint8)


def judge_for(window: int):
    def judge(block: Block) -> np.ndarray:
        """The least document order among equal windows."""
        suffixes = Suffixes(block.symbols)
        out = np.zeros(int((block.size - window + 1).sum()), np.int64)
        for segment, start, number in block_windows(block, window):
            order, agree = aligned_order(suffixes, block, segment, start, window)
            new = np.flatnonzero(agree < window)
            least = np.minimum.reduceat(block.low[segment[order]], new)
            out[number[order]] = np.repeat(least, np.diff(np.append(new, len(order))))
        return out
    return judge


def method(window: int, gram: int) -> Method:
    return Method(window, gram, byte_symbols, "u1", True, judge_for(window), byte_content)


def runs_of(edges: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Maximal runs of marked symbols of a row, as [begin, end) in the row."""
    hit = np.concatenate([[0], (edges[begin:end] > 0).astype(np.int8), [0]])
    return np.flatnonzero(np.diff(hit)).reshape(-1, 2)


def _each_row(table: pa.Table, first: np.ndarray, edges: np.ndarray):
    """Per row its bytes and its runs."""
    covered = np.cumsum(edges)
    any_before = np.concatenate([[0], np.cumsum(covered[:-1] > 0)])
    for i, value in enumerate(table.column("text")):
        data = value.as_buffer().to_pybytes() if value.is_valid else b""
        if any_before[first[i + 1]] == any_before[first[i]]:
            yield data, np.zeros((0, 2), np.int64)
        else:
            yield data, runs_of(covered, first[i], first[i + 1])


def without(data: bytes, runs: np.ndarray) -> bytes:
    at, out = 0, []
    for begin, end in runs.tolist():
        out.append(data[at:begin])
        at = end
    return b"".join([*out, data[at:]])


def suffix_report(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                  window: int = WINDOW, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES,
                  bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    result = T.StructType([T.StructField(f.name, T.StringType() if f.name == "kept_sha256"
                                         else T.LongType()) for f in fields])

    def finish(table, values, first, edges) -> pa.Table:
        rows = []
        for data, runs in _each_row(table, first, edges):
            kept = without(data, runs)
            rows.append((len(data), len(data) - len(kept), len(runs),
                         hashlib.sha256(kept).hexdigest()))
        columns = [table.column("doc_id"), *(list(c) for c in zip(*rows, strict=True))]
        return pa.table([pa.array(c, f.type) if isinstance(c, list) else c
                         for c, f in zip(columns, fields, strict=True)], schema=fields)

    small = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
                        F.col(f"`{text}`").alias("text"))
    return mark_repeats(small, method(window, gram), finish, result,
                        chunk_bytes=chunk_bytes, bucket_bytes=bucket_bytes)


def remove_duplicate_bytes(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                           window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs without the duplicate strings; broken characters at their edges go as well."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text)
    inner = inner.withColumnsRenamed({f"c{at}": "text", f"c{names.index(id_column)}": "doc_id"})

    def finish(table, values, first, edges) -> pa.Table:
        kept = [without(data, runs).decode("utf-8", "ignore") if value.is_valid else None
                for value, (data, runs) in zip(table.column("text"), _each_row(table, first, edges),
                                               strict=True)]
        out = table.drop_columns(["chunk", "ord"])
        return out.set_column(out.column_names.index("text"), "text", pa.array(kept, pa.string()))

    out = mark_repeats(inner, method(window, gram), finish, inner.schema)
    return out.toDF(*names)
