"""Substring dedup of words by relative Lempel-Ziv parsing.

Every word inside `window` consecutive words that also start anywhere else in the corpus goes, all
occurrences alike. Segments that may share words meet in blocks (anchors.py). A block is a reference:
its suffixes are indexed, and each of its segments is factored greedily against it, the longest match with
another place first. A factor of at least `window` words is a duplicate span. Parsing goes on at the
first window that the factor doesn't hold whole, so windows across a factor's end are looked up as well.

Defined results: a null or empty text has no words; texts shorter than the window stay; words are
compared by 64-bit hashes and their lengths; repeated rows lose their words like other copies; an
empty table gives no rows. Columns of documents pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.anchors import BUCKET_BYTES, CHUNK_BYTES, Block, Method, mark_repeats
from ledgerloom.llm.common import range_hashes, text_buffer, word_ranges
from ledgerloom.llm.suffix_dedup import runs_of
from ledgerloom.llm.suffix_sort import Suffixes, aligned_order, block_windows

WINDOW = 35
GRAM = 6


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_ranges(data, offsets)
    return range_hashes(data, starts, ends), first


def longest_matches(block: Block, window: int) -> np.ndarray:
    """For each window of the block, how many words from there on match another place of the block."""
    suffixes = Suffixes(block.symbols)
    out = np.zeros(int((block.size - window + 1).sum()), np.int64)
    for segment, start, number in block_windows(block, window):
        order, agree = aligned_order(suffixes, block, segment, start, None)
        out[number[order]] = np.maximum(agree, np.append(agree[1:], 0))
    return out


def factor(longest: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Greedy factors of every segment, all segments side by side; 1 for windows inside long factors."""
    base = np.cumsum(count) - count
    edges = np.zeros(len(longest) + 1, np.int64)
    at, todo = np.zeros(len(count), np.int64), np.arange(len(count))
    while len(todo):
        here = base[todo] + at[todo]
        held = longest[here] - window + 1          # windows that the factor holds whole
        long = held > 0
        held = np.minimum(held, count[todo] - at[todo])
        np.add.at(edges, here[long], 1)
        np.add.at(edges, here[long] + held[long], -1)
        at[todo] += np.maximum(held, 1)
        todo = todo[at[todo] < count[todo]]
    return (np.cumsum(edges)[:-1] > 0).astype(np.int64)


def judge_for(window: int):
    def judge(block: Block) -> np.ndarray:
        return factor(longest_matches(block, window), block.size - window + 1, window)
    return judge


def method(window: int, gram: int) -> Method:
    return Method(window, gram, word_symbols, "<u8", False, judge_for(window), lambda v: v)


def rlz_report(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
               window: int = WINDOW, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES,
               bucket_bytes: int = BUCKET_BYTES, keep_spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; on demand spans, [begin, end) in words."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_sha256", pa.string())]
                       + [("spans", pa.list_(pa.list_(pa.int64())))] * keep_spans)
    result = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_sha256", T.StringType())]
                          + [T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))] * keep_spans)

    def finish(table, values, first, edges) -> pa.Table:
        covered, rows = np.cumsum(edges), []
        data, offsets = text_buffer(table.column("text"))
        for i in range(table.num_rows):
            words = data[offsets[i]:offsets[i + 1]].tobytes().split()
            runs = runs_of(covered, first[i], first[i + 1])
            n = len(words)
            for begin, end in runs[::-1].tolist():
                del words[begin:end]
            rows.append([n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()]
                        + [runs.tolist()] * keep_spans)
        columns = [table.column("doc_id"), *(list(c) for c in zip(*rows, strict=True))]
        return pa.table([pa.array(c, f.type) if isinstance(c, list) else c
                         for c, f in zip(columns, fields, strict=True)], schema=fields)

    small = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
                        F.col(f"`{text}`").alias("text"))
    return mark_repeats(small, method(window, gram), finish, result,
                        chunk_bytes=chunk_bytes, bucket_bytes=bucket_bytes)
