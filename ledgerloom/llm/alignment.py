"""Alignment of two tokenizations of the same texts, by merge-path partitioning.

A reads a space and the text with a byte-level BPE, B the text with a sentence piece model, which adds that
space itself. Both cut the same bytes, so tokens are known by where they end. Merging the ends of A and B
in order visits every stretch between neighbouring ends once, and such a stretch lies in one token of
each: it is their link. Where both end, a group of tokens is complete.

The merge of all ends of a batch is cut into independent pieces of equal work: a binary search along each
diagonal of the merge finds how many ends of A and of B come before it. All pieces are then merged side by
side and emit their links; a pair of equal ends that a diagonal would part stays with the piece before, and
groups are numbered over the pieces, which stitches those that pieces share.

How many documents hold a pair of ids linked is counted over the corpus. Documents are kept in chunks that
list their pairs once, and only a chunk's list meets the counts, so what is shuffled does not grow with
the tokens. No chunk, pair or document is collected.

Defined results: a null or empty text, or one whose tokens do not spell a space and the text in both, has no
tokens; strings of special tokens are plain text; repeated rows are documents of their own; an empty
table gives no rows. Memory is in proportion to a chunk, CHUNK bytes of text or one longer text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ledgerloom.llm.bpe import SPLIT, byte_characters
from ledgerloom.llm.common import save, ship, slices, text_buffer
from ledgerloom.llm.minhash import bucketed

CHUNK = 4 << 20
PIECE = 64
SPACE = "▁"
LONG_SPACE = 10_000
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_SPACE)


# -- tokenizers ----------------------------------------------------------------------------------------

class Vocabulary:
    """The bytes of every id."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.zeros(0, np.uint8)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.begins[ids] - (ends - sizes), sizes)]


class ByteLevel(Vocabulary):
    """A byte-level BPE from its tokenizer file; ids of merged tokens follow the order of merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte_of = spec["model"]["vocab"], byte_characters()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))]
                  for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids of this tokenizer don't follow its merges")
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        super().__init__(tokens)
        self.encoding = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self._encode(" " + t), np.int64) for t in texts]

    def _encode(self, text: str) -> list[int]:
        # the fast library's matcher can't hold a very long row of white space
        if len(text) > LONG_SPACE and _LONG_SPACE.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.encoding.encode_ordinary(text)


class Pieces(Vocabulary):
    """A sentence piece model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        super().__init__([bytes([int(p[1:-1], 16)]) if self.model.is_byte(i)
                          else p.replace(SPACE, " ").encode()
                          for i, p in enumerate(map(self.model.id_to_piece, range(n)))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


# -- merging ends ---------------------------------------------------------------------------------------

def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of a and of b come before each cut of the merge, 0 and all of them included."""
    total = len(a) + len(b)
    cut = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(cut - len(b), 0), np.minimum(cut, len(a))
    while (low < high).any():
        middle = (low + high) >> 1
        go_on = low < high
        # of equal ends that of a comes first: as long as it is not greater, more of a is before the cut
        more = go_on & (a[np.minimum(middle, len(a) - 1)] <= b[np.minimum(cut - middle - 1, len(b) - 1)])
        low, high = np.where(more, middle + 1, low), np.where(go_on & ~more, middle, high)
    i, j = low, cut - low
    parted = (i > 0) & (j < len(b))
    parted[parted] = a[i[parted] - 1] == b[j[parted]]
    return i, j + parted


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (i of a, j of b) of every link in order, and whether both end with it.

    a and b are ascending ends whose last ones are equal.
    """
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    i, j = diagonals(a, b, piece)
    i, j, stop_i, stop_j = i[:-1].copy(), j[:-1].copy(), i[1:], j[1:]
    rows = len(i)
    links = np.zeros((3, rows, int((stop_i - i + stop_j - j).max())), np.int64)
    emitted = np.zeros(rows, np.int64)
    live = np.arange(rows)
    for step in range(links.shape[2]):
        going = (i[live] < stop_i[live]) | (j[live] < stop_j[live])
        if not going.all():
            live = live[going]
        if not len(live):
            break
        x, y = i[live], j[live]
        p, q = a[np.minimum(x, len(a) - 1)], b[np.minimum(y, len(b) - 1)]
        links[0, live, step], links[1, live, step], links[2, live, step] = x, y, p == q
        emitted[live] += 1
        i[live] = x + (p <= q)
        j[live] = y + (q <= p)
    filled = np.arange(links.shape[2])[None, :] < emitted[:, None]
    return links[0][filled], links[1][filled], links[2][filled] > 0


# -- one chunk ------------------------------------------------------------------------------------------

def _decimals(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 .. top, left-aligned, and their number."""
    texts = [str(i).encode() for i in range(top)]
    width = max(map(len, texts))
    return (np.frombuffer(b"".join(t.ljust(width) for t in texts), np.uint8).reshape(top, width),
            np.array([len(t) for t in texts]))


@lru_cache(maxsize=2)
def decimals(top: int) -> tuple[np.ndarray, np.ndarray]:
    return _decimals(top)


def group_texts(ids_a, ids_b, group_a, group_b, docs_a, docs_b) -> list[bytes]:
    """Per document its groups as decimal ids: those of A by commas, a bar, those of B; by semicolons.

    group_a and group_b number the groups over all documents, docs_a and docs_b say where each
    document's tokens begin (one more at the end).
    """
    n = len(ids_a) + len(ids_b)
    if not n:
        return [b""] * (len(docs_a) - 1)
    # tokens in order of group, then A before B
    before_b = np.searchsorted(group_b, np.arange(group_a[-1] + 1))
    upto_a = np.searchsorted(group_a, np.arange(group_a[-1] + 1), side="right")
    at_a = np.arange(len(ids_a)) + before_b[group_a]
    at_b = np.arange(len(ids_b)) + upto_a[group_b]
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[at_a], ids[at_b] = ids_a, ids_b
    mark[at_a[np.append(group_a[1:] != group_a[:-1], True)]] = ord("|")
    mark[at_b[np.append(group_b[1:] != group_b[:-1], True)]] = ord(";")
    digits, lengths = decimals(int(ids.max()) + 1)
    ends = np.cumsum(lengths[ids] + 1)
    begins = ends - lengths[ids] - 1
    out = np.empty(int(ends[-1]), np.uint8)
    for k in range(digits.shape[1]):
        has = lengths[ids] > k
        out[begins[has] + k] = digits[ids[has], k]
    out[ends - 1] = mark
    edges = np.append(0, ends)[docs_a + docs_b].tolist()
    flat = out.tobytes()
    return [flat[a:max(a, b - 1)] for a, b in zip(edges[:-1], edges[1:])]


def encoded(texts: list[str], vocabulary, step: int = 1 << 18) -> list[np.ndarray]:
    out, part, size = [], [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= step:
            out += vocabulary.encode(part)
            part, size = [], 0
    return out + (vocabulary.encode(part) if part else [])


def align(texts: list[str], a: ByteLevel, b: Pieces) -> dict:
    """Tokens, groups and links of the texts (none of them empty), document after document.

    The tokens of a text that both don't spell alike are left out.
    """
    tokens = []
    for text, x, y in zip(texts, encoded(texts, a), encoded(texts, b), strict=True):
        whole = np.frombuffer(b" " + text.encode(), np.uint8)
        same = all(np.array_equal(v.spell(ids), whole) for v, ids in ((a, x), (b, y)))
        tokens.append((x, y) if same else (x[:0], y[:0]))
    docs_a, docs_b = (np.append(0, np.cumsum([len(t[k]) for t in tokens])).astype(np.int64)
                      for k in range(2))
    ids_a, ids_b = (np.concatenate([t[k] for t in tokens] or [np.zeros(0, np.int64)]) for k in range(2))
    # ends in the bytes of all texts: both last ends of a document are equal, so no group crosses them
    i, j, both = overlaps(np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b]))
    group = np.cumsum(both) - both
    group_a, group_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    group_a[i], group_b[j] = group, group        # a token's last link decides, all are of one group
    doc = np.searchsorted(docs_a, i, side="right") - 1
    n = len(texts)
    return {"n_a": np.diff(docs_a), "n_b": np.diff(docs_b),
            "n_groups": np.bincount(doc[both], minlength=n), "n_links": np.bincount(doc, minlength=n),
            "groups": group_texts(ids_a, ids_b, group_a, group_b, docs_a, docs_b),
            "doc": doc, "a": ids_a[i], "b": ids_b[j]}


# -- the corpus ------------------------------------------------------------------------------------------

_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_ALIGNED = T.StructType(
    [T.StructField("chunk", T.LongType()), T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in _COUNTS]
    + [T.StructField("groups_sha256", T.StringType()),
       # of the chunk's first row: its distinct pairs, and how many of its documents have each
       T.StructField("pairs", T.ArrayType(T.LongType())),
       T.StructField("documents", T.ArrayType(T.IntegerType())),
       # of each row: places of its pairs in that list, and how often they are linked
       T.StructField("places", T.ArrayType(T.IntegerType())),
       T.StructField("times", T.ArrayType(T.IntegerType()))])


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()),
                                    pa.array(values, kind))


def aligned_chunks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """One row per row of docs (doc_id, text); rows of a chunk share their list of pairs."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokenizers(a, b)
        top = len(second.sizes)
        chunk = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", CHUNK):
            chunk += 1
            n = batch.num_rows
            texts = batch.column("text").to_pylist()
            place = np.array([k for k, t in enumerate(texts) if t], np.int64)
            found = align([t for t in texts if t], first, second)
            counts = {c: np.zeros(n, np.int64) for c in _COUNTS}
            digests = [""] * n
            for c in _COUNTS:
                counts[c][place] = found[c]
            for k, groups in zip(place.tolist(), found["groups"], strict=True):
                digests[k] = hashlib.sha256(groups).hexdigest() if groups else ""
            pairs, where = np.unique(found["a"] * top + found["b"], return_inverse=True)
            key, times = np.unique(place[found["doc"]] * max(1, len(pairs)) + where, return_counts=True)
            doc, where = np.divmod(key, max(1, len(pairs)))
            lead = np.zeros(n, np.int64)
            lead[0] = len(pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, chunk)), batch.column("doc_id")]
                + [pa.array(counts[c]) for c in _COUNTS] + [pa.array(digests, pa.string())]
                + [_lists(pairs, lead, pa.int64()),
                   _lists(np.bincount(where, minlength=len(pairs)), lead, pa.int32()),
                   _lists(where, np.bincount(doc, minlength=n), pa.int32()),
                   _lists(times, np.bincount(doc, minlength=n), pa.int32())],
                _ALIGNED.names)
    return docs.mapInArrow(rows, _ALIGNED)


_JUDGED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", *_COUNTS, "n_best", "count_sum")]
    + [T.StructField("groups_sha256", T.StringType())])


def _judge(key, rows: pa.Table, counts: pa.Table) -> pa.Table:
    """Rows of a chunk with what the corpus says of their pairs."""
    top = counts.num_rows
    count, best = np.zeros(max(1, top), np.int64), np.zeros(max(1, top), np.int64)
    at = np.asarray(counts.column("place"))
    count[at] = np.asarray(counts.column("count"))
    best[at] = np.asarray(counts.column("best").cast(pa.int64()))
    lists = rows.column("places").combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(lists))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    where = np.asarray(lists.flatten())
    times = np.asarray(rows.column("times").combine_chunks().flatten()).astype(np.int64)
    sums = []
    for value in (best, count):
        out = np.zeros(len(sizes), np.int64)
        np.add.at(out, doc, times * value[where])
        sums.append(pa.array(out))
    return pa.table([rows.column(c) for c in ("doc_id", *_COUNTS)] + sums
                    + [rows.column("groups_sha256")], names=_JUDGED.names)


def alignment_report(docs: DataFrame, a: str, b: str, id_column: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Per row of docs its tokens, groups and links, n_best and count_sum.

    A pair of ids counts the documents that hold it linked. n_best are links whose count is the highest of
    their id of A, count_sum is the sum of counts over links.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    top = tokenizers(a, b)[1].sizes.size
    chunks, name = bucketed(aligned_chunks(docs, a, b), "chunk")
    try:
        listed = save(chunks.where(F.size("pairs") > 0).select(
            "chunk", F.posexplode(F.arrays_zip("pairs", "documents")).alias("place", "pair"))
            .select("chunk", "place", "pair.pairs", "pair.documents"))
        counts = save(listed.groupBy("pairs").agg(F.sum("documents").alias("count"))
                      .withColumn("a", F.expr(f"pairs div {top}")))
        best = counts.groupBy("a").agg(F.max("count").alias("most"))
        judged = counts.join(best, "a").select("pairs", "count", (F.col("count") == F.col("most")).alias("best"))
        found = listed.join(judged, "pairs").select("chunk", "place", "count", "best")
        return save(chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(
            _judge, _JUDGED))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
