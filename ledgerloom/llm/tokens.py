"""Token ids in binary files of directly addressable codes.

An id is split into chunks of fixed widths, the low bits first. Level k holds the k-th chunk of all
ids that are long enough, bit-packed, and a bitmap that says of each chunk whether another one
follows; a rank directory counts the bitmap's ones before every RANK_BITS bits. So token i is read
in one step per level, from any place, without decoding a block: its chunk at level k + 1 lies at
the number of ones before its chunk at level k.

A file holds the documents of one range of ids, ascending, with the offset of each document's tokens;
files are ranges that ascend too. Widths are chosen per file from the ids' bit lengths. Documents
are spread by range over (id, hash of the text), so that even a frequent id makes no large file.

Defined results: a null or empty text has no ids but the end id; a null doc_id comes first; rows with
equal ids follow each other in the order of their texts' hash; no rows give no file and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.bpe import Remembered
from ledgerloom.llm.common import input_bytes, shared_folder, ship, slices
from ledgerloom.llm.files import commit, system, temporary

MAGIC = b"DACv1\0\0\0"
RANK_BITS = 512
END_ID = 2
FILE_TEXT_BYTES = 64 << 20
CODE_IDS = 1 << 18
_MARKS = re.compile(r"[\W_][.,] ")


# -- the codes ---------------------------------------------------------------------------------------

def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value, most significant bit first, one after the other."""
    parts, step = [], CODE_IDS
    for at in range(0, len(values), step):  # step * width is a multiple of 8
        big = values[at:at + step].astype(">u4")
        bits = np.unpackbits(big.view(np.uint8)).reshape(-1, 32)[:, 32 - width:]
        parts.append(np.packbits(bits.reshape(-1)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def unpack_bits(data: np.ndarray, width: int, begin: int, end: int) -> np.ndarray:
    """Values begin to end of packed ones."""
    out = []
    for at in range(begin, end, CODE_IDS):
        stop = min(at + CODE_IDS, end)
        first, last = at * width // 8, -(-stop * width // 8)
        bits = np.unpackbits(data[first:last])[at * width - first * 8:][:(stop - at) * width]
        full = np.zeros((stop - at, 32), np.uint8)
        full[:, 32 - width:] = bits.reshape(-1, width)
        out.append(np.packbits(full.reshape(-1)).view(">u4").astype(np.uint32))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def choose_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths of least total size, by dynamic programming over the ids' bit lengths."""
    top = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    lengths = np.zeros(top + 1, np.int64)
    edges = 2 ** np.arange(top + 1)
    for at in range(0, len(ids), CODE_IDS):
        lengths += np.bincount(np.minimum(np.searchsorted(edges, ids[at:at + CODE_IDS], "right"), top),
                               minlength=top + 1)
    longer = [int(lengths[b + 1:].sum()) if b else int(lengths.sum()) for b in range(top + 1)]
    best = {top: (0, [])}
    for b in range(top - 1, -1, -1):
        # a level from bit b to e holds all ids longer than b bits; all but the last have a bitmap
        best[b] = min((longer[b] * (e - b + (e < top)) + best[e][0], [e - b] + best[e][1])
                      for e in range(b + 1, top + 1))
    return best[0][1]


def ranks_of(bits: np.ndarray) -> np.ndarray:
    """Ones before every RANK_BITS bits."""
    padded = np.zeros(-(-len(bits) // RANK_BITS) * RANK_BITS, np.uint8)
    padded[:len(bits)] = bits
    ones = padded.reshape(-1, RANK_BITS).sum(1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(ones)]).astype("<i8")


def encode_file(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    widths = choose_widths(ids)
    sections, levels, rest = [], [], ids
    for k, width in enumerate(widths):
        level = {"width": width, "n": len(rest), "chunks": len(sections)}
        sections.append(pack_bits(rest & np.uint32((1 << width) - 1), width).tobytes())
        if k + 1 < len(widths):
            rest = rest >> np.uint32(width)
            more = rest > 0
            level |= {"more": len(sections), "ranks": len(sections) + 1}
            sections += [np.packbits(more).tobytes(), ranks_of(more.astype(np.uint8)).tobytes()]
            rest = rest[more]
        levels.append(level)
    documents = len(sections)
    sections += [json.dumps(doc_ids).encode(),
                 np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes()]
    head = {"levels": levels, "documents": documents,
            "offsets": np.concatenate([[0], np.cumsum([len(s) for s in sections])]).tolist()}
    head_bytes = json.dumps(head).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(head_bytes)), head_bytes, *sections])


class TokenFile:
    """Random access to the tokens of a file."""

    def __init__(self, data: bytes):
        if data[:len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack_from("<Q", data, len(MAGIC))
        body = len(MAGIC) + 8 + n
        head = json.loads(data[len(MAGIC) + 8:body])
        at = head["offsets"]

        def section(i: int, kind=np.uint8) -> np.ndarray:
            return np.frombuffer(data, kind, (at[i + 1] - at[i]) // np.dtype(kind).itemsize,
                                 body + at[i])

        self.levels = [(x["width"], section(x["chunks"]),
                        section(x["more"]) if "more" in x else None,
                        section(x["ranks"], "<i8") if "more" in x else None)
                       for x in head["levels"]]
        self.doc_ids = json.loads(section(head["documents"]).tobytes())
        self.offsets = section(head["documents"] + 1, "<i8")

    def _rank(self, level: int, at: int) -> int:
        """Ones in the level's bitmap before bit `at`."""
        _, _, more, ranks = self.levels[level]
        block = at // RANK_BITS
        bits = np.unpackbits(more[block * RANK_BITS // 8:-(-at // 8)])
        return int(ranks[block]) + int(bits[:at - block * RANK_BITS].sum())

    def token(self, i: int) -> int:
        return int(self.tokens(i, i + 1)[0])

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end of the file."""
        out, where, shift = np.zeros(end - begin, np.uint32), np.arange(end - begin), 0
        for level, (width, chunks, more, _) in enumerate(self.levels):
            if end <= begin:
                break
            out[where] |= unpack_bits(chunks, width, begin, end) << np.uint32(shift)
            if more is None:
                break
            bits = np.unpackbits(more[begin // 8:-(-end // 8)])[begin % 8:][:end - begin]
            where, shift = where[bits > 0], shift + width
            begin, end = self._rank(level, begin), self._rank(level, end)
        return out


# -- tokens of texts ---------------------------------------------------------------------------------

class WordEncoder:
    """The library's ids of texts, word by word.

    The tokenizer drops white space, so a text's ids are those of the parts between its spaces (and
    line ends), each of which is encoded once and remembered. `joins` is checked on each tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table = Remembered(400_000)
        self.marks = {m: struct.pack(f"<{len(i)}I", *i)
                      for m, i in zip(".,", self._library([".", ","]), strict=True)}
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        probe = "Don't stop, 12 é\nx"
        apart = [i for w in probe.replace("\n", " ").split(" ") for i in self._library([w])[0]]
        if self._library([probe])[0] != apart:
            raise ValueError("this tokenizer does not drop white space")

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in
                self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, text: str) -> list[str]:
        """Parts of the text whose ids make up its ids, in as few different forms as possible.

        Lower case is what the normaliser makes of Latin-1 texts anyway; a mark after a letter or digit
        is a match of its own, if no other mark stands before it.
        """
        text = text.replace("\n", " ")
        if "<|" not in text:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text.split(" ")
            text = text.lower()
            if not _MARKS.search(text):
                text = text.replace(". ", " . ").replace(", ", " , ")
        return text.split(" ")

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        table = self.table
        if len(table.young) >= table.size:
            table.old, table.young = table.young, {}
        split = [self._parts(t or "") for t in texts]
        missing = set(chain.from_iterable(split)) - table.young.keys()
        known = {w: v for w in missing if (v := table.old.get(w)) is not None}
        table.young |= known
        self._encode_words(missing - known.keys())
        out = [b"".join(map(table.young.__getitem__, words)) for words in split]
        for w in missing:
            if len(w) > 64:
                del table.young[w]
        return out

    def _encode_words(self, words: set[str]) -> None:
        """Words share a call in the form that the normaliser gives them, without a last mark.

        The split pattern always ends a match between a letter and a mark, so their ids add up.
        """
        plain = {}
        for w in words:
            p = w.lower() if w and max(w) < "\u0300" and "<|" not in w else w
            mark = p[-1:] if p[-1:] in self.marks and p[-2:-1].lower().isalpha() else ""
            plain[w] = (p[:-1], mark) if mark else (p, mark)
        ids_of = {}
        letters, other = [], []
        for p in {p for p, _ in plain.values()}:
            value = self.table.young.get(p) or self.table.old.get(p)
            if value is not None:
                ids_of[p] = value
            else:
                (letters if p.isalpha() else other).append(p)
        # a word of letters only is one match, and the last of its tokens ends a word
        for at in range(0, len(letters), 256):
            part = letters[at:at + 256]
            ids = np.array(self._library([" ".join(part)])[0], "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):
                other += part
                continue
            packed, ends = ids.tobytes(), (ends * 4).tolist()
            for p, a, b in zip(part, [0, *ends], ends):
                ids_of[p] = packed[a:b]
        for at in range(0, len(other), 4096):
            part = other[at:at + 4096]
            for p, i in zip(part, self._library(part), strict=True):
                ids_of[p] = struct.pack(f"<{len(i)}I", *i)
        for w, (p, mark) in plain.items():
            self.table.young[w] = ids_of[p] + self.marks[mark] if mark else ids_of[p]


@lru_cache(maxsize=2)
def load_words(path: str) -> WordEncoder:
    return WordEncoder(path)


# -- Spark -----------------------------------------------------------------------------------------

WRITTEN = T.StructType([
    T.StructField("temporary", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("part", T.IntegerType()), T.StructField("piece", T.IntegerType()),
    T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("n_bytes", T.LongType())])


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None,
                 id_column: str = "doc_id", text: str = "text", end_id: int = END_ID,
                 file_text_bytes: int = FILE_TEXT_BYTES) -> tuple[str, DataFrame]:
    """Write the ids of all texts in ascending order of the id column; the folder and its manifest."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_folder(spark)
    small = docs.select(F.col(id_column).cast("bigint").alias("doc_id"),
                        F.col(text).alias("text"))
    parts = max(spark.sparkContext.defaultParallelism,
                -(-input_bytes(small, "text") // file_text_bytes))
    rows = (small.withColumn("h", F.xxhash64("text"))
            .repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, piece = load_words(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            data = encode_file(doc_ids, counts, np.frombuffer(b"".join(ids), "<u4"))
            name = f"tokens-{part:06d}-{piece:04d}.dac"
            path = temporary(folder, name)
            files, at = system(path)
            files.create_dir(os.path.dirname(at), recursive=True)
            with files.open_output_stream(at) as f:
                f.write(data)
            values = [path, name, part, piece, len(counts), int(counts.sum()), len(data)]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(values, ARROW, strict=True)], schema=ARROW)

        end = struct.pack("<I", end_id)
        for batch in slices(batches, "text"):
            doc_ids += batch.column("doc_id").to_pylist()
            new = [x + end for x in encoder.encode_batch(batch.column("text").to_pylist())]
            ids += new
            size += sum(map(len, new))
            if size >= file_text_bytes // 4:
                yield flush()
                doc_ids, ids, size, piece = [], [], 0, piece + 1
        if doc_ids:
            yield flush()

    return folder, commit(rows.select("doc_id", "text").mapInArrow(write, WRITTEN), folder)


ARROW = pa.schema([("temporary", pa.string()), ("file", pa.string()), ("part", pa.int32()),
                   ("piece", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                   ("n_bytes", pa.int64())])


def read_tokens(folder: str, manifest: DataFrame, digests: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it, over all files), n_tokens, and the ids.

    digests gives ids_crc32 in place of ids. The manifest has a row per file; its running sum of
    tokens, in the order of the files, gives each file's start.
    """
    spark = manifest.sparkSession
    ship(spark)
    files = sorted(manifest.select("part", "piece", "file", "n_tokens").collect())
    starts, at = [], 0
    for _, _, name, n in files:
        starts.append((name, at))
        at += n
    last = T.StructField("ids_crc32", T.LongType()) if digests else T.StructField(
        "ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), last])
    table = spark.createDataFrame(starts, "file string, start long")

    def read_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(),
                                   batch.column("start").to_pylist(), strict=True):
                fs_, path = system(os.path.join(folder, name))
                with fs_.open_input_file(path) as f:
                    tokens = TokenFile(f.read())
                for at in range(0, len(tokens.doc_ids), 1000):
                    bounds = tokens.offsets[at:at + 1001]
                    ids = tokens.tokens(int(bounds[0]), int(bounds[-1])).astype("<u4")
                    local = bounds - bounds[0]
                    raw = memoryview(ids.tobytes())
                    if digests:
                        value = pa.array([zlib.crc32(raw[a * 4:b * 4]) for a, b in
                                          zip(local[:-1].tolist(), local[1:].tolist(), strict=True)],
                                         pa.int64())
                    else:
                        value = pa.ListArray.from_arrays(pa.array(local.astype(np.int32)),
                                                         pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tokens.doc_ids[at:at + 1000], pa.int64()),
                         pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)), value],
                        schema.names)

    return table.repartition(max(1, len(files))).mapInArrow(read_file, schema)


def token_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, as read back from the files."""
    folder, manifest = write_tokens(docs, tokenizer)
    return read_tokens(folder, manifest, digests=True)
