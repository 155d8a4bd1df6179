"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Encoding. Text is cut at special tokens, then by the tokenizer's split pattern, then into bytes that
merge by rank. Merging a piece never needs more of it than a window: bytes that follow can change
tokens only within the merge list's sufficient lookahead, a constant computed from the list. So the
transducer merges a window, emits the tokens that end before its last `lookahead` bytes, and goes
on with the rest and the next bytes; its memory is constant however long a piece is.

Why the bound holds: run the merges on a window alone and on the window with more text after it, in
rank order side by side, and call frontier the place up to which both have the same tokens. It moves
left only when one run merges the last common token u with something right of it, by a rule (u, z)
of higher rank number than the move before, where z starts with the common token of that earlier
move. The longest such chain of rules, weighted by the bytes of u, bounds all moves together.

Decoding maps ids to bytes and bytes to text by an incremental UTF-8 state machine; bytes that are no
text become U+FFFD as in the usual decoders.

Parts between spaces are remembered in a table of bounded size; those of a batch that are not in it are
merged side by side, one merge of each a round. Pieces longer than SIDE_BY_SIDE bytes go through the window.

Defined results: a null or empty text has no ids and decodes to the empty text; the strings of special
tokens are their ids; repeated rows are encoded alike; columns of documents pass through, a new
column whose name is taken gets underscores before it.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.common import free_name, ship, slices

SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_SPLIT = regex.compile(SPLIT)
_SPACE = regex.compile(r"\p{White_Space}")
TABLE_SIZE = 100_000
REMEMBERED = 64
SIDE_BY_SIDE = 64
DECODE_IDS = 1 << 16
BATCH = 1 << 20


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def decimals(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below top, left-aligned, and how many each has."""
    texts = [str(i).encode() for i in range(top)]
    width = max(map(len, texts))
    return (np.frombuffer(b"".join(t.ljust(width) for t in texts), np.uint8).reshape(top, width),
            np.array(list(map(len, texts))))


class Remembered:
    """Two generations of a table: the older one goes when the younger is full."""

    def __init__(self, size: int = TABLE_SIZE):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Bpe:
    """Vocabulary, merges, transducer and decoder of one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_characters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if token not in self.special else b""
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.of_byte = [0] * 256
        for c, b in byte_of.items():
            self.of_byte[b] = vocab[c]
        # pair of ids -> rank and id of the merged token; pairs as one number
        self.shift = len(self.bytes_of).bit_length()
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        rules = []
        for pair in spec["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocab[left], vocab[right]
            key = a << self.shift | b
            if key not in self.rank:
                self.rank[key] = len(self.merged)
                self.merged.append(vocab[left + right])
                rules.append((a, b))
        self.lookahead = self._sufficient_lookahead(rules)
        self.window = max(4 * self.lookahead, 1024)
        self._cut = (regex.compile("|".join(regex.escape(t) for t in
                                            sorted(self.special, key=len, reverse=True)))
                     if self.special else None)
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.byte_ids = np.array(self.of_byte, np.int64)
        self.merged_ids, self.no_rank = np.array(self.merged, np.int64), len(self.merged)
        keys = np.array(list(self.rank), np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        self.digits, self.lengths = decimals(len(self.bytes_of))
        self.spaces = {chr(c) for c in range(0x3001) if _SPACE.match(chr(c))}
        self._table = Remembered()

    def _sufficient_lookahead(self, rules: list[tuple[int, int]]) -> int:
        left_part = {}
        for (a, b), token in zip(rules, self.merged, strict=True):
            left_part.setdefault(token, a)
        moved: dict[int, int] = {}
        for a, z in rules:
            best, prefix = 0, z
            while prefix is not None:
                best = max(best, moved.get(prefix, 0))
                prefix = left_part.get(prefix)
            moved[a] = max(moved.get(a, 0), best + len(self.bytes_of[a]))
        longest = max(map(len, self.bytes_of))
        return max(moved.values(), default=0) + longest

    # -- encoding --------------------------------------------------------------------------------

    def _merge(self, ids: list[int]) -> list[int]:
        """Apply the merges by rank, the leftmost pair first, until none applies."""
        rank, shift, none = self.rank.get, self.shift, len(self.merged)
        ranks = [rank(a << shift | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [self.merged[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << shift | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << shift | ids[i + 1], none)
        return ids

    def stream(self, data: bytes) -> Iterator[int]:
        """Ids of one split piece; at most a window of its bytes is merged at a time."""
        at, end = 0, min(self.window, len(data))
        while True:
            ids = self._merge([self.of_byte[b] for b in data[at:end]])
            if end == len(data):
                yield from ids
                return
            stable = end - self.lookahead
            for i in ids:
                if at + len(self.bytes_of[i]) > stable:
                    break
                at += len(self.bytes_of[i])
                yield i
            end = min(at + self.window, len(data))

    def merge_side_by_side(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, given one after the other, and how many each has.

        In every round each piece that is not done applies its merge of least rank, the leftmost first.
        """
        ids = self.byte_ids[np.frombuffer(data, np.uint8)]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        done_ids, done_owner = [], []
        ranks = np.full(len(ids), self.no_rank, np.int64)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inside] = self._ranks(ids[inside], ids[inside + 1])
        while len(ids):
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            counts = np.diff(np.append(begins, len(ids)))
            least = np.repeat(np.minimum.reduceat(ranks, begins), counts)
            done = least == self.no_rank
            if done.any():
                done_ids.append(ids[done])
                done_owner.append(owner[done])
                ids, owner, ranks, least = (x[~done] for x in (ids, owner, ranks, least))
            at = np.flatnonzero(ranks == least)
            if not len(at):
                break
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]
            ids[at] = self.merged_ids[ranks[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))             # each piece before has lost one place
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            for k in (at, at - 1):
                near = np.flatnonzero(np.minimum(k, len(ids) - k - 2) >= 0)
                same = near[owner[k[near]] == owner[k[near] + 1]]
                if k is at:
                    ranks[at] = self.no_rank
                ranks[k[same]] = self._ranks(ids[k[same]], ids[k[same] + 1])
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        return (ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes)))

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a << self.shift | b
        place = np.searchsorted(self.pairs, pair)
        place[place == len(self.pairs)] = 0
        return np.where(self.pairs[place] == pair, self.pair_ranks[place], self.no_rank)

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of texts that begin and end where split pieces do."""
        pieces: list[bytes] = []
        counts = []
        for unit in units:
            # a space and letters are one piece
            found = [unit] if unit[1:].isalpha() and unit[0] == " " else _SPLIT.findall(unit)
            counts.append(len(found))
            pieces += map(str.encode, found)
        sizes = np.array(list(map(len, pieces)), np.int64)
        long = np.flatnonzero(sizes > SIDE_BY_SIDE)
        streamed = {i: list(self.stream(pieces[i])) for i in long.tolist()}
        for i in streamed:
            pieces[i] = b""
        sizes[long] = 0
        ids, n = self.merge_side_by_side(b"".join(pieces), sizes)
        if streamed:
            ends = np.cumsum(n)
            places = np.concatenate([np.full(len(x), ends[i]) for i, x in streamed.items()])
            ids = np.insert(ids, places, np.concatenate([np.array(x) for x in streamed.values()]))
            n[long] = [len(x) for x in streamed.values()]
        ends = np.append(0, np.cumsum(n))[np.cumsum([0, *counts])] * 4
        packed = ids.astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def units(self, text: str) -> list[str]:
        """Keys of the parts of a text, which are encoded alone and remembered.

        A part begins at a space before a character that is no white space: no split piece crosses such
        a place. Its key leaves that space out; the key of the first part is a space and the part.
        """
        parts = text.split(" ")
        known, spaces = self._table.young, self.spaces
        begins = [i for i, p in enumerate(parts) if p in known or (p and p[0] not in spaces)]
        if begins and begins[0] == 0:
            begins.pop(0)
        if len(begins) == len(parts) - 1:
            parts[0] = " " + parts[0]
            return parts
        edges = [0, *begins, len(parts)]
        keys = [" ".join(parts[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        keys[0] = " " + keys[0]
        return keys

    def keys(self, text: str) -> list[str | int]:
        """Keys of a text's parts, and the ids of special tokens between them."""
        if self._cut is None or not self._cut.search(text):
            return self.units(text)
        out: list[str | int] = []
        at = 0
        for m in self._cut.finditer(text):
            out += [*self.units(text[at:m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.units(text[at:])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. All parts not seen before are merged side by side."""
        keys = [self.keys(t) if t else [] for t in texts]
        table = self._table
        if len(table.young) >= table.size:
            table.old, table.young = table.young, {}
        known = table.young
        new = set(chain.from_iterable(keys)).difference(known)
        again = new.intersection(table.old)
        known.update((k, table.old[k]) for k in again)
        new -= again
        ids = new.intersection(self.special.values())
        known.update((k, struct.pack("<I", k)) for k in ids)
        words = list(new - ids)
        values = self.encode_units([k[1:] if k[0] == " " else " " + k for k in words])
        fresh = zip(words, values, strict=True)
        if max(map(len, words), default=0) < REMEMBERED:
            known.update(fresh)
            return [b"".join(map(known.__getitem__, ks)) for ks in keys]
        long = dict(fresh)
        known.update((k, long.pop(k)) for k in words if len(k) < REMEMBERED)
        return [b"".join([known[k] if k in known else long[k] for k in ks]) for ks in keys]

    # -- decoding --------------------------------------------------------------------------------

    def decimal_texts(self, ids: np.ndarray, sizes: list[int]) -> Iterator[bytes]:
        """For each text, of that many ids, its ids as decimals joined by commas."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, ord(","), np.uint8)
        begins = ends - lengths - 1
        for k in range(self.digits.shape[1]):
            has = np.flatnonzero(lengths > k)
            out[begins[has] + k] = self.digits[ids[has], k]
        flat, edges = out.tobytes(), np.append(0, ends)[np.append(0, np.cumsum(sizes))].tolist()
        return (flat[a:max(a, b - 1)] for a, b in zip(edges[:-1], edges[1:]))

    def token_bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        places = np.arange(ends[-1]) + np.repeat(self.begins[ids] - (ends - sizes), sizes)
        return self.flat[places].tobytes()

    def decode_parts(self, ids: np.ndarray) -> Iterator[str]:
        """Text of the ids, part by part; a character may lie across parts of ids."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(ids), DECODE_IDS):
            yield machine.decode(self.token_bytes(ids[at:at + DECODE_IDS]))
        yield machine.decode(b"", final=True)


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One per Python worker: the table of pieces lasts over tasks."""
    return Bpe(path)


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text", digests: bool = False,
                  keep_text: bool = True) -> DataFrame:
    """Rows of docs with n_tokens and either token_ids and decoded, or the digests of both.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8.
    """
    ship(docs.sparkSession)
    passed = [c for c in docs.columns if keep_text or c != text]
    kinds = {"n_tokens": T.LongType()} | (
        {"ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digests
        else {"token_ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()})
    names = [free_name(docs.select(passed), c) for c in kinds]
    schema = T.StructType([docs.schema[c] for c in passed]
                          + [T.StructField(n, k) for n, k in zip(names, kinds.values(), strict=True)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in slices(batches, text, BATCH):
            packed = bpe.encode_batch(batch.column(batch.schema.get_field_index(text)).to_pylist())
            sizes = [len(p) // 4 for p in packed]
            ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
            edges = np.append(0, np.cumsum(sizes)).astype(np.int32)
            texts = (bpe.decode_parts(ids[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()))
            if digests:
                first = pa.array([hashlib.sha256(t).hexdigest()
                                  for t in bpe.decimal_texts(ids, sizes)], pa.string())
                second = [digest_of(parts) for parts in texts]
            else:
                first = pa.ListArray.from_arrays(pa.array(edges), pa.array(ids, pa.int32()))
                second = ["".join(parts) for parts in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in passed]
                + [pa.array(sizes, pa.int64()), first, pa.array(second, pa.string())], passed + names)

    return docs.mapInArrow(rows, schema)


def digest_of(parts: Iterator[str]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part.encode())
    return digest.hexdigest()
