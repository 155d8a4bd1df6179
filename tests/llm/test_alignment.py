import hashlib
from bisect import bisect_left
from collections import Counter
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import alignment
from ledgerloom.llm.queries import QUERIES

A_PATH, B_PATH = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def plain_tokens(text, libraries):
    """(id, bytes) of both tokenizations, or nothing where they don't spell the text."""
    if not text:
        return [], []
    a, b = libraries
    alphabet = {c: bytes([v]) for c, v in alignment.byte_characters().items()}
    x = [(i, b"".join(alphabet[c] for c in a.id_to_token(i)))
         for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = []
    for i in b.encode(text, num_threads=1):
        p = b.id_to_piece(i)
        y.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = b" " + text.encode()
    same = b"".join(t for _, t in x) == whole == b"".join(t for _, t in y)
    return (x, y) if same else ([], [])


def ranges(tokens):
    ends = np.cumsum([len(t) for _, t in tokens]).tolist()
    return list(zip([i for i, _ in tokens], [0, *ends[:-1]], ends))


def plain_report(rows, libraries):
    """Every two tokens of a document compared; groups by common ends."""
    linked = []
    for _, text in rows:
        x, y = map(ranges, plain_tokens(text, libraries))
        pairs, j = [], 0
        for i, s, e in x:
            while j and y[j - 1][2] > s:
                j -= 1
            while j < len(y) and y[j][1] < e:
                if y[j][2] > s:
                    pairs.append((i, y[j][0]))
                j += 1
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        sides = [[[str(i) for i, *_ in g] for _, g in groupby(z, lambda t: bisect_left(cuts, t[2]))]
                 for z in (x, y)]
        groups = ["|".join(map(",".join, both)) for both in zip(*sides, strict=True)]
        linked.append((len(x), len(y), groups, pairs))
    counts = Counter(p for *_, pairs in linked for p in set(pairs))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    return [(d, n_a, n_b, len(groups), len(pairs), sum(counts[p] == most[p[0]] for p in pairs),
             sum(counts[p] for p in pairs),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
            for (d, _), (n_a, n_b, groups, pairs) in zip(rows, linked)]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def found(df):
    return sorted(map(str, (tuple(r[c] for c in COLUMNS) for r in df.collect())))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=60),
       st.integers(1, 9))
def test_pieces_merge_like_a_plain_merge(x, y, piece):
    more = sum(x) - sum(y)
    (y if more > 0 else x).extend([1] * abs(more))
    a, b = np.cumsum(x), np.cumsum(y)
    ends = sorted({*a.tolist(), *b.tolist()})
    i, j, both = alignment.overlaps(a, b, piece)
    assert i.tolist() == np.searchsorted(a, ends).tolist()
    assert j.tolist() == np.searchsorted(b, ends).tolist()
    assert both.tolist() == [e in a and e in b for e in ends]
    at, bt = alignment.diagonals(a, b, piece)
    work = np.diff(at + bt)
    assert (work >= 0).all() and (work <= piece + 1).all()


def test_odd_rows(spark, odd, none, libraries):
    more = [(200 + k, t) for k, t in enumerate([
        "a  b", " lead", "trail ", "tab\tx", "<|endoftext|> <s> </s> <unk>", "▁ under", "<0x41>", "\x00",
        "ﬁ ligature", "é", "🙂🙂 x", " ", "　", "don't we'll", "x" * 300, "\n\n\n", "１２"])]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    out = alignment.alignment_report(docs.withColumnRenamed("text", "chunk"), A_PATH, B_PATH, text="chunk")
    expected = plain_report(rows, libraries)
    assert found(out) == sorted(map(str, expected))
    assert sum(not r[1] for r in expected) == 3 and any(r[4] > 1000 for r in expected)
    assert alignment.alignment_report(none, A_PATH, B_PATH).collect() == []


def test_very_long_texts(spark, libraries):
    texts = [" " * 100_000 + "end", "word " * 60_000 + "x", "y" * 30_000]
    rows = list(enumerate(texts))
    out = alignment.alignment_report(spark.createDataFrame(rows, "doc_id long, text string"), A_PATH, B_PATH)
    assert found(out) == sorted(map(str, plain_report(rows, libraries)))


def test_registered_query(spark, libraries):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain_report(rows, libraries)
    assert found(QUERIES["op13_merge_path"](spark, folder)) == sorted(map(str, expected))
    assert not spark.sql("SHOW TABLES").where("tableName LIKE 'corpus_%'").count()
