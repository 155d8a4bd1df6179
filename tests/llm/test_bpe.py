import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import odd_documents
from tokenizers import Tokenizer

from ledgerloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "a", "the", "'s", "'", "é", "̈", "\x85", "\x1c", "　", "<|endoftext|>",
         "<|", "1", "２", "²", ".", "!!", "😀", "�", "İ", "ß", "\r\n", " x", "\xa0", "Ⅷ"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(text):
    return np.frombuffer(bpe.load(PATH).encode_batch([text])[0], "<u4").tolist()


def test_random_texts(library):
    rnd = random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids_of(text) == ids, repr(text)
        assert "".join(bpe.load(PATH).decode_parts(np.array(ids, np.int64))) == library.decode(
            ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "a" * 9000, "ab" * 4000, "the" * 5000, "é" * 5000, "." * 5000, "1234567890" * 800,
    "".join(random.Random(1).choice("etaoinsh") for _ in range(20_000))])
def test_long_pieces_stream_through_a_window(library, text):
    assert ids_of(text) == library.encode(text, add_special_tokens=False).ids


def test_batches_share_a_table_that_is_renewed(library):
    b = bpe.Bpe(PATH)
    b._table.size = 50
    rnd = random.Random(9)
    words = ["".join(rnd.choice("etaoinshé1.") for _ in range(rnd.randint(1, 90))) for _ in range(300)]
    for _ in range(20):
        texts = [rnd.choice(["", " ", "\n"]).join([" ".join(rnd.choices(words, k=20)), "  x"]) for _ in range(5)]
        got = [np.frombuffer(p, "<u4").tolist() for p in b.encode_batch([*texts, "", None])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts] + [[], []]
        for t, d in zip(texts, b.decimal_texts(np.array(sum(got, [])), [len(g) for g in got])):
            assert d.decode() == ",".join(map(str, library.encode(t, add_special_tokens=False).ids))


def test_ids_that_are_no_text_decode_as_the_library_does(library):
    ids = [random.Random(2).randrange(50257) for _ in range(3000)]
    assert "".join(bpe.load(PATH).decode_parts(np.array(ids))) == library.decode(
        ids, skip_special_tokens=False)


def test_window_is_larger_than_the_lookahead():
    b = bpe.load(PATH)
    assert max(map(len, b.bytes_of)) < b.lookahead < b.window


def digests(text, library):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_odd_documents(spark, odd, none, library):
    got = Counter((r.doc_id, r.text, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                  for r in bpe.encode_decode(odd, PATH, digests=True).collect())
    assert got == Counter((i, t, *digests(t, library)) for i, t, *_ in odd_documents())
    whole = bpe.encode_decode(odd, PATH)
    assert whole.columns == odd.columns + ["n_tokens", "token_ids", "decoded"]
    for r in whole.collect():
        assert r.decoded == (r.text or "") and len(r.token_ids) == r.n_tokens
    assert bpe.encode_decode(none, PATH).count() == 0


def test_registered_query(spark, library):
    from ledgerloom.llm import queries
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op10_bpe_transducer(spark, path).collect()}
    assert got == {r.doc_id: digests(r.text, library) for r in docs}
