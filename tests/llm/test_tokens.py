import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import odd_documents
from tokenizers import Tokenizer

from ledgerloom.llm import tokens
from ledgerloom.llm.files import MANIFEST, system

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("values", [
    [], [0], [0, 0, 0], [5], [2**31, 7, 0, 1], list(range(3000)),
    (np.random.default_rng(1).zipf(1.3, 20_000) % 49_408).tolist()])
def test_codes_round_trip_and_random_access(values):
    ids = np.array(values, np.uint32)
    counts = np.array([len(values) // 2, len(values) - len(values) // 2])
    f = tokens.TokenFile(tokens.encode_file([1, None], counts, ids))
    assert f.doc_ids == [1, None] and f.offsets.tolist() == [0, len(values) // 2, len(values)]
    assert f.tokens(0, len(ids)).tolist() == values
    for i in range(0, len(values), 571):
        assert f.token(i) == values[i]
        assert f.tokens(i, min(i + 33, len(values))).tolist() == values[i:i + 33]


def test_widths_are_of_least_size():
    ids = np.array([1] * 1000 + [60_000] * 10, np.uint32)
    assert tokens.choose_widths(ids) == [1, 15]


def test_encoder_equals_the_library(library):
    encoder = tokens.load_words(PATH)
    texts = [None, "", " ", "\n", "A'S don't İI ẖ H̱ <|endoftext|> x<|ENDOFTEXT|>y\x1cz \t é É",
             "a!. b", "a . b", "x_, y", "1. 2, é, Ü. ", " . ,", "it's, don't.", "A.B. c,d, .. e",
             "x" * 3000, "a.b,c!!\n\nd", "Σς ΑΣ 12 345 ２"]
    for _ in range(2):  # the second time from the table
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_batch(texts)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def expected(rows, library):
    out, start = [], 0
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_odd_documents(spark, odd, none, library):
    rows = sorted((r[:2] for r in odd_documents()), key=lambda r: (r[0] is not None, r[0]))
    got = tokens.token_report(odd, PATH).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected(rows, library)
    assert tokens.token_report(none, PATH).count() == 0


def test_files_are_committed_and_small(spark, odd):
    folder, manifest = tokens.write_tokens(odd, PATH, file_text_bytes=4000)
    assert manifest.count() > 3
    files, root = system(folder)
    files.get_file_info(f"{root}/{MANIFEST}")
    ids = tokens.read_tokens(folder, manifest).collect()
    assert len(ids) == len(odd_documents()) and all(r.ids[-1] == 2 for r in ids)


def test_registered_query(spark, library):
    from ledgerloom.llm import queries
    path = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect())
    got = sorted(tuple(r) for r in queries.op8_directly_addressable(spark, path).collect())
    assert got == expected(rows, library)
