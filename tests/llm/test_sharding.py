import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from conftest import odd_documents

from ledgerloom.llm import sharding

MASK = 2**64 - 1


def shard_of(key, weights):
    """Spark's xxhash64 hashes column after column, each with the hash before it as seed."""
    def cost(i, w):
        h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42)
        if key is not None:
            h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), h)
        return -math.log(((h >> 11) + 0.5) / 2.0**53) / w
    return min(range(len(weights)), key=lambda i: cost(i, weights[i]))


def check(rows, expected, weights):
    slots, got = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        got[(r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard)] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter()
    for i, text in expected:
        b = (text or "").encode()
        want[(i, len(b) + 1, zlib.crc32(b), shard_of(i, weights), shard_of(i, [*weights, 1]))] += 1
    assert got == want
    assert all(k[4] in (k[3], len(weights)) for k in got)


@pytest.mark.parametrize("weights", [(1.0,) * 16, (3.0, 1.0, 0.5)])
def test_against_own_hashes(spark, odd, weights):
    rows = sharding.shard_documents(odd, weights=weights).collect()
    check(rows, [r[:2] for r in odd_documents()], weights)


def test_empty_and_bad_weights(spark, none):
    assert sharding.shard_documents(none).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(none, weights=(1.0, 0.0))


def test_weights_and_growth(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    rows = sharding.shard_documents(docs, weights=(1.0, 2.0, 1.0), grown_weight=4.0).collect()
    n = Counter(r.shard for r in rows)
    assert abs(n[1] / len(rows) - 0.5) < 0.02
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {3} and abs(len(moved) / len(rows) - 0.5) < 0.02


def test_registered_query(spark):
    from ledgerloom.llm import queries
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    check(queries.op7_rendezvous(spark, path).collect(), docs, (1.0,) * 16)
