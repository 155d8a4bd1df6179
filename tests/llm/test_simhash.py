import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import simhash
from ledgerloom.llm.queries import QUERIES

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_fingerprint(text, size=3):
    words = (text or "").translate(str.maketrans(UPPER, UPPER.lower())).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, most=2):
    """Least id reachable, by comparing every two distinct fingerprints."""
    distinct = list(set(prints.values()))
    f = np.array(distinct, np.uint64)
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= most):
            root[find(distinct[j])] = find(x)
    least = {}
    for d, x in sorted(prints.items()):
        least.setdefault(find(x), d)
    return {d: least[find(x)] for d, x in prints.items()}


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 4), st.integers(1, 12), st.integers(0, 2**64 - 1), st.data())
def test_ring_keeps_every_near_pair(most, more, f, data):
    """Some start has an equal chain and no chain over its budget: the pair is met and stays."""
    ring = simhash.Ring(most, most + more)
    other = f
    for b in data.draw(st.lists(st.integers(0, 63), max_size=most)):
        other ^= 1 << b
    differ = f ^ other
    starts = [s for s in range(ring.segments)
              if all((differ & ring.chain(s, n)).bit_count() <= ring.budget(n)
                     for n in range(ring.equal, ring.segments + 1))]
    assert starts and ring.budget(ring.equal) == 0
    for s in starts:
        parts = ring.open_parts(s)
        assert any(not differ & ~sum(left) & (2**64 - 1) for left in combinations(parts, min(most, len(parts))))


def test_ring_of_the_query():
    ring = simhash.Ring(2)
    assert (ring.segments, ring.equal, ring.budget(3), ring.budget(5)) == (5, 2, 1, 2)
    assert all(sum(sorted((m.bit_count() for m in ring.open_parts(s)), reverse=True)[:2]) <= simhash.OPEN
               for s in range(5))
    with pytest.raises(ValueError):
        simhash.Ring(5, 5)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("node", [2048, 3])
def test_links_join_what_brute_force_joins(spark, node):
    """Also where every place is branched (node 3), in chains, balls and far from all others."""
    rng = random.Random(4)
    prints = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 4, 25])):
            prints.add(x)
            if rng.random() < .5:
                x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << rng.randrange(9)) ^ (1 << rng.randrange(9)) for _ in range(60)}
    elements = spark.createDataFrame([(signed(x),) for x in prints], "f long")
    links = [(r.a % 2**64, r.b % 2**64)
             for r in simhash.similar_prints(elements, 2, node=node).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    expected = plain_components({x: x for x in prints})
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {x: find(x) for x in prints} == expected


def test_odd_rows(spark, odd, none):
    prints = {r.doc_id if r.doc_id is not None else simhash.LEAST: plain_fingerprint(r.text)
              for r in odd.collect()}
    expected = plain_components(prints)
    got = simhash.near_duplicates(odd.withColumnRenamed("lang", "fingerprint")).collect()
    assert len(got) == odd.count()
    for r in got:
        d = simhash.LEAST if r.doc_id is None else r.doc_id
        assert int(r.fingerprint, 16) == prints[d] and len(r.fingerprint) == 16
        assert (simhash.LEAST if r.component_id is None else r.component_id) == expected[d]
    assert simhash.near_duplicates(none).collect() == []


def test_very_long_text():
    text = " ".join(f"Word{i % 977} of{i % 31}" for i in range(100_000))
    assert simhash.fingerprint(text.lower().encode(), 3) == plain_fingerprint(text)


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    prints = {d.doc_id: plain_fingerprint(d.text) for d in docs}
    expected = plain_components(prints)
    got = QUERIES["op12_pigeonring"](spark, folder).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (d, f"{x:016x}", expected[d]) for d, x in prints.items()}
    assert len(got) == len(docs) > len(set(expected.values()))
