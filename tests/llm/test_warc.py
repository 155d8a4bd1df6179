import base64
import gzip
import hashlib
import io
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import warc
from ledgerloom.llm.files import MANIFEST, system

PAGES = [(1, "http://a/\r\nX: y", "<p>one</p>", 7), (2, None, None, 7), (3, "u3", "", 7),
         (4, "u4", "<p>one</p>", 7), (5, "u5", "é" * 3000, 7), (6, "u6", "\r\n\r\nx", 7),
         (7, "u7", "<p>one</p>", 7), (8, "u8", "twin", 7), (8, "u8", "twin", 7),
         (None, "n", "<p>one</p>", 7), (None, "n", "alone", 7), (9, "u9", "x" * 200_000, 7)]
SCHEMA = "page_id long, url string, html string, shard int"


def expected(pages, least=0):
    groups = defaultdict(list)
    for i, (key, _, html, *_) in enumerate(pages):
        groups[(html or "").encode()].append((key is not None, key or 0, i, key))
    out = Counter()
    for data, members in groups.items():
        members.sort()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for m in members:
            response = len(data) < least or m == members[-1]
            out[(m[3], len(data), digest, "response" if response else "revisit",
                 None if response else members[-1][3])] += 1
    return out


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, SCHEMA).repartition(4)


def test_report(spark, pages):
    assert Counter(tuple(r) for r in warc.warc_report(pages).collect()) == expected(PAGES)
    assert warc.warc_report(pages.limit(0)).count() == 0


def test_small_payloads_stay_responses(pages):
    folder, manifest = warc.write_warc(pages, min_revisit_bytes=5)
    got = warc.read_warc(folder, manifest).drop("url")
    assert Counter(tuple(r) for r in got.collect()) == expected(PAGES, 5)


def archives(folder, manifest):
    files, root = system(folder)
    assert files.get_file_info(f"{root}/{MANIFEST}").size > 0
    out = {}
    for r in manifest.collect():
        with files.open_input_stream(f"{root}/{r.file}", compression=None) as f:
            out[r.file] = f.read()
        assert hashlib.sha256(out[r.file]).hexdigest() == r.sha256 and len(out[r.file]) == r.n_bytes
    return out


def test_bytes_depend_on_the_records_alone(spark, pages):
    first = archives(*warc.write_warc(pages, shard_bytes=2000, roll_bytes=300))
    again = archives(*warc.write_warc(pages.repartition(1), shard_bytes=2000, roll_bytes=300))
    assert first == again and len(first) > 3
    order = []
    for name in sorted(first):
        data = gzip.decompress(first[name])
        assert data.startswith(b"WARC/1.1\r\n")
        order += [warc.parse_record(r)["Record-Key"] for r in warc.read_members(io.BytesIO(first[name]))]
    keys = [int(k) if k else -1 for k in order]
    assert keys == sorted(keys) and len(keys) == len(PAGES)


def test_files_roll_at_the_sizes_the_query_uses(spark):
    """Over two shards of text that shrinks to about half: each is written as several files in order."""
    digits = "array_join(transform(sequence(1, 400), i -> sha2(concat(id, '/', i), 256)), '')"
    pages = spark.range(700).selectExpr("id AS page_id", "'u' AS url", f"{digits} AS html")
    folder, manifest = warc.write_warc(pages)
    rows = sorted(manifest.collect(), key=lambda r: r.file)
    parts = Counter(r.file[:-len("-0000.warc.gz")] for r in rows)
    assert len(parts) == 3 and max(parts.values()) > 1 and sum(r.n_records for r in rows) == 700
    for r, after in zip(rows, rows[1:]):
        assert r.n_bytes < warc.ROLL_BYTES + 30_000
        assert r.n_bytes >= warc.ROLL_BYTES or after.file.endswith("-0000.warc.gz")
    assert warc.read_warc(folder, manifest).select("page_id").distinct().count() == 700


def test_empty_pages_fill_shards(spark):
    """Null html throughout, and only at the front: shards by bytes, not one per page."""
    empty = spark.range(600).selectExpr("id AS page_id", "'u' AS url", "CAST(NULL AS string) AS html")
    full = spark.range(600, 700).selectExpr("id AS page_id", "'u' AS url", "repeat('x', 1000) AS html")
    for pages, n in ((empty, 600), (empty.unionByName(full), 700)):
        folder, manifest = warc.write_warc(pages, shard_bytes=100_000)
        rows = manifest.collect()
        assert 2 < len(rows) < 10 and sum(r.n_records for r in rows) == n
        assert max(r.n_records for r in rows) < 300
        assert warc.read_warc(folder, manifest).select("page_id").distinct().count() == n


def test_payloads_round_trip(pages):
    folder, manifest = warc.write_warc(pages)
    for r in warc.read_warc(folder, manifest, payloads=True).collect():
        if r.record_type == "response":
            assert warc.base32_sha1(r.payload) == r.payload_digest


def test_damage_is_seen():
    record = warc.make_record(1, "u", b"data", None, False)
    assert warc.parse_record(record)["payload"] == b"data"
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"data", b"dart"))


def test_registered_query(spark):
    from ledgerloom.llm import queries
    path = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{path}/pages.parquet").collect()]
    got = queries.op5_sharded_warc(spark, path)
    assert Counter(tuple(r) for r in got.collect()) == expected(rows)


def test_an_archive_with_records_missing_is_seen(pages):
    """The manifest's counts and digests decide what is read."""
    folder, manifest = warc.write_warc(pages)
    name = manifest.first().file
    files, path = warc.system(f"{folder}/{name}")
    with files.open_input_stream(path, compression=None) as stream:
        members = list(warc.read_members(stream))
    with files.open_output_stream(path, compression=None) as out:
        out.write(b"".join(warc.gzip_member(m) for m in members[:-1]))
    with pytest.raises(Exception, match="not the archive its manifest lists"):
        warc.read_warc(folder, manifest).collect()
