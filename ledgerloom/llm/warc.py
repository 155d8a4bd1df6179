"""Deterministic sharded WARC writer and reader.

Records are put in the total order (key, digest), cut into shards of about `shard_bytes` of headers and
payload by the running sum of sizes in that order, and each shard is written in that order. So shards, files and bytes
depend on the records alone, not on partitions or attempts. Files roll when their compressed size
passes `roll_bytes`, by default a quarter of a shard before compression, so that text that shrinks to half fills two
files; each record is a gzip member of its own. Headers are made anew from the records:
ids from key and digest, digests from the bytes, a fixed date. Files are written under temporary names,
listed in a manifest and renamed when all are there (see files.py).

Of records with equal payloads of at least `min_revisit_bytes`, the one with the largest key is the
response; the others become revisit records that name it and carry no payload. The decision is made on
(key, digest) rows alone, aggregated before the shuffle; the payloads are shuffled once.

Defined results: a null payload is empty; a null key sorts first and is shown as null; of repeated
rows (equal key and payload) one is the response and the others revisit it; no rows give no file.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ledgerloom.llm.common import save, shared_folder, ship
from ledgerloom.llm.files import commit, system, temporary

SHARD_BYTES = 8 << 20
ROLL_BYTES = SHARD_BYTES // 4
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{key}/{digest}')}>"


def _line(value: str | None) -> str:
    """A header value: no line ends, nothing that ends the header early."""
    return " ".join((value or "").split())


def make_record(key, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One uncompressed record: WARC header, HTTP header and, for a response, the payload."""
    digest = base32_sha1(payload)
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"Record-Key: {'' if key is None else key}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}",
                 f"Refers-To-Key: {'' if refers_to is None else refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HEADER_BYTES = len(make_record(0, "", b"", 0, True))


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name: the same bytes for the same data."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Checked:
    """A stream that counts and digests what is read of it."""

    def __init__(self, stream) -> None:
        self.stream, self.n_bytes, self.sha256 = stream, 0, hashlib.sha256()

    def read(self, size: int) -> bytes:
        data = self.stream.read(size)
        self.n_bytes += len(data)
        self.sha256.update(data)
        return data


def read_members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed records of an archive, one gzip member after the other."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(size)
            if not data:
                if parts:
                    raise EOFError("the archive ends inside a record")
                return
        parts.append(z.decompress(data))
        data = b""
        if z.eof:
            data = z.unused_data
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def parse_record(record: bytes) -> dict:
    """Headers and payload of a record; checks lengths and digests."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                  for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    if "sha1:" + base32_sha1(block) != fields["WARC-Block-Digest"]:
        raise ValueError("a record's block digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().rsplit("Content-Length: ", 1)[1])
    if fields["WARC-Type"] == "response" and (
            len(payload) != size or "sha1:" + base32_sha1(payload) != fields["WARC-Payload-Digest"]):
        raise ValueError("a payload's length or digest is wrong")
    return fields | {"payload": payload, "payload_bytes": size}


# -- Spark -----------------------------------------------------------------------------------------

_WRITTEN = T.StructType([
    T.StructField("temporary", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("n_records", T.LongType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("sha256", T.StringType())])
_ARROW = pa.schema([("temporary", pa.string()), ("file", pa.string()), ("n_records", pa.int64()),
                    ("n_bytes", pa.int64()), ("sha256", pa.string())])


def shard_starts(sizes: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first (key, digest) of every shard but the first, from rows (key, digest, size > 0).

    The running sum is taken in two steps: within ranges, and over the sums of the ranges. Only rows
    at which a shard begins come to the driver, one per shard_bytes of input.
    """
    sums = (sizes.groupBy("key", "digest").agg(F.sum("size").alias("size"))
            .repartitionByRange("key", "digest").select("*", F.spark_partition_id().alias("range")))
    sums = save(sums)
    before = W.Window.orderBy("range").rowsBetween(W.Window.unboundedPreceding, -1)
    ranges = (sums.groupBy("range").agg(F.sum("size").alias("n"))
              .select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    within = W.Window.partitionBy("range").orderBy("key", "digest").rowsBetween(
        W.Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("size").over(within), F.lit(0))
    rows = sums.withColumn("at", at).join(ranges, "range")
    begin = F.col("offset") + F.col("at")
    shard = F.floor(begin / shard_bytes)
    # sizes are above 0, so only the very first row begins at 0; it needs no start
    return [tuple(r) for r in
            rows.where((shard != F.floor((begin + F.col("size")) / shard_bytes)) & (begin > 0))
            .select("key", "digest").orderBy("key", "digest").collect()]


def write_warc(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url",
               payload: str = "html", min_revisit_bytes: int = 0, shard_bytes: int = SHARD_BYTES,
               roll_bytes: int = ROLL_BYTES) -> tuple[str, DataFrame]:
    """Write all pages; the folder and its manifest (file, n_records, n_bytes, sha256)."""
    ship(pages.sparkSession)
    folder = folder or shared_folder(pages.sparkSession)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    records = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).alias("url"),
                           body.alias("payload"), F.sha1(body).alias("digest"))
    small = records.select("key", "digest", F.octet_length("payload").cast("bigint").alias("size"))
    whole = F.octet_length("payload") + F.coalesce(F.octet_length("url"), F.lit(0)) + HEADER_BYTES
    starts = shard_starts(records.select("key", "digest", whole.cast("bigint").alias("size")), shard_bytes)
    shards = len(starts) + 1
    # one row per payload that occurs more than once: (digest, key of the response)
    largest = (small.where(F.col("size") >= min_revisit_bytes).groupBy("digest")
               .agg(F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("n"))
               .where("n > 1"))
    marks = (small.where(F.col("size") >= min_revisit_bytes).select("key", "digest").distinct()
             .join(largest, "digest"))
    # the decision travels as a row of its own beside the payload's rows of the same (key, digest)
    both = records.select("key", "digest", F.lit(1).alias("kind"), "url", "payload",
                          F.lit(None).cast("bigint").alias("refers_to")).unionByName(
        marks.select("key", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
                     F.lit(None).cast("binary").alias("payload"), "refers_to"))
    shared = pages.sparkSession.sparkContext.broadcast(starts)

    def add_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right
        order = [(k is not None, k or 0, d) for k, d in shared.value]
        for batch in batches:
            places = [bisect_right(order, (k is not None, k or 0, d)) for k, d in
                      zip(batch.column("key").to_pylist(), batch.column("digest").to_pylist(),
                          strict=True)]
            yield batch.append_column("shard", pa.array(places, pa.int32()))

    schema = T.StructType([*both.schema.fields, T.StructField("shard", T.IntegerType())])
    dealt = (both.mapInArrow(add_shard, schema)
             .repartition(shards, "shard").sortWithinPartitions("shard", "key", "digest", "kind", "url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, name, written = None, "", "", None
        shard, roll, mark, answered = None, 0, None, None

        def close() -> pa.RecordBatch:
            out.close()
            values = [path, name, written[0], written[1], written[2].hexdigest()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(values, _ARROW, strict=True)],
                schema=_ARROW)

        for batch in batches:
            for i in range(batch.num_rows):
                place, k, digest, kind, uri, data, refers_to = (
                    batch.column(c)[i].as_py() for c in
                    ("shard", "key", "digest", "kind", "url", "payload", "refers_to"))
                if kind == 0:
                    mark, answered = (k, digest, refers_to), False
                    continue
                if shard is not None and (place != shard or written[1] >= roll_bytes):
                    yield close()
                    roll = roll + 1 if place == shard else 0
                    shard = None
                if shard is None:
                    shard, written = place, [0, 0, hashlib.sha256()]
                    name = f"pages-{place:06d}-{roll:04d}.warc.gz"
                    path = temporary(folder, name)
                    files, at = system(path)
                    files.create_dir(os.path.dirname(at), recursive=True)
                    out = files.open_output_stream(at)
                revisit = False
                if mark is not None and mark[:2] == (k, digest):
                    revisit = mark[2] != k or answered
                    answered = True
                member = gzip_member(make_record(
                    k, uri, data, mark[2] if revisit else None, revisit))
                out.write(member)
                written[0] += 1
                written[1] += len(member)
                written[2].update(member)
        if shard is not None:
            yield close()

    return folder, commit(dealt.mapInArrow(write, _WRITTEN), folder)


def read_warc(folder: str, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the archives: key, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Each archive is checked against its manifest row: number of records, bytes and SHA-256.
    payload is there on demand, and null for revisits.
    """
    ship(manifest.sparkSession)
    schema = T.StructType([
        T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType())]
        + [T.StructField("payload", T.BinaryType())] * payloads)
    arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("record_type", pa.string()),
                       ("refers_to", pa.int64()), ("url", pa.string())]
                      + [("payload", pa.binary())] * payloads)

    def number(value: str | None) -> int | None:
        return int(value) if value else None

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *listed in zip(*(batch.column(c).to_pylist() for c in (
                    "file", "n_records", "n_bytes", "sha256")), strict=True):
                files, path = system(os.path.join(folder, name))
                rows: list[dict] = []
                with files.open_input_stream(path, compression=None) as stream:
                    checked = Checked(stream)
                    n_records = 0
                    for record in read_members(checked):
                        n_records += 1
                        r = parse_record(record)
                        rows.append({
                            "page_id": number(r["Record-Key"]), "payload_bytes": r["payload_bytes"],
                            "payload_digest": r["WARC-Payload-Digest"].removeprefix("sha1:"),
                            "record_type": r["WARC-Type"], "url": r["WARC-Target-URI"],
                            "refers_to": number(r.get("Refers-To-Key")),
                            "payload": r["payload"] if r["WARC-Type"] == "response" else None})
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows = []
                if listed != [n_records, checked.n_bytes, checked.sha256.hexdigest()]:
                    raise ValueError(f"{name} is not the archive its manifest lists")
                yield pa.RecordBatch.from_pylist(rows, arrow)

    files = manifest.select("file", "n_records", "n_bytes", "sha256")
    return files.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2,
                             "file").mapInArrow(read_files, schema)


def warc_report(pages: DataFrame) -> DataFrame:
    """What the archives say of each page, read back after writing them."""
    folder, manifest = write_warc(pages)
    return read_warc(folder, manifest).drop("url")
