"""Near-duplicates by a chosen-path similarity join of shingle sets.

A document is the set of its word shingles. Equal sets are one element (its digest names it), however
many documents have it. Elements get minwise tokens, and a sketch of SKETCH minwise values of 4 bits
that estimates similarity.

Trees of nodes bring elements together: at the root of each of TREES trees an element takes the path of
one minwise token; a node that is still large is branched by further tokens, chosen by the node, so
that similar elements go on together. TREES independent trees miss a pair at the threshold with
probability (1 - threshold) ** TREES.

First, in every node of any size each element is held against the node's first element only, and takes the
best two of its partners; the links found make components. Then only nodes in which different
components meet are branched and, once small, compared exhaustively, each pair of elements of different
components. Large nodes of which a fifth is one component, which tokens don't split, are compared in
pairs of blocks. Comparing gives elements, not pairs: those that look similar to one of another
component come to their node with their full sets, all pairs of different components are tested there,
and the links that join components are kept. So rows stay in proportion to the elements of nodes,
however similar a group is, and no link between different components is left out.

Links of the first round are confirmed on full sets that come to their partner, spread over several
tasks where a partner has many.

Defined results: texts without words have an empty set and are linked with nothing; fewer words than
a shingle has make one shingle; null ids come first (component_id is null where only they are
reachable); repeated rows are copies: of rows with one id, all are kept or none; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import (
    LOWER, free_name, mix, range_hashes, save, ship, slices, text_buffer, word_ranges)
from ledgerloom.llm.components import connected_components

TREES = 8
TOKENS = 32
SKETCH = 256
BRANCHES = 2
DEPTH = 5
NODE = 4096
SAFE = 0.93
DEVIATIONS = 4.5
SALT = 64

_rng = np.random.Generator(np.random.PCG64(0xC0FFEE))
_FACTORS = _rng.integers(0, 1 << 62, SKETCH, dtype=np.uint64) * np.uint64(4) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of `size` lower-cased words."""
    data = LOWER[data]
    starts, ends, first = word_ranges(data, offsets)
    h = range_hashes(data, starts, ends)
    n = len(h)
    rolled = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k:k + len(rolled)]
    rolled = mix(rolled)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            yield np.unique(rolled[a:b - size + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = mix(np.array([whole ^ x], np.uint64))[0]
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minwise(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at:at + 1024, None] * _FACTORS[None, :] + _TERMS[None, :]
        least = np.minimum(least, part.min(0))
    return least


def sketch_of(least: np.ndarray) -> bytes:
    small = ((least >> np.uint64(24)) & np.uint64(15)).astype(np.uint8)
    return (small[::2] << 4 | small[1::2]).tobytes()


def _unpacked(sketches: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), SKETCH // 2)
    return np.concatenate([packed >> 4, packed & 15], axis=1)


def _similarity(equal: np.ndarray) -> np.ndarray:
    """Estimate from the number of equal values; unequal tokens have equal values one time in 16."""
    return (equal / SKETCH - 1 / 16) / (15 / 16)


def lowest_estimate(threshold: float) -> float:
    """Estimates of pairs at the threshold lie above this but for chance below 1 in 100,000."""
    return threshold - DEVIATIONS * (threshold * (1 - threshold) / SKETCH) ** 0.5 * 16 / 15


_SKETCHED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("h", T.StringType()),
    T.StructField("n_shingles", T.LongType()), T.StructField("g", T.BinaryType()),
    T.StructField("tokens", T.ArrayType(T.IntegerType())),
    T.StructField("sketch", T.BinaryType())])


def sketch_documents(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, h, n_shingles, g (the digest of the set, null if empty), tokens, sketch of each row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, digests, tokens, sketches = [], [], [], []
            for s in shingle_sets(*text_buffer(batch.column("text")), size):
                counts.append(len(s))
                if not len(s):
                    digests.append(None)
                    tokens.append(None)
                    sketches.append(None)
                    continue
                least = minwise(s)
                digests.append(digest_of(s))
                tokens.append((least[:TOKENS] >> np.uint64(28)).astype(np.uint32).view(np.int32))
                sketches.append(sketch_of(least))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(counts, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(tokens, pa.list_(pa.int32())),
                 pa.array(sketches, pa.binary())],
                _SKETCHED.names)
    return docs.mapInArrow(rows, _SKETCHED)


def needed_sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(g, shingles) of the elements g in needed, once each."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            digests, packed = [], []
            for s in shingle_sets(*text_buffer(batch.column("text")), size):
                if len(s):
                    digests.append(digest_of(s))
                    packed.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["g", "shingles"])
    sets = docs.select("text").mapInArrow(rows, "g binary, shingles binary")
    # equal sets are equal rows: one of each is enough
    return (needed.withColumn("here", F.lit(1)).join(sets, "g").groupBy("g")
            .agg(F.first("shingles").alias("shingles")))


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """df as a table bucketed by a column, so that joins on it don't shuffle it; and its name."""
    spark, name = df.sparkSession, f"corpus_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").bucketBy(parts, key).saveAsTable(name)
    return spark.table(name), name


def _set(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u8")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of which 100 * intersection >= percent * union, on full sets. b is the partner."""
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(SALT)).alias("salt"))
    members = pairs.join(sets.select(F.col("g").alias("a"), F.col("shingles").alias("sa")), "a")
    partners = pairs.select("b", "salt").distinct().join(
        sets.select(F.col("g").alias("b"), F.col("shingles").alias("sb")), "b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, other = [], None, None
            for sa, sb in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(),
                              strict=True):
                if sb is not last:
                    last, other = sb, _set(sb)
                mine = _set(sa)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return (members.join(partners, ["b", "salt"]).select("a", "b", "sa", "sb")
            .mapInArrow(rows, "a binary, b binary"))


def estimated(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """(a, b, estimate) of pairs whose sketches are similar enough."""
    both = (pairs.join(sketches.select(F.col("g").alias("a"), F.col("sketch").alias("ka")), "a")
            .join(sketches.select(F.col("g").alias("b"), F.col("sketch").alias("kb")), "b"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_unpacked(batch.column(c).to_pylist()) for c in ("ka", "kb"))
                estimate = pa.array(_similarity((a == b).sum(1)))
                out = batch.select(["a", "b"]).append_column("estimate", estimate)
                yield out.filter(pa.compute.greater_equal(estimate, least))
    return both.select("a", "b", "ka", "kb").mapInArrow(rows, "a binary, b binary, estimate double")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one node after the other, from batches sorted by node; single rows are left out."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = np.array(table.column("node"))
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
        for start, stop in zip(edges[:-1], edges[1:]):
            if stop - start > 1:
                yield table.slice(start, stop - start)
        rest = table.slice(edges[-1])
    if rest is not None and rest.num_rows > 1:
        yield rest


def _numbered(table: pa.Table) -> np.ndarray:
    return np.array(table.column("root").dictionary_encode().combine_chunks().indices, np.int64)


def suspects(rows: DataFrame, least: float) -> DataFrame:
    """(node, g, root) of the elements that look similar to one of another component in their node.

    rows: node, g, root, half, t, first, whole, sketch. Elements of halves 0 and 1 are held against
    each other, those of half 2 against all of the node. A pair is left to the first tree in which
    its elements share a root (first has their tokens) that is compared whole (a bit per tree).
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enough = (least * 15 / 16 + 1 / 16) * SKETCH
        for table in _groups(batches):
            root, half = _numbered(table), np.array(table.column("half"))
            k = _unpacked(table.column("sketch").to_pylist())
            seen = np.zeros(len(root), bool)
            tree = table.column("t")[0].as_py()
            first = np.array(table.column("first").to_pylist(), np.int64)[:, :tree]
            whole = (np.array(table.column("whole"))[:, None] >> np.arange(tree) & 1) > 0
            for i in range(len(root) - 1):
                other = np.flatnonzero((root[i + 1:] != root[i]) & (
                    (half[i + 1:] != half[i]) | (half[i] == 2))) + i + 1
                close = other[(k[other] == k[i]).sum(1) >= enough]
                earlier = (first[close] == first[i]) & whole[close] & whole[i]
                close = close[~earlier.any(1)]
                if len(close):
                    seen[i] = True
                    seen[close] = True
            if seen.any():
                yield from table.select(["node", "g", "root"]).filter(pa.array(seen)).to_batches()
    return (rows.repartition("node").sortWithinPartitions("node")
            .select("node", "g", "root", "half", "t", "first", "whole", "sketch")
            .mapInArrow(compare, "node long, g binary, root binary"))


def intersections(sets: list[np.ndarray], rows: slice) -> np.ndarray:
    """Sizes of the intersections of some of the sets with all of them."""
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    count = np.bincount(column)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(range(*rows.indices(len(sets)))), len(sets)), np.float32)
    kinds = np.cumsum(np.append(0, column[1:] != column[:-1])) if len(column) else column
    for at in range(0, int(kinds[-1]) + 1 if len(kinds) else 0, 512):
        a, b = np.searchsorted(kinds, [at, at + 512])
        matrix = np.zeros((len(sets), 512), np.float32)
        matrix[owner[a:b], kinds[a:b] - at] = 1
        out += matrix[rows] @ matrix.T
    return out


def confirm_nodes(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each node, confirmed on full sets.

    rows: node, g, root, shingles. Every pair of different components is tested until they are joined;
    links within what is joined already are not needed, so a node gives fewer links than elements.
    """
    def confirm_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            g, root = table.column("g").to_pylist(), _numbered(table)
            sets = [_set(x) for x in table.column("shingles").to_pylist()]
            sizes = np.array([len(x) for x in sets])
            a, b = [], []
            for at in range(0, len(g), 512):
                both = intersections(sets, slice(at, at + 512))
                mine = sizes[at:at + 512, None]
                linked = 100 * both >= percent * (mine + sizes[None, :] - both)
                for i in np.flatnonzero((linked & (root[at:at + 512, None] != root[None, :])).any(1)):
                    for j in np.flatnonzero(linked[i]).tolist():
                        if root[at + i] != root[j]:
                            a.append(g[at + i])
                            b.append(g[j])
                            root[root == root[at + i]] = root[j]
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
    return (rows.repartition("node").sortWithinPartitions("node")
            .select("node", "g", "root", "shingles").mapInArrow(confirm_rows, "a binary, b binary"))


def _mixed_nodes(rows: DataFrame) -> DataFrame:
    """rows (node, g, root, tokens) of nodes in which different components meet, with the node's size."""
    size = (rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"),
                                     F.max("root").alias("r1"))
            .where("r0 <> r1").select("node", "n"))
    return rows.join(size, "node")


def _branch(rows: DataFrame) -> DataFrame:
    """Each element of a node takes BRANCHES paths on, by tokens that the node chooses."""
    deep = TOKENS - TREES
    choice = F.explode(F.array(*[F.lit(i) for i in range(BRANCHES)]))
    place = F.pmod(F.xxhash64("node", "choice"), F.lit(deep)) + F.lit(TREES + 1)
    return rows.withColumn("choice", choice).select(
        F.xxhash64("node", "choice", F.element_at("tokens", place.cast("int"))).alias("node"),
        "g", "root", "tokens", "t")


def _dense(rows: DataFrame) -> DataFrame:
    """rows with `dense`: whether a fifth of the node is one component, which tokens won't split."""
    main = (rows.groupBy("node", "root").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("node").agg(F.max("c").alias("c")))
    return rows.join(main, "node").withColumn("dense", 5 * F.col("c") >= F.col("n")).drop("c")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Large nodes as pairs of blocks of NODE elements: every two elements meet in one of them."""
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / NODE).cast("int")).withColumn(
        "own", F.pmod(F.xxhash64("g"), F.col("blocks").cast("bigint")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    half = (F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0)
            .otherwise(1))
    return rows.select(F.xxhash64("node", F.least("own", "with"), F.greatest("own", "with"))
                       .alias("node"), "g", "root", half.alias("half"), "t")


def compared_nodes(elements: DataFrame, branches: DataFrame) -> DataFrame:
    """(node, g, root, half, t, whole): nodes in which elements of different components are compared.

    elements: g, root, tokens; branches: node, g, t (the tree) at the roots of the trees. whole has a
    bit for each tree in which the element's root node is compared as it is, not branched.
    """
    def ready(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("n") <= NODE).select("node", "g", "root", F.lit(2).alias("half"), "t")

    rows = save(_mixed_nodes(branches.join(elements.select("g", "root", "tokens"), "g")))
    parts, roots = [ready(rows)], [ready(rows).select("g", "t")]
    for depth in range(DEPTH + 1):
        large = rows.where(F.col("n") > NODE)
        if large.isEmpty():
            break
        large = save(_dense(large))
        stays = F.col("dense") | F.lit(depth == DEPTH)
        parts.append(_block_pairs(large.where(stays)))
        if depth == 0:
            roots.append(large.where(stays).select("g", "t"))
        rows = save(_mixed_nodes(_branch(large.where(~stays))))
        parts.append(ready(rows))
    nodes, whole = parts[0], roots[0]
    for more in parts[1:]:
        nodes = nodes.unionByName(more)
    for more in roots[1:]:
        whole = whole.unionByName(more)
    bits = whole.groupBy("g").agg(F.expr("bit_or(shiftleft(1, t))").alias("whole"))
    return nodes.join(bits, "g", "left").withColumn("whole", F.coalesce("whole", F.lit(0)))


def _links(elements: DataFrame, branches: DataFrame, sets: DataFrame, least: float,
           percent: int) -> DataFrame:
    """Links (a, b) that join the elements' components, confirmed on full sets."""
    # first round: each element with the first of its nodes, the best two
    stars = branches.where("g <> lead").select(
        F.col("g").alias("a"), F.col("lead").alias("b"), F.col("lead_doc").alias("doc")).distinct()
    close = estimated(stars.select("a", "b"), elements, least)
    close = close.join(elements.select(F.col("g").alias("b"), "doc"), "b")
    best = close.groupBy("a").agg(
        F.min(F.when(F.col("estimate") >= SAFE, F.struct("doc", "b")))["b"].alias("first"),
        F.max(F.struct("estimate", "b"))["b"].alias("most"))
    tried = save(best.select("a", F.explode(F.array_distinct(F.array("first", "most"))).alias("b"))
                 .where("b IS NOT NULL"))
    links = save(confirm(tried, sets, percent))
    roots = connected_components(links)
    # second round: all pairs of different components that share a node
    rooted = save(elements.join(roots.withColumnRenamed("node", "g"), "g", "left")
                  .withColumn("root", F.coalesce("root", "g")))
    nodes = compared_nodes(rooted, branches.select("node", "g", "t"))
    looks = rooted.select("g", "sketch", F.slice("tokens", 1, TREES).alias("first"))
    close = save(suspects(nodes.join(looks, "g"), least))
    more = confirm_nodes(close.join(sets, "g"), percent)
    return links.unionByName(save(more))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                    shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, g, h, component_id and kept of every row.

    component_id is the least id reachable over links of at least percent similarity; kept says that
    it is the row's own. g names the row's set (null if empty), h is the md5 of its text.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
                       F.col(f"`{text}`").alias("text"), F.md5(F.col(f"`{text}`")).alias("h"))
    least = lowest_estimate(percent / 100)
    sketched = save(sketch_documents(docs, shingle))
    elements = save(sketched.where("g IS NOT NULL").groupBy("g").agg(
        F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("doc"),
        F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")))
    branches = elements.select("g", "doc", F.posexplode(F.slice("tokens", 1, TREES)).alias("t", "x"))
    branches = branches.select(F.xxhash64("t", "x").alias("node"), "g", "doc", "t")
    shared = (branches.groupBy("node")
              .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "g")).alias("lead"))
              .where("n > 1").select("node", "lead.g", "lead.doc"))
    branches = save(branches.drop("doc").join(
        shared.select("node", F.col("g").alias("lead"), F.col("doc").alias("lead_doc")), "node"))
    sets, name = bucketed(needed_sets(docs, branches.select("g").distinct(), shingle), "g")
    try:
        links = _links(elements, branches, sets, least, percent)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    roots = connected_components(links)
    found = elements.select("g", "doc").join(roots.withColumnRenamed("node", "g"), "g", "left")
    found = found.withColumn("root", F.coalesce("root", "g"))
    first = found.groupBy("root").agg(F.min("doc").alias("first"))
    component = found.join(first, "root").select("g", "first")
    out = sketched.select("doc_id", "n_shingles", "g", "h").join(component, "g", "left")
    own = F.coalesce("doc_id", F.lit(-(1 << 63)))
    first = F.when(F.col("g").isNull(), own).otherwise(F.col("first"))
    return out.select("doc_id", "n_shingles", "g", "h",
                      F.nullif(first, F.lit(-(1 << 63))).alias("component_id"),
                      (own == first).alias("kept"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5,
             percent: int = 80) -> DataFrame:
    """docs with one row of each component: of its least id, and of rows alike in id and set one.

    Rows without words have no component and all stay.
    """
    judged = near_duplicates(docs, id_column, text, shingle, percent).where("kept")
    key, digest, times = (free_name(docs, c) for c in ("kept_id", "kept_h", "kept_times"))
    won = judged.where("g IS NOT NULL").groupBy("doc_id", "g").agg(
        F.min(F.struct("h", F.lit(1).alias("one")))["h"].alias("h"), F.count(F.lit(1)).alias("n"))
    won = won.groupBy("doc_id", "h").agg(F.max("n").alias("n"))
    # rows without words are told apart from those by their digest, and stay however often they occur
    bare = judged.where("g IS NULL").select("doc_id", "h", F.lit(1).alias("n")).distinct()
    keep = save(won.unionByName(bare).select(
        F.col("doc_id").alias(key), F.coalesce("h", F.lit("")).alias(digest), F.col("n").alias(times)))
    rows = docs.withColumn(digest + "2", F.coalesce(F.md5(F.col(f"`{text}`")), F.lit("")))
    found = rows.join(keep, F.col(f"`{id_column}`").cast("bigint").eqNullSafe(F.col(key))
                      & (F.col(digest + "2") == F.col(digest)))
    repeated = found.where(F.col(times) > 1).dropDuplicates([key, digest])
    return found.where(F.col(times) == 1).unionByName(repeated).select(
        *[F.col(f"`{c}`") for c in docs.columns])
