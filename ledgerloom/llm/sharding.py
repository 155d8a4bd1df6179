"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Each key has a hash with every shard, read as a number u in (0, 1); the record goes to the shard with
the least -ln(u) / weight (weighted rendezvous hashing). A shard's number alone decides its hash with
a key, so one more shard takes records only into itself, and a share of 1 / (shards + 1) at equal
weights.

Slots number the rows of a shard from 0 without gaps. Rows are counted per shard and input
partition, the counts are summed up per shard, and rows are numbered within shard and input
partition, so that no task holds a shard, whatever key is frequent.

Defined results: a null text has no bytes (size 1, crc32 0); a null key is a key like any other;
rows with equal keys share a shard and get different slots; an empty table gives no row; columns of
documents other than key and text take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.llm.common import save

SHARDS = 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")

    def cost(shard: int, weight: float) -> Column:
        # 53 bits and a half make a double in (0, 1), never 0 or 1
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(shard), key), 11) + F.lit(0.5)) / F.lit(2.0 ** 53)
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"),
                        F.lit(shard).cast("int").alias("shard"))

    return F.array_min(F.array(*[cost(i, w) for i, w in enumerate(weights)]))["shard"]


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    weights: Sequence[float] = (1.0,) * SHARDS,
                    grown_weight: float = 1.0) -> DataFrame:
    """Key, size, text_crc32, shard, slot and grown_shard (with one more shard) of every row."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    crc = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("bigint")
    rows = save(docs.select(
        F.col(key).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, grown_weight]).alias("grown_shard"),
        F.spark_partition_id().alias("part")))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = (W.Window.partitionBy("shard").orderBy("part")
              .rowsBetween(W.Window.unboundedPreceding, -1))
    counts = counts.select("shard", "part",
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = (W.Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return (rows.withColumn("row", F.row_number().over(within))
            .join(counts, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("offset") + F.col("row") - 1).cast("bigint").alias("slot"),
                    "grown_shard"))
