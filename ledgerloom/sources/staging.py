"""Intermediate results in the folder all executors share.

What several parts of a report read is written once and read back: it is computed once, its lineage ends
there, and a lost executor costs the files' readers nothing. The folders are named by `shared_folder` and
stay until the cluster cleans that folder up, as results made from them are lazy.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = "_range"
ROWS_PER_TASK = 500_000
COMPILED = 8000         # bytes of a method up to which the JVM compiles it; beyond, it interprets it
TASK_BYTES = 32 << 20   # of a shuffle, up to which small tasks are merged into one
CODEC = "zstd"          # a third smaller than the default, at the same speed


def shared_folder(spark: SparkSession) -> str:
    """A new folder name in the folder all executors share: ``spark.checkpoint.dir``, or the
    warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Tasks for a shuffle of so many wide rows, each small enough to be sorted in memory; None where
    the session's own number will do."""
    tasks = -(-rows // ROWS_PER_TASK)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


@contextmanager
def at_least(spark: SparkSession, tasks: int | None) -> Iterator[None]:
    """While this holds, scans and shuffles have so many tasks, where there are rows enough for them;
    with None, the session's own number. Operators whose common code the JVM would not compile run one by
    one: interpreted, it takes ten times as long."""
    values = {"spark.sql.codegen.hugeMethodLimit": COMPILED}
    if tasks is not None:
        values |= {"spark.sql.shuffle.partitions": tasks, "spark.sql.files.minPartitionNum": tasks,
                   "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES}
    before = {n: spark.conf.get(n, None) for n in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def staged(df: DataFrame, **options: str) -> DataFrame:
    """df, written and read back."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", CODEC).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_ranges(df: DataFrame, *order: str) -> DataFrame:
    """df with `_range`, the number of the range of `order` a row lies in; ranges are of even size.

    Rows are shuffled by range once. They are stored in buckets by range, so that what is grouped, sorted
    or joined by range does not shuffle them again.
    """
    spark, name = df.sparkSession, f"staged_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id())
     .write.option("path", shared_folder(spark)).option("compression", CODEC).bucketBy(buckets, RANGE).saveAsTable(name))
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")              # the files stay, and the frame knows their buckets
    return rows
