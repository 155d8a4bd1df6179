"""Running sums that do not put one key's rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.staging import RANGE, staged, staged_ranges


def running_sum(rows: DataFrame, key: str | Sequence[str], order: Sequence[str], value: str,
                out: str, carried: DataFrame | None = None, last: Sequence[str] = ()) -> DataFrame:
    """Sum of `value` over the rows of the same `key` up to each row, in the given order.

    Together with the key, `order` is unique. Rows are cut into even ranges of (key, order), so a
    key of any size, or a day of it, lies in as many ranges as it needs. Sums run within a range,
    and a range starts from what its first key adds up to in the ranges before, the only key it
    can share with them. Only these sums, one per range and key, meet in a window.

    `carried` (`key`, `value`) is what each key starts from: rows that sort before the key's others,
    so null keys work and no row is joined by its key.

    Columns of the key that are `last` come after the order instead. Rows that are alike but for these, like
    an item's lines in several reports, then lie side by side, where they are stored as one and little more;
    a range shares its first key with others once per value of `last`.
    """
    keys = [key] if isinstance(key, str) else list(key)
    kind = T.DecimalType(38, rows.schema[value].dataType.scale)
    tagged, amount = rows.withColumn("_is_row", F.lit(1)), F.col(value)
    if carried is not None:
        # openings may be wider than an item's amount, which is shuffled as narrow as it comes
        wide = T.DecimalType(28, kind.scale)
        tagged = tagged.unionByName(
            carried.select(*keys, F.col(value).cast(wide).alias("_carried"),
                           F.lit(0).alias("_is_row")), allowMissingColumns=True)
        amount = F.coalesce("_carried", F.col(value).cast(wide))
    leading = [k for k in keys if k not in last]
    ranged = staged_ranges(tagged, *leading, "_is_row", *order, *last)
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    shared = (ranged.groupBy(RANGE, *keys).agg(F.sum(amount).alias("_sum"))
              .withColumn("_before", F.sum("_sum").over(before)).where("_before IS NOT NULL")
              .select(RANGE, F.struct(*keys).alias("_first"), "_before"))
    upto = (Window.partitionBy(RANGE, *keys).orderBy("_is_row", *order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.struct(*keys).eqNullSafe(F.col("_first"))
    offset = F.when(own, F.col("_before"))
    summed = ranged.withColumn("_so_far", F.sum(amount).over(upto)).where("_is_row = 1").drop("_carried")
    if last:
        # a few rows a range, known to be few once they are staged
        first = staged(shared).withColumnRenamed(RANGE, "_shared")
        joined = summed.join(first, (F.col(RANGE) == F.col("_shared")) & own, "left").drop("_shared")
    else:
        joined = summed.join(shared, RANGE, "left")
    return (joined.withColumn(out, F.col("_so_far").cast(kind) + F.coalesce(offset, F.lit(0).cast(kind)))
            .drop("_is_row", "_so_far", "_first", "_before", RANGE))


def running_balance(lines: DataFrame, key: str, carried: DataFrame | None = None,
                    date: str = "date", unique_id: str = "move_line_id") -> DataFrame:
    """Lines with `cumul_balance`: what they carry in plus the balance so far, by date and id."""
    if carried is not None:
        carried = carried.select(F.col("report_object_id").alias(key), "balance")
    return running_sum(lines, key, [date, unique_id], "balance", "cumul_balance", carried)
