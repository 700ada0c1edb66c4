"""Running sums and ordered folds that hold up when one key owns a third of the log.

A plain window over a hot key sorts that key's whole history in one task. Here a history is cut into time slices: rows
are ranked inside (key, slice), slices are summed with map-side combine, and only the few slice totals of a key are
scanned in order. A slice is an hour; the hours in which a key has more than `HOT_ROWS` rows are cut into seconds, found by a
count combined on the map side. `slice_by` replaces that and must follow the row order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


HOT_ROWS = 100_000


def hour_slice(ts: str = "ts") -> Column:
    return F.date_trunc("HOUR", F.col(ts).cast("timestamp"))


def sliced(df: DataFrame, keys: list[str], ts: str, slice_by: Column | None, hot_rows: int) -> DataFrame:
    """`df` with `_slice`: the hour of a row, or its second where its key is hot in that hour."""
    if slice_by is not None:
        return df.withColumn("_slice", slice_by)
    hours = df.withColumn("_hour", hour_slice(ts))
    hot = hours.groupBy(*keys, "_hour").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], F.col("_hour").alias("_h_hour"), F.lit(True).alias("_hot"))
    same = reduce(lambda a, b: a & b, [hours[k].eqNullSafe(hot[f"_h_{k}"]) for k in keys], hours["_hour"].eqNullSafe(hot["_h_hour"]))
    second = F.date_trunc("SECOND", F.col(ts).cast("timestamp"))
    return hours.join(hot, same, "left").withColumn("_slice", F.when(F.col("_hot"), second).otherwise(F.col("_hour"))).select(*df.columns, "_slice")


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, slice_by: Column | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """`df` plus `name` = sum of `value` over the rows of the same key up to this one. NULL keys count as equal."""
    cut = sliced(df.withColumn("_v", value), keys, order[0], slice_by, hot_rows)
    totals = cut.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.col("_slice").alias("_o_slice"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"),
    )
    same = reduce(
        lambda a, b: a & b, [cut[k].eqNullSafe(offsets[f"_o_{k}"]) for k in keys], cut["_slice"] == offsets["_o_slice"]
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = cut.withColumn("_inside", F.sum("_v").over(inside))
    return ranked.join(offsets, same).withColumn(name, F.col("_inside") + F.col("_before")).select(*df.columns, name)


def decayed_sum(
    df: DataFrame, keys: list[str], order: list[str], value: Column, rate: float, slice_by: Column | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per key: `n`, `n_pos`, `n_neg` and `w`, the result of w <- w + rate * (value - w) over the ordered rows from 0.

    The recurrence has the closed form sum(rate * (1 - rate)^(rows after this one) * value); the exponent is split into
    the rows after it in its own slice and the rows of later slices.
    """
    cut = sliced(df.withColumn("_v", value), keys, order[0], slice_by, hot_rows)
    newest_first = Window.partitionBy(*keys, "_slice").orderBy(*[F.col(o).desc() for o in order])
    keep = F.lit(1.0 - rate)
    per_slice = (
        cut.withColumn("_after", F.row_number().over(newest_first) - 1)
        .groupBy(*keys, "_slice")
        .agg(
            F.count("*").alias("_n"),
            F.count_if(F.col("_v") > 0).alias("_pos"),
            F.count_if(F.col("_v") < 0).alias("_neg"),
            F.sum(rate * F.pow(keep, F.col("_after")) * F.col("_v")).alias("_w"),
        )
    )
    later = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    return (
        per_slice.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0)))
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("n"),
            F.sum("_pos").alias("n_pos"),
            F.sum("_neg").alias("n_neg"),
            F.sum(F.col("_w") * F.pow(keep, F.col("_later"))).alias("w"),
        )
    )
