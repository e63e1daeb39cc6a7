"""Global row numbers, prefix sums and seeded sampling without a one-task window."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from stampmill.functions.draws import draw
from stampmill.operators.lineage import settle

_OFFSET_BITS = 33  # monotonically_increasing_id keeps the in-partition row number below this


def _range_sorted(df: DataFrame, order) -> DataFrame:
    """Range-sorted rows with their partition and offset fixed by a checkpoint."""
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = settle(placed)
    return placed.withColumn("_part", F.shiftright("_at", _OFFSET_BITS))


def _before(totals: DataFrame, value: str) -> DataFrame:
    """Running total before each partition. One row per partition, so one task is enough."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("_before"))


def global_row_number(df: DataFrame, *order, name: str = "row_index") -> DataFrame:
    """Row number from 0 in a total order. `order` must be unique; keep `df` narrow.

    The rows are range-sorted once; only per-partition counts are summed in one place.
    """
    placed = _range_sorted(df, order)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offset = F.col("_at").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))
    return (
        placed.join(F.broadcast(_before(counts, "_n")), "_part")
        .withColumn(name, (F.col("_before") + offset).cast("bigint"))
        .drop("_part", "_at", "_before")
    )


def global_prefix_sum(df: DataFrame, *order, value: str, name: str) -> DataFrame:
    """Sum of `value` over all rows before this one in a total order, in two levels."""
    placed = _range_sorted(df, order)
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_n"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(_before(totals, "_n")), "_part")
        .withColumn(name, F.col("_before") + F.col("_in"))
        .drop("_part", "_at", "_before", "_in")
    )


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """First n rows; with no order, any n rows."""
    return (df.orderBy(*order) if order else df).limit(n)


def sample_n(df: DataFrame, n: int, seed, key: str) -> DataFrame:
    """n rows without replacement, in key order: those with the smallest draws. `key` is unique.

    Of many rows only those whose draw could be among the n smallest are ordered, so what meets in
    one place is about n rows however large the table. Too few such rows is all but impossible, is
    checked, and falls back to ordering them all.
    """
    drawn = df.withColumn("_h", draw(seed, key))
    total = df.count()
    share = min((n + 10 * math.sqrt(n) + 100) / max(total, 1), 1.0)
    near = drawn.where(F.col("_h") < int(share * (1 << 60)))
    if near.count() >= min(n, total):
        drawn = near
    return drawn.orderBy("_h", key).limit(n).drop("_h").orderBy(key)


def sample_with_replacement(df: DataFrame, n: int, seed, key: str) -> DataFrame:
    """n independent uniform draws over the whole set, as (draw_index, key)."""
    numbered = global_row_number(df.select(key), key)
    total = numbered.count()
    if total == 0:
        raise ValueError("cannot sample from an empty set")
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw_index"), F.pmod(draw(seed, "id"), F.lit(total)).alias("row_index")
    )
    return draws.join(numbered, "row_index").select("draw_index", key)


def half_splits(df: DataFrame, repeats: int, seed, key: str) -> DataFrame:
    """(repeat_index, key, half): a shuffled split per repeat; an odd last row is dropped."""
    if repeats < 1:
        raise ValueError("need at least one split")
    n = df.count()
    spread = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat_index"))
    spread = spread.withColumn("_h", draw(seed, "repeat_index", key))
    placed = global_row_number(spread, "repeat_index", "_h", key, name="_rn")
    place = F.col("_rn") - F.col("repeat_index") * F.lit(n)
    return (
        placed.withColumn("_p", place)
        .where(F.col("_p") < 2 * (n // 2))
        .select("repeat_index", key, F.when(F.col("_p") < n // 2, 0).otherwise(1).alias("half"))
    )
