"""Reading a training run's log: loss by noise level, running mean, checkpoint rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from stampmill.operators.lineage import settle
from stampmill.operators.ordering import global_row_number

SEGMENT_ROWS = 4096
DOUBLE_DECADES = 640  # between the largest and the smallest positive double


def loss_by_sigma(df: DataFrame, keys: tuple[str, ...] = ("step", "sigma")) -> DataFrame:
    """Mean loss and its standard error per noise level."""
    return df.groupBy(*keys).agg(
        F.avg("loss").alias("loss_by_sigma"), (F.stddev_pop("loss") / F.sqrt(F.count("loss").cast("double"))).alias("loss_by_sigma_err"),
        F.count("loss").alias("n"))


def _faded_sum(df: DataFrame, by: list, at: str, value: Column, keep: float, name: str) -> DataFrame:
    """Running sum over `at` (0, 1, ...) within `by`, all earlier values faded by `keep` for each step between."""
    running = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    grown = F.sum(value * F.pow(F.lit(keep), -F.col(at))).over(running)
    return df.withColumn(name, grown * F.pow(F.lit(keep), F.col(at)))


def ewma(df: DataFrame, key: str, order: str, value: str, alpha: float = 0.02, name: str = "loss_ema", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Running mean per key: the first value, then (1 - alpha) * previous + alpha * value.

    Each stretch of a series is a map (decay, sum) from the mean before it to the mean after it, and maps of
    stretches in a row compose. So a series is cut into short segments, each summed on its own, their ends are
    composed within blocks of segments, and the ends of blocks with as many earlier ones as a double can tell
    from zero. No row is made beyond the input, and no series is ever held in one task.
    """
    keep = 1.0 - alpha
    if not 0 < keep < 1:
        raise ValueError("alpha must lie strictly between 0 and 1")
    fade = -math.log10(keep)
    # No factor within a segment or a block leaves 200 decades.
    rows = max(1, min(segment_rows, int(200 / fade)))
    segments = max(1, min(segment_rows, int(200 / (fade * rows))))
    blocks = math.ceil(DOUBLE_DECADES / (fade * rows * segments))
    numbered = global_row_number(df.select(key, order, value), key, order, name="_rn")
    first = numbered.groupBy(key).agg(F.min("_rn").alias("_from"))
    placed = numbered.join(first, key).withColumn("_at", F.col("_rn") - F.col("_from")).drop("_from", "_rn")
    placed = placed.withColumn("_seg", F.floor(F.col("_at") / rows)).withColumn("_k", F.col("_at") % rows)
    # The first value counts whole, as if the mean had stood there before.
    weight = F.when(F.col("_at") == 0, 1.0).otherwise(alpha)
    inside = _faded_sum(placed, [key, "_seg"], "_k", weight * F.col(value), keep, "_in")
    ends = inside.where(F.col("_k") == rows - 1).select(key, F.col("_in").alias("_b"), F.floor(F.col("_seg") / segments).alias("_block"), (F.col("_seg") % segments).alias("_s"))
    ends = settle(_faded_sum(ends, [key, "_block"], "_s", F.col("_b"), keep**rows, "_end"))
    whole = ends.where(F.col("_s") == segments - 1).select(key, (F.col("_block") + 1).alias("_block"), "_end")
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(-min(blocks, 1 << 20) + 1, 0)
    decay = F.lit(keep ** (rows * segments))
    before = F.aggregate(F.collect_list("_end").over(earlier), F.lit(0.0), lambda total, end: total * decay + end)
    entering = whole.select(key, "_block", before.alias("_before"))
    # What enters a segment: the segments of its block before it, and the blocks before that.
    carried = ends.select(key, (F.col("_block") * segments + F.col("_s") + 1).alias("_seg"), F.when(F.col("_s") < segments - 1, F.col("_end")).otherwise(0.0).alias("_carry"))
    out = inside.withColumn("_block", F.floor(F.col("_seg") / segments)).join(carried, [key, "_seg"], "left").join(entering, [key, "_block"], "left")
    enters = F.coalesce("_carry", F.lit(0.0)) + F.coalesce("_before", F.lit(0.0)) * F.pow(F.lit(keep), (F.col("_seg") % segments) * rows)
    mean = F.col("_in") + enters * F.pow(F.lit(keep), F.col("_k") + 1)
    return out.select(key, order, value, mean.alias(name))


def checkpoint_rows(log: DataFrame, steps: int, n: int) -> DataFrame:
    """Log rows at n evenly spread steps, the last at `steps`; halves round to even."""
    if n <= 0 or steps <= 0:
        return log.limit(0)
    n = min(n, steps)
    at = log.sparkSession.range(1, n + 1).select(F.bround(F.lit(steps) * F.col("id") / n).cast("bigint").alias("step"))
    return log.join(at, "step", "left_semi")
