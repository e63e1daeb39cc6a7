"""Which stamp goes into which training batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stampmill.cuts import PatchSettings, TransformSettings
from stampmill.functions.draws import draw
from stampmill.operators.images import make_batch
from stampmill.operators.manifest import usable
from stampmill.operators.ordering import global_row_number


def batch_plan(df: DataFrame, batch_size: int, seed, epochs: int, sizes: Sequence[int], key: str) -> DataFrame:
    """(epoch, batch_id, slot, key, out_size): each epoch shuffled anew, the short last batch dropped.

    Sizes go round by the running batch number, so every batch holds one size.
    """
    n = df.count()
    if n < batch_size:
        raise ValueError(f"{n} stamps are fewer than a batch of {batch_size}")
    per_epoch = n // batch_size
    spread = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    spread = spread.withColumn("_h", draw(seed, "epoch", key))
    placed = global_row_number(spread, "epoch", "_h", key, name="_rn").withColumn("_at", F.col("_rn") - F.col("epoch") * n)
    placed = placed.where(F.col("_at") < per_epoch * batch_size)
    batch = F.col("epoch") * per_epoch + F.floor(F.col("_at") / batch_size)
    out = placed.select("epoch", batch.cast("bigint").alias("batch_id"), (F.col("_at") % batch_size).alias("slot"), key)
    size = F.element_at(F.array(*[F.lit(int(s)) for s in sizes]), (F.col("batch_id") % len(sizes) + 1).cast("int"))
    return out.withColumn("out_size", size)


def batches(df: DataFrame, plan: DataFrame, cfg: TransformSettings, patch: PatchSettings, key: str, seed=0, manifest: DataFrame | None = None) -> DataFrame:
    """The planned batches as rows (batch_id, slot, key, out_size, image), whatever their sizes, from one join of the stamps.

    With a manifest a plan that holds a stamp not usable under `patch` loses it; plan from `usable` stamps.
    """
    df = df if manifest is None else usable(df, patch, manifest)
    drawn = plan.where(F.col("out_size").isin([int(s) for s in patch.training_sizes])).withColumn("_draw", F.concat_ws(":", "batch_id", "slot"))
    made = make_batch(df.join(drawn, key), cfg, patch, "_draw", seed, augment=True, out_size=F.col("out_size"))
    return made.select("batch_id", "slot", key, "out_size", "image")
