"""Host and manifest tables, merging the parts of a campaign, and the run log."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

LOG_SCHEMA = """step bigint, loss double, loss_ema double, seconds double, event string, signal string, sigma array<double>,
    loss_by_sigma array<double>, loss_by_sigma_err array<double>, gaussian_floor array<double>, samples string, sample_seconds double,
    sample_mean double, sample_std double, sample_nonfinite bigint, sample_error string"""


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts; a column one part lacks is null there."""
    if not parts:
        raise ValueError("no parts to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_counters(counters: DataFrame) -> DataFrame:
    """Sum the additive numbers of all parts; `counters` is (part, block, name, value as text).

    Text that is not a number, and the part label itself, belong to one part only and are left out.
    """
    value = F.expr("try_cast(value as double)")
    return (
        counters.where((F.col("name") != "part") & value.isNotNull())
        .groupBy("block", "name").agg(F.sum(value).alias("total"), F.countDistinct("part").alias("n_parts"))
    )


def merge_parts(manifests: Sequence[DataFrame], hosts: Sequence[DataFrame], counters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return union_parts(manifests), union_parts(hosts), merge_counters(counters)


def read_run_log(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """JSON lines by kind: `step` rows have no event, the others go by its name."""
    log = spark.read.schema(LOG_SCHEMA).json(path)
    steps = log.where(F.col("event").isNull()).select("step", "loss", "loss_ema", "seconds")
    # A column an older log lacks pads with nulls.
    columns = [F.coalesce(F.col(c), F.array().cast("array<double>")).alias(c) for c in ("sigma", "loss_by_sigma", "loss_by_sigma_err", "gaussian_floor")]
    by_sigma = F.arrays_zip(*columns)
    evals = log.where("event = 'eval'").select("step", F.posexplode(by_sigma).alias("rung", "z")).select("step", "rung", "z.*").toDF("step", "rung", "sigma", "loss_by_sigma", "loss_by_sigma_err", "gaussian_floor")
    checkpoints = log.where("event = 'checkpoint'").select("step", "seconds", "samples", "sample_seconds", "sample_mean", "sample_std", "sample_nonfinite", "sample_error")
    stopped = log.where("event = 'stopped'").select("step", "signal", "seconds")
    return {"step": steps, "eval": evals, "checkpoint": checkpoints, "stopped": stopped}
