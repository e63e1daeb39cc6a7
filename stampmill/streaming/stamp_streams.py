"""Gate stamps as files arrive; the manifest grows and the tallies stay current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stampmill.cuts import PatchCuts
from stampmill.operators.gate import gate
from stampmill.operators.manifest import rejection_counts
from stampmill.operators.spectra import merge_states, power_state


def manifest_rows(stamps: DataFrame, cuts: PatchCuts | None = None) -> DataFrame:
    judged = gate(stamps, cuts).drop("image", "variance", "mask", "planes")
    return judged.withColumn("status", F.when(F.size("reasons") == 0, "accepted").otherwise("rejected")).withColumn(
        "reasons", F.concat_ws(";", "reasons"))


def stream_extract(spark: SparkSession, source: str, out: str, schema, cuts: PatchCuts | None = None, files_per_batch: int = 64):
    """Start a query that gates new files under `source` and stops when it has seen them all.

    Every batch writes its own folder, so a batch run again after a failure replaces itself.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def judge(batch: DataFrame, batch_id: int) -> None:
        rows = f"{out}/manifest/batch={batch_id}"
        manifest_rows(batch, cuts).write.mode("overwrite").parquet(rows)
        written = batch.sparkSession.read.parquet(rows)
        rejection_counts(written).write.mode("overwrite").parquet(f"{out}/tallies/batch={batch_id}")

    return arriving.writeStream.foreachBatch(judge).option("checkpointLocation", f"{out}/_progress").trigger(availableNow=True).start()


def manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/manifest")


def tallies(spark: SparkSession, out: str) -> DataFrame:
    """Rejections by reason over all batches so far."""
    return spark.read.parquet(f"{out}/tallies").groupBy("reason").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "reason")


def add_to_total(batch: DataFrame, batch_id: int, out: str, size: int) -> None:
    """Add a batch's summed spectrum to the total of all batches before it.

    Two places take turns: a batch reads the one that it does not write, so it can be run again after a failure
    and adds once, and the disk holds two totals however many batches there are.
    """
    total = power_state(batch, size)
    if batch_id > 0:
        total = merge_states(total, batch.sparkSession.read.parquet(_turn(out, batch_id - 1)).drop("batch"))
    total.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(_turn(out, batch_id))


def _turn(out: str, batch_id: int) -> str:
    return f"{out}/total/turn={batch_id % 2}"


def stream_acf(spark: SparkSession, source: str, out: str, schema, size: int, files_per_batch: int = 64):
    """Keep the summed spectrum of all stamps seen so far."""
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def add(batch: DataFrame, batch_id: int) -> None:
        add_to_total(batch, batch_id, out, size)

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/_progress").trigger(availableNow=True).start()


def running_state(spark: SparkSession, out: str) -> DataFrame:
    """The newest total."""
    totals = spark.read.parquet(f"{out}/total")
    last = totals.agg(F.max("batch")).first()[0]
    return totals.where(F.col("batch") == last).drop("batch", "turn")
