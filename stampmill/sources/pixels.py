"""The pixel table: images by host and band, laid out by patch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stampmill.operators.keyed import fetch

LAYOUT = ("tract", "patch")


def by_patch(keys: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows in order of patch, host and band, dealt out by range, so that several tasks share a patch with most of the hosts."""
    order = (*LAYOUT, "host_id", "band_idx")
    return keys.repartitionByRange(tasks or keys.sparkSession.sparkContext.defaultParallelism, *order).sortWithinPartitions(*order)


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Write a pixel table that is in order `by_patch`, with a folder for each patch.

    Extraction walks whole patches, so a range of the walk reads only its own folders. Only keys need to be put in
    order, before their images are joined to them.
    """
    # Pixel values hardly repeat, so looking for a dictionary is lost time.
    noise = {f"parquet.enable.dictionary#{c}.list.element": "false" for c in ("image", "variance")}
    pixels.write.mode("overwrite").options(**noise).partitionBy(*LAYOUT).parquet(path)


def read_pixels(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table with the column types of `like`, folders included."""
    return spark.read.schema(like.schema).parquet(path)


def from_patches(pixels: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted hosts and bands, with the other columns of `wanted`.

    The wanted keys, a handful of numbers each, go to the pixels while a count shows them to be few; where the table is
    laid out by patch only the folders of wanted patches are opened then. Images stay where they are read.
    """
    on = [c for c in (*LAYOUT, "host_id", "band_idx") if c in pixels.columns]
    return fetch(pixels, wanted, on)
