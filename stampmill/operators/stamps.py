"""Small helpers on the stamp table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def planes_from_mask(df: DataFrame) -> DataFrame:
    """One boolean array column per plane of the map that all rows share; a second map is an error."""
    maps = df.where("planes IS NOT NULL").select(F.array_sort(F.map_entries("planes")).alias("planes")).distinct().limit(2).collect()
    if not maps:
        raise ValueError("no stamps")
    if len(maps) > 1:
        raise ValueError("the stamps have different plane maps; unpack each kind on its own")

    def is_set(bit):
        return lambda bits: F.shiftright(bits, bit).bitwiseAND(F.lit(1)) == 1

    for name, bit in maps[0]["planes"]:
        df = df.withColumn(name, F.transform("mask", is_set(bit)))
    return df
