"""Exact interpolated quantiles that hold no more than a bounded table anywhere.

Spark's `percentile` keeps every distinct value of a group in one task. Above a row bound the
wanted order statistics are bracketed instead: each pass counts rows per bin inside the open
brackets, and a bracket closes when its bin holds a single value. Any value may be held by any
share of the rows; rows are only counted, never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from stampmill.functions.flux import finite

PERCENTILE_ROWS = 2_000_000
BINS = 1024


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    keep: bool = False,
    percentile_rows: int = PERCENTILE_ROWS,
) -> DataFrame:
    """One row per group: the keys, `n` finite values, and `q`, the array of quantiles.

    Groups are few (bands, panels, diagnostics); numpy's linear interpolation. The values are read
    two or more times: `keep` holds them (in memory, spilling to disk) meanwhile, for values that
    are one a stamp and costly to make again.
    """
    by = list(by)
    values = df.select(*by, F.col(value).cast("double").alias("_v")).where(finite(F.col("_v")))
    if keep:
        values = values.persist()
    try:
        return _quantiles(values, [float(p) for p in probs], by, percentile_rows)
    finally:
        if keep:
            values.unpersist()


def _quantiles(values: DataFrame, probs: list[float], by: list[str], percentile_rows: int) -> DataFrame:
    spark = values.sparkSession
    key_schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in values.select(*by).schema)
    schema = key_schema + "n bigint, q array<double>"
    biggest = values.groupBy(*by).count().agg(F.max("count").alias("m")).first()["m"] or 0
    if biggest <= percentile_rows:
        ordered = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("_v")).alias("s"))
        last = F.col("n") - 1
        low = [F.floor(F.lit(p) * last).cast("int") for p in probs]
        around = [F.array(F.get("s", k), F.get("s", F.least(k + 1, last.cast("int")))) for k in low]
        found = [(tuple(r[k] for k in by), r["n"], r["a"]) for r in ordered.select(*by, "n", F.array(*around).alias("a")).collect()]
        return spark.createDataFrame([(*key, n, [between(p, n, a, b) for p, (a, b) in zip(probs, pairs)] if n else None) for key, n, pairs in found], schema)

    bounds = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    groups = {tuple(r[k] for k in by): (r["n"], r["lo"], r["hi"]) for r in bounds.collect()}

    def count_bins(brackets):
        rows = [(*key, i, float(lo), float(hi)) for i, (key, lo, hi) in enumerate(brackets)]
        opened = spark.createDataFrame(rows, key_schema + "_id int, _lo double, _hi double")
        inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        if by:
            match = [F.col(f"v.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
            joined = values.alias("v").join(F.broadcast(opened.alias("b")), match + [inside])
        else:
            listed = F.array(*[F.struct(F.lit(r[0]).alias("_id"), F.lit(r[1]).alias("_lo"), F.lit(r[2]).alias("_hi")) for r in rows])
            joined = values.withColumn("_b", F.explode(listed)).select("_v", "_b.*").where(inside)
        binned = joined.withColumn("_bin", bin_of(F.col("_v"), F.col("_lo"), F.col("_hi")))
        counted = binned.groupBy("_id", "_bin").agg(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
        )
        return [(r["_id"], r["_bin"], r["n"], r["lo"], r["hi"]) for r in counted.collect()]

    found = refine(groups, probs, count_bins)
    rows = [(*key, groups[key][0], found[key]) for key in groups]
    return spark.createDataFrame(rows, schema)


def between(p: float, n: int, a: float, b: float) -> float:
    """The quantile between the two order statistics about it, however those were found."""
    at = p * (n - 1)
    return a + (b - a) * (at - math.floor(at))


def bin_of(v, lo, hi):
    """Bin of a value inside its bracket; monotone in the value, so counts add up to ranks."""
    width = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    return F.least(F.floor((v - lo) / width * F.lit(float(BINS))), F.lit(BINS - 1)).cast("int")


def _bin_of_rank(rank: int, below: int, bins) -> tuple[int, float, float]:
    """(values below it, least, greatest) of the bin that holds a rank; `below` values come before the first bin."""
    for _, n, first, last in bins:
        if rank < below + n:
            return below, first, last
        below += n
    raise ValueError("the bins do not reach the rank")


def refine(
    groups: dict[tuple, tuple[int, float, float]],
    probs: Sequence[float],
    count_bins: Callable[[list[tuple[tuple, float, float]]], list[tuple[int, int, int, float, float]]],
    counted: dict[tuple, list[tuple[int, int, float, float]]] | None = None,
) -> dict[tuple, list[float]]:
    """Quantiles per group from repeated bin counts.

    `groups` maps a key to (n, min, max). `count_bins` gets open brackets (key, lo, hi) and
    returns (bracket, bin, n, min, max) rows for the values inside them. `counted` has the bins
    (bin, n, min, max) of each whole group, in order, where they are known already.
    """
    wanted = {}
    for key, (n, lo, hi) in groups.items():
        for p in probs:
            at = p * (n - 1)
            wanted[(key, math.floor(at))] = (0, lo, hi)
            wanted[(key, min(math.floor(at) + 1, n - 1))] = (0, lo, hi)
    for key, rank in wanted if counted else ():
        wanted[(key, rank)] = _bin_of_rank(rank, 0, counted[key])
    while True:
        still = {w: b for w, b in wanted.items() if b[1] < b[2]}
        if not still:
            break
        brackets = sorted({(w[0], b[1], b[2]) for w, b in still.items()}, key=repr)
        place = {b: i for i, b in enumerate(brackets)}
        by_bracket: dict[int, list] = {}
        for bracket, bin_index, n, lo, hi in count_bins(brackets):
            by_bracket.setdefault(bracket, []).append((bin_index, n, lo, hi))
        for (key, rank), (below, lo, hi) in still.items():
            wanted[(key, rank)] = _bin_of_rank(rank, below, sorted(by_bracket[place[(key, lo, hi)]]))
    out = {}
    for key, (n, _, _) in groups.items():
        out[key] = []
        for p in probs:
            k = math.floor(p * (n - 1))
            out[key].append(between(p, n, wanted[(key, k)][1], wanted[(key, min(k + 1, n - 1))][1]))
    return out
