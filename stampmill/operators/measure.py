"""Measures of a stamp set: noise, transform settings, pixel statistics, reports."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stampmill.cuts import TransformSettings
from stampmill.functions import arrays as A
from stampmill.functions.flux import QUARTILE_SPREAD, SKY_SLOPE, as_column, finite, sky_level, soften
from stampmill.functions.types import DOUBLE, LONG, arrow_function, struct
from stampmill.operators.histograms import Stream, Summary, summarise
from stampmill.operators.quantiles import exact_quantiles

STAT_PERCENTILES = (0.1, 1, 16, 50, 84, 99, 99.9)
SIGMA_FLOOR, SCATTER_SHARE = 1e-3, 0.05
SHELL_OVERLAP = 0.5
WIDEST_RATIO, TINY = 2.0**20, 1e-30


def percent_name(p: float) -> str:
    return "p" + f"{p:g}".replace(".", "_")


def faint_spread(image: Column) -> Column:
    """Gaussian sigma from the faint quarter of a stamp's pixels."""
    ordered = F.sort_array(A.doubles(image))
    return (A.quantile_of(ordered, 0.25) - A.quantile_of(ordered, 0.05)) / QUARTILE_SPREAD


def pooled_sky_noise(pooled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Median over stamps of the faint spread, finite and positive ones only; none at all is an error."""
    spread = pooled.select(*by, faint_spread(F.col("image")).alias("v")).where(finite(F.col("v")) & (F.col("v") > 0))
    found = exact_quantiles(spread, "v", (0.5,), by=by, keep=True).where("n > 0")
    if found.isEmpty():
        raise ValueError("no stamp has a measurable sky noise")
    return found.select(*by, F.col("n").alias("n_stamps"), F.element_at("q", 1).alias("pooled_noise"))


def measure_transform(pooled: DataFrame, meta: DataFrame, cfg: TransformSettings, pool_factor: int) -> DataFrame:
    """One row: softening and the ratio of measured pooled noise to native noise over the factor."""
    native = exact_quantiles(meta, "sky_noise", (0.5,)).first()
    if native is None or not native["n"] or not native["q"][0] > 0:
        raise ValueError("the stamps' sky_noise is not positive")
    naive = native["q"][0] / pool_factor
    return pooled_sky_noise(pooled).select(
        "pooled_noise",
        (F.lit(float(cfg.softening_sigma)) * F.col("pooled_noise")).alias("softening"),
        (F.col("pooled_noise") / naive).alias("pooled_noise_ratio"),
    )


def check_softening(softening: float | Column, measured: DataFrame, softening_sigma: float) -> DataFrame:
    """Add `implied_sigma`; fails when the stated softening is not near the stated sigma."""
    implied = as_column(softening) / F.col("pooled_noise")
    share = implied / softening_sigma
    stale = F.raise_error(F.lit("softening disagrees with softening_sigma; clear one of them")).cast("double")
    return measured.withColumn("implied_sigma", F.when((share > 0.8) & (share < 1.25), implied).otherwise(stale))


def input_offset(softening: Column, softening_sigma: Column, floor_sigma: Column) -> Column:
    """Typical sky level in x; 0 when the softening is not measured."""
    on = (floor_sigma > 0) & (softening_sigma > 0)
    floor = F.when(on, floor_sigma * softening / F.when(softening_sigma > 0, softening_sigma)).otherwise(F.lit(0.0))
    return F.when(softening > 0, F.log(soften(F.lit(0.0), softening, floor))).otherwise(F.lit(0.0))


def scatter_check(stats: DataFrame, cfg: TransformSettings) -> DataFrame:
    """Predicted scatter of raw unfloored sky, and whether the measured one is plausible."""
    predicted = SKY_SLOPE / cfg.softening_sigma
    low = 0.0 if (cfg.sky_smooth_pixels > 0 or cfg.floor_sigma > 0) else 0.5 * predicted
    plausible = (F.col("sky_scatter") >= low) & (F.col("sky_scatter") < 2.0 * predicted)
    return stats.withColumn("predicted_scatter", F.lit(predicted)).withColumn(
        "verdict", F.when(plausible, "plausible").otherwise("far from the prediction"))


def _told(df: DataFrame, by: tuple[str, ...], rows: dict[tuple, list], columns: str) -> DataFrame:
    """Rows by group as a frame; a set without groups always has one row."""
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)
    return df.sparkSession.createDataFrame([(*key, *values) for key, values in rows.items()], keys + columns)


def set_stats(df: DataFrame, pool_factor: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (per group) of statistics of log-space pixels, from one scan of the images and what it leaves open.

    `image` is x. With `flux` (pooled flux) and `sky_noise` the deepest flux in sky sigma is added.
    """
    streams = [Stream("pixels", tuple(p / 100 for p in STAT_PERCENTILES)), Stream("ranges", (0.99,))]
    deep = {"flux", "sky_noise"} <= set(df.columns)
    if deep:
        df = df.withColumn("noise", F.col("sky_noise").cast("double") / pool_factor)
        streams.append(Stream("deepest"))
    found = summarise(df.select(*by, "image", *(["flux", "noise"] if deep else [])), streams, by)
    names = ["mean", "std", "min", "max", "skew", *[percent_name(p) for p in STAT_PERCENTILES], "per_patch_range_p99", "sky_scatter"]
    rows = {}
    for key, (x, r, *rest) in found.items():
        q = x.quantiles or [None] * len(STAT_PERCENTILES)
        scatter = (q[4] - q[2]) / 2 if x.quantiles else None
        rows[key] = [r.n, x.mean, x.std, x.least, x.most, x.skew, *q, *(r.quantiles or [None]), scatter, *[d.least for d in rest]]
    return _told(df, by, rows, "n_stamps bigint, " + ", ".join(f"{n} double" for n in names) + (", deepest_flux_sigma double" if deep else ""))


def sample_report(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """x: mean, std, range and non-finite count; flux: median and maximum."""
    found = summarise(df.select(*by, "image"), [Stream("finite"), Stream("exponentials", (0.5,))], by)
    rows = {}
    for key, (x, flux) in found.items():
        most = None if x.most is None else math.exp(x.most) if x.most < 709 else math.inf
        rows[key] = [x.mean, x.std, x.least, x.most, x.skipped, most, flux.quantiles[0] if flux.quantiles else None]
    return _told(df, by, rows, "mean double, std double, min double, max double, n_nonfinite bigint, flux_max double, flux_median double")


def shared_range(df: DataFrame, column: str = "image", by: tuple[str, ...] = ()) -> DataFrame:
    """0.5 and 99.5 percentiles of all finite pixels together; (0, 1) when there are none."""
    found = summarise(df.select(*by, F.col(column).alias("image")), [Stream("pixels", (0.005, 0.995))], by)
    found = found or ({} if by else {(): [Summary()]})
    return _told(df, by, {key: x.quantiles or [0.0, 1.0] for key, (x,) in found.items()}, "low double, high double")


def sigma_range(df: DataFrame, rule: str = "pairs") -> DataFrame:
    """Add sigma_min and sigma_max from the statistics (and `pair_max`) on each row."""
    if rule not in ("pairs", "per-pixel"):
        raise ValueError(f"rule must be 'pairs' or 'per-pixel', not {rule!r}")
    if rule == "pairs" and "pair_max" not in df.columns:
        raise ValueError("the pairs rule needs the largest pair distance")
    high = F.col("pair_max") if rule == "pairs" else F.greatest(2.0 * F.col("std"), F.col("per_patch_range_p99"))
    return df.withColumn("sigma_min", F.greatest(F.lit(SIGMA_FLOOR), SCATTER_SHARE * F.col("sky_scatter"))).withColumn("sigma_max", high)


_ERF = np.vectorize(math.erf, otypes=[float])


def _shell_ratios(dims: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Ratio of neighbouring noise levels whose shells overlap by half, by Newton's method on the overlap.

    In d dimensions a shell is sqrt(d) deep and 3 wide to either side. Up to 9 dimensions shells overlap
    by more at any ratio, so the largest ratio stands.
    """
    ratios = np.full(len(dims), WIDEST_RATIO)
    root = np.sqrt(dims[dims > 9])
    # Where the lower edge meets the middle of the next shell the overlap is close to a half already.
    g = root / (root - 3)
    for _ in range(rounds):
        edges = [root * (g - 1) + side * 3 * g for side in (1, -1)]
        overlap = (_ERF(edges[0] / math.sqrt(2)) - _ERF(edges[1] / math.sqrt(2))) / 2 if len(root) else root
        slope = (np.exp(-edges[0] ** 2 / 2) * (root + 3) - np.exp(-edges[1] ** 2 / 2) * (root - 3)) / math.sqrt(2 * math.pi)
        g = g - (overlap - SHELL_OVERLAP) / slope
    ratios[dims > 9] = np.minimum(g, WIDEST_RATIO)
    return ratios


@arrow_function(struct(gamma=DOUBLE, n_steps=LONG))
def _steps(dim: pd.Series, sigma_min: pd.Series, sigma_max: pd.Series) -> pd.DataFrame:
    known, which = np.unique(dim.to_numpy(float), return_inverse=True)
    gamma = _shell_ratios(known)[which]
    span = np.log(np.maximum(sigma_max.to_numpy(float), TINY)) - np.log(np.maximum(sigma_min.to_numpy(float), TINY))
    return pd.DataFrame({"gamma": gamma, "n_steps": np.ceil(np.maximum(span / np.log(gamma), 1.0)).astype(np.int64)})


def n_steps(df: DataFrame) -> DataFrame:
    """Add gamma and n_steps: the coarsest ladder whose neighbouring noise shells overlap by half."""
    return df.withColumn("_n", _steps(F.col("dim").cast("double"), "sigma_min", "sigma_max")).select("*", "_n.*").drop("_n")


def sky_levels(df: DataFrame, softening: float, floor: Column) -> DataFrame:
    return df.withColumn("sky_level", sky_level(softening, floor))
