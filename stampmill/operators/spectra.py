"""Autocorrelation and Fourier band power from sums that merge in any order."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stampmill.functions.arrays import each, square
from stampmill.functions.types import DOUBLES, LONG, LONGS, arrow_function, struct

SCALES = (1, 2, 4, 8, 16, 32)
STATE_SCHEMA = "mode bigint, power double, n_patches bigint, size int"


FAN_IN = 256


def _one_spectrum(partial: DataFrame) -> DataFrame:
    """Adds (n, power) rows, one from each task, in two levels; whole arrays move, never a row per mode."""

    def add(batches):
        n, total = 0, None
        for batch in batches:
            for count, power in zip(batch["n"], batch["power"]):
                n, total = n + int(count), np.asarray(power) if total is None else total + power
        if total is not None:
            yield pd.DataFrame({"n": [n], "power": [total]})

    for tasks in (min(FAN_IN, partial.sparkSession.sparkContext.defaultParallelism), 1):
        partial = partial.repartition(tasks).mapInPandas(add, "n bigint, power array<double>")
    return partial


def power_state(df: DataFrame, size: int, pad: int = 2, column: str = "image") -> DataFrame:
    """Summed power by Fourier mode of mean-free stamps: (mode, power, n_patches, size).

    Stamps with a non-finite pixel are skipped; one of another size fails the job. Each task sends
    one spectrum, whatever its share of the stamps.
    """

    def summed(batches):
        total, n = np.zeros((pad * size, pad * size // 2 + 1)), 0
        for batch in batches:
            for pixels in batch[column]:
                a = square(pixels)
                if a.shape != (size, size):
                    raise ValueError(f"expected {size} px stamps, got {a.shape}")
                if np.isfinite(a).all():
                    total += np.abs(np.fft.rfft2(a - a.mean(), s=(pad * size, pad * size))) ** 2
                    n += 1
        yield pd.DataFrame({"n": [n], "power": [total.ravel()]})

    whole = _one_spectrum(df.select(column).mapInPandas(summed, "n bigint, power array<double>"))
    return whole.select(F.posexplode("power").alias("mode", "power"), "n").select(
        F.col("mode").cast("bigint").alias("mode"), "power", F.col("n").alias("n_patches"), F.lit(size).alias("size"))


def merge_states(*states: DataFrame) -> DataFrame:
    """Sum of partial states; any grouping of the stamps gives the same."""
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy("mode").agg(F.sum("power").alias("power"), F.sum("n_patches").alias("n_patches"), F.max("size").alias("size"))


def autocorrelation(state: DataFrame, max_lag: int | None = None) -> DataFrame:
    """(lag, value, n_patches): the ring-averaged unbiased autocorrelation, 1 at lag 0.

    Works on the summed spectrum, whose size is that of one stamp.
    """

    @arrow_function(DOUBLES)
    def rings(power: pd.Series, n: pd.Series, size: pd.Series) -> pd.Series:
        def one(p, count, side):
            if not count:
                return []
            wide = 2 * side
            power_sum = np.asarray(p).reshape(wide, side + 1)
            ones = np.abs(np.fft.rfft2(np.ones((side, side)), s=(wide, wide))) ** 2
            overlap = np.maximum(np.fft.irfft2(ones, s=(wide, wide)), 1.0)
            ac = np.fft.fftshift(np.fft.irfft2(power_sum / count, s=(wide, wide)) / overlap)
            y, x = np.mgrid[0:wide, 0:wide] - side
            ring = np.floor(np.hypot(y, x) + 0.5).astype(int)
            last = side - 1 if max_lag is None else max_lag
            profile = np.array([ac[ring == lag].mean() for lag in range(last + 1)])
            return profile / profile[0]

        return pd.Series([one(*row) for row in zip(power, n, size)])

    ordered = F.transform(F.sort_array(F.collect_list(F.struct("mode", "power"))), lambda s: s["power"])
    row = state.agg(ordered.alias("p"), F.max("n_patches").alias("n_patches"), F.max("size").alias("size"))
    return row.select("n_patches", F.posexplode(rings("p", "n_patches", "size")).alias("lag", "value"))


def correlation_length(profile: DataFrame, exclude_noise: bool = True) -> DataFrame:
    """One row: xi, noise fraction, whether the profile never fell below 1/e.

    The profile is renormalised at lag 1, past the pixel noise that sits at lag 0 alone. It has one
    row per lag, so ordering it takes one small task.
    """
    start, target = (1 if exclude_noise else 0), math.exp(-1.0)
    base = profile.agg(F.max(F.when(F.col("lag") == start, F.col("value"))).alias("b"), F.max(F.when(F.col("lag") == 1, F.col("value"))).alias("first"),
                       F.max("lag").alias("last"), F.max("n_patches").alias("n")).first()
    if base["b"] is None:
        return profile.sparkSession.createDataFrame([(float("nan"), float("nan"), False, base["n"] or 0)],
                                                    "xi double, noise_fraction double, truncated boolean, n_patches bigint")
    p = profile.where(F.col("lag") >= start).select("lag", (F.col("value") / base["b"]).alias("p"))
    previous = F.lag("p").over(Window.orderBy("lag"))
    crossing = p.withColumn("prev", previous).where(F.col("p") < target)
    at = F.when(F.col("prev").isNull(), F.col("lag").cast("double")).otherwise(
        F.col("lag") - 1 + (F.col("prev") - target) / F.greatest(F.col("prev") - F.col("p"), F.lit(1e-12)))
    first = crossing.agg(F.min_by(at, "lag").alias("xi"))
    return first.select(
        F.coalesce("xi", F.lit(float(base["last"]))).alias("xi"),
        F.lit(1.0 - base["first"] if base["first"] is not None else float("nan")).alias("noise_fraction"),
        F.col("xi").isNull().alias("truncated"), F.lit(base["n"]).cast("bigint").alias("n_patches"))


def reach_verdict(df: DataFrame, reach: Column) -> DataFrame:
    """Whether a reach covers the correlation length `xi`."""
    ratio = reach / F.col("xi")
    known = (F.col("xi") > 0) & ~F.isnan("xi") & (F.col("xi") < float("inf"))
    verdict = F.when(ratio >= 2.0, "comfortable").when(ratio >= 1.2, "adequate").when(ratio >= 0.8, "marginal").otherwise("too small")
    return df.withColumn("reach_ratio", F.when(known, ratio)).withColumn("verdict", F.when(known, verdict).otherwise("unavailable"))


# -- band power -------------------------------------------------------------


def band_power(df: DataFrame, scales: Sequence[int] = SCALES, window: bool = False, by: Sequence[str] = (), column: str = "image") -> DataFrame:
    """Rows per octave [N/2l, N/l): rms, modes, relative error, white share; then `>` and `all`.

    Each stamp gives one sum per band, so nothing larger than that is shuffled.
    """
    scales, by = [int(s) for s in scales], list(by)
    coarsest = max(scales)

    @arrow_function(struct(power=DOUBLES, modes=LONGS, side=LONG))
    def bands(image: pd.Series) -> pd.DataFrame:
        grids = {}

        def one(pixels):
            a = square(pixels)
            h = len(a)
            if h not in grids:
                f = np.fft.fftfreq(h) * h
                k = np.hypot(f[:, None], f[None, :])
                masks = [(k >= h / (2.0 * s)) & (k < h / float(s)) for s in scales]
                masks.append((k > 0) & (k < h / (2.0 * coarsest)))
                w = np.outer(np.hanning(h), np.hanning(h)) if window else np.ones((h, h))
                grids[h] = masks, w / np.sqrt((w**2).mean())
            masks, w = grids[h]
            power = np.abs(np.fft.fft2((a - a.mean()) * w)) ** 2
            return [float(power[m].sum()) for m in masks], [int(m.sum()) for m in masks], h

        return pd.DataFrame(each(one, image), columns=["power", "modes", "side"])

    per_stamp = df.select(*by, bands(column).alias("b"))
    long = per_stamp.select(*by, F.col("b.side").alias("side"), F.posexplode(F.arrays_zip("b.power", "b.modes")).alias("pos", "z"))
    mean = long.groupBy(*by, "pos").agg(
        F.avg("z.power").alias("power"), F.max("z.modes").alias("n_modes"), F.count(F.lit(1)).alias("n_patches"),
        F.max("side").alias("side"), F.min("side").alias("_least"))
    mixed = F.raise_error(F.lit("stamps of several sizes")).cast("double")
    h2 = (F.col("side") * F.col("side")).cast("double")
    names = F.array(*[F.lit(str(s)) for s in scales], F.lit(f">{2 * coarsest}"))
    widths = F.array(*[F.lit(s) for s in scales], F.lit(2 * coarsest))
    rows = mean.select(
        *by, F.get(names, "pos").alias("band"), F.get(widths, "pos").alias("scale"), "n_patches", "side",
        F.when(F.col("side") == F.col("_least"), F.sqrt("power") / h2).otherwise(mixed).alias("rms"), "n_modes",
        F.when(F.col("n_modes") > 0, 1.0 / F.sqrt(2.0 * F.greatest("n_modes", F.lit(1)) * F.col("n_patches"))).otherwise(F.lit(float("inf"))).alias("rel_error"),
        F.sqrt(F.col("n_modes") / h2).alias("white_rms"),
    )
    total = rows.groupBy(*by).agg(
        F.lit("all").alias("band"), F.lit(0).alias("scale"), F.max("n_patches").alias("n_patches"), F.max("side").alias("side"),
        F.sqrt(F.sum(F.col("rms") * F.col("rms"))).alias("rms"), F.sum("n_modes").alias("n_modes"),
        F.lit(None).cast("double").alias("rel_error"), F.sqrt(F.sum(F.col("white_rms") * F.col("white_rms"))).alias("white_rms"))
    return rows.unionByName(total)


def _visible():
    return F.when(F.col("n_modes") > 0, F.col("rms") / F.when(F.col("n_modes") > 0, F.col("white_rms"))).otherwise(F.lit(float("inf")))


def scale_visibility(df: DataFrame, scales: Sequence[int] = SCALES, window: bool = True) -> DataFrame:
    """Noise level above which structure of each scale is gone."""
    octaves = band_power(df, scales, window).where(~F.col("band").startswith(">") & (F.col("band") != "all"))
    return octaves.withColumn("sigma_visible", _visible())


def schedule_headroom(df: DataFrame, sigma_max: float, scales: Sequence[int] = SCALES, window: bool = False) -> DataFrame:
    """How far sigma_max is above each scale, most persistent first, and the floor it leaves."""
    rows = band_power(df, scales, window).where((F.col("band") != "all") & (F.col("n_modes") > 0)).withColumn("sigma_visible", _visible())
    ratio = F.col("sigma_visible") / float(sigma_max)
    return rows.select("band", "sigma_visible", (F.lit(float(sigma_max)) / F.col("sigma_visible")).alias("headroom"),
                       (1.0 / F.sqrt(1.0 + ratio * ratio)).alias("pflow_ratio"), "n_modes").orderBy(F.desc("sigma_visible"))


def buried_share(visibility: DataFrame, sigma_min: float, sigma_max: float) -> DataFrame:
    """Share of the log-uniform schedule above a scale's visibility."""
    v = F.col("sigma_visible")
    share = F.log(F.lit(float(sigma_max)) / v) / math.log(sigma_max / sigma_min)
    return visibility.withColumn("buried", F.when(v <= sigma_min, 1.0).when(v >= sigma_max, 0.0).otherwise(share))


def band_ratio(a: DataFrame, b: DataFrame, scales: Sequence[int] = SCALES) -> DataFrame:
    """Band power of one set over another, with its statistical error."""
    left = band_power(a, scales).select("band", F.col("rms").alias("rms_a"), F.col("rel_error").alias("err_a"), "n_modes")
    right = band_power(b, scales).select("band", F.col("rms").alias("rms_b"), F.col("rel_error").alias("err_b"))
    ratio = F.try_divide("rms_a", "rms_b")
    error = F.sqrt(F.col("err_a") * F.col("err_a") + F.col("err_b") * F.col("err_b")) * F.col("ratio")
    return left.join(right, "band").withColumn("ratio", ratio).withColumn("error", error).drop("err_a", "err_b")


def gaussian_floor(df: DataFrame, size: int, sigmas: Column) -> DataFrame:
    """(sigma, floor): mean over all Fourier modes of P / (P + sigma^2)."""
    state = power_state(df, size, pad=1)
    # The real transform keeps half the modes; all but the first and (even sizes) last column stand for two.
    column = F.pmod("mode", F.lit(size // 2 + 1))
    single = (column == 0) | (column == (size // 2 if size % 2 == 0 else -1))
    power = F.col("power") / F.col("n_patches") / float(size * size)
    modes = state.select(power.alias("p"), F.when(single, 1.0).otherwise(2.0).alias("w"), F.explode(sigmas).alias("sigma"))
    return modes.groupBy("sigma").agg((F.sum(F.col("w") * F.col("p") / (F.col("p") + F.col("sigma") * F.col("sigma"))) / float(size * size)).alias("floor"))
