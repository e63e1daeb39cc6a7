"""Stamp diagnostics and the accept / reject gate.

A stamp is one row, so nothing here shuffles. Pixel sums run in small Arrow-batched functions
that share one transfer of the arrays; limits, reasons and text are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stampmill.cuts import PatchCuts
from stampmill.functions.arrays import each, ranked, square
from stampmill.functions.flux import finite
from stampmill.functions.types import DOUBLE, DOUBLES, LONGS, arrow_function, struct

# Fixed values of the gate.
RECORDED_PLANES = ("INEXACT_PSF", "REJECTED", "DETECTED", "DETECTED_NEGATIVE", "CLIPPED", "SUSPECT")
MAX_PLANES = 63  # bits 0 to 62 of a signed long
BLOCK_FRACTION = 1 / 8
MIN_BLOCK = 8
FLOOR_PERCENTILE = 10.0
SOURCE_NSIGMA = 3.0
MIN_USABLE = 0.5
CENTRE_WINDOW = 16
PEAK_NSIGMA = 5.0
PEAK_SMOOTH = 3
PEAK_RADIUS = 3


def _inner(a: np.ndarray, fraction: float) -> np.ndarray:
    side = max(int(len(a) * fraction), 1)
    start = (len(a) - side) // 2
    return a[start : start + side, start : start + side]


def _block_floors(variance: np.ndarray, image: np.ndarray) -> list[float]:
    """Low percentile of the sky variance in each block that keeps enough sky, reading order."""
    block = max(int(round(len(variance) * BLOCK_FRACTION)), MIN_BLOCK)
    with np.errstate(invalid="ignore"):
        usable = np.isfinite(variance) & (variance > 0)
        seen = image[usable]
        sky = ranked(seen, 0.5) if seen.size and not np.isnan(seen).any() else np.nan
        usable &= image < sky + SOURCE_NSIGMA * np.sqrt(np.where(usable, variance, 0.0))
        usable &= np.isfinite(image)
    n = len(variance) // block
    if n == 0:
        return []

    def blocks(a):
        return a[: n * block, : n * block].reshape(n, block, n, block).swapaxes(1, 2).reshape(n * n, block * block)

    # Unusable pixels sort to the end of their block.
    ordered = np.sort(blocks(np.where(usable, variance, np.inf)), axis=1)
    count = blocks(usable).sum(axis=1)
    enough = np.flatnonzero(count >= MIN_USABLE * block * block)
    at = FLOOR_PERCENTILE / 100 * (count[enough] - 1)
    low = at.astype(int)
    first, second = ordered[enough, low], ordered[enough, np.minimum(low + 1, count[enough] - 1)]
    return (first + (second - first) * (at - low)).tolist()


@arrow_function(DOUBLES)
def variance_floors(variance: pd.Series, image: pd.Series) -> pd.Series:
    return pd.Series(each(lambda v, i: _block_floors(square(v), square(i)), variance, image))


def variance_step(floors: Column) -> Column:
    """Highest over lowest block floor; NaN under two floors or without a positive one."""
    usable = (F.size(floors) >= 2) & (F.array_min(floors) > 0)
    return F.when(usable, F.array_max(floors) / F.when(usable, F.array_min(floors))).otherwise(F.lit(float("nan")))


@arrow_function(DOUBLE)
def centre_median(image: pd.Series) -> pd.Series:
    """Median of the finite pixels in the central window; NaN when there are none."""

    def one(pixels):
        a = square(pixels)
        half, middle = min(CENTRE_WINDOW, len(a)) // 2, len(a) // 2
        window = a[middle - half : middle + half, middle - half : middle + half]
        window = window[np.isfinite(window)]
        return ranked(window, 0.5) if window.size else np.nan

    return pd.Series(each(one, image))


def centre_sigma(median: Column, sky_noise: Column) -> Column:
    usable = finite(sky_noise) & (sky_noise > 0)
    return F.when(usable, median / F.when(usable, sky_noise)).otherwise(F.lit(float("nan")))


def _windowed(a: np.ndarray, width: int, combine, scale: float = 1.0) -> np.ndarray:
    """Combine the pixels of every full `width` x `width` window, one axis after the other."""
    for axis in (0, 1):
        n = a.shape[axis] - width + 1
        views = [a[k : k + n] if axis == 0 else a[:, k : k + n] for k in range(width - 1, -1, -1)]
        out = views[0].copy()
        for view in views[1:]:
            combine(out, view, out=out)
        a = out * scale if scale != 1.0 else out
    return a


def _peaks(a: np.ndarray, noise: float) -> int:
    a = np.where(np.isfinite(a), a, 0.0)
    edge = PEAK_RADIUS + PEAK_SMOOTH
    if len(a) <= 2 * edge:
        return 0
    # Valid-only windows: the trimmed border is never computed.
    smooth = _windowed(a, PEAK_SMOOTH, np.add, 1 / PEAK_SMOOTH)
    largest = _windowed(smooth, 2 * PEAK_RADIUS + 1, np.maximum)
    centre = smooth[PEAK_RADIUS:-PEAK_RADIUS, PEAK_RADIUS:-PEAK_RADIUS]
    hit = (centre >= largest) & (centre > PEAK_NSIGMA * noise / PEAK_SMOOTH)
    trim = edge - PEAK_RADIUS - PEAK_SMOOTH // 2
    return int(np.count_nonzero(hit[trim:-trim, trim:-trim]))


@arrow_function(DOUBLE)
def count_peaks(image: pd.Series, sky_noise: pd.Series) -> pd.Series:
    """Distinct bright maxima of the smoothed stamp; -1 without a usable noise."""
    usable = [s is not None and np.isfinite(s) and s > 0 for s in sky_noise]
    noise = [s if ok else -1.0 for s, ok in zip(sky_noise, usable)]
    return pd.Series(each(lambda p, s: float(_peaks(square(p), s)) if s > 0 else -1.0, image, noise))


def _depth_measures(inner_fraction: float):
    @arrow_function(struct(all_finite=T.BooleanType(), frac_no_data=DOUBLE, inner_frac_no_data=DOUBLE, sky_noise=DOUBLE))
    def measure(image: pd.Series, variance: pd.Series) -> pd.DataFrame:
        def one(pixels, var):
            v = square(var)
            empty = ~np.isfinite(v) | (v <= 0)
            seen = v[~empty]
            noise = float(np.sqrt(ranked(seen, 0.5))) if seen.size else np.nan
            return bool(np.all(np.isfinite(pixels))), float(empty.mean()), float(_inner(empty, inner_fraction).mean()), noise

        rows = [r or (None, None, None, None) for r in each(one, image, variance)]
        return pd.DataFrame(rows, columns=["all_finite", "frac_no_data", "inner_frac_no_data", "sky_noise"])

    return measure


def _plane_measures(inner_fraction: float):
    @arrow_function(struct(whole=DOUBLES, inner=DOUBLES))
    def measure(mask: pd.Series) -> pd.DataFrame:
        def one(bits):
            flat = np.asarray(bits, dtype=np.int64)
            side = int(round(flat.size**0.5))
            box = _inner(flat.reshape(side, side), inner_fraction)
            used = int(np.bitwise_or.reduce(flat))
            if used < 0:
                raise ValueError(f"a mask sets bit {MAX_PLANES}; planes are bits 0 to {MAX_PLANES - 1}")
            bits_in_use = [b if (used >> b) & 1 else None for b in range(max(used.bit_length(), 1))]
            return tuple([0.0 if b is None else float(((m >> b) & 1).mean()) for b in bits_in_use] for m in (flat, box))

        rows = [r or (None, None) for r in each(one, mask)]
        return pd.DataFrame(rows, columns=["whole", "inner"])

    return measure


def _at_bit(fractions: Column, bit: Column) -> Column:
    """The fraction of a bit; bits above the highest one set count 0, and a bit no mask can hold fails."""
    outside = F.raise_error(F.concat(F.lit("plane on bit "), bit.cast("string"), F.lit(f"; planes are bits 0 to {MAX_PLANES - 1}")))
    value = F.when(fractions.isNotNull(), F.coalesce(F.get(fractions, bit), F.lit(0.0)))
    return F.when(bit.between(0, MAX_PLANES - 1), value).otherwise(outside.cast("double"))


def plane_fraction(fractions: Column, planes: Column, name: str) -> Column:
    """Fraction of one named plane; a plane the map does not have counts 0."""
    bit = F.element_at(planes, F.lit(name))
    return F.when(bit.isNull(), F.lit(0.0)).otherwise(_at_bit(fractions, bit))


def plane_fractions(df: DataFrame, inner_fraction: float = 0.34) -> DataFrame:
    """(stamp columns, plane, fraction, inner_fraction): a row for each plane of the map."""
    measured = df.withColumn("_p", _plane_measures(inner_fraction)("mask"))
    keep = [c for c in df.columns if c not in ("image", "variance", "mask", "planes")]
    return measured.select(*keep, "_p", F.explode("planes").alias("plane", "_bit")).select(
        *keep, "plane", _at_bit(F.col("_p.whole"), F.col("_bit")).alias("fraction"), _at_bit(F.col("_p.inner"), F.col("_bit")).alias("inner_fraction")
    )


def pack_mask(df: DataFrame, planes: Iterable[str], out: str = "mask") -> DataFrame:
    """Boolean array columns to one bit array and its name-to-bit map; more planes than bits are refused."""
    names = list(planes)
    if not names:
        raise ValueError("no planes to pack")
    if len(names) > MAX_PLANES:
        raise ValueError(f"{len(names)} planes do not fit in {MAX_PLANES} bits")

    @arrow_function(LONGS)
    def packed(stacked: pd.Series) -> pd.Series:
        bits = np.left_shift(np.int64(1), np.arange(len(names)))
        return pd.Series(each(lambda planes: bits @ np.stack(planes).astype(np.int64), stacked))

    mapping = F.create_map(*[F.lit(v) for bit, name in enumerate(names) for v in (name, bit)])
    return df.withColumn(out, packed(F.array(*[F.col(n) for n in names]))).withColumn("planes", mapping)


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text as printf writes it: ties to even on the exact value, the sign kept at zero, `inf` for infinity."""
    scale, size = 10.0**digits, F.abs(value)
    scaled = size * scale
    # What rounding the product lost; below 2^16 each part has few enough bits to be exact.
    high = F.floor(size * 2.0**20) / 2.0**20
    lost = (high * scale - scaled) + (size - high) * scale
    low = F.floor(scaled)
    seeming_tie = (size < 2.0**16) & (scaled - low == 0.5) & (lost != 0)
    nearest = F.when(seeming_tie, low + (lost > 0).cast("double")).otherwise(F.rint(scaled)) / scale
    shown = F.when(scaled < 2.0**52, nearest).otherwise(size)
    sign = F.when(value.cast("string").startswith("-"), "-").otherwise("")
    return F.concat(sign, F.when(size == float("inf"), "inf").otherwise(F.format_string(f"%.{digits}f", shown)))


def _reason(test: Column, *text) -> Column:
    return F.when(test, F.concat(*[t if isinstance(t, Column) else F.lit(str(t)) for t in text]))


def gate(df: DataFrame, cuts: PatchCuts | None = None) -> DataFrame:
    """Add `diag_*` columns and `reasons`, in gate order; an empty list accepts the stamp.

    Needs image, variance, mask, planes, n_visits_min and cell_depth_ratio.
    """
    cuts = cuts or PatchCuts()
    refused = sorted(set(cuts.max_plane_fraction) & set(RECORDED_PLANES))
    if refused:
        raise ValueError(f"refusing to gate on {refused}: these mark real sources")
    wanted = sorted({*cuts.zero_tolerance_planes, *cuts.max_plane_fraction, *cuts.max_inner_plane_fraction})

    df = df.withColumns(
        {
            "_d": _depth_measures(cuts.inner_fraction)("image", "variance"),
            "_p": _plane_measures(cuts.inner_fraction)("mask"),
            "_floors": variance_floors("variance", "image"),
            "_centre": centre_median("image"),
        }
    ).withColumn("_peaks", count_peaks("image", F.col("_d.sky_noise")))
    planes = F.col("planes")
    diag: dict[str, Column] = {
        "frac_no_data": F.col("_d.frac_no_data"),
        "inner_frac_no_data": F.col("_d.inner_frac_no_data"),
        "n_visits_min": F.col("n_visits_min").cast("double"),
        "cell_depth_ratio": F.col("cell_depth_ratio").cast("double"),
        "variance_step": variance_step(F.col("_floors")),
        "sky_noise": F.col("_d.sky_noise"),
        "centre_sigma": centre_sigma(F.col("_centre"), F.col("_d.sky_noise")),
        "n_peaks": F.col("_peaks"),
    }
    for plane in sorted(cuts.max_plane_fraction):
        diag[f"frac_{plane}"] = plane_fraction(F.col("_p.whole"), planes, plane)
    for plane in sorted(cuts.max_inner_plane_fraction):
        diag[f"inner_frac_{plane}"] = plane_fraction(F.col("_p.inner"), planes, plane)
    for plane in RECORDED_PLANES:
        diag[f"frac_{plane}"] = plane_fraction(F.col("_p.whole"), planes, plane)
    df = df.withColumns({f"diag_{name}": column for name, column in diag.items()})
    d = {name: F.col(f"diag_{name}") for name in diag}

    reasons = [
        F.when(~F.col("_d.all_finite"), F.lit("nonfinite_image")),
        _reason(d["frac_no_data"] > cuts.max_no_data, "no_data:", fixed(d["frac_no_data"], 4), f">{cuts.max_no_data}"),
        _reason(
            d["inner_frac_no_data"] > cuts.max_inner_no_data,
            "inner_no_data:", fixed(d["inner_frac_no_data"], 4), f">{cuts.max_inner_no_data}",
        ),
    ]
    if cuts.min_visits is not None:
        visits = F.col("n_visits_min")
        reasons.append(_reason(visits < cuts.min_visits, "too_shallow:", visits.cast("string"), f"<{cuts.min_visits}"))
    if cuts.max_cell_depth_ratio is not None:
        limit, ratio = cuts.max_cell_depth_ratio, d["cell_depth_ratio"]
        reasons.append(_reason(~F.isnan(ratio) & (ratio > limit), "cell_depth:", fixed(ratio, 2), f">{limit}"))
    if cuts.max_variance_step is not None:
        limit, step = cuts.max_variance_step, d["variance_step"]
        reasons.append(_reason(finite(step) & (step > limit), "variance_step:", fixed(step, 2), f">{limit}"))
    if cuts.min_centre_sigma is not None:
        limit, centre = cuts.min_centre_sigma, d["centre_sigma"]
        reasons.append(_reason(finite(centre) & (centre < limit), "empty_centre:", fixed(centre, 2), f"<{limit}"))
    if cuts.max_peaks is not None:
        peaks = d["n_peaks"]
        reasons.append(
            _reason((peaks >= 0) & (peaks > cuts.max_peaks), "crowded:", peaks.cast("int").cast("string"), f">{cuts.max_peaks}")
        )
    if cuts.zero_tolerance_planes:
        present = F.array_compact(
            F.array(*[F.when(plane_fraction(F.col("_p.whole"), planes, p) > 0, F.lit(p)) for p in cuts.zero_tolerance_planes])
        )
        reasons.append(_reason(F.size(present) > 0, "zero_tol:", F.concat_ws("+", present)))
    for prefix, key, limits in (
        ("", "frac_", cuts.max_plane_fraction),
        ("inner_", "inner_frac_", cuts.max_inner_plane_fraction),
    ):
        for plane, limit in sorted(limits.items()):
            share = d[f"{key}{plane}"]
            reasons.append(_reason(share > limit, f"{prefix}{plane}:", fixed(share, 4), f">{limit}"))

    found = F.array_compact(F.array(*reasons))
    if wanted:
        names = F.array(*[F.lit(w) for w in wanted])
        stale = F.raise_error(F.lit(f"none of the gated planes {wanted} is in the stamp's mask map"))
        found = F.when(planes.isNull() | F.arrays_overlap(names, F.map_keys(planes)), found).otherwise(stale.cast("array<string>"))
    return df.withColumn("reasons", found).drop("_d", "_p", "_floors", "_centre", "_peaks")
