"""From a stamp set to the settings of its transform and noise schedule, in one report."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, functions as F

from stampmill.cuts import PatchSettings, TransformSettings
from stampmill.operators import images as im, measure as me, pairs as pr, spectra as sp
from stampmill.operators.manifest import usable
from stampmill.operators.ordering import sample_n

SCALES = (1, 2, 4, 8, 16, 32)


def prepare(stamps: DataFrame, cfg: TransformSettings, patch: PatchSettings, key: str, n: int = 512, seed=0, rule: str = "pairs",
            sigma_min: float | None = None, sigma_max: float | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """One row of measured and kept settings. A setting that is given is kept, one that is None is measured.

    With a manifest only the stamps usable under `patch` are read; without one the caller has cut them.

    The sample is drawn once and its few rows are kept in memory (and on disk when they do not
    fit) for the measures that read them; what is lost with an executor is computed again.
    """
    if manifest is not None:
        stamps = usable(stamps, patch, manifest)
    keys = sample_n(stamps.select(key), n, seed, key)
    sample = stamps.join(keys, key, "left_semi")
    pooled = im.to_grid(sample, patch, key)
    measured = me.measure_transform(pooled, stamps, cfg, patch.pool_factor).first()
    if cfg.softening is None:
        cfg = dataclasses.replace(cfg, softening=measured["softening"])
    else:
        me.check_softening(cfg.softening, me.pooled_sky_noise(pooled), cfg.softening_sigma).first()
    if cfg.pooled_noise_ratio is None:
        cfg = dataclasses.replace(cfg, pooled_noise_ratio=round(measured["pooled_noise_ratio"], 4))

    x = im.make_batch(sample, cfg, patch, key)
    flux = pooled.select(key, F.col("image").alias("flux"))
    x = x.select(key, "image", "sky_noise").join(flux, key).persist()
    try:
        stats = me.set_stats(x, patch.pool_factor)
        pairs = pr.pair_distances(x.select(key, "image"), key, None).select("n_pairs", "dim", F.col("max").alias("pair_max"), F.col("p99").alias("pair_p99"))
        # Two one-row frames side by side.
        row = {**stats.first().asDict(), **pairs.first().asDict()}
        report = stamps.sparkSession.createDataFrame([tuple(row.values())], one_row_schema(row))
        report = me.scatter_check(me.sigma_range(report, rule), cfg)
        chosen = report.first()
        low = sigma_min if sigma_min is not None else round(chosen["sigma_min"], 5)
        high = sigma_max if sigma_max is not None else round(chosen["sigma_max"], 3)
        report = me.n_steps(report.withColumns({"sigma_min": F.lit(float(low)), "sigma_max": F.lit(float(high))}))
        worst = sp.schedule_headroom(x, high, SCALES).agg(F.min("headroom").alias("h"), F.min("pflow_ratio").alias("p")).first()
        xi = sp.correlation_length(sp.autocorrelation(sp.power_state(x, patch.out_size))).first()
        return report.withColumns(
            {"softening": F.lit(float(cfg.softening)), "pooled_noise_ratio": F.lit(float(cfg.pooled_noise_ratio)),
             "least_headroom": F.lit(worst["h"]), "least_pflow_ratio": F.lit(worst["p"]), "xi": F.lit(xi["xi"]),
             "noise_fraction": F.lit(xi["noise_fraction"]), "truncated": F.lit(xi["truncated"])})
    finally:
        x.unpersist()


def one_row_schema(row: dict) -> str:
    return ", ".join(f"`{k}` {'bigint' if isinstance(v, int) else 'double'}" for k, v in row.items())
