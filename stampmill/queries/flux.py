"""The softened log-flux map on the 8 px stamps, pixel by pixel."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampmill.cuts import PatchSettings, TransformSettings
from stampmill.functions import arrays as A, flux as fx
from stampmill.operators import images as im, measure as me
from stampmill.queries import query
from stampmill.queries.gate import rounded
from stampmill.queries.views import ctes, stamps8

S = 20.0
PATCH = PatchSettings(native_size=8, out_size=4, pool_factor=2)
CFG = TransformSettings(softening=S, pooled_noise_ratio=1.1)
# The floor is a stamp's pooled noise: sky_noise / 2 * 1.1.
FLOOR = "(sky_noise / 2e0 * 11e-1)"


def softplus_sql(u):
    return f"(greatest({u}, 0e0) + ln(1 + exp(-abs({u}))))"


def soften_sql(f, c="0e0"):
    return f"({c} + 20e0 * {softplus_sql(f'(({f} - {c}) / 20e0)')})"


def log_sql(f, c="0e0"):
    return f"ln({soften_sql(f, c)})"


def pixels(df, column="image"):
    return df.select("stamp_id", F.posexplode(column).alias("i", "v")).select("stamp_id", F.col("i").cast("bigint").alias("i"), rounded(F.col("v")).alias("v"))


def _px(expression):
    return ctes("px8") + f"SELECT stamp_id, i, round({expression}, 6) AS v FROM px8"


@query("f1_softplus", _px(softplus_sql("(v / 20e0)")))
def f1(spark, sf):
    df = stamps8(spark, sf)
    return pixels(df.withColumn("image", F.transform("image", lambda v: fx.softplus(v.cast("double") / S))))


@query("f2_soften", _px(soften_sql("v", FLOOR)))
def f2(spark, sf):
    return pixels(stamps8(spark, sf).withColumn("image", A.soften_image(F.col("image"), S, im.sky_floor(CFG, PATCH))))


@query("f3_log_softplus", _px(  # below -12 as a series: ln(1 + tiny) loses its digits
    f"CASE WHEN v / 2e0 < -20 THEN v / 2e0 WHEN v / 2e0 < -12 THEN v / 2e0 + ln(1 - exp(v / 2e0) / 2) ELSE ln({softplus_sql('(v / 2e0)')}) END"))
def f3(spark, sf):
    df = stamps8(spark, sf)
    return pixels(df.withColumn("image", F.transform("image", lambda v: fx.log_softplus(v.cast("double") / 2.0))))


@query("f4_to_x", _px(log_sql("v", FLOOR)))
def f4(spark, sf):
    return pixels(stamps8(spark, sf).withColumn("image", A.to_x(F.col("image"), S, im.sky_floor(CFG, PATCH))))


@query("f5_to_flux", _px(f"exp({log_sql('v')})"))
def f5(spark, sf):
    return pixels(stamps8(spark, sf).withColumn("image", A.to_flux(A.to_x(F.col("image"), S))))


# The inverse must give the measured flux back, so the oracle is the input itself.
@query("f6_to_flux_exact", ctes("px8") + "SELECT stamp_id, i, round(v, 4) + 0e0 AS v FROM px8")
def f6(spark, sf):
    x = A.to_x(F.col("image"), S)
    back = stamps8(spark, sf).withColumn("image", A.to_flux_exact(x, S))
    exploded = back.select("stamp_id", F.posexplode("image").alias("i", "v"))
    return exploded.select("stamp_id", F.col("i").cast("bigint").alias("i"), (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("f7_sky_level", ctes("px8") + f"SELECT stamp_id, round({log_sql('0e0', FLOOR)}, 6) AS sky_level FROM px8 WHERE i = 0")
def f7(spark, sf):
    return me.sky_levels(stamps8(spark, sf), S, im.sky_floor(CFG, PATCH)).select("stamp_id", rounded(F.col("sky_level")).alias("sky_level"))


@query("f8_sky_floor", ctes("px8") + f"SELECT stamp_id, round({FLOOR}, 6) AS floor FROM px8 WHERE i = 0")
def f8(spark, sf):
    return stamps8(spark, sf).select("stamp_id", rounded(im.sky_floor(CFG, PATCH)).alias("floor"))


POOLED_SQL = "pooled AS (SELECT stamp_id, band_idx, label, any_value(sky_noise) AS sky_noise, y // 2 AS py, x // 2 AS px, avg(v) AS v FROM px8 GROUP BY stamp_id, band_idx, label, py, px)"
SPREAD_SQL = "spread AS (SELECT stamp_id, band_idx, (quantile_cont(v, 0.25) - quantile_cont(v, 0.05)) / 9703648e-7 AS s FROM pooled GROUP BY stamp_id, band_idx)"
NOISE_CTES = ctes("px8") + "," + POOLED_SQL + "," + SPREAD_SQL + ", noise AS (SELECT count(*) AS n_stamps, median(s) AS pooled_noise FROM spread WHERE s > 0)"


def pooled(spark, sf):
    return im.pool_stamps(stamps8(spark, sf), PATCH, "stamp_id")


@query("a12_pooled_sky_noise", NOISE_CTES + " SELECT n_stamps, round(pooled_noise, 6) AS pooled_noise FROM noise")
def a12(spark, sf):
    return me.pooled_sky_noise(pooled(spark, sf)).select("n_stamps", rounded(F.col("pooled_noise")).alias("pooled_noise"))


@query("a12_pooled_sky_noise_by_band", NOISE_CTES + " SELECT band_idx, count(*) AS n_stamps, round(median(s), 6) AS pooled_noise FROM spread WHERE s > 0 GROUP BY band_idx")
def a12_band(spark, sf):
    return me.pooled_sky_noise(pooled(spark, sf), ("band_idx",)).withColumn("pooled_noise", rounded(F.col("pooled_noise")))


@query("a13_measure_transform", NOISE_CTES + """ SELECT round(pooled_noise, 6) AS pooled_noise, round(15e-1 * pooled_noise, 6) AS softening,
  round(pooled_noise / ((SELECT median(sky_noise) FROM px8 WHERE i = 0) / 2), 6) AS pooled_noise_ratio FROM noise""")
def a13(spark, sf):
    out = me.measure_transform(pooled(spark, sf), stamps8(spark, sf), TransformSettings(softening_sigma=1.5), 2)
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


# Softening set once, from the typical native noise of each band, against what is measured.
@query("f9_check_softening", NOISE_CTES + """, per_band AS (SELECT band_idx, median(s) AS m FROM spread WHERE s > 0 GROUP BY band_idx)
  SELECT band_idx, round(m * 11e-1 / m, 6) AS implied_sigma FROM per_band""")
def f9(spark, sf):
    measured = me.pooled_sky_noise(pooled(spark, sf), ("band_idx",))
    return me.check_softening(F.col("pooled_noise") * 1.1, measured, 1.0).select("band_idx", rounded(F.col("implied_sigma")).alias("implied_sigma"))


@query("p14_input_offset", NOISE_CTES + f""", per_band AS (SELECT band_idx, median(s) AS s FROM spread WHERE s > 0 GROUP BY band_idx)
  SELECT band_idx, round(ln(c + s * {softplus_sql('(-c / s)')}), 6) AS input_offset FROM (SELECT band_idx, s * 15e-1 AS s, 5e-1 * s AS c FROM per_band)""")
def p14(spark, sf):
    settings = me.pooled_sky_noise(pooled(spark, sf), ("band_idx",))
    offset = me.input_offset(F.col("pooled_noise") * 1.5, F.lit(1.5), F.lit(0.5))
    return settings.select("band_idx", rounded(offset).alias("input_offset"))


@query("p13_asinh_stretch", ctes("px8") + """SELECT stamp_id, round(greatest(quantile_cont(asinh(v / sky_noise), 0.998), 3e0), 6) AS high,
  round(sum(asinh(v / sky_noise)), 4) AS total FROM px8 GROUP BY stamp_id""")
def p13(spark, sf):
    df = stamps8(spark, sf).withColumn("x", A.asinh_stretch(F.col("image"), F.col("sky_noise")))
    total = F.aggregate("x.image", F.lit(0.0), lambda a, v: a + v)
    return df.select("stamp_id", rounded(F.col("x.high")).alias("high"), rounded(total, 4).alias("total"))


@query("p15_shared_range", ctes("px8") + "SELECT band_idx, round(quantile_cont(v, 0.005), 6) AS low, round(quantile_cont(v, 0.995), 6) AS high FROM px8 GROUP BY band_idx")
def p15(spark, sf):
    out = me.shared_range(stamps8(spark, sf), by=("band_idx",))
    return out.select("band_idx", rounded(F.col("low")).alias("low"), rounded(F.col("high")).alias("high"))
