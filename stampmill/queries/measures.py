"""Measures of the stamp set: statistics, spectra, distances, settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampmill.cuts import TransformSettings
from stampmill.operators import images as im, measure as me, pairs as pr, spectra as sp
from stampmill.operators.ordering import sample_n
from stampmill.plans.preparation import prepare
from stampmill.queries import query
from stampmill.queries.flux import CFG, FLOOR, PATCH, log_sql, pooled
from stampmill.queries.gate import rounded
from stampmill.queries.images import BLEND_CTES
from stampmill.queries.views import ctes, hash_sql, stamps8

SCALES = (1, 2, 4)
XPX_CTES = BLEND_CTES + f", xpx AS (SELECT stamp_id, band_idx, label, sky_noise, py AS y, px AS x, {log_sql('f', FLOOR)} AS v FROM blended)"


def xstamps(spark, sf):
    return im.make_batch(stamps8(spark, sf), CFG, PATCH, "stamp_id")


def rounded_all(df, digits=6, keep=()):
    return df.select(*[rounded(F.col(c), digits).alias(c) if t in ("double", "float") and c not in keep else F.col(c) for c, t in df.dtypes])


_STATS = ", ".join(f"round(quantile_cont(v, {p / 100:.12g}), 6) AS {me.percent_name(p)}" for p in me.STAT_PERCENTILES)


@query("a11_set_stats", XPX_CTES + f""", per AS (SELECT band_idx, stamp_id, max(v) - min(v) AS r FROM xpx GROUP BY band_idx, stamp_id),
  deep AS (SELECT band_idx, min(v / (sky_noise / 2)) AS d FROM pooled GROUP BY band_idx),
  moments AS (SELECT band_idx, avg(v) AS m, stddev_pop(v) AS sd FROM xpx GROUP BY band_idx)
  SELECT xpx.band_idx, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
  round(avg(((v - m) / sd) ** 3), 6) AS skew, {_STATS}, (SELECT count(*) FROM per p WHERE p.band_idx = xpx.band_idx) AS n_stamps,
  round((SELECT quantile_cont(r, 0.99) FROM per p WHERE p.band_idx = xpx.band_idx), 6) AS per_patch_range_p99,
  round((quantile_cont(v, 0.84) - quantile_cont(v, 0.16)) / 2, 6) AS sky_scatter, round(any_value(d), 6) AS deepest_flux_sigma
  FROM xpx JOIN moments USING (band_idx) JOIN deep USING (band_idx) GROUP BY xpx.band_idx""")
def a11(spark, sf):
    flux = pooled(spark, sf).select("stamp_id", F.col("image").alias("flux"))
    x = xstamps(spark, sf).join(flux, "stamp_id")
    return rounded_all(me.set_stats(x, 2, by=("band_idx",)))


@query("f7_scatter_check", XPX_CTES + f""" SELECT round(s, 6) AS sky_scatter, round({me.SKY_SLOPE!r}e0, 6) AS predicted_scatter,
  CASE WHEN s < 2 * {me.SKY_SLOPE!r}e0 THEN 'plausible' ELSE 'far from the prediction' END AS verdict
  FROM (SELECT (quantile_cont(v, 0.84) - quantile_cont(v, 0.16)) / 2 AS s FROM xpx)""")
def f7_check(spark, sf):
    stats = me.set_stats(xstamps(spark, sf))
    return rounded_all(me.scatter_check(stats, CFG).select("sky_scatter", "predicted_scatter", "verdict"))


@query("a18_sample_report", XPX_CTES + """ SELECT label, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
  count(*) FILTER (NOT isfinite(v)) AS n_nonfinite, round(max(exp(v)), 6) AS flux_max, round(median(exp(v)), 6) AS flux_median FROM xpx GROUP BY label""")
def a18(spark, sf):
    return rounded_all(me.sample_report(xstamps(spark, sf), by=("label",)))


# -- autocorrelation by explicit pixel pairs --------------------------------
# Lags (dy, dx) of an n px stamp; rings of width one; unbiased by the overlap count.
def _acf_sql(source, n):
    return f"""centred AS (SELECT stamp_id, y, x, v - avg(v) OVER (PARTITION BY stamp_id) AS c FROM {source}),
lags AS (SELECT b.y - a.y AS dy, b.x - a.x AS dx, sum(a.c * b.c) / (SELECT count(DISTINCT stamp_id) FROM centred) / (({n} - abs(b.y - a.y)) * ({n} - abs(b.x - a.x))) AS ac
  FROM centred a JOIN centred b USING (stamp_id) GROUP BY b.y - a.y, b.x - a.x),
rings AS (SELECT CAST(floor(sqrt(dy * dy + dx * dx) + 5e-1) AS INT) AS lag, avg(ac) AS ac FROM lags GROUP BY 1),
profile AS (SELECT lag, ac / (SELECT ac FROM rings WHERE lag = 0) AS value FROM rings WHERE lag <= {n - 1})"""


ACF_CTES = ctes("px8") + "," + _acf_sql("px8", 8)
_XI_SQL = """, shifted AS (SELECT lag, value / (SELECT value FROM profile WHERE lag = 1) AS p FROM profile WHERE lag >= 1),
crossed AS (SELECT lag, p, lag(p) OVER (ORDER BY lag) AS prev FROM shifted)
SELECT round(coalesce((SELECT lag - 1 + (prev - exp(-1e0)) / greatest(prev - p, 1e-12) FROM crossed WHERE p < exp(-1e0) ORDER BY lag LIMIT 1),
  (SELECT max(lag) FROM profile)), 6) AS xi, round(1 - (SELECT value FROM profile WHERE lag = 1), 6) AS noise_fraction,
  (SELECT count(*) FROM crossed WHERE p < exp(-1e0)) = 0 AS truncated, (SELECT count(DISTINCT stamp_id) FROM centred) AS n_patches"""


@query("m1_autocorrelation", ACF_CTES + " SELECT lag, round(value, 6) AS value, (SELECT count(DISTINCT stamp_id) FROM centred) AS n_patches FROM profile")
def m1(spark, sf):
    out = sp.autocorrelation(sp.power_state(stamps8(spark, sf), 8))
    return out.select("lag", rounded(F.col("value")).alias("value"), "n_patches")


@query("m2_correlation_length", ACF_CTES + _XI_SQL)
def m2(spark, sf):
    return rounded_all(sp.correlation_length(sp.autocorrelation(sp.power_state(stamps8(spark, sf), 8))))


@query("m3_merged_states", ACF_CTES + _XI_SQL)
def m3(spark, sf):
    stamps = stamps8(spark, sf)
    parts = [sp.power_state(stamps.where(F.col("band_idx").between(lo, lo + 1)), 8) for lo in (0, 2, 4)]
    return rounded_all(sp.correlation_length(sp.autocorrelation(sp.merge_states(*parts))))


@query("m4_reach_verdict", ctes("px8") + """, noise AS (SELECT stamp_id, sky_noise / 10 AS xi, band_idx * 3 AS reach FROM px8 WHERE i = 0)
  SELECT stamp_id, round(reach / xi, 6) AS reach_ratio, CASE WHEN reach / xi >= 2 THEN 'comfortable' WHEN reach / xi >= 1.2 THEN 'adequate'
  WHEN reach / xi >= 0.8 THEN 'marginal' ELSE 'too small' END AS verdict FROM noise""")
def m4(spark, sf):
    df = stamps8(spark, sf).withColumn("xi", F.col("sky_noise") / 10)
    return sp.reach_verdict(df, F.col("band_idx") * 3).select("stamp_id", rounded(F.col("reach_ratio")).alias("reach_ratio"), "verdict")


# -- band power by explicit cosine and sine sums ----------------------------
def _modes_sql(source, n, group="0", hann=False):
    # A Hann window in both directions, scaled to unit mean square.
    side = f"(5e-1 - 5e-1 * cos(2 * pi() * {{0}} / {n - 1}e0))"
    weight = f" * {side.format('y')} * {side.format('x')} / (SELECT avg({side.format('i')} ** 2) FROM (SELECT unnest(range({n})) AS i))" if hann else ""
    freq = f"unnest(range({n})) AS k"
    f = f"(CASE WHEN {{0}} < {n - n // 2} THEN {{0}} ELSE {{0}} - {n} END)"
    return f"""waves AS (SELECT a.k AS ky, b.k AS kx, {f.format('a.k')} AS fy, {f.format('b.k')} AS fx FROM (SELECT {freq}) a, (SELECT {freq}) b),
flat AS (SELECT stamp_id, {group} AS grp, y, x, (v - avg(v) OVER (PARTITION BY stamp_id)){weight} AS c FROM {source}),
spectrum AS (SELECT stamp_id, grp, ky, kx, any_value(sqrt(fy * fy + fx * fx)) AS k, sum(c * cos(2 * pi() * (ky * y + kx * x) / {n})) ** 2 + sum(c * sin(2 * pi() * (ky * y + kx * x) / {n})) ** 2 AS p
  FROM flat, waves GROUP BY stamp_id, grp, ky, kx),
limits AS (SELECT unnest(['1', '2', '4', '>8']) AS band, unnest([1, 2, 4, 8]) AS scale, unnest([{n}/2e0, {n}/4e0, {n}/8e0, 1e-9]) AS lo, unnest([{n}/1e0, {n}/2e0, {n}/4e0, {n}/8e0]) AS hi),
per_band AS (SELECT grp, stamp_id, band, scale, coalesce(sum(p) FILTER (k >= lo AND k < hi), 0) AS p, count(*) FILTER (k >= lo AND k < hi) AS n_modes FROM spectrum, limits GROUP BY grp, stamp_id, band, scale),
bands AS (SELECT grp, band, scale, count(*) AS n_patches, sqrt(avg(p)) / {n * n} AS rms, max(n_modes) AS n_modes, sqrt(max(n_modes) / {float(n * n)!r}e0) AS white_rms,
  CASE WHEN max(n_modes) > 0 THEN 1 / sqrt(2e0 * max(n_modes) * count(*)) END AS rel_error FROM per_band GROUP BY grp, band, scale)"""


BAND_CTES = ctes("px8") + "," + _modes_sql("px8", 8)
_ALL_ROW = """ UNION ALL SELECT 'all', 0, max(n_patches), round(sqrt(sum(rms * rms)), 6), CAST(sum(n_modes) AS BIGINT), NULL, round(sqrt(sum(white_rms * white_rms)), 6) FROM bands"""


@query("m5_band_power", BAND_CTES + " SELECT band, scale, n_patches, round(rms, 6) AS rms, n_modes, round(rel_error, 6) AS rel_error, round(white_rms, 6) AS white_rms FROM bands" + _ALL_ROW)
def m5(spark, sf):
    return rounded_all(sp.band_power(stamps8(spark, sf), SCALES).drop("side"))


@query("m6_scale_visibility", BAND_CTES + " SELECT band, round(rms / white_rms, 6) AS sigma_visible FROM bands WHERE band NOT LIKE '>%'")
def m6(spark, sf):
    return sp.scale_visibility(stamps8(spark, sf), SCALES, window=False).select("band", rounded(F.col("sigma_visible")).alias("sigma_visible"))


@query("m6_scale_visibility_windowed", ctes("px8") + "," + _modes_sql("px8", 8, hann=True) + " SELECT band, round(rms / white_rms, 6) AS sigma_visible FROM bands WHERE band NOT LIKE '>%'")
def m6_windowed(spark, sf):
    return sp.scale_visibility(stamps8(spark, sf), SCALES).select("band", rounded(F.col("sigma_visible")).alias("sigma_visible"))


@query("m7_schedule_headroom", BAND_CTES + """ SELECT band, round(rms / white_rms, 6) AS sigma_visible, round(60e0 / (rms / white_rms), 6) AS headroom,
  round(1 / sqrt(1 + (rms / white_rms / 60e0) ** 2), 6) AS pflow_ratio, n_modes FROM bands WHERE n_modes > 0""")
def m7(spark, sf):
    return rounded_all(sp.schedule_headroom(stamps8(spark, sf), 60.0, SCALES))


@query("m8_buried_share", BAND_CTES + """, vis AS (SELECT band, rms / white_rms AS s FROM bands WHERE band NOT LIKE '>%')
  SELECT band, round(CASE WHEN s <= 1 THEN 1e0 WHEN s >= 60 THEN 0e0 ELSE ln(60e0 / s) / ln(60e0) END, 6) AS buried FROM vis""")
def m8(spark, sf):
    out = sp.buried_share(sp.scale_visibility(stamps8(spark, sf), SCALES, window=False), 1.0, 60.0)
    return out.select("band", rounded(F.col("buried")).alias("buried"))


@query("m9_band_ratio", ctes("px8") + "," + _modes_sql("px8", 8, "label % 2") + """, joined AS (
  SELECT band, a.rms AS rms_a, b.rms AS rms_b, a.n_modes, sqrt(a.rel_error * a.rel_error + b.rel_error * b.rel_error) AS err FROM bands a JOIN bands b USING (band) WHERE a.grp = 0 AND b.grp = 1),
  whole AS (SELECT sqrt(sum(rms_a ** 2)) AS a, sqrt(sum(rms_b ** 2)) AS b, CAST(sum(n_modes) AS BIGINT) AS n FROM joined)
  SELECT band, round(rms_a, 6) AS rms_a, round(rms_b, 6) AS rms_b, n_modes, round(rms_a / rms_b, 6) AS ratio, round(err * rms_a / rms_b, 6) AS error FROM joined
  UNION ALL SELECT 'all', round(a, 6), round(b, 6), n, round(a / b, 6), NULL FROM whole""")
def m9(spark, sf):
    stamps = stamps8(spark, sf)
    return rounded_all(sp.band_ratio(stamps.where("label % 2 = 0"), stamps.where("label % 2 = 1"), SCALES))


@query("m10_gaussian_floor", BAND_CTES + """, power AS (SELECT ky, kx, avg(p) / 64 AS p FROM spectrum GROUP BY ky, kx)
  SELECT sigma, round(avg(p / (p + sigma * sigma)), 6) AS floor FROM power, (SELECT unnest([1e0, 10e0, 50e0, 200e0]) AS sigma) GROUP BY sigma""")
def m10(spark, sf):
    sigmas = F.array(*[F.lit(s) for s in (1.0, 10.0, 50.0, 200.0)])
    return sp.gaussian_floor(stamps8(spark, sf), 8, sigmas).select("sigma", rounded(F.col("floor")).alias("floor"))


@query("m11_ladder", ctes("px8") + """, ends AS (SELECT band_idx, min(sky_noise) / 20 AS lo, max(abs(v)) AS hi FROM px8 GROUP BY band_idx)
  SELECT band_idx, rung, round(lo * (hi / lo) ** (1 - rung / 7e0), 6) AS sigma, round(1 - rung / 7e0, 6) AS t FROM ends, (SELECT unnest(range(8)) AS rung)""")
def m11(spark, sf):
    stamps = stamps8(spark, sf)
    loudest = F.max(F.array_max(F.transform("image", lambda v: F.abs(v.cast("double")))))
    ends = stamps.groupBy("band_idx").agg((F.min("sky_noise") / 20).alias("lo"), loudest.alias("hi"))
    out = ends.select("band_idx", "lo", "hi", F.posexplode(im.ladder(F.col("lo"), F.col("hi"), 8)).alias("rung", "sigma"))
    return out.select("band_idx", F.col("rung").cast("bigint").alias("rung"), rounded(F.col("sigma")).alias("sigma"),
                      rounded(im.time_of_sigma(F.col("sigma"), F.col("lo"), F.col("hi"))).alias("t"))


# -- distances --------------------------------------------------------------
N_PAIRS = 512
_SAMPLE = f"(SELECT stamp_id FROM (SELECT DISTINCT stamp_id FROM px8) ORDER BY {hash_sql(4, 'stamp_id')}, stamp_id LIMIT {N_PAIRS})"
DISTANCE_SQL = """sampled AS (SELECT * FROM px8 WHERE stamp_id IN {sample}),
distances AS (SELECT a.stamp_id AS a, b.stamp_id AS b, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d FROM sampled a JOIN sampled b ON a.i = b.i AND a.stamp_id < b.stamp_id GROUP BY a.stamp_id, b.stamp_id)"""
PAIR_CTES = ctes("px8") + "," + DISTANCE_SQL.format(sample=_SAMPLE)


@query("j8_pair_table", PAIR_CTES + """ SELECT stamp_id, count(*) AS n_pairs, round(avg(d), 5) AS mean, round(min(d), 5) AS min, round(max(d), 5) AS max
  FROM (SELECT a AS stamp_id, d FROM distances UNION ALL SELECT b, d FROM distances) GROUP BY stamp_id""")
def j8(spark, sf):
    return rounded_all(pr.pair_table(stamps8(spark, sf), "stamp_id", N_PAIRS, seed=4), 5)


@query("m12_pair_distances", PAIR_CTES + """, d2 AS (SELECT count(*) AS n, avg(d) AS m, stddev_pop(d) AS s, min(d) AS lo, max(d) AS hi, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.9) AS p90,
  quantile_cont(d, 0.99) AS p99 FROM distances)
  SELECT (SELECT count(DISTINCT stamp_id) FROM sampled) AS n_patches, n AS n_pairs, 64 AS dim, round(m, 5) AS mean, round(s, 5) AS std, round(lo, 5) AS min, round(hi, 5) AS max, round(p50, 5) AS p50,
  round(p90, 5) AS p90, round(p99, 5) AS p99, round(hi / 8, 5) AS max_per_pixel, round(m / 8, 5) AS mean_per_pixel, round((SELECT min(v) FROM sampled), 5) AS x_min,
  round((SELECT max(v) FROM sampled), 5) AS x_max FROM d2""")
def m12(spark, sf):
    return rounded_all(pr.pair_distances(stamps8(spark, sf), "stamp_id", N_PAIRS, seed=4), 5)


@query("m13_sigma_range", XPX_CTES + """, per AS (SELECT band_idx, stamp_id, max(v) - min(v) AS r FROM xpx GROUP BY band_idx, stamp_id),
  range99 AS (SELECT band_idx, quantile_cont(r, 0.99) AS r99 FROM per GROUP BY band_idx)
  SELECT xpx.band_idx, round(greatest(1e-3, 5e-2 * (quantile_cont(v, 0.84) - quantile_cont(v, 0.16)) / 2), 6) AS sigma_min,
  round(greatest(2 * stddev_pop(v), any_value(r99)), 6) AS sigma_max FROM xpx JOIN range99 USING (band_idx) GROUP BY xpx.band_idx""")
def m13(spark, sf):
    stats = me.set_stats(xstamps(spark, sf), by=("band_idx",))
    return rounded_all(me.sigma_range(stats, "per-pixel").select("band_idx", "sigma_min", "sigma_max"))


_CHOSEN = f"chosen AS (SELECT stamp_id FROM (SELECT DISTINCT stamp_id FROM px8) ORDER BY {hash_sql(4, 'stamp_id')}, stamp_id LIMIT {N_PAIRS})"


@query("m13_sigma_range_pairs", XPX_CTES + "," + _CHOSEN + """, near AS (SELECT * FROM xpx WHERE stamp_id IN (SELECT stamp_id FROM chosen)),
  far AS (SELECT sqrt(max(d)) AS d FROM (SELECT sum((a.v - b.v) ** 2) AS d FROM near a JOIN near b ON a.y = b.y AND a.x = b.x AND a.stamp_id < b.stamp_id
  GROUP BY a.stamp_id, b.stamp_id))
  SELECT round(greatest(1e-3, 5e-2 * (quantile_cont(v, 0.84) - quantile_cont(v, 0.16)) / 2), 5) AS sigma_min, round((SELECT d FROM far), 5) AS sigma_max FROM near""")
def m13_pairs(spark, sf):
    x = xstamps(spark, sf)
    x = x.join(sample_n(x.select("stamp_id"), N_PAIRS, 4, "stamp_id"), "stamp_id", "left_semi")
    widest = pr.pair_distances(x, "stamp_id", None).first()["max"]
    return rounded_all(me.sigma_range(me.set_stats(x).withColumn("pair_max", F.lit(widest))).select("sigma_min", "sigma_max"), 5)


# The overlap of two shells is a piece of the normal curve, summed by Simpson's rule; halving finds the ratio at which it is a half.
_DIM, _PIECES = 16, 2000
_EDGE = lambda side: f"({_DIM ** 0.5}e0 * (g - 1) {side} 3e0 * g)"
_OVERLAP = (f"list_sum(list_transform(range({_PIECES + 1}), lambda j: (CASE WHEN j = 0 OR j = {_PIECES} THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) "
            f"* exp(-((low + j * (high - low) / {_PIECES}e0) ** 2) / 2))) * (high - low) / {_PIECES}e0 / 3 / sqrt(2 * pi())")
_GAMMA = f"""halved AS (SELECT 0 AS k, 1e0 + 1e-9 AS a, {me.WIDEST_RATIO}e0 AS b UNION ALL
  SELECT k + 1, CASE WHEN {_OVERLAP} > {me.SHELL_OVERLAP} THEN g ELSE a END, CASE WHEN {_OVERLAP} > {me.SHELL_OVERLAP} THEN b ELSE g END FROM (
    SELECT *, greatest({_EDGE('-')}, -9e0) AS low, least({_EDGE('+')}, 9e0) AS high FROM (SELECT *, (a + b) / 2 AS g FROM halved WHERE k < 80)))"""


@query("m14_n_steps", XPX_CTES + "," + _GAMMA + """, per AS (SELECT band_idx, stamp_id, max(v) - min(v) AS r FROM xpx GROUP BY band_idx, stamp_id),
  range99 AS (SELECT band_idx, quantile_cont(r, 0.99) AS r99 FROM per GROUP BY band_idx),
  levels AS (SELECT xpx.band_idx, greatest(1e-3, 5e-2 * (quantile_cont(v, 0.84) - quantile_cont(v, 0.16)) / 2) AS lo, greatest(2 * stddev_pop(v), any_value(r99)) AS hi
    FROM xpx JOIN range99 USING (band_idx) GROUP BY xpx.band_idx)
  SELECT band_idx, round(lo, 6) AS sigma_min, round(hi, 6) AS sigma_max, round(a, 6) AS gamma, CAST(ceil(greatest(ln(hi / lo) / ln(a), 1)) AS BIGINT) AS n_steps
  FROM levels, (SELECT a FROM halved WHERE k = 80)""")
def m14(spark, sf):
    stats = me.sigma_range(me.set_stats(xstamps(spark, sf), by=("band_idx",)), "per-pixel").withColumn("dim", F.lit(_DIM))
    return rounded_all(me.n_steps(stats).select("band_idx", "sigma_min", "sigma_max", "gamma", "n_steps"))


@query("m20_prepare")
def m20(spark, sf):
    return prepare(stamps8(spark, sf), TransformSettings(), PATCH, "stamp_id", seed=4)
