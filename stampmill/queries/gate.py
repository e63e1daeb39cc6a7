"""Why were stamps rejected? Diagnostics, gate and rejection tallies on the 32 px stamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampmill.cuts import BANDS, PatchCuts, PatchSettings
from stampmill.functions.flux import finite
from stampmill.operators import gate as g, manifest as m
from stampmill.operators.lineage import scratch_path
from stampmill.operators.stamps import planes_from_mask
from stampmill.queries import query
from stampmill.queries.views import PLANES, ctes, stamps32

# Every cut on, with depth columns that make each of them fire.
CUTS = PatchCuts(min_visits=2, max_peaks=2, max_plane_fraction=PatchCuts().max_plane_fraction | {"SENSOR_EDGE": 0.01})


def rounded(column, digits=6):
    """Six decimals; NaN becomes null so both engines print the same."""
    column = column.cast("double")
    return F.when(finite(column), F.round(column, digits))


def with_depth(df):
    return df.withColumn("n_visits_min", (1 + F.col("host_id") % 4).cast("int")).withColumn(
        "cell_depth_ratio", (F.col("host_id") % 5).cast("double")
    )


def gated(spark, sf, cuts=CUTS):
    return g.gate(with_depth(stamps32(spark, sf)), cuts)


# The inner box of a 32 px stamp is 10 px from 11; the blocks are 8 px.
_INNER = "(x BETWEEN 11 AND 20 AND y BETWEEN 11 AND 20)"
_NO_DATA = "(isinf(var) OR var <= 0)"
MEASURES_SQL = f"""measured AS (
  SELECT s, avg(CASE WHEN {_NO_DATA} THEN 1e0 ELSE 0e0 END) AS frac_no_data,
    avg(CASE WHEN {_NO_DATA} THEN 1e0 ELSE 0e0 END) FILTER ({_INNER}) AS inner_frac_no_data,
    sqrt(median(var) FILTER (NOT {_NO_DATA})) AS sky_noise,
    median(v) FILTER (NOT {_NO_DATA}) AS sky,
    median(v) FILTER (x BETWEEN 8 AND 23 AND y BETWEEN 8 AND 23) AS centre
  FROM stamp_px GROUP BY s),
blocks AS (
  SELECT s, y // 8 AS blk_y, x // 8 AS blk_x, quantile_cont(var, 0.1) AS floor
  FROM stamp_px JOIN measured USING (s)
  WHERE NOT {_NO_DATA} AND v < sky + 3 * sqrt(var) GROUP BY s, blk_y, blk_x HAVING count(*) >= 32),
steps AS (
  SELECT s, CASE WHEN count(*) >= 2 AND min(floor) > 0 THEN max(floor) / min(floor) END AS variance_step
  FROM blocks GROUP BY s),
tall AS (
  SELECT a.s, a.y, a.x, sum(b.v ORDER BY b.y DESC) / 3 AS v FROM stamp_px a JOIN stamp_px b
  ON a.s = b.s AND a.x = b.x AND b.y BETWEEN a.y - 1 AND a.y + 1 WHERE a.y BETWEEN 1 AND 30 GROUP BY a.s, a.y, a.x),
smooth AS (
  SELECT a.s, a.y, a.x, sum(b.v ORDER BY b.x DESC) / 3 AS v FROM tall a JOIN tall b
  ON a.s = b.s AND a.y = b.y AND b.x BETWEEN a.x - 1 AND a.x + 1 WHERE a.x BETWEEN 1 AND 30 GROUP BY a.s, a.y, a.x),
peaks AS (
  SELECT s, count(*) FILTER (is_peak) AS n_peaks FROM (
    SELECT a.s, a.y, a.x, bool_and(a.v >= b.v) AND any_value(a.v) > 5 * any_value(sky_noise) / 3 AS is_peak
    FROM smooth a JOIN smooth b ON a.s = b.s AND b.y BETWEEN a.y - 3 AND a.y + 3 AND b.x BETWEEN a.x - 3 AND a.x + 3
    JOIN measured ON a.s = measured.s WHERE a.y BETWEEN 6 AND 25 AND a.x BETWEEN 6 AND 25 GROUP BY a.s, a.y, a.x)
  GROUP BY s),
plane_list AS (SELECT unnest([{", ".join(f"'{p}'" for p in PLANES)}]) AS plane, unnest({list(PLANES.values())}) AS bit),
fractions AS (
  SELECT s, plane, avg(CAST((bits >> bit) & 1 AS DOUBLE)) AS fraction,
    avg(CAST((bits >> bit) & 1 AS DOUBLE)) FILTER ({_INNER}) AS inner_fraction
  FROM stamp_px, plane_list GROUP BY s, plane),
planes AS (
  SELECT s, {", ".join(f"max(fraction) FILTER (plane = '{p}') AS f_{p}, max(inner_fraction) FILTER (plane = '{p}') AS i_{p}" for p in PLANES)}
  FROM fractions GROUP BY s),
gated AS (
  SELECT s, frac_no_data, inner_frac_no_data, sky_noise, variance_step, centre / sky_noise AS centre_sigma,
    CAST(coalesce(n_peaks, 0) AS DOUBLE) AS n_peaks, planes.* EXCLUDE (s),
    1 + s % 4 AS n_visits_min, CAST(s % 5 AS DOUBLE) AS cell_depth_ratio
  FROM measured LEFT JOIN steps USING (s) LEFT JOIN peaks USING (s) JOIN planes USING (s)),
judged AS (
  SELECT *, [r FOR r IN [
    CASE WHEN frac_no_data > 0 THEN 'no_data:' || printf('%.4f', frac_no_data) || '>0.0' END,
    CASE WHEN inner_frac_no_data > 0 THEN 'inner_no_data:' || printf('%.4f', inner_frac_no_data) || '>0.0' END,
    CASE WHEN n_visits_min < 2 THEN 'too_shallow:' || n_visits_min || '<2' END,
    CASE WHEN cell_depth_ratio > 3.5 THEN 'cell_depth:' || printf('%.2f', cell_depth_ratio) || '>3.5' END,
    CASE WHEN variance_step > 4 THEN 'variance_step:' || printf('%.2f', variance_step) || '>4.0' END,
    CASE WHEN centre_sigma < 2 THEN 'empty_centre:' || printf('%.2f', centre_sigma) || '<2.0' END,
    CASE WHEN n_peaks > 2 THEN 'crowded:' || CAST(n_peaks AS INT) || '>2' END,
    CASE WHEN f_DETECTION_EDGE > 0 THEN 'zero_tol:DETECTION_EDGE' END,
    CASE WHEN f_COSMIC_RAY > 0.005 THEN 'COSMIC_RAY:' || printf('%.4f', f_COSMIC_RAY) || '>0.005' END,
    CASE WHEN f_INTERPOLATED > 0.02 THEN 'INTERPOLATED:' || printf('%.4f', f_INTERPOLATED) || '>0.02' END,
    CASE WHEN f_SATURATED > 0.005 THEN 'SATURATED:' || printf('%.4f', f_SATURATED) || '>0.005' END,
    CASE WHEN f_SENSOR_EDGE > 0.01 THEN 'SENSOR_EDGE:' || printf('%.4f', f_SENSOR_EDGE) || '>0.01' END,
    CASE WHEN i_COSMIC_RAY > 0.005 THEN 'inner_COSMIC_RAY:' || printf('%.4f', i_COSMIC_RAY) || '>0.005' END,
    CASE WHEN i_INTERPOLATED > 0.001 THEN 'inner_INTERPOLATED:' || printf('%.4f', i_INTERPOLATED) || '>0.001' END,
    CASE WHEN i_SATURATED > 0 THEN 'inner_SATURATED:' || printf('%.4f', i_SATURATED) || '>0.0' END
  ] IF r IS NOT NULL] AS reason_list FROM gated),
manifest AS (
  SELECT *, s AS host_id, s AS manifest_index, CAST(s % 6 AS INT) AS band_idx, [{", ".join(f"'{b}'" for b in BANDS)}][s % 6 + 1] AS band,
    CASE WHEN len(reason_list) = 0 THEN 'accepted' ELSE 'rejected' END AS status,
    array_to_string(reason_list, ';') AS reasons
  FROM judged)
"""
MANIFEST_CTES = ctes("px32") + "," + MEASURES_SQL


def manifest32(spark, sf, cuts=CUTS):
    """A manifest of the gated 32 px stamps."""
    out = gated(spark, sf, cuts).drop("image", "variance", "mask", "planes")
    return m.band_name(out).select(
        "*",
        F.col("host_id").alias("manifest_index"),
        F.when(F.size("reasons") == 0, "accepted").otherwise("rejected").alias("status"),
        F.concat_ws(";", "reasons").alias("_text"),
    ).drop("reasons").withColumnRenamed("_text", "reasons")


@query("a3_plane_fractions", MANIFEST_CTES + """SELECT s AS host_id, plane, round(fraction, 6) AS fraction,
  round(inner_fraction, 6) AS inner_fraction FROM fractions""")
def a3(spark, sf):
    out = g.plane_fractions(stamps32(spark, sf))
    return out.select("host_id", "plane", rounded(F.col("fraction")).alias("fraction"), rounded(F.col("inner_fraction")).alias("inner_fraction"))


@query("i1_centre_sigma", MANIFEST_CTES + "SELECT s AS host_id, round(centre_sigma, 6) AS centre_sigma FROM gated")
def i1(spark, sf):
    measured = stamps32(spark, sf).withColumn("_d", g._depth_measures(0.34)("image", "variance"))
    sigma = g.centre_sigma(g.centre_median("image"), F.col("_d.sky_noise"))
    return measured.select("host_id", rounded(sigma).alias("centre_sigma"))


@query("i2_count_peaks", MANIFEST_CTES + "SELECT s AS host_id, CAST(n_peaks AS BIGINT) AS n_peaks FROM gated")
def i2(spark, sf):
    measured = stamps32(spark, sf).withColumn("_d", g._depth_measures(0.34)("image", "variance"))
    return measured.select("host_id", g.count_peaks("image", F.col("_d.sky_noise")).cast("bigint").alias("n_peaks"))


@query("i3_variance_floors", MANIFEST_CTES + """SELECT s AS host_id, row_number() OVER (PARTITION BY s ORDER BY blk_y, blk_x) - 1 AS block,
  round(floor, 6) AS floor FROM blocks""")
def i3(spark, sf):
    floors = stamps32(spark, sf).select("host_id", F.posexplode(g.variance_floors("variance", "image")).alias("block", "floor"))
    return floors.select("host_id", F.col("block").cast("bigint").alias("block"), rounded(F.col("floor")).alias("floor"))


@query("i4_variance_step", MANIFEST_CTES + "SELECT s AS host_id, round(variance_step, 6) AS variance_step FROM gated")
def i4(spark, sf):
    return stamps32(spark, sf).select("host_id", rounded(g.variance_step(g.variance_floors("variance", "image"))).alias("variance_step"))


@query("i5_gate", MANIFEST_CTES + """SELECT host_id, reasons, round(frac_no_data, 6) AS frac_no_data,
  round(inner_frac_no_data, 6) AS inner_frac_no_data, round(variance_step, 6) AS variance_step, round(sky_noise, 6) AS sky_noise,
  round(centre_sigma, 6) AS centre_sigma, n_peaks, round(f_INTERPOLATED, 6) AS frac_interpolated,
  round(f_SENSOR_EDGE, 6) AS frac_sensor_edge, round(i_SATURATED, 6) AS inner_frac_saturated, round(f_INEXACT_PSF, 6) AS frac_inexact_psf FROM manifest""")
def i5(spark, sf):
    d = {"frac_no_data": "frac_no_data", "inner_frac_no_data": "inner_frac_no_data", "variance_step": "variance_step",
         "sky_noise": "sky_noise", "centre_sigma": "centre_sigma", "n_peaks": "n_peaks", "frac_INTERPOLATED": "frac_interpolated", "frac_SENSOR_EDGE": "frac_sensor_edge",
         "inner_frac_SATURATED": "inner_frac_saturated", "frac_INEXACT_PSF": "frac_inexact_psf"}
    return manifest32(spark, sf).select("host_id", "reasons", *[rounded(F.col(f"diag_{k}")).alias(v) for k, v in d.items()])


@query("a4_rejection_counts", MANIFEST_CTES + """SELECT reason, count(*) AS n FROM (
  SELECT DISTINCT s, split_part(unnest(reason_list), ':', 1) AS reason FROM manifest WHERE status <> 'accepted')
  GROUP BY reason ORDER BY n DESC, reason""")
def a4(spark, sf):
    return m.rejection_counts(manifest32(spark, sf))


_DIAG_SQL = {"centre_sigma": "centre_sigma", "n_peaks": "n_peaks", "cell_depth_ratio": "cell_depth_ratio",
             "variance_step": "variance_step", "frac_no_data": "frac_no_data", "inner_frac_no_data": "inner_frac_no_data"}
_DIAG_SQL |= {f"{a}frac_{p}": f"{b}_{p}" for p in ("COSMIC_RAY", "INTERPOLATED", "SATURATED") for a, b in (("", "f"), ("inner_", "i"))}


@query("a5_diagnostic_percentiles", MANIFEST_CTES + "SELECT diagnostic, count(*) AS n, "
       + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in m.PERCENTILES)
       + " FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS diagnostic, CAST({v} AS DOUBLE) AS value FROM manifest" for k, v in _DIAG_SQL.items())
       + ") WHERE isfinite(value) GROUP BY diagnostic HAVING count(*) >= 2")
def a5(spark, sf):
    out = m.diagnostic_percentiles(manifest32(spark, sf))
    return out.select("diagnostic", "n", *[rounded(F.col(f"p{p}")).alias(f"p{p}") for p in m.PERCENTILES])


@query("a9_two_group_histogram", MANIFEST_CTES + """SELECT grp, bin, count(*) AS n FROM (
  SELECT status AS grp, CAST(least(floor((sky_noise - lo) / (hi - lo) * 40), 39) AS INT) AS bin
  FROM manifest, (SELECT min(sky_noise) AS lo, max(sky_noise) AS hi FROM manifest)) GROUP BY grp, bin""")
def a9(spark, sf):
    return m.histogram(manifest32(spark, sf), "diag_sky_noise", 40, group="status").withColumnRenamed("status", "grp")


@query("w9_top_reasons", MANIFEST_CTES + """SELECT reason, count(*) AS n FROM (
  SELECT DISTINCT s, split_part(unnest(reason_list), ':', 1) AS reason FROM manifest WHERE status <> 'accepted')
  GROUP BY reason ORDER BY n DESC, reason LIMIT 5""")
def w9(spark, sf):
    return m.top_k(m.rejection_counts(manifest32(spark, sf)), 5, "n", "reason")


@query("a2_pack_mask", ctes("px32") + """SELECT s AS host_id, i, (bits & 127) | (((bits >> 40) & 1) << 7) AS bits FROM stamp_px""")
def a2(spark, sf):
    planes = planes_from_mask(stamps32(spark, sf))
    packed = g.pack_mask(planes, PLANES)
    return packed.select("host_id", F.posexplode("mask").alias("i", "bits")).withColumn("i", F.col("i").cast("bigint"))


@query("j6_manifest_cut", MANIFEST_CTES + """SELECT host_id, band_idx FROM manifest
  WHERE status = 'accepted' AND f_SATURATED <= 1e-3 AND f_INTERPOLATED <= 1e-3""")
def j6(spark, sf):
    # The manifest is a written table by the time a loader cuts on it.
    path = scratch_path(spark, "manifest")
    manifest32(spark, sf).write.parquet(path)
    manifest = spark.read.parquet(path)
    accepted = manifest.where("status = 'accepted'").select("host_id", "band_idx")
    return m.manifest_cut(accepted, manifest, {"diag_frac_SATURATED": 1e-3, "diag_frac_INTERPOLATED": 1e-3})


@query("j6_usable", MANIFEST_CTES + """SELECT host_id, i, round(v, 4) AS v FROM stamp_px JOIN manifest ON stamp_px.s = manifest.s
  WHERE status = 'accepted' AND frac_no_data <= 5e-4 AND f_SATURATED <= 1e-3 AND f_INTERPOLATED <= 1e-3""")
def j6_usable(spark, sf):
    path = scratch_path(spark, "manifest")
    manifest32(spark, sf).write.parquet(path)
    manifest = spark.read.parquet(path)
    known = manifest.where("status = 'accepted'").select("host_id", F.col("diag_frac_no_data").alias("frac_no_data"))
    stamps = stamps32(spark, sf).join(known, "host_id")
    patch = PatchSettings(native_size=32, out_size=8, max_no_data=5e-4, max_frac_saturated=1e-3, max_frac_interpolated=1e-3)
    out = m.usable(stamps, patch, manifest).select("host_id", F.posexplode("image").alias("i", "v"))
    return out.select("host_id", F.col("i").cast("bigint").alias("i"), rounded(F.col("v"), 4).alias("v"))


@query("p10_no_data_cut", MANIFEST_CTES + "SELECT host_id, round(frac_no_data, 6) AS frac_no_data FROM manifest WHERE frac_no_data <= 5e-4")
def p10(spark, sf):
    rows = manifest32(spark, sf).select("host_id", F.col("diag_frac_no_data").alias("frac_no_data"))
    return m.no_data_cut(rows, 5e-4).select("host_id", rounded(F.col("frac_no_data")).alias("frac_no_data"))


@query("p17_band_index", MANIFEST_CTES + "SELECT host_id, band, band_idx FROM manifest")
def p17(spark, sf):
    names = manifest32(spark, sf).select("host_id", "band")
    return m.band_index(names)


@query("s10_band_counts", ctes("px32") + f"""SELECT b.band_idx, b.band, count(p.s) AS n FROM
  (SELECT unnest([0,1,2,3,4,5]) AS band_idx, unnest([{", ".join(f"'{b}'" for b in BANDS)}]) AS band) b
  LEFT JOIN (SELECT DISTINCT s FROM stamp_px) p ON p.s % 6 = b.band_idx GROUP BY ALL""")
def s10(spark, sf):
    return m.band_counts(stamps32(spark, sf))


@query("s11_set_report", MANIFEST_CTES + """SELECT count(*) AS n_rows, count(*) * 4096 AS image_bytes,
  count(*) FILTER (frac_no_data <= 0) AS n_kept, count(*) FILTER (frac_no_data > 0) AS n_held_back FROM manifest""")
def s11(spark, sf):
    stamps = stamps32(spark, sf).withColumn("_d", g._depth_measures(0.34)("image", "variance"))
    stamps = stamps.withColumn("frac_no_data", F.col("_d.frac_no_data"))
    return m.set_report(stamps, m.no_data_cut(stamps, 0.0))
