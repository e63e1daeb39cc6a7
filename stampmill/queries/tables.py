"""Sources, sinks, merged parts and the run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampmill.cuts import HostCuts
from stampmill.operators import hosts as h, manifest as m, runlog as rl
from stampmill.operators.lineage import scratch_path
from stampmill.queries import query
from stampmill.queries.catalogue import CUTS, CUT_SQL, FLAG_SQL, HOSTS_CTES, MAG_SQL
from stampmill.queries.gate import MANIFEST_CTES, MEASURES_SQL, manifest32, rounded, with_depth
from stampmill.queries.measures import rounded_all
from stampmill.queries.views import ctes, hash_sql, objects, run_log, stamps8, stamps32
from stampmill.sources import catalogue as sc, stamps as ss, tables as st


def stored(spark, sf):
    """The 32 px stamps with some of their metadata."""
    stamps = with_depth(stamps32(spark, sf))
    return stamps.select("host_id", "band_idx", "native_size", "image", "n_visits_min", "cell_depth_ratio", F.lit(10.5).alias("sky_noise"))


@query("s1_read_stamps", ctes("px32") + "SELECT CAST(s % 6 AS INT) AS band_idx, count(DISTINCT s) AS n, count(*) AS n_pixels, round(sum(v), 2) AS total FROM stamp_px GROUP BY s % 6")
def s1(spark, sf):
    path = scratch_path(spark, "stamps")
    ss.write_stamps(stored(spark, sf), path, 10)
    found = ss.read_stamps(spark, path)
    total = F.aggregate("image", F.lit(0.0), lambda a, v: a + v)
    return found.groupBy(F.col("band_idx").cast("int").alias("band_idx")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("image")).alias("n_pixels"), F.round(F.sum(total), 2).alias("total"))


@query("s2_write_stamps", ctes("px32") + """SELECT DISTINCT s AS host_id, -1 AS x0, 10.5e0 AS sky_noise, CAST(1 + s % 4 AS BIGINT) AS n_visits_min, TRUE AS no_step,
  3 AS schema_version FROM stamp_px""")
def s2(spark, sf):
    path = scratch_path(spark, "stamps")
    ss.write_stamps(stored(spark, sf), path, 10)
    return ss.read_stamps(spark, path).select("host_id", "x0", F.col("sky_noise").cast("double").alias("sky_noise"), F.col("n_visits_min").cast("bigint").alias("n_visits_min"),
                                              F.isnan("variance_step").alias("no_step"), "schema_version")


@query("s3_repack", ctes("px32") + "SELECT host_id, CAST((row_number() OVER (ORDER BY band_idx, host_id) - 1) // 8 AS BIGINT) AS file_id FROM (SELECT DISTINCT s AS host_id, s % 6 AS band_idx FROM stamp_px)")
def s3(spark, sf):
    path = scratch_path(spark, "repacked")
    stamps = ss.stored_form(stored(spark, sf))
    ss.repack(stamps, path, 8, ("band_idx", "host_id"))
    ss.repack(stamps, path, 8, ("band_idx", "host_id"), mode="overwrite")
    return spark.read.parquet(path).select("host_id", F.col("file_id").cast("bigint").alias("file_id"))


@query("s4_read_catalogue", ctes("objects") + "SELECT objectId, coord_ra, coord_dec, r_cModelFlux, g_blendedness FROM objects")
def s4(spark, sf):
    path = scratch_path(spark, "objects")
    objects(spark, sf).write.parquet(path)
    return sc.read_catalogue(spark, path, ("g", "r")).select("objectId", "coord_ra", "coord_dec", "r_cModelFlux", "g_blendedness")


@query("s5_cached_selection", ctes("objects") + f"SELECT objectId FROM objects WHERE {CUT_SQL} AND {FLAG_SQL}")
def s5(spark, sf):
    path, text = scratch_path(spark, "selection"), sc.selection_text(CUTS, ("r",), source=sf)

    def select():
        return h.host_flags(h.host_cuts(objects(spark, sf), CUTS), CUTS).select("objectId")

    sc.cached(spark, select, path, text)
    return sc.cached(spark, select, path, text)


@query("s6_tables", MANIFEST_CTES + "SELECT host_id, status, reasons FROM manifest")
def s6(spark, sf):
    path = scratch_path(spark, "manifest")
    st.write_table(manifest32(spark, sf), path)
    return st.read_table(spark, path).select("host_id", "status", "reasons")


def _parts(spark, sf):
    """Two parts of a campaign, each written as its own table; one lacks a column."""
    path = scratch_path(spark, "parts")
    st.write_table(manifest32(spark, sf).select("host_id", "status", "reasons", "diag_sky_noise"), path)
    manifest = st.read_table(spark, path)
    return [manifest.where("host_id % 2 = 0"), manifest.where("host_id % 2 = 1").drop("diag_sky_noise")]


@query("u1_union_parts", MANIFEST_CTES + "SELECT host_id, status, CASE WHEN host_id % 2 = 0 THEN round(sky_noise, 6) END AS sky_noise FROM manifest")
def u1(spark, sf):
    return st.union_parts(_parts(spark, sf)).select("host_id", "status", rounded(F.col("diag_sky_noise")).alias("sky_noise"))


@query("s7_merge_counters", MANIFEST_CTES + """, totals AS (
  SELECT host_id % 2 AS part, count(DISTINCT host_id) AS hosts_tried, 0 AS none, count(*) AS attempted, count(*) FILTER (status = 'accepted') AS accepted FROM manifest GROUP BY 1),
counters AS (
  SELECT part, 'counts' AS block, unnest(['hosts_tried', 'hosts_with_no_coadd', 'hosts_off_the_grid', 'stamps_off_the_grid', 'stamps_attempted', 'stamps_accepted', 'stamps_rejected']) AS name,
    unnest([hosts_tried, none, none, none, attempted, accepted, attempted - accepted]) AS v FROM totals
  UNION ALL SELECT host_id % 2, 'rejection_counts', reason, count(*) FROM (SELECT DISTINCT host_id, split_part(unnest(reason_list), ':', 1) AS reason FROM manifest WHERE status <> 'accepted') GROUP BY ALL)
  SELECT block, name, CAST(sum(v) AS DOUBLE) AS total, count(*) AS n_parts FROM counters GROUP BY block, name""")
def s7(spark, sf):
    parts = _parts(spark, sf)
    summaries = [m.run_summary(part, k, labels={"dataset": "stamps"}) for k, part in enumerate(parts)]
    return st.merge_parts(parts, parts, st.union_parts(summaries))[2]


@query("s8_read_run_log", ctes("run_log") + """SELECT step, round(loss, 6) AS loss FROM run_log WHERE event_type <> 'error'""")
def s8(spark, sf):
    path = scratch_path(spark, "log")
    kind = F.when(F.col("event_type") == "error", "stopped")
    lines = run_log(spark, sf).select("step", "loss", F.lit(0.0).alias("seconds"), kind.alias("event"))
    lines.write.json(path)
    return st.read_run_log(spark, path)["step"].select("step", rounded(F.col("loss")).alias("loss"))


@query("s8_read_run_log_evals", ctes("run_log") + """SELECT step, CAST(r AS INT) AS rung, round(loss / (r + 1), 6) AS loss_by_sigma FROM run_log, (SELECT unnest([0, 1, 2]) AS r) WHERE event_type = 'error'""")
def s8_evals(spark, sf):
    path = scratch_path(spark, "log")
    levels = F.array(*[F.lit(float(k)) for k in (1, 2, 3)])
    lines = run_log(spark, sf).select("step", F.when(F.col("event_type") == "error", "eval").alias("event"), levels.alias("sigma"),
                                      F.transform(levels, lambda s: F.col("loss") / s).alias("loss_by_sigma"))
    lines.write.json(path)
    return st.read_run_log(spark, path)["eval"].select("step", "rung", rounded(F.col("loss_by_sigma")).alias("loss_by_sigma"))


@query("s9_gather", ctes("objects") + f""", rows AS (SELECT objectId, row_number() OVER (ORDER BY objectId) - 1 AS row_index FROM objects),
  asked AS (SELECT CAST(o_orderkey AS BIGINT) AS ord, {hash_sql(12, 'o_orderkey')} % (SELECT count(*) FROM orders) AS row_index FROM orders)
  SELECT ord, row_index, objectId FROM asked JOIN rows USING (row_index)""")
def s9(spark, sf):
    from stampmill.functions.draws import draw
    from stampmill.operators.ordering import global_row_number

    rows = global_row_number(objects(spark, sf).select("objectId"), "objectId")
    n = rows.count()
    asked = objects(spark, sf).select(F.col("objectId").alias("ord"), F.pmod(draw(12, "objectId"), F.lit(n)).alias("row_index"))
    return ss.gather(rows, asked)


@query("s9_gather_images", ctes("px8") + f"""SELECT a.stamp_id AS ord, a.r AS row_index, round(sum(p.v * (p.i + 1)), 3) AS weighed
  FROM (SELECT stamp_id, {hash_sql(13, 'stamp_id')} % (SELECT count(*) FROM px8 WHERE i = 0) AS r FROM px8 WHERE i = 0) a JOIN px8 p ON p.stamp_id = a.r GROUP BY a.stamp_id, a.r""")
def s9_images(spark, sf):
    from stampmill.functions.draws import draw

    stamps = stamps8(spark, sf).select(F.col("stamp_id").alias("row_index"), "image")
    asked = stamps.select(F.col("row_index").alias("ord"), F.pmod(draw(13, "row_index"), F.lit(stamps.count())).alias("row_index"))
    weighed = F.aggregate(F.transform("image", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda t, v: t + v)
    return ss.gather(stamps, asked).select("ord", "row_index", rounded(weighed, 3).alias("weighed"))


# -- host population --------------------------------------------------------
_PANELS = {
    "host size": ("sersic_reff_major", 40), "host distortion": ("(1 - q * q) / (1 + q * q)", 40), "host magnitude": (MAG_SQL, 40),
    "host surface brightness": (f"{MAG_SQL} + 25e-1 * log10(6283185307179586e-15 * (sersic_reff_major * sersic_reff_minor))", 40),
    "host Sersic index": ("sersic_index", 40), "host blendedness": ("r_blendedness", 40),
}
_META_PANELS = {
    "local sky noise": ("sky_noise", 40), "variance step": ("variance_step", 40), "visits in shallowest cell": ("n_visits_min", 30),
    "coadd cells spanned": ("1 + s % 3", 20), "no-data fraction": ("frac_no_data", 40), "INEXACT_PSF fraction": ("f_INEXACT_PSF", 40), "REJECTED fraction": ("f_REJECTED", 40),
}


def _panel_sql(panels, source):
    return " UNION ALL ".join(f"SELECT '{p}' AS panel, CAST({v} AS DOUBLE) AS value, {b} AS bins FROM {source}" for p, (v, b) in panels.items())


@query("a10_host_population", ctes("objects", "px32") + "," + MEASURES_SQL + f""", chosen AS (SELECT *, sersic_reff_minor / sersic_reff_major AS q FROM objects WHERE {CUT_SQL}),
  long AS (SELECT * FROM ({_panel_sql(_PANELS, 'chosen')} UNION ALL {_panel_sql(_META_PANELS, 'manifest')}) WHERE isfinite(value)),
  edges AS (SELECT panel, CASE WHEN min(value) = max(value) THEN min(value) - 5e-1 ELSE min(value) END AS lo, CASE WHEN min(value) = max(value) THEN max(value) + 5e-1 ELSE max(value) END AS hi FROM long GROUP BY panel)
  SELECT panel, CAST(least(floor((value - lo) / (hi - lo) * bins), bins - 1) AS INT) AS bin, count(*) AS n FROM long JOIN edges USING (panel) GROUP BY 1, 2""")
def a10(spark, sf):
    meta = manifest32(spark, sf).select(
        F.col("diag_sky_noise").alias("sky_noise"), F.col("diag_variance_step").alias("variance_step"), "n_visits_min", (1 + F.col("host_id") % 3).alias("n_cells_spanned"),
        F.col("diag_frac_no_data").alias("frac_no_data"), F.col("diag_frac_INEXACT_PSF").alias("frac_inexact_psf"), F.col("diag_frac_REJECTED").alias("frac_rejected"))
    return m.host_population(h.host_cuts(objects(spark, sf), HostCuts()), meta)


# -- run log ----------------------------------------------------------------


@query("a14_loss_by_sigma", ctes("run_log") + """SELECT run_id, rung, round(avg(loss), 6) AS loss_by_sigma, round(stddev_pop(loss) / sqrt(count(*)), 6) AS loss_by_sigma_err, count(*) AS n FROM run_log GROUP BY run_id, rung""")
def a14(spark, sf):
    return rounded_all(rl.loss_by_sigma(run_log(spark, sf), ("run_id", "rung")))


@query("w8_ewma", ctes("run_log") + """, placed AS (SELECT run_id, step, loss, row_number() OVER (PARTITION BY run_id ORDER BY step) AS rn FROM run_log),
  walk AS (SELECT run_id, step, loss, rn, loss AS e FROM placed WHERE rn = 1
    UNION ALL SELECT p.run_id, p.step, p.loss, p.rn, 98e-2 * w.e + 2e-2 * p.loss FROM walk w JOIN placed p ON p.run_id = w.run_id AND p.rn = w.rn + 1)
  SELECT run_id, step, loss, round(e, 6) AS loss_ema FROM walk""")
def w8(spark, sf):
    out = rl.ewma(run_log(spark, sf), "run_id", "step", "loss")
    return out.withColumn("loss_ema", rounded(F.col("loss_ema")))


@query("w10_checkpoint_rows", ctes("run_log") + """SELECT step, loss FROM run_log WHERE step IN (
  SELECT CAST(round_even((SELECT max(step) FROM run_log) * i / 40e0, 0) AS BIGINT) FROM (SELECT unnest(range(1, 41)) AS i))""")
def w10(spark, sf):
    log = run_log(spark, sf).select("step", "loss")
    return rl.checkpoint_rows(log, log.agg(F.max("step")).first()[0], 40)
