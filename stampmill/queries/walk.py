"""From selected hosts to accepted stamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampmill.cuts import BANDS, PatchCuts
from stampmill.operators import hosts as h, manifest as m, walk as w
from stampmill.operators.lineage import scratch_path, settle
from stampmill.operators.ordering import global_row_number
from stampmill.plans.extraction import extract
from stampmill.queries import query
from stampmill.queries.catalogue import CUTS, HOSTS_CTES, DEDUPE_CTES
from stampmill.queries.gate import MEASURES_SQL, rounded
from stampmill.queries.views import coadds, contributions, ctes, hash_sql, objects, stamps32
from stampmill.sources.pixels import by_patch, read_pixels, write_pixels

SEED, SIZE, TARGET = 7, 32, 300
USED_BANDS = ("g", "r", "i", "z")

_H = hash_sql(SEED, "objectId")
WALK_SQL = f"""ordered AS (SELECT *, {_H} AS shuffle FROM objects),
ranks AS (SELECT tract, patch, row_number() OVER (ORDER BY f.shuffle, f.id) - 1 AS patch_rank FROM (
  SELECT tract, patch, min({{'shuffle': shuffle, 'id': objectId}}) AS f FROM ordered GROUP BY tract, patch)),
walk AS (SELECT ordered.*, patch_rank FROM ordered JOIN ranks USING (tract, patch))"""
_CELLS = """SELECT *, unnest(range(CAST(floor((round_even(x, 0) - 16) / 150) AS BIGINT), CAST(floor((round_even(x, 0) + 15) / 150) AS BIGINT) + 1)) AS ci"""
VISITS_SQL = "visits AS (SELECT tract, patch, band_idx, cell_i, cell_j, count(DISTINCT visit) AS n_visits FROM contributions GROUP BY ALL)"
DEPTH_SQL = f"""tried AS (SELECT o.objectId, o.tract, o.patch, o.x, o.y, c.band_idx, c.band FROM objects o JOIN coadds c
  ON o.tract = c.tract AND o.patch = c.patch WHERE c.band IN ('g', 'r', 'i', 'z')),
cells AS (SELECT *, unnest(range(CAST(floor((round_even(y, 0) - 16) / 150) AS BIGINT), CAST(floor((round_even(y, 0) + 15) / 150) AS BIGINT) + 1)) AS cj
  FROM ({_CELLS} FROM tried)),
depth AS (SELECT cells.objectId, cells.band_idx, count(*) AS n_cells_spanned, count(*) FILTER (n_visits IS NULL) AS n_cells_missing,
  min(coalesce(n_visits, 0)) AS n_visits_min, max(coalesce(n_visits, 0)) AS n_visits_max
  FROM cells LEFT JOIN visits v ON v.tract = cells.tract AND v.patch = cells.patch AND v.band_idx = cells.band_idx AND v.cell_i = ci AND v.cell_j = cj
  GROUP BY cells.objectId, cells.band_idx)"""
_ALL = ctes("objects", "coadds") + "," + VISITS_SQL + "," + DEPTH_SQL


def tried(spark, sf):
    hosts = objects(spark, sf).select("objectId", "tract", "patch", "x", "y")
    return w.host_coadds(hosts, coadds(spark, sf), USED_BANDS)


def visits(spark, sf):
    return w.cell_visit_counts(contributions(spark, sf))


@query("a1_cell_visit_counts", ctes("contributions") + "," + VISITS_SQL + " SELECT * FROM visits")
def a1(spark, sf):
    return visits(spark, sf)


@query("j1_host_coadds", _ALL + " SELECT objectId, band FROM tried")
def j1(spark, sf):
    return tried(spark, sf).select("objectId", "band")


@query("j2_hosts_without_coadd", _ALL + """ SELECT objectId, tract, patch, '' AS band, 'no_coadd' AS reasons FROM objects
  WHERE (tract, patch) NOT IN (SELECT (tract, patch) FROM coadds WHERE band IN ('g', 'r', 'i', 'z'))""")
def j2(spark, sf):
    hosts = objects(spark, sf).select("objectId", "tract", "patch")
    none = w.hosts_without_coadd(hosts, coadds(spark, sf), USED_BANDS)
    return none.select("objectId", "tract", "patch", F.lit("").alias("band"), F.lit("no_coadd").alias("reasons"))


@query("j3_stamp_depth", _ALL + """ SELECT *, CASE WHEN n_visits_min > 0 THEN round(n_visits_max / n_visits_min, 6) ELSE -1e0 END AS cell_depth_ratio
  FROM depth""")
def j3(spark, sf):
    out = w.with_depth(tried(spark, sf), visits(spark, sf), SIZE)
    ratio = F.when(F.col("cell_depth_ratio") == float("inf"), -1.0).otherwise(F.round("cell_depth_ratio", 6))
    return out.select("objectId", "band_idx", *[F.col(c).cast("bigint").alias(c) for c in
                      ("n_cells_spanned", "n_cells_missing", "n_visits_min", "n_visits_max")], ratio.alias("cell_depth_ratio"))


@query("j4_off_grid", _ALL + " SELECT objectId, band_idx, 'off_the_grid:cells' AS reasons FROM depth WHERE n_cells_missing > 0")
def j4(spark, sf):
    out = w.off_grid(tried(spark, sf), visits(spark, sf), SIZE)
    return out.select("objectId", "band_idx", F.lit("off_the_grid:cells").alias("reasons"))


@query("j5_cell_convention", _ALL + " SELECT CAST(sum(n_cells_spanned - n_cells_missing) AS BIGINT) AS n_known_cells FROM depth")
def j5(spark, sf):
    stamps, known = tried(spark, sf), visits(spark, sf)
    w.check_cell_convention(stamps, known, SIZE)
    return w.covered_known_cells(stamps, known, SIZE).agg(F.count(F.lit(1)).alias("n_known_cells"))


@query("a6_visits_distribution", _ALL + """ SELECT count(*) AS n, CAST(min(n_visits) AS DOUBLE) AS min, quantile_cont(CAST(n_visits AS DOUBLE), 0.25) AS p25,
  quantile_cont(CAST(n_visits AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(n_visits AS DOUBLE), 0.75) AS p75, CAST(max(n_visits) AS DOUBLE) AS max
  FROM visits WHERE (tract, patch, band_idx) IN (SELECT (tract, patch, band_idx) FROM tried JOIN depth USING (objectId, band_idx) WHERE n_cells_missing = 0)""")
def a6(spark, sf):
    known = visits(spark, sf)
    read = w.with_depth(tried(spark, sf), known, SIZE).withColumn("was_read", F.col("n_cells_missing") == 0)
    return m.visits_per_cell(read, known)


@query("w0_global_row_number", ctes("objects") + f" SELECT objectId, row_number() OVER (ORDER BY {_H}, objectId) - 1 AS row_index FROM objects")
def w0(spark, sf):
    rows = objects(spark, sf).select("objectId", w.draw(SEED, "objectId").alias("h"))
    return global_row_number(rows, "h", "objectId").select("objectId", "row_index")


@query("w1_walk_order", ctes("objects") + "," + WALK_SQL + """ SELECT objectId, patch_rank,
  row_number() OVER (ORDER BY patch_rank, shuffle, objectId) - 1 AS walk_index FROM walk""")
def w1(spark, sf):
    walk = w.walk_order(objects(spark, sf).select("objectId", "tract", "patch"), SEED)
    return global_row_number(walk.select(*w.WALK), *w.WALK, name="walk_index").select("objectId", "patch_rank", "walk_index")


# Accepted stamps per host stand in for the gate here: orders are accepted by their own key.
_TAKEN = "CASE WHEN objectId % 7 = 0 THEN 3 WHEN objectId % 2 = 0 THEN 1 ELSE 0 END"


@query("w2_walk_until", ctes("objects") + "," + WALK_SQL + f""" SELECT objectId, accepted_before FROM (SELECT objectId, CAST(coalesce(sum({_TAKEN})
  OVER (ORDER BY patch_rank, shuffle, objectId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS accepted_before FROM walk)
  WHERE accepted_before < 1000""")
def w2(spark, sf):
    hosts = objects(spark, sf).select("objectId", "tract", "patch")
    taken = hosts.select("objectId", F.expr(_TAKEN).cast("bigint").alias("n_accepted")).where("n_accepted > 0")
    return w.walk_until(w.walk_order(hosts, SEED), taken, 1000).select("objectId", "accepted_before")


@query("w3_part", ctes("objects") + "," + WALK_SQL + " SELECT objectId, patch_rank FROM walk WHERE patch_rank % 4 = 1")
def w3(spark, sf):
    return w.part(w.walk_order(objects(spark, sf).select("objectId", "tract", "patch"), SEED), 1, 4).select("objectId", "patch_rank")


@query("j10_check_walk", _ALL + "," + WALK_SQL + """ SELECT objectId FROM (SELECT * FROM walk ORDER BY patch_rank, shuffle, objectId LIMIT 20)
  WHERE objectId IN (SELECT objectId FROM depth WHERE n_cells_missing = 0)""")
def j10(spark, sf):
    hosts = objects(spark, sf).select("objectId", "tract", "patch")
    read = w.with_depth(tried(spark, sf), visits(spark, sf), SIZE).where("n_cells_missing = 0")
    return w.check_walk(w.walk_order(hosts, SEED), read).select("objectId")


@query("u2_check_parts", ctes("objects") + "," + WALK_SQL + """, listed AS (SELECT DISTINCT k, tract, patch FROM walk, (SELECT unnest([0, 1, 2]) AS k)
  WHERE patch_rank % 4 = k OR (k = 0 AND patch_rank % 8 = 1))
  SELECT 'in two parts' AS problem, tract, patch FROM listed GROUP BY tract, patch HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'in no part', tract, patch FROM walk WHERE (tract, patch) NOT IN (SELECT (tract, patch) FROM listed)""")
def u2(spark, sf):
    walk = w.walk_order(objects(spark, sf).select("objectId", "tract", "patch"), SEED)
    # Parts 0 to 2 of 4, the first with some patches of the second: both faults must show.
    parts = [walk.where((F.col("patch_rank") % 4 == 0) | (F.col("patch_rank") % 8 == 1)), w.part(walk, 1, 4), w.part(walk, 2, 4)]
    return w.check_parts(parts, walk).select("problem", "tract", "patch")


# -- the whole extraction ---------------------------------------------------

PATCH_CUTS = PatchCuts(min_centre_sigma=None, max_variance_step=8.0)


#: Stamps that go to every task whole, 16 kB each; more of them are joined by key.
SENT_STAMPS = 4096


def pixels(spark, sf, hosts):
    """An image for each selected host and band, from the 32 px stamps, laid out by patch; some numbers have none."""
    stamps = settle(stamps32(spark, sf).drop("band_idx").withColumnRenamed("host_id", "s"))
    n = stamps.count()
    hosts = hosts.select("objectId", "tract", "patch")
    keys = w.host_coadds(hosts, coadds(spark, sf), USED_BANDS).select(
        F.col("objectId").alias("host_id"), "band_idx", "tract", "patch", ((F.col("objectId") * 6 + F.col("band_idx")) % (n + 4)).alias("s"))
    # Many hosts share a stamp here, so the table laid out by patch holds stamp numbers, and the stamps are kept once.
    path = scratch_path(spark, "pixels")
    write_pixels(by_patch(keys), path)
    table = read_pixels(spark, path, keys)
    return table.join(F.broadcast(stamps) if n <= SENT_STAMPS else stamps, "s").drop("s")


def run(spark, sf):
    hosts = settle(h.select_hosts(objects(spark, sf), CUTS))
    return extract(hosts, coadds(spark, sf), contributions(spark, sf), pixels(spark, sf, hosts), size=SIZE, cuts=PATCH_CUTS,
                   bands=USED_BANDS, seed=SEED, n_stamps=TARGET)


EXTRACT_CTES = (
    ctes("objects", "coadds", "px32") + "," + MEASURES_SQL + DEDUPE_CTES
    + "," + VISITS_SQL + "," + DEPTH_SQL + "," + WALK_SQL.replace("FROM objects", "FROM hosts") + """,
attempts AS (
  SELECT w.objectId AS host_id, w.tract, w.patch, w.patch_rank, w.shuffle, coalesce(t.band, '') AS band, coalesce(t.band_idx, -1) AS band_idx,
    d.n_visits_min AS lo, d.n_visits_max AS hi, n_cells_missing, g.s AS s, t.objectId IS NULL AS no_coadd, g.* EXCLUDE (s, n_visits_min, cell_depth_ratio)
  FROM walk w LEFT JOIN tried t ON t.objectId = w.objectId LEFT JOIN depth d ON d.objectId = t.objectId AND d.band_idx = t.band_idx
  LEFT JOIN gated g ON g.s = (t.objectId * 6 + t.band_idx) % ((SELECT count(*) FROM measured) + 4)),
reasoned AS (
  SELECT *, CASE WHEN no_coadd THEN 'no_coadd' WHEN n_cells_missing > 0 THEN 'off_the_grid:cells' WHEN s IS NULL THEN 'off_the_grid:read'
    ELSE array_to_string([r FOR r IN [
    CASE WHEN frac_no_data > 0 THEN 'no_data:' || printf('%.4f', frac_no_data) || '>0.0' END,
    CASE WHEN inner_frac_no_data > 0 THEN 'inner_no_data:' || printf('%.4f', inner_frac_no_data) || '>0.0' END,
    CASE WHEN hi / lo > 3.5 THEN 'cell_depth:' || printf('%.2f', bround_2(hi / lo)) || '>3.5' END,
    CASE WHEN variance_step > 8 THEN 'variance_step:' || printf('%.2f', variance_step) || '>8.0' END,
    CASE WHEN f_DETECTION_EDGE > 0 THEN 'zero_tol:DETECTION_EDGE' END,
    CASE WHEN f_COSMIC_RAY > 0.005 THEN 'COSMIC_RAY:' || printf('%.4f', f_COSMIC_RAY) || '>0.005' END,
    CASE WHEN f_INTERPOLATED > 0.02 THEN 'INTERPOLATED:' || printf('%.4f', f_INTERPOLATED) || '>0.02' END,
    CASE WHEN f_SATURATED > 0.005 THEN 'SATURATED:' || printf('%.4f', f_SATURATED) || '>0.005' END,
    CASE WHEN i_COSMIC_RAY > 0.005 THEN 'inner_COSMIC_RAY:' || printf('%.4f', i_COSMIC_RAY) || '>0.005' END,
    CASE WHEN i_INTERPOLATED > 0.001 THEN 'inner_INTERPOLATED:' || printf('%.4f', i_INTERPOLATED) || '>0.001' END,
    CASE WHEN i_SATURATED > 0 THEN 'inner_SATURATED:' || printf('%.4f', i_SATURATED) || '>0.0' END
    ] IF r IS NOT NULL], ';') END AS reasons FROM attempts),
per_host AS (SELECT host_id, patch_rank, shuffle, count(*) FILTER (reasons = '') AS taken FROM reasoned GROUP BY ALL),
walked AS (SELECT host_id FROM (SELECT host_id, coalesce(sum(taken) OVER (ORDER BY patch_rank, shuffle, host_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per_host) WHERE before < 300),
run_manifest AS (SELECT *, CASE WHEN reasons = '' THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN reasons = '' THEN row_number() OVER (PARTITION BY reasons = '' ORDER BY patch_rank, shuffle, host_id, band_idx) - 1 END AS patch_index
  FROM reasoned WHERE host_id IN (SELECT host_id FROM walked))
""").replace("bround_2(hi / lo)", "hi / lo")


@query("i6_extract", EXTRACT_CTES + " SELECT host_id, band, status, reasons, patch_index FROM run_manifest")
def i6(spark, sf):
    return run(spark, sf).manifest.select("host_id", "band", "status", "reasons", "patch_index")


@query("i6_accepted_stamps", EXTRACT_CTES + """ SELECT r.host_id, r.patch_index, CAST(band_idx AS BIGINT) AS band_idx, CAST(round(sky_noise, 3) AS DOUBLE) AS sky_noise,
  CAST(lo AS BIGINT) AS n_visits_min, round(t.total, 2) AS total FROM run_manifest r JOIN (SELECT s, sum(v) AS total FROM stamp_px GROUP BY s) t ON t.s = r.s
  WHERE status = 'accepted'""")
def i6_stamps(spark, sf):
    total = F.aggregate("image", F.lit(0.0), lambda a, v: a + v)
    return run(spark, sf).stamps.select("host_id", "patch_index", F.col("band_idx").cast("bigint").alias("band_idx"),
        rounded(F.col("sky_noise"), 3).alias("sky_noise"), F.col("n_visits_min").cast("bigint").alias("n_visits_min"), rounded(total, 2).alias("total"))


@query("a7_run_counts", EXTRACT_CTES + f""" SELECT (SELECT count(*) FROM hosts) AS host_candidates, count(DISTINCT host_id) AS hosts_tried,
  count(DISTINCT host_id) FILTER (reasons = 'no_coadd') AS hosts_with_no_coadd,
  (SELECT count(*) FROM (SELECT host_id FROM run_manifest GROUP BY host_id HAVING bool_and(reasons LIKE 'off_the_grid%'))) AS hosts_off_the_grid,
  count(*) FILTER (reasons LIKE 'off_the_grid%') AS stamps_off_the_grid, count(*) AS stamps_attempted,
  count(*) FILTER (status = 'accepted') AS stamps_accepted, count(*) FILTER (status = 'rejected') AS stamps_rejected,
  CAST({TARGET} AS BIGINT) AS stamps_requested FROM run_manifest""")
def a7(spark, sf):
    n = h.select_hosts(objects(spark, sf), CUTS).count()
    return m.run_counts(n, run(spark, sf).manifest, TARGET)


@query("a8_first_failures", EXTRACT_CTES + """ SELECT split_part(reasons, ':', 2) AS kind, arg_min(CASE WHEN n_cells_missing > 0
  THEN n_cells_missing || ' cells were never built' ELSE 'no pixels' END, {'a': patch_rank, 'b': shuffle, 'c': host_id, 'd': band_idx}) AS message, count(*) AS n
  FROM run_manifest WHERE reasons LIKE 'off_the_grid:%' GROUP BY kind""")
def a8(spark, sf):
    manifest = run(spark, sf).manifest
    placed = manifest.withColumn("walk_index", F.struct("patch_rank", "shuffle", "host_id"))
    return m.first_failures(placed)
