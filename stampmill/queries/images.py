"""Stamp operators on the 8 px and 32 px stamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampmill.cuts import PatchSettings, TransformSettings
from stampmill.functions import arrays as A
from stampmill.functions.mix import mix_sql
from stampmill.operators import images as im
from stampmill.queries import query
from stampmill.queries.flux import CFG, FLOOR, PATCH, POOLED_SQL, S, log_sql, pixels, pooled
from stampmill.queries.gate import rounded
from stampmill.queries.views import ctes, hash_sql, stamps8, stamps32

CROP = PatchSettings(native_size=8, out_size=2, pool_factor=2)


@query("i9_block_mean", ctes("px8") + "SELECT stamp_id, (y // 4) * 2 + x // 4 AS i, round(avg(v), 6) AS v FROM px8 GROUP BY stamp_id, y // 4, x // 4")
def i9(spark, sf):
    return pixels(im.block_mean(stamps8(spark, sf), 4))


# Footprint overlap of output pixel o (8/3 wide) with input pixel p.
_W = "greatest(least((o{0} + 1) * 8e0 / 3, {0} + 1) - greatest(o{0} * 8e0 / 3, {0}), 0e0) * 3 / 8e0"


@query("i10_area_resample", ctes("px8") + f"""SELECT stamp_id, CAST(oy * 3 + ox AS BIGINT) AS i, round(sum(v * ({_W.format('y')}) * ({_W.format('x')})), 6) AS v
  FROM px8, (SELECT unnest([0, 1, 2]) AS oy), (SELECT unnest([0, 1, 2]) AS ox) GROUP BY stamp_id, oy, ox""")
def i10(spark, sf):
    return pixels(im.area_resample(stamps8(spark, sf), 3))


@query("i11_to_grid", ctes("px8") + """SELECT stamp_id, ((y - 2) // 2) * 2 + (x - 2) // 2 AS i, round(avg(v), 6) AS v FROM px8
  WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY stamp_id, (y - 2) // 2, (x - 2) // 2""")
def i11(spark, sf):
    return pixels(im.to_grid(stamps8(spark, sf), CROP, "stamp_id"))


@query("i11_to_grid_translated", ctes("px8") + f"""SELECT stamp_id, ((y - y0) // 2) * 2 + (x - x0) // 2 AS i, round(avg(v), 6) AS v FROM
  (SELECT *, {hash_sql("'5y'", 'stamp_id')} % 5 AS y0, {hash_sql("'5x'", 'stamp_id')} % 5 AS x0 FROM px8)
  WHERE y BETWEEN y0 AND y0 + 3 AND x BETWEEN x0 AND x0 + 3 GROUP BY stamp_id, (y - y0) // 2, (x - x0) // 2""")
def i11_moved(spark, sf):
    return pixels(im.to_grid(stamps8(spark, sf), CROP, "stamp_id", seed=5, augment=True))


_SHARE = "greatest(least((o{0} + 1) * size / 2e0, {0} - {0}0 + 1) - greatest(o{0} * size / 2e0, {0} - {0}0), 0e0) * 2e0 / size"


@query("i11_to_grid_annulus", ctes("px8") + f""", sized AS (
  SELECT stamp_id, 4 + {hash_sql("'5s'", 'stamp_id')} % 2 AS size FROM (SELECT DISTINCT stamp_id FROM px8)),
ranged AS (SELECT *, (8 - size) // 2 AS middle, least(2, (8 - size) // 2) AS away FROM sized),
tries AS (SELECT stamp_id, t, {hash_sql("'5y'", 'stamp_id', 't')} % (2 * middle + 1) - middle AS dy, {hash_sql("'5x'", 'stamp_id', 't')} % (2 * middle + 1) - middle AS dx, away
  FROM ranged, (SELECT unnest(range(64)) AS t)),
landed AS (SELECT stamp_id, arg_min(dy, t) AS dy, arg_min(dx, t) AS dx FROM tries WHERE sqrt(dy * dy + dx * dx) >= away GROUP BY stamp_id),
placed AS (SELECT stamp_id, size, middle + coalesce(dy, least(CAST(ceil(away / sqrt(2e0)) AS BIGINT), middle)) AS y0,
  middle + coalesce(dx, least(CAST(ceil(away / sqrt(2e0)) AS BIGINT), middle)) AS x0 FROM ranged LEFT JOIN landed USING (stamp_id))
SELECT stamp_id, CAST(oy * 2 + ox AS BIGINT) AS i, round(sum(v * ({_SHARE.format('y')}) * ({_SHARE.format('x')})), 6) AS v
  FROM px8 JOIN placed USING (stamp_id), (SELECT unnest([0, 1]) AS oy), (SELECT unnest([0, 1]) AS ox) GROUP BY stamp_id, oy, ox""")
def i11_annulus(spark, sf):
    cfg = PatchSettings(native_size=8, out_size=2, pool_factor=2, min_shift_native=2, scale_jitter=0.3)
    return pixels(im.to_grid(stamps8(spark, sf), cfg, "stamp_id", seed=5, augment=True))


@query("i11_centre_crop", ctes("px8") + "SELECT stamp_id, (y - 1) * 6 + x - 1 AS i, round(v, 6) AS v FROM px8 WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6")
def i11_crop(spark, sf):
    return pixels(stamps8(spark, sf).withColumn("image", A.centre_crop(F.col("image"), 6)))


# Gaussian of width 1.5 cut at 6 px; on 4 px it covers everything.
def blend_sql(noise):
    k = "exp(-5e-1 * ((a.py - b.py) * (a.py - b.py) + (a.px - b.px) * (a.px - b.px)) / 225e-2)"
    return f"""smoothed AS (SELECT a.stamp_id, a.band_idx, a.label, a.py, a.px, any_value(a.sky_noise) AS sky_noise, any_value(a.v) AS v, sum({k} * b.v) / sum({k}) AS g
  FROM pooled a JOIN pooled b USING (stamp_id) GROUP BY a.stamp_id, a.band_idx, a.label, a.py, a.px),
blended AS (SELECT *, lam * v + (1 - lam) * g AS f FROM (SELECT *, 5e-1 * (tanh(5e-1 * (g / {noise} - 15e-1) / 3e-1) + 1) AS lam FROM smoothed))"""


BLEND_CTES = ctes("px8") + "," + POOLED_SQL + "," + blend_sql(FLOOR)


@query("i12_blend_sky", BLEND_CTES + " SELECT stamp_id, py * 4 + px AS i, round(f, 6) AS v FROM blended")
def i12(spark, sf):
    return pixels(im.blend_sky(pooled(spark, sf), im.pooled_noise(CFG, PATCH), 1.5, 1.5, 0.3))


# Connected blobs as closed sets: a lit pixel's label is the smallest index it can reach.
def _blob_sql(lit):
    return f"""lit AS ({lit}),
reach AS (
  SELECT stamp_id, i AS root, i, y, x FROM lit
  UNION
  SELECT r.stamp_id, r.root, l.i, l.y, l.x FROM reach r JOIN lit l ON l.stamp_id = r.stamp_id AND abs(l.y - r.y) <= 1 AND abs(l.x - r.x) <= 1),
blob AS (SELECT stamp_id, i, min(root) AS blob FROM reach GROUP BY stamp_id, i),
sized AS (SELECT *, count(*) OVER (PARTITION BY stamp_id, blob) AS n FROM blob)"""


_BLOB_SQL = _blob_sql("SELECT stamp_id, i, y, x, v FROM px8 WHERE v > sky_noise")


def _despeckled(spark, sf):
    return im.despeckle(stamps8(spark, sf), F.col("sky_noise"), F.lit(0.0), 3)


@query("i13_despeckle", ctes("px8") + "," + _BLOB_SQL + " SELECT p.stamp_id, p.i, round(CASE WHEN s.n <= 3 THEN 0e0 ELSE v END, 6) AS v FROM px8 p LEFT JOIN sized s ON s.stamp_id = p.stamp_id AND s.i = p.i")
def i13(spark, sf):
    return pixels(_despeckled(spark, sf))


@query("a17_despeckle_report", ctes("px8") + "," + _BLOB_SQL + """ SELECT (SELECT count(*) FROM px8 WHERE i = 0) AS n_stamps, count(DISTINCT (stamp_id, blob)) AS n_blobs,
  count(DISTINCT (stamp_id, blob)) FILTER (n <= 3) AS n_blobs_removed, (SELECT count(*) FROM px8) AS n_pixels, count(*) FILTER (n <= 3) AS n_pixels_removed FROM sized""")
def a17(spark, sf):
    return im.despeckle_report(_despeckled(spark, sf))


def turned_sql(side):
    """Where output pixel (y, xx) of an image comes from, by element k."""
    end = f"{side} - 1"
    return f"""CASE k % 4 WHEN 0 THEN y * {side} + xx WHEN 1 THEN xx * {side} + {end} - y
      WHEN 2 THEN ({end} - y) * {side} + {end} - xx ELSE ({end} - xx) * {side} + y END"""


def _dihedral_sql(k):
    return ctes("px8") + f"""SELECT o.stamp_id, o.i, round(s.v, 6) AS v FROM (SELECT *, {turned_sql(8)} AS src FROM (
  SELECT *, CASE WHEN k >= 4 THEN 7 - x ELSE x END AS xx FROM (SELECT stamp_id, i, y, x, {k} AS k FROM px8))) o
  JOIN px8 s ON s.stamp_id = o.stamp_id AND s.i = o.src"""


@query("i14_dihedral", _dihedral_sql("stamp_id % 8"))
def i14(spark, sf):
    return pixels(stamps8(spark, sf).withColumn("image", A.dihedral(F.col("image"), (F.col("stamp_id") % 8).cast("int"))))


@query("i14_random_dihedral", _dihedral_sql(hash_sql("'3d'", "stamp_id") + " % 8"))
def i14_random(spark, sf):
    return pixels(im.random_dihedral(stamps8(spark, sf), "stamp_id", seed=3))


@query("i15_to_log_space", BLEND_CTES + f" SELECT stamp_id, py * 4 + px AS i, round({log_sql('f', FLOOR)}, 6) AS v FROM blended")
def i15(spark, sf):
    return pixels(im.to_log_space(pooled(spark, sf), CFG, PATCH))


@query("i15_to_log_space_despeckled", BLEND_CTES + f""", logged AS (SELECT stamp_id, py * 4 + px AS i, py AS y, px AS x, {log_sql('f', FLOOR)} AS v,
  {log_sql(f'(2e0 * {FLOOR})', FLOOR)} AS least, {log_sql('0e0', FLOOR)} AS level FROM blended),""" + _blob_sql("SELECT stamp_id, i, y, x, v FROM logged WHERE v > least")
       + " SELECT p.stamp_id, p.i, round(CASE WHEN s.n <= 2 THEN level ELSE v END, 6) AS v FROM logged p LEFT JOIN sized s ON s.stamp_id = p.stamp_id AND s.i = p.i")
def i15_despeckled(spark, sf):
    cfg = TransformSettings(softening=S, pooled_noise_ratio=1.1, despeckle_max_pixels=2)
    return pixels(im.to_log_space(pooled(spark, sf), cfg, PATCH))


@query("i16_make_batch", BLEND_CTES + f" SELECT stamp_id, py * 4 + px AS i, round({log_sql('f', FLOOR)}, 6) AS v FROM blended")
def i16(spark, sf):
    return pixels(im.make_batch(stamps8(spark, sf), TransformSettings(softening=S, pooled_noise_ratio=1.1, fill_no_data=True), PATCH, "stamp_id"))


@query("i16_make_batch_augmented", ctes("px8") + f""", pooled AS (
  SELECT stamp_id, band_idx, label, any_value(sky_noise) AS sky_noise, (y - y0) // 2 AS py, (x - x0) // 2 AS px, avg(v) AS v FROM
    (SELECT *, {hash_sql("'9y'", 'stamp_id')} % 5 AS y0, {hash_sql("'9x'", 'stamp_id')} % 5 AS x0 FROM px8)
  WHERE y BETWEEN y0 AND y0 + 3 AND x BETWEEN x0 AND x0 + 3 GROUP BY stamp_id, band_idx, label, py, px),
{blend_sql(FLOOR)},
logged AS (SELECT stamp_id, py * 2 + px AS i, py AS y, px AS x, {log_sql('f', FLOOR)} AS v FROM blended)
SELECT o.stamp_id, o.i, round(s.v, 6) AS v FROM (SELECT *, {turned_sql(2)} AS src FROM (
  SELECT *, CASE WHEN k >= 4 THEN 1 - x ELSE x END AS xx FROM (SELECT stamp_id, i, y, x, {hash_sql("'9d'", 'stamp_id')} % 8 AS k FROM logged))) o
  JOIN logged s ON s.stamp_id = o.stamp_id AND s.i = o.src""")
def i16_augmented(spark, sf):
    return pixels(im.make_batch(stamps8(spark, sf), CFG, CROP, "stamp_id", seed=9, augment=True))


def _unit_sql(name):
    """The draw of a pixel's counter in one of the stamp's two streams."""
    return f"(({mix_sql(f'xor({name}, {mix_sql(chr(105))})')} + 5e-1) / 4294967296e0)"


_EPS = f"sqrt(-2e0 * ln({_unit_sql('one')})) * cos(6283185307179586e-15 * {_unit_sql('two')})"


@query("i17_forward_expand", ctes("px8") + f"""SELECT stamp_id, rung, i, round(v + sigma * eps, 6) AS v FROM (SELECT stamp_id, i, v, {_EPS} AS eps FROM
  (SELECT *, {hash_sql("'11a'", 'stamp_id')} % 4294967296 AS one, {hash_sql("'11b'", 'stamp_id')} % 4294967296 AS two FROM px8)),
  (SELECT r AS rung, 1e-1 * (50e0 / 1e-1) ** (1 - r / 3e0) AS sigma FROM (SELECT unnest([0, 1, 2, 3]) AS r))""")
def i17(spark, sf):
    out = im.forward_expand(stamps8(spark, sf), F.lit(0.1), F.lit(50.0), 4, "stamp_id", seed=11)
    return out.select("stamp_id", "rung", F.posexplode("image").alias("i", "v")).select(
        "stamp_id", "rung", F.col("i").cast("bigint").alias("i"), rounded(F.col("v")).alias("v"))


@query("j9_with_ladder", ctes("px8") + """SELECT stamp_id, rung, round(sky_noise / 100 * (sky_noise * 5 / (sky_noise / 100)) ** (1 - rung / 4e0), 6) AS sigma
  FROM px8, (SELECT unnest([0, 1, 2, 3, 4]) AS rung) WHERE i = 0""")
def j9(spark, sf):
    out = im.with_ladder(stamps8(spark, sf).drop("image"), F.col("sky_noise") / 100, F.col("sky_noise") * 5, 5)
    return out.select("stamp_id", "rung", rounded(F.col("sigma")).alias("sigma"))


@query("i18_pool_stamps", ctes("px8") + "," + POOLED_SQL + f""" SELECT stamp_id, py * 4 + px AS i, round(v, 6) AS v FROM pooled
  WHERE stamp_id IN (SELECT stamp_id FROM (SELECT DISTINCT stamp_id FROM px8) ORDER BY {hash_sql(2, 'stamp_id')}, stamp_id LIMIT 256)""")
def i18(spark, sf):
    return pixels(im.pool_stamps(stamps8(spark, sf), PATCH, "stamp_id", n=256, seed=2))


# -- repair -----------------------------------------------------------------


def holed(spark, sf):
    """32 px stamps with a 3 x 3 hole of zeros in two of three, and a lone non-finite pixel."""
    stamps = stamps32(spark, sf).select("host_id", "image", F.lit(10.0).alias("sky_noise"))
    return stamps.withColumn("image", F.expr("""transform(image, (v, i) -> if(host_id % 3 <> 0 and (i div 32) between 5 and 7 and (i % 32) between 9 and 11,
        cast(0 as float), if(host_id % 5 = 1 and i = 700, cast('NaN' as float), v)))"""))


# All sweeps at once: the stamp as a list, hole pixels inside the frame take the mean of their neighbours.
_FILLED = f"""holed AS (SELECT s, i, y, x, v, v = 0 OR (s % 3 <> 0 AND y BETWEEN 5 AND 7 AND x BETWEEN 9 AND 11) OR (s % 5 = 1 AND i = 700) AS hole FROM stamp_px),
frame AS (SELECT s, greatest(min(y) - {im.FILL_PAD}, 0) AS y0, least(max(y) + {im.FILL_PAD}, 31) AS y1, greatest(min(x) - {im.FILL_PAD}, 0) AS x0, least(max(x) + {im.FILL_PAD}, 31) AS x1,
  count(*) AS n FROM holed WHERE hole GROUP BY s),
rim AS (SELECT s, avg(v) AS start FROM holed JOIN frame USING (s) WHERE NOT hole AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY s),
laid AS (SELECT s, n, list(CASE WHEN hole THEN start ELSE v END ORDER BY i) AS a, list(hole AND y > y0 AND y < y1 AND x > x0 AND x < x1 ORDER BY i) AS moving
  FROM holed JOIN frame USING (s) JOIN rim USING (s) GROUP BY s, n),
swept AS (SELECT 0 AS k, s, n, a, moving FROM laid UNION ALL
  SELECT k + 1, s, n, list_transform(range(1, 1025), lambda j: CASE WHEN moving[j] THEN (a[j - 32] + a[j + 32] + a[j - 1] + a[j + 1]) / 4 ELSE a[j] END), moving FROM swept WHERE k < {im.FILL_SWEEPS}),
done AS (SELECT s, n, unnest(range(1024)) AS i, unnest(a) AS v FROM swept WHERE k = {im.FILL_SWEEPS} UNION ALL SELECT s, 0, i, v FROM stamp_px WHERE s NOT IN (SELECT s FROM frame))"""


@query("i7_fill_no_data", ctes("px32") + "," + _FILLED + " SELECT s AS host_id, n AS n_filled, CAST(i AS INT) AS i, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 3) AS v FROM done")
def i7(spark, sf):
    out = im.fill_no_data(holed(spark, sf))
    return out.select("host_id", "n_filled", F.posexplode("image").alias("i", "v")).withColumn("v", rounded(F.col("v").cast("double"), 3))


@query("a15_fill_report", ctes("px32") + """SELECT count(*) AS n_stamps, count(*) FILTER (n > 0) AS n_stamps_filled, CAST(sum(n) AS BIGINT) AS n_pixels_filled, max(n) AS largest_hole_px
  FROM (SELECT s, count(*) FILTER (v = 0 OR (s % 3 <> 0 AND y BETWEEN 5 AND 7 AND x BETWEEN 9 AND 11) OR (s % 5 = 1 AND i = 700)) AS n FROM stamp_px GROUP BY s)""")
def a15(spark, sf):
    return im.fill_report(im.fill_no_data(holed(spark, sf)))


# Noise 30, dark at or below -3, bright above 6: loose, so the signature occurs in these stamps.
def _sides(reach):
    near = "SELECT max(b.v) FROM stamp_px b WHERE b.s = a.s AND "
    return [f"({near} b.y = a.y AND b.x BETWEEN a.x - {reach} AND a.x - 1)", f"({near} b.y = a.y AND b.x BETWEEN a.x + 1 AND a.x + {reach})",
            f"({near} b.x = a.x AND b.y BETWEEN a.y - {reach} AND a.y - 1)", f"({near} b.x = a.x AND b.y BETWEEN a.y + 1 AND a.y + {reach})"]


def _dark_sql(reach):
    return ctes("px32") + ", dark AS (SELECT s, i, v FROM stamp_px a WHERE v <= -3 AND " + " AND ".join(f"{q} > 6" for q in _sides(reach)) + ")"


def _dark_input(spark, sf):
    return stamps32(spark, sf).select("host_id", "image", F.lit(30.0).alias("sky_noise"))


@query("i8_dark_inside_bright", _dark_sql(3) + " SELECT s AS host_id, i FROM dark")
def i8(spark, sf):
    out = im.dark_inside_bright(_dark_input(spark, sf), radius=3, dark_sigma=-0.1, bright_sigma=0.2)
    return out.select("host_id", F.explode("dark").alias("i")).withColumn("i", F.col("i").cast("bigint"))


@query("a16_dark_core_report", _dark_sql(3) + """, per AS (SELECT s, count(*) AS n, min(v) / 30 AS lo, median(v) / 30 AS mid, max(v) / 30 AS hi FROM dark GROUP BY s)
  SELECT (SELECT count(DISTINCT s) FROM stamp_px) AS n_stamps, CAST(0 AS BIGINT) AS n_with_detected_holes, CAST(0 AS BIGINT) AS n_pixels_detected,
  count(*) AS n_with_missed_holes, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pixels_missed, round(min(lo), 4) AS missed_min, round(max(hi), 4) AS missed_max, round(median(mid), 4) AS missed_median FROM per""")
def a16(spark, sf):
    return im.dark_core_report(im.dark_cores(_dark_input(spark, sf), radius=3, dark_sigma=-0.1, bright_sigma=0.2))


@query("a16_worst_dark_cores", _dark_sql(3) + " SELECT s AS host_id, count(*) AS n_missed FROM dark GROUP BY s ORDER BY n_missed DESC, s LIMIT 10")
def a16_worst(spark, sf):
    cores = im.dark_cores(_dark_input(spark, sf), radius=3, dark_sigma=-0.1, bright_sigma=0.2)
    return im.worst_dark_cores(cores, "host_id").select("host_id", "n_missed")
