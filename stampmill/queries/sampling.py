"""Samples and batch plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampmill.cuts import PatchSettings
from stampmill.operators.batches import batch_plan, batches
from stampmill.operators.ordering import sample_n, sample_with_replacement
from stampmill.queries import query
from stampmill.queries.flux import CFG, FLOOR, log_sql
from stampmill.queries.gate import rounded
from stampmill.queries.images import blend_sql, turned_sql
from stampmill.queries.views import ctes, hash_sql, objects, stamps8

_PLAN = f""", spread AS (SELECT objectId, epoch, (SELECT count(*) FROM objects) AS n, row_number() OVER (PARTITION BY epoch ORDER BY {hash_sql(15, 'epoch', 'objectId')}, objectId) - 1 AS place
  FROM objects, (SELECT CAST(unnest(range(2)) AS INT) AS epoch)),
plan AS (SELECT epoch, epoch * (n // 128) + place // 128 AS batch_id, place % 128 AS slot, objectId FROM spread WHERE place < n // 128 * 128)"""


@query("w4_batch_plan", ctes("objects") + _PLAN + " SELECT *, [4, 2, 3][batch_id % 3 + 1] AS out_size FROM plan")
def w4(spark, sf):
    return batch_plan(objects(spark, sf).select("objectId"), 128, 15, 2, (4, 2, 3), "objectId")


@query("w4_batches", ctes("px8") + f""", ranked AS (
  SELECT stamp_id, row_number() OVER (ORDER BY {hash_sql(15, '0', 'stamp_id')}, stamp_id) - 1 AS place FROM (SELECT DISTINCT stamp_id FROM px8)),
plan AS (SELECT stamp_id, place // 64 AS batch_id, place % 64 AS slot, CASE WHEN (place // 64) % 2 = 0 THEN 3 ELSE 2 END AS out_size
  FROM ranked WHERE place < (SELECT count(*) // 64 * 64 FROM ranked)),
drawn AS (SELECT *, batch_id || ':' || slot AS d FROM plan),
moved AS (SELECT *, {hash_sql("'15y'", 'd')} % (9 - 2 * out_size) AS y0, {hash_sql("'15x'", 'd')} % (9 - 2 * out_size) AS x0, {hash_sql("'15d'", 'd')} % 8 AS k FROM drawn),
pooled AS (SELECT stamp_id, band_idx, label, any_value(sky_noise) AS sky_noise, (y - y0) // 2 AS py, (x - x0) // 2 AS px, avg(v) AS v FROM px8 JOIN moved USING (stamp_id)
  WHERE y BETWEEN y0 AND y0 + 2 * out_size - 1 AND x BETWEEN x0 AND x0 + 2 * out_size - 1 GROUP BY stamp_id, band_idx, label, py, px),
{blend_sql(FLOOR)},
logged AS (SELECT stamp_id, py * out_size + px AS i, py AS y, px AS x, {log_sql('f', FLOOR)} AS v, batch_id, slot, out_size, k FROM blended JOIN moved USING (stamp_id))
SELECT o.batch_id, o.slot, o.stamp_id, o.out_size, o.i, round(s.v, 6) AS v FROM (SELECT *, {turned_sql('out_size')} AS src FROM (
  SELECT *, CASE WHEN k >= 4 THEN out_size - 1 - x ELSE x END AS xx FROM logged)) o JOIN logged s ON s.stamp_id = o.stamp_id AND s.i = o.src""")
def w4_batches(spark, sf):
    stamps = stamps8(spark, sf)
    patch = PatchSettings(native_size=8, out_size=3, pool_factor=2, out_sizes=(2,))
    plan = batch_plan(stamps.select("stamp_id"), 64, 15, 1, patch.training_sizes, "stamp_id")
    out = batches(stamps, plan, CFG, patch, "stamp_id", seed=15).select("batch_id", "slot", "stamp_id", "out_size", F.posexplode("image").alias("i", "v"))
    return out.withColumns({"i": F.col("i").cast("bigint"), "v": rounded(F.col("v"))})


@query("w5_sample_n", ctes("objects") + f"SELECT objectId FROM objects ORDER BY {hash_sql(16, 'objectId')}, objectId LIMIT 1000")
def w5(spark, sf):
    return sample_n(objects(spark, sf).select("objectId"), 1000, 16, "objectId")


@query("w6_sample_with_replacement", ctes("objects") + f""", rows AS (SELECT objectId, row_number() OVER (ORDER BY objectId) - 1 AS rn FROM objects)
  SELECT i AS draw_index, objectId FROM (SELECT i, {hash_sql(17, 'i')} % (SELECT count(*) FROM objects) AS rn FROM (SELECT unnest(range(2000)) AS i)) JOIN rows USING (rn)""")
def w6(spark, sf):
    return sample_with_replacement(objects(spark, sf).select("objectId"), 2000, 17, "objectId")
