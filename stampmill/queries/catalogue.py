"""Host selection on the objects view."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stampmill.cuts import HostCuts
from stampmill.functions.flux import flux_to_mag, mag_to_flux
from stampmill.operators import hosts as h
from stampmill.operators.ordering import top
from stampmill.queries import query
from stampmill.queries.gate import rounded
from stampmill.queries.views import ctes, objects

CUTS = HostCuts()
_FAINT, _BRIGHT = CUTS.flux_range
CUT_SQL = (
    f"r_cModelFlux > {_FAINT}e0 AND r_cModelFlux <= {_BRIGHT}e0 AND sersic_reff_major >= 15e-1 AND sersic_reff_major <= 30e0 "
    f"AND refExtendedness > 5e-1 AND r_cModelFlux >= {CUTS.flux_per_area}e0 * (sersic_reff_major * sersic_reff_minor) AND sersic_index <= 6e0"
)
FLAG_SQL = (
    "NOT sersic_unknown_flag AND NOT sersic_no_data_flag AND NOT r_pixelFlags_saturatedCenter AND NOT r_pixelFlags_interpolatedCenter"
)
MAG_SQL = "CASE WHEN r_cModelFlux > 0 THEN 314e-1 - 25e-1 * log10(r_cModelFlux) END"
_TWO_PI = repr(2 * math.pi) + "e0"

DEDUPE_CTES = f""", candidates AS (SELECT * FROM objects WHERE {CUT_SQL} AND {FLAG_SQL}),
placed AS (SELECT objectId AS id, coord_ra AS ra, coord_dec AS dec, CAST(floor(coord_dec * 7200) AS BIGINT) AS b FROM candidates),
edges AS (
  SELECT l.id AS late, e.id AS early FROM placed l JOIN placed e ON e.b IN (l.b - 1, l.b)
  AND (e.dec < l.dec OR (e.dec = l.dec AND e.id < l.id)) AND e.dec >= l.dec - 5e-1 / 36e2
  AND sqrt(((e.ra - l.ra) * cos(radians(l.dec))) ** 2 + (e.dec - l.dec) ** 2) < 5e-1 / 36e2),
rounds AS (
  SELECT 0 AS it, id, CASE WHEN id IN (SELECT late FROM edges) THEN 0 ELSE 1 END AS st FROM placed
  UNION ALL
  SELECT a.it + 1, a.id, CASE WHEN any_value(a.st) <> 0 THEN any_value(a.st) WHEN bool_or(o.st = 1) THEN 2
    WHEN bool_and(o.st = 2) THEN 1 ELSE 0 END
  FROM rounds a LEFT JOIN edges ON edges.late = a.id LEFT JOIN rounds o ON o.id = edges.early
  WHERE EXISTS (SELECT 1 FROM rounds WHERE st = 0) GROUP BY a.it, a.id),
hosts AS (
  SELECT candidates.* FROM candidates JOIN rounds ON objectId = id
  WHERE it = (SELECT max(it) FROM rounds) AND st = 1)
"""
HOSTS_CTES = ctes("objects") + DEDUPE_CTES


@query("p1_unmask", ctes("objects") + """SELECT o_orderkey, coalesce(CAST(o_custkey AS INT), -1) AS cust,
  coalesce(price, -1e0) AS price, flag FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS flag FROM orders)""")
def p1(spark, sf):
    from stampmill.queries.views import table

    raw = table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS INT) END").alias("cust"),
        F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END").alias("price"),
        F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END").alias("flag"),
    )
    out = h.unmask(raw)
    # NaN is shown as -1 so the comparison can see it.
    return out.withColumn("price", F.when(F.isnan("price"), -1.0).otherwise(F.col("price")))


@query("p2_host_cuts", ctes("objects") + f"SELECT objectId, r_cModelFlux, sersic_reff_major FROM objects WHERE {CUT_SQL}")
def p2(spark, sf):
    return h.host_cuts(objects(spark, sf), CUTS).select("objectId", "r_cModelFlux", "sersic_reff_major")


@query("p3_cone", ctes("objects") + """SELECT objectId FROM objects WHERE degrees(2 * asin(sqrt(
  sin(radians(coord_dec + 28e0) / 2) ** 2 + cos(radians(coord_dec)) * cos(radians(-28e0)) * sin(radians(coord_ra - 532e-1) / 2) ** 2))) <= 1e-1""")
def p3(spark, sf):
    return h.cone(objects(spark, sf), 53.2, -28.0, 0.1).select("objectId")


@query("p4_host_flags", ctes("objects") + f"SELECT objectId FROM objects WHERE {FLAG_SQL}")
def p4(spark, sf):
    return h.host_flags(objects(spark, sf), CUTS).select("objectId")


@query("p5_top", ctes("objects") + f"SELECT objectId, coord_dec FROM objects WHERE {CUT_SQL} ORDER BY coord_dec, objectId LIMIT 100")
def p5(spark, sf):
    return top(h.host_cuts(objects(spark, sf), CUTS).select("objectId", "coord_dec"), 100, "coord_dec", "objectId")


@query("p6_flux_to_mag", ctes("objects") + f"""SELECT objectId, round({MAG_SQL}, 6) AS mag,
  round(10e0 ** ((314e-1 - {MAG_SQL}) / 25e-1), 4) AS flux FROM objects""")
def p6(spark, sf):
    mag = flux_to_mag(F.col("r_cModelFlux"))
    return objects(spark, sf).select("objectId", rounded(mag).alias("mag"), rounded(mag_to_flux(mag), 4).alias("flux"))


@query("p7_mu_e", ctes("objects") + f"""SELECT objectId, round({MAG_SQL} + 25e-1 * log10({_TWO_PI} * (sersic_reff_major * sersic_reff_minor)), 6) AS mu_e
  FROM objects""")
def p7(spark, sf):
    return objects(spark, sf).select("objectId", rounded(h.mean_surface_brightness("r")).alias("mu_e"))


@query("p8_distortion", ctes("objects") + """SELECT objectId, round(q, 6) AS axis_ratio, round((1 - q * q) / (1 + q * q), 6) AS distortion
  FROM (SELECT objectId, sersic_reff_minor / sersic_reff_major AS q FROM objects)""")
def p8(spark, sf):
    return objects(spark, sf).select("objectId", rounded(h.axis_ratio()).alias("axis_ratio"), rounded(h.distortion()).alias("distortion"))


@query("p9_binding_cut", ctes("objects") + f"""SELECT objectId, round(m, 6) AS mag_from_sb, CASE WHEN 205e-1 < m THEN 'magnitude'
  ELSE 'surface brightness' END AS binding FROM (SELECT objectId, 255e-1 - 25e-1 * log10({_TWO_PI} * (sersic_reff_major * sersic_reff_minor)) AS m FROM objects)""")
def p9(spark, sf):
    return h.binding_cut(objects(spark, sf), CUTS).select("objectId", rounded(F.col("mag_from_sb")).alias("mag_from_sb"), "binding")


_SEP_SQL = """sqrt((((coord_ra + (objectId % 9) * 1e-5) - coord_ra) * cos(radians(coord_dec))) ** 2 + ((coord_dec - (objectId % 4) * 2e-5) - coord_dec) ** 2) * 36e2"""


@query("p11_separation", ctes("objects") + f"SELECT objectId, round({_SEP_SQL}, 6) AS centre_sep_arcsec FROM objects")
def p11(spark, sf):
    moved = objects(spark, sf).withColumn("got_ra", F.expr("coord_ra + (objectId % 9) * 1e-5")).withColumn(
        "got_dec", F.expr("coord_dec - (objectId % 4) * 2e-5"))
    return h.verify_centre(moved).select("objectId", rounded(F.col("centre_sep_arcsec")).alias("centre_sep_arcsec"))


@query("p12_stamp_box", ctes("objects") + """SELECT objectId, x0, x0 + 416 AS x1, y0, y0 + 416 AS y1 FROM (
  SELECT objectId, CAST(round_even(x, 0) AS BIGINT) - 208 AS x0, CAST(round_even(y, 0) AS BIGINT) - 208 AS y0 FROM objects)""")
def p12(spark, sf):
    return h.stamp_box(objects(spark, sf), 416).select("objectId", "x0", "x1", "y0", "y1")


@query("p16_data_id", ctes("coadds") + """SELECT '{"tract":"' || tract || '","patch":"' || patch || '","band":"' || band || '"}' AS data_id FROM coadds""")
def p16(spark, sf):
    from stampmill.queries.views import coadds

    return h.data_id_json(coadds(spark, sf), ("tract", "patch", "band")).select("data_id")


@query("j7_dedupe", HOSTS_CTES + "SELECT objectId FROM hosts")
def j7(spark, sf):
    return h.select_hosts(objects(spark, sf), CUTS).select("objectId")
