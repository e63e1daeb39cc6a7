"""The catalogue, coadd, stamp and log shapes, derived from the driver tables.

Every view is fixed arithmetic. The text in `*_SQL` is the same arithmetic as a DuckDB CTE, so
an oracle starts with `ctes("objects", ...)`. Number literals carry an exponent because that
makes them doubles in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stampmill.cuts import BANDS

# Mask plane numbers of the 32 px stamps.
PLANES = {
    "SATURATED": 0,
    "COSMIC_RAY": 1,
    "INTERPOLATED": 2,
    "DETECTION_EDGE": 3,
    "DETECTED": 4,
    "INEXACT_PSF": 5,
    "REJECTED": 6,
    "SENSOR_EDGE": 40,
}

_OBJECT_COLUMNS = {
    "objectId": "o_orderkey",
    "coord_ra": "53e0 + (o_custkey % 500) * 1e-3 + (o_orderkey % 7) * 5e-5",
    "coord_dec": "-28e0 - ((o_custkey - o_custkey % 500) / 500e0) * 1e-3 - (o_orderkey % 5) * 3e-5",
    "tract": "CAST(5063 + o_custkey % 3 AS INT)",
    "patch": "CAST(o_custkey % 25 AS INT)",
    "sersic_reff_major": "5e-1 + (o_custkey % 60) * 1e-1",
    "sersic_reff_minor": "(5e-1 + (o_custkey % 60) * 1e-1) * (3e-1 + (o_orderkey % 7) * 1e-1)",
    "sersic_index": "5e-1 + (o_orderkey % 70) * 1e-1",
    "refExtendedness": "CASE WHEN o_orderkey % 10 < 8 THEN 1e0 ELSE 0e0 END",
    "sersic_unknown_flag": "o_orderkey % 41 = 0",
    "sersic_no_data_flag": "o_orderkey % 43 = 0",
    "x": "((o_custkey * 37) % 900) + 5e-1 * (o_orderkey % 2)",
    "y": "((o_orderkey * 53) % 900) + 0e0",
}
for _band, _scale in (("g", "15e-1"), ("r", "2e0"), ("i", "25e-1")):
    _OBJECT_COLUMNS |= {
        f"{_band}_cModelFlux": f"o_totalprice * {_scale}",
        f"{_band}_blendedness": "(o_orderkey % 100) / 100e0",
        f"{_band}_pixelFlags_saturatedCenter": "o_orderkey % 19 = 0",
        f"{_band}_pixelFlags_interpolatedCenter": "o_orderkey % 23 = 0",
    }

_CONTRIBUTION_COLUMNS = {
    "tract": "CAST(5063 + l_suppkey % 3 AS INT)",
    "patch": "CAST(l_partkey % 25 AS INT)",
    "band_idx": "CAST((l_linenumber - 1) % 6 AS INT)",
    "cell_i": "CAST(l_orderkey % 6 AS INT)",
    "cell_j": "CAST(CAST(l_quantity AS BIGINT) % 6 AS INT)",
    "visit": "l_suppkey",
    "detector": "CAST(round(l_tax * 100) AS BIGINT)",
}
_COADD_RULE = "patch % 12 <> 11 AND (tract * 7 + patch * 3 + band_idx) % 11 <> 0"


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in columns.items())


_BAND_SQL = "[" + ", ".join(f"'{b}'" for b in BANDS) + "]"

_CTES = {
    "objects": f"objects AS (SELECT {_columns(_OBJECT_COLUMNS)} FROM orders)",
    "contributions": f"contributions AS (SELECT {_columns(_CONTRIBUTION_COLUMNS)} FROM lineitem)",
    "coadds": (
        f"coadds AS (SELECT DISTINCT tract, patch, band_idx, {_BAND_SQL}[band_idx + 1] AS band "
        f"FROM contributions WHERE {_COADD_RULE})"
    ),
    "px8": (
        "px8 AS (SELECT vec_id AS stamp_id, label, CAST(vec_id % 6 AS INT) AS band_idx, i // 8 AS y, i % 8 AS x, i, v, "
        "40e0 + (vec_id % 7) * 2e0 AS sky_noise FROM "
        "(SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, "
        "CAST(CAST(CAST(unnest(embedding) AS DOUBLE) * 400e0 AS FLOAT) AS DOUBLE) AS v FROM embeddings))"
    ),
    # 16 consecutive vectors tiled 4 x 4; a last stamp short of tiles begins again with its own first ones.
    "px32": """px32 AS (
  SELECT *, y * 32 + x AS i FROM (
    SELECT s, (p // 4) * 8 + k // 8 AS y, (p % 4) * 8 + k % 8 AS x, e
    FROM (SELECT s, p, s * 16 + p % least(16, (SELECT count(*) FROM embeddings) - s * 16) AS vec_id
      FROM (SELECT unnest(range((SELECT count(*) + 15 FROM embeddings) // 16)) AS s), (SELECT unnest(range(16)) AS p)) tiles
    JOIN (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings) USING (vec_id))),
stamp_px AS (
  SELECT s, y, x, i, v,
    CASE WHEN (s * 7 + i * 13) % 9973 = 0 THEN CAST('inf' AS DOUBLE)
      ELSE CAST(CAST((100e0 + greatest(v, 0e0)) * (CASE WHEN s % 4 = 1 AND x >= 16 THEN 6e0 ELSE 1e0 END) AS FLOAT) AS DOUBLE) END AS var,
    CAST(CASE WHEN v > 110 THEN 1 ELSE 0 END + CASE WHEN (s * 31 + i * 17) % 641 = 0 THEN 2 ELSE 0 END
      + CASE WHEN (s + i * 29) % 809 = 0 THEN 4 ELSE 0 END + CASE WHEN s % 13 = 0 AND y = 0 THEN 8 ELSE 0 END
      + CASE WHEN v > 50 THEN 16 ELSE 0 END + CASE WHEN y < 10 THEN 32 ELSE 0 END
      + CASE WHEN s % 5 = 0 THEN 64 ELSE 0 END + CASE WHEN (s * 5 + i) % 97 = 0 THEN 1099511627776 ELSE 0 END AS BIGINT) AS bits
  FROM (SELECT s, y, x, i, CAST(CAST(80e0 * e + (s % 5) * 30e0 * exp(-((x - 16) * (x - 16) + (y - 16) * (y - 16)) / 50e0)
    AS FLOAT) AS DOUBLE) AS v FROM px32))""",
    "run_log": (
        "run_log AS (SELECT event_id AS step, value AS loss, user_id AS run_id, event_type, "
        "CAST(json_extract(props, '$.k') AS BIGINT) AS rung FROM events)"
    ),
}
_NEEDS = {"coadds": ("contributions",)}


def ctes(*names: str) -> str:
    """`WITH ...` text for the named views and what they stand on."""
    ordered: list[str] = []
    for name in names:
        for wanted in (*_NEEDS.get(name, ()), name):
            if wanted not in ordered:
                ordered.append(wanted)
    return "WITH RECURSIVE " + ",\n".join(_CTES[n] for n in ordered) + "\n"


def hash_sql(seed, *keys: str) -> str:
    """DuckDB text of `draws.draw`."""
    joined = " || ':' || ".join([f"CAST({seed} AS VARCHAR)"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"CAST('0x' || substr(md5({joined}), 1, 15) AS BIGINT)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def objects(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(*[F.expr(t).alias(n) for n, t in _OBJECT_COLUMNS.items()])


def contributions(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(*[F.expr(t).alias(n) for n, t in _CONTRIBUTION_COLUMNS.items()])


def coadds(spark, sf) -> DataFrame:
    bands = F.array(*[F.lit(b) for b in BANDS])
    found = contributions(spark, sf).where(_COADD_RULE).select("tract", "patch", "band_idx").distinct()
    return found.withColumn("band", F.element_at(bands, F.col("band_idx") + 1))


def stamps8(spark, sf) -> DataFrame:
    """8 x 8 stamps, one per embedding."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("stamp_id"),
        "label",
        (F.col("vec_id") % 6).cast("int").alias("band_idx"),
        F.lit(8).alias("native_size"),
        F.expr("40e0 + (vec_id % 7) * 2e0").alias("sky_noise"),
        F.transform("embedding", lambda e: (e.cast("double") * F.lit(400.0)).cast("float")).alias("image"),
    )


def stamps32(spark, sf) -> DataFrame:
    """32 x 32 stamps with variance, mask and plane map; 16 embeddings each, the last one's repeated where it has fewer."""
    tiles = table(spark, sf, "embeddings").select(
        F.expr("vec_id div 16").alias("s"), (F.col("vec_id") % 16).alias("p"), "embedding"
    )
    grouped = tiles.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("p", "embedding"))).alias("t"))
    tile = lambda p: F.get("t", (p % F.size("t")).cast("int"))["embedding"]
    whole = grouped.withColumn("e", F.transform(F.sequence(F.lit(0), F.lit(15)), tile))
    image = """transform(sequence(0, 1023), i -> cast(80e0 * cast(e[((i div 256) * 4) + ((i % 32) div 8)]
        [((i div 32) % 8) * 8 + (i % 8)] as double) + (s % 5) * 30e0 *
        exp(-(((i % 32) - 16) * ((i % 32) - 16) + ((i div 32) - 16) * ((i div 32) - 16)) / 50e0) as float))"""
    variance = """transform(image, (v, i) -> if((s * 7 + i * 13) % 9973 = 0, cast('Infinity' as float),
        cast((100e0 + greatest(cast(v as double), 0e0)) * if(s % 4 = 1 and i % 32 >= 16, 6e0, 1e0) as float)))"""
    mask = """transform(image, (v, i) -> cast(if(v > 110, 1, 0) + if((s * 31 + i * 17) % 641 = 0, 2, 0)
        + if((s + i * 29) % 809 = 0, 4, 0) + if(s % 13 = 0 and i < 32, 8, 0) + if(v > 50, 16, 0)
        + if(i < 320, 32, 0) + if(s % 5 = 0, 64, 0) + if((s * 5 + i) % 97 = 0, 1099511627776L, 0L) as bigint))"""
    planes = F.create_map(*[F.lit(v) for pair in PLANES.items() for v in pair])
    return (
        whole.withColumn("image", F.expr(image))
        .withColumn("variance", F.expr(variance))
        .withColumn("mask", F.expr(mask))
        .select(
            F.col("s").alias("host_id"),
            (F.col("s") % 6).cast("int").alias("band_idx"),
            F.lit(32).alias("native_size"),
            F.lit(3).alias("schema_version"),
            "image",
            "variance",
            "mask",
            planes.alias("planes"),
        )
        # Pixel work is heavy for its bytes, so spread the few stamps evenly over the tasks.
        .repartition(spark.sparkContext.defaultParallelism, "host_id")
    )


def run_log(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("step"),
        F.col("value").alias("loss"),
        F.col("user_id").alias("run_id"),
        "event_type",
        F.from_json("props", "k bigint")["k"].alias("rung"),
    )
