"""Two-sample comparison of the two halves of the embeddings, told apart by label parity."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampmill.functions.mix import mix_sql, seed_of
from stampmill.operators import pairs as pr
from stampmill.operators.ordering import half_splits, sample_n
from stampmill.queries import query
from stampmill.queries.gate import rounded
from stampmill.queries.measures import rounded_all
from stampmill.queries.views import ctes, hash_sql, stamps8

# Sample of the two together, permutations, control splits.
N, P, REPEATS = 4096, 999, 5
LANDMARKS, ALPHA = 128, 0.01


def sample(spark, sf):
    stamps = stamps8(spark, sf)
    return stamps.join(sample_n(stamps.select("stamp_id"), N, 6, "stamp_id"), "stamp_id", "left_semi")


def halves(spark, sf):
    stamps = sample(spark, sf)
    return stamps.where("label % 2 = 0"), stamps.where("label % 2 = 1")


_SAMPLE = f"""sampled AS (SELECT * FROM px8 WHERE stamp_id IN (SELECT stamp_id FROM (SELECT DISTINCT stamp_id FROM px8)
  ORDER BY {hash_sql(6, 'stamp_id')}, stamp_id LIMIT {N})),
ids AS (SELECT stamp_id, 1 - label % 2 AS is_x FROM sampled WHERE i = 0),
vectors AS (SELECT stamp_id, list(v ORDER BY i) AS v FROM sampled GROUP BY stamp_id),
distances AS (SELECT a.stamp_id AS a, b.stamp_id AS b, list_distance(a.v, b.v) AS d FROM vectors a, vectors b)"""


def _ordered_sql(ids="ids"):
    return f"numbered AS (SELECT *, row_number() OVER (ORDER BY stamp_id) - 1 AS rn FROM {ids})"


def _energy_sql(marks="1"):
    """Statistic of each labelling in `labellings` (run, p, stamp_id, is_x); rows meet the columns that `marks` is 1 for."""
    dot = lambda side: f"list_inner_product(ds, {side})"
    mean = lambda c, side: f"sum(CASE WHEN l.is_x = {c} THEN {dot(side)} ELSE 0e0 END)"
    return f"""reach AS (SELECT a, list(d ORDER BY b) AS ds FROM distances GROUP BY a),
columns AS (SELECT run, p, list(CASE WHEN is_x = 1 THEN 1e0 * {marks} ELSE 0e0 END ORDER BY stamp_id) AS xs, list(CASE WHEN is_x = 0 THEN 1e0 * {marks} ELSE 0e0 END ORDER BY stamp_id) AS ys,
  sum(CASE WHEN is_x = 1 THEN 1e0 END) AS nx, sum(CASE WHEN is_x = 0 THEN 1e0 END) AS ny, sum(CASE WHEN is_x = 1 THEN 1e0 * {marks} END) AS mx, sum(CASE WHEN is_x = 0 THEN 1e0 * {marks} END) AS my
  FROM labellings GROUP BY run, p),
energies AS (SELECT run, p, {mean(1, "ys")} / (nx * my) + {mean(0, "xs")} / (ny * mx) - {mean(1, "xs")} / (nx * mx) - {mean(0, "ys")} / (ny * my) AS e
  FROM labellings l JOIN columns USING (run, p) JOIN reach ON a = l.stamp_id GROUP BY run, p, nx, ny, mx, my)"""


def _shuffled_sql(source, landmark="1"):
    """Labellings of `source` (run, stamp_id, rn, is_x): the given one, then reshuffles by mixed counters; -1 stays."""
    base = mix_sql(f"xor({mix_sql(f'xor({seed_of(chr(56) + chr(112))}, run::BIGINT)')}, p::BIGINT)")
    return f"""drawn AS (SELECT *, {mix_sql(f"xor(base, {mix_sql('rn')})")} AS h FROM {source},
  (SELECT p, r, {base.replace('run::', 'r::')} AS base FROM (SELECT unnest(range(1, {P + 1})) AS p), (SELECT DISTINCT run AS r FROM {source})) WHERE r = run),
labellings AS (SELECT run, 0 AS p, stamp_id, is_x, {landmark} AS mark FROM {source} UNION ALL
  SELECT run, p, stamp_id, CASE WHEN is_x < 0 THEN -1
    WHEN row_number() OVER (PARTITION BY run, p, {landmark}, is_x < 0 ORDER BY h) <= sum(CASE WHEN is_x = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY run, p, {landmark}) THEN 1 ELSE 0 END AS is_x, {landmark}
  FROM drawn)"""


_PERMUTED = _ordered_sql() + ", given AS (SELECT 0 AS run, * FROM numbered)," + _shuffled_sql("given")
_MARKED = (_ordered_sql() + f""", given AS (SELECT 0 AS run, *, CASE WHEN row_number() OVER (ORDER BY {hash_sql("'8l'", 'stamp_id')}, stamp_id) <= {LANDMARKS} THEN 1 ELSE 0 END AS landmark FROM numbered),"""
           + _shuffled_sql("given", "landmark"))
_SPLIT = _ordered_sql() + f""", given AS (SELECT run, stamp_id, rn, CASE WHEN place >= 2 * (n // 2) THEN -1 WHEN place < n // 2 THEN 1 ELSE 0 END AS is_x FROM (
  SELECT run, stamp_id, rn, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY {hash_sql(8, 'run', 'stamp_id')}, stamp_id) - 1 AS place
  FROM numbered, (SELECT unnest(range({REPEATS})) AS run))),""" + _shuffled_sql("given")
_JUDGED = """judged AS (SELECT n.run, count(*) AS permutations, any_value(o.e) AS statistic, avg(n.e) AS null_mean, stddev_pop(n.e) AS null_std,
  (1 + count(*) FILTER (n.e >= o.e)) / (1e0 + count(*)) AS p_value FROM energies n JOIN energies o ON o.run = n.run AND o.p = 0 WHERE n.p > 0 GROUP BY n.run)"""
_BASE = ctes("px8") + "," + _SAMPLE + ","


@query("m15_energy_distance", _BASE + "labellings AS (SELECT 0 AS run, 0 AS p, stamp_id, is_x FROM ids)," + _energy_sql()
       + " SELECT round(e, 5) AS statistic, (SELECT CAST(sum(is_x) AS BIGINT) FROM ids) AS n_x, (SELECT CAST(sum(1 - is_x) AS BIGINT) FROM ids) AS n_y, 64 AS dim FROM energies")
def m15(spark, sf):
    return rounded_all(pr.energy_distance(*halves(spark, sf), "stamp_id"), 5)


_TOLD = " SELECT permutations, round(statistic, 5) AS statistic, round(null_mean, 5) AS null_mean, round(null_std, 5) AS null_std, round(p_value, 6) AS p_value FROM judged"


def _told(out):
    return out.select("permutations", *[rounded(F.col(c), 5).alias(c) for c in ("statistic", "null_mean", "null_std")], rounded(F.col("p_value")).alias("p_value"))


@query("m16_permutation_test", _BASE + _PERMUTED + "," + _energy_sql() + "," + _JUDGED + _TOLD)
def m16(spark, sf):
    return _told(pr.permutation_test(*halves(spark, sf), "stamp_id", permutations=P, seed=8))


@query("m16_permutation_test_landmarks", _BASE + _MARKED + "," + _energy_sql("mark") + "," + _JUDGED + _TOLD)
def m16_landmarks(spark, sf):
    return _told(pr.permutation_test(*halves(spark, sf), "stamp_id", permutations=P, seed=8, landmarks=LANDMARKS))


@query("m17_control", _BASE + _SPLIT + "," + _energy_sql() + "," + _JUDGED + " SELECT run AS repeat_index, round(statistic, 5) AS statistic, round(p_value, 6) AS p_value FROM judged")
def m17(spark, sf):
    out = pr.control(sample(spark, sf), "stamp_id", repeats=REPEATS, permutations=P, seed=8)
    return out.select("repeat_index", rounded(F.col("statistic"), 5).alias("statistic"), rounded(F.col("p_value")).alias("p_value"))


# Run -1 is the test itself, the others are the controls.
_BOTH = (_ordered_sql() + """, given AS (SELECT -1 AS run, stamp_id, rn, is_x FROM numbered UNION ALL SELECT run, stamp_id, rn, is_x FROM control_given),"""
         + _shuffled_sql("given").replace("r::BIGINT", "greatest(r, 0)::BIGINT"))
_CONTROL_GIVEN = _SPLIT[_SPLIT.index("given AS") : _SPLIT.index("drawn AS")].replace("given AS", "control_given AS", 1).rstrip(", \n")


@query("m18_verdict", _BASE + _BOTH.replace(", given AS", ", " + _CONTROL_GIVEN + ", given AS", 1) + "," + _energy_sql() + "," + _JUDGED + f""",
controls AS (SELECT count(*) FILTER (p_value < {ALPHA}) AS rejected FROM judged WHERE run >= 0)
  SELECT round(p_value, 6) AS p_value, CASE WHEN rejected = 1 THEN 'one control rejected' ELSE '' END AS control_note,
  CASE WHEN rejected >= 2 THEN 'withheld' WHEN p_value < {ALPHA} THEN 'rejected' ELSE 'not rejected' END AS verdict FROM judged, controls WHERE run = -1""")
def m18(spark, sf):
    result = pr.permutation_test(*halves(spark, sf), "stamp_id", permutations=P, seed=8)
    runs = pr.control(sample(spark, sf), "stamp_id", repeats=REPEATS, permutations=P, seed=8)
    return pr.verdict(result, pr.control_summary(runs, ALPHA), ALPHA).select(rounded(F.col("p_value")).alias("p_value"), "control_note", "verdict")


@query("m19_test_cost", ctes("px8") + """, n AS (SELECT band_idx, count(*) FILTER (label % 2 = 0) AS n_x, count(*) FILTER (label % 2 = 1) AS n_y FROM px8 WHERE i = 0 GROUP BY band_idx)
  SELECT band_idx, n_x + n_y AS pooled, least(64, n_x + n_y) AS columns, round((n_x + n_y) * least(64, n_x + n_y) * 4 / 1e9, 9) AS matrix_gb, round((n_x + n_y) * 64 * 4 / 1e9, 9) AS samples_gb,
  (n_x + n_y) * 1e0 * least(64, n_x + n_y) * 64 AS flops, 64 >= n_x + n_y AS exact FROM n""")
def m19(spark, sf):
    n = stamps8(spark, sf).groupBy("band_idx").agg(
        F.count_if(F.col("label") % 2 == 0).alias("n_x"), F.count_if(F.col("label") % 2 == 1).alias("n_y"), F.max(F.size("image")).alias("dim"))
    out = n.select("band_idx", pr.test_cost(F.col("n_x"), F.col("n_y"), F.col("dim"), 64).alias("c")).select("band_idx", "c.*")
    return out.withColumns({c: F.round(c, 9) for c in ("matrix_gb", "samples_gb")})


@query("w7_half_splits", ctes("px8") + f""", ids AS (SELECT stamp_id FROM px8 WHERE i = 0)
  SELECT run AS repeat_index, stamp_id, CASE WHEN place < n // 2 THEN 0 ELSE 1 END AS half FROM (
  SELECT run, stamp_id, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY {hash_sql(8, 'run', 'stamp_id')}, stamp_id) - 1 AS place
  FROM ids, (SELECT CAST(unnest(range(4)) AS INT) AS run)) WHERE place < 2 * (n // 2)""")
def w7(spark, sf):
    return half_splits(stamps8(spark, sf).select("stamp_id"), 4, 8, "stamp_id")
