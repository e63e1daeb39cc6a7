import numpy as np
import pytest
from pyspark.sql import functions as F

from stampmill.cuts import HostCuts, from_mapping
from stampmill.operators import hosts as h


def greedy(rows, r):
    """Walk by (dec, id); drop a row nearer than r to a kept one."""
    kept = []
    for i, ra, dec in sorted(rows, key=lambda t: (t[2], t[0])):
        cos = max(np.cos(np.deg2rad(dec)), 1e-6)
        if not any(d >= dec - r and np.hypot((a - ra) * cos, d - dec) < r for _, a, d in kept):
            kept.append((i, ra, dec))
    return {i for i, _, _ in kept}


def frame(spark, rows):
    return spark.createDataFrame([(int(i), float(a), float(d)) for i, a, d in rows], "objectId long, coord_ra double, coord_dec double")


def ids(df):
    return {r["objectId"] for r in df.select("objectId").collect()}


def test_repeated_ids_and_rows(spark):
    rows = [(1, 10.0, 0.0), (1, 10.0, 0.0), (2, 20.0, 0.0), (3, 20.00001, 0.0), (3, 50.0, 0.0), (4, 60.0, 0.0), (4, 70.0, 0.0)]
    got = [(r["objectId"], r["coord_ra"]) for r in h.dedupe(frame(spark, rows), 0.5).collect()]
    assert sorted(got) == [(1, 10.0), (2, 20.0), (3, 50.0), (4, 60.0), (4, 70.0)]


def test_places_without_coordinates_stay_once(spark):
    df = spark.createDataFrame([(1, None, None), (2, 10.0, 0.0), (3, 10.00001, 0.0)], "objectId long, coord_ra double, coord_dec double")
    assert sorted(r["objectId"] for r in h.dedupe(df, 0.5).collect()) == [1, 2]


def test_two_near_one_far(spark):
    rows = [(1, 53.1, -28.0), (2, 53.1 + 1e-5, -28.0), (3, 53.5, -28.0)]
    assert ids(h.dedupe(frame(spark, rows), 0.5)) == {1, 3}


@pytest.mark.parametrize("dec0, spread", [(-28.0, 1.5), (85.0, 1.0), (-89.999, 1.0)])
def test_dense_field_is_the_greedy_walk(spark, dec0, spread):
    rng = np.random.default_rng(int(abs(dec0)) + 3)
    r = 0.5 / 3600
    dec = dec0 + rng.uniform(-1, 1, 120) * spread * 3 * r
    ra = 53.0 + rng.uniform(-1, 1, 120) * spread * 3 * r / np.cos(np.deg2rad(dec0))
    rows = list(zip(range(120), ra, dec))
    assert ids(h.dedupe(frame(spark, rows), 0.5)) == greedy(rows, r)


def test_a_third_of_all_rows_in_one_bucket(spark):
    rng = np.random.default_rng(5)
    r = 0.5 / 3600
    hot = [(i, 53.0 + rng.uniform(0, r), -28.0 + rng.uniform(0, r)) for i in range(700)]
    same = [(700 + i, 53.01, -28.0) for i in range(300)]
    far = [(1000 + i, 53.0 + i * 1e-3, -28.0 + rng.uniform(0, 0.5)) for i in range(1000)]
    rows = hot + same + far
    assert ids(h.dedupe(frame(spark, rows), 0.5)) == greedy(rows, r)


def test_partitioning_does_not_matter(spark):
    rng = np.random.default_rng(9)
    rows = [(i, 10 + rng.uniform(0, 0.0006), 5 + rng.uniform(0, 0.0006)) for i in range(60)]
    df = frame(spark, rows)
    assert ids(h.dedupe(df.repartition(1), 0.5)) == ids(h.dedupe(df.repartition(7), 0.5)) == greedy(rows, 0.5 / 3600)


def test_wrap_joins_both_sides_of_zero(spark):
    rows = [(1, 359.99999, 0.0), (2, 0.00001, 1e-9), (3, 180.0, 0.0)]
    assert ids(h.dedupe(frame(spark, rows), 0.5)) == {1, 2, 3}
    assert ids(h.dedupe(frame(spark, rows), 0.5, wrap=True)) == {1, 3}


def test_empty(spark):
    assert ids(h.dedupe(frame(spark, []).limit(0), 0.5)) == set()


def test_nan_and_null_never_pass(spark):
    nan = float("nan")
    cols = "objectId long, r_cModelFlux double, sersic_reff_major double, sersic_reff_minor double, refExtendedness double, sersic_index double"
    good = (1, 1e5, 2.0, 1.0, 1.0, 2.0)
    rows = [good] + [tuple([k + 2] + [bad if j == k else v for j, v in enumerate(good[1:])]) for k in range(5) for bad in (nan,)]
    rows += [tuple([k + 12] + [None if j == k else v for j, v in enumerate(good[1:])]) for k in range(5)]
    assert ids(h.host_cuts(spark.createDataFrame(rows, cols))) == {1}


def test_numeric_cuts_reach_the_scan(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("objectId"), F.lit(1e5).alias("r_cModelFlux"), F.lit(2.0).alias("sersic_reff_major"),
                                F.lit(1.0).alias("sersic_reff_minor"), F.lit(1.0).alias("refExtendedness"), F.lit(2.0).alias("sersic_index"), F.lit("x").alias("unused"))
    df.write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    cut = h.host_cuts(spark.read.parquet(str(tmp_path / "t"))).select("objectId")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    for column in ("r_cModelFlux", "sersic_reff_major", "refExtendedness", "sersic_index"):
        assert f"GreaterThan({column}" in plan or f"LessThanOrEqual({column}" in plan or f"GreaterThanOrEqual({column}" in plan
    assert "unused" not in plan


def test_sentinels(spark):
    out = h.unmask(spark.createDataFrame([(None, None, None, None), (1.5, 2, True, "a")], "f double, i int, b boolean, s string")).collect()
    assert np.isnan(out[0]["f"]) and out[0]["i"] == -1 and out[0]["b"] is None and out[0]["s"] is None
    assert tuple(out[1]) == (1.5, 2, True, "a")


def test_a_displaced_stamp_fails_the_job(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0, 2.001)], "got_ra double, got_dec double, coord_ra double, coord_dec double")
    with pytest.raises(Exception, match="pixel origins"):
        h.verify_centre(df).collect()


def test_boxes_round_halves_to_even(spark):
    df = spark.createDataFrame([(0.5, 1.5), (2.5, 3.5)], "x double, y double")
    got = [(r["x0"], r["x1"], r["y0"], r["y1"]) for r in h.stamp_box(df, 4).collect()]
    assert got == [(-2, 2, 0, 4), (0, 4, 2, 6)]


def test_unknown_settings_are_refused():
    with pytest.raises(ValueError):
        from_mapping(HostCuts, {"max_magg": 1})
    with pytest.raises(ValueError):
        HostCuts(band="x")


def test_which_cut_binds_changes_with_size(spark):
    rows = h.binding_table(spark).orderBy("sersic_reff_major").collect()
    assert [r["sersic_reff_major"] for r in rows] == [2.0, 4.0, 10.0, 20.0]
    assert [r["binding"] for r in rows] == ["magnitude", "magnitude", "surface brightness", "surface brightness"]
