import numpy as np
import pytest
from pyspark.sql import functions as F

from stampmill.cuts import PatchSettings, TransformSettings
from stampmill.functions import arrays as A
from stampmill.operators import images as im

RNG = np.random.default_rng(0)


def frame(spark, images, noise=1.0):
    return spark.createDataFrame([(i, np.asarray(a, float).ravel().tolist(), float(noise)) for i, a in enumerate(images)], "k long, image array<double>, sky_noise double")


def back(df, column="image"):
    rows = df.orderBy("k").select(column).collect()
    out = [np.array(r[0], dtype=float) for r in rows]
    return [a.reshape(int(a.size**0.5), -1) for a in out]


def test_pooling_white_noise_divides_its_sigma(spark):
    a = RNG.normal(size=(8, 64, 64))
    assert np.std(back(im.block_mean(frame(spark, a), 4))) == pytest.approx(0.25, rel=0.05)
    for x, y in zip(back(im.block_mean(frame(spark, a), 4)), back(im.area_resample(frame(spark, a), 16))):
        assert x == pytest.approx(y)
    with pytest.raises(Exception, match="does not divide"):
        im.block_mean(frame(spark, a), 5).collect()


def test_area_resample_keeps_the_mean_and_matches_the_integral(spark):
    a = RNG.normal(size=(11, 11))
    got = back(im.area_resample(frame(spark, [a]), 4))[0]
    edges = np.linspace(0, 11, 5)
    cs = np.concatenate([[0], np.cumsum(a.sum(1))])
    rows = np.diff(np.interp(edges, np.arange(12), cs)) / (11 / 4) / 11
    assert got.mean() == pytest.approx(a.mean()) and got.mean(1) == pytest.approx(rows)


@pytest.mark.parametrize("k", range(8))
def test_dihedral(spark, k):
    a = RNG.normal(size=(5, 5))
    want = np.rot90(a, k % 4)
    want = want[:, ::-1] if k >= 4 else want
    assert back(frame(spark, [a]).withColumn("image", A.dihedral(F.col("image"), k)))[0] == pytest.approx(want)


def test_crop(spark):
    a = np.arange(36.0).reshape(6, 6)
    df = frame(spark, [a])
    assert back(df.withColumn("image", A.crop(F.col("image"), 3, 1, 2)))[0] == pytest.approx(a[1:4, 2:5])
    assert back(df.withColumn("image", A.centre_crop(F.col("image"), 4)))[0] == pytest.approx(a[1:5, 1:5])
    with pytest.raises(Exception, match="does not fit"):
        df.withColumn("image", A.crop(F.col("image"), 3, 4, 0)).collect()


def test_offsets_stay_in_the_annulus(spark):
    cfg = PatchSettings(native_size=32, out_size=8, pool_factor=2, min_shift_native=4, max_shift_native=6)
    df = spark.range(300).select(F.col("id").alias("k"), F.array_repeat(F.lit(1.0), 1024).alias("image"))
    rows = im.crop_offsets(df, cfg, "k", seed=1).collect()
    d = np.array([(r["crop_y"] - 8, r["crop_x"] - 8) for r in rows])
    assert (np.hypot(*d.T) >= 4).all() and (np.abs(d) <= 6).all() and len(np.unique(d, axis=0)) > 40
    still = im.crop_offsets(df, cfg, "k", augment=False).first()
    assert (still["crop_y"] - 8, still["crop_x"] - 8) == (3, 3)  # ceil(4 / sqrt 2) on the diagonal


def test_jitter_sizes(spark):
    cfg = PatchSettings(native_size=32, out_size=8, pool_factor=2, scale_jitter=0.25)
    df = spark.range(300).select(F.col("id").alias("k"), F.array_repeat(F.lit(2.0), 1024).alias("image"))
    sizes = {r["crop_size"] for r in im.crop_offsets(df, cfg, "k", seed=1).collect()}
    assert sizes == set(range(13, 21))
    assert all(r == pytest.approx(np.full((8, 8), 2.0)) for r in back(im.to_grid(df, cfg, "k", seed=1, augment=True)))


def test_fill_leaves_a_smooth_cap(spark):
    y, x = np.mgrid[0:24, 0:24]
    plane = 5.0 + 0.5 * x + 0.25 * y
    holed = plane.copy()
    holed[8:14, 10:15] = 0.0
    holed[9, 11] = np.nan
    edge = plane.copy()
    edge[0, :4] = 0.0
    out = im.fill_no_data(frame(spark, [holed, edge, plane, np.zeros((6, 6))])).orderBy("k")
    got = [np.array(r["image"]) for r in out.collect()]
    assert [r["n_filled"] for r in out.collect()] == [30, 4, 0, 36]
    assert np.abs(got[0].reshape(24, 24) - plane).max() < 1.0
    assert (got[1] != 0).all() and got[2] == pytest.approx(plane.ravel()) and (got[3] == 0).all()


def test_dark_core_is_found_but_not_the_ring(spark):
    y, x = np.mgrid[0:64, 0:64] - 32
    r = np.hypot(y, x)
    star = np.where(r < 10, 5000.0, 0.5)
    star[r < 3] = -1.0
    got = im.dark_inside_bright(frame(spark, [star])).first()["dark"]
    assert sorted(got) == np.flatnonzero(r.ravel() < 3).tolist()
    core = im.dark_cores(frame(spark, [star])).first()
    assert core["n_missed"] == len(got) and core["missed_median"] == -1.0 and core["n_detected"] == 0


def blobs(lit):
    """Flood fill, eight neighbours."""
    left, out = {tuple(p) for p in np.argwhere(lit)}, []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            y, x = todo.pop()
            seen.append((y, x))
            near = [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (y + i, x + j) in left]
            left -= set(near)
            todo += near
        out.append(seen)
    return out


@pytest.mark.parametrize("share", [0.05, 0.3, 0.6, 1.0])
def test_despeckle_against_flood_fill(spark, share):
    a = np.where(RNG.uniform(size=(20, 20)) < share, 2.0, 0.0)
    if share == 0.3:  # a long thin spiral is one blob
        a[:] = 0
        a[0, :], a[:, -1], a[-1, :], a[2:, 0], a[2, :-2], a[2:-2, -3] = 2, 2, 2, 2, 2, 2
    want, found = a.copy(), blobs(a > 1)
    for b in found:
        if len(b) <= 4:
            for p in b:
                want[p] = -7.0
    row = im.despeckle(frame(spark, [a]), F.lit(1.0), F.lit(-7.0), 4)
    assert back(row)[0] == pytest.approx(want)
    r = row.first()
    assert (r["n_blobs"], r["n_blobs_removed"]) == (len(found), sum(len(b) <= 4 for b in found))


def test_blend_averages_sky_and_keeps_sources(spark):
    a = RNG.normal(size=(40, 40))
    a[15:25, 15:25] += 50
    got = back(im.blend_sky(frame(spark, [a]), F.lit(1.0), 1.5, 1.5, 0.3))[0]
    k = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    smooth, inside = a, np.ones_like(a)
    for axis in (0, 1):
        smooth = np.apply_along_axis(np.convolve, axis, smooth, k, "same")
        inside = np.apply_along_axis(np.convolve, axis, inside, k, "same")
    smooth = smooth / inside
    lam = 1 / (1 + np.exp(-np.clip((smooth - 1.5) / 0.3, -500, 500)))
    assert got == pytest.approx(lam * a + (1 - lam) * smooth, abs=1e-9)


def test_map_and_its_inverse_at_every_flux(spark):
    flux = np.concatenate([-np.logspace(5, -3, 40), [0.0], np.logspace(-3, 6, 40)])
    flux = np.append(flux, np.zeros(81 - len(flux)))
    df = frame(spark, [flux.reshape(9, 9)])
    for floor in (0.0, 3.0):
        x = A.to_x(F.col("image"), 2.0, floor)
        got = np.array(df.select(x.alias("v")).first()["v"])
        assert np.isfinite(got).all()
        u = (flux - floor) / 2.0
        near = (u > -20) | (floor > 0)
        direct = np.log(np.where(near, floor + 2.0 * np.logaddexp(0, u), 1))
        assert got[near] == pytest.approx(direct[near], rel=1e-12)
        assert floor > 0 or got[~near] == pytest.approx((u + np.log(2.0))[~near])
        again = np.array(df.select(A.to_flux_exact(x, 2.0, floor).alias("v")).first()["v"])
        safe = u > (-15 if floor else -1e9)
        assert again[safe] == pytest.approx(flux[safe], rel=1e-6, abs=1e-6)


def test_chain_without_noise_is_the_bare_map(spark):
    a = RNG.normal(size=(4, 4))
    df = frame(spark, [a]).drop("sky_noise")
    cfg = TransformSettings(softening=1.0)
    got = back(im.to_log_space(df, cfg, PatchSettings(native_size=8, out_size=4)))[0]
    assert got == pytest.approx(np.log(np.logaddexp(0, a)))
    with pytest.raises(ValueError, match="pooled_noise_ratio"):
        im.to_log_space(frame(spark, [a]), cfg, PatchSettings(native_size=8, out_size=4))


def test_one_noise_field_for_the_whole_ladder(spark):
    a = RNG.normal(size=(16, 16))
    rows = im.forward_expand(frame(spark, [a]), F.lit(0.5), F.lit(8.0), 5, "k", seed=2).orderBy("rung").collect()
    assert [r["sigma"] for r in rows] == pytest.approx([8, 4, 2, 1, 0.5])
    eps = [(np.array(r["image"]) - a.ravel()) / r["sigma"] for r in rows]
    assert eps[0] == pytest.approx(eps[4]) and abs(eps[0].mean()) < 0.2 and eps[0].std() == pytest.approx(1, abs=0.15)


def test_the_log_chain_goes_to_python_once(spark):
    cfg, patch = TransformSettings(softening=50.0, pooled_noise_ratio=1.1, despeckle_max_pixels=2), PatchSettings(native_size=8, out_size=4)
    df = frame(spark, [np.arange(16.0).reshape(4, 4)]).withColumn("sky_noise", F.lit(10.0))
    plan = im.to_log_space(df, cfg, patch)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
