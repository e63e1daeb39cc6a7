import numpy as np
import pytest
from pyspark.sql import functions as F

from stampmill.cuts import TransformSettings
from stampmill.functions.mix import mix, seed_of
from stampmill.operators import measure as me, pairs as pr, runlog as rl, spectra as sp


def frame(spark, images, **extra):
    names = list(extra)
    rows = [(i, np.asarray(a, float).ravel().tolist(), *[extra[n][i] for n in names]) for i, a in enumerate(images)]
    return spark.createDataFrame(rows, "k long, image array<double>" + "".join(f", {n} double" for n in names))


def smooth_field(n, size, width, seed=0):
    rng = np.random.default_rng(seed)
    f = np.fft.rfftfreq(size)
    k2 = np.fft.fftfreq(size)[:, None] ** 2 + f[None, :] ** 2
    fields = [np.fft.irfft2(np.fft.rfft2(rng.normal(size=(size, size))) * np.exp(-2 * np.pi**2 * width**2 * k2), s=(size, size)) for _ in range(n)]
    return np.array(fields)


@pytest.mark.parametrize("width", [2.0, 3.0])
def test_correlation_length_of_a_smoothed_field(spark, width):
    fields = smooth_field(150, 64, width)
    df = frame(spark, fields).repartition(5)
    clean = sp.correlation_length(sp.autocorrelation(sp.power_state(df, 64))).first()
    assert clean["xi"] == pytest.approx(2 * width, rel=0.12)
    noisy = frame(spark, fields + np.random.default_rng(9).normal(0, 2 * fields.std(), fields.shape))
    profile = sp.autocorrelation(sp.power_state(noisy, 64))
    assert sp.correlation_length(profile).first()["xi"] == pytest.approx(clean["xi"], rel=0.05)
    assert sp.correlation_length(profile, exclude_noise=False).first()["xi"] < 0.5 * clean["xi"]


def test_partial_states_merge_to_the_whole(spark):
    df = frame(spark, smooth_field(20, 16, 1.5))
    whole = sp.autocorrelation(sp.power_state(df, 16)).orderBy("lag").collect()
    parts = sp.merge_states(*[sp.power_state(df.where(F.col("k") % 3 == i), 16) for i in range(3)])
    merged = sp.autocorrelation(parts).orderBy("lag").collect()
    assert [r["value"] for r in whole] == pytest.approx([r["value"] for r in merged])
    with pytest.raises(Exception, match="expected 8 px"):
        sp.power_state(df, 8).collect()
    bad = frame(spark, [np.full((16, 16), np.nan), *smooth_field(2, 16, 1.5)])
    assert sp.power_state(bad, 16).first()["n_patches"] == 2


def test_a_starved_band_reads_its_attenuation(spark):
    rng = np.random.default_rng(3)
    size, cut = 64, 8
    f = np.fft.fftfreq(size) * size
    k = np.hypot(f[:, None], f[None, :])
    full = rng.normal(size=(24, size, size))
    starved = np.fft.ifft2(np.fft.fft2(full) * np.where(k < size / cut, 0.4, 1.0)).real
    out = {r["band"]: r for r in sp.band_ratio(frame(spark, starved), frame(spark, full), (1, 2, 4, 8, 16)).collect()}
    assert [round(out[b]["ratio"], 6) for b in ("1", "2", "4", "8", "16", ">32")] == [1, 1, 1, 0.4, 0.4, 0.4]
    power = {r["band"]: r for r in sp.band_power(frame(spark, full), (1, 2, 4, 8, 16)).collect()}
    centred = full - full.mean((1, 2), keepdims=True)
    corner = np.abs(np.fft.fft2(centred)) ** 2
    rest = corner[:, k >= size].sum() / len(full) / size**4
    assert power["all"]["rms"] ** 2 + rest == pytest.approx((centred**2).mean((1, 2)).mean())


def test_gaussian_floor(spark):
    x = smooth_field(12, 15, 1.0)
    v = x - x.mean((1, 2), keepdims=True)
    p = (np.abs(np.fft.fft2(v)) ** 2).mean(0) / 15**2
    got = {r["sigma"]: r["floor"] for r in sp.gaussian_floor(frame(spark, x), 15, F.array(F.lit(0.1), F.lit(1.0))).collect()}
    for s in got:
        assert got[s] == pytest.approx((p / (p + s * s)).mean())


def test_headroom_drops_empty_bands(spark):
    rows = sp.schedule_headroom(frame(spark, smooth_field(4, 16, 1.0)), 5.0).collect()
    assert "32" not in {r["band"] for r in rows}
    seen = [r["sigma_visible"] for r in rows]
    assert seen == sorted(seen, reverse=True)


def test_pooled_noise_ignores_sources(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(0, 3, (40, 32, 32))
    a[:, :10, :10] += 500
    got = me.pooled_sky_noise(frame(spark, a)).first()["pooled_noise"]
    per = (np.percentile(a.reshape(40, -1), 25, axis=1) - np.percentile(a.reshape(40, -1), 5, axis=1)) / 0.9703648
    assert got == pytest.approx(np.median(per)) and got == pytest.approx(3, rel=0.2)
    with pytest.raises(ValueError, match="measurable"):
        me.pooled_sky_noise(frame(spark, np.ones((3, 4, 4))))


def test_softening_that_disagrees_is_refused(spark):
    noise = spark.createDataFrame([(10.0,)], "pooled_noise double")
    assert me.check_softening(11.0, noise, 1.0).first()["implied_sigma"] == pytest.approx(1.1)
    with pytest.raises(Exception, match="disagrees"):
        me.check_softening(20.0, noise, 1.0).collect()


def test_sigma_range_needs_its_measurement(spark):
    stats = spark.createDataFrame([(0.5, 0.2, 3.0)], "std double, sky_scatter double, per_patch_range_p99 double")
    with pytest.raises(ValueError):
        me.sigma_range(stats)
    row = me.sigma_range(stats, "per-pixel").first()
    assert (row["sigma_min"], row["sigma_max"]) == (pytest.approx(0.01), 3.0)


def test_steps_grow_with_dimension(spark):
    df = spark.createDataFrame([(64, 0.01, 50.0), (16384, 0.01, 50.0)], "dim int, sigma_min double, sigma_max double")
    small, large = me.n_steps(df).orderBy("dim").collect()
    assert 1 < large["gamma"] < small["gamma"] and large["n_steps"] > small["n_steps"] > 10


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(pr, "BLOCK_ROWS", 7)


def test_distances_over_many_blocks(spark, small_blocks):
    x = np.random.default_rng(2).normal(5, 1, (31, 6, 6))
    flat = x.reshape(31, -1)
    d = np.sqrt(((flat[:, None] - flat[None]) ** 2).sum(-1))
    u = d[np.triu_indices(31, 1)]
    row = pr.pair_distances(frame(spark, x), "k", None).first()
    assert row["n_pairs"] == u.size
    for name, want in (("mean", u.mean()), ("std", u.std()), ("min", u.min()), ("max", u.max()), ("p50", np.percentile(u, 50)), ("p99", np.percentile(u, 99))):
        assert row[name] == pytest.approx(want, rel=1e-9)
    for r in pr.pair_table(frame(spark, x), "k").collect():
        others = np.delete(d[r["k"]], r["k"])
        assert (r["n_pairs"], r["mean"], r["min"], r["max"]) == (30, pytest.approx(others.mean()), pytest.approx(others.min()), pytest.approx(others.max()))


def energy(d, a, b):
    return 2 * d[np.ix_(a, b)].mean() - d[np.ix_(a, a)].mean() - d[np.ix_(b, b)].mean()


def test_energy_distance_and_its_direction(spark, small_blocks):
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, (25, 3, 3)), rng.normal(0.8, 1, (18, 3, 3))
    flat = np.concatenate([x, y]).reshape(43, -1)
    d = np.sqrt(((flat[:, None] - flat[None]) ** 2).sum(-1))
    fx, fy = frame(spark, x), frame(spark, y).withColumn("k", F.col("k") + 100)
    assert pr.energy_distance(fx, fy, "k").first()["statistic"] == pytest.approx(energy(d, np.arange(25), np.arange(25, 43)))
    far = pr.permutation_test(fx, fy, "k", permutations=99, seed=1).first()
    assert far["p_value"] == pytest.approx(0.01) and far["z"] > 3 and far["permutations"] == 99
    marked = pr.permutation_test(fx, fy, "k", permutations=99, seed=1, landmarks=20).first()
    assert marked["p_value"] < 0.1
    everything = pr.permutation_test(fx, fy, "k", permutations=99, seed=1, landmarks=1000).first()
    assert everything["statistic"] == pytest.approx(far["statistic"]) and everything["p_value"] == far["p_value"]


def test_control_is_calibrated(spark):
    x = np.random.default_rng(6).normal(size=(41, 3, 3))
    runs = pr.control(frame(spark, x), "k", repeats=8, permutations=49, seed=2)
    p = [r["p_value"] for r in runs.collect()]
    assert len(p) == 8 and max(p) > 0.2 and all(r["n_x"] == r["n_y"] == 20 for r in runs.collect())


@pytest.mark.parametrize("p, rejected, want", [(0.001, 0, "rejected"), (0.5, 1, "not rejected"), (0.001, 2, "withheld")])
def test_verdict(spark, p, rejected, want):
    result = spark.createDataFrame([(p,)], "p_value double")
    summary = spark.createDataFrame([(5, rejected)], "repeats int, n_rejected int")
    row = pr.verdict(result, summary).first()
    assert row["verdict"] == want and bool(row["control_note"]) == (rejected == 1)


def shuffled_energies(x, y, permutations, seed):
    """The test by hand: the same counters, all labels of a permutation at once."""
    both = np.concatenate([x, y]).reshape(len(x) + len(y), -1)
    d = np.sqrt(((both[:, None] - both[None]) ** 2).sum(-1))
    base = mix(mix(np.uint64(seed_of(f"{seed}p"))) ^ np.arange(permutations + 1, dtype=np.uint64))
    out = [energy(d, np.arange(len(x)), np.arange(len(x), len(both)))]
    for p in range(1, permutations + 1):
        order = np.argsort(mix(base[p] ^ mix(np.arange(len(both)))))
        out.append(energy(d, order[: len(x)], order[len(x) :]))
    return np.array(out)


def test_every_verdict_is_reached(spark, small_blocks):
    rng = np.random.default_rng(9)
    same = rng.normal(size=(60, 3, 3))
    near, far = same[:30], same[30:] + 2.0
    x = frame(spark, near)
    test = lambda y: pr.permutation_test(x, frame(spark, y).withColumn("k", F.col("k") + 100), "k", permutations=999, seed=3)
    null = shuffled_energies(near, far, 999, 3)
    got = test(far)
    row = got.first()
    assert row["p_value"] == pytest.approx((1 + (null[1:] >= null[0] - 1e-12).sum()) / 1000) and row["null_std"] == pytest.approx(null[1:].std(), rel=1e-6)
    controls = pr.control(frame(spark, same), "k", permutations=999, seed=3)
    p = sorted(r["p_value"] for r in controls.collect())
    assert len(p) == 5
    said = lambda result, alpha: tuple(pr.verdict(result, pr.control_summary(controls, alpha), alpha).select("verdict", "control_note").first())
    assert p[0] > 0.01 and said(got, 0.01) == ("rejected", "")
    assert said(test(same[30:]), 0.01) == ("not rejected", "")
    # Levels between the controls' own p-values: one of them rejects, then two.
    assert said(got, (p[0] + p[1]) / 2) == ("rejected", "one control rejected")
    assert said(got, (p[1] + p[2]) / 2) == ("withheld", "")


def test_permutations_are_not_shuffled(spark):
    x = frame(spark, np.random.default_rng(1).normal(size=(20, 2, 2)))
    blocks, _, _ = pr.blocks_of(x.withColumn("labels", F.array(F.lit(1))).withColumn("landmark", F.lit(1)), "k", ("labels", "landmark"))
    sums = pr._label_sums(blocks, pr._shuffles(blocks, 1, 999, 1))
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "md5" not in plan


@pytest.mark.parametrize("alpha, segment", [(0.02, 4096), (0.02, 7), (0.9, 4), (1e-6, 16), (1e-4, 5)])
def test_running_mean_by_scan(spark, alpha, segment):
    rng = np.random.default_rng(2)
    sizes = {1: 3000, 2: 1, 3: 64, 4: 65}
    data = [(k, i, float(v)) for k, n in sizes.items() for i, v in enumerate(rng.normal(5, 1, n))]
    out = rl.ewma(spark.createDataFrame(data, "k int, i int, v double"), "k", "i", "v", alpha=alpha, segment_rows=segment)
    got = {(r["k"], r["i"]): r["loss_ema"] for r in out.collect()}
    mean = None
    for k, i, v in data:
        mean = v if i == 0 else (1 - alpha) * mean + alpha * v
        assert got[k, i] == pytest.approx(mean, rel=1e-9)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_input_offset_without_a_softening(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (2.0, 1.0, 0.0)], "s double, k double, f double")
    got = [r[0] for r in df.select(me.input_offset(F.col("s"), F.col("k"), F.col("f"))).collect()]
    assert got == [0.0, pytest.approx(np.log(2 * np.log(2)))]


def test_scatter_verdict(spark):
    stats = spark.createDataFrame([(0.1,), (2.0,)], "sky_scatter double")
    both = [r["verdict"] for r in me.scatter_check(stats, TransformSettings()).collect()]
    raw = [r["verdict"] for r in me.scatter_check(stats, TransformSettings(sky_smooth_pixels=0, floor_sigma=0)).collect()]
    assert both == ["plausible", "far from the prediction"] and raw == ["far from the prediction"] * 2
