import numpy as np
import pytest
from pyspark.sql import functions as F

from stampmill.cuts import PatchCuts
from stampmill.operators import gate as g, manifest as m

N = 64
PLANES = {"SATURATED": 0, "COSMIC_RAY": 1, "INTERPOLATED": 2, "DETECTION_EDGE": 3}
SCHEMA = "host_id long, image array<float>, variance array<float>, mask array<long>, planes map<string,int>, n_visits_min int, cell_depth_ratio double"


def scene(peak=200.0, noise=1.0, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:N, 0:N] - N // 2
    image = rng.normal(0, noise, (N, N)) + peak * np.exp(-(x**2 + y**2) / 50)
    return image, np.full((N, N), noise**2), np.zeros((N, N), dtype=np.int64)


def run(spark, image, variance, mask, cuts=None, visits=10, ratio=1.0, planes=None):
    row = (1, image.ravel().tolist(), variance.ravel().tolist(), mask.ravel().tolist(), planes or PLANES, visits, ratio)
    return g.gate(spark.createDataFrame([row], SCHEMA), cuts).first()


def test_clean_stamp_passes(spark):
    out = run(spark, *scene())
    assert out["reasons"] == [] and out["diag_n_peaks"] == 1 and out["diag_sky_noise"] == pytest.approx(1.0)


def test_all_reasons_in_gate_order(spark):
    image, variance, mask = scene(peak=0.0)
    image[0, 0] = np.nan
    variance[N // 2, N // 2] = np.inf
    variance[:, : N // 2] *= 9
    mask[N // 2 - 5 : N // 2 + 5, N // 2 - 5 : N // 2 + 5] = 0b111
    mask[0, 0] |= 8
    out = run(spark, image, variance, mask, PatchCuts(min_visits=3, max_peaks=-1, max_variance_step=4.0), visits=2, ratio=float("inf"))
    names = [r.split(":")[0] for r in out["reasons"]]
    assert names == ["nonfinite_image", "no_data", "inner_no_data", "too_shallow", "cell_depth", "empty_centre", "crowded", "zero_tol",
                     "COSMIC_RAY", "INTERPOLATED", "SATURATED", "inner_COSMIC_RAY", "inner_INTERPOLATED", "inner_SATURATED"][: len(names)] or "crowded" not in names
    assert "cell_depth:inf>3.5" in out["reasons"] and "too_shallow:2<3" in out["reasons"]
    assert "no_data:0.0002>0.0" in out["reasons"] and "zero_tol:DETECTION_EDGE" in out["reasons"]


def test_variance_step_is_the_depth_ratio(spark):
    image, variance, mask = scene(peak=0.0)
    variance[:, N // 2 :] *= 6
    out = run(spark, image, variance, mask, PatchCuts(min_centre_sigma=None))
    assert out["diag_variance_step"] == pytest.approx(6.0)
    assert out["reasons"] == ["variance_step:6.00>4.0"]


def test_a_limit_that_is_off(spark):
    image, variance, mask = scene()
    cuts = PatchCuts(max_cell_depth_ratio=None)
    assert run(spark, image, variance, mask, cuts, ratio=float("inf"))["reasons"] == []


def test_no_noise_gives_no_centre_and_no_peaks(spark):
    image, variance, mask = scene()
    out = run(spark, image, np.zeros_like(variance), mask)
    assert np.isnan(out["diag_centre_sigma"]) and out["diag_n_peaks"] == -1
    assert [r.split(":")[0] for r in out["reasons"]] == ["no_data", "inner_no_data"]


def peaks_by_hand(a, noise):
    box = sum(np.roll(np.roll(a, i, 0), j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1)) / 9
    n = 0
    for y in range(6, len(a) - 6):
        for x in range(6, len(a) - 6):
            n += box[y, x] > 5 * noise / 3 and box[y, x] >= box[y - 3 : y + 4, x - 3 : x + 4].max() - 1e-12
    return n


@pytest.mark.parametrize("stars", [0, 6, 40])
def test_peaks_against_a_plain_loop(spark, stars):
    image, variance, mask = scene(seed=stars)
    rng = np.random.default_rng(stars)
    y, x = np.mgrid[0:N, 0:N]
    for sy, sx in rng.uniform(8, N - 8, (stars, 2)):
        image += 80 * np.exp(-((x - sx) ** 2 + (y - sy) ** 2) / 3)
    assert run(spark, image, variance, mask)["diag_n_peaks"] == peaks_by_hand(image.astype(np.float32).astype(float), 1.0)


def test_ties_are_rounded_to_even(spark):
    df = spark.createDataFrame([(0.03125,), (0.09375,), (float("inf"),), (2.0,)], "v double")
    assert [r[0] for r in df.select(g.fixed(F.col("v"), 4)).collect()] == ["0.0312", "0.0938", "inf", "2.0000"]


def test_a_small_negative_keeps_its_sign(spark):
    image, variance, mask = scene(peak=0.0)
    image[:] = -0.002745
    assert run(spark, image, variance, mask, PatchCuts(min_centre_sigma=2.0))["reasons"] == ["empty_centre:-0.00<2.0"]


@pytest.mark.parametrize("digits", [2, 4])
def test_fixed_text_is_that_of_printf(spark, digits):
    rng = np.random.default_rng(1)
    seeming = [(2 * k + 1) / 10 ** (digits + 1) * 5 for k in range(3000)]  # 3.675 is a little under its own text
    values = [-0.0, 0.0, -1e-9, -0.002745, 147 / 40, 3.625, 0.125, 5e-5, 99.995, 1e15 + 0.5, *seeming, *rng.normal(0, 50, 2000), *rng.integers(1, 400, 2000) / 40]
    df = spark.createDataFrame([(i, float(s * v)) for i, v in enumerate(values) for s in (1, -1)], "i long, v double")
    wrong = [(r["v"], r["t"]) for r in df.withColumn("t", g.fixed(F.col("v"), digits)).collect() if r["t"] != f"{r['v']:.{digits}f}"]
    assert wrong == []


def test_stale_plane_names_fail(spark):
    with pytest.raises(Exception, match="none of the gated planes"):
        run(spark, *scene(), planes={"SAT": 0})
    with pytest.raises(ValueError, match="real sources"):
        run(spark, *scene(), PatchCuts(max_plane_fraction={"DETECTED": 0.1}))


def test_an_absent_plane_counts_zero(spark):
    out = run(spark, *scene(), planes={"SATURATED": 0})
    assert out["diag_frac_COSMIC_RAY"] == 0.0 and out["reasons"] == []


def test_packing_keeps_63_planes_and_refuses_more(spark):
    names = [f"p{i}" for i in range(64)]
    df = spark.createDataFrame([tuple([[i % 2 == 0, True] for i in range(64)])], ", ".join(f"{n} array<boolean>" for n in names))
    out = g.pack_mask(df, names[:63]).first()
    assert len(out["planes"]) == 63 and out["mask"] == [sum(1 << i for i in range(0, 63, 2)), (1 << 63) - 1]
    with pytest.raises(ValueError, match="64 planes"):
        g.pack_mask(df, names)


def test_a_high_plane_rejects(spark):
    image, variance, mask = scene()
    out = run(spark, image, variance, mask.astype(np.int64) | (1 << 40), planes={**PLANES, "SATURATED": 40})
    assert out["diag_frac_SATURATED"] == 1.0 and any(r.startswith("SATURATED") for r in out["reasons"])


def test_a_bit_no_mask_can_hold_fails(spark):
    with pytest.raises(Exception, match="bits 0 to 62"):
        run(spark, *scene(), planes={**PLANES, "SATURATED": 63})
    image, variance, mask = scene()
    with pytest.raises(Exception, match="sets bit 63"):
        run(spark, image, variance, np.full_like(mask, -(1 << 63), dtype=np.int64))


def test_two_plane_maps_are_not_mixed(spark):
    from stampmill.operators.stamps import planes_from_mask

    df = spark.createDataFrame([([1], {"a": 0}), ([1], {"b": 0})], "mask array<long>, planes map<string,int>")
    with pytest.raises(ValueError, match="different plane maps"):
        planes_from_mask(df)


def test_reasons_count_once_a_row(spark):
    rows = [("rejected", "cell_depth:2>1.5;inner_INTERPOLATED:0.3>0;inner_INTERPOLATED:x"), ("rejected", "inner_INTERPOLATED:0.4>0"),
            ("accepted", "x"), ("rejected", None), ("rejected", "nan")]
    out = m.rejection_counts(spark.createDataFrame(rows, "status string, reasons string"))
    assert [tuple(r) for r in out.collect()] == [("inner_INTERPOLATED", 2), ("cell_depth", 1), ("unknown", 1)]


def test_manifest_cut(spark):
    stamps = spark.createDataFrame([(1, 0), (2, 1)], "host_id long, band_idx int")
    rows = [(1, "u", "accepted", 0.5, 0), (1, "u", "accepted", 0.0, 1), (2, "g", "accepted", 0.2, 2), (2, "g", "rejected", 0.0, 3)]
    manifest = spark.createDataFrame(rows, "host_id long, band string, status string, diag_a double, manifest_index long")
    assert [r["host_id"] for r in m.manifest_cut(stamps, manifest, {"diag_a": 0.1}).collect()] == [1]
    with pytest.raises(ValueError):
        m.manifest_cut(stamps, manifest, {"diag_b": 0.1})
    with pytest.raises(Exception, match="another run"):
        m.manifest_cut(stamps, manifest.where("host_id = 1"), {"diag_a": 0.1}).collect()
    assert m.manifest_cut(stamps, manifest, {"diag_a": None}).count() == 2


def test_usable_stamps(spark):
    from stampmill.cuts import PatchSettings

    stamps = spark.createDataFrame([(1, 0, 0.0), (2, 0, 0.5), (3, 0, 0.0), (4, 0, 0.0)], "host_id long, band_idx int, frac_no_data double")
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.2, 0.0), (4, 0.0, 0.2)]
    manifest = spark.createDataFrame([(h, "u", "accepted", a, b, h) for h, a, b in rows],
                                     "host_id long, band string, status string, diag_frac_SATURATED double, diag_frac_INTERPOLATED double, manifest_index long")
    kept = lambda patch, m=manifest: sorted(r["host_id"] for r in m_usable(stamps, patch, m).collect())
    m_usable = m.usable
    assert kept(PatchSettings()) == [1]
    assert kept(PatchSettings(max_frac_saturated=None)) == [1, 3]
    assert kept(PatchSettings(max_frac_saturated=None, max_frac_interpolated=None), None) == [1, 3, 4]
    assert kept(PatchSettings(max_no_data=-1)) == [1, 2]
    with pytest.raises(ValueError, match="needs the manifest"):
        kept(PatchSettings(), None)
    with pytest.raises(Exception, match="another run"):
        kept(PatchSettings(), manifest.where("host_id <> 3"))


def test_unknown_no_data_is_an_error(spark):
    df = spark.createDataFrame([(1, -1.0)], "host_id long, frac_no_data double")
    with pytest.raises(Exception, match="no frac_no_data"):
        m.no_data_cut(df, 0.0).collect()


def test_the_maximum_is_in_the_last_bin(spark):
    v = np.random.default_rng(0).normal(size=500)
    df = spark.createDataFrame([(float(x), "a" if i % 3 else "b") for i, x in enumerate(v)], "v double, g string")
    got = {(r["g"], r["bin"]): r["n"] for r in m.histogram(df, "v", 40, group="g").collect()}
    for name, part in (("a", [x for i, x in enumerate(v) if i % 3]), ("b", [x for i, x in enumerate(v) if not i % 3])):
        counts = np.histogram(part, bins=np.linspace(v.min(), v.max(), 41))[0]
        assert [got.get((name, i), 0) for i in range(40)] == counts.tolist()


def test_unknown_bands_fail(spark):
    with pytest.raises(Exception, match="unknown band"):
        m.band_index(spark.createDataFrame([("q",)], "band string")).collect()
    with pytest.raises(Exception, match="unknown band"):
        m.band_name(spark.createDataFrame([(6,)], "band_idx int")).collect()
