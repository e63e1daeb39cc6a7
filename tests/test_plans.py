import pytest
from pyspark.sql import functions as F

from stampmill.cuts import PatchSettings, TransformSettings
from stampmill.operators import batches as bt, gate as g, images as im, manifest as m, pairs as pr, spectra as sp
from stampmill.plans import extraction as ex
from stampmill.plans.preparation import prepare
from stampmill.queries import gate as qg, walk as qw
from stampmill.queries.flux import CFG, PATCH
from stampmill.queries.views import coadds, contributions, objects, stamps8
from stampmill.sources import pixels as px

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    hosts = objects(spark, SF).where("objectId < 400")
    return hosts, coadds(spark, SF), contributions(spark, SF), qw.pixels(spark, SF, hosts)


def manifest(run):
    return sorted((r["host_id"], r["band"], r["status"], r["reasons"], r["patch_index"]) for r in run.manifest.collect())


def test_many_small_chunks_give_the_one_answer(spark, inputs, monkeypatch):
    args = dict(size=qw.SIZE, cuts=qw.PATCH_CUTS, bands=qw.USED_BANDS, seed=3)
    whole = ex.extract(*inputs, **args)
    n = whole.manifest.where("status = 'accepted'").count() // 2
    assert n > 5 and not whole.short
    monkeypatch.setattr(ex, "FIRST_ACCEPTANCE", 1000.0)
    some = ex.extract(*inputs, **args, n_stamps=n)
    walked = some.hosts.select("objectId").collect()
    ids = {r["objectId"] for r in walked}
    assert manifest(some) == [row for row in manifest(whole) if row[0] in ids]
    assert n <= sum(row[2] == "accepted" for row in manifest(some)) < n + len(qw.USED_BANDS)
    assert some.stamps.count() == sum(row[2] == "accepted" for row in manifest(some))


def test_falling_short_is_reported(spark, inputs):
    run = ex.extract(*inputs, size=qw.SIZE, cuts=qw.PATCH_CUTS, bands=("g",), n_stamps=10**6)
    assert run.short and run.hosts.count() == 400
    assert '"band":"g"' in run.manifest.where("data_id is not null").first()["data_id"]
    counts = m.run_counts(400, run.manifest, 10**6, rows_per_file=10)
    row = counts.first()
    assert row["files"] == -(-row["stamps_accepted"] // 10) and row["stamps_attempted"] == row["stamps_accepted"] + row["stamps_rejected"]
    assert "of the 1000000 stamps" in m.shortfall(counts).first()["warning"]
    assert m.shortfall(m.run_counts(400, run.manifest, 1)).isEmpty()


def test_an_empty_catalogue_fails(spark, inputs):
    hosts, *rest = inputs
    with pytest.raises(RuntimeError, match="empty"):
        ex.extract(hosts.limit(0), *rest, size=qw.SIZE)


@pytest.mark.parametrize("fault", ["no_coadd", "off_the_grid:cells"])
def test_a_first_patch_that_is_not_covered_is_walked_past(spark, inputs, monkeypatch, fault):
    """Many hosts share a patch, so the first 20 may all lie in one without coadds, or outside its cells."""
    monkeypatch.setattr(ex, "FIRST_ACCEPTANCE", 1000.0)
    hosts, found, contributed, pixels = inputs
    walk = qw.w.walk_order(hosts, 3)
    last = walk.orderBy(*qw.w.WALK).limit(40).agg(F.max("patch_rank")).first()[0]
    early = walk.where(F.col("patch_rank") <= last)
    gone = early.select("tract", "patch").distinct()
    if fault == "no_coadd":
        found = found.join(gone, ["tract", "patch"], "left_anti")
    else:
        contributed = contributed.join(gone.withColumn("_gone", F.lit(100)), ["tract", "patch"], "left").withColumn("cell_i", F.col("cell_i") + F.coalesce("_gone", F.lit(0))).drop("_gone")
    args = dict(size=qw.SIZE, cuts=qw.PATCH_CUTS, bands=qw.USED_BANDS, seed=3, n_stamps=5)
    run = ex.extract(hosts, found, contributed, pixels, **args)
    ids = {r["objectId"] for r in early.select("objectId").collect()}
    seen = {row[3] for row in manifest(run) if row[0] in ids}
    assert fault in seen <= {"no_coadd", "off_the_grid:cells"} and len(ids) > 20 and not run.short
    assert ids < {r["objectId"] for r in run.hosts.select("objectId").collect()}
    early_read = qw.w.check_walk(walk, ex.readable(walk, found, qw.w.cell_visit_counts(contributed), pixels, qw.USED_BANDS, qw.SIZE))
    assert early_read.isEmpty()
    with pytest.raises(RuntimeError, match="numberings"):
        ex.extract(hosts, found, contributed, pixels.limit(0), **args)
    with pytest.raises(RuntimeError, match="numberings"):
        ex.extract(hosts, found.limit(0), contributed, pixels, **args)
    with pytest.raises(RuntimeError, match="transposed"):
        ex.extract(hosts, inputs[1], inputs[2].withColumn("cell_i", F.lit(100)), pixels, **args)


def test_settings_are_measured_or_kept(spark):
    stamps = stamps8(spark, SF)
    row = prepare(stamps, TransformSettings(), PATCH, "stamp_id", n=200).first()
    assert row["sigma_max"] == pytest.approx(row["pair_max"], abs=1e-3) and row["sigma_min"] >= 1e-3 and row["n_steps"] >= 1
    kept = prepare(stamps, TransformSettings(softening=row["softening"] * 1.1, pooled_noise_ratio=2.0), PATCH, "stamp_id", n=200, sigma_max=77.0).first()
    assert kept["sigma_max"] == 77.0 and kept["softening"] == pytest.approx(1.1 * row["softening"]) and kept["pooled_noise_ratio"] == 2.0
    with pytest.raises(Exception, match="disagrees"):
        prepare(stamps, TransformSettings(softening=row["softening"] * 3), PATCH, "stamp_id", n=200)


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("job", [
    lambda df: im.make_batch(df, CFG, PATCH, "stamp_id", seed=1, augment=True).select("stamp_id", F.explode("image")),
    lambda df: sp.band_power(df, (1, 2, 4)),
    lambda df: sp.autocorrelation(sp.power_state(df, 8)),
    lambda df: pr.pair_distances(df, "stamp_id", 100),
])
def test_partitioning_does_not_matter(spark, job):
    stamps = stamps8(spark, SF).where("stamp_id < 200")
    assert rows(job(stamps.repartition(1))) == rows(job(stamps.repartition(7)))


def test_gate_partitioning_does_not_matter(spark):
    stamps = qg.with_depth(qg.stamps32(spark, SF))
    one, seven = (g.gate(stamps.repartition(n), qg.CUTS).select("host_id", F.concat_ws(";", "reasons"), "diag_variance_step") for n in (1, 7))
    assert rows(one) == rows(seven)


def test_pixels_are_read_by_patch(spark, inputs, tmp_path):
    """A range opens its own patches' folders, images stay where they are read, and what is missing shows in the same join."""
    hosts, found, contributed, pixels = inputs
    stored = pixels.select("host_id", "band_idx", "native_size", "image", "variance", "mask", "planes", "tract", "patch")
    px.write_pixels(px.by_patch(stored), str(tmp_path / "pixels"))
    table = px.read_pixels(spark, str(tmp_path / "pixels"), stored)
    one = hosts.where("tract = 5063 AND patch = 3")
    wanted = qw.w.host_coadds(one, found, qw.USED_BANDS).select("tract", "patch", F.col("objectId").alias("host_id"), "band_idx")
    read = px.from_patches(table, wanted)
    n = read.count()
    assert n == pixels.join(wanted, ["tract", "patch", "host_id", "band_idx"], "left_semi").count() > 0
    filters = lambda df: df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters", 1)[1]
    assert "patch" in filters(read)[:80]  # told by the keys' own filter, or found as the keys are sent
    few = px.from_patches(table, qw.w.host_coadds(hosts.where("objectId < 40"), found, qw.USED_BANDS).select("tract", "patch", F.col("objectId").alias("host_id"), "band_idx"))
    assert "dynamicpruning" in filters(few).split("ReadSchema")[0] and few.count() > 0
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert not any("image" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line)
    assert {tuple(r) for r in read.select("tract", "patch").distinct().collect()} == {(5063, 3)}
    assert (tmp_path / "pixels" / "tract=5063" / "patch=3").is_dir()
    args = dict(size=qw.SIZE, cuts=qw.PATCH_CUTS, bands=qw.USED_BANDS, seed=3)
    gone = table.where("host_id % 3 <> 0")
    run = ex.extract(hosts, found, contributed, gone, **args)
    lost = {(r["host_id"], r["band"]) for r in run.manifest.where("reasons = 'off_the_grid:read'").collect()}
    attempted = {(r["host_id"], r["band"]): r["reasons"] for r in run.manifest.where("was_read OR reasons = 'off_the_grid:read'").collect()}
    assert {k for k in attempted if k[0] % 3 == 0} <= lost and lost
    plain = ex.extract(hosts, found, contributed, pixels.drop("tract", "patch"), **args)
    assert manifest(plain) == manifest(ex.extract(hosts, found, contributed, table, **args))


def test_a_stamp_goes_to_python_once(spark):
    """Filling, pooling, blending, the log map, despeckling and turning are one kernel, and mixed sizes are one join."""
    cfg = TransformSettings(softening=30.0, pooled_noise_ratio=1.1, fill_no_data=True, despeckle_max_pixels=2)
    stamps = stamps8(spark, SF).where("stamp_id < 40")
    made = im.make_batch(stamps, cfg, PATCH, "stamp_id", seed=1, augment=True)
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]
    assert plan.count("ArrowEvalPython") == 1 and {"n_filled", "n_blobs_removed"} <= set(made.columns)
    # The same steps one by one.
    steps = im.to_log_space(im.to_grid(im.fill_no_data(stamps), PATCH, "stamp_id", 1, True), cfg, PATCH)
    steps = im.random_dihedral(steps, "stamp_id", 1) if PATCH.dihedral else steps
    assert rows(made.select("stamp_id", "n_blobs", F.posexplode("image"))) == rows(steps.select("stamp_id", "n_blobs", F.posexplode("image")))
    sizes = PatchSettings(native_size=8, out_size=4, out_sizes=(4, 2), pool_factor=2)
    planned = bt.batch_plan(stamps, 8, 3, 2, sizes.training_sizes, "stamp_id")
    mixed = bt.batches(stamps, planned, CFG, sizes, "stamp_id", seed=3)
    assert {(r["out_size"], r["n"]) for r in mixed.select("out_size", F.size("image").alias("n")).distinct().collect()} == {(4, 16), (2, 4)}
    text = mixed._jdf.queryExecution().executedPlan().toString()
    assert text.count("embeddings.parquet") == 1 or text.count("FileScan") <= 2
    for size in sizes.training_sizes:
        alone = im.make_batch(stamps.join(planned.where(F.col("out_size") == size).withColumn("_d", F.concat_ws(":", "batch_id", "slot")), "stamp_id"), CFG, sizes, "_d", 3, True, size)
        pick = lambda df: rows(df.select("batch_id", "slot", F.posexplode("image")))
        assert pick(mixed.where(F.col("out_size") == size)) == pick(alone)
