import numpy as np
import pytest
from pyspark.sql import functions as F

from stampmill.cuts import HostCuts
from stampmill.operators import walk as w
from stampmill.queries import gate as qg
from stampmill.queries.views import stamps32
from stampmill.sources import catalogue as sc, stamps as ss, tables as st
from stampmill.operators import spectra as sp
from stampmill.queries.views import stamps8
from stampmill.streaming import stamp_streams

SF = "/root/testdata/sf0.001"


def stamps(spark, n=23, side=4):
    return spark.range(n).select(F.col("id").alias("host_id"), (F.col("id") % 6).cast("int").alias("band_idx"), F.lit(side).alias("native_size"),
                                 F.array_repeat(F.col("id").cast("float"), side * side).alias("image"))


def test_round_trip_and_fill(spark, tmp_path):
    path = str(tmp_path / "s")
    ss.write_stamps(stamps(spark).coalesce(1), path, 10)
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 3
    row = ss.read_stamps(spark, path).where("host_id = 7").first()
    assert row["x0"] == -1 and np.isnan(row["sky_noise"]) and row["image"] == [7.0] * 16 and row["schema_version"] == 3


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown stamp metadata"):
        ss.stored_form(stamps(spark).withColumn("colour", F.lit(1)))
    with pytest.raises(Exception, match="native_size squared"):
        ss.stored_form(stamps(spark).withColumn("native_size", F.lit(5))).collect()
    good = ss.stored_form(stamps(spark))
    for name, bad, message in (("v", good.withColumn("schema_version", F.lit(2)), "not of schema"), ("m", good.withColumn("native_size", F.col("host_id").cast("int")), "mixes"),
                               ("c", good.drop("tract"), "tract")):
        bad.write.parquet(str(tmp_path / name))
        with pytest.raises(ValueError, match=message):
            ss.read_stamps(spark, str(tmp_path / name))


@pytest.mark.parametrize("tasks", [1, 2, None])
def test_repack_keeps_row_order(spark, tmp_path, tasks):
    path = str(tmp_path / "r")
    for mode in ("errorifexists", "overwrite"):  # it can run again
        ss.repack(stamps(spark).repartition(5), path, 8, ("host_id",), mode=mode, tasks=tasks)
        found = {}
        for file in (tmp_path / "r").glob("*.parquet"):
            rows = [(r["file_id"], r["host_id"]) for r in spark.read.parquet(str(file)).select("file_id", "host_id").collect()]
            if not rows:  # the first task writes the schema even when no file fell to it
                continue
            assert len({f for f, _ in rows}) == 1
            found[rows[0][0]] = [h for _, h in rows]
        assert found == {k: list(range(8 * k, min(8 * k + 8, 23))) for k in range(3)}


def test_gather_keeps_order_and_repeats(spark):
    df = stamps(spark).withColumn("row_index", F.col("host_id"))
    asked = spark.createDataFrame([(0, 9), (1, 2), (2, 9)], "ord int, row_index long")
    assert [r["host_id"] for r in ss.gather(df, asked).collect()] == [9, 2, 9]
    many = spark.range(500).select((F.lit(499) - F.col("id")).cast("int").alias("ord"), (F.col("id") * 7 % 23).alias("row_index")).repartition(5)
    out = ss.gather(df, many)
    assert [r["host_id"] for r in out.collect()] == [(499 - k) * 7 % 23 for k in range(500)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and ss.gather(df, many.limit(0)).count() == 0


def test_cached_selection(spark, tmp_path):
    calls = []

    def select():
        calls.append(1)
        return spark.range(5)

    text = sc.selection_text(HostCuts(), ("r",))
    for _ in range(2):
        assert sc.cached(spark, select, str(tmp_path / "c"), text).count() == 5
    assert len(calls) == 1
    with pytest.raises(ValueError, match="other cuts"):
        sc.cached(spark, select, str(tmp_path / "c"), sc.selection_text(HostCuts(max_mag=1.0), ("r",)))
    with pytest.raises(ValueError, match="unknown bands"):
        sc.host_columns(("r", "q"))


def test_merge_skips_text_and_labels(spark):
    rows = [(0, "counts", "n", "3"), (1, "counts", "n", "4"), (0, "counts", "part", "0"), (0, "counts", "dataset", "x")]
    out = st.merge_counters(spark.createDataFrame(rows, "part int, block string, name string, value string")).collect()
    assert [(r["name"], r["total"], r["n_parts"]) for r in out] == [("n", 7.0, 2)]


def test_run_log(spark, tmp_path):
    lines = ['{"step":1,"loss":0.5,"loss_ema":0.5,"seconds":1.0}', '{"step":2,"event":"eval","sigma":[1.0,2.0],"loss_by_sigma":[0.1,0.2]}',
             '{"step":3,"event":"checkpoint","seconds":2.0,"sample_mean":0.1}', '{"step":4,"event":"stopped","signal":"SIGTERM"}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = st.read_run_log(spark, str(tmp_path / "log.jsonl"))
    assert [log[k].count() for k in ("step", "eval", "checkpoint", "stopped")] == [1, 2, 1, 1]
    assert log["eval"].orderBy("rung").collect()[1]["loss_by_sigma"] == 0.2


def test_visits(spark):
    rows = [(0, 0, 10, 1), (0, 0, 10, 2), (0, 0, 11, 1), (1, 0, 10, 1)]
    cells = spark.createDataFrame(rows, "cell_i int, cell_j int, visit long, detector long").withColumns({"tract": F.lit(1), "patch": F.lit(2), "band_idx": F.lit(0)})
    counts = w.cell_visit_counts(cells)
    assert {(r["cell_i"], r["cell_j"]): r["n_visits"] for r in counts.collect()} == {(0, 0): 2, (1, 0): 1}
    with pytest.raises(ValueError):
        w.cell_visit_counts(cells.limit(0))
    stamp = spark.createDataFrame([(1, 2, 0, 149.0, 10.0), (1, 2, 0, 10.0, 160.0)], "tract int, patch int, band_idx int, x double, y double")
    rows = w.with_depth(stamp, counts, 16).orderBy(F.desc("x")).collect()
    assert [(r["n_visits_min"], r["n_visits_max"], r["n_cells_spanned"], r["n_cells_missing"]) for r in rows] == [(1, 2, 2, 0), (0, 0, 1, 1)]
    assert rows[0]["cell_depth_ratio"] == 2.0 and rows[1]["cell_depth_ratio"] == float("inf")
    with pytest.raises(RuntimeError, match="transposed"):
        w.check_cell_convention(stamp.withColumn("x", F.lit(800.0)), counts, 16)


def test_a_large_stamp_covers_nine_cells(spark):
    df = spark.createDataFrame([(225.0, 225.0)], "x double, y double")
    cells = df.select(w.covered_cells(416)).first()[0]
    assert sorted((c["i"], c["j"]) for c in cells) == [(i, j) for i in range(3) for j in range(3)]


def test_a_coadd_listed_twice_fails(spark):
    hosts = spark.createDataFrame([(1, 1, 2)], "objectId long, tract int, patch int")
    coadds = spark.createDataFrame([(1, 2, 0, "u"), (1, 2, 0, "u")], "tract int, patch int, band_idx int, band string")
    with pytest.raises(Exception, match="listed twice"):
        w.host_coadds(hosts, coadds, ("u",)).collect()


def test_walking_and_checking_parts_moves_no_host(spark):
    hosts = spark.range(3000).select(F.col("id").alias("objectId"), (F.col("id") % 3).cast("int").alias("tract"), (F.col("id") % 20).cast("int").alias("patch"))
    walk = w.walk_order(hosts, 5)
    assert "hashpartitioning(tract" not in walk._jdf.queryExecution().executedPlan().toString()
    twice = walk.where("patch_rank % 4 = 0 OR patch_rank % 8 = 1")
    found = w.check_parts([twice, w.part(walk, 1, 4), w.part(walk, 2, 4)], walk)
    # No row is made for each host: neither repeated, as an except of all rows does, nor joined.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan
    ranks = {(r["tract"], r["patch"]): r["patch_rank"] for r in walk.collect()}
    want = {("in two parts", *k) for k, v in ranks.items() if v % 8 == 1} | {("in no part", *k) for k, v in ranks.items() if v % 4 == 3}
    rows = found.select("problem", "tract", "patch").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_walk_is_whole_patches_in_first_seen_order(spark):
    hosts = spark.range(300).select(F.col("id").alias("objectId"), (F.col("id") % 3).cast("int").alias("tract"), (F.col("id") % 20).cast("int").alias("patch"))
    rows = w.walk_order(hosts, 5).orderBy(*w.WALK).collect()
    seen = {}
    for r in sorted(rows, key=lambda r: (r["shuffle"], r["objectId"])):
        seen.setdefault((r["tract"], r["patch"]), len(seen))
    assert all(r["patch_rank"] == seen[(r["tract"], r["patch"])] for r in rows)
    walk = w.walk_order(hosts, 5)
    parts = [w.part(walk, k, 4) for k in range(4)]
    assert w.check_parts(parts, walk).isEmpty() and sum(p.count() for p in parts) == 300
    assert w.check_parts(parts[:3], walk).select("problem").distinct().collect()[0][0] == "in no part"
    with pytest.raises(ValueError, match="no hosts"):
        w.part(walk, 70, 71)
    with pytest.raises(RuntimeError, match="numberings"):
        w.check_walk(walk, hosts.limit(0))


def test_a_stream_run_again_changes_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = qg.with_depth(stamps32(spark, SF))
    first.where("host_id < 20").repartition(3).write.parquet(source)
    stamp_streams.stream_extract(spark, source, out, first.schema, qg.CUTS, files_per_batch=1).awaitTermination()
    before = stamp_streams.tallies(spark, out).collect()
    stamp_streams.stream_extract(spark, source, out, first.schema, qg.CUTS).awaitTermination()
    assert stamp_streams.tallies(spark, out).collect() == before and stamp_streams.manifest(spark, out).count() == 20
    first.where("host_id >= 20").write.mode("append").parquet(source)
    stamp_streams.stream_extract(spark, source, out, first.schema, qg.CUTS).awaitTermination()
    assert stamp_streams.manifest(spark, out).count() == first.count()
    assert stamp_streams.tallies(spark, out).collect() == __import__("stampmill.operators.manifest", fromlist=["x"]).rejection_counts(qg.manifest32(spark, SF)).collect()


def test_a_batch_run_twice_adds_once(spark, tmp_path):
    """Totals take turns in two places, so the disk stays as it is and a failed batch starts over."""
    out, stamps = str(tmp_path), stamps8(spark, SF)
    parts = [stamps.where(F.col("stamp_id") % 5 == k) for k in range(5)]
    values = lambda df: {r["lag"]: r["value"] for r in sp.autocorrelation(df).collect()}
    for k in (0, 1, 1, 2, 3, 3, 4):
        stamp_streams.add_to_total(parts[k], k, out, 8)
        assert len(list((tmp_path / "total").iterdir())) == min(k + 1, 2)
    whole, running = values(sp.power_state(stamps, 8)), values(stamp_streams.running_state(spark, out))
    assert whole.keys() == running.keys() and all(running[k] == pytest.approx(whole[k]) for k in whole)
