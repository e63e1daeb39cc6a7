import numpy as np
import pytest
from pyspark.sql import functions as F

from stampmill.operators import ordering as o, quantiles as q, runlog as rl
from stampmill.operators.batches import batch_plan


def test_quantiles_are_bit_equal_either_way(spark):
    v = np.random.default_rng(7).normal(size=1000) * 1000
    df = spark.createDataFrame([(i % 3, float(x)) for i, x in enumerate(v)], "g int, v double")
    probs = tuple(np.linspace(0, 1, 23))
    one, many = ({r["g"]: list(r["q"]) for r in q.exact_quantiles(df, "v", probs, by=["g"], percentile_rows=n).collect()} for n in (10**9, 10))
    assert one == many


def test_a_faded_giant_is_still_seen(spark):
    n = 3000
    df = spark.createDataFrame([(1, i, 1e200 if i == 0 else 1.0) for i in range(n)], "run long, step long, loss double")
    got = {r["step"]: r["loss_ema"] for r in rl.ewma(df, "run", "step", "loss", 0.1, segment_rows=50).collect()}
    want = 1e200
    for i in range(1, n):
        want = 0.9 * want + 0.1
        assert got[i] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("parts", [1, 7])
def test_row_numbers_and_prefix_sums(spark, parts):
    v = np.random.default_rng(1).permutation(1000)
    df = spark.createDataFrame([(int(x), int(x) % 5) for x in v], "k long, n long").repartition(parts)
    assert all(r["k"] == r["row_index"] for r in o.global_row_number(df, "k").collect())
    sums = np.concatenate([[0], np.cumsum(np.arange(1000) % 5)[:-1]])
    assert all(sums[r["k"]] == r["before"] for r in o.global_prefix_sum(df, "k", value="n", name="before").collect())


@pytest.mark.parametrize("rows", [10**9, 0])
def test_quantiles_both_ways(spark, rows):
    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=3000), "b": np.concatenate([np.zeros(2000), rng.exponential(size=500) ** 8]), "c": np.array([3.5])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("a", float("nan")), ("b", None)], "g string, v double")
    probs = (0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0)
    got = {r["g"]: r for r in q.exact_quantiles(df, "v", probs, by=["g"], percentile_rows=rows).collect()}
    for k, v in data.items():
        assert got[k]["n"] == len(v)
        assert got[k]["q"] == pytest.approx(np.quantile(v, probs).tolist(), rel=1e-12, abs=1e-15)
    whole = q.exact_quantiles(df.where("g = 'a'"), "v", probs, percentile_rows=rows).first()["q"]
    assert whole == pytest.approx(np.quantile(data["a"], probs).tolist(), rel=1e-12)


def test_samples(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = [r["k"] for r in o.sample_n(df.repartition(5), 50, 3, "k").collect()]
    assert a == [r["k"] for r in o.sample_n(df.repartition(2), 50, 3, "k").collect()] == sorted(set(a)) and len(a) == 50
    assert a == [r["k"] for r in o.sample_n(df, 50, 3, "k").collect()]
    drawn = o.sample_with_replacement(df, 2000, 3, "k").collect()
    assert len(drawn) == 2000 and len({r["k"] for r in drawn}) > 450
    halves = o.half_splits(spark.range(7).withColumnRenamed("id", "k"), 3, 1, "k").groupBy("repeat_index").agg(F.count("k").alias("n"), F.sum("half").alias("h")).collect()
    assert [(r["n"], r["h"]) for r in halves] == [(6, 3)] * 3


def test_batch_plan(spark):
    plan = batch_plan(spark.range(103).withColumnRenamed("id", "k"), 10, 5, 2, (128, 64), "k").collect()
    assert len(plan) == 200 and {r["batch_id"] for r in plan} == set(range(20))
    for b in range(20):
        rows = [r for r in plan if r["batch_id"] == b]
        assert sorted(r["slot"] for r in rows) == list(range(10)) and {r["out_size"] for r in rows} == {(128, 64)[b % 2]}
    for e in (0, 1):
        assert len({r["k"] for r in plan if r["epoch"] == e}) == 100
    with pytest.raises(ValueError):
        batch_plan(spark.range(3).withColumnRenamed("id", "k"), 10, 5, 1, (1,), "k")


@pytest.mark.parametrize("alpha, segment", [(0.02, 4096), (0.02, 16), (0.5, 8), (0.9, 4096)])
def test_running_mean(spark, alpha, segment):
    rng = np.random.default_rng(4)
    series = {1: rng.normal(size=900), 2: rng.normal(size=3), 3: rng.normal(size=1)}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)], "run long, step long, loss double")
    got = {(r["run"], r["step"]): r["loss_ema"] for r in rl.ewma(df, "run", "step", "loss", alpha, segment_rows=segment).collect()}
    for k, vs in series.items():
        e = vs[0]
        for i, v in enumerate(vs):
            e = v if i == 0 else (1 - alpha) * e + alpha * v
            assert got[(k, i)] == pytest.approx(e, abs=1e-12)


def test_checkpoints_round_to_even(spark):
    log = spark.range(1, 31).withColumnRenamed("id", "step")
    got = [r["step"] for r in rl.checkpoint_rows(log, 25, 10).orderBy("step").collect()]
    assert got == [round(25 * (i + 1) / 10) for i in range(10)]
