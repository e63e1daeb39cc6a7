"""Moments and quantiles of pixels against numpy, and how often the images are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stampmill.operators import histograms as hi, measure as me
from stampmill.operators.histograms import Stream, summarise

PROBS = (0.0, 0.001, 0.16, 0.5, 0.99, 1.0)


@pytest.fixture
def stamps(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        values = rng.normal(k % 3, 1, 64) if k % 5 else rng.integers(0, 3, 64).astype(float)
        if k % 7 == 0:
            values[:3] = (np.nan, np.inf, -np.inf)
        rows.append((k, None if k == 59 else "ab"[k % 2], values.tolist(), float(k % 4) or None))
    return spark.createDataFrame(rows, "k int, g string, image array<double>, noise double").withColumn("flux", F.transform("image", lambda v: v * 2))


def by_group(stamps, key="g"):
    out = {}
    for r in stamps.collect():
        out.setdefault((r[key],), []).append(r)
    return out


@pytest.fixture
def scans(spark, monkeypatch):
    """The plans that tasks read images from."""
    kind = type(spark.range(0))
    seen, real = [], kind.mapInArrow

    def counted(self, *args, **kwargs):
        seen.append(self._jdf.queryExecution().optimizedPlan().toString())
        return real(self, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    return seen


@pytest.mark.parametrize("edges", [1 << 14, 8, 1])
def test_against_numpy(spark, stamps, scans, monkeypatch, edges):
    monkeypatch.setattr(hi, "EDGES", edges)
    streams = [Stream("finite", PROBS), Stream("ranges", (0.5,)), Stream("deepest"), Stream("exponentials", (0.5,))]
    found = summarise(stamps, streams, ["g"])
    groups = by_group(stamps)
    assert set(found) == set(groups)
    for key, rows in groups.items():
        every = np.concatenate([r["image"] for r in rows])
        good = every[np.isfinite(every)]
        x, spread, deep, flux = found[key]
        assert (x.n, x.skipped) == (len(good), len(every) - len(good)) and (x.least, x.most) == (good.min(), good.max())
        assert (x.mean, x.std) == (pytest.approx(good.mean(), abs=1e-12), pytest.approx(good.std()))
        assert x.skew == pytest.approx(((good - good.mean()) ** 3).mean() / good.std() ** 3, abs=1e-9)
        assert x.quantiles == pytest.approx(np.quantile(good, PROBS).tolist(), abs=0)
        ranges = np.array([max(r["image"]) - min(r["image"]) for r in rows])
        assert spread.quantiles == pytest.approx([np.median(ranges[np.isfinite(ranges)])])
        noisy = [min(v for v in r["flux"] if v == v) / r["noise"] for r in rows if r["noise"]]
        assert deep.least == (min(noisy) if noisy else None)
        raised = np.exp(every)
        assert flux.quantiles == pytest.approx([np.median(raised[np.isfinite(raised)])])
    assert not any("Generate" in plan for plan in scans)


def test_few_scans(spark, scans):
    """A look at some stamps, the one scan of all, and nothing more where the bins tell all; else their insides."""
    rng = np.random.default_rng(1)
    small = spark.createDataFrame([(rng.normal(size=16).tolist(),) for _ in range(40)], "image array<double>")
    me.set_stats(small).collect()
    assert len(scans) == 2
    scans.clear()
    large = spark.range(6000).select(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.sin(F.col("id") * 16 + i)).alias("image"))
    row = me.set_stats(large).first()
    values = np.sin(np.arange(6000 * 16))
    assert (row["p50"], row["p99_9"]) == (pytest.approx(np.median(values), abs=1e-12), pytest.approx(np.quantile(values, 0.999), abs=1e-12))
    assert len(scans) <= 2 + 2 * 2 and not any("Generate" in plan for plan in scans)


def test_no_values(spark):
    none = spark.createDataFrame([([float("nan")],), ([],), (None,)], "image array<double>")
    assert tuple(me.shared_range(none).first()) == (0.0, 1.0)
    assert me.sample_report(none).first()["flux_median"] is None
    assert me.set_stats(none.limit(0)).collect() == []
    assert tuple(me.shared_range(none.limit(0)).first()) == (0.0, 1.0)
