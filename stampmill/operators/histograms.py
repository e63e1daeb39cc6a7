"""Moments and exact quantiles of all pixels of a stamp set, from histograms that each task builds over its images.

A first look at a few stamps places the bins, up to `EDGES` for each group; which ones they are changes the work and
never the result. One scan of the images then gives the moments and the counts of all bins, as one table a task,
and tables add up. A quantile whose bin holds a single value is known; the other bins are opened by further
scans that count within them only. No pixel ever is a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from stampmill.operators.quantiles import BINS, refine

EDGES, LOOK_STAMPS, LOOK_PIXELS = 1 << 14, 512, 1 << 10


@dataclass(frozen=True)
class Stream:
    """Values of a stamp set: its pixels, the finite ones or all exponentials, each stamp's range, or its least flux in sky sigma."""

    kind: str
    probs: tuple[float, ...] = ()

    def values(self, batch: pa.RecordBatch, chosen: np.ndarray) -> np.ndarray:
        """Values of the chosen rows of a batch, one stamp after the other."""
        rows = batch.take(pa.array(np.flatnonzero(chosen)))
        lists = rows.column("flux" if self.kind == "deepest" else "image")
        held = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if self.kind == "pixels":
            return held
        if self.kind == "finite":
            return held[np.isfinite(held)]
        if self.kind == "exponentials":
            with np.errstate(over="ignore"):
                return np.exp(held)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        some = sizes > 0
        starts = (np.cumsum(sizes) - sizes)[some]
        least = np.fmin.reduceat(held, starts) if len(starts) else held[:0]
        if self.kind == "deepest":
            noise = rows.column("noise").to_numpy(zero_copy_only=False).astype(np.float64)[some]
            good = np.isfinite(noise) & (noise > 0)
            return least[good] / noise[good]
        return (np.maximum.reduceat(held, starts) if len(starts) else held[:0]) - least


@dataclass
class Summary:
    """What is known of one stream of one group. Sums are about `shift`, over all values."""

    n: int = 0
    finite: int = 0
    shift: float = 0.0
    sums: tuple[float, float, float] = (0.0, 0.0, 0.0)
    least: float | None = None
    most: float | None = None
    quantiles: list[float] = field(default_factory=list)
    pixels: int = 0

    @property
    def skipped(self) -> int:
        """Pixels that are no value of the stream."""
        return self.pixels - self.n

    @property
    def mean(self):
        return self.shift + self.sums[0] / self.n if self.n else None

    @property
    def std(self):
        return float(np.sqrt(max(self._central(2), 0.0))) if self.n else None

    @property
    def skew(self):
        if not self.n:
            return None
        with np.errstate(all="ignore"):
            skew = self._central(3) / max(self.std, 1e-12) ** 3
        return float(skew) if np.isfinite(skew) else 0.0

    def _central(self, power: int) -> float:
        a, b, c = (s / self.n for s in self.sums)
        return b - a * a if power == 2 else c - 3 * a * b + 2 * a**3


_COUNTS = "_group int, _stream int, _bin int, n bigint, finite bigint, pixels bigint, a double, b double, c double, lo double, hi double"


def _by_group(batch: pa.RecordBatch, groups: dict[tuple, int], by: Sequence[str]):
    """(group, chosen rows) of the groups in a batch."""
    keys = zip(*(batch.column(k).to_pylist() for k in by)) if by else [()] * len(batch)
    of = np.array([groups[k] for k in keys], np.int64)
    for g in np.unique(of):
        yield int(g), of == g


def _counted(values: np.ndarray, bins: np.ndarray, into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Add sorted values in their bins to counts, least and greatest values."""
    if len(values):
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        here = bins[first]
        n, lo, hi = into
        n[here] += np.diff(np.append(first, len(bins)))
        lo[here] = np.fmin(lo[here], values[first])
        hi[here] = np.fmax(hi[here], values[np.append(first[1:], len(bins)) - 1])


def _none(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(size, np.int64), np.full(size, np.nan), np.full(size, np.nan)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = [*[pa.int32()] * 3, *[pa.int64()] * 3, *[pa.float64()] * 5]
    names = ["_group", "_stream", "_bin", "n", "finite", "pixels", "a", "b", "c", "lo", "hi"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 11, types)], names)


def summarise(df: DataFrame, streams: Sequence[Stream], by: Sequence[str] = ()) -> dict[tuple, list[Summary]]:
    """A summary of each stream for each group of `df` (keys, image; flux and noise for "deepest").

    Groups are few: bands, panels, labels. Moments are of all values, quantiles of the finite ones.
    """
    by = list(by)
    needed = df.select(*by, *[c for c in ("image", "flux", "noise") if c in df.columns])
    sizes = needed.groupBy(*by).count().collect()
    groups = {tuple(r[k] for k in by): i for i, r in enumerate(sizes) if r["count"]}
    names = list(groups)
    if not groups:
        return {}
    share = min(1.0, LOOK_STAMPS * len(groups) / sum(r["count"] for r in sizes))
    looked = needed if share == 1.0 else needed.sample(fraction=share, seed=1)

    def look(batches):
        for batch in batches:
            for g, chosen in _by_group(batch, groups, by):
                for s, stream in enumerate(streams):
                    found = stream.values(batch, chosen)
                    found = np.sort(found[np.isfinite(found)])
                    if len(found) > (most := LOOK_PIXELS * int(chosen.sum())):
                        found = found[np.linspace(0, len(found) - 1, most).astype(int)]
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([s], pa.int32()), pa.array([np.unique(found)], pa.list_(pa.float64()))], ["g", "s", "v"])

    edges = {(g, s): np.zeros(0) for g in range(len(groups)) for s in range(len(streams))}
    held: dict[tuple[int, int], list] = {}
    for r in looked.mapInArrow(look, "g int, s int, v array<double>").collect():
        held.setdefault((r["g"], r["s"]), []).append(np.asarray(r["v"], float))
    for place, parts in held.items():
        found = np.unique(np.concatenate(parts))
        edges[place] = found if len(found) <= EDGES else found[np.linspace(0, len(found) - 1, EDGES).astype(int)]
    shifts = {place: float(np.median(e)) if len(e) else 0.0 for place, e in edges.items()}

    def count(batches):
        tables: dict = {}
        for batch in batches:
            for g, chosen in _by_group(batch, groups, by):
                for s, stream in enumerate(streams):
                    found = stream.values(batch, chosen)
                    # An edge has a bin of its own, between those of the values below and above it.
                    at = edges[g, s]
                    bins, sums, span = tables.setdefault((g, s), (_none(2 * len(at) + 1), np.zeros(6), [np.nan, -np.inf]))
                    pixels = pc.sum(pc.list_value_length(batch.column("image")).filter(pa.array(chosen))).as_py() or 0
                    with np.errstate(all="ignore"):
                        away = found - shifts[g, s]
                        sums += [len(found), np.isfinite(found).sum(), pixels, away.sum(), (away**2).sum(), (away**3).sum()]
                    if len(found):  # the range of all values, a NaN counting as the greatest as in SQL
                        span[:] = np.fmin(span[0], np.fmin.reduce(found)), np.maximum(span[1], np.max(found))
                    good = np.sort(found[np.isfinite(found)])
                    _counted(good, np.searchsorted(at, good, "left") + np.searchsorted(at, good, "right"), bins)
        rows = []
        for place, ((n, lo, hi), sums, span) in tables.items():
            rows.append((*place, -1, *sums[:3].astype(int).tolist(), *sums[3:].tolist(), *map(float, span)))
            rows += [(*place, int(b), int(n[b]), 0, 0, 0.0, 0.0, 0.0, float(lo[b]), float(hi[b])) for b in np.flatnonzero(n)]
        yield _table(rows)

    def added(rows: DataFrame):
        folded = rows.groupBy("_group", "_stream", "_bin").agg(
            *[F.sum(c).alias(c) for c in ("n", "finite", "pixels", "a", "b", "c")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        return folded.collect()

    out = {name: [Summary(shift=shifts[g, s]) for s in range(len(streams))] for name, g in groups.items()}
    bins: dict[tuple[int, int], list] = {}
    for r in added(needed.mapInArrow(count, _COUNTS)):
        if r["_bin"] < 0:
            one = out[names[r["_group"]]][r["_stream"]]
            one.n, one.finite, one.pixels, one.sums = r["n"], r["finite"], r["pixels"], (r["a"], r["b"], r["c"])
            one.least, one.most = (r["lo"], r["hi"]) if one.n else (None, None)
        else:
            bins.setdefault((r["_group"], r["_stream"]), []).append((r["_bin"], r["n"], r["lo"], r["hi"]))

    # Ranks whose bins hold several values are looked for within those bins only.
    def count_bins(brackets):
        of: dict[tuple[int, int], list] = {}
        for i, ((g, s), lo, hi) in enumerate(brackets):
            of.setdefault((g, s), []).append((i, lo, hi))

        def inside(batches):
            tables: dict = {}
            for batch in batches:
                for g, chosen in _by_group(batch, groups, by):
                    for s, stream in enumerate(streams):
                        if (g, s) not in of:
                            continue
                        found = stream.values(batch, chosen)
                        found = np.sort(found[np.isfinite(found)])
                        for i, lo, hi in of[g, s]:
                            part = found[np.searchsorted(found, lo, "left") : np.searchsorted(found, hi, "right")]
                            place = np.minimum(np.floor((part - lo) / (hi - lo) * BINS), BINS - 1).astype(np.int64)
                            _counted(part, place, tables.setdefault(i, _none(BINS)))
            yield _table([(i, 0, int(b), int(n[b]), 0, 0, 0.0, 0.0, 0.0, float(lo[b]), float(hi[b])) for i, (n, lo, hi) in tables.items() for b in np.flatnonzero(n)])

        return [(r["_group"], r["_bin"], r["n"], r["lo"], r["hi"]) for r in added(needed.mapInArrow(inside, _COUNTS))]

    for s, stream in enumerate(streams):
        known = {(g, s): sorted(bins[g, s]) for g in range(len(groups)) if (g, s) in bins}
        if stream.probs and known:
            wholes = {place: (sum(b[1] for b in held), held[0][2], held[-1][3]) for place, held in known.items()}
            for (g, _), found in refine(wholes, stream.probs, count_bins, known).items():
                out[names[g]][s].quantiles = found
    return out
