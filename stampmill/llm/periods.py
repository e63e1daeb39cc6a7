"""Periodic runs of words by a dictionary of basic factors.

The dictionary names every stretch of 1, 2, 4, ... words, so that equal stretches of a text have equal names.
A run with smallest period q begins with a stretch of length L, the largest power of two up to q, that occurs
again q words on. The occurrences of one name within twice L of each other form a few arithmetic progressions;
of these only the first members and their distances to all others have to be proposed as periods, since pairs
further along a progression lie in the same run. Each proposal is extended to both sides by the dictionary
itself, and runs proposed more than once, also by a multiple of their period, are told once.

A text is one value of its row; many short texts go through the arrays together.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampmill.llm.tables import whole

#: Words that one step of a task holds as arrays, if no single text has more.
_STEP = 1 << 17


def _renamed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs of names, equal for equal pairs."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1].astype(np.int64)


def _proposals(at: np.ndarray, name: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): distances from `size` to under twice that between places with equal names."""
    order = np.lexsort((at, name))
    p, n = at[order], name[order]
    gap = np.diff(p)
    gap[n[1:] != n[:-1]] = -1  # no gap between names
    # A place that two equal small gaps lead to carries on a progression; the others are first members.
    on = np.zeros(len(p), bool)
    on[2:] = (gap[1:] == gap[:-1]) & (gap[1:] > 0) & (2 * gap[1:] <= size)
    firsts = np.flatnonzero(~on)
    before = np.cumsum(~on) - 1  # of `firsts`: the last one up to each place
    here, period = [], []
    every = np.arange(len(p))
    for way in (1, -1):
        step, left = (1 if way == 1 else 0), every
        while len(left):
            k = before[left] + way * step
            inside = (k >= 0) & (k < len(firsts))
            left, k = left[inside], k[inside]
            other = firsts[k]
            q = way * (p[other] - p[left])
            near = (n[other] == n[left]) & (q < 2 * size)
            left, q, other = left[near], q[near], other[near]
            good = q >= size
            here.append(np.minimum(p[left], p[other])[good])
            period.append(q[good])
            step += 1
    return np.concatenate(here), np.concatenate(period)


def runs_of(texts: list[list[bytes]], least: int = 12) -> list[np.ndarray]:
    """For each text [start, length, period] of all its runs, by start, then period.

    A run is a stretch of at least `least` words and twice its smallest period that cannot be made longer.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return [np.zeros((0, 3), np.int64) for _ in texts]
    names = np.empty(total, np.int64)
    base = 0
    for end, text in zip(ends.tolist(), texts):  # words of different texts never have one name
        known: dict[bytes, int] = {}
        names[end - len(text) : end] = [base + known.setdefault(w, len(known)) for w in text]
        base += len(known)
    owner = np.repeat(np.arange(len(texts)), sizes)
    last = ends[owner]
    levels: list[np.ndarray] = []  # the names of each length, -1 where none occurs twice
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at, size = np.arange(total), 1
    while len(at):
        seen = np.bincount(names[at])[names[at]] > 1
        at = at[seen]
        level = np.full(total, -1, np.int64)
        level[at] = names[at]
        levels.append(level)
        if not len(at):
            break
        found.append(_proposals(at, names[at], size))
        # The next length: two halves in a row that both occur again.
        both = at + size < total
        at = at[both]
        at = at[(at + 2 * size <= last[at]) & (level[at + size] >= 0)]
        longer = np.full(total, -1, np.int64)
        if len(at):
            longer[at] = _renamed(level[at], level[at + size])
        names, size = longer, 2 * size
    place, period = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    if not len(place):
        return [np.zeros((0, 3), np.int64) for _ in texts]
    pairs = np.unique(np.stack([period, place], 1), axis=0)
    period, place = pairs[:, 0], pairs[:, 1]
    first, end = (ends - sizes)[owner[place]], last[place]
    right, left = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length, level = 1 << k, levels[k]
        i = place + right
        some = np.flatnonzero(i + period + length <= end)
        i = i[some]
        some = some[(level[i] >= 0) & (level[i] == level[i + period[some]])]
        right[some] += length
        i = place - left - length
        some = np.flatnonzero(i >= first)
        i = i[some]
        some = some[(level[i] >= 0) & (level[i] == level[i + period[some]])]
        left[some] += length
    start, long = place - left, left + right + period
    good = long >= np.maximum(least, 2 * period)
    rows = np.unique(np.stack([owner[place], start - first, long, period], 1)[good], axis=0)
    # One stretch has one smallest period; the rows of a stretch are next to each other, smallest first.
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[a:b, 1:] for a, b in zip(cuts[:-1], cuts[1:])]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(gone)[: len(words)] == 0
    return words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]


def planted(words: list[bytes], key: int | None) -> list[bytes]:
    """The words as they are, or for a tenth of all keys with a repetition written over their end."""
    n = len(words)
    if key is None or not n:
        return words
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, plant: bool = False) -> DataFrame:
    """id, n_words, runs (array of start, length, period by start, then period) and kept_words of every row.

    Words are what lies between blanks; null and empty texts have none, and no runs. `kept_words` is the
    text without what its runs repeat, words joined by one space. With `plant` each text is first written
    over as `planted` says; rows with a null id stay as they are. Repeated rows give repeated results; an
    empty table gives none. Other columns are not read, whatever their names. The dictionary of a text of n
    words takes n numbers for each power of two up to its longest repeated stretch.
    """
    chosen = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    id_type = dict(chosen.dtypes)["id"]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def told(ids, texts):
        out = runs_of(texts, least)
        flat = np.concatenate(out)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in out])])
        structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        rest = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(texts, out)]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
        return pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), lists.cast(run_type), pa.array(rest, pa.string())], ["id", "n_words", "runs", "kept_words"])

    def find(batches):
        for batch in batches:
            texts, begin, held = [], 0, 0
            for k, (key, text) in enumerate(zip(batch.column("id"), batch.column("text"))):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                texts.append(planted(words, key.as_py()) if plant else words)
                held += len(words)
                if held >= _STEP or k == batch.num_rows - 1:
                    yield told(batch.column("id").slice(begin, len(texts)), texts)
                    texts, begin, held = [], k + 1, 0

    return chosen.mapInArrow(find, f"id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_words string")


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and hashes of all runs and of the kept words."""
    longest = F.aggregate(
        "runs", F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    best = found.withColumn("best", longest)
    return best.select(
        "id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("kept_words", 256).alias("collapsed_sha256"),
    )
