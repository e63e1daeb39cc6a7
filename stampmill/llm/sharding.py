"""Histogram sort into shards: probe boundaries are counted exactly and refined, then rows move once.

Rows are ordered by text hash, id and a row number, so equal texts lie side by side and no two keys are
equal. Each round draws a bounded number of probe keys inside the brackets that still hold a boundary,
counts the exact bytes and rows below every probe, and narrows the brackets. Only probes and their
counts reach the driver; a hot text or id is split like any other run of keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stampmill.llm.tables import kept, whole

_KEY = "S24"
_LOW, _HIGH = b"", b"\xff" * 24


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """Order-preserving 24-byte keys from three signed longs."""
    columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("h", "rank_id", "row")]
    return np.ascontiguousarray((np.stack(columns, 1) ^ np.uint64(1 << 63)).astype(">u8")).view(_KEY).ravel()


def _compact(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow stored row per document; everything after reads this table only."""
    text = whole(text_col)
    return kept(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("rank_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "shard-keys",
    )


def _histogram(rows: DataFrame, probes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows in each interval that the sorted probes cut; a probe belongs to the interval above it."""
    edges = np.array(probes, _KEY)

    def count(batches):
        size, n = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            place = np.searchsorted(edges, _keys(batch), side="right")
            np.add.at(size, place, batch.column("size").to_numpy())
            np.add.at(n, place, 1)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"place": full, "size": size[full], "n": n[full]})

    found = rows.select("h", "rank_id", "row", "size").mapInArrow(count, "place long, size long, n long")
    size, n = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for r in found.groupBy("place").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect():
        size[r["place"]], n[r["place"]] = r["size"], r["n"]
    return size, n


def _draw(rows: DataFrame, brackets: list[tuple[bytes, bytes, int]], each: int, seed: int) -> list[bytes]:
    """About `each` keys from within every bracket (low, high, rows), picked by a hash of the row number."""
    low = np.array([b[0] for b in brackets], _KEY)
    high = np.array([b[1] for b in brackets], _KEY)
    rate = np.array([min(1.0, each / max(1, b[2])) for b in brackets])

    def pick(batches):
        for batch in batches:
            keys = _keys(batch)
            at = np.searchsorted(low, keys, side="right") - 1
            inside = (at >= 0) & (keys < high[np.maximum(at, 0)])
            mix = (batch.column("row").to_numpy().view(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
            mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            drawn = inside & ((mix >> np.uint64(11)) / float(1 << 53) < rate[np.maximum(at, 0)])
            yield pa.RecordBatch.from_pydict({"key": pa.array([k.ljust(24, b"\0") for k in keys[drawn].tolist()], pa.binary())})

    return sorted(bytes(r["key"]) for r in rows.select("h", "rank_id", "row").mapInArrow(pick, "key binary").collect())


def boundaries(rows: DataFrame, n_shards: int, law: str, tolerance: float = 0.0005, probes: int = 64, max_rounds: int = 40) -> tuple[list[bytes], list[bytes], list[int]]:
    """The n_shards - 1 boundary keys, all probed keys between, and the exact rows below each of those.

    A boundary is settled when what lies below it is within `tolerance` of a shard of its target, or no
    row is left between it and its neighbours. The law `rows` has no tolerance: counts are at most one apart.
    """
    known: dict[bytes, tuple[int, int]] = {}
    size, n = _histogram(rows, [])
    total = (int(size.sum()), int(n.sum()))
    known[_LOW], known[_HIGH] = (0, 0), total
    which = 0 if law == "bytes" else 1
    targets = [total[which] * k // n_shards for k in range(1, n_shards)]
    slack = int(tolerance * total[which] / n_shards) if law == "bytes" else 0
    cuts: list[bytes] = []
    for turn in range(max_rounds):
        order = sorted(known)
        below = np.array([known[k][which] for k in order])
        cuts, brackets = [], {}
        for target in targets:
            at = int(np.argmin(np.abs(below - target)))
            cuts.append(order[at])
            if abs(int(below[at]) - target) > slack:
                right = int(np.searchsorted(below, target, side="left"))
                a, b = order[right - 1], order[right]
                inside = known[b][1] - known[a][1]
                if inside > 1:
                    brackets[a] = (a, b, inside)
        if not brackets:
            return cuts, order[1:-1], [known[k][1] for k in order[1:-1]]
        fresh = _draw(rows, [brackets[a] for a in sorted(brackets)], probes, turn + 1)
        new = sorted(set(order[1:-1]) | set(fresh))
        size, n = _histogram(rows, new)
        for k, s, m in zip(new, np.cumsum(size).tolist(), np.cumsum(n).tolist()):
            known[k] = (s, m)
    raise RuntimeError(f"boundaries did not settle in {max_rounds} rounds")


def shard(docs: DataFrame, n_shards: int = 8, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.0005, runs: int = 64) -> DataFrame:
    """id, size, text_crc32, shard, slot: every row's shard and its gapless place there.

    `law` is "bytes" (sizes near equal) or "rows" (counts at most one apart). Null text counts no bytes
    and has the checksum of an empty one; null ids sort first; repeated rows get slots of their own; an
    empty table gives an empty result. `runs` is how many ordered pieces each shard is numbered in.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law}")
    rows = _compact(docs, id_col, text_col)
    cuts, _, _ = boundaries(rows, n_shards, law, tolerance)
    # Finer cuts only spread the numbering; their exact row counts give each piece its first slot.
    pieces = _draw(rows, [(_LOW, _HIGH, rows.count())], n_shards * runs, 0)
    edges = sorted(set(cuts) | set(pieces))
    _, n = _histogram(rows, edges)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    of_shard = np.searchsorted(np.array(cuts, _KEY), np.array([_LOW, *edges], _KEY), side="right")
    start = {s: int(first[np.flatnonzero(of_shard == s)[0]]) for s in set(of_shard.tolist())}
    base = np.array([int(f) - start[s] for f, s in zip(first.tolist(), of_shard.tolist())])
    table = np.array(edges, _KEY)

    def place(batches):
        for batch in batches:
            piece = np.searchsorted(table, _keys(batch), side="right")
            new = [pa.array(piece, pa.int64()), pa.array(of_shard[piece], pa.int32()), pa.array(base[piece], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "piece", "shard", "base"])

    schema = T.StructType([*rows.schema, *(T.StructField(n, t) for n, t in (("piece", T.LongType()), ("shard", T.IntegerType()), ("base", T.LongType())))])
    placed = rows.mapInArrow(place, schema)
    number = F.expr("row_number() OVER (PARTITION BY piece ORDER BY h, rank_id, row)")
    return placed.withColumn("slot", F.col("base") + number - 1).select("id", "size", "text_crc32", "shard", "slot")
