"""Removal of long repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Which 400-byte strings occur twice is read off sorted suffixes. Not every suffix is sorted: every string
of the length asked holds an anchor, the place of the least 8-byte hash near its beginning, which depends
on the string alone, so equal strings have equal anchors. Anchors whose context is met once in the corpus
fall out by hash counts first. For the others each task sorts the suffixes at its anchors into a run,
equal ones once, and writes it front-coded. Runs are cut and exchanged by splitters of the suffixes and combined
with a loser tree that keeps every suffix's common prefix with the last one put out, and never compares
characters within it. Neighbours in that order with enough in common to the right, compared to the left
as well, tell for each anchor which of the strings around it occur elsewhere.

A group of suffixes that is larger than a piece of the order is cut by splitters. What its pieces cannot
tell alone is counted by 128-bit hash, so no piece grows with a hot group. The order bounds what can match
to the right of a suffix, counts of a few left parts what can match to the left, and strings that a piece
has found repeated are told once, so that few strings of a group are hashed.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampmill.llm.tables import dropped, kept, whole

_MULTIPLIER = 0x9E3779B97F4A7C15
#: Bytes of text that one step of a task holds as arrays; strings in one run and in one stored segment.
_STEP, _RUN, _SEGMENT = 1 << 21, 1 << 15, 512
#: Left parts of a suffix, in bytes, that are counted to bound what can match there.
_LEFTS = (4, 8, 16, 32, 64, 128)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _least_before(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row, from block-wise running minima."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()[:n]
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(behind[: n - width + 1], ahead[width - 1 :])


class Anchors:
    """Anchors of all strings of `length` bytes, and hashes of what follows them in every such string."""

    def __init__(self, length: int):
        self.length, self.window = length, length // 2
        self.context = length - self.window + 1
        powers = np.full(_STEP + (_STEP >> 1) + 2 * length + 1, _MULTIPLIER, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers)
        inverse = np.full(len(powers), pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.inverses = np.cumprod(inverse)

    def _of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece, place in the piece and context hash of every anchor of some pieces."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        grams = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(np.uint64).ravel()
        keys = (_mix(grams) & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        least = (_least_before(keys, self.window) & np.uint64(0xFFFFFF)).astype(np.int64)
        # Only strings that lie in one piece count: those that begin at most `length` before its end.
        begins = np.zeros(len(data) + 1, np.int8)
        np.add.at(begins, ends - sizes, 1)
        np.add.at(begins, ends - self.length + 1, -1)
        valid = np.flatnonzero(np.cumsum(begins[: len(least)]) > 0)
        found = least[valid]
        found = found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * self.powers[: len(data)])])
        hashes = _mix((sums[found + self.context] - sums[found]) * self.inverses[found])
        piece = np.searchsorted(ends, found, side="right")
        return piece, found - (ends - sizes)[piece], hashes

    def __call__(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(hashes, places) of the anchors of each text; long texts are read in overlapping pieces."""
        out = [([], []) for _ in texts]
        pieces, owners, held = [], [], 0

        def flush():
            nonlocal pieces, owners, held
            if pieces:
                piece, place, hashes = self._of(pieces)
                cuts = np.searchsorted(piece, np.arange(len(pieces) + 1))
                for k, (t, start) in enumerate(owners):
                    out[t][0].append(hashes[cuts[k] : cuts[k + 1]])
                    out[t][1].append(place[cuts[k] : cuts[k + 1]] + start)
            pieces, owners, held = [], [], 0

        for t, text in enumerate(texts):
            for start in range(0, len(text) - self.length + 1, _STEP):
                piece = text[start : start + _STEP + self.length - 1]
                if held + len(piece) > _STEP + self.length:
                    flush()
                pieces.append(piece)
                owners.append((t, start))
                held += len(piece)
        flush()
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        done = []
        for hashes, places in out:
            if not hashes:
                done.append(empty)
            elif len(hashes) == 1:
                done.append((hashes[0], places[0]))
            else:  # two pieces may both hold an anchor of the strings where they overlap
                place, first = np.unique(np.concatenate(places), return_index=True)
                done.append((np.concatenate(hashes)[first], place))
        return done


def _suffixes(text: bytes, places: np.ndarray, length: int, window: int) -> np.ndarray:
    """A row of bytes for each anchor: what follows it, then what precedes it, nearest first, padded with 255."""
    wide = np.frombuffer(b"\xff" * (window - 1) + text + b"\xff" * length, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(wide, window - 1 + length)[places]
    return np.concatenate([rows[:, window - 1 :], rows[:, : window - 1][:, ::-1]], axis=1)


def _common(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it; none for the first."""
    if not len(rows):
        return np.zeros(0, np.int64)
    different = rows[1:] != rows[:-1]
    first = np.where(different.any(axis=1), different.argmax(axis=1), rows.shape[1])
    return np.concatenate([[0], first])


def _run_rows(run: int, rows: np.ndarray, owner: np.ndarray, place: np.ndarray, segment: int = _SEGMENT):
    """A sorted run of distinct suffixes in front-coded segments, and whose they are."""
    width = rows.shape[1]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    rows, owner, place = rows[order], owner[order], place[order]
    common = _common(rows)
    fresh = common < width
    fresh[0] = True
    number = np.cumsum(fresh) - 1
    rows, common = rows[fresh], common[fresh]
    times = np.bincount(number)
    names = [r.tobytes() for r in rows]
    for s in range(0, len(names), segment):
        part = names[s : s + segment]
        own = slice(*np.searchsorted(number, [s, s + len(part)]))
        yield {
            "run": run, "start": s, "n": len(part), "first": part[0],
            "body": _encode(part, common[s : s + segment].tolist(), (times[s : s + segment] > 1).tolist()),
            "sid": ((run << 20) + number[own]).tolist(), "owner": owner[own].tolist(), "place": place[own].tolist(),
        }


_RUNS = "run long, start int, n int, first binary, body binary, sid array<long>, owner array<long>, place array<int>, row long, packed binary"


def _encode(names: list[bytes], shared: list[int], many: list[bool]) -> bytes:
    """Sorted strings front-coded: each without what it shares with the one before, the first one whole."""
    shared = [0, *shared[1:]]
    head = np.array(shared, "<u2").tobytes() + np.array(many, np.uint8).tobytes()
    return zlib.compress(head + b"".join(x[c:] for x, c in zip(names, shared)), 1)


def _decode(body: bytes, n: int, width: int) -> tuple[list[bytes], list[int], list[bool]]:
    data = zlib.decompress(body)
    shared = np.frombuffer(data, "<u2", n).tolist()
    many = np.frombuffer(data, np.bool_, n, 2 * n).tolist()
    at, last, names = 3 * n, b"", []
    for c in shared:
        last = last[:c] + data[at : at + width - c]
        at += width - c
        names.append(last)
    return names, shared, many


def _prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings, of which `known` bytes are known to agree."""
    n = min(len(a), len(b))
    at = known
    while at < n:
        x, y = a[at : at + 48], b[at : at + 48]
        if x != y:
            size = min(len(x), len(y))
            odd = int.from_bytes(x[:size], "big") ^ int.from_bytes(y[:size], "big")
            return at + size - (odd.bit_length() + 7) // 8
        at += 48
    return n


def merge(streams: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges sorted streams of (strings, common prefix with the one before) with a loser tree.

    Every waiting string carries its common prefix with the last string put out. Of two strings the one
    with the longer such prefix comes first; only at equal lengths are characters compared, from there on.
    Returns (stream, place) in order and each string's common prefix with the one put out before it.
    """
    count = len(streams)
    leaves = 1
    while leaves < max(1, count):
        leaves *= 2
    at = [0] * leaves
    now: list[bytes | None] = [streams[s][0][0] if s < count and streams[s][0] else None for s in range(leaves)]
    shared = [0] * leaves
    tree = [0] * leaves

    def better(a: int, b: int) -> tuple[int, int]:
        """(winner, loser), with the loser's prefix set to what it shares with the winner."""
        x, y = now[a], now[b]
        if y is None:
            return a, b
        if x is None or shared[a] < shared[b]:
            return b, a
        if shared[a] > shared[b]:
            return a, b
        both = _prefix(x, y, shared[a])
        if x[both:] <= y[both:]:
            shared[b] = both
            return a, b
        shared[a] = both
        return b, a

    level = list(range(leaves))
    node = leaves
    while node > 1:
        node //= 2
        following = []
        for k in range(node):
            winner, loser = better(level[2 * k], level[2 * k + 1])
            tree[node + k] = loser
            following.append(winner)
        level = following
    best = level[0]
    order, prefixes = [], []
    while now[best] is not None:
        order.append((best, at[best]))
        prefixes.append(shared[best])
        names, commons = streams[best]
        at[best] = k = at[best] + 1
        if k < len(names):
            now[best], shared[best] = names[k], commons[k]
        else:
            now[best] = None
        node = (best + leaves) // 2
        while node:
            best, tree[node] = better(best, tree[node])
            node //= 2
    return order, prefixes


def repeated(rows: np.ndarray, common: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """[suffix, j]: whether the string that begins j bytes before a suffix is met at another suffix too,
    and whether the suffix is the first of those that meet it.

    Suffixes are in order; at each j those that agree on length - j bytes to the right are one stretch,
    and within a stretch equal strings agree on j bytes to the left.
    """
    n = len(rows)
    out, first = np.zeros((n, window), bool), np.zeros((n, window), bool)
    right = np.minimum(common, length)
    group = np.cumsum(right < length - window + 1)
    sizes = np.bincount(group)
    held = np.flatnonzero(sizes[group] > 1)
    if not len(held):
        return out, first
    left = np.zeros(len(held), np.uint64)
    near = rows[held, length:]
    for j in range(window):
        if j:
            left = _mix(left * np.uint64(_MULTIPLIER) + near[:, j - 1] + np.uint64(1))
        stretch = np.cumsum(right < length - j)[held].astype(np.uint64)
        key = _mix(stretch * np.uint64(0xD6E8FEB86659FD93) ^ left)
        order = np.argsort(key)
        same = np.concatenate([[False], key[order[1:]] == key[order[:-1]], [False]])
        out[held[order[same[1:] | same[:-1]]], j] = True
        first[held[order[same[1:] & ~same[:-1]]], j] = True
    return out, first


def _string_hashes(rows: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """[suffix, j] 64-bit hashes of the right and left parts of the string that begins j bytes before."""
    right = np.zeros((len(rows), window), np.uint64)
    left = np.zeros((len(rows), window), np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for c in range(length):
        h = _mix(h * np.uint64(_MULTIPLIER) + rows[:, c] + np.uint64(1))
        if length - 1 - c < window:
            right[:, length - 1 - c] = h
    h = np.full(len(rows), 7, np.uint64)
    for j in range(1, window):
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + rows[:, length + j - 1] + np.uint64(1))
        left[:, j] = h
    return right, left


def _cut(body: bytes, n: int, width: int, splitters: list[bytes]):
    """(part, place of the first string, strings, body) of the pieces that the splitters make of a segment."""
    names, shared, many = _decode(body, n, width)
    at = 0
    while at < n:
        part = bisect_right(splitters, names[at])
        end = bisect_left(names, splitters[part], at) if part < len(splitters) else n
        yield part, at, end - at, body if end - at == n else _encode(names[at:end], shared[at:end], many[at:end])
        at = end


def _merge_part(table: pa.Table, splitters: list[bytes], length: int, window: int):
    """Which strings around each suffix of one piece of the order are repeated; cut groups as string hashes."""
    part = table.column("part")[0].as_py()
    width, least = length + window - 1, length - window + 1
    by_run: dict[int, list] = {}
    for r in table.to_pylist():
        by_run.setdefault(r["run"], []).append(r)
    streams, sids, times = [], [], []
    for run in sorted(by_run):
        names, commons, ids, many = [], [], [], []
        for r in sorted(by_run[run], key=lambda r: r["start"]):
            found, shared, more = _decode(r["body"], r["n"], width)
            if names:
                shared[0] = _prefix(names[-1], found[0])
            names += found
            commons += shared
            many += more
            ids += range((run << 20) + r["start"], (run << 20) + r["start"] + r["n"])
        streams.append((names, commons))
        sids.append(ids)
        times.append(many)
    order, prefixes = merge(streams)
    rows = np.frombuffer(b"".join(streams[s][0][k] for s, k in order), np.uint8).reshape(-1, width)
    common = np.array(prefixes, np.int64)
    common[0] = 0
    sid = np.array([sids[s][k] for s, k in order], np.int64)
    many = np.array([times[s][k] for s, k in order], bool)
    found, first = repeated(rows, common, length, window)
    # Only a long splitter lies within a group. What that group's suffixes may share with other pieces is counted later.
    group = np.cumsum(common < least)
    cut = np.zeros(len(rows), bool)
    if part and _prefix(splitters[part - 1], rows[0].tobytes()) >= least:
        cut |= group == group[0]
    if part < len(splitters) and _prefix(splitters[part], rows[-1].tobytes()) >= least:
        cut |= group == group[-1]
    # Neighbours in the order agree the furthest to the right; those of the first and last suffix may lie elsewhere.
    furthest = np.maximum(common, np.append(common[1:], length))
    furthest[0] = length
    open_ = ~found & (np.arange(window) >= length - np.minimum(furthest, length)[:, None])
    ask = np.packbits(open_ | first, axis=1)
    found[many] = True
    told = np.flatnonzero(found.any(axis=1))
    masks = np.packbits(found[told], axis=1)
    yield sid[told], [m.tobytes() for m in masks], None, None
    some = np.flatnonzero(cut)
    if len(some):
        yield sid[some], None, [r.tobytes() for r in rows[some]], [a.tobytes() for a in ask[some]]


def _left_probes(rows: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[suffix, probe] hashes of the common context and of a few left parts, and the parts' lengths."""
    sizes = [j for j in _LEFTS if j < window]
    right, left = _string_hashes(rows, length, window)
    return np.repeat(right[:, -1:], len(sizes), axis=1), left[:, sizes], np.array(sizes, np.int32)


def _splitters(runs: DataFrame, piece: int, length: int, window: int) -> list[bytes]:
    """Strings that cut the order into pieces of about `piece` suffixes, from a sample of segment heads.

    A splitter is as short as it can be, and within the common context of a group only where one group
    alone fills pieces, so that other groups are never cut.
    """
    total, segments = runs.agg(F.sum("n"), F.count("*")).first()
    parts = max(1, -(-(total or 0) // piece))
    if parts == 1:
        return []
    share = min(1.0, 16 * parts / segments)
    heads = sorted(bytes(r[0]) for r in runs.filter(F.pmod(F.xxhash64("run", "start"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("first").collect())
    out: list[bytes] = []
    for k in range(1, parts):
        at = k * len(heads) // parts
        if not at or not heads:
            continue
        short = heads[at][: min(length - window, _prefix(heads[at - 1], heads[at]) + 1)]
        if not out or short > out[-1]:
            out.append(short)
        elif heads[at] > out[-1]:
            out.append(heads[at])
    return out


def _shared_places(texts: DataFrame, short: int) -> DataFrame:
    """i, d, n_shared: for ids and digests that have any, the anchors of strings of `short` bytes whose context begins in another row too.

    Every string of `short` bytes that is met in another row holds such an anchor; the context is about half as long.
    """
    id_type = dict(texts.dtypes)["id"]

    def anchor(batches):
        find = Anchors(short)
        for batch in batches:
            found = pa.array([h.view(np.int64) for h, _ in find([t.encode() for t in batch.column("text").to_pylist()])], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), found], ["id", "digest", "hashes"])

    found = texts.select("id", "digest", "text").mapInArrow(anchor, f"id {id_type}, digest long, hashes array<long>")
    found = kept(found.withColumn("row", F.monotonically_increasing_id()), "short-anchors")
    each = found.select("row", F.explode("hashes").alias("h"))
    apart = kept(each.groupBy("h").agg(F.min("row").alias("x"), F.max("row").alias("y")).filter(F.col("x") != F.col("y")).select("h"), "shared-contexts")
    counted = each.join(apart, "h").groupBy("row").agg(F.count("*").alias("n"))
    out = found.select("row", F.col("id").alias("i"), F.col("digest").alias("d")).join(counted, "row").groupBy("i", "d").agg(F.max("n").alias("n_shared"))
    out = kept(out, "shared-places")
    dropped(found, apart)
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, piece: int = 1 << 14, segment: int = _SEGMENT, short: int | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, spans: the repeated bytes of every row.

    A byte is removed when a string of `length` bytes that covers it also begins anywhere else in the
    rows, the same text included; strings never reach over two rows. Texts count as UTF-8 bytes; null is
    empty. Rows that repeat in id and text repeat each other, so their long texts go whole. Empty
    table: empty. `spans` are the maximal removed runs as [start, end) in bytes. With `short` a column
    n_shared follows: places that a passage too short to be removed shares with other rows, at least one in
    every string of `short` bytes that is met in another row.
    """
    window = length // 2
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("digest", F.xxhash64("text"))
    id_type = dict(texts.dtypes)["id"]
    shared = _shared_places(texts, short) if short else None

    def anchor(batches):
        find = Anchors(length)
        for batch in batches:
            found = find([t.encode() for t in batch.column("text").to_pylist()])
            rest = [pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "digest", "n_bytes", "sha")), *rest], ["id", "digest", "n_bytes", "sha", "hashes", "places"])

    stated = texts.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), "text")
    anchors = stated.mapInArrow(anchor, f"id {id_type}, digest long, n_bytes long, sha string, hashes array<long>, places array<int>")
    anchors = kept(anchors.withColumn("row", F.monotonically_increasing_id()), "anchors")
    # Contexts met once cannot be in a repeated string.
    met = kept(anchors.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("h"), "contexts")
    single = anchors.select("row", F.explode(F.arrays_zip(F.col("hashes").alias("h"), F.col("places").alias("p"))).alias("a")).select("row", "a.h", "a.p")
    own = single.join(met, "h").groupBy("row").agg(F.collect_list("p").alias("places"))
    rows = anchors.select("row", "id", "digest").join(own, "row").groupBy("id", "digest").agg(F.min("row").alias("row"), F.min_by("places", "row").alias("places"))
    rows = kept(rows, "repeated-anchors").withColumnsRenamed({"id": "i", "digest": "d"})
    some = texts.join(rows, texts["id"].eqNullSafe(rows["i"]) & (texts["digest"] == rows["d"])).select("row", "text", "places")

    def sort(batches):
        task, chunk = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def batch_of(found):
            names = ["run", "start", "n", "first", "body", "sid", "owner", "place", "row", "packed"]
            types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 2, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([f.get(n) for f in found], t) for n, t in zip(names, types)], names)

        def run_of():
            nonlocal held, size, chunk
            found = list(_run_rows((task << 20) + chunk, *(np.concatenate(x) for x in zip(*held)), segment))
            held, size, chunk = [], 0, chunk + 1
            return batch_of(found)

        for batch in batches:
            packed = []
            for row, text, places in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("places")):
                data = text.as_py().encode()
                packed.append({"row": row, "packed": zlib.compress(data, 1)})
                at = np.sort(np.array(places.as_py(), np.int64))
                for k in range(0, len(at), _RUN):
                    part = at[k : k + _RUN]
                    held.append((_suffixes(data, part, length, window), np.full(len(part), row), part))
                    size += len(part)
                    if size >= _RUN:
                        yield run_of()
            yield batch_of(packed)
        if held:
            yield run_of()

    stored = kept(some.mapInArrow(sort, _RUNS), "suffix-runs")
    runs = stored.filter(F.col("run").isNotNull())
    splitters = _splitters(runs.select("run", "start", "n", "first"), piece, length, window)

    def deal(batches):
        names, types = ["part", "run", "start", "n", "body"], [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            cut = [(part, r["run"], r["start"] + at, n, body) for r in batch.to_pylist() for part, at, n, body in _cut(r["body"], r["n"], length + window - 1, splitters)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*cut)) or [[]] * 5, types)], names)

    def combine(table: pa.Table) -> pa.Table:
        schema = pa.schema([("sid", pa.int64()), ("mask", pa.binary()), ("body", pa.binary()), ("ask", pa.binary())])
        parts = [pa.table([pa.nulls(len(row[0]), f.type) if c is None else pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema) for row in _merge_part(table, splitters, length, window)]
        return pa.concat_tables(parts)

    dealt = runs.select("run", "start", "n", "body").mapInArrow(deal, "part int, run long, start int, n int, body binary")
    told = kept(dealt.groupBy("part").applyInArrow(combine, "sid long, mask binary, body binary, ask binary"), "repeated-strings")
    cut = told.filter(F.col("body").isNotNull()).select("sid", "body", "ask")
    hashed = "sid long, right long, left long, j int"

    def matrix(batch):
        return np.frombuffer(b"".join(batch.column("body").to_pylist()), np.uint8).reshape(len(batch), -1)

    def hashes_of(sid, right, left, j):
        return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(right.view(np.int64)), pa.array(left.view(np.int64)), pa.array(j, pa.int32())], ["sid", "right", "left", "j"])

    def probe(batches):
        for batch in (b.slice(k, 2048) for b in batches for k in range(0, len(b), 2048)):
            right, left, sizes = _left_probes(matrix(batch), length, window)
            yield hashes_of(np.repeat(batch.column("sid").to_numpy(), len(sizes)), right.ravel(), left.ravel(), np.tile(sizes, len(batch)))

    # No string that reaches further to the left than a part met once can be met twice.
    lone = cut.mapInArrow(probe, hashed).groupBy("right", "left", "j").agg(F.count("*").alias("n"), F.min("sid").alias("sid")).filter(F.col("n") == 1)
    bounded = cut.join(lone.groupBy("sid").agg(F.min("j").alias("below")), "sid", "left")

    def question(batches):
        for batch in (b.slice(k, 2048) for b in batches for k in range(0, len(b), 2048)):
            right, left = _string_hashes(matrix(batch), length, window)
            wanted = np.unpackbits(np.frombuffer(b"".join(batch.column("ask").to_pylist()), np.uint8).reshape(len(batch), -1), axis=1)[:, :window].astype(bool)
            below = batch.column("below").fill_null(window).to_numpy()
            at, j = np.nonzero(wanted & (np.arange(window) < below[:, None]))
            yield hashes_of(batch.column("sid").to_numpy()[at], right[at, j], left[at, j], j)

    counted = kept(bounded.mapInArrow(question, hashed), "cut-strings")
    again = kept(counted.groupBy("right", "left", "j").agg(F.count("*").alias("n")).filter(F.col("n") > 1).drop("n"), "cut-repeats")
    later = counted.join(again, ["right", "left", "j"]).groupBy("sid").agg(F.collect_list("j").alias("js"))
    marks = told.filter(F.col("mask").isNotNull()).select("sid", "mask", F.lit(None).cast("array<int>").alias("js")).unionByName(later.select("sid", F.lit(None).cast("binary").alias("mask"), "js"))
    owners = runs.select(F.explode(F.arrays_zip("sid", "owner", "place")).alias("o")).select("o.sid", F.col("o.owner").alias("row"), "o.place")
    strings = owners.join(marks, "sid").groupBy("row").agg(F.collect_list(F.struct("place", "mask", "js")).alias("strings"))
    bodies = stored.filter(F.col("packed").isNotNull()).select("row", "packed").dropDuplicates(["row"])

    def remove(batches):
        for batch in batches:
            out = []
            for packed, found in zip(batch.column("packed").to_pylist(), batch.column("strings").to_pylist()):
                data = zlib.decompress(packed)
                out.append(_removed(data, found, length, window))
            columns = list(zip(*out)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, t) for c, t in zip(columns, types))], ["row", "n_removed", "n_spans", "kept", "spans"])

    cleaned = bodies.join(strings, "row").mapInArrow(remove, "row long, n_removed long, n_spans long, kept string, spans array<array<int>>")
    known = rows.select("i", "d", "row").join(cleaned, "row").drop("row")
    every = anchors.select("id", "digest", "n_bytes", "sha")
    told = every.join(known, every["id"].eqNullSafe(known["i"]) & (every["digest"] == known["d"]), "left").drop("i", "d")
    more = []
    if shared is not None:
        told = told.join(shared, told["id"].eqNullSafe(shared["i"]) & (told["digest"] == shared["d"]), "left")
        more = [F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared")]
    return told.select(
        "id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"), *more,
    )


def _removed(data: bytes, found: list[dict], length: int, window: int) -> tuple[int, int, str, list[list[int]]]:
    """Removed bytes, spans, hash of the rest and the spans, from the repeated strings around some anchors."""
    starts = []
    for f in found:
        if f["mask"] is not None:
            j = np.flatnonzero(np.unpackbits(np.frombuffer(f["mask"], np.uint8))[:window])
        else:
            j = np.array(f["js"], np.int64)
        starts.append(f["place"] - j)
    at = np.unique(np.concatenate(starts))
    at = at[(at >= 0) & (at <= len(data) - length)]
    if not len(at):
        return 0, 0, hashlib.sha256(data).hexdigest(), []
    breaks = np.flatnonzero(at[1:] > at[:-1] + length)
    begin = at[np.concatenate([[0], breaks + 1])]
    end = at[np.concatenate([breaks, [len(at) - 1]])] + length
    rest, last = hashlib.sha256(), 0
    for a, b in zip(begin.tolist(), end.tolist()):
        rest.update(data[last:a])
        last = b
    rest.update(data[last:])
    return int((end - begin).sum()), len(begin), rest.hexdigest(), np.stack([begin, end], 1).tolist()


def remove_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, kept: each text's bytes without its spans, for ids that stand for one row."""

    @F.pandas_udf("binary")
    def cut(text, spans):
        import pandas as pd

        out = []
        for t, s in zip(text, spans):
            data, last, parts = (t or "").encode(), 0, []
            for a, b in s if s is not None else []:
                parts.append(data[last:a])
                last = b
            out.append(b"".join([*parts, data[last:]]))
        return pd.Series(out, dtype=object)

    named = found.select(F.col("id").alias("__id"), "spans")
    return docs.join(named, docs[id_col].eqNullSafe(named["__id"])).select(F.col(id_col).alias("id"), cut(F.col(text_col).cast("string"), "spans").alias("kept"))
