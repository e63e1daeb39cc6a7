"""Repeated word spans by compaction of a De Bruijn graph of token k-mers.

Edges are windows of `length` words, nodes what two windows in a row have in common. Only edges met twice
matter. A window is filed under its anchor, the least hashed run of words in it, so equal windows have equal
anchors; stretches of windows with one anchor are one compacted path of the graph from the start. Anchors met
once cannot lie in a repeated window and fall out by count. Where every stretch of an anchor is the same, the
stretch is a repeated path as it is. Where stretches differ their windows are counted as single edges, once
for each different stretch.

Joins give every repeated edge its source, the first place it is met, and the degrees of its nodes. Edges whose
sources follow each other over nodes of degree one are one path, so a text is told as a few spans of paths.
Each span names the place of its source, and in the end the words at both places are compared by 128-bit
digest. Should a hash have confused two windows, the work is done again with another seed.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from stampmill.llm.suffixes import _least_before, _mix
from stampmill.llm.tables import dropped, kept, whole

_MULTIPLIER = 0x9E3779B97F4A7C15
#: Words that one step of a task holds as arrays; requests that one source text answers at a time.
_STEP, _REQUESTS = 1 << 19, 1 << 12


class Graph:
    """Hashes of runs of words, and the stretches of windows that share an anchor."""

    def __init__(self, length: int, seed: int):
        self.length, self.seed, self.step = length, seed, _STEP
        self.run = max(1, length // 3)
        powers = np.full(_STEP + 2 * length + 1, _MULTIPLIER, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers)
        inverse = np.full(len(powers), pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.inverses = np.cumprod(inverse)

    def _sums(self, hashes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[: len(hashes)])])

    def _runs(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((sums[ends] - sums[starts]) * self.inverses[starts])

    def words(self, data: bytes) -> list[bytes]:
        return data.split()  # bytes are split at the six blanks of the contract only

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.array([xxh64_intdigest(w, self.seed) for w in words], np.uint64)

    def _stretches_of(self, pieces: list[np.ndarray]):
        """Piece, first window, windows, anchor hash and own hash of every stretch."""
        joined, sizes = np.concatenate(pieces), np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        sums = self._sums(joined)
        at = np.arange(len(joined) - self.run + 1)
        runs = self._runs(sums, at, at + self.run)
        keys = (runs & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
        anchor = (_least_before(keys, self.length - self.run + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        piece = np.searchsorted(ends, np.arange(len(anchor)), side="right")
        valid = np.flatnonzero(np.arange(len(anchor)) + self.length <= ends[piece])
        anchor, piece = anchor[valid], piece[valid]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]))
        first, count = valid[new], np.diff(np.append(new, len(valid)))
        own = _mix(self._runs(sums, first, first + count + self.length - 1) ^ count.astype(np.uint64))
        return piece[new], first - (ends - sizes)[piece[new]], count, runs[anchor[new]], own

    def stretches(self, texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first windows, windows, anchors, own hashes) of each text's word hashes; long texts go in pieces."""
        out = [[] for _ in texts]
        pieces, owners, held = [], [], 0

        def flush():
            nonlocal pieces, owners, held
            if pieces:
                piece, first, count, anchor, own = self._stretches_of(pieces)
                cuts = np.searchsorted(piece, np.arange(len(pieces) + 1))
                for k, (t, start) in enumerate(owners):
                    part = slice(cuts[k], cuts[k + 1])
                    out[t].append((first[part] + start, count[part], anchor[part], own[part]))
            pieces, owners, held = [], [], 0

        most = self.step - self.length
        for t, text in enumerate(texts):
            for start in range(0, len(text) - self.length + 1, most):
                piece = text[start : start + most + self.length - 1]
                if held + len(piece) > self.step:
                    flush()
                pieces.append(piece)
                owners.append((t, start))
                held += len(piece)
        flush()
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return [tuple(np.concatenate(c) for c in zip(*parts)) if parts else none for parts in out]

    def nodes(self, hashes: np.ndarray, first: int, count: int) -> np.ndarray:
        """Hashes of the nodes before, between and after `count` windows; a stretch is never longer than a window."""
        part = hashes[first : first + count + self.length - 1]
        sums, at = self._sums(part), np.arange(count + 1)
        return self._runs(sums, at, at + self.length - 1)


def _joined(words: list[bytes], start: int, end: int) -> bytes:
    return xxh3_128_digest(b" ".join(words[start:end]))


_PATH_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("windows", pa.int32()), ("s_row", pa.int64()), ("s_first", pa.int32())]))


def _paths(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and columns (first, windows, source row, source first) of each list's spans in order, those that follow each other as one."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), sizes)
    first, windows, s_row, s_first, head = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in lists.flatten().flatten())
    order = np.lexsort((first, owner))
    owner, first, windows, s_row, s_first, head = (c[order] for c in (owner, first, windows, s_row, s_first, head))
    same = (owner[1:] == owner[:-1]) & (s_row[1:] == s_row[:-1]) & (head[1:] == 0)
    same &= (first[1:] == first[:-1] + windows[:-1]) & (s_first[1:] == s_first[:-1] + windows[:-1])
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(owner)), bool), ~same]))
    windows = np.add.reduceat(windows, new) if len(new) else windows
    return np.searchsorted(owner[new], np.arange(len(lists) + 1)), [first[new], windows, s_row[new], s_first[new]]


def _cleaned(words: list[bytes], begin: np.ndarray, end: np.ndarray) -> tuple[int, str, list[list[int]]]:
    """Removed words, hash of the rest and the maximal removed spans."""
    breaks = np.flatnonzero(begin[1:] > end[:-1])
    begin, end = begin[np.concatenate([[0], breaks + 1])], end[np.concatenate([breaks, [len(end) - 1]])]
    rest, last = [], 0
    for a, b in zip(begin.tolist(), end.tolist()):
        rest += words[last:a]
        last = b
    rest += words[last:]
    return int((end - begin).sum()), hashlib.sha256(b" ".join(rest)).hexdigest(), np.stack([begin, end], 1).tolist()


def _repeats(docs: DataFrame, id_col: str, text_col: str, length: int, seed: int) -> DataFrame | None:
    """The result of `repeats`, or nothing if a source did not bear out its span."""
    graph = Graph(length, seed)
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("digest", F.xxhash64("text"))
    id_type = dict(texts.dtypes)["id"]

    def file(batches):
        names = ["id", "digest", "n_words", "sha", "first", "windows", "anchor", "own"]
        for batch in (b.slice(k, 1024) for b in batches for k in range(0, len(b), 1024)):
            words = [graph.words(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column("text")]
            found = list(zip(*graph.stretches([graph.hashes(w) if len(w) >= length else np.zeros(0, np.uint64) for w in words]))) or [[]] * 4
            n, sha = pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())
            ints = [pa.array([x.astype(np.int32) for x in c], pa.list_(pa.int32())) for c in found[:2]]
            longs = [pa.array([x.view(np.int64) for x in c], pa.list_(pa.int64())) for c in found[2:]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), n, sha, *ints, *longs], names)

    filed = texts.select("id", "digest", "text").mapInArrow(file, f"id {id_type}, digest long, n_words long, sha string, first array<int>, windows array<int>, anchor array<long>, own array<long>")
    filed = kept(filed.withColumn("row", F.monotonically_increasing_id()), "filed-windows")
    met = kept(filed.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("anchor"), "met-anchors")
    each = filed.select("row", F.explode(F.arrays_zip("first", "windows", "anchor", "own")).alias("x")).select("row", "x.*")
    some = kept(each.join(met, "anchor"), "met-stretches")
    dropped(met)
    # An anchor with one kind of stretch is a path of the graph already.
    kinds = some.groupBy("anchor").agg((F.min("own") != F.max("own")).alias("mixed"), F.min(F.struct("row", "first")).alias("source"))
    some_kinds = kept(kinds, "anchor-kinds")
    told = kept(some.join(some_kinds, "anchor").select("row", "first", "windows", "own", "mixed", F.col("source.row").alias("s_row"), F.col("source.first").alias("s_first")), "told-stretches")
    named = kept(filed.select("row", "id", "digest", "n_words", "sha"), "filed-rows")
    dropped(some, some_kinds, filed)
    places = F.collect_list(F.when(F.col("mixed"), F.struct("first", "windows", "own")))
    rows = named.select("row", "id", "digest").join(told.groupBy("row").agg(places.alias("mixed")), "row")
    rows = rows.select(F.col("id").alias("i"), F.col("digest").alias("d"), "row", "mixed")
    # Rows that repeat in id and text would meet each other's places, so each pair of them is read once.
    first = kept(rows.groupBy("i", "d").agg(F.collect_list(F.struct("row", "mixed")).alias("rows")), "rows-of-texts")
    read = texts.join(first, texts["id"].eqNullSafe(first["i"]) & (texts["digest"] == first["d"]))
    read = read.dropDuplicates(["i", "d"]).select("text", F.explode("rows").alias("r")).select("r.row", "text", "r.mixed")

    def unfold(batches):
        names = ["row", "packed", "own", "first", "nodes"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        for batch in (b.slice(k, 512) for b in batches for k in range(0, len(b), 512)):
            out = []
            for row, text, mixed in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("mixed").to_pylist()):
                words = graph.words(text.as_py().encode("utf-8", "surrogatepass"))
                out.append((row, zlib.compress(b" ".join(words), 1), None, None, None))
                hashes = graph.hashes(words) if mixed else None
                out += [(row, None, m["own"], m["first"], graph.nodes(hashes, m["first"], m["windows"]).view(np.int64)) for m in mixed]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, types)], names)

    stored = kept(read.mapInArrow(unfold, "row long, packed binary, own long, first int, nodes array<long>"), "unfolded-windows")
    dropped(first)
    mixed = stored.filter(F.col("nodes").isNotNull())
    distinct = kept(mixed.groupBy("own").agg(F.count("*").alias("n"), F.min(F.struct("row", "first")).alias("source"), F.first("nodes").alias("nodes")), "mixed-stretches")
    edges = distinct.select("own", "n", "source", F.posexplode(F.arrays_zip(F.slice("nodes", F.lit(1), F.size("nodes") - 1).alias("u"), F.slice("nodes", F.lit(2), F.size("nodes") - 1).alias("v"))).alias("j", "e"))
    edges = edges.select("own", "j", "n", "e.u", "e.v", F.struct(F.col("source.row").alias("row"), (F.col("source.first") + F.col("j")).alias("first")).alias("source"))
    again = kept(edges.groupBy("u", "v").agg(F.sum("n").alias("n"), F.min("source").alias("source")).filter(F.col("n") > 1).select("u", "v", "source"), "repeated-edges")
    # A path goes on over nodes that one repeated edge enters and one leaves.
    ends = again.select(F.col("u").alias("node"), F.lit(1).alias("leave"), F.lit(0).alias("enter")).union(again.select(F.col("v"), F.lit(0), F.lit(1)))
    forks = kept(ends.groupBy("node").agg(F.sum("leave").alias("leave"), F.sum("enter").alias("enter")).filter((F.col("leave") > 1) | (F.col("enter") > 1)).select(F.col("node").alias("u"), F.lit(1).alias("head")), "forks")
    flagged = kept(again.join(forks, "u", "left").select("u", "v", "source", F.coalesce("head", F.lit(0)).alias("head")), "flagged-edges")
    back = edges.select("own", "j", "u", "v").join(flagged, ["u", "v"]).groupBy("own").agg(F.collect_list(F.struct(F.col("j").alias("first"), F.lit(1).alias("windows"), F.col("source.row").alias("s_row"), F.col("source.first").alias("s_first"), "head")).alias("edges"))

    def path(batches):
        for batch in batches:
            offsets, columns = _paths(batch.column("edges"))
            structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PATH_TYPE.value_type)], fields=list(_PATH_TYPE.value_type))
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)], ["own", "paths"])

    compact = kept(back.mapInArrow(path, "own long, paths array<struct<first:int,windows:int,s_row:long,s_first:int>>"), "paths")
    dropped(again, forks, flagged, distinct)
    loose = mixed.select("row", "first", "own").join(compact, "own").select("row", "first", F.explode("paths").alias("p"))
    # Between stretches a path goes on wherever the sources do.
    loose = loose.select("row", (F.col("first") + F.col("p.first")).alias("first"), "p.windows", "p.s_row", "p.s_first")
    spans = told.filter(~F.col("mixed")).select("row", "first", "windows", "s_row", "s_first").union(loose)
    listed = spans.groupBy("row").agg(F.collect_list(F.struct("first", "windows", "s_row", "s_first", F.lit(0).alias("head"))).alias("spans"))
    bodies = stored.filter(F.col("packed").isNotNull()).select("row", "packed")

    def remove(batches):
        names = ["row", "n_removed", "kept", "spans", "s_row", "s_first", "windows", "digest"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary())]
        for batch in (b.slice(k, 512) for b in batches for k in range(0, len(b), 512)):
            out = []
            offsets, (first, windows, s_row, s_first) = _paths(batch.column("spans"))
            end = first + windows + length - 1
            for row, packed, a, b in zip(batch.column("row").to_pylist(), batch.column("packed"), offsets[:-1], offsets[1:]):
                words = zlib.decompress(packed.as_py()).split()
                ask = a + np.flatnonzero((s_row[a:b] != row) | (s_first[a:b] != first[a:b]))
                digests = [_joined(words, x, y) for x, y in zip(first[ask].tolist(), end[ask].tolist())]
                out.append((row, *_cleaned(words, first[a:b], end[a:b]), s_row[ask], s_first[ask], windows[ask], digests))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 8, types)], names)

    cleaned = bodies.join(listed, "row").mapInArrow(remove, "row long, n_removed long, kept string, spans array<array<int>>, s_row array<long>, s_first array<int>, windows array<int>, digest array<binary>")
    cleaned = kept(cleaned, "cleaned-rows")
    dropped(told, compact)
    # Many texts ask one source for the same words: each question is put once, and a text answers some at a time.
    asked = cleaned.select(F.explode(F.arrays_zip("s_row", "s_first", "windows", "digest")).alias("a")).select("a.*").distinct()
    share = F.pmod(F.xxhash64("digest"), F.lit(1 << 30))
    counted = kept(asked, "asked-spans")
    shares = kept(counted.groupBy("s_row").agg(F.ceil(F.count("*") / _REQUESTS).alias("shares")), "asked-shares")
    grouped = counted.join(shares, "s_row").groupBy("s_row", F.pmod(share, F.col("shares")).alias("part")).agg(F.collect_list(F.struct("s_first", "windows", "digest")).alias("asked"))

    def answer(batches):
        for batch in (b.slice(k, 64) for b in batches for k in range(0, len(b), 64)):
            wrong = 0
            for packed, asked_ in zip(batch.column("packed").to_pylist(), batch.column("asked").to_pylist()):
                words = zlib.decompress(packed).split()
                wrong += sum(_joined(words, a["s_first"], a["s_first"] + a["windows"] + length - 1) != a["digest"] for a in asked_)
            if wrong:
                yield pa.RecordBatch.from_arrays([pa.array([wrong], pa.int64())], ["wrong"])

    refuted = bodies.join(grouped, bodies["row"] == grouped["s_row"]).select("packed", "asked").mapInArrow(answer, "wrong long")
    if refuted.agg(F.sum("wrong")).first()[0]:
        return None
    dropped(stored, counted, shares)
    result = named.select("row", "id", "n_words", "sha").join(cleaned.select("row", "n_removed", "kept", "spans"), "row", "left")
    return result.select(
        "id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept", "sha").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"),
    )


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, spans: the repeated words of every row.

    A word is removed when a window of `length` words that covers it also begins anywhere else in the rows,
    the same text included; windows never reach over two rows. Words are what lies between blanks; null and
    empty texts have none. Rows that repeat in id and text repeat each other, so their long texts go whole;
    null ids are ids like any other. Empty table: empty. Other columns are not read, whatever their names.
    `spans` are the maximal removed runs as [start, end) in words. A text is one value of its row and is
    worked on in steps of bounded size.
    """
    for seed in range(42, 45):
        found = _repeats(docs, id_col, text_col, length, seed)
        if found is not None:
            return found
    raise RuntimeError("three seeds in a row confused different windows")


def without(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, kept: each text's words outside its spans joined by one space, for ids that stand for one row."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans):
            words, rest, last = (t or "").encode("utf-8", "surrogatepass").split(), [], 0
            for a, b in s if s is not None else []:
                rest += words[last:a]
                last = b
            out.append(b" ".join([*rest, *words[last:]]).decode())
        return pd.Series(out, dtype=object)

    named = found.select(F.col("id").alias("__id"), "spans")
    return docs.join(named, docs[id_col].eqNullSafe(named["__id"])).select(F.col(id_col).alias("id"), cut(F.col(text_col).cast("string"), "spans").alias("kept"))
