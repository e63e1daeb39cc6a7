"""Near-duplicates by the exact similarity of their shingle sets.

Rows with the same set of word shingles are one node. Fingerprints (SimHash of the sets) are looked up in the byte-position
lists of `simhash`, which link what is at most two bits apart. Sets of similarity 0.8 can be more bits apart than
the lists guarantee, so MinHash bands retrieve the other pairs, with as many bands as make a pair of the least asked
similarity meet with the asked probability. Every pair is verified on the sets, which are read again from the texts of the
nodes in question; pairs whose sketches alone show that they differ too much never get that far.
In the bands every node is held against one other first, the one of its lists that stands in the longest lists. Nodes of
long lists that this leaves in different classes are then searched among themselves by prefix and position: two sets of
similarity t share one of the n - ceil(t n) + 1 rarest shingles of each, and the first one that they share leaves enough
behind it in both. Only pairs that are not linked yet are verified there, so a group of copies costs a few
pairs a member.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from stampmill.llm.components import components
from stampmill.llm.simhash import fingerprint, row_key
from stampmill.llm.simhash import links as fingerprint_links
from stampmill.llm.tables import dropped, kept, whole
from stampmill.operators.keyed import sendable

#: Shingles that one step of a task holds as arrays.
_STEP = 1 << 18
#: Places of a sketch. An unrelated pair of sets falls out by it up to about twice as many shingles each.
_PLACES = 512
_MIX = np.random.default_rng(42).integers(1, 1 << 63, (2, 1024), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of a text's distinct runs of `size` words; a shorter text is one run, an empty one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as in the fingerprints
    if len(words) < size:
        runs = [b" ".join(words)] if words else []
    else:
        runs = map(b" ".join, zip(*(words[k:] for k in range(size))))
    return np.unique(np.array([xxh64_intdigest(r, 42) for r in runs], np.uint64))


def _band_keys(sets: list[np.ndarray], bands: int, rows: int) -> list[np.ndarray]:
    """A key for every band of every set that is not empty, from the least values of `rows` hash functions each."""
    held = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    keys = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            x = (held ^ _MIX[0, k]) * _MIX[1, k]
            x ^= x >> np.uint64(29)
            least = np.minimum.reduceat(x * _MIX[0, k], starts)
            key = (key ^ least) * _MIX[1, b]
            key ^= key >> np.uint64(32)
        keys[:, b] = key
    return list(keys.view(np.int64))


def _sketches(sets: list[np.ndarray]) -> list[np.ndarray]:
    """For every set, whether each of `_PLACES` places holds an odd number of its shingles, as longs."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = (np.concatenate(sets) % np.uint64(_PLACES)).astype(np.int64)
    odd = np.bincount(owner * _PLACES + place, minlength=len(sets) * _PLACES) & 1
    return list(np.packbits(odd.astype(bool).reshape(len(sets), _PLACES), axis=1).view(np.int64))


class Sets(NamedTuple):
    """Nodes (node, n, fp, sketch, bands) and what gives the packed texts (node, packed) of some of them."""

    nodes: DataFrame
    texts: Callable[[DataFrame], DataFrame]


def _read(texts: list[str | None], size: int, bands: int, rows: int) -> pd.DataFrame:
    sets = [shingle_set(t, size) for t in texts]
    keys = [np.zeros(0, np.int64)] * len(sets)
    sketches = [np.zeros(_PLACES // 64, np.int64)] * len(sets)
    fps = np.zeros(len(sets), np.uint64)
    step: list[int] = []
    held = 0
    for i, s in enumerate(sets):
        if len(s):
            step.append(i)
            held += len(s)
        if step and (held > _STEP or i == len(sets) - 1):
            some = [sets[j] for j in step]
            fps[step] = fingerprint(np.concatenate(some), np.cumsum([0, *(len(x) for x in some[:-1])]))
            for at, row, sketch in zip(step, _band_keys(some, bands, rows), _sketches(some)):
                keys[at], sketches[at] = row, sketch
            step, held = [], 0
    nodes = np.array([xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
    return pd.DataFrame({"node": nodes, "n": [len(s) for s in sets], "fp": fps.view(np.int64), "sketch": sketches, "bands": keys})


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    return shingle_set(zlib.decompress(packed).decode("utf-8", "surrogatepass"), size)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """u, v: the pairs whose sets are as similar as asked."""

    def alike(batches):
        known, last = None, None  # pairs of one node come one after the other
        for batch in batches:
            out = []
            for u, v, a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("a"), batch.column("b")):
                if u != known:
                    known, last = u, _unpacked(a.as_py(), size)
                other = _unpacked(b.as_py(), size)
                both = len(np.intersect1d(last, other, assume_unique=True))
                if both >= similarity * (len(last) + len(other) - both) - 1e-9:
                    out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 2, ["u", "v"])

    left, right = texts.select(F.col("node").alias("u"), F.col("packed").alias("a")), texts.select(F.col("node").alias("v"), F.col("packed").alias("b"))
    return pairs.join(right, "v").join(left, "u").mapInArrow(alike, "u long, v long")


def _alike(a, b, similarity: float):
    """Whether sets of these sizes can be as similar as asked."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def _ranked(crowd: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """node, n, alone, r: of each set of the crowd (node, n) how many shingles no other set has, and its rarest others that a partner must share one of."""

    @F.pandas_udf("array<long>")
    def shingles(packed: pd.Series) -> pd.Series:
        return pd.Series([_unpacked(p, size).view(np.int64) for p in packed])

    each = kept(crowd.join(texts, "node").select("node", "n", F.explode(shingles("packed")).alias("s")), "crowded-shingles")
    common = kept(each.groupBy("s").agg(F.count("*").alias("c")).filter(F.col("c") > 1), "shingle-counts")
    listed = each.join(common, "s").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("r"))
    alone = (F.col("n") - F.size("r")).alias("alone")
    # Shingles met once come first among the rarest, but lead nowhere: it is enough to know how many they are.
    first = (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int") - (F.col("n") - F.size("r"))
    out = kept(listed.select("node", "n", alone, F.slice("r", F.lit(1), F.greatest(first, F.lit(0))).alias("r")), "ranked-shingles")
    dropped(each, common)
    return out


def _apart_pairs(ranked: DataFrame, similarity: float) -> DataFrame:
    """u, v: pairs of ranked sets (node, n, root, alone, r) in different classes that may be as similar as asked."""
    rare = ranked.select("node", "n", "root", "alone", F.posexplode("r").alias("i", "x"))
    # How much of the set a shingle has from itself on, in the order of rarity.
    rare = kept(rare.select("node", "n", "root", "x.s", (F.col("n") - F.col("alone") - F.col("i")).alias("rest")), "rare-shingles")
    mixed = rare.groupBy("s", "root").agg(F.count("*").alias("c")).groupBy("s").agg(F.count("*").alias("classes"), F.max_by("root", "c").alias("main"), F.sum("c").alias("held")).filter(F.col("classes") > 1)
    # Sizes must be near for a pair, so members meet by size, in their own step and the next; a long list is dealt out besides.
    members = kept(rare.join(kept(mixed, "mixed-shingles"), "s").withColumn("step", F.floor(F.log("n") / -math.log(similarity - 1e-9))).withColumn("parts", F.least(F.ceil(F.col("held") / 256), F.lit(1024)).cast("int")), "mixed-lists")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = members.filter(F.col("root") != F.col("main")).withColumn("part", part).withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    others = others.select("s", "step", "part", *[F.col(c).alias(f"o_{c}") for c in ("node", "n", "root", "rest")])
    every = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    apart = (F.col("root") != F.col("o_root")) & ((F.col("root") == F.col("main")) | (F.col("node") < F.col("o_node")))
    reach = F.least("rest", "o_rest") * (1 + similarity) >= similarity * (F.col("n") + F.col("o_n")) - 1e-9
    out = others.join(every, ["s", "step", "part"]).filter(apart & reach).select(F.least("node", "o_node").alias("u"), F.greatest("node", "o_node").alias("v")).distinct()
    return out


def _in_mixed_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (key, node, n, length) with their classes, of lists that hold several."""
    rooted = kept(lists.join(roots, "node"), "rooted-lists")
    mixed = kept(rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter(F.col("x") != F.col("y")).select("key"), "mixed-keys")
    out = kept(rooted.join(mixed, "key"), "apart-lists")
    dropped(rooted, mixed)
    return out


def _near(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that may be as similar as asked by their sizes and sketches: no similar pair falls out.

    A sketch is the parity of the shingles in each of its places, so two sets differ in at least as many shingles as their
    sketches do in places.
    """
    told = nodes.select("node", "n", "sketch")
    ends = pairs.join(told.select(F.col("node").alias("u"), F.col("n").alias("a"), F.col("sketch").alias("x")), "u")
    ends = ends.join(told.select(F.col("node").alias("v"), F.col("n").alias("b"), F.col("sketch").alias("y")), "v")
    differing = sum((F.bit_count(F.get("x", F.lit(i)).bitwiseXOR(F.get("y", F.lit(i)))) for i in range(_PLACES // 64)), F.lit(0))
    few = differing * (1 + similarity) <= (1 - similarity) * (F.col("a") + F.col("b")) + 1e-9
    return ends.filter(_alike(F.col("a"), F.col("b"), similarity) & few).select("u", "v")


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """u, v: nodes of one fingerprint with the first of them, and first nodes whose fingerprints the byte lists link."""
    held = nodes.filter(F.col("n") > 0).select("node", "fp")
    first = kept(held.groupBy("fp").agg(F.min("node").alias("first")), "first-of-fingerprints")
    same = held.join(first, "fp").filter(F.col("node") != F.col("first")).select(F.col("first").alias("u"), F.col("node").alias("v"))
    close = fingerprint_links(first).withColumnsRenamed({"u": "fp", "v": "other"}).join(first.withColumnRenamed("first", "u"), "fp")
    close = close.select("u", F.col("other").alias("fp")).join(first.withColumnRenamed("first", "v"), "fp")
    return same.union(close.select("u", "v"))


def _merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """The classes (node, root) after the further links."""
    ends = more.join(roots.select(F.col("node").alias("u"), F.col("root").alias("x")), "u").join(roots.select(F.col("node").alias("v"), F.col("root").alias("y")), "v")
    tops = components(kept(ends.select(F.col("x").alias("u"), F.col("y").alias("v")), "merged-classes")).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return kept(roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "star-classes")


def links(sets: Sets, similarity: float = 0.8, list_limit: int = 8, size: int = 5, rounds: int = 2) -> DataFrame:
    """u, v: links whose components are those of all pairs of `similarity` that meet in a band.

    Members of lists up to `list_limit` long that are still apart are paired up as they are, those of longer
    lists by prefix and position: the limit and the number of rounds change the work, never the classes.
    """

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = kept(_near(pairs, sets.nodes, similarity).distinct(), f"{name}-pairs")
        texts = kept(sets.texts(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()), f"{name}-texts")
        out = kept(_verified(pairs, texts, similarity, size), f"{name}-links")
        dropped(pairs, texts)
        return out

    postings = sets.nodes.select("node", "n", F.explode("bands").alias("key"))
    lengths = kept(postings.groupBy("key").agg(F.count("*").alias("length")).filter(F.col("length") > 1), "band-lengths")
    lists = kept(postings.join(lengths, "key"), "band-lists")
    reach = kept(lists.groupBy("node").agg(F.sum("length").alias("reach")), "node-reach")
    hubs = kept(lists.join(reach, "node").groupBy("key").agg(F.max(F.struct("reach", "node", "n")).alias("hub")), "list-hubs")
    best = lists.join(hubs, "key").groupBy("node", "n").agg(F.max("hub").alias("hub"))
    stars = best.filter((F.col("node") != F.col("hub.node")) & _alike(F.col("n"), F.col("hub.n"), similarity)).select(F.col("hub.node").alias("u"), F.col("node").alias("v"))
    found = [verified(_fingerprint_pairs(sets.nodes).union(stars), "first")]
    dropped(lengths, reach, hubs)
    roots = lists.select("node").distinct().join(components(found[0]), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    roots = kept(roots, "first-classes")
    rooted = _in_mixed_lists(lists, roots)
    dropped(lists)
    if rooted.isEmpty():
        return found[0]
    crowd = kept(rooted.filter(F.col("length") > list_limit), "crowded-lists")
    ranked = None
    if not crowd.isEmpty():
        # Then against the member that has the least of its own, and some other one in each further round while that links many.
        texts = kept(sets.texts(crowd.select("node").distinct()), "crowded-texts")
        ranked = _ranked(crowd.select("node", "n").distinct(), texts, similarity, size)
        dropped(texts)
        plain = ranked.select("node", (F.col("alone") / F.col("n")).alias("own"))
        for turn in range(rounds):
            rank = lambda own, node: F.struct(own if turn == 0 else F.lit(0.0), F.xxhash64(node, F.lit(turn)))  # noqa: B023, E731
            lead = crowd.join(plain, "node", "left").withColumn("own", F.coalesce("own", F.lit(1.0)))
            lead = kept(lead.groupBy("key").agg(F.min_by(F.struct("node", "n", "root", "own"), rank(F.col("own"), "node")).alias("lead")), "list-leads")
            other = crowd.join(lead, "key").filter((F.col("root") != F.col("lead.root")) & _alike(F.col("n"), F.col("lead.n"), similarity))
            pairs = kept(other.groupBy("node").agg(F.min_by("lead.node", rank(F.col("lead.own"), "lead.node")).alias("u")).select("u", F.col("node").alias("v")), "turn-pairs")
            more = verified(pairs, "turn")
            tried, linked = pairs.count(), more.count()
            dropped(pairs, lead)
            if not linked:
                break
            found.append(more)
            before, roots = roots, _merged(roots, more)
            last, crowd = crowd, _in_mixed_lists(crowd.drop("root"), roots)
            dropped(before, last)
            if 50 * linked <= tried:
                break
        last, rooted = rooted, _in_mixed_lists(rooted.drop("root"), roots)
        dropped(last)
    short = rooted.filter(F.col("length") <= list_limit).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n", "root"))).alias("held"))
    later = F.slice("held", F.col("i") + 2, F.greatest(F.size("held") - F.col("i") - 1, F.lit(0)))
    pairs = short.select("held", F.posexplode("held").alias("i", "x")).select("x", F.explode(F.filter(later, lambda y: (y["root"] != F.col("x.root")) & _alike(F.col("x.n"), y["n"], similarity))).alias("y"))
    pairs = pairs.select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct()
    if ranked is not None:
        pairs = pairs.union(_apart_pairs(ranked.join(crowd.select("node", "root").distinct(), "node"), similarity)).distinct()
    found.append(verified(pairs, "apart"))
    dropped(rooted, roots, crowd, *([] if ranked is None else [ranked]))
    return reduce(DataFrame.union, found)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, collide: float = 0.9999, rows: int = 4) -> DataFrame:
    """The same columns, with one row of each class linked by shingle similarity: its smallest id, then its smallest text hash.

    A pair of `similarity` is retrieved with probability `collide` at least. Null and empty texts are
    alike; texts shorter than a shingle are one shingle. Null ids come last. Rows that repeat in id and
    text are one and the same document and keep one row. Columns whose names begin with __ are reserved.
    """
    bands = math.ceil(math.log(1 - collide) / math.log(1 - similarity**rows))

    @F.pandas_udf("struct<node:long,n:int,fp:long,sketch:array<long>,bands:array<long>>")
    def read(text: pd.Series) -> pd.DataFrame:
        return pd.concat([_read(text[k : k + 512].tolist(), size, bands, rows) for k in range(0, max(1, len(text)), 512)])

    @F.pandas_udf("binary")
    def pack(text: pd.Series) -> pd.Series:
        return pd.Series([zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in text], dtype=object)

    marked = kept(docs.select(row_key(id_col, text_col).alias("key"), read(F.col(text_col).cast("string")).alias("x")).select("key", "x.*"), "shingle-bands")
    # Of the rows of a node one stands for all; which one is told by id and text alone.
    nodes = kept(marked.groupBy("node").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("n", "fp", "sketch", "bands")]), "distinct-sets")
    dropped(marked)
    keyed = docs.select("*", F.col(id_col).isNull().alias("__null"), F.col(id_col).alias("__id"), F.xxhash64(whole(text_col)).alias("__h"))
    same = keyed["__id"].eqNullSafe(F.col("key.id")) & (keyed["__h"] == F.col("key.h"))

    def texts(near: DataFrame) -> DataFrame:
        wanted = kept(nodes.select("node", "key").join(near, "node"), "near-keys")
        return keyed.select("__id", "__h", F.col(text_col).cast("string").alias("__text")).join(sendable(wanted), same).select("node", pack("__text").alias("packed")).dropDuplicates(["node"])

    rooted = components(links(Sets(nodes.drop("key"), texts), similarity)).withColumnRenamed("node", "x")
    classes = nodes.select("node", "key").join(rooted, nodes["node"] == rooted["x"], "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("key").alias("key"))
    # Null ids are told by their flag, so that one exchange of the rows serves both the choice and repeated rows.
    zero = F.lit("0").cast(docs.schema[id_col].dataType)
    chosen = kept(classes.select(F.col("key.null").alias("__null"), F.coalesce("key.id", zero).alias("__id"), F.col("key.h").alias("__h")), "chosen-rows")
    dropped(nodes)
    stay = keyed.withColumn("__id", F.coalesce("__id", zero)).join(chosen, ["__null", "__id", "__h"], "left_semi")
    return stay.dropDuplicates(["__null", "__id", "__h"]).select(*docs.columns)
