"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes. Two fingerprints that differ in at most two bits share at least six
of the eight, so of the four pairs of byte positions at least two are shared whole: the index lists
fingerprints under every two such pairs. Within a list the shared positional bytes of each pair are
tallied, pairs below the guaranteed minimum fall out, and the rest are verified bit by bit. Lists too
long to be paired up are linked exactly another way: fingerprints within one bit of the same value are
at most two bits apart, so every such value links at most 65 fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from stampmill.llm.components import components
from stampmill.llm.tables import kept, whole

#: Bytes of text that one step of a task holds as arrays.
_STEP = 1 << 20


def fingerprint(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One fingerprint per document from all shingle hashes, concatenated; documents begin at `starts`."""
    counts = np.diff(np.append(starts, len(hashes)))
    out = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    for bit in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(bit) & np.uint64(1)).astype(np.int64), starts[full])
        out[full] |= (2 * ones > counts[full]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints_of(texts: list[str | None], size: int = 3) -> np.ndarray:
    """Fingerprints of whole texts as unsigned longs; texts are worked through in steps of bounded size."""
    out: list[np.ndarray] = []
    hashes: list[int] = []
    starts: list[int] = []
    held = 0
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, and only the six blanks split
        starts.append(len(hashes))
        if len(words) < size:
            shingles = [b" ".join(words)] if words else []
        elif size == 3:
            shingles = [b"%b %b %b" % s for s in zip(words, words[1:], words[2:])]
        else:
            shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
        hashes += [xxh64_intdigest(s, 42) for s in shingles]
        held += len(words)
        if held > _STEP // 4:
            out.append(fingerprint(np.array(hashes, np.uint64), np.array(starts)))
            hashes, starts, held = [], [], 0
    if starts:
        out.append(fingerprint(np.array(hashes, np.uint64), np.array(starts)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def with_fingerprint(docs: DataFrame, text_col: str, to: str, size: int = 3) -> DataFrame:
    """The same rows with their fingerprint as a signed long in column `to`."""

    @F.pandas_udf("long")
    def marks(text):
        import pandas as pd

        return pd.Series(fingerprints_of(text.tolist(), size).view(np.int64))

    return docs.withColumn(to, marks(F.col(text_col).cast("string")))


def _byte(column: Column, place: int) -> Column:
    return F.shiftrightunsigned(column, 8 * place).bitwiseAND(0xFF)


def _shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes two fingerprints have in common."""
    x = a.bitwiseXOR(b)
    return sum(((_byte(x, i) == 0).cast("int") for i in range(8)), F.lit(0))


def links(fingerprints: DataFrame, bits: int = 2, list_limit: int = 48) -> DataFrame:
    """u, v: links whose components are those of all pairs of distinct `fp` at most two bits apart.

    `list_limit` is the length up to which a posting list is paired up; longer lists are linked over
    shared neighbours, so the limit changes the work, never the result.
    """
    if bits != 2:
        raise ValueError("the index is laid out for two differing bits")
    sets = list(combinations(range(4), 2))
    masks = [sum(0xFFFF << (16 * p) for p in s) for s in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    postings = fingerprints.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("list", "key")
    )
    lengths = kept(postings.groupBy("list", "key").agg(F.count("*").alias("n")).filter(F.col("n") > 1), "list-lengths")
    postings = kept(postings.join(lengths, ["list", "key"]), "postings")
    short = postings.filter(F.col("n") <= list_limit).groupBy("list", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    # Each member meets the later ones of its short list; the tally of shared bytes comes before the bits.
    pairs = (
        short.select("fps", F.posexplode("fps").alias("i", "u"))
        .select("u", F.explode(F.filter(F.slice("fps", F.col("i") + 2, F.greatest(F.size("fps") - F.col("i") - 1, F.lit(0))), lambda v: _shared_bytes(F.col("u"), v) >= 8 - bits)).alias("v"))
        .filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
    )
    long = postings.filter(F.col("n") > list_limit).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b)) for b in range(64)])
    near = long.select("fp", F.explode(flips).alias("middle")).groupBy("middle").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = near.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter(F.col("u") != F.col("v"))
    return pairs.select("u", "v").union(stars.select("u", "v")).distinct()


def classes(fingerprints: DataFrame) -> DataFrame:
    """fp, root: the linked class of every distinct fingerprint, named by one of its fingerprints."""
    rooted = components(links(fingerprints)).withColumnRenamed("node", "fp")
    return fingerprints.select("fp").join(rooted, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """id, fp, component: every row's fingerprint (signed long) and the smallest id of its linked class.

    Null and empty texts have fingerprint zero and link like any other; texts shorter than a shingle are
    one shingle. Repeated rows give repeated results. Null ids get their class's smallest id, and a class
    of null ids only has none. Empty table: empty.
    """
    rows = kept(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", "fp", size).select("id", "fp"), "fingerprints")
    distinct = kept(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    rooted = classes(distinct).join(distinct, "fp")
    smallest = kept(rooted.groupBy("root").agg(F.min("first").alias("component")), "smallest")
    named = kept(rooted.join(smallest, "root").select("fp", "component"), "named")
    return rows.join(named, "fp").select("id", "fp", "component")


def row_key(id_col: str, text_col: str) -> Column:
    """What rows of a class are ordered by: id with nulls last, then text hash."""
    return F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), F.xxhash64(whole(text_col)).alias("h"))


def first_rows(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` with the smallest key of each class, once each; `classes` has root and key."""
    first = classes.groupBy("root").agg(F.min("key").alias("key"))
    chosen = first.select(F.col("key.id").alias("__id"), F.col("key.h").alias("__h"))
    own = docs.withColumn("__h0", F.xxhash64(whole(text_col)))
    stay = own.join(chosen, own[id_col].eqNullSafe(chosen["__id"]) & (own["__h0"] == chosen["__h"]), "left_semi")
    return stay.dropDuplicates([id_col, "__h0"]).select(*docs.columns)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """The same columns, with one row of each linked class: its smallest id, then its smallest text hash.

    Null ids come last. Rows that repeat in id and text are one and the same document and keep one row.
    Columns whose names begin with __ are reserved.
    """
    marked = with_fingerprint(docs, text_col, "__fp", size).withColumn("__key", row_key(id_col, text_col))
    keys = kept(marked.select("__fp", "__key"), "near-keys").select(F.col("__fp").alias("fp"), F.col("__key").alias("key"))
    distinct = kept(keys.groupBy("fp").agg(F.min("key").alias("key")), "distinct-fingerprints")
    return first_rows(docs, classes(distinct).join(distinct, "fp").select("root", "key"), id_col, text_col)
