"""Licence notices: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

A template's words make its shingles. Every text is read in overlapping windows that are as wide as the
templates of a size class; a window's MinHash bands retrieve templates, and a retrieved template matches
when the window holds the asked share of its shingles. Bands and rows are set from the probability with
which a true match must collide. Windows without any shingle of a template cannot match and are not
hashed. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stampmill.llm import licence_texts as texts
from stampmill.llm.tables import kept, whole

#: What a scan looks for unless told otherwise.
TEMPLATES = texts.NOTICES | texts.BODIES
#: Places of the filter that goes out to the tasks for each of its three probes; shingles of templates that go out whole.
_PLACES, _SENT = 1 << 18, 1 << 20

_BREAK = "[^\\p{L}\\p{N}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _BREAK), "")


def _shingles(words: str, hashes: str, size: int) -> Column:
    """Hashes of runs of `size` words at every place, from word hashes; a shorter text is one run."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
    return F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def _with_shingles(rows: DataFrame, text_col: str, size: int) -> DataFrame:
    hashed = rows.withColumn("w", _words(F.col(text_col))).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    return hashed.withColumn("s", _shingles("w", "h", size))


def bands_for(containment: float, overlap: float, collide: float = 0.999, rows: int = 1) -> int:
    """How many bands of `rows` make a match of the least containment collide with probability `collide`.

    A window `overlap` times as wide as its template and holding `containment` of it has a similarity of
    containment / (1 + overlap - containment) at least.
    """
    similarity = containment / (1 + overlap - containment)
    return 1 if similarity >= 1 else math.ceil(math.log(1 - collide) / math.log(1 - similarity**rows))


def _band_keys(shingles: str, bands: int, rows: int) -> Column:
    """A key for every band from the least values of `rows` seeded hash functions each."""

    def least(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(k))))

    return F.array(*[F.xxhash64(F.lit(b), *[least(b * rows + r) for r in range(rows)]) for b in range(bands)])


def _filter(shingles: set[int]):
    """A test that every given shingle passes and nearly no other: three probes of tables of fixed size."""
    held = np.array(sorted(shingles), np.int64).view(np.uint64)
    flags = []
    for k in range(3):
        table = np.zeros(_PLACES, np.uint8)
        table[(held >> np.uint64(20 * k)) & np.uint64(_PLACES - 1)] = 1
        flags.append(F.lit(table.tobytes()))

    def test(h: Column) -> Column:
        probe = lambda k: F.substring(flags[k], F.shiftrightunsigned(h, 20 * k).bitwiseAND(_PLACES - 1).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
        return probe(0) & probe(1) & probe(2)

    return test


def templates(spark: SparkSession, notices: dict[str, str] = TEMPLATES, size: int = 5) -> DataFrame:
    """licence, n_words, shingles of every notice."""
    rows = _with_shingles(spark.createDataFrame(sorted(notices.items()), "licence string, notice string"), "notice", size)
    return rows.select("licence", F.size("w").alias("n_words"), F.array_distinct("s").alias("shingles"))


def scan(docs: DataFrame, notices: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", size: int = 5, containment: float = 0.8, rows: int = 1) -> DataFrame:
    """id, row, licence, containment, first_word: every template found in every row, at its best window.

    `notices` is a bounded list that the caller hands over. Null and empty texts hold nothing; repeated
    rows are reported each, told apart by `row`; ties go to the first window; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    known = sorted((r["licence"], list(r["shingles"])) for r in templates(spark, notices, size).collect())
    may_be = _filter({h for _, shingles in known for h in shingles})
    # Templates of similar size share windows, a little wider than the widest and at a grid of a quarter of it.
    classes: dict[int, list] = {}
    for licence, shingles in known:
        classes.setdefault(math.ceil(math.log2(len(shingles))), []).append((licence, shingles))
    layout = {power: (max(1, 2**power // 4), 2**power + max(1, 2**power // 4)) for power in classes}

    def windows_of(place: Column, power: int) -> Column:
        """All windows of a class in which a template with a shingle at this place can begin."""
        grid, width = layout[power]
        last = place - place % grid
        starts = [last - k * grid for k in range(-(-(width - grid) // grid) + 1)]
        return F.array(*[F.struct(F.lit(power).alias("power"), F.greatest(x, F.lit(0)).cast("int").alias("start")) for x in starts])

    found_at = _with_shingles(docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")), "text", size)
    # Only windows with some template's shingle can match; a filter of fixed size passes all of them and hardly another.
    places = F.transform(F.filter(F.transform("s", lambda h, i: F.struct(i.alias("i"), may_be(h).alias("on"))), lambda x: x["on"]), lambda x: x["i"])
    found_at = found_at.withColumn("places", F.when(F.exists("s", may_be), places).otherwise(F.array().cast("array<int>")))
    near = F.array_distinct(F.flatten(F.transform("places", lambda p: F.flatten(F.array(*[windows_of(p, power) for power in sorted(classes)])))))
    marked = found_at.select("id", "s", near.alias("near"), F.monotonically_increasing_id().alias("row"))
    width = F.create_map(*[F.lit(x) for power in sorted(layout) for x in (power, layout[power][1])])
    windows = marked.select("id", "row", "s", F.explode("near").alias("x")).select("id", "row", "x.power", "x.start", F.array_distinct(F.slice("s", F.col("x.start") + 1, F.element_at(width, F.col("x.power")))).alias("held"))
    windows = kept(windows, "licence-windows")
    found = None
    for power, members in sorted(classes.items()):
        overlap = layout[power][1] / min(len(shingles) for _, shingles in members)
        bands = bands_for(containment, overlap, rows=rows)
        probes = windows.filter(F.col("power") == power).select("id", "row", "start", "held", F.explode(F.array_distinct(_band_keys("held", bands, rows))).alias("key"))
        names = spark.createDataFrame(members, "licence string, shingles array<bigint>")
        keyed = names.select("licence", "shingles", F.explode(F.array_distinct(_band_keys("shingles", bands, rows))).alias("key"))
        sent = sum(len(shingles) for _, shingles in members) * bands <= _SENT
        pairs = probes.join(F.broadcast(keyed) if sent else keyed, "key")
        share = F.size(F.array_intersect("shingles", "held")) / F.size("shingles")
        hits = pairs.select("id", "row", "licence", "start", share.alias("containment")).filter(F.col("containment") >= containment)
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("row", "licence").agg(F.first("id").alias("id"), F.max(F.struct("containment", (-F.col("start")).alias("before"))).alias("b"))
    return best.select("id", "row", "licence", F.col("b.containment").alias("containment"), (-F.col("b.before")).cast("long").alias("first_word"))
