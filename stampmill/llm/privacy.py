"""Personal data: fixed kinds by pattern, and words that corpus co-occurrence shows to give them away.

A protected entity is a value of one of the four kinds, or a part that values share. How strongly a word
reveals it is the share of the entity's information that the word carries: pointwise mutual information over
the entity's information content, from document counts of the whole corpus. A word needs evidence to count as
disclosing: judged by its other documents, left out one by one, it must name the entity more likely than not
at a stated confidence, so a word met once tells nothing in a corpus of any size. Words over the threshold are
marked in every document that holds the entity, wherever they stand. `sanitise` generalises values to their
kind's name and removes such words. Only DataFrame functions are used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampmill.llm.tables import dropped, kept, whole

#: Fixed: kinds in the order of the contract, then the kind that the method adds.
KINDS = ["email", "ip", "card", "phone"]
TERM = "term"

# Possessive and anchored forms of the contract's patterns that find the same valid matches in linear time.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"
#: Lengths that are summed in one go, as a power of two; buckets of the word filter that goes out to the tasks, one byte each.
_BLOCK_BITS, _BUCKETS = 7, 1 << 18
#: From the first letter or digit between blanks to the last.
_WORD = r"[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}])?"


def _luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, x: total + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(value, "\\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        ) & F.forall(F.split(value, "\\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """`use` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(sizes: Column) -> Column:
    """Running sums of an array of ints, by blocks, so that the work stays far from the square of its length."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda t, x: t + x)
    block = F.lit(1 << _BLOCK_BITS)

    def blocks(s):
        last = F.shiftright(F.greatest(F.size(s) - 1, F.lit(0)), _BLOCK_BITS)
        return F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(s, b * block + 1, block)))

    def within(s, before):
        return F.transform(s, lambda _, i: F.get(before, F.shiftright(i, _BLOCK_BITS)) + total(F.slice(s, i - i % block + 1, i % block + 1)))

    before = lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
    return _let(sizes, lambda s: _let(_let(blocks(s), before), lambda found: within(s, found)))


def _located(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their ends in code points: the text between matches gives their places."""
    size = lambda x: F.length(F.coalesce(x, F.lit("")))

    def placed(found):
        sizes = F.zip_with(F.split(text, pattern), found, lambda gap, value: size(gap) + size(value))
        return F.zip_with(found, F.slice(_running(sizes), F.lit(1), F.size(found)), lambda value, end: F.struct(value.alias("value"), end.alias("end")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _span(found: Column, rank: int, kind: str, value: Column) -> Column:
    start = found["end"] - F.length(found["value"])
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), found["end"].alias("end"), value.alias("value"))


def _placed(text: Column, pattern: str, rank: int, kind: str, valid) -> Column:
    """Valid matches of a pattern as spans."""
    return F.transform(F.filter(_located(text, pattern), lambda x: valid(x["value"])), lambda x: _span(x, rank, kind, x["value"]))


def base_spans(text: Column) -> Column:
    """Spans of the four kinds by start, then kind. Texts without a digit or an @ skip the patterns."""
    empty = F.from_json(F.lit("[]"), _SPANS)
    parts = [
        F.when(text.rlike(test), _placed(text, _PATTERNS[kind], rank, kind, lambda v, k=kind: _valid(k, v))).otherwise(empty)
        for rank, (kind, test) in enumerate({"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){13}", "phone": "\\+[0-9]"}.items())
    ]
    return F.sort_array(F.concat(*parts))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _words(text: Column, spans: Column) -> Column:
    """The words of a text without its spans, cut from their first letter or digit to their last."""
    return F.regexp_extract_all(_blanked(text, spans), F.lit(_WORD), F.lit(0))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with blanks for its spans, so that what touches a value is a word of its own; places stay. Works by pieces."""
    size = F.lit(1 << 12)

    def piece(b):
        low = b * size
        inside = F.filter(spans, lambda x: (x["start"] < low + size) & (x["end"] > low))

        def cover(t, x):
            start, end = F.greatest(x["start"], low), F.least(x["end"], low + size)
            return F.overlay(t, F.repeat(F.lit(" "), end - start), start - low + 1, end - start)

        return F.aggregate(inside, F.substring(text, low + 1, size), cover)

    last = F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / size).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), last), piece), "")


def _occurrences(text: Column, spans: Column, terms: Column) -> Column:
    """Spans of every place at which a text has one of the terms outside its spans."""
    told = F.filter(_located(_blanked(text, spans), _WORD), lambda x: F.array_contains(terms, F.lower(x["value"])))
    return F.transform(told, lambda x: _span(x, len(KINDS), TERM, F.lit("")))


def _entities(spans: Column) -> Column:
    """What a word can disclose: values in lower case, and the parts they share with other values.

    Parts are the local part and the domain of an address, the first three numbers of an IP, the first
    six digits of a card and of a phone number. They pool values that are met once or twice.
    """

    def parts(x):
        value, digits = F.lower(x["value"]), F.regexp_replace(x["value"], "[^0-9]", "")
        two = F.when(x["kind"] == "email", F.array(F.concat(F.substring_index(value, "@", 1), F.lit("@")), F.concat(F.lit("@"), F.substring_index(value, "@", -1))))
        one = F.when(x["kind"] == "ip", F.concat(F.substring_index(value, ".", 3), F.lit("."))).otherwise(F.concat(x["kind"], F.lit(" "), F.substring(digits, 1, 6)))
        return F.concat(F.array(value), F.coalesce(two, F.array(one)))

    return F.array_distinct(F.flatten(F.transform(spans, parts)))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(_BUCKETS))


def _maybe_one_of(terms: DataFrame) -> Column:
    """Whether column `term` may be one of some terms: a filter of fixed size, true for every one of them."""
    place = _bucket(F.col("term")) + 1  # maps number their places from 1
    maps = terms.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    flags = np.zeros(_BUCKETS, np.uint8)
    for r in maps.collect():
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        flags[(r["part"] - 1) * len(bits) : r["part"] * len(bits)] = bits
    return F.substring(F.lit(flags.tobytes()), place.cast("int"), F.lit(1)) == F.lit(b"\x01")


def telling_terms(some: DataFrame, docs: DataFrame, text_col: str, min_support: int, share: float, confidence: float = 1.2816) -> DataFrame:
    """row, terms: the words that reveal more than `share` of an entity, for each row that holds both.

    `some` has row, base and text of the rows with values. Counts are rows of the whole corpus, and every
    word of a row counts as found with every entity of it, values of one row too. Of the other rows that hold
    a word, p hold the entity. The word discloses it when log2(p * rows / rows with the entity) exceeds `share`
    of the entity's information, and the lower bound of p (Wilson's, at `confidence` standard deviations: 90 %)
    is a half at least. That takes three rows with both, more if the word is found elsewhere; values that are
    met once or twice are disclosed by their parts.
    """
    words = F.array_distinct(F.transform(_words(F.col("text"), F.col("base")), F.lower))
    held = kept(some.select("row", _entities(F.col("base")).alias("entities"), words.alias("terms")), "personal-words")
    total = float(max(1, docs.count()))
    owners = held.select("row", F.explode("entities").alias("entity"))
    holding = kept(owners.groupBy("entity").agg(F.count("*").alias("with_entity")), "entity-counts")
    most = float(holding.agg(F.max("with_entity")).first()[0] or 1)
    each = held.select("row", F.explode("terms").alias("term"))
    # A lower bound of a half asks for p of a half at least, and p is at most (both - 1) / (with_term - 1).
    # Neither count of a pair exceeds the rows with values that hold the word, so most words need no pairs.
    least = each.groupBy("term").agg(F.count("*").alias("least")).filter((F.col("least") > 1) & (F.col("least") - 1 <= 2 * (most - 1)))
    least = kept(least, "repeated-words")
    # How many rows without values hold a word is counted for those words alone.
    text = whole(text_col)
    others = docs.filter(F.size(base_spans(text)) == 0).select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower))).alias("term"))
    elsewhere = others.filter(_maybe_one_of(least)).groupBy("term").agg(F.count("*").alias("elsewhere"))
    counted = least.join(elsewhere, "term", "left").withColumn("with_term", F.col("least") + F.coalesce("elsewhere", F.lit(0)))
    counted = kept(counted.filter(2 * (F.col("least") - 1) >= F.col("with_term") - 1).select("term", "least", "with_term"), "concentrated-words")
    rare = kept(each.join(counted, "term"), "concentrated-rows")
    owners = kept(owners.join(holding, "entity"), "entity-rows")
    pairs = rare.join(owners, "row").filter(2 * (F.least("least", "with_entity") - 1) >= F.col("with_term") - 1)
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("with_entity").alias("with_entity"), F.first("with_term").alias("with_term"))
    n, z = F.col("with_term") - 1, confidence
    p = (F.col("both") - 1) / n
    lower = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    information = F.log2(F.lit(total) / F.col("with_entity"))
    mutual = F.log2(F.lit(total) * p / F.col("with_entity"))
    seen = together.filter((F.col("both") > 1) & (F.col("both") >= min_support))
    telling = kept(seen.filter((lower >= 0.5) & (information > 0) & (mutual > share * information)).select("entity", "term"), "telling-terms")
    told = rare.select("row", "term").join(telling, "term").join(owners.select("row", "entity"), ["row", "entity"], "left_semi")
    out = kept(told.groupBy("row").agg(F.collect_set("term").alias("terms")), "told-rows")
    dropped(held, holding, least, counted, rare, owners, telling)
    return out


def _all_spans(text: Column, base: Column, terms: Column) -> Column:
    """Base spans and those of the telling terms, in order."""
    return F.when(terms.isNull(), base).otherwise(F.sort_array(F.concat(base, _occurrences(text, base, terms))))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = 1, share: float = 0.9) -> DataFrame:
    """id, digest, base, spans: base spans and all spans of every row, each with kind, start and end.

    Null text is empty and has no spans. Repeated rows and ids that stand for several texts each get
    their own spans, null ids included. Empty table: empty.
    """
    based = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("digest", F.xxhash64("text")).withColumn("base", base_spans(F.col("text")))
    found = kept(based.withColumn("text", F.when(F.size("base") > 0, F.col("text"))).withColumn("row", F.monotonically_increasing_id()), "entities")
    some, none = found.filter(F.size("base") > 0), found.filter(F.size("base") == 0)
    terms = telling_terms(some, docs, text_col, min_support, share)
    spans = some.join(terms, "row", "left").select("id", "digest", "base", _all_spans(F.col("text"), F.col("base"), F.col("terms")).alias("spans"))
    return spans.unionByName(none.select("id", "digest", "base", F.col("base").alias("spans")))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and the joined span lists of `find`."""
    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced; overlapping spans become one, named after the first."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        return F.when(
            x["start"] >= s["at"],
            F.struct(x["end"].alias("at"), F.concat(s["out"], gap, F.when(x["kind"] == TERM, F.lit("[REDACTED]")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out")),
        ).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out")))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text) - s["at"])))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = 1, share: float = 0.9) -> DataFrame:
    """The same rows and columns with personal data generalised and telling words removed.

    Rows without any stay as they are, null text too. Columns named __base, __row or __terms are reserved.
    """
    named = docs.withColumn("__base", base_spans(whole(text_col)))
    some = kept(named.filter(F.size("__base") > 0).withColumn("__row", F.monotonically_increasing_id()), "personal-rows")
    terms = telling_terms(some.select(F.col("__row").alias("row"), F.col("__base").alias("base"), whole(text_col).alias("text")), docs, text_col, min_support, share)
    joined = some.join(terms.select(F.col("row").alias("__row"), F.col("terms").alias("__terms")), "__row", "left")
    changed = joined.withColumn(text_col, _replaced(F.col(text_col), _all_spans(F.col(text_col), F.col("__base"), F.col("__terms")))).select(*docs.columns)
    return named.filter(F.size("__base") == 0).select(*docs.columns).unionByName(changed)
