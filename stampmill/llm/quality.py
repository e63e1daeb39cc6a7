"""Quality rules as a short-circuit cascade, ordered by rejections per cost as measured on a sample."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampmill.llm.tables import whole, words


@dataclass(frozen=True)
class Rule:
    """`rejects` is a boolean column over the measures and the text; cheap or dear, it stands alone."""

    name: str
    rejects: Column


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every whole text.

    Null text is empty. Words are runs of other characters than space and \\t..\\r. An empty text has
    zeros throughout. A word counts as repeated when a window of three words that holds it is found
    twice or more; windows are compared by 64-bit hash. Repeated rows give repeated results.
    """
    df = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    df = df.withColumn("w", words(F.col("text"))).withColumn("n_words", F.size("w").cast("long"))
    three = F.when(
        F.size("w") > 2,
        F.transform(
            F.sequence(F.lit(0), F.size("w") - 3),
            lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)),
        ),
    )
    df = df.withColumn("word_chars", F.length(F.array_join("w", "")).cast("long")).withColumn("h", three)
    # Texts without a repeated window are told apart cheaply; the rest sort (hash, place) pairs.
    df = df.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    again = F.filter(
        "sorted",
        lambda x, k: (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"]),
    )
    df = df.withColumn("starts", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("starts", lambda x, k: F.coalesce(F.least(F.lit(3), F.get("starts", k + 1) - x), F.lit(3))),
        F.lit(0),
        lambda total, x: total + x,
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("lines", lines)
    return df.select(
        "id",
        "text",
        "n_words",
        "word_chars",
        F.length(F.regexp_replace("text", "[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules over the columns of `measure`; thresholds follow published web-corpus heuristics."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.length(F.regexp_replace("text", "\\P{L}+", ""))
    capitals = F.length(F.regexp_replace("text", "\\P{Lu}+", ""))
    spelled = F.length(F.regexp_replace("text", "[^|]+", ""))
    return [
        Rule("symbols", F.col("n_symbols") > 0.1 * n),
        Rule("same_lines", (F.col("n_dup_lines") > 0.5 * F.col("n_lines")) & (F.col("n_dup_lines") > 3)),
        Rule("word_length", (F.col("word_chars") < 2.5 * n) | (F.col("word_chars") > 15 * n)),
        Rule("few_letters", letters < 0.6 * F.col("word_chars")),
        Rule("shouting", capitals > 0.7 * F.greatest(letters, F.lit(1))),
        Rule("cells", spelled > 0.2 * n),
    ]


def rule_order(measured: DataFrame, rules: list[Rule], sample_rows: int = 2000) -> list[dict]:
    """Name, seconds, share rejected and rank of each rule, best first, from a bounded sample of rows.

    The sample holds about `sample_rows` rows picked by a hash of the id, spread over all rows. A
    rule's cost is the time of a pass over the sample beyond that of an empty pass. Only the order
    depends on it: a row is kept when no rule rejects it, in any order.
    """
    total = measured.select("id").count()
    part = min(1.0, sample_rows / max(1, total))
    rows = measured.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < int(part * 1_000_000) + 1).persist()
    try:
        size = rows.count()

        def seconds(expression: Column) -> tuple[float, float]:
            start = time.perf_counter()
            hits = rows.agg(F.sum(expression.cast("long"))).first()[0] or 0
            return time.perf_counter() - start, hits

        seconds(F.lit(False))
        empty, _ = seconds(F.lit(False))
        found = []
        for rule in rules:
            took, hits = seconds(rule.rejects)
            cost = max(took - empty, 1e-4)
            found.append({"name": rule.name, "seconds": cost, "rejected": hits / max(1, size), "rank": hits / max(1, size) / cost})
    finally:
        rows.unpersist()
    return sorted(found, key=lambda x: (-x["rank"], x["seconds"]))


def quality(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The measures without the text, base_failed, and kept: the verdict of the ordered cascade.

    The base rules come first, then the others in measured order, each evaluated only where all before
    it let the row pass. An empty table gives an empty result; null ids are ids like any other.
    """
    rules = default_rules() if rules is None else rules
    measured = measure(docs, id_col, text_col)
    by_name = {r.name: r.rejects for r in rules}
    kept = F.when(base_failed(), False)
    for entry in rule_order(measured, rules, sample_rows):
        kept = kept.when(F.coalesce(by_name[entry["name"]], F.lit(False)), False)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", kept.otherwise(True)).drop("text")
