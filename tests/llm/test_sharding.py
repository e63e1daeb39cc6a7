"""The laws of the shards, with hot texts and ids."""

import zlib

import pytest

from stampmill.llm.sharding import shard
from stampmill.llm.tables import table


def pairs_of(rows):
    return sorted((r["shard"], r["slot"]) for r in rows)


def gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    return all(sorted(s) == list(range(len(s))) for s in by.values())


def test_bytes_near_equal(spark, sf):
    rows = shard(table(spark, sf, "documents"), 8).collect()
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    largest = max(r["size"] for r in rows)
    assert gapless(rows) and max(sizes) - min(sizes) <= 2 * largest
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, sf, "documents").collect()}
    assert all(r["size"] == len(texts[r["id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["id"]]) for r in rows)


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_hot_text(docs_of, law):
    rows = shard(docs_of([(None, "same")] * 900 + [(5, None), (5, "")] * 50), 8, law).collect()
    counts = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert len(rows) == 1000 and gapless(rows)
    if law == "rows":
        assert max(counts) - min(counts) <= 1


def test_equal_texts_are_neighbours(docs_of):
    rows = shard(docs_of([(i, f"text {i % 10}") for i in range(200)]), 4, "rows").collect()
    shards = {}
    for r in rows:
        shards.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 3


def test_empty_table(empty_docs):
    assert shard(empty_docs).count() == 0


def test_unknown_law(empty_docs):
    with pytest.raises(ValueError):
        shard(empty_docs, law="sources")
