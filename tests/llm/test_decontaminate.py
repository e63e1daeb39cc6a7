"""Leaks against exact containment and planted edits, and recall of the index."""

import random

import numpy as np
import pytest

from stampmill.llm import decontaminate as D
from stampmill.llm.tables import table


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def items(spark):
    return table(spark, "/root/testdata/sf0.001", "benchmark")


def test_distances():
    rng = random.Random(1)
    for _ in range(50):
        a, b = [[rng.randint(1, 4) for _ in range(rng.randint(1, 12))] for _ in range(2)]
        row = D.edit_distances(np.array(a), np.array(b), 50)
        assert row.tolist() == [brute_distance(a, b[:k]) for k in range(len(b) + 1)]


def test_every_exact_leak(spark, sf, items):
    docs = table(spark, sf, "documents")
    got = {(r["id"], r["item"]) for r in D.leaks(docs, items).collect() if r["edits"] == 0}
    texts = {r["doc_id"]: f" {' '.join(D.words_of(r['text']))} " for r in docs.collect()}
    want = {(i, b["item_id"]) for b in items.collect() for i, t in texts.items() if f" {' '.join(D.words_of(b['text']))} " in t}
    assert got == want and want


def test_edited_items_are_found_and_others_left(items):
    rng = random.Random(4)
    index = D.index(items)[0]
    texts, wanted, clean = [], [], []
    vocabulary = sorted(index.vocabulary)
    for m, ids in enumerate(index.items):
        words = [vocabulary[i - 1] for i in ids]
        for _ in range(5):
            w = list(words)
            for _ in range(D.edits_allowed(len(w), 0.8)):
                at, kind = rng.randrange(len(w)), rng.random()
                if kind < 0.5:
                    w[at] = f"new{rng.random()}"
                elif kind < 0.75:
                    del w[at]
                else:
                    w.insert(at, "extra")
            texts.append(" ".join(["before"] * 9 + w + ["after"] * 9))
            wanted.append(m)
        half = list(words)
        half[::2] = ["other"] * len(half[::2])
        clean.append(" ".join(half))
    found = {(t, m) for t, m, *_ in index.search(texts)}
    assert sum((t, m) in found for t, m in enumerate(wanted)) >= 0.95 * len(wanted)
    assert list(index.search(clean)) == []


def test_reported_distance_is_exact(items):
    index = D.index(items)[0]
    words = [sorted(index.vocabulary)[i - 1] for i in index.items[0]]
    text = " ".join(["pre"] * 3 + words[:4] + ["wrong"] + words[5:] + ["post"])
    hits = [h for h in index.search([text]) if h[1] == 0]
    assert hits == [(0, 0, 3, 3 + len(words), 1)]


def test_odd_rows(docs_of, spark, items):
    item = items.first()
    pairs = [(1, None), (2, ""), (3, "... !!!"), (None, item["text"]), (4, item["text"].upper()), (4, item["text"].upper()), (5, "the " * 50_000 + item["text"])]
    rows = D.leaks(docs_of(pairs), items).collect()
    assert sorted(r["id"] or 0 for r in rows if r["item"] == item["item_id"]) == [0, 4, 4, 5]
    left = D.drop_leaks(docs_of(pairs), items)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3] and left.columns == docs_of(pairs).columns
    odd = spark.createDataFrame([(1, None), (2, ""), (3, item["text"]), (4, item["text"]), (5, "one two")], "item_id long, text string")
    assert sorted((r["id"] or 0, r["item"]) for r in D.leaks(docs_of(pairs[3:4] + [(9, "now one two three")]), odd).collect()) == [(0, 3), (0, 4), (9, 5)]


def test_empty_tables(empty_docs, items, docs_of):
    assert D.leaks(empty_docs, items).count() == 0
    assert D.leaks(docs_of([(1, "x")]), items.limit(0)).count() == 0
    assert D.drop_leaks(docs_of([(1, "x")]), items.limit(0)).count() == 1


def test_blocks_share_one_reading(spark, sf, items):
    """Ten thousand items in many blocks give what one block gives, and the corpus is read once."""
    docs = table(spark, sf, "documents")
    rows = [(10_000 + k, " ".join(f"v{(k * 31 + j * 7) % 9973}" for j in range(20))) for k in range(10_000)]
    many = items.select("item_id", "text").union(spark.createDataFrame(rows, "item_id long, text string"))
    hits = lambda df: sorted(map(tuple, df.collect()))
    found = D.leaks(docs, many, block=1500)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert hits(found) == hits(D.leaks(docs, items)) != []
    left = D.drop_leaks(docs, many, block=1500)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(r["doc_id"] for r in D.drop_leaks(docs, items).collect())
