"""Fingerprints and links against all pairs."""

import random
import re

import pytest
import xxhash

from stampmill.llm import simhash as S
from stampmill.llm.components import components
from stampmill.llm.tables import table


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def compare(rows, pairs):
    prints = [fingerprint(t) for _, t in pairs]
    roots = linked(prints)
    ids = {}
    for (i, _), r in zip(pairs, roots):
        ids.setdefault(r, []).append(i)
    want = sorted((i is None, i or 0, p, min((x for x in ids[r] if x is not None), default=None) or 0) for (i, _), p, r in zip(pairs, prints, roots))
    assert sorted((r["id"] is None, r["id"] or 0, r["fp"] % (1 << 64), r["component"] or 0) for r in rows) == want


def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    compare(S.near_duplicates(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(docs_of):
    base = "one two three four five six seven eight nine ten eleven twelve".split()
    pairs = [(1, None), (2, ""), (3, " \t\n"), (4, "Word"), (4, "word"), (5, "two words"), (6, "Ünï ÉA b"), (None, "alone here"), (7, "x y z"), (8, "a b c " * 4000)]
    pairs += [(10 + k, " ".join(base * 6 + [str(k)])) for k in range(12)] * 2
    compare(S.near_duplicates(docs_of(pairs)).collect(), pairs)


@pytest.mark.parametrize("limit", [2, 10**6])
def test_list_limit_changes_nothing(spark, limit):
    rng = random.Random(2)
    prints = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(60):
            p = base
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    root = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(S.links(rows, list_limit=limit)).collect()}
    want = linked(prints)
    for i in range(len(prints)):
        for j in range(i):
            assert (want[i] == want[j]) == (root.get(prints[i], prints[i]) == root.get(prints[j], prints[j]))


def test_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[1001] == 1000


def test_one_of_each_class_stays(docs_of):
    text = " ".join(f"w{k % 40}" for k in range(400))
    pairs = [(5, text), (3, text), (3, text), (9, "another text altogether with its own words"), (None, text), (None, None), (11, "")]
    left = S.drop_near_duplicates(docs_of(pairs))
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 9, 11]
    assert left.columns == docs_of(pairs).columns


def test_empty_table(empty_docs):
    assert S.near_duplicates(empty_docs).count() == 0 and S.drop_near_duplicates(empty_docs).count() == 0
