"""Similar shingle sets against all pairs."""

import random

import pytest

import corpus_pipeline as C
from stampmill.llm import similar as S
from stampmill.llm.tables import table


def planted(groups=12, edits=(1, 2, 3)):
    """Texts of 120 words and copies with a few words changed, which are several fingerprint bits away."""
    rng = random.Random(5)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows.append((10 * g, " ".join(base)))
        for k, n in enumerate(edits):
            copy = list(base)
            for at in rng.sample(range(120), n):
                copy[at] = f"x{rng.randrange(5000)}"
            rows.append((10 * g + k + 1, " ".join(copy)))
    return rows


def left(rows, size=5, similarity=0.8):
    """Ids that stay, by all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted(least.values())


def test_the_stage_drops_near_copies(spark, docs_of):
    rows = planted() + [(900, None), (901, ""), (902, "two words"), (903, "Two  words"), (904, "x y z")]
    want = left(rows)
    got = C.near_duplicates(spark, docs_of(rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == want and len(want) < 12 * 3 and got.columns == docs_of(rows).columns


@pytest.mark.parametrize("limit", [2, 10**6])
def test_list_limit_changes_nothing(spark, docs_of, limit, monkeypatch):
    rng = random.Random(8)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(80):  # chains of copies: each is edited further away from the first
        if i % 20 == 0:
            now = list(base)
        now[rng.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(now)))
    links = S.links
    monkeypatch.setattr(S, "links", lambda nodes, similarity: links(nodes, similarity, limit))
    assert sorted(r["doc_id"] for r in S.drop_similar(docs_of(rows)).collect()) == left(rows)


def test_empty_table(empty_docs):
    assert S.drop_similar(empty_docs).count() == 0


def test_given_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in C.near_duplicates(spark, docs, sf).collect()) == left(rows)


def test_byte_lists_and_sketches(spark):
    """Sets a shingle apart meet by their fingerprints; sketches let every similar pair pass and few others."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(20)]
    read = S._read([*texts, *(f"{t} end" for t in texts)], 5, 2, 4)
    rows = [(int(a), int(n), int(f), [int(x) for x in k]) for a, n, f, k in zip(read["node"], read["n"], read["fp"], read["sketch"])]
    nodes = spark.createDataFrame(rows, "node long, n int, fp long, sketch array<long>")
    pair = {frozenset((rows[i][0], rows[i + 20][0])) for i in range(20)}
    both = lambda df: {frozenset((r["u"], r["v"])) for r in df.collect()}
    close = {p for p in pair if len({r[2] for r in rows if r[0] in p}) == 1 or bin((lambda a, b: a ^ b)(*(r[2] & (2**64 - 1) for r in rows if r[0] in p))).count("1") <= 2}
    assert close and close <= both(S._fingerprint_pairs(nodes)) <= pair
    every = nodes.selectExpr("node AS u").crossJoin(nodes.selectExpr("node AS v")).where("u < v")
    assert both(S._near(every, nodes, 0.8)) == pair
