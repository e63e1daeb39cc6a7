import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stampmill.llm import periods as P
from stampmill.llm.queries import QUERIES
from stampmill.llm.tables import table


def brute(words, least=12):
    """Every maximal stretch with its smallest period, by trying all periods."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e - s + q >= max(least, 2 * q):
                best.setdefault((s, e - s + q), q)
            s = e + 1
    return sorted((s, k, q) for (s, k), q in best.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=4), st.sampled_from([2, 12]))
def test_against_all_periods(texts, least):
    texts = [[w.encode() for w in t] for t in texts]
    assert [[tuple(r) for r in found.tolist()] for found in P.runs_of(texts, least)] == [[(s, k, q) for s, k, q in sorted(brute(t, least), key=lambda r: (r[0], r[2]))] for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_built_texts(seed):
    """Repeated units, Fibonacci words and breaks between progressions."""
    rng = random.Random(seed)
    a, b = "a", "ab"
    for _ in range(9):
        a, b = b, b + a
    texts = [list(b), list("abababa" * 20), list("ab" * 30 + "a" + "ab" * 30), ["x"] * 200, list("abcab" * 3 + "q" + "abcab" * 12)]
    for _ in range(20):
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 40))]
        text = [rng.choice("abcd") for _ in range(rng.randrange(30))] + unit * rng.randrange(1, 6) + unit[: rng.randrange(len(unit))]
        texts.append(text + [rng.choice("ab") for _ in range(rng.randrange(30))])
    texts = [[w.encode() for w in t] for t in texts]
    assert [[tuple(r) for r in f.tolist()] for f in P.runs_of(texts)] == [sorted(brute(t), key=lambda r: (r[0], r[2])) for t in texts]


def test_overlapping_runs_drop_words():
    words = [w.encode() for w in "a b a b a b a b a b a b c a b a b a b a b a b a b c".split()]
    (runs,) = P.runs_of([words])
    kept = [not any(s + q <= i < s + k for s, k, q in runs.tolist()) for i in range(len(words))]
    assert P.collapsed(words, runs) == [w for w, k in zip(words, kept) if k]


def test_odd_rows(spark, docs_of, empty_docs):
    tail = " ".join(["la"] * 40)
    pairs = [(1, None), (2, ""), (3, " \n\t"), (None, tail), (None, None), (4, tail), (4, tail), (5, "x " * 30000 + "y"), (6, " ".join(map(str, range(40000))))]
    got = {(r["id"], r["n_words"]): r for r in P.periodic_runs(docs_of(pairs)).collect()}
    assert len(P.periodic_runs(docs_of(pairs)).collect()) == len(pairs)
    assert got[1, 0]["runs"] == [] and got[1, 0]["kept_words"] == "" and got[6, 40000]["runs"] == []
    assert [tuple(r) for r in got[5, 30001]["runs"]] == [(0, 30000, 1)] and got[5, 30001]["kept_words"] == "x y"
    assert [tuple(r) for r in got[None, 40]["runs"]] == [(0, 40, 1)]
    assert P.digest(P.periodic_runs(empty_docs)).collect() == []


def test_query(spark, sf):
    got = sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, sf).collect()))
    docs, want = table(spark, sf, "documents"), []
    for r in docs.select("doc_id", "text").collect():
        words = (r["text"] or "").encode().split()
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = sorted(brute(words), key=lambda x: (x[0], x[2]))
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs)]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        one = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want.append((r["doc_id"], len(runs), *one, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()), sha(b" ".join(kept))))
    assert got == sorted(want)
