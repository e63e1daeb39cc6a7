import hashlib
import random
from collections import Counter

import pytest

from stampmill.llm import debruijn as D
from stampmill.llm.tables import table


def brute(texts, length):
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        rest = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(rest)).hexdigest()))
    return out


def rows(found):
    return sorted((r["id"] if r["id"] is not None else -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect())


def expected(pairs, length):
    return sorted((i if i is not None else -1, *b) for (i, _), b in zip(pairs, brute([t for _, t in pairs], length)))


@pytest.mark.parametrize("length", [4, 35])
def test_planted(spark, docs_of, length):
    rng = random.Random(length)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(3 * length)]
    texts = [" ".join(word() for _ in range(rng.randrange(120))) for _ in range(30)]
    for k in range(40):  # near copies with an edit, at other places, cut short, and broken lines
        part = passage[rng.randrange(length) : len(passage) - rng.randrange(length)]
        part[rng.randrange(len(part))] = "odd" + str(k % 7)
        texts.append("\n ".join([*(word() for _ in range(k % 5)), *part, *(word() for _ in range(k % 3))]))
    texts += [" ".join(["same"] * (length + 3)), " ".join(["ab", "cd"] * length), " ".join(passage[:length]), " ".join(passage[: length - 1])]
    pairs = list(enumerate(texts))
    found = D.repeats(docs_of(pairs), length=length)
    assert rows(found) == expected(pairs, length)
    kept = {r["id"]: r["kept"] for r in D.without(docs_of(pairs), found).collect()}
    assert all(hashlib.sha256(kept[r["id"]].encode()).hexdigest() == r["kept_sha256"] for r in found.collect())


def test_odd_rows(spark, docs_of, empty_docs):
    long = " ".join(str(i) for i in range(60))
    pairs = [(1, None), (2, ""), (3, " \n"), (4, long), (4, long), (None, long + " x"), (None, None), (5, "a b c"), (6, "x " * 50), (7, " ".join(str(i) for i in range(30)))]
    found = D.repeats(docs_of(pairs))
    assert rows(found) == expected(pairs, 35)
    assert D.repeats(empty_docs).collect() == []


def test_long_text(spark, docs_of, monkeypatch):
    monkeypatch.setattr(D, "_STEP", 256)  # pieces of a text that is longer than a step
    rng = random.Random(3)
    long = [str(rng.randrange(1 << 30)) for _ in range(2000)]
    pairs = [(0, " ".join(long)), (1, " ".join(long[300:1500])), (2, " ".join(long[190:235] + ["x"] + long[700:760]))]
    hashes = [D.Graph(35, 42).hashes(t.encode().split()) for _, t in pairs]
    covered = [sum(c.sum() for c in [s[1]]) for s in D.Graph(35, 42).stretches(hashes)]
    assert covered == [len(h) - 34 for h in hashes]
    assert rows(D.repeats(docs_of(pairs))) == expected(pairs, 35)


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows(D.repeats(docs)) == expected(pairs, 35)
