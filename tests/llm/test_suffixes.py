"""Repeated byte strings against counting every string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from stampmill.llm import suffixes as S


def brute(texts, length):
    found = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if found[t[i : i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1 if i + length <= len(t) else 0
        inside = np.cumsum(covered)[: len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], inside.astype(int)])) == 1).sum())
        kept = bytes(b for b, x in zip(t, inside) if not x)
        out.append((len(t), int(inside.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed, n):
    rng = random.Random(seed)
    stock = ["".join(rng.choices("abcdefgé \n", k=rng.randint(20, 200))) for _ in range(6)]

    def text():
        out = ""
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(stock)
            if rng.random() < 0.5:
                a = rng.randint(0, len(x))
                x = x[a : a + rng.randint(0, 90)]
            out += x + "".join(rng.choices("abcdefg", k=rng.randint(0, 30)))
        return out

    return [(i, text()) for i in range(n)] + [
        (900, None), (901, ""), (902, "a" * 300), (903, "ab" * 100), (904, "a" * 39), (905, "a" * 40), (906, "\0" * 100 + "x"), (906, "\0" * 100 + "x"), (None, stock[0]), (None, stock[0]), (907, "é" * 50 + stock[1]),
    ]


@pytest.mark.parametrize(("piece", "segment"), [(1 << 15, 512), (50, 8), (4, 1)])
def test_against_counting(docs_of, piece, segment):
    pairs = passages(3, 100)
    want = sorted((i is None, i or 0, *b) for (i, _), b in zip(pairs, brute([(t or "").encode() for _, t in pairs], 40)))
    got = S.repeats(docs_of(pairs).repartition(5), length=40, piece=piece, segment=segment).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_hot_passage_is_cut_between_pieces(docs_of):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=70))
    pairs = [(i, "".join(rng.choices("abcdefgh ", k=rng.randint(30, 60))) + passage + "".join(rng.choices("abcdefgh ", k=9))) for i in range(120)]
    got = S.repeats(docs_of(pairs).repartition(4), length=40, piece=10, segment=2).collect()
    want = sorted((i, *b) for (i, _), b in zip(pairs, brute([t.encode() for _, t in pairs], 40)))
    assert sorted((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert all(r["n_removed"] >= 70 for r in got)


def test_empty_table(empty_docs):
    assert S.repeats(empty_docs).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choices("ab c", k=5000)).encode()
    whole = S.Anchors(40)([text])[0]
    monkeypatch.setattr(S, "_STEP", 300)
    parts = S.Anchors(40)([text])[0]
    assert (whole[1] == parts[1]).all()


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(5)
    for n in (1, 2, 3, 7):
        streams = []
        for _ in range(n):
            names = sorted(bytes(rng.choices(b"ab", k=6)) for _ in range(rng.randint(0, 30)))
            streams.append((names, [0, *(S._prefix(a, b) for a, b in zip(names, names[1:]))][: len(names)]))
        order, prefixes = S.merge(streams)
        out = [streams[s][0][k] for s, k in order]
        assert out == sorted(x for names, _ in streams for x in names)
        assert prefixes[1:] == [S._prefix(a, b) for a, b in zip(out, out[1:])]


def test_kept_bytes(docs_of):
    pairs = [(1, "x" * 10 + "abcdefghij" * 8), (2, "abcdefghij" * 8 + "y"), (3, None)]
    docs = docs_of(pairs, extra=False)
    got = {r["id"]: bytes(r["kept"]) for r in S.remove_spans(docs, S.repeats(docs, length=40)).collect()}
    assert got == {1: b"x" * 10, 2: b"y", 3: b""}


def test_passages_too_short_to_be_removed(docs_of):
    """Passages of 50 to 120 words in pairs of documents: removed from 400 bytes on, told as shared below that; other documents are left alone."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    words = lambda n: " ".join(word() for _ in range(n))
    rows, size = [], {}
    for k, n in enumerate(range(50, 121, 5)):
        passage = words(n)
        for _ in range(2):
            size[len(rows)] = len(passage)
            rows.append((len(rows), f"{words(rng.randint(0, 80))} {passage} {words(rng.randint(0, 80))}"))
    clean = [(1000 + k, words(150)) for k in range(20)]
    line = words(40)
    clean.append((1100, f"{line}\n{words(20)}\n{line}"))  # repeats itself, shares nothing
    found = {r["id"]: r for r in S.repeats(docs_of(rows + clean), short=256).collect()}
    for key, length in size.items():
        assert found[key]["n_shared"] > 0 and (found[key]["n_removed"] >= length - 2 if length >= 400 else True)
    assert any(found[k]["n_removed"] == 0 for k in size) and all(found[k]["n_shared"] == 0 and found[k]["n_removed"] == 0 for k, _ in clean)
    assert "n_shared" not in S.repeats(docs_of(clean)).columns


def test_shared_places_of_odd_rows(docs_of, empty_docs):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, None), (2, ""), (None, long), (3, long), (3, long), (4, "short")]
    got = {(r["id"], r["n_bytes"]): r["n_shared"] for r in S.repeats(docs_of(rows), short=256).collect()}
    assert got[1, 0] == got[2, 0] == got[4, 5] == 0 and got[None, len(long)] > 0 and got[3, len(long)] > 0
    assert S.repeats(empty_docs, short=256).collect() == []
