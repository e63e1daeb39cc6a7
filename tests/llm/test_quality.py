"""Measures against plain Python, and the verdict in any order of the rules."""

import re
from collections import Counter

from stampmill.llm import quality as Q


def measure(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(repeated))


PAIRS = [
    (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "a b c a b c a b"), (5, "one\none\n\none \n two#*$%&|<>"), (6, "x " * 3000), (7, "word joined naïve 😀 text"), (7, "word joined naïve 😀 text"),
    (None, " ".join(f"word{k}" for k in range(80))), (9, "| ".join(f"cell{k}" for k in range(100))), (10, " ".join(f"LOUD{k}X" for k in range(100))), (11, "a b a b a b"), (12, " ".join(f"Some{k} plain" for k in range(60))),
]
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def test_measures(docs_of):
    got = Q.measure(docs_of(PAIRS)).collect()
    assert sorted((r["id"] or 0, *(r[c] for c in COLUMNS)) for r in got) == sorted((i or 0, *measure(t)) for i, t in PAIRS)


def test_verdict_is_the_same_in_any_order(docs_of, monkeypatch):
    docs = docs_of(PAIRS)
    first = sorted(map(str, Q.quality(docs).collect()))
    order = Q.rule_order
    monkeypatch.setattr(Q, "rule_order", lambda *a, **k: order(*a, **k)[::-1])
    assert sorted(map(str, Q.quality(docs).collect())) == first


def test_verdicts(docs_of):
    kept = {r["id"]: (r["base_failed"], r["kept"]) for r in Q.quality(docs_of(PAIRS)).collect()}
    assert kept[1] == (True, False) and kept[6] == (True, False)
    assert kept[9] == (False, False) and kept[10] == (False, False)
    assert kept[12] == (False, True) and kept[None] == (False, True)


def test_order_is_by_rejection_per_cost(docs_of):
    found = Q.rule_order(Q.measure(docs_of(PAIRS)), Q.default_rules())
    assert {x["name"] for x in found} == {r.name for r in Q.default_rules()}
    assert [x["rank"] for x in found] == sorted((x["rank"] for x in found), reverse=True)


def test_empty_table(empty_docs):
    assert Q.quality(empty_docs).count() == 0
