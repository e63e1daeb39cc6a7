"""The grammar's parts, and held-out accuracy."""

import random

import pytest

from stampmill.llm import toxicity as T
from stampmill.llm.tables import table


def corpus(n=600):
    rng = random.Random(3)
    plain = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=40)
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["grumpkin", "blatherer", f"zork{rng.choice('abcdefgh')}"]))
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark, docs_of):
    rows, labels = corpus()
    out = T.toxicity(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    unseen = [r for r in out if r["held_out"]]
    assert len(unseen) > 100 and sum(r["predicted"] == truth[r["id"]] for r in unseen) >= 0.97 * len(unseen)


def test_given_tables(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    out = [r for r in T.toxicity(docs, labels).collect() if r["held_out"] and r["id"] in truth]
    clean = [r for r in out if not truth[r["id"]]]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert sum(r["predicted"] == truth[r["id"]] for r in out) >= 0.93 * len(out)


def test_transducers():
    to, factor, threats = T.compose()
    assert to.shape == factor.shape == threats.shape == (32 * len(T._AIMS), 7)
    g = T.Grammar(words={"idiot": 2.0}, stems={"zork": 1.0}, phrase=3.0)
    out = lambda text: g._clause(text)[0]
    assert out("what an idiot") == 2.0 and out("zorkling") == out("zork") == 1.0 and out("zor") == 0.0
    assert out("not an idiot") == 1.0 and out("not a b c idiot") == 2.0
    assert out("he said idiot") == 2.0 * 0.6 * 1.25 and out("you idiot") == 2.5
    assert out("a waste of space") == 3.0 and out("a waste of time and space") == 0.0 and out("waste of waste of space") == 3.0
    assert out("you are not a waste of space") == 3.0 * 1.25 and out("you not waste of space") == 3.0 * 1.25 * 0.5
    assert T.Grammar(words={"idiot": 2.0}, factors=(0.1, 1.0, 1.0, 1.0))._clause("you said not idiot")[0] == pytest.approx(0.2)


def test_threats_are_joined_with_targets():
    threats = lambda text: T.Grammar()._clause(text)[2]
    assert threats("hurt you") == threats("you they hurt") == 1.0 and threats("i will hurt you") == 1.5
    assert threats("it may hurt") == 0.0 and threats("never hurt anybody at all you") == 0.5
    assert threats("kill you and burn them") == 2.0


def test_default_grammar(spark):
    g = T.Grammar()
    toxic, clean = ["you idiot", "what a pathetic loser you are", "I will kill you", "go to hell"], ["", None, "a fine day", "he said it was stupid", "the fire may burn", "you are not stupid"]
    assert (g.score(toxic) >= 0.7).all() and (g.score(clean) < 0.7).all()


def test_factors_are_fitted(spark):
    """A heavy insult that is negated is clean, a light one plain is not: only a stronger factor tells them apart."""
    rows = spark.createDataFrame([(1, "an idiot"), (0, "not grumpkin")] * 60, "toxic int, text string")
    words = {"idiot": 3.0, "grumpkin": 6.0}
    (_, half), (w, quarter) = T._fitted(rows, [T.Grammar(words), T.Grammar(words, factors=(0.25, *T.FACTORS[1:]))])
    assert half < -80 and quarter > -20 and w[1] > 0
    g = T.Grammar(words, coefficients=w, factors=(0.25, *T.FACTORS[1:]))
    assert g.score(["an idiot"])[0] > 0.7 > g.score(["not grumpkin"])[0]


def test_a_factor_moves_only_on_evidence(spark, docs_of):
    rows, labels = corpus()
    assert T.fit(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).factors == T.FACTORS


def test_clauses_are_apart():
    g = T.Grammar(words={"idiot": 2.0})
    assert g.features("not this. idiot") == g.features("idiot")
    assert g.features("idiotic") == [0.0] * 4 and g.features(None) == g.features("") == [0.0] * 4
    assert g.features("Idiot! " * 20000)[2] > 9


def test_odd_rows(spark, docs_of, empty_docs):
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (77, 1)], "doc_id long, toxic int")
    docs = docs_of([(1, "you idiot"), (1, "you idiot"), (2, None), (None, ""), (3, "a " * 100_000)])
    out = T.toxicity(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    left = T.drop_toxic(docs, labels.limit(0))
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 2, 3]
    assert T.toxicity(empty_docs, labels).count() == 0
