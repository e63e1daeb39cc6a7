"""Toxicity by a weighted finite-state grammar over clauses, fitted on labelled rows.

Small transducers read a clause word by word. One reads insults, words and whole phrases, and puts out their
weight; one reads threats and puts out one for each threat that a target joins, before it or after it, more if
somebody means to do it. Targets and threats raise the insults that follow, negation damps the next words and
reported speech the rest of the clause. The modifiers are composed into one table of states and weights, the
phrases into one automaton of words, and both run side by side. Words reach the table as classes: insults
come from a lexicon of words and stems learned from labels, the rest from fixed lists. A text's score is a
logistic function of what its matched clauses put out; the factors of the modifiers are fitted with it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed word lists of the grammar, in four languages.
TARGETS = "you your yours yourself he she they them him her ihr du dich dir euch sie tu toi vous te tú usted ustedes vosotros".split()
NEGATIONS = "not never no none neither nobody cannot isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais aucun nunca jamás tampoco".split()
REPORTS = "said says wrote writes called calls quoted quote reported claims claimed sagte sagt schrieb dit écrit appelle dijo dice escribió".split()
THREATS = "kill hurt destroy beat burn punish töten schlagen tuer frapper matar golpear".split()
INTENTS = "will gonna going i'll we'll want wanna must werde werden will wollen vais allons veux voy vamos quiero".split()
INSULTS = "idiot moron stupid pathetic worthless disgusting loser scum trash".split()
PHRASES = [
    "piece of trash", "waste of space", "good for nothing", "shut your mouth", "shut the hell up", "go to hell", "get out of my sight", "nobody likes you",
    "halt die klappe", "halt dein maul", "geh zur hölle", "ferme ta gueule", "va en enfer", "bon à rien", "cállate la boca", "vete al infierno",
]

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT = range(7)
#: What negation, reported speech, a target and a threat do to what follows, and the other values that fitting tries.
FACTORS = (0.5, 0.6, 1.25, 1.25)
TRIED = ((0.25, 1.0), (0.3, 1.0), (1.0, 2.0), (1.0, 2.0))
_WORD = re.compile(r"[\w']+")
_ENDS = ".!?;\n|"
_STEMS = range(3, 9)


def _negation(state: int, word: int) -> tuple[int, bool]:
    """Marks the three words after a negation."""
    return (3 if word == NEGATION else max(0, state - 1)), state > 0


def _report(state: int, word: int) -> tuple[int, bool]:
    """Marks what follows a word of saying, to the end of the clause."""
    return (1 if word == REPORT else state), state > 0


def _target(state: int, word: int) -> tuple[int, bool]:
    """Marks what follows a word for the person meant."""
    return (1 if word == TARGET else state), state > 0


def _threat(state: int, word: int) -> tuple[int, bool]:
    """Marks what follows a threat."""
    return (1 if word == THREAT else state), state > 0


def _aim(state: int, word: int, damped: bool) -> tuple[int, float]:
    """Joins threats with targets. States: intent seen (1), target seen (2), a threat that waits for one (4, damped 8)."""
    intent, target, waits = state & 1, state & 2, state & 12
    weight = 1.5 if intent else 1.0
    if word == INTENT:
        return state | 1, 0.0
    if word == THREAT:
        return (state, weight * (0.5 if damped else 1.0)) if target else (intent | (8 if damped else 4), 0.0)
    if word == TARGET:
        return intent | 2, weight * {0: 0.0, 4: 1.0, 8: 0.5}[waits]
    return state, 0.0


_AIMS = [s for s in range(16) if s & 12 != 12 and not (s & 2 and s & 12)]


def compose(factors: tuple[float, ...] = FACTORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """next[state, class], factor[state, class] and threats put out[state, class] of all modifiers run side by side."""
    states = list(product(range(4), range(2), range(2), range(2), _AIMS))
    index = {s: i for i, s in enumerate(states)}
    shape = len(states), 7
    to, factor, threats = np.zeros(shape, int), np.ones(shape), np.zeros(shape)
    for s in states:
        for word in range(7):
            moves = [f(x, word) for f, x in zip((_negation, _report, _target, _threat), s)]
            aim, threats[index[s], word] = _aim(s[4], word, moves[0][1])
            to[index[s], word] = index[(*(m[0] for m in moves), aim)]
            factor[index[s], word] = math.prod(f for f, (_, on) in zip(factors, moves) if on)
    return to, factor, threats


def phrase_table(phrases: list[str]) -> tuple[list[dict[str, int]], set[int]]:
    """next[state][word] of an automaton that reads words, and the states at which a phrase ends; a missing word leads to state 0."""
    split = [tuple(_WORD.findall(p)) for p in phrases]
    heads = sorted({p[:k] for p in split for k in range(len(p) + 1)}, key=lambda h: (len(h), h))
    index = {h: i for i, h in enumerate(heads)}
    words = {w for p in split for w in p}
    table = []
    for h in heads:
        row = {}
        for w in words:
            tail = (*h, w)
            while tail and tail not in index:
                tail = tail[1:]
            if tail:
                row[w] = index[tail]
        table.append(row)
    return table, {index[p] for p in split if p}


_CLASSES = {w: c for c, ws in ((INTENT, INTENTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
_NEXT, _ENDED = phrase_table(PHRASES)


@dataclass
class Grammar:
    """The insult lexicon, weights by word and by stem, and the coefficients of the score."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 4.0))
    stems: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: [-4.0, 1.5, 1.0, 1.0, 5.5])
    factors: tuple[float, ...] = FACTORS
    phrase: float = 6.0

    def __post_init__(self):
        self._built = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_built"}

    def __setstate__(self, state):
        self.__dict__.update(state, _built=None)

    def _machines(self):
        if self._built is None:
            scan = ahocorasick.Automaton()
            for w in {*self.words, *self.stems, *THREATS, *(max(_WORD.findall(p), key=len) for p in PHRASES)}:
                scan.add_word(w, w)
            if len(scan):
                scan.make_automaton()
            self._built = scan, *(t.tolist() for t in compose(self.factors))
        return self._built

    def weight(self, word: str) -> float:
        """The heaviest entry that accepts the word: itself, or a stem it begins with or is."""
        best = self.words.get(word, 0.0)
        for k in _STEMS:
            if k <= len(word):
                best = max(best, self.stems.get(word[:k], 0.0))
        return best

    def _clause(self, clause: str) -> tuple[float, int, float]:
        """Weight put out, insults matched, and threats joined with a target."""
        _, to, factor, aimed = self._machines()
        state, place, out, hits, threats = 0, 0, 0.0, 0, 0.0
        for m in _WORD.finditer(clause):
            word = m.group()
            kind = _CLASSES.get(word, OTHER)
            heavy = 0.0 if kind else self.weight(word)
            place = _NEXT[place].get(word, 0)
            if place in _ENDED:  # all of a phrase is one insult, as heavy as its heaviest part
                heavy = max(heavy, self.phrase)
            if heavy:
                out += heavy * factor[state][INSULT]
                hits += 1
            threats += aimed[state][kind]
            state = to[state][INSULT if heavy and not kind else kind]
        return out, hits, threats

    def features(self, text: str | None) -> list[float]:
        """What the matched clauses of a whole text put out: strongest, sum, insults, aimed threats; zeros without any."""
        low = (text or "").lower()
        scan = self._machines()[0]
        if not low or not len(scan):
            return [0.0] * 4
        strongest = total = threats = 0.0
        hits = done = 0
        for last, word in scan.iter(low):
            at = last - len(word) + 1
            if at < done or (at and (low[at - 1].isalnum() or low[at - 1] == "_")):
                continue
            start = max(low.rfind(c, 0, at) for c in _ENDS) + 1
            start = max(start, done)
            stops = [e for e in (low.find(c, last) for c in _ENDS) if e >= 0]
            done = min(stops, default=len(low))
            out, n, threat = self._clause(low[start:done])
            strongest, total, hits, threats = max(strongest, out), total + out, hits + n, threats + threat
        return [math.log1p(strongest), math.log1p(total), math.log1p(hits), math.log1p(threats)]

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([[1.0, *self.features(t)] for t in texts]).reshape(-1, 5)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.coefficients), -30, 30)))


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def _marks(text: str) -> set[str]:
    """A text's words, and stems marked by a trailing star."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:k] + "*" for w in words for k in _STEMS if k <= len(w)}


def _tally(rows: DataFrame, toxic: int, only: set[str] | None) -> Counter:
    """Texts by mark; the rows are the bounded sample, so the tally is bounded too."""

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(_marks(text) if only is None else _marks(text) & only)
        yield pa.RecordBatch.from_pydict({"mark": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    counted = rows.filter(F.col("toxic") == toxic).select("text").mapInArrow(count, "mark string, n long").groupBy("mark").agg(F.sum("n").alias("n"))
    least = 5 if only is None else 1
    return Counter({r["mark"]: r["n"] for r in counted.filter(F.col("n") >= least).collect()})


def _lexicon(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, least_weight: float) -> tuple[dict, dict]:
    """Marks far commoner in toxic texts, and in one of a hundred at least; of a stem and its longer forms the one that covers most texts, the longer on a tie."""
    weight = {m: math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean[m] + 0.5) / (n_clean + 1)) for m, n in toxic.items()}
    strong = sorted((m for m in weight if weight[m] >= least_weight and 100 * toxic[m] >= n_toxic), key=lambda m: (-toxic[m], -len(m.rstrip("*")), m))
    words, stems = {}, {}
    for m in strong:
        bare = m.rstrip("*")
        # Said already by a stem of it, by the word itself, or by a longer form in about as many texts.
        longer = [t for t in (*words, *stems) if t.startswith(bare)]
        if any(bare.startswith(t) for t in stems) or bare in words or any(toxic[m] < 1.5 * max(toxic[t], toxic[t + "*"]) for t in longer):
            continue
        (stems if m != bare else words)[bare] = weight[m]
    return words, stems


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 60) -> tuple[list[float], float]:
    """Coefficients and log likelihood by Newton's method, with a small ridge on all but the intercept; classes weigh by their counts."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return w.tolist(), float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, least_weight: float = 3.0) -> Grammar:
    """The grammar learned from labelled rows that are not held out.

    At most about `max_rows` labelled rows are used, picked by a hash of the id over all of them. Ids
    with several labels take the largest; null labels, and ids without a text, teach nothing. With no
    toxic or no clean row the grammar keeps its fixed insults and default coefficients.
    """
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__label_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    share = min(1.0, max_rows / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64("__label_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = docs.select(F.col(id_col).alias("__label_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "__label_id").select("__label_id", "text", "toxic")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Grammar()
    toxic = _tally(rows, 1, None)
    clean = _tally(rows, 0, set(toxic))
    words, stems = _lexicon(toxic, clean, sizes[1], sizes[0], least_weight)
    words = {**dict.fromkeys(INSULTS, least_weight), **words}
    variants = [FACTORS] + [(*FACTORS[:k], f, *FACTORS[k + 1 :]) for k, tried in enumerate(TRIED) for f in tried]
    fitted = _fitted(rows, [Grammar(words, stems, factors=f, phrase=least_weight) for f in variants])
    # A factor moves only where the labels bear it out by themselves.
    best = list(FACTORS)
    for k in range(len(FACTORS)):
        of = [(fit[1], v[k]) for v, fit in zip(variants, fitted) if v[:k] + v[k + 1 :] == FACTORS[:k] + FACTORS[k + 1 :]]
        likelihood, value = max(of)
        if likelihood > fitted[0][1] + 2:
            best[k] = value
    grammar = Grammar(words, stems, factors=tuple(best), phrase=least_weight)
    found = dict(zip(variants, fitted))
    grammar.coefficients = (found[tuple(best)] if tuple(best) in found else _fitted(rows, [grammar])[0])[0]
    return grammar


def _fitted(rows: DataFrame, grammars: list[Grammar]) -> list[tuple[list[float], float]]:
    """Coefficients and log likelihood of each grammar on the bounded sample, from one reading of its texts."""

    def read(batches):
        for batch in batches:
            first = [grammars[0].features(t) for t in batch.column("text").to_pylist()]
            rest = [[g.features(t) for t in batch.column("text").to_pylist()] if any(map(any, first)) else first for g in grammars[1:]]
            found = [sum(x, []) for x in zip(first, *rest)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])

    # Texts without a match are alike in every grammar, so rows go to the driver as counts of equal ones.
    counted = rows.select("toxic", "text").mapInArrow(read, "toxic int, x array<double>").groupBy("toxic", "x").count().collect()
    seen = sorted((tuple(r["x"]), r["toxic"], r["count"]) for r in counted)
    n = np.array([c for *_, c in seen])
    x = np.repeat(np.array([f for f, *_ in seen]).reshape(len(seen), len(grammars), -1), n, axis=0)
    y = np.repeat(np.array([float(t) for _, t, _ in seen]), n)
    return [_logistic(np.concatenate([np.ones((len(y), 1)), x[:, k]], axis=1), y) for k in range(len(grammars))]


def score_column(grammar: Grammar, text_col: str) -> Column:
    """Scores 0 to 1 of whole texts; null and empty texts score what a text without a match scores."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(grammar.score(text.tolist()))

    return score(F.col(text_col).cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, held_out, score, predicted of every row; repeated rows repeat, an empty table gives an empty result."""
    grammar = fit(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), score_column(grammar, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows below the threshold with their columns as they are."""
    return docs.filter(score_column(fit(docs, labels, id_col, text_col), text_col) < threshold)
