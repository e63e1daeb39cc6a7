"""Benchmark leaks by edit distance: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

Texts and items are sequences of words. The CGK random walk reads a sequence with repetitions chosen by
shared random bits, so that few edits become few differing symbols at equal steps; each repetition of
the LSH samples some steps and keys a window by the symbols found there. Windows and items that share a
key in any repetition are compared by exact edit distance over words.

Only windows that can hold an item are embedded: within k edits an item of n words keeps at least
n - q + 1 - k*q of its q-word runs, and a window without that many runs of any item is passed over. This
bound loses nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TRIM = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "“”‘’«»…–—¿¡"


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without the punctuation around them; what is punctuation only falls out."""
    return [w for w in (x.strip(_TRIM) for x in (text or "").lower().split()) if w]


def edits_allowed(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray | None:
    """Word edits between all of `a` and every beginning of `b`, or None once all exceed `most`."""
    before = np.arange(len(b) + 1)
    place = np.arange(len(b) + 1)
    for i, x in enumerate(a.tolist(), 1):
        now = np.empty_like(before)
        now[0] = i
        now[1:] = np.minimum(before[1:] + 1, before[:-1] + (b != x))
        # Insertions run along the row: a running minimum of (value - place).
        before = np.minimum.accumulate(now - place) + place
        if before.min() > most:
            return None
    return before


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Ids(dict):
    """Ids of raw words, found once each: 0 for a word no item has, -1 for punctuation only."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        word = raw.strip(_TRIM)
        self[raw] = found = self.vocabulary.get(word, 0) if word else -1
        return found


@dataclass
class Index:
    """Items as ids, their q-word runs, and the LSH tables over their embeddings."""

    item_ids: list
    vocabulary: dict[str, int]
    items: list[np.ndarray]
    similarity: float
    repeats: int
    samples: int
    run: int = 3

    def __post_init__(self):
        self.edits = np.array([edits_allowed(len(i), self.similarity) for i in self.items], np.int64)
        self.lengths = np.array([len(i) for i in self.items], np.int64)
        # Every run of an item, and the lengths of the items that hold it as bits.
        widths = sorted(set(self.lengths.tolist()))
        own = {n: np.unique(np.concatenate([self._runs(i) for i in self.items if len(i) == n])) for n in widths}
        self.runs = np.unique(np.concatenate([*own.values(), np.zeros(0, np.uint64)]))
        self.of_width = {n: np.isin(self.runs, own[n]) for n in widths}
        # Runs that every window within reach of an item of some length must hold; short items need no run.
        self.needed = {}
        for n, k in zip(self.lengths.tolist(), self.edits.tolist()):
            self.needed[n] = max(0, n - self.run + 1 - k * self.run)
        rng = np.random.default_rng(20240229)
        self.steps = np.sort(rng.random((self.repeats, self.samples)), axis=1)
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        for n in sorted(set(self.lengths.tolist())):
            members = np.flatnonzero(self.lengths == n)
            keys = self.keys(np.stack([self.items[m] for m in members]), n)
            tables = []
            for r in range(self.repeats):
                table: dict[int, list[int]] = {}
                for m, key in zip(members.tolist(), keys[:, r].tolist()):
                    table.setdefault(key, []).append(m)
                tables.append(table)
            self.tables[n] = tables

    def _runs(self, ids: np.ndarray) -> np.ndarray:
        """Hashes of all runs of `run` known words; a run with an unknown word is zero."""
        if len(ids) < self.run:
            return np.zeros(0, np.uint64)
        wide = np.lib.stride_tricks.sliding_window_view(ids.astype(np.uint64), self.run)
        h = np.zeros(len(wide), np.uint64)
        for j in range(self.run):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + wide[:, j])
        return np.where((wide > 0).all(1), h | np.uint64(1), np.uint64(0))

    def keys(self, windows: np.ndarray, n: int) -> np.ndarray:
        """[window, repeat] keys of windows that are n words wide: symbols at the sampled steps of each walk.

        Sampled steps lie below 2n, where the walk is expected to end; past the window it reads a symbol of its own.
        """
        count, width = windows.shape
        padded = np.concatenate([windows.astype(np.uint64), np.full((count, 1), (1 << 62) + 1, np.uint64)], axis=1)
        wanted = (self.steps * 2 * n).astype(int)
        at = np.zeros((count, self.repeats), np.int64)
        key = np.zeros((count, self.repeats), np.uint64)
        row = np.arange(count)[:, None]
        salt = np.arange(self.repeats).astype(np.uint64)
        for step in range(int(wanted.max()) + 1):
            symbol = padded[row, np.minimum(at, width)]
            for r in np.flatnonzero((wanted == step).any(axis=1)):
                key[:, r] = _mix(key[:, r] * np.uint64(0x9E3779B97F4A7C15) + symbol[:, r] + np.uint64(step))
            move = (symbol + salt + np.uint64(step * 8191)) * np.uint64(0xD6E8FEB86659FD93)
            at += ((move ^ (move >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(np.int64)
        return key

    def places_of_runs(self, ids: np.ndarray) -> np.ndarray:
        """For each place, which of the items' runs begins there, or -1."""
        runs = self._runs(ids)
        if not len(self.runs) or not len(runs):
            return np.full(len(runs), -1)
        place = np.minimum(np.searchsorted(self.runs, runs), len(self.runs) - 1)
        return np.where((self.runs[place] == runs) & (runs > 0), place, -1)

    def search(self, texts: list[str | None]):
        """(place of the text, item, first word, last word + 1, edits) of every item found in every text."""
        if not self.items:
            return
        known = _Ids(self.vocabulary)
        held, size = [], 0
        for t, text in enumerate(texts):
            ids = np.array([known[w] for w in (text or "").lower().split()], np.int64)
            ids = ids[ids >= 0]
            if len(ids):
                held.append((t, ids))
                size += len(ids)
            if size > 1 << 19 or (t + 1 == len(texts) and held):
                yield from self._search(held)
                held, size = [], 0

    def _search(self, held: list[tuple[int, np.ndarray]]):
        """Hits in some texts at once. Texts are apart by words that no item has."""
        gap = np.zeros(self.run, np.int64)
        which = self.places_of_runs(np.concatenate([x for _, ids in held for x in (ids, gap)]))
        below = np.concatenate([[0], np.cumsum(which >= 0)])
        least, widest = min(self.needed.values()), max(n + edits_allowed(n, self.similarity) for n in self.needed)
        dense = below[np.minimum(np.arange(len(below)) + widest, len(below) - 1)] - below
        windows: dict[int, list[tuple[int, np.ndarray]]] = {}
        texts, at = dict(held), 0
        for t, ids in held:
            here = slice(at, at + max(1, len(ids) - self.run + 1))
            at += len(ids) + self.run
            peak = int(dense[here].max())
            if peak >= least:
                for n, starts in self._starts(which[here], len(ids), peak):
                    windows.setdefault(n, []).append((t, starts))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, found in windows.items():
            for (t, m), starts in self._candidates(n, found, texts).items():
                hit = self._closest(texts[t], sorted(starts), m, edits_allowed(n, self.similarity))
                if hit:
                    best[t, m] = hit
        for (t, m), hit in sorted(best.items()):
            yield (t, m, *hit)

    def _starts(self, which: np.ndarray, words: int, peak: int):
        """Beginnings of windows that hold enough runs of the items of one length, for every length."""
        here = np.flatnonzero(which >= 0)
        for n, needed in self.needed.items():
            if needed > peak:
                continue
            most = edits_allowed(n, self.similarity)
            # A leaked item may have lost words, so its window may reach past the end of the text.
            starts = np.arange(max(1, min(words, words - n + 1 + most)))
            if needed:
                own = here[self.of_width[n][which[here]]]
                if len(own) < needed:
                    continue
                count = np.searchsorted(own, starts + n + most - self.run, side="right") - np.searchsorted(own, starts)
                starts = starts[count >= needed]
            if len(starts):
                yield n, starts

    def _candidates(self, n: int, found: list[tuple[int, np.ndarray]], texts: dict[int, np.ndarray]) -> dict[tuple[int, int], set[int]]:
        """Beginnings of windows that share a key with an item, by text and item; equal windows of a text count once."""
        out: dict[tuple[int, int], set[int]] = {}
        rows, owner, begin = [], [], []
        for t, starts in found:
            padded = np.concatenate([texts[t], np.zeros(n, np.int64)])
            wide, first = np.unique(np.lib.stride_tricks.sliding_window_view(padded, n)[starts], axis=0, return_index=True)
            rows.append(wide)
            owner += [t] * len(first)
            begin += starts[first].tolist()
        rows = np.concatenate(rows)
        for k in range(0, len(rows), 8192):
            keys = self.keys(rows[k : k + 8192], n)
            for r, table in enumerate(self.tables[n]):
                for j, key in enumerate(keys[:, r].tolist(), k):
                    for m in table.get(key, ()):
                        out.setdefault((owner[j], m), set()).add(begin[j])
        return out

    def _closest(self, ids: np.ndarray, starts: list[int], m: int, most: int) -> tuple[int, int, int] | None:
        """The window with the fewest edits among those that begin at `starts`; unedited ones need no table."""
        item, n, best = self.items[m], int(self.lengths[m]), None
        for start in starts:
            if np.array_equal(ids[start : start + n], item):
                return start, start + n, 0
        for start in starts:
            row = edit_distances(item, ids[start : start + n + most], most)
            if row is not None and int(row.min()) <= most and (best is None or int(row.min()) < best[2]):
                best = (start, start + int(row.argmin()), int(row.min()))
        return best


def index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", similarity: float = 0.8, repeats: int = 24, samples: int = 2, block: int = 20_000) -> list[Index]:
    """LSH indexes over the items, in blocks of at most `block` items that share a vocabulary.

    Null and empty items have no words and match nothing; items of equal text are all reported.
    """
    rows = benchmark.select(id_col, F.col(text_col).cast("string").alias("text"))
    found = sorted(((r[0], words_of(r[1])) for r in rows.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    found = [(i, w) for i, w in found if w]
    blocks = []
    for k in range(0, len(found), block):
        part = found[k : k + block]
        vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in part for w in ws}), 1)}
        items = [np.array([vocabulary[w] for w in ws], np.int64) for _, ws in part]
        blocks.append(Index([i for i, _ in part], vocabulary, items, similarity, repeats, samples))
    return blocks


def _passes(blocks: list[Index]) -> list[list[Index]]:
    """Blocks that go out together, so that tasks hold a bounded number of items: one reading of the corpus for each ten blocks."""
    return [blocks[k : k + 10] for k in range(0, len(blocks), 10)]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", similarity: float = 0.8, block: int = 20_000) -> DataFrame:
    """id, item, first_word, end_word, edits, item_words: each item found in each row, at its closest window.

    Found means at most (1 - similarity) of the item's words edited. Null and empty texts hold nothing,
    repeated rows are reported each, and an empty table or benchmark gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("item", benchmark.schema[item_col].dataType),
        T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("item_words", T.LongType()),
    ])
    found = None
    for together in _passes(index(benchmark, item_col, similarity=similarity, block=block)):

        def search(batches, together=together):
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for one in together:
                    hits = list(one.search(texts))
                    at, items, *rest = list(zip(*hits)) or [[]] * 5
                    sizes = [len(one.items[m]) for m in items]
                    columns = [batch.column("id").take(pa.array(at, pa.int64())), pa.array([one.item_ids[m] for m in items], None if hits else pa.int64())]
                    columns += [pa.array(c, pa.int64()) for c in (*rest, sizes)]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

        part = rows.mapInArrow(search, schema)
        found = part if found is None else found.union(part)
    return found if found is not None else rows.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", similarity: float = 0.8, block: int = 20_000) -> DataFrame:
    """The rows that hold no item, with their columns as they are."""
    for together in _passes(index(benchmark, item_col, similarity=similarity, block=block)):

        @F.pandas_udf("boolean")
        def clean(text, together=together):
            texts = text.tolist()
            hold = {hit[0] for one in together for hit in one.search(texts)}
            return pd.Series([n not in hold for n in range(len(texts))], dtype=bool)

        docs = docs.filter(clean(F.col(text_col).cast("string")))
    return docs
