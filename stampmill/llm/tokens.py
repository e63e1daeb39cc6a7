"""SentencePiece models on the tokenizers library: the model file is parsed, its normaliser, word marker, scores
and byte fallback are rebuilt, and texts are encoded in batches on several threads.

Unigram models keep their piece scores. Pair-merge models get their merges back from the pieces: every way
to cut a piece into two pieces is a merge, ranked by the score of the whole. The rebuilt tokenizer is held
against the sentencepiece library on a set of probe texts before it is used.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: numbers of piece kinds and model kinds in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, PAIRS = 1, 2
MARK = "▁"

#: Texts that exercise every part: blanks, marks, control words, unknown letters, surrogates, digits, long runs.
PROBES = [
    "", " ", "  two  blanks ", "plain words, and punctuation.", "\ttab\nline\r\n", "<s> </s> <unk> <0x41>", "naïve Ünïcode éèê ñ ß",
    "日本語 текст عربى", "emoji 😀👍🏽 and ‍ joiners", "12345678901234567890", "a" * 200, "x" + " " * 40 + "y", f"{MARK}mark {MARK}{MARK} inside{MARK}", "é ﬁ ﬃ ½ ①", " 　 blanks",
]


def _fields(data: bytes):
    """(number, value) of every field of a protobuf message; nested messages and strings as bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            value = varint()
        elif tag & 7 == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, at = struct.unpack("<f" if size == 4 else "<d", data[at : at + size])[0], at + size
        yield tag >> 3, value


@dataclass
class Model:
    """What a model file says: pieces as (text, score, kind), the kind of model, and the normaliser."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_blanks: bool = True
    escape_blanks: bool = True


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append((piece.get(1, b"").decode("utf-8"), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind, model.byte_fallback, model.suffix_mark = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze_blanks, model.escape_blanks = (bool(spec.get(n, 1)) for n in (3, 4, 5))
    if model.kind not in (UNIGRAM, PAIRS):
        raise ValueError("only unigram and pair-merge models can be rebuilt")
    if model.suffix_mark or not model.escape_blanks:
        raise ValueError("word marks must be escaped blanks in front of words")
    return model


def rebuild(model: Model):
    """The tokenizer that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next(n for n, p in enumerate(model.pieces) if p[2] == UNKNOWN)
    vocabulary = {p[0]: n for n, p in enumerate(model.pieces)}
    if model.kind == UNIGRAM:
        core = models.Unigram([(p[0], p[1]) for p in model.pieces], unknown, model.byte_fallback)
    else:
        usable = {p[0]: p[1] for p in model.pieces if p[2] in (NORMAL, USER_DEFINED)}
        merges = [
            (-score, vocabulary[piece], vocabulary[piece[:cut]], (piece[:cut], piece[cut:]))
            for piece, score in usable.items()
            for cut in range(1, len(piece))
            if piece[:cut] in usable and piece[cut:] in usable
        ]
        core = models.BPE(vocabulary, [m[3] for m in sorted(merges)], unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_blanks:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Replace(" ", MARK)] + ([normalizers.Prepend(MARK)] if model.dummy_prefix else [])
    out.normalizer = normalizers.Sequence(steps)
    # Where no piece reaches over the start of a word, words can be encoded one by one, which is exact and far quicker.
    if not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    undo = [decoders.Replace(MARK, " ")] + ([decoders.ByteFallback()] if model.byte_fallback else []) + [decoders.Fuse()]
    out.decoder = decoders.Sequence(undo + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return out


def differences(tokenizer, data: bytes, texts: list[str]) -> list[str]:
    """The texts that the rebuilt tokenizer and the sentencepiece library encode or decode differently."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    bad = []
    for text in texts:
        ids = own.encode(text)
        if tokenizer.encode(text, add_special_tokens=False).ids != ids or tokenizer.decode(ids, skip_special_tokens=False) != own.decode(ids):
            bad.append(text)
    return bad


@lru_cache(maxsize=2)
def load(path: str, threads: int = 2):
    """The rebuilt tokenizer of a model file, once per worker; refused when a probe text comes out differently."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    with open(path, "rb") as file:
        data = file.read()
    tokenizer = rebuild(parse(data))
    bad = differences(tokenizer, data, PROBES)
    if bad:
        raise ValueError(f"the rebuilt tokenizer differs on {bad[:3]!r}")
    return tokenizer


def _batches(texts: list[str], most: int = 1 << 18):
    """Slices of whole texts with about `most` characters each, so that encodings in memory stay bounded."""
    start = held = 0
    for n, text in enumerate(texts, 1):
        held += len(text)
        if held >= most or n == len(texts):
            yield texts[start:n]
            start, held = n, 0


class Encoder:
    """Encodes batches of texts, each distinct word once, where the model lets words be encoded one by one.

    That holds when no piece reaches over the start of a word and the normaliser changes blanks only; a
    text is then restored by decoding when each of its words is. Words are kept as packed ids up to a
    bound; texts with marks or double blanks of their own go through whole.
    """

    def __init__(self, path: str, threads: int = 2, most: int = 200_000):
        self.whole = load(path, threads)
        with open(path, "rb") as file:
            model = parse(file.read())
        self.most, self.known, self.lossy = most, {}, set()
        self.apart = self.whole.pre_tokenizer is not None and model.dummy_prefix and not model.charsmap and not model.squeeze_blanks
        self.begins = np.array([p[0].startswith(MARK) for p in model.pieces])

    def _learn(self, words: list[str]) -> None:
        """Encodes new words many to a text; a word's ids run from one piece with a mark to the next."""
        for k in range(0, len(words), 4096):
            groups = [words[n : n + 512] for n in range(k, min(k + 4096, len(words)), 512)]
            for group, found in zip(groups, self.whole.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(found.ids, np.int32)
                starts = np.flatnonzero(self.begins[ids]).tolist()
                parts = [ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)])]
                back = self.whole.decode_batch([p.tolist() for p in parts], skip_special_tokens=False)
                self.known.update((w, p.tobytes()) for w, p in zip(group, parts, strict=True))
                self.lossy.update(w for w, b in zip(group, back) if w != b)

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether they decode to it again."""
        split = [t.split(" ") if self.apart and t and MARK not in t and "  " not in t and t[0] != " " and t[-1] != " " else None for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
            self.lossy.clear()
        known = self.known
        self._learn(list({w for words in split if words for w in words if w not in known}))
        odd = [t for t, words in zip(texts, split) if words is None]
        found = [e.ids for e in self.whole.encode_batch_fast(odd, add_special_tokens=False)]
        rest = iter(zip(found, odd, self.whole.decode_batch(found, skip_special_tokens=False)))
        ids, restored = [], []
        for words in split:
            if words is None:
                own, text, back = next(rest)
                ids.append(np.array(own, np.int32))
                restored.append(text == back)
            else:
                ids.append(np.frombuffer(b"".join([known[w] for w in words]), np.int32))
                restored.append(self.lossy.isdisjoint(words))
        return ids, restored


@lru_cache(maxsize=2)
def encoder(path: str, threads: int = 2) -> Encoder:
    return Encoder(path, threads)


def encode(texts: list[str | None], path: str, threads: int = 2) -> list[list[int]]:
    run = encoder(path, threads)
    return [ids.tolist() for part in _batches([t or "" for t in texts]) for ids in run(part)[0]]


def decode(ids: list, path: str, threads: int = 2) -> list[str]:
    return load(path, threads).decode_batch([[] if i is None else list(i) for i in ids], skip_special_tokens=False)


def ids_column(text_col: str, path: str, threads: int = 2) -> Column:
    """Ids of a text column; null and empty texts have none. The model file is read where the task runs."""

    @F.pandas_udf("array<int>")
    def ids(text):
        import pandas as pd

        return pd.Series([np.array(i, np.int32) for i in encode(text.tolist(), path, threads)], dtype=object)

    return ids(F.col(text_col).cast("string"))


def text_column(ids_col: str, path: str, threads: int = 2) -> Column:
    """Texts of an id column; null ids give an empty text."""

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        return pd.Series(decode(ids.tolist(), path, threads))

    return text(F.col(ids_col))


def tokenise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2) -> DataFrame:
    """id, ids, n_tokens, restored: the ids of every whole text, and whether they decode to the text again.

    A text is not restored where the model's normaliser changes it. Null is read as empty, which has no
    ids and is restored; rows that repeat repeat; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        run_on = encoder(path, threads)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            done = 0
            for part in _batches(texts):
                ids, restored = run_on(part)
                lengths = np.array([len(i) for i in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                own = batch.column("id").slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays([own, lists, pa.array(lengths), pa.array(restored, pa.bool_())], ["id", "ids", "n_tokens", "restored"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, ids array<int>, n_tokens long, restored boolean")
