"""Parity with the sentencepiece library, and round trips."""

import struct

import pytest
import sentencepiece

from stampmill.llm import tokens as K
from stampmill.llm.queries import model_path
from stampmill.llm.tables import table

PATH = model_path()


@pytest.fixture(scope="module")
def own():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_documents(spark, sf, own):
    docs = table(spark, sf, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = K.tokenise(docs, PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r["ids"]) == own.encode(texts[r["id"]]) and r["restored"] and r["n_tokens"] == len(r["ids"])


def test_odd_texts(own):
    odd = [*K.PROBES, "a  b", "▁", "a▁b c", " lead", "trail ", "x " * 5000, "ab" * 4000, "\0\x01", "word\nnext\tone"]
    ids = K.encode([*odd, None], PATH)
    assert ids == [own.encode(t) for t in odd] + [[]]
    assert K.decode([*ids, None], PATH) == [own.decode(i) for i in ids] + [""]


def test_words_are_forgotten_at_the_bound(own):
    run = K.Encoder(PATH, most=3)
    for text in ("one two three four", "five six seven", "one two"):
        ids, restored = run([text])
        assert [i.tolist() for i in ids] == [own.encode(text)] and restored == [True]
    assert len(run.known) <= 7


def test_rows(docs_of, empty_docs):
    rows = K.tokenise(docs_of([(1, None), (1, None), (None, ""), (2, "two words")]), PATH).collect()
    assert sorted((r["id"] or 0, r["n_tokens"], r["restored"]) for r in rows)[:3] == [(0, 0, True), (1, 0, True), (1, 0, True)]
    assert K.tokenise(empty_docs, PATH).count() == 0


def test_columns_round_trip(docs_of):
    docs = docs_of([(1, "some text here"), (2, None)])
    out = docs.withColumn("ids", K.ids_column("text", PATH)).withColumn("back", K.text_column("ids", PATH))
    assert sorted(r["back"] for r in out.collect()) == ["", "some text here"]


def _message(*fields):
    """A protobuf message from (number, value): text and bytes, floats and ints."""
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
            continue
        tag, body = (0, value) if isinstance(value, int) else (2, value.encode() if isinstance(value, str) else value)
        for n in (number << 3 | tag, body if tag == 0 else len(body)):
            while True:
                out += bytes([n & 127 | (128 if n > 127 else 0)])
                n >>= 7
                if not n:
                    break
        out += body if tag else b""
    return out


def unigram():
    pieces = [("<unk>", 0.0, K.UNKNOWN), ("<s>", 0.0, K.CONTROL), ("</s>", 0.0, K.CONTROL)]
    pieces += [(f"<0x{n:02X}>", -20.0, K.BYTE) for n in range(256)]
    pieces += [("▁", -3.0, 1), ("▁the", -2.0, 1), ("the", -3.5, 1), ("m", -5.0, 1), ("e", -4.0, 1), ("me", -4.2, 1), ("▁theme", -4.5, 1), ("s", -4.0, 1), ("t", -4.0, 1), ("h", -4.5, 1), ("hem", -6.0, 1)]
    return _message(*[(1, _message((1, p), (2, s), (3, k))) for p, s, k in pieces], (2, _message((3, K.UNIGRAM), (35, 1))), (3, _message((1, "identity"), (3, 1), (4, 1), (5, 1))))


def test_unigram_scores_and_byte_fallback():
    data = unigram()
    model = K.parse(data)
    assert model.kind == K.UNIGRAM and model.byte_fallback and model.squeeze_blanks
    texts = ["the theme", "  themes  them ", "me ü the", "", "thethe"]
    assert K.differences(K.rebuild(model), data, texts) == []


def test_word_models_are_refused():
    with pytest.raises(ValueError):
        K.parse(_message((2, _message((3, 3)))))
