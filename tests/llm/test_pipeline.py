"""Every stage of the pipeline against its operator's brute force, each on its own input."""

import sys
from pathlib import Path

import sentencepiece

import corpus_pipeline as C
from stampmill.llm import decontaminate as D
from stampmill.llm import toxicity as T
from stampmill.llm.queries import model_path
from stampmill.llm.tables import kept, table

sys.path.insert(0, str(Path(__file__).parent))
from test_privacy import base  # noqa: E402
from test_similar import left  # noqa: E402


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, inputs, outputs = docs.columns, {}, {}
    for name, stage in C.STAGES:
        inputs[name] = [r.asDict() for r in docs.collect()]
        docs = kept(stage(spark, docs, sf), name)
        outputs[name] = [r.asDict() for r in docs.collect()]
        if name != "tokens":
            assert docs.columns == columns
    ids = lambda rows: sorted(r["doc_id"] for r in rows)

    grammar = T.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    scores = grammar.score([r["text"] for r in inputs["toxicity"]])
    assert ids(outputs["toxicity"]) == sorted(r["doc_id"] for r, s in zip(inputs["toxicity"], scores) if s < 0.7)

    # By all pairs of five-word shingle sets at a similarity of 0.8.
    assert ids(outputs["near_duplicates"]) == left([(r["doc_id"], r["text"]) for r in inputs["near_duplicates"]])

    items = [f" {' '.join(D.words_of(r['text']))} " for r in table(spark, sf, "benchmark").collect()]
    holds = lambda text: any(x in f" {' '.join(D.words_of(text))} " for x in items)
    assert ids(outputs["decontamination"]) == sorted(r["doc_id"] for r in inputs["decontamination"] if not holds(r["text"]))

    before = {r["doc_id"]: r["text"] for r in inputs["privacy"]}
    for r in outputs["privacy"]:
        assert (r["text"] == before[r["doc_id"]]) == (base(before[r["doc_id"]]) == "") and base(r["text"]) == "" and r["n_chars"] == len(r["text"])
    assert ids(outputs["privacy"]) == ids(inputs["privacy"])

    own = sentencepiece.SentencePieceProcessor(model_file=model_path())
    texts = {r["doc_id"]: r["text"] for r in inputs["tokens"]}
    assert all(list(r["ids"]) == own.encode(texts[r["doc_id"]]) for r in outputs["tokens"]) and ids(outputs["tokens"]) == sorted(texts)


def test_clean_documents_stay(spark, tmp_path, sf):
    plain = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "s", 10) for i in range(20)] + [(50, None, None, None, None)]
    spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, sf, name).write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted(r["doc_id"] for r in C.run(spark, str(tmp_path)).collect()) == [*range(20), 50]
