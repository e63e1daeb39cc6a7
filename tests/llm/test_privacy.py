"""Base spans against Python's patterns, and what the corpus adds."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from stampmill.llm import privacy as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


ODD = [
    (1, "a@b.c%d@e.f x@y 1.2.3.4.5.6 300.1.1.1 +1 (23) 456-78901 4 5 é😀 a@b.co.uk 4111 1111 1111 1111 4111111111111111222222222"),
    (2, None), (3, "9" * 3000 + " " + "a" * 5000), (4, "001.002.3.4 4111-1111-1111-1111 0000000000000.1.1.1"), (5, ""), (5, "x@y.z"), (5, "x@y.z"), (None, "mail é@b.de a@b.de"),
    (6, "+12 345 678 90.. +1 2 +123456789012345678"), (7, "😀😀 10.0.0.1 +49 (30) 1234567"), (8, "a@@b.c @b.c a@b a@b. a@b.c. a@-.-"), (9, "1 - 2 4111  1111 1111 1111"),
]


def test_base_spans(docs_of):
    got = sorted((r["id"] or 0, r["base_sha256"]) for r in P.digest(P.find(docs_of(ODD))).collect())
    assert got == sorted((i or 0, hashlib.sha256(base(t).encode()).hexdigest()) for i, t in ODD)


def corpus():
    shared = [(i, f"line {i} filler{i} write to jane.roe@mail.example at Rosewater or the office number {i * 7}") for i in range(6)]
    return shared + [(100 + i, f"the office at number {i} is or was open to filler{i} and the line") for i in range(60)]


def test_disclosing_words(docs_of):
    found = {r["id"]: r["spans"] for r in P.digest(P.find(docs_of(corpus()))).collect()}
    text = dict(corpus())
    for i in range(6):
        kinds = [s.split(":") for s in found[i].split(",")]
        words = {text[i][int(a) : int(b)] for kind, a, b in kinds if kind == "term"}
        assert "Rosewater" in words and "the" not in words and "office" not in words
        assert [k for k, *_ in kinds if k != "term"] == ["email"]
    assert all(found[i] == "" for i in range(100, 160))


def test_sanitise(docs_of):
    docs = docs_of(corpus() + [(300, None), (301, "call +1 (234) 555-7777 and 4111 1111 1111 1111!"), (301, "call +1 (234) 555-7777 and 4111 1111 1111 1111!")])
    out = P.sanitise(docs)
    texts = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == docs.columns and len(texts) == docs.count()
    by = dict(texts)
    assert by[300] is None and by[301] == "call [PHONE] and [CARD]!" and by[100] == dict(corpus())[100]
    assert "jane" not in by[0] and "[EMAIL]" in by[0] and "Rosewater" not in by[0]


def test_no_python_on_the_way(docs_of):
    plan = P.find(docs_of(ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(empty_docs):
    assert P.find(empty_docs).count() == 0 and P.sanitise(empty_docs).count() == 0


def marked(docs):
    return {r["id"]: {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)} for r in P.digest(P.find(docs)).collect()}


def test_words_anywhere_in_the_text(docs_of):
    line = "Rosewater said it. Mail '{}', 王伟 or one two three four five (Rosewater) and 王伟, six of them"
    rows = [(i, line.format("jane@x.org")) for i in range(6)] + [(100 + i, line.replace("Rosewater", "who").replace("王伟", "who").format("nobody")) for i in range(200)]
    found = marked(docs_of(rows))
    text = rows[0][1]
    words = sorted(text[a:b] for kind, a, b in found[0] if kind == "term")
    assert words == ["Rosewater", "Rosewater", "王伟", "王伟"] and found[100] == set()
    out = {r["doc_id"]: r["text"] for r in P.sanitise(docs_of(rows)).collect()}
    assert "Rosewater" not in out[0] and "王伟" not in out[0] and "'[EMAIL]'," in out[0] and out[100] == rows[6][1]


def test_words_met_once_are_no_evidence(docs_of):
    """A word met once beside a value met once tells nothing, in however many rows."""
    plain = [(100 + i, f"the mail of the office {i % 7} is open to all at night") for i in range(3000)]
    rows = [(1, "the office is open to Rosewater at jane@x.org"), (2, "at night the mail to joe@x.org")]
    assert all({k for k, *_ in spans} <= {"email"} for spans in marked(docs_of(rows + plain)).values())


def test_evidence_decides(docs_of):
    """Of planted telling words nine in ten at least are found, of unrelated rare words nine in ten at least are left."""
    rng = random.Random(11)
    common = [f"word{k}" for k in range(300)]
    rows, telling, unrelated = [], {}, {}
    for e in range(40):  # a value in three to six documents, each with its telling word and rare words of its own
        for k in range(rng.randrange(3, 7)):
            own = [f"rare{e}x{k}x{j}" for j in range(3)]
            words = [*rng.sample(common, 30), f"Name{e}", *own, *(f"odd{rng.randrange(400)}" for _ in range(3))]
            rng.shuffle(words)
            key = len(rows)
            rows.append((key, " ".join([*words[:20], f"person{e}@host{e % 9}.example", *words[20:]])))
            telling[key] = f"Name{e}"
            unrelated[key] = {w for w in words if w != f"Name{e}"}
    rows += [(len(rows) + i, " ".join([*rng.sample(common, 30), *(f"odd{rng.randrange(400)}" for _ in range(3))])) for i in range(800)]
    found, text = marked(docs_of(rows)), dict(rows)
    words = {key: {text[key][a:b] for kind, a, b in found[key] if kind == "term"} for key in telling}
    assert sum(telling[key] in words[key] for key in telling) >= 0.9 * len(telling)
    assert sum(len(unrelated[key] - words[key]) for key in telling) >= 0.9 * sum(map(len, unrelated.values()))
    assert all(not found[key] for key in text if key not in telling)


def test_long_texts(spark, docs_of):
    """Marking takes time in proportion to a text, with many words, many values and many telling words."""
    words = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, f"{words} jane@x.org"), (2, " ".join(f"10.{i % 256}.{i // 256}.7" for i in range(20_000)))]
    P.find(docs_of(rows[:1])).collect()
    began = time.perf_counter()
    spans = {r["id"]: r["spans"] for r in P.digest(P.find(docs_of(rows))).collect()}
    assert spans[1] == base(rows[0][1]) and spans[2] == base(rows[1][1])
    assert time.perf_counter() - began < 30  # the whole job, its tables too; a fold took 60 s for a fifth of this
    told = P._occurrences(F.lit(words), P.base_spans(F.lit(words)), F.array(F.lit("w7"), F.lit("w19999")))
    began = time.perf_counter()
    (row,) = spark.range(1).select(told.alias("s")).collect()
    assert [words[x["start"] : x["end"]] for x in row["s"]] == ["w7", "w19999"] and time.perf_counter() - began < 5


def test_values_pooled_by_their_parts(docs_of):
    plain = [(100 + i, f"the mail of the office {i % 7} is open") for i in range(200)]
    rows = [(i, f"the mail of Rosewater to clerk{i}@rose.example is open") for i in range(6)]
    found = marked(docs_of(rows + plain))
    for i, text in rows:
        assert "Rosewater" in {text[a:b] for kind, a, b in found[i] if kind == "term"}
