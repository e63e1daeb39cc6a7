"""Licence notices in texts against sliding every window."""

import re

from stampmill.llm import licences as L


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(w, k=5):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else [])


MIT, APACHE = L.TEMPLATES["MIT-text"], L.TEMPLATES["Apache-2.0"]
PAIRS = [
    (1, f"Some words first. {APACHE}\nAnd more words after the notice."), (2, MIT.upper()), (3, MIT.replace("without restriction, including", "with no limit and also")), (4, " ".join(words(MIT)[: len(words(MIT)) // 2])),
    (5, None), (6, ""), (7, "nothing of the kind " * 500 + L.TEMPLATES["GPL-3.0-header"] + " tail" * 300), (7, "nothing of the kind " * 500 + L.TEMPLATES["GPL-3.0-header"] + " tail" * 300), (None, L.TEMPLATES["MIT"]), (9, "Released under the"), (10, f"{APACHE} {APACHE}"),
]


def expected():
    out = []
    for i, text in PAIRS:
        s = shingles(words(text))
        for name, notice in L.TEMPLATES.items():
            t = set(shingles(words(notice)))
            width = len(t) + max(1, len(t) // 4)
            if any(len(t & set(s[k : k + width])) >= 0.8 * len(t) for k in range(len(s))):
                out.append((i or 0, name))
    return sorted(out)


def test_against_every_window(docs_of):
    rows = L.scan(docs_of(PAIRS)).collect()
    assert sorted((r["id"] or 0, r["licence"]) for r in rows) == expected()
    assert all(r["containment"] >= 0.8 for r in rows)


def test_bands_reach_the_asked_probability():
    for containment, overlap in ((0.8, 1.25), (0.8, 2.5), (0.9, 4.0)):
        bands = L.bands_for(containment, overlap, 0.999)
        similarity = containment / (1 + overlap - containment)
        assert 1 - (1 - similarity) ** bands >= 0.999


def test_no_python_on_the_way(docs_of):
    plan = L.scan(docs_of(PAIRS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(empty_docs):
    assert L.scan(empty_docs).count() == 0


def test_every_template_is_found(docs_of):
    """Bodies and notices among other words, with a name put in and line ends moved."""
    names = sorted(L.TEMPLATES)
    assert {"LGPL-2.1", "BSD-2-Clause-body", "EPL-2.0", "BSL-1.0-body", "Zlib-body", "MIT-body"} <= set(names)
    filler = " ".join(f"other{k}" for k in range(300))
    rows = [(k, f"{filler} Copyright 2020 Somebody\n" + L.TEMPLATES[n].replace(". ", ".\n   ") + f" {filler}") for k, n in enumerate(names)]
    rows += [(1000, filler), (1001, "Distributed under the MIT License"), (1002, "licensed under cc by 4.0 and more")]
    found = {}
    for r in L.scan(docs_of(rows)).collect():
        found.setdefault(r["id"], set()).add(r["licence"])
    assert all(n in found[k] for k, n in enumerate(names)) and 1000 not in found
    assert found[1001] == {"MIT-distributed"} and "CC-BY-4.0-short" in found[1002]


def test_filter_passes_every_shingle(spark):
    held = {h * 0x9E3779B97F4A7C15 % (1 << 63) - (1 << 62) for h in range(1, 3000)}
    test = L._filter(held)
    df = spark.createDataFrame([(h,) for h in held], "h long")
    assert df.filter(test(L.F.col("h"))).count() == len(held)
    assert spark.range(200_000).filter(test(L.F.xxhash64("id"))).count() < 20
