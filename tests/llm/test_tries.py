import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from stampmill.llm import tries as Z
from stampmill.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, k string, d string"


def brute(rows):
    """Rows of every beginning, from the whole sequences."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own_words = len(p[-1][1].encode().split()) if p else 0
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * own_words + sum(saved[q] for q in children[p])
    out = []
    for p, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(built[c]) == len(p))
        out.append((min(held), len(p), min(members[p[:-1]]) if p else None, len(held), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(2))
def test_against_whole_sequences(spark, seed, monkeypatch):
    monkeypatch.setattr(Z, "_PIECE", 4)  # sequences that are several pieces
    rng = random.Random(seed)
    rows = []
    for c in list(range(90)) + [120, 121, 140, -3, -20, -45]:
        say = lambda: rng.choice(["hi", "yes  no", "", None, "a b c"])
        n = rng.choice([1, 2, 3, 5, 9, 30])
        rows += [(c, t, rng.choice(["user", "user", None]), say() if rng.random() < 0.3 else "go on") for t in range(n)]
    assert found(Z.shared_beginnings(conversations(spark, rows))) == brute(rows)


def test_batches_give_one_trie(spark, sf):
    from stampmill.llm.tables import table

    steps, convs = Z.rebuilt(table(spark, sf, "conversations"))
    results = [found(Z.trie(steps, convs, batches)) for batches in ((1.0,), (0.2, 0.5, 1.0))]
    assert results[0] == results[1]


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, 1, "bot", "a"), (6, 2, "user", "a"), (20, None, "user", "b"), (33, 7, "user", "only")]
    rows += [(40 + k, t, "user", "same words") for k in range(30) for t in range(4)]
    assert found(Z.shared_beginnings(conversations(spark, rows))) == brute(rows)
    assert Z.shared_beginnings(conversations(spark, rows).limit(0)).collect() == []
    assert Z.shared_beginnings(conversations(spark, rows[:1])).collect() == []


def test_fattest(spark):
    pairs = [(a, e) for a in range(40) for e in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a long, e long").select("a", "e", Z.fattest(Z.F.col("a"), Z.F.col("e")).alias("f")).collect()
    assert all(r["f"] == max(range(r["a"] + 1, r["e"] + 1), key=lambda x: x & -x) for r in got)


def test_query(spark, sf):
    got = QUERIES["op11_prefix_trie"](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert found(got) == brute(rows)
    sql = con.execute(ORACLES["op11_prefix_trie"])
    assert [c[0] for c in sql.description] == got.columns
    assert sorted(sql.fetchall(), key=str) == brute(rows)
