"""A z-fast trie of conversations: every shared beginning, who shares it and what sharing saves.

Sequences of turns are read through the hashes of their beginnings, 128 bits each, so any beginning can be
looked up. The trie is compacted: its nodes are the root, the forks and the ends of sequences. Each node is
hashed at its handle, the depth within its edge that is divisible by the greatest power of two. A sequence
finds the edge at which it leaves the trie by fat binary search: it looks up its beginning at the handle depth
of the interval that is left, goes on below the node found, or above the depth if there is none. Sequences are
inserted in batches: a first share builds the trie, and of the rest only what lies beyond their exits is new.

Subtree sums go up the trie in rounds of doubled distance, and edges are expanded into one row for each
beginning in the end. No step gathers a path, a subtree or the members of a node in one place.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stampmill.llm.tables import dropped, kept, whole, words
from stampmill.operators.ordering import global_row_number

_MULTIPLIER = 0x9E3779B97F4A7C15
#: Turns of a sequence that are held together; a longer one is several pieces.
_PIECE = 1024
_ROOT = b"\0" * 16
_NO_ONE = hashlib.sha256(b"").hexdigest()


def _ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, pos, role, text: turns in order, numbered from 0 in their conversation; null turn numbers first, ties by role, then text."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), whole(role_col).alias("role"), whole(text_col).alias("text"))
    rows = rows.filter(F.col("conv").isNotNull())
    numbered = global_row_number(rows, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), name="at")
    numbered = kept(numbered.select("conv", "role", "text", "at"), "ordered-turns")
    begins = kept(numbered.groupBy("conv").agg(F.min("at").alias("begin")), "conversation-begins")
    return numbered.join(begins, "conv").select("conv", (F.col("at") - F.col("begin")).alias("pos"), "role", "text")


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(steps, conversations) of the rebuilt conversations: conv, pos, role, text and conv, n.

    Conversation c begins with the first h original turns of conversation c - c % 20, h being the CRC-32 of
    the decimal c modulo 4, and goes on with its own turns after its first h. Turns without a conversation id
    belong to none.
    """
    own = kept(_ordered(turns, conv_col, turn_col, role_col, text_col), "own-turns")
    sizes = kept(own.groupBy("conv").agg(F.count("*").alias("n")), "conversation-sizes")
    named = sizes.select("conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).alias("h"), (F.col("conv") - F.col("conv") % 20).alias("base"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = named.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    plan = kept(plan.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("n")), "rebuild-plan")
    # At most 3 turns of a base go to the conversations of its twenty.
    lent = own.filter(F.col("pos") < 3).withColumnRenamed("conv", "base").join(plan.select("conv", "base", "taken"), "base")
    lent = lent.filter(F.col("pos") < F.col("taken")).select("conv", "pos", "role", "text")
    rest = own.join(plan.select("conv", "h", "taken"), "conv").filter(F.col("pos") >= F.col("h"))
    rest = rest.select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "role", "text")
    return lent.unionByName(rest), plan.select("conv", "n")


def _powers(first: int, count: int) -> np.ndarray:
    out = np.full(count, _MULTIPLIER, np.uint64)
    out[:1] = pow(_MULTIPLIER, first, 1 << 64)
    return np.cumprod(out)


def _beginnings(steps: DataFrame) -> DataFrame:
    """conv, d, k, pk, words, sums: the hash of every beginning of d turns, of the one before it, the words of turn d and of all up to it."""
    pieces = steps.select(
        "conv", F.floor(F.col("pos") / _PIECE).alias("piece"),
        F.struct("pos", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit(7), "role").alias("b"), F.size(words(F.col("text"))).cast("long").alias("w")).alias("s"),
    ).groupBy("conv", "piece").agg(F.sort_array(F.collect_list("s")).alias("steps"))

    def sums_of(lists, first):
        """Running sums of both hashes, weighted by place, and of the words."""
        for steps_, piece in zip(lists, first):
            s = steps_.values
            h = [s.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b", "w")]
            weights = _powers(piece * _PIECE, len(s))
            yield np.cumsum(h[0].view(np.uint64) * weights), np.cumsum(h[1].view(np.uint64) * weights), h[2]

    def total(batches):
        for batch in batches:
            found = [(int(a[-1:].view(np.int64)[0]), int(b[-1:].view(np.int64)[0]), int(w.sum())) for a, b, w in sums_of(batch.column("steps"), batch.column("piece").to_pylist())]
            columns = list(zip(*found)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("piece"), *(pa.array(c, pa.int64()) for c in columns)], ["conv", "piece", "t1", "t2", "t_words"])

    def carry(batches):
        """What comes before each piece of a conversation."""
        for batch in batches:
            out = []
            for conv, held in zip(batch.column("conv").to_pylist(), batch.column("pieces").to_pylist()):
                a = b = w = 0
                for p in sorted(held, key=lambda p: p["piece"]):
                    out.append((conv, p["piece"], a, b, w))
                    a, b, w = (a + p["t1"]) % (1 << 64), (b + p["t2"]) % (1 << 64), w + p["t_words"]
            columns = list(zip(*out)) or [[]] * 5
            signed = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[2:4]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *signed, pa.array(columns[4], pa.int64())], ["conv", "piece", "b1", "b2", "b_words"])

    def unfold(batches):
        for batch in batches:
            out = []
            before = zip(*(batch.column(c).to_pylist() for c in ("conv", "piece", "b1", "b2", "b_words")))
            for (conv, piece, b1, b2, bw), (a, b, w) in zip(before, sums_of(batch.column("steps"), batch.column("piece").to_pylist())):
                b1, b2 = (np.array([x or 0], np.int64).view(np.uint64) for x in (b1, b2))
                keys = np.stack([np.concatenate([b1, a + b1]), np.concatenate([b2, b + b2])], 1).astype(">u8").tobytes()
                keys = [keys[i : i + 16] for i in range(0, len(keys), 16)]
                out += zip([conv] * len(a), range(piece * _PIECE + 1, piece * _PIECE + len(a) + 1), keys[1:], keys, w.tolist(), (np.cumsum(w) + (bw or 0)).tolist())
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, types)], ["conv", "d", "k", "pk", "words", "sums"])

    stored = kept(pieces, "turn-pieces")
    several = stored.filter(F.col("piece") > 0).select("conv").distinct()
    totals = stored.join(several, "conv", "left_semi").mapInArrow(total, "conv long, piece long, t1 long, t2 long, t_words long")
    carried = totals.groupBy("conv").agg(F.collect_list(F.struct("piece", "t1", "t2", "t_words")).alias("pieces"))
    carried = kept(carried.mapInArrow(carry, "conv long, piece long, b1 long, b2 long, b_words long"), "piece-carries")
    joined = stored.join(carried, ["conv", "piece"], "left")
    return kept(joined.mapInArrow(unfold, "conv long, d long, k binary, pk binary, words long, sums long"), "beginnings")


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that is divisible by the greatest power of two."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


def _marked_before(rows: DataFrame, name: str) -> DataFrame:
    """The same rows (conv, d, k, ...) with `prev`, the (d, k) of the row of the same conversation with the next smaller d.

    A path is cut into pieces; the last row of each piece is carried over by a window of one row a piece.
    """
    rows = kept(rows.withColumn("piece", F.floor(F.col("d") / _PIECE)), name)
    lasts = rows.groupBy("conv", "piece").agg(F.max(F.struct("d", "k")).alias("carry"))
    lasts = lasts.withColumn("carry", F.lag("carry").over(Window.partitionBy("conv").orderBy("piece")))
    near = rows.withColumn("prev", F.lag(F.struct("d", "k")).over(Window.partitionBy("conv", "piece").orderBy("d")))
    return near.join(kept(lasts.filter(F.col("carry").isNotNull()), f"{name}-carry"), ["conv", "piece"], "left").withColumn("prev", F.coalesce("prev", "carry")).drop("carry", "piece")


def _handled(nodes: DataFrame, begun: DataFrame) -> DataFrame:
    """Nodes (k and depth e, pk and depth a of the parent, rep that passes it) with handle depth f, handle hk and the first beginning tk of the edge."""
    asked = nodes.withColumn("f", fattest(F.col("a"), F.col("e")))
    handles = begun.select(F.col("conv").alias("rep"), F.col("d").alias("f"), F.col("k").alias("hk"))
    tops = begun.select(F.col("conv").alias("rep"), (F.col("d") - 1).alias("a"), F.col("k").alias("tk"))
    return asked.join(handles, ["rep", "f"]).join(tops, ["rep", "a"]).select("k", "e", "pk", "a", "rep", "f", "hk", "tk")


def _exits(trie: DataFrame | None, batch: DataFrame, begun: DataFrame) -> DataFrame:
    """For each sequence (conv, n): a, ak the node above its exit, b the depth up to which the trie knows it, ek, ee, erep the edge it leaves, or null."""
    if trie is None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("ek", "binary"), ("ee", "long"), ("erep", "long"))]
        zero = F.lit(0).cast("long")
        return kept(batch.select("conv", "n", zero.alias("a"), F.lit(_ROOT).alias("ak"), *none, zero.alias("b")), "exits")
    root = [F.lit(0).cast("long").alias("l"), F.lit(_ROOT).alias("bk"), F.lit(0).cast("long").alias("be"), F.lit(0).cast("long").alias("ba"), F.lit(_ROOT).alias("bpk"), F.lit(0).cast("long").alias("bf"), F.lit(None).cast("long").alias("brep")]
    state = kept(batch.select("conv", "n", F.col("n").alias("r"), *root), "search")
    handles = trie.select(F.col("hk").alias("hk"), F.col("f").alias("d"), *[F.col(c).alias(f"h_{c}") for c in ("k", "e", "a", "pk", "rep")])
    keys = begun.select("conv", "d", F.col("k").alias("hk"))
    while not (left := state.filter(F.col("l") < F.col("r"))).isEmpty():
        asked = left.withColumn("d", fattest(F.col("l"), F.col("r"))).join(keys, ["conv", "d"]).join(handles, ["hk", "d"], "left")
        hit = F.col("h_k").isNotNull()
        pick = lambda c, o: F.when(hit, F.col(c)).otherwise(F.col(o)).alias(o)
        moved = asked.select("conv", "n", F.when(hit, F.col("r")).otherwise(F.col("d") - 1).alias("r"), pick("h_e", "l"), pick("h_k", "bk"), pick("h_e", "be"), pick("h_a", "ba"), pick("h_pk", "bpk"), F.when(hit, F.col("d")).otherwise(F.col("bf")).alias("bf"), pick("h_rep", "brep"))
        done = state.filter(F.col("l") >= F.col("r"))
        before, state = state, kept(done.unionByName(moved), "search")
        dropped(before)
    whole_edge = begun.select("conv", F.col("d").alias("be"), F.col("k").alias("bk"), F.lit(True).alias("full"))
    found = state.join(whole_edge, ["conv", "be", "bk"], "left").withColumn("full", F.coalesce("full", F.col("be") == 0))
    # Below a node that is passed whole, the edge that begins like the sequence goes on, if there is one.
    onward = begun.select("conv", (F.col("d") - 1).alias("be"), F.col("k").alias("tk"))
    edges = trie.select("tk", *[F.col(c).alias(f"t_{c}") for c in ("k", "e", "rep")])
    found = found.join(onward, ["conv", "be"], "left").withColumn("tk", F.when(F.col("full"), F.col("tk"))).join(edges, "tk", "left")
    found = found.select(
        "conv", "n", F.when(F.col("full"), F.col("be")).otherwise(F.col("ba")).alias("a"), F.when(F.col("full"), F.col("bk")).otherwise(F.col("bpk")).alias("ak"),
        F.when(F.col("full"), F.col("be") + F.col("t_e").isNotNull().cast("long")).otherwise(F.col("bf")).alias("least"),
        *[F.when(F.col("full"), F.col(f"t_{c}")).otherwise(F.col(o)).alias(e) for c, o, e in (("k", "bk", "ek"), ("e", "be", "ee"), ("rep", "brep", "erep"))],
    )
    found = kept(found, "exit-edges")
    ours = found.filter(F.col("ek").isNotNull()).select("conv", "least", "ee", "erep").join(begun.select("conv", "d", "k"), "conv").filter((F.col("d") > F.col("least")) & (F.col("d") <= F.col("ee")))
    theirs = begun.select(F.col("conv").alias("erep"), "d", "k")
    common = ours.join(theirs, ["erep", "d", "k"]).groupBy("conv").agg(F.max("d").alias("deep"))
    out = found.join(common, "conv", "left").withColumn("b", F.coalesce("deep", "least")).drop("deep", "least")
    return kept(out, "exits")


def _inserted(trie: DataFrame | None, batch: DataFrame, begun: DataFrame) -> DataFrame:
    """The trie with a batch of distinct sequences (conv, n) added."""
    exits = _exits(trie, batch, begun)
    keys = begun.select("conv", "d", "k", "pk")
    splits = exits.filter(F.col("ek").isNotNull() & (F.col("b") < F.col("ee"))).select("conv", F.col("b").alias("d")).join(keys, ["conv", "d"]).select("k", "d", "conv")
    ends = exits.filter(F.col("n") > F.col("b")).select("conv", F.col("n").alias("d")).join(keys, ["conv", "d"]).select("k", "d", "conv")
    beyond = keys.join(exits.select("conv", "b"), "conv").filter(F.col("d") > F.col("b") + 1)
    forks = beyond.groupBy("pk").agg(F.min("k").alias("x"), F.max("k").alias("y"), F.min("d").alias("d"), F.min("conv").alias("conv")).filter(F.col("x") != F.col("y"))
    forks = forks.select(F.col("pk").alias("k"), (F.col("d") - 1).alias("d"), "conv")
    new = kept(splits.unionByName(ends).unionByName(forks).groupBy("k").agg(F.min("d").alias("d"), F.min("conv").alias("rep")), "new-nodes")
    paths = keys.select("conv", "d", "k").join(exits.select("conv", "a", "ak"), "conv").filter(F.col("d") > F.col("a")).join(new.select("k"), "k")
    linked = _marked_before(paths.select("conv", "d", "k", "a", "ak"), "new-paths")
    parents = linked.groupBy("k").agg(F.min(F.struct(F.coalesce("prev.d", "a").alias("a"), F.coalesce("prev.k", "ak").alias("pk"))).alias("p"))
    added = new.join(parents, "k").select("k", F.col("d").alias("e"), "p.pk", "p.a", "rep")
    if trie is None:
        return kept(_handled(added, begun), "trie")
    # An edge that was cut hangs from its deepest cut now.
    touched = exits.filter(F.col("ek").isNotNull() & (F.col("b") < F.col("ee"))).select("ek", "b", "conv").join(begun.select("conv", F.col("d").alias("b"), F.col("k").alias("bk")), ["conv", "b"])
    touched = kept(touched.groupBy("ek").agg(F.max(F.struct("b", "bk")).alias("cut")).withColumnRenamed("ek", "k"), "cut-edges")
    lower = trie.join(touched, "k").select("k", "e", F.col("cut.bk").alias("pk"), F.col("cut.b").alias("a"), "rep")
    grown = trie.join(touched.select("k"), "k", "left_anti").unionByName(_handled(added.unionByName(lower), begun))
    out = kept(grown, "trie")
    dropped(exits, new, touched)
    return out


def _risen(nodes: DataFrame, **values: str) -> DataFrame:
    """The nodes (k, pk, ...) with each value summed (or the least taken) over the whole subtree, in rounds of doubled distance."""
    folds = {"sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0).cast("long"))), "min": (F.min, lambda a, b: F.least(a, b))}
    state = kept(nodes.select("k", F.col("pk").alias("up"), *values), "rising")
    while not (some := state.filter(F.col("up").isNotNull())).isEmpty():
        sums = kept(some.groupBy(F.col("up").alias("k")).agg(*[folds[f][0](c).alias(f"more_{c}") for c, f in values.items()]), "rising-sums")
        ups = kept(some.select(F.col("k").alias("up"), F.col("up").alias("upper")), "rising-links")
        joined = state.join(sums, "k", "left").join(ups, "up", "left")
        before, state = state, kept(joined.select("k", F.col("upper").alias("up"), *[folds[f][1](F.col(c), F.col(f"more_{c}")).alias(c) for c, f in values.items()]), "rising")
        dropped(before, sums, ups)
    return nodes.drop(*values).join(state.drop("up"), "k")


def _digests(ends: DataFrame) -> DataFrame:
    """k, ends_sha256 of the decimal ids of the conversations (k, conv) that end at each key, ascending.

    The ids are sorted over all tasks, and each task joins what it has of a key into one compressed chunk.
    The digest itself can only be taken in one go, over the chunks of a key in order.
    """
    tasks = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pack(batches):
        held: dict = {}

        def out():
            rows = [(k, ids[0], zlib.compress(",".join(map(str, ids)).encode(), 1)) for k, ids in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, [pa.binary(), pa.int64(), pa.binary()])], ["k", "first", "chunk"])

        for batch in batches:
            for k, conv in zip(batch.column("k").to_pylist(), batch.column("conv").to_pylist()):
                if k not in held and len(held) >= 4096:  # keys come in order
                    yield out()
                    held = {}
                held.setdefault(k, []).append(conv)
        if held:
            yield out()

    def digest(batches):
        for batch in batches:
            out = []
            for chunks in batch.column("chunks"):
                sha = hashlib.sha256()
                for i, c in enumerate(chunks.values.field("chunk")):
                    sha.update((b"," if i else b"") + zlib.decompress(c.as_py()))
                out.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.string())], ["k", "ends_sha256"])

    chunks = ends.repartitionByRange(tasks, "k", "conv").sortWithinPartitions("k", "conv").mapInArrow(pack, "k binary, first long, chunk binary")
    listed = chunks.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("first", "chunk"))).alias("chunks"))
    return listed.mapInArrow(digest, "k binary, ends_sha256 string")


def trie(steps: DataFrame, conversations: DataFrame, batches: tuple[float, ...] = (0.125, 1.0)) -> DataFrame:
    """One row for each distinct beginning of the sequences of `steps` (conv, pos, role, text; pos from 0 without gaps).

    `conversations` has conv and n, the number of turns, also of those without any. Columns: conv_id, its
    smallest member; depth; parent_conv_id, null at the root; n_convs; n_children; n_leaves; saved_tokens, the
    words that its subtree's conversations need not repeat; ends_sha256 over the ids that end there. `batches`
    are the shares of sequences that are in the trie after each batch. No conversations: no rows.
    """
    begun = _beginnings(steps)
    root = F.lit(_ROOT)
    lasts = begun.select("conv", F.col("d").alias("n"), "k")
    ends = kept(conversations.join(lasts, ["conv", "n"], "left").select("conv", "n", F.coalesce("k", root).alias("k")), "sequence-ends")
    counted = kept(ends.groupBy("k").agg(F.count("*").alias("here"), F.min("conv").alias("least"), F.first("n").alias("n")), "distinct-ends")
    if counted.isEmpty():
        schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return steps.sparkSession.createDataFrame([], schema)
    sequences = kept(counted.filter(F.col("n") > 0).select(F.col("least").alias("conv"), "n").withColumn("share", F.pmod(F.xxhash64("conv"), F.lit(1 << 20)) / F.lit(1 << 20)), "sequences")
    nodes = None
    for low, high in zip((0.0, *batches[:-1]), batches):
        batch = sequences.filter((F.col("share") >= low) & (F.col("share") < high)).select("conv", "n")
        nodes = _inserted(nodes, batch, begun)
    # The root, and what each node has by itself.
    top = steps.sparkSession.createDataFrame([(bytearray(_ROOT), 0)], "k binary, e long").select("k", "e", F.lit(None).cast("binary").alias("pk"), F.lit(0).cast("long").alias("a"), F.lit(None).cast("long").alias("rep"))
    every = kept(nodes.select("k", "e", "pk", "a", "rep").unionByName(top), "all-nodes")
    below = kept(every.filter(F.col("pk").isNotNull()).groupBy(F.col("pk").alias("k")).agg(F.count("*").alias("n_children")), "child-counts")
    own = every.join(below, "k", "left").join(counted.select("k", "here", "least"), "k", "left")
    zero = F.lit(0).cast("long")
    own = own.withColumns({"n_children": F.coalesce("n_children", zero), "n_convs": F.coalesce("here", zero)}).drop("here")
    own = own.withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
    summed = kept(_risen(kept(own, "own-values"), n_convs="sum", n_leaves="sum", least="min"), "summed-nodes")
    # What an edge saves goes up in a second pass, since it needs the number of members below it.
    at = begun.select(F.col("conv").alias("rep"), F.col("d"), "sums")
    edge = summed.join(at.select("rep", F.col("d").alias("e"), F.col("sums").alias("to")), ["rep", "e"], "left").join(at.select("rep", F.col("d").alias("a"), F.col("sums").alias("since")), ["rep", "a"], "left")
    edge = edge.withColumn("saved", (F.col("n_convs") - 1) * (F.coalesce("to", zero) - F.coalesce("since", zero))).withColumn("edge", F.col("saved")).drop("since")
    saved = kept(_risen(kept(edge, "edge-values"), saved="sum"), "saved-nodes")
    above = kept(saved.select(F.col("k").alias("pk"), F.col("least").alias("above")), "node-names")
    told = kept(saved.join(above, "pk", "left").join(_digests(ends), "k", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ONE))), "told-nodes")
    # An edge's rows are read off the path of its smallest member, some depths at a time.
    chains = told.filter(F.col("e") > 0).select(F.col("least").alias("conv"), "e", "k", F.explode(F.sequence(F.col("a") + 1, F.col("e"), F.lit(_PIECE).cast("long"))).alias("s"))
    inside = kept(chains.select("conv", "k", F.explode(F.sequence("s", F.least(F.col("s") + _PIECE - 1, F.col("e")))).alias("d")), "edge-depths")
    rows = begun.select("conv", "d", "words", "sums").join(inside, ["conv", "d"]).join(told.drop("rep", "pk"), "k")
    at_end, first = F.col("d") == F.col("e"), F.col("d") == F.col("a") + 1
    expanded = rows.select(
        F.col("least").alias("conv_id"), F.col("d").alias("depth"), F.when(first, F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"), "n_convs",
        F.when(at_end, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
        (F.col("saved") - F.col("edge") + (F.col("n_convs") - 1) * (F.col("to") - F.col("sums") + F.col("words"))).alias("saved_tokens"),
        F.when(at_end, F.col("ends_sha256")).otherwise(F.lit(_NO_ONE)).alias("ends_sha256"),
    )
    head = told.filter(F.col("e") == 0).select(F.col("least").alias("conv_id"), F.col("e").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
    return expanded.unionByName(head)


def shared_beginnings(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`trie` of the rebuilt conversations of a table of turns.

    Null roles and texts are empty. Turns of a conversation are ordered by number, null first, ties by role and
    then by text, so repeated rows are turns of their own. Rows without a conversation id belong to none.
    Other columns are not read, whatever their names. Empty table: empty.
    """
    steps, conversations = rebuilt(turns, conv_col, turn_col, role_col, text_col)
    return trie(steps, conversations)
