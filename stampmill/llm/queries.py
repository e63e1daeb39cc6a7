"""The registered queries of this subpackage: each operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampmill.llm.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_WORDS = r"[x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']"

_OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
tri AS (SELECT r, i, list_slice(w, i, i + 2) AS t FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM tri) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS p FROM again) GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup
       FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             coalesce(ln.n, 0)::BIGINT AS n_lines, coalesce(ln.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS letters, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS capitals,
             length(regexp_replace(text, '[^|]+', '', 'g')) AS bars
      FROM d LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.1 * greatest(n_words, 1) OR (n_dup_lines > 0.5 * n_lines AND n_dup_lines > 3)
            OR word_chars < 2.5 * greatest(n_words, 1) OR word_chars > 15 * greatest(n_words, 1) OR letters < 0.6 * word_chars
            OR capitals > 0.7 * greatest(letters, 1) OR bars > 0.2 * greatest(n_words, 1)) AS kept
FROM b
"""


@query("op5_quality_cascade", _OP5)
def op5_quality_cascade(spark, sf_dir):
    """Quality measures and the verdict of the ordered cascade for every document."""
    from stampmill.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op2_pii_disclosure")
def op2_pii_disclosure(spark, sf_dir):
    """Personal data and disclosing words of every document."""
    from stampmill.llm.privacy import digest, find

    return digest(find(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


@query("op3_histogram_shards")
def op3_histogram_shards(spark, sf_dir):
    """Every document's shard of 8, sizes near equal."""
    from stampmill.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents"), n_shards=8, law="bytes").withColumnRenamed("id", "doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and linked class of every document."""
    from stampmill.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op9_toxicity_grammar")
def op9_toxicity_grammar(spark, sf_dir):
    """Toxicity of every document."""
    from stampmill.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


@query("op8_benchmark_leaks")
def op8_benchmark_leaks(spark, sf_dir):
    """Every benchmark item found in every document, edited by a fifth of its words at most."""
    from stampmill.llm.decontaminate import leaks

    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed vocabulary files are; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_sentencepiece_tokens")
def op6_sentencepiece_tokens(spark, sf_dir):
    """Token ids of every document, and whether they decode to its text."""
    from stampmill.llm.tokens import tokenise

    return tokenise(table(spark, sf_dir, "documents"), model_path()).withColumnRenamed("id", "doc_id")


@query("op4_tag_path_text")
def op4_tag_path_text(spark, sf_dir):
    """Main text of every page."""
    from stampmill.llm.pages import extract

    return extract(table(spark, sf_dir, "pages"))


@query("op7_licence_scan")
def op7_licence_scan(spark, sf_dir):
    """Every licence notice found in every document, with the share of it that is there."""
    from stampmill.llm.licences import scan

    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("row")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf_dir):
    """Bytes of every document that lie in a 400-byte string met elsewhere."""
    from stampmill.llm.suffixes import repeats

    return repeats(table(spark, sf_dir, "documents"), length=400).withColumnRenamed("id", "doc_id").drop("spans")


_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS t FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) > 34)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY t) AS c FROM windows) WHERE c > 1),
gone AS (SELECT DISTINCT r, i + unnest(range(35)) AS p FROM again),
rest AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS k FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (SELECT count(*) FROM gone g WHERE g.r = d.r)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN rest USING (r)
"""


@query("op13_debruijn_dedup", _OP13)
def op13_debruijn_dedup(spark, sf_dir):
    """Words of every document that lie in a window of 35 words met elsewhere."""
    from stampmill.llm.debruijn import repeats

    return repeats(table(spark, sf_dir, "documents"), length=35).withColumnRenamed("id", "doc_id").drop("spans")


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    """Periodic runs of words of every document, a tenth of them with a repetition written over their end."""
    from stampmill.llm.periods import digest, periodic_runs

    return digest(periodic_runs(table(spark, sf_dir, "documents"), plant=True)).withColumnRenamed("id", "doc_id")


_OP11 = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'role': role, 'text': text} ORDER BY pos) AS s FROM t GROUP BY c),
hashed AS (SELECT c, s, c - c % 20 AS base, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i::BIGINT, 1))::BIGINT),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 4 AS h FROM own),
built AS (SELECT a.c, list_concat(coalesce(b.s, [])[1:a.h], a.s[a.h + 1:]) AS s FROM hashed a LEFT JOIN own b ON b.c = a.base),
beg AS (SELECT c, d, s[1:d] AS p, d = len(s) AS last FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM built)),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN last THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256,
                CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len([w FOR w IN regexp_split_to_array(p[d].text, '[\x20\x09-\x0D]+') IF w <> '']) END AS own FROM beg GROUP BY p, d),
child AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
up AS (SELECT p, d, own, NOT EXISTS (SELECT 1 FROM child k WHERE k.p = node.p) AS leaf, unnest(range(0, d + 1)) AS e FROM node),
sub AS (SELECT p[1:e] AS p, sum(own)::BIGINT AS saved_tokens, sum(leaf::BIGINT)::BIGINT AS n_leaves FROM up GROUP BY 1)
SELECT n.conv_id::BIGINT AS conv_id, n.d::BIGINT AS depth, q.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
       s.n_leaves, s.saved_tokens, n.ends_sha256
FROM node n JOIN sub s ON s.p = n.p LEFT JOIN child k ON k.p = n.p LEFT JOIN node q ON n.d > 0 AND q.p = n.p[1:n.d - 1]
"""


@query("op11_prefix_trie", _OP11)
def op11_prefix_trie(spark, sf_dir):
    """Every shared beginning of the rebuilt conversations: members, children, leaves and words saved."""
    from stampmill.llm.tries import shared_beginnings

    return shared_beginnings(table(spark, sf_dir, "conversations"))
