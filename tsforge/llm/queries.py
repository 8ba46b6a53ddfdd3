"""The registered queries of the text operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm import (
    block_naming, collocations, exact_topk, golay_simhash, odd_sketches, packing, quality, sentence_spans, stream_viterbi, token_files,
    trie_counts, turn_repair, url_filter,
)
from tsforge.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return register


@query(
    "op4_exact_topk",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
               CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    WHERE rank <= 5
    """,
)
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query(
    "op6_url_filter",
    r"""
    WITH p AS (
        SELECT page_id,
               translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages),
    r(rule_host, rule_path, rule_verdict) AS (
        VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
               ('org', '/fr/', 'allow')),
    j AS (
        SELECT p.*, (SELECT max({'n': length(rule_host || rule_path), 'rule': rule_host || rule_path,
                                 'v': rule_verdict}) FROM r
                     WHERE ('.' || p.host) LIKE ('%.' || rule_host) AND starts_with(p.path, rule_path)) AS best
        FROM p)
    SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM j
    """,
)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query(
    "op7_block_naming",
    r"""
    WITH n AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
    g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept,
           sha256(t) AS text_sha256
    FROM n JOIN g USING (t)
    """,
)
def op7_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_files.write_shards(table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"))
    return token_files.read_documents(folder, manifest)


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizers.path("byte_bpe_50k.json"), with_ids=False).withColumn(
        "length", F.col("length").cast("long")
    )


@query("op3_stream_viterbi")
def op3_stream_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_viterbi.round_trip(table(spark, sf_dir, "documents"), tokenizers.path("piece_bpe_32k.model"))


@query("op10_trie_counts")
def op10_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.token_counts(table(spark, sf_dir, "documents"), tokenizers.path("piece_bpe_32k.model"))


@query(
    "op9_odd_sketches",
    r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, list_filter(
            string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
        FROM documents),
    s AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
            range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s
        FROM d),
    c AS (SELECT s AS set_, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s)
          WHERE len(s) > 0 GROUP BY s),
    x AS (SELECT rep, n, unnest(set_) AS g FROM c),
    p AS (
        SELECT a.rep AS u, b.rep AS v FROM x a JOIN x b
            ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
        GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
    r(node, root) AS (
        SELECT rep, rep FROM c
        UNION
        SELECT e.v, r.root FROM r JOIN e ON e.u = r.node),
    k AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id,
           s.doc_id = coalesce(k.component_id, s.doc_id) AS kept
    FROM s LEFT JOIN c ON list_sort(s.s) = c.set_ LEFT JOIN k ON k.node = c.rep
    """,
)
def op9_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketches.near_duplicates(table(spark, sf_dir, "documents"), k=4)


@query("op8_sentence_spans")
def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentence_spans.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "text",
        F.col("_n_removed").alias("n_removed"),
        F.col("_removed_bytes").alias("removed_bytes"),
        (F.length(F.trim("text")) > 0).alias("kept"),
    )


@query("op5_naive_bayes_svm")
def op5_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs.select("doc_id", "text"), model).select(
        "doc_id",
        quality.held_out().alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= quality.CUT).cast("int").alias("predicted"),
    )


@query(
    "op12_collocations",
    r"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
    g AS (
        SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i : i + m - 1])) AS words
        FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
    f AS MATERIALIZED (SELECT lang, m, words, count(*) AS f FROM g GROUP BY ALL HAVING m = 1 OR count(*) >= 100),
    t AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS (SELECT lang, m, words, f AS a FROM f WHERE m > 1 AND f >= 100),
    parts AS (
        SELECT lang, words[i : j] AS words, max(a) AS longer
        FROM c, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 6)) AS j)
        WHERE i < j AND j <= m AND j - i + 1 < m
        GROUP BY ALL),
    d AS MATERIALIZED (
        SELECT c.lang, c.words, a, k, c.words[1 : k] AS head, c.words[k + 1 :] AS tail
        FROM c JOIN (SELECT unnest(range(1, 5)) AS k) ON k < m LEFT JOIN parts USING (lang, words)
        WHERE longer IS NULL OR 100 * longer < 100 * a),
    s AS (
        SELECT d.lang, d.words, a, n, k, l.f AS l, r.f AS r,
               (1000 * a::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
        FROM d JOIN t USING (lang) JOIN f l ON l.lang = d.lang AND l.words = head
             JOIN f r ON r.lang = d.lang AND r.words = tail),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS cut FROM s),
    o AS (
        SELECT *, row_number() OVER (
            PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank
        FROM b WHERE cut = 1)
    SELECT lang, rank, array_to_string(words, ' ') AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
           CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM o WHERE rank <= 2000
    """,
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_golay_simhash")
def op13_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op11_turn_repair",
    r"""
    WITH RECURSIVE raw AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(
                       coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                       lambda c: ascii(c)::BIGINT)),
                   lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
                       lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS kind
        FROM conversations),
    d AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM raw WHERE kind <> 0),
    f AS (
        SELECT *, left(role, 1) AS initial, right(rtrim(text, E' \t\n\x0b\f\r'), 1) AS tail,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
        FROM d),
    r AS (
        SELECT *, tail = '' OR seen > 1 AS forced, CASE WHEN tail IN ('.', '!', '?') THEN 0 ELSE 3 END AS cut,
               lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before,
               chr(10) || 'user:' || text AS as_user, chr(10) || 'assistant:' || text AS as_assistant
        FROM f),
    -- Per state: cost c, audit a, repaired text t (a line end before each row).
    rec(conv_id, i, e, s, u, a) AS (
        SELECT DISTINCT conv_id, 1::BIGINT, {'c': 0, 'a': '', 't': ''}, {'c': 1000000000, 'a': '', 't': ''},
               {'c': 1000000000, 'a': '', 't': ''}, {'c': 1000000000, 'a': '', 't': ''}
        FROM r
        UNION ALL
        SELECT y.conv_id, y.i + 1, {'c': e.c + 4, 'a': e.a || 'D', 't': e.t},
               list_min([{'c': s.c + 4, 'a': s.a || 'D', 't': s.t},
                         {'c': e.c + CASE WHEN forced OR initial <> 's' THEN 1000000000 ELSE cut END, 'a': e.a || 'K',
                          't': e.t || chr(10) || role || ':' || text}]),
               list_min([{'c': u.c + 4, 'a': u.a || 'D', 't': u.t},
                         {'c': b.c + CASE WHEN forced OR initial <> 'u' THEN 1000000000 ELSE cut END, 'a': b.a || 'K',
                          't': b.t || chr(10) || role || ':' || text},
                         {'c': b.c + CASE WHEN forced THEN 1000000000 ELSE cut + 3 END, 'a': b.a || 'R',
                          't': b.t || as_user}]),
               list_min([{'c': a.c + 4, 'a': a.a || 'D', 't': a.t},
                         {'c': u.c + CASE WHEN forced OR initial <> 'a' THEN 1000000000 ELSE cut END, 'a': u.a || 'K',
                          't': u.t || chr(10) || role || ':' || text},
                         {'c': u.c + CASE WHEN forced THEN 1000000000 ELSE cut + 3 END, 'a': u.a || 'R',
                          't': u.t || as_assistant}])
        FROM (SELECT *, list_min([e, s, a]) AS b FROM (
                  SELECT conv_id, i, e, s, u, list_min([a, {'c': u.c + 3, 'a': u.a || 'I',
                                                            't': u.t || chr(10) || 'assistant:'}]) AS a
                  FROM (SELECT conv_id, i, e, s, a, list_min([u, {'c': e.c + 3, 'a': e.a || 'I', 't': e.t || chr(10) || 'user:'},
                                                              {'c': s.c + 3, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'},
                                                              {'c': a.c + 3, 'a': a.a || 'I', 't': a.t || chr(10) || 'user:'}]) AS u
                        FROM rec))) y
        JOIN r ON r.conv_id IS NOT DISTINCT FROM y.conv_id AND r.i = y.i),
    o AS (
        SELECT conv_id, list_min([e, a, {'c': u.c + 3, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'},
                                  {'c': s.c + 6, 'a': s.a || 'II', 't': s.t || chr(10) || 'user:' || chr(10) || 'assistant:'}]) AS z
        FROM rec WHERE (SELECT count(*) FROM r WHERE r.conv_id IS NOT DISTINCT FROM rec.conv_id) = i - 1),
    n AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (tail = '') AS blank, count(*) FILTER (tail <> '' AND seen > 1) AS duplicate,
               count(*) FILTER (NOT forced AND cut > 0) AS truncated,
               count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
        FROM r GROUP BY conv_id)
    SELECT q.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
           CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
           CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(z.c, 0) AS BIGINT) AS cost,
           coalesce(z.a, '') AS audit, sha256(coalesce(substr(z.t, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) q
    LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM q.conv_id
    """,
)
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_report(table(spark, sf_dir, "conversations"))
