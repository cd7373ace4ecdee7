"""Queries of the corpus operators, each over its whole table, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.bpe import bpe_digests
from colloquy.llm.common import read
from colloquy.llm.exact import exact_dedup
from colloquy.llm.licences import scan_licences
from colloquy.llm.near import near_dedup
from colloquy.llm.negatives import hard_negatives
from colloquy.llm.packing import pack
from colloquy.llm.personal import scan_personal
from colloquy.llm.prefixes import prefix_trie
from colloquy.llm.quality import grades_of, rate_quality, train_quality
from colloquy.llm.secret_scan import scan_secrets
from colloquy.llm.tokens import token_counts
from colloquy.llm.urls import LONG_SUFFIXES, STRONGEST, WEAKEST, judge_urls
from colloquy.llm.vectors import embedding_dedup

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rated = rate_quality(docs, train_quality(docs, grades_of(read(spark, sf_dir, "labels"))))
    tails = [F.round(F.col("_tails")[k], 6).alias(name) for k, name in enumerate(("p_readable", "p_good"))]
    return rated.select("_row.doc_id", F.round("_expected", 6).alias("expected_grade"), *tails, F.col("_kept").alias("kept"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents").select("text"))


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), labels, URL_RULES)


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_personal(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ordinal_quality, op2_exact_dedup, op3_best_fit_packing, op4_token_counts, op5_url_reputation, op6_bag_minhash, op7_bpe_trie, op8_embedding_dedup, op9_secret_scan, op10_licence_scan, op11_personal_data, op12_prefix_trie, op13_hard_negatives)}


def _url_sql(limit: float = 0.25, z: float = 1.6448536269514722) -> str:
    long = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
    rules = " UNION ALL ".join(f"SELECT '{r.partition('/')[0]}' AS h, '/{r.partition('/')[2]}' AS p, '{r}' AS r, '{v}' AS v" for r, v in URL_RULES.items())

    def strength(table: str) -> str:
        return f"""(SELECT CASE WHEN t IS NULL THEN {WEAKEST}e0 WHEN rho <= 1 / (1 + {STRONGEST}e0) THEN {STRONGEST}e0 WHEN rho >= 1 / (1 + {WEAKEST}e0) THEN {WEAKEST}e0 ELSE coalesce(1 / rho - 1, {STRONGEST}e0) END
            FROM (SELECT (s - p * (1 - p) * k) / nullif(p * (1 - p) * (t - q / t - k), 0) AS rho, t
                  FROM (SELECT sum(y * y / n) - sum(y) * sum(y) / sum(n) AS s, sum(y) / sum(n) AS p, count(*) - 1 AS k, sum(n) AS t, sum(n * n) AS q FROM {table} WHERE n > 0)))"""

    return f"""
        WITH a AS (SELECT page_id, coalesce(url, '') AS u, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h0, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM a),
        marks AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
        parts AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS y,
                         regexp_replace(regexp_replace(host, '^.*@', ''), '[.]?(:[0-9]*)?$', '') AS bare, string_split(bare, '.') AS x,
                         array_to_string(x[-2:], '.') AS two, regexp_full_match(bare, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') OR starts_with(bare, '[') AS ip
                  FROM b LEFT JOIN marks USING (page_id) GROUP BY host),
        hosts AS (SELECT host, n, y, CASE WHEN ip THEN bare WHEN two IN ({long}) THEN array_to_string(x[-3:], '.') ELSE two END AS domain,
                         CASE WHEN ip THEN 'ip' WHEN two IN ({long}) THEN two ELSE x[-1] END AS suffix FROM parts),
        domains AS (SELECT domain, suffix, sum(n) AS n, sum(y) AS y FROM hosts GROUP BY ALL),
        suffixes AS (SELECT suffix, sum(n) AS n, sum(y) AS y FROM domains GROUP BY ALL),
        k AS (SELECT {strength("hosts")} AS kh, {strength("domains")} AS kd, {strength("suffixes")} AS ks, (SELECT (sum(y) + 1) / (sum(n) + 2) FROM suffixes) AS m),
        s2 AS (SELECT suffix, (y + m * ks) / (n + ks) AS ms FROM suffixes, k),
        d2 AS (SELECT domain, (y + ms * kd) / (n + kd) AS md FROM domains JOIN s2 USING (suffix), k),
        h1 AS (SELECT host, y + md * kh AS ba, n - y + (1 - md) * kh AS bb, 1 - 1 / (9 * bb) AS bp, 1 - 1 / (9 * ba) AS bq,
                      {z}e0 * {z}e0 / (9 * bb) AS bu, {z}e0 * {z}e0 / (9 * ba) AS bv FROM hosts JOIN d2 USING (domain), k),
        h2 AS (SELECT host, ba * pow(greatest(0, (bp * bq - sqrt(greatest(0, bp * bp * bq * bq - (bp * bp - bu) * (bq * bq - bv)))) / (bp * bp - bu)), 3) AS f, f / (bb + f) AS lower FROM h1),
        rules AS ({rules}),
        best AS (SELECT page_id, arg_max(r, length(r)) AS rule, arg_max(v, length(r)) AS v
                 FROM b JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN lower > {limit} THEN 'block' ELSE 'allow' END) AS verdict, round(lower, 6) AS lower
        FROM b JOIN h2 USING (host) LEFT JOIN best USING (page_id)"""


_PREFIX_SQL = r"""
    WITH t AS (SELECT conv_id, turn, sha256(strlen(r) || ':' || r || x) AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w
               FROM (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM t),
    c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
              lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, i: xor(y >> 1, 3988292384 * (y & 1))))) % 4 AS h
          FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (SELECT c.conv_id, 0 AS part, pos, k, w FROM c JOIN o ON o.conv_id = base AND pos <= h UNION ALL SELECT c.conv_id, 1, pos, k, w FROM c JOIN o ON o.conv_id = c.conv_id AND pos > h),
    l AS (SELECT c.conv_id, coalesce(list({'k': k, 'w': w} ORDER BY part, pos) FILTER (WHERE k IS NOT NULL), []) AS l FROM c LEFT JOIN r USING (conv_id) GROUP BY 1),
    p AS (SELECT conv_id, len(l) AS size, d, l[1:d] AS pre FROM l, unnest(range(0, len(l) + 1)) u(d)),
    n AS (SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256 FROM p GROUP BY d, pre),
    q AS (SELECT d - 1 AS d, pre[1:d - 1] AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
    x AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * pre[d].w ELSE 0 END AS cost FROM n LEFT JOIN q USING (d, pre)),
    s AS (SELECT a AS d, pre[1:a] AS pre, sum(cost)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM x, unnest(range(0, d + 1)) u(a) GROUP BY ALL)
    SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
    FROM x JOIN s USING (d, pre) LEFT JOIN n up ON up.d = x.d - 1 AND up.pre = x.pre[1:x.d - 1]"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_prefix_trie": _PREFIX_SQL,
        "op13_hard_negatives": """
            WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q
                       FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
            s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
                  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.q) = len(b.q) AND a <> b),
            p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
            SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
            WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5""",
        "op2_exact_dedup": """
            WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
            FROM t WINDOW w AS (PARTITION BY norm)""",
        "op5_url_reputation": _url_sql(),
        "op8_embedding_dedup": """
            WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
            ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
            l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
                  WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.93),
            r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id)
            SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(c) AS component_id, vec_id = min(c) AS kept
            FROM r LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) USING (vec_id) GROUP BY vec_id""",
    }
