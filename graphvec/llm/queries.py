"""Registered queries of the operators in this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphvec.llm import alignment, bpe, divergence, jaccard, langid, language_model, packing, quality, substring, toxicity, url_filter, vptree, warc
from graphvec.session import scratch_path, write_table

#: Vocabulary file of the tokenizing queries.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Model file that alignment sets against it.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Host and path rules of op1 (fixed values).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OP1_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM cut
), rules(v, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT DISTINCT host, path, v, h || p AS rule,
    row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, length(h) DESC, v DESC, h || p DESC) AS k
  FROM (SELECT DISTINCT host, path FROM parts) u
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, parts.host, parts.path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN fits ON fits.host = parts.host AND fits.path = parts.path AND k = 1
"""


@register("op1_url_filter", _OP1_SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@register("op2_langid")
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@register("op3_robust_outliers")
def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


@register("op4_chain")
def op4_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@register("op5_pack_binary")
def op5_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, digest=True)


_OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r
)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN reach ON reach.doc_id = d.doc_id
GROUP BY d.doc_id
"""


@register("op6_prefix_groups", _OP6_SQL)
def op6_prefix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


_OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS start, ws FROM w WHERE len(ws) >= 20
), judged AS (
  SELECT doc_id, start,
    row_number() OVER (PARTITION BY array_to_string(ws[start:start + 19], ' ') ORDER BY doc_id, start) > 1 AS again
  FROM windows
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(start, start + 20)) AS p FROM judged WHERE again) GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept, count(*) AS n
  FROM words ANTI JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) g ON g.doc_id = words.doc_id AND g.p = words.p
  GROUP BY words.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


@register("op7_seed_extend", _OP7_SQL)
def op7_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


_OP8_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@register("op8_vp_tree", _OP8_SQL)
def op8_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, factor=1.0)


@register("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), TOKENIZER)


_OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), newest AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS newest FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN newest > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN newest > page_id THEN newest END AS refers_to
FROM newest
"""


@register("op10_warc", _OP10_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = write_table(warc.read_archives(spark, path), "warc_records")
    return warc.resolve_revisits(found)


_OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), t AS (
  SELECT lang, source, rid, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS held FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30
), l AS (
  SELECT lang, count(*) AS v, sum(held) AS n FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
), gn AS (
  SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(gn.n, 0) + 5 * l.v) AS p,
    1 + 1000000000::HUGEINT * (kept.held + 5) // (l.n + 5 * l.v) AS q
  FROM g JOIN l ON l.lang = g.lang JOIN kept ON kept.lang = g.lang
  LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), found AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), both_parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(found.value, 0) AS value
  FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN found ON found.lang = g.lang AND found.source = g.source AND found.item = h.source
  UNION ALL
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@register("op13_divergence_cube", _OP13_SQL)
def op13_divergence_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@register("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)[0]


@register("op11_recurrent_lm")
def op11_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))
