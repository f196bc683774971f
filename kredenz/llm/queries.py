"""Queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kredenz.llm.decontaminate import leaks
from kredenz.llm.html_text import extract
from kredenz.llm.negatives import hard_negatives
from kredenz.llm.neighbours import nearest
from kredenz.llm.packing import packed
from kredenz.llm.secrets import KINDS, secrets
from kredenz.llm.shards import assign_shards
from kredenz.llm.simhash import near_duplicates
from kredenz.llm.substrings import remove_repeats
from kredenz.llm.token_counts import token_counts
from kredenz.llm.toxicity import held_out, toxicity
from kredenz.llm.url_filter import judge_urls
from kredenz.llm.whitening import finite, floored, whitened

#: Host and path rules of the url filter.
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), 512)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "toxic_words",
        "spans",
    )


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return assign_shards(table(spark, folder, "documents"), 24)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), 2048, 1, with_ids=False)


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), with_text=False)


def op9_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), URL_RULES)


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(table(spark, folder, "embeddings"), components=4, scale=256)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where(finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), floored(rows, "embedding", 256).alias("x")))


def op13_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets(table(spark, folder, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s.kind.isin(*kinds))

    def digest(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(digest(of(*KINDS[:3])), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
        F.size(of(KINDS[3])).cast("long").alias(f"n_{KINDS[3]}"),
    )


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_html_text": op4_html_text,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_nearest": op9_nearest,
    "op10_url_filter": op10_url_filter,
    "op11_whitening": op11_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_secret_scans": op13_secret_scans,
    "pipeline": pipeline,
}

SUBSTRING_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM words WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS run FROM starts
), repeated AS (
  SELECT a.doc_id, a.i
  FROM windows a JOIN (SELECT run, min(doc_id) AS least FROM windows GROUP BY run) b USING (run)
  WHERE b.least < a.doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM repeated
), gone_lists AS (
  SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(
         list_filter(w, lambda x, k: ks IS NULL OR NOT list_contains(ks, k)), ' '), '')) AS kept_sha256
FROM words LEFT JOIN gone_lists USING (doc_id)
"""

URL_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), '') AS raw_host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2), '') AS path
  FROM pages
), hosts AS (
  SELECT *, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts
), rules(verdict, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), ruled AS (
  SELECT hosts.*,
    (SELECT max({'size': length(h || p), 'allow': verdict = 'allow', 'rule': h || p}) FROM rules
     WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS fit
  FROM hosts
), links AS (
  SELECT *, list_concat(
    list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<link\s[^<>]*>'),
      lambda t: regexp_matches(t, '(?i)\srel\s*=\s*["'']?canonical["''\s/>]')),
      lambda t: regexp_extract(t, '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<meta\s[^<>]*>'),
      lambda t: regexp_matches(t, '(?i)\shttp-equiv\s*=\s*["'']?refresh["''\s/>]')),
      lambda t: regexp_extract(t, '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1))) AS targets
  FROM ruled
), addresses AS (
  SELECT page_id, 0 AS kind, host, path, url AS address FROM links
  UNION ALL
  SELECT page_id, 1, host, path, replace(target, '&amp;', '&')
  FROM (SELECT page_id, host, path, unnest(targets) AS target FROM links WHERE contains(url, '://')) WHERE target <> ''
), full_addresses AS (
  SELECT page_id, kind, CASE
    WHEN contains(address, '://') THEN address
    WHEN kind = 0 THEN NULL
    WHEN starts_with(address, '//') THEN 'http:' || address
    WHEN starts_with(address, '/') THEN 'http://' || host || address
    ELSE 'http://' || host || regexp_replace(path, '[^/]*$', '') || address END AS a
  FROM addresses
), cut AS (
  SELECT page_id, kind,
    translate(regexp_extract(a, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
    regexp_extract(a, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2) AS p,
    regexp_replace(regexp_replace(coalesce(regexp_extract(a, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 3), ''),
      '(^\?|&)(utm_[^&=]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '^[?&]', '') AS q
  FROM full_addresses WHERE a IS NOT NULL
), nodes AS (
  SELECT page_id, kind, regexp_replace(h, '^(www|m)\.', '') || regexp_replace(p, '(/|\.html)$', '')
    || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS node
  FROM cut
), edges AS (
  SELECT x.node AS u, y.node AS v FROM nodes x JOIN nodes y USING (page_id) WHERE x.kind = 0 AND y.kind > 0 AND x.node <> y.node
), both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(node, other) AS (
  SELECT DISTINCT node, node FROM nodes
  UNION SELECT reach.node, both_ways.v FROM reach JOIN both_ways ON reach.other = both_ways.u
), stopped AS (
  SELECT DISTINCT node FROM nodes JOIN ruled USING (page_id) WHERE kind = 0 AND NOT fit.allow
), blocked AS (SELECT DISTINCT reach.node FROM reach JOIN stopped ON reach.other = stopped.node)
SELECT page_id, host, path, fit.rule AS rule,
  CASE WHEN fit IS NOT NULL THEN CASE WHEN fit.allow THEN 'allow' ELSE 'block' END
       WHEN blocked.node IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN (SELECT page_id, node FROM nodes WHERE kind = 0) USING (page_id) LEFT JOIN blocked USING (node)
"""

NEGATIVES_SQL = """
WITH rows AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
         CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
) WHERE rank <= 10
"""

ORACLE: dict[str, str] = {
    "op12_hard_negatives": NEGATIVES_SQL,
    "op8_substring_dedup": SUBSTRING_SQL,
    "op10_url_filter": URL_SQL,
}
