"""The ten operators as queries over the driver's tables, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, language, confidence, accepted) of every document."""
    from segtide.llm import language_id

    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, hits, quoted_hits, terms) of the documents found toxic, by terms learnt from the labelled ones."""
    from segtide.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    terms = toxicity.learn_lexicon(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, toxicity.compile_automaton(terms))


#: Places blocked and allowed in ``pages``; nested on purpose, so that precedence matters.
URL_ENTRIES = (
    ("example.net", "block"), ("m.tionsh.example.net", "allow"), ("blog.example.net", "allow"), ("tionsh.example.net/en", "allow"),
    ("example.net/es", "allow"), ("tionsh.example.net/en/1", "block"), ("adult-x.example.com", "block"), ("free-bets.example.com", "block"),
    ("adult-x.example.org", "block"), ("free-bets.example.org", "block"), ("example.com/de", "block"), ("ththon.example.com/de", "allow"),
    ("ththon.example.com", "block"), ("ththan.example.com/fr", "block"), ("www.example.org", "allow"), ("example.org/fr", "block"),
)


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, verdict, entry, kept) of every page."""
    from segtide.llm import url_filter

    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_ENTRIES)


ORACLES["op7_url_filter"] = rf"""
WITH rules(entry, verdict) AS (VALUES {", ".join(f"('{e}', '{v}')" for e, v in URL_ENTRIES)}),
r AS (
  SELECT entry, verdict, split_part(entry, '/', 1) AS host,
         list_filter(string_split(entry, '/')[2:], lambda x: x <> '') AS segs
  FROM rules),
p AS (
  SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS segs
  FROM pages),
m AS (
  SELECT p.page_id, r.entry, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY len(string_split(r.host, '.')) DESC, len(r.segs) DESC, r.verdict DESC) AS k
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND p.segs[1:len(r.segs)] = r.segs)
SELECT p.page_id, CASE WHEN p.host = '' THEN 'invalid' ELSE coalesce(m.verdict, 'allow') END AS verdict, m.entry AS entry,
       CASE WHEN p.host = '' THEN false ELSE coalesce(m.verdict, 'allow') = 'allow' END AS kept
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
"""


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, epoch, block, key, tokens) each time that the mixture takes a document."""
    from segtide.llm import mixing

    return mixing.plan(table(spark, sf_dir, "documents"))


ORACLES["op6_mixing"] = r"""
WITH RECURSIVE counted AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^ \t\n\r]+')) AS BIGINT) AS n
  FROM documents WHERE len(regexp_extract_all(text, '[^ \t\n\r]+')) > 0),
sizes AS MATERIALIZED (SELECT source, CAST(sum(n) AS BIGINT) AS size FROM counted GROUP BY source),
all_of AS MATERIALIZED (
  SELECT CAST(sum(size) AS DOUBLE) AS budget, count(*) AS k, list(size / (SELECT CAST(sum(size) AS DOUBLE) FROM sizes)) AS shares FROM sizes),
bisect(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN even THEN (lo + hi) / 2 ELSE lo END, CASE WHEN even THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, ln(list_sum(p)) - list_sum(list_transform(p, lambda x: x * ln(x))) / list_sum(p) >= 0.98 * ln(k) AS even
        FROM (SELECT i, lo, hi, k, list_transform(shares, lambda x: pow(x, (lo + hi) / 2)) AS p FROM bisect, all_of WHERE i < 60))),
whole AS (SELECT -list_sum(list_transform(shares, lambda x: x * ln(x))) >= 0.98 * ln(k) AS even FROM all_of),
first_alpha AS MATERIALIZED (SELECT CASE WHEN k < 2 OR even THEN 1.0 ELSE lo END AS alpha FROM bisect, whole, all_of WHERE i = 60),
rare(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN lo ELSE (lo + hi) / 2 END, CASE WHEN good THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT i, lo, hi, list_max(list_transform(shares, lambda x: pow(x, (lo + hi) / 2) / s / x)) <= 4.0 AS good
        FROM (SELECT i, lo, hi, shares, list_sum(list_transform(shares, lambda x: pow(x, (lo + hi) / 2))) AS s FROM rare, all_of WHERE i < 60))),
chosen AS MATERIALIZED (
  SELECT CASE WHEN list_max(list_transform(shares, lambda x: pow(x, alpha) / s / x)) <= 4.0 THEN alpha ELSE hi END AS alpha
  FROM (SELECT *, list_sum(list_transform(shares, lambda x: pow(x, alpha))) AS s FROM first_alpha, all_of), rare WHERE i = 60),
goals AS MATERIALIZED (
  SELECT source, size, CAST(floor(pow(size / budget, alpha) / (SELECT sum(pow(size / budget, alpha)) FROM sizes) * budget + 0.5) AS BIGINT) AS goal
  FROM sizes, all_of, chosen),
taken AS (
  SELECT doc_id, source, n, size, goal, CAST(unnest(range(0, (goal - 1) // size + 1)) AS INTEGER) AS epoch
  FROM counted JOIN goals USING (source) WHERE goal > 0),
placed AS (
  SELECT *, epoch * size + sum(n) OVER (PARTITION BY source, epoch ORDER BY md5('17:' || epoch || ':' || doc_id), doc_id, n) - sum(n) OVER (PARTITION BY source, epoch, doc_id, n) AS place FROM taken)
SELECT doc_id, source, epoch, CAST(place * 64 // goal AS INTEGER) AS block,
       md5('17:' || (place * 64 // goal) || ':' || epoch || ':' || doc_id) AS key, n AS tokens
FROM placed WHERE place < goal
"""


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bin, doc_id, copy, piece, start, length, place) of every piece of every document."""
    from segtide.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, kept) of every document, by a model of the labelled ones."""
    from segtide.llm import quality_classifier

    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


@query
def op8_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, distance, kept) of every document."""
    from segtide.llm import outliers

    return outliers.reject(table(spark, sf_dir, "documents"))


@query
def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kept_id) of every near-duplicate document and the document of its group that stays."""
    from segtide.llm import near_dup

    return near_dup.find_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without the lines that repeat, exactly or nearly, a line that stays elsewhere."""
    from segtide.llm import line_dedup

    return line_dedup.drop_repeats(table(spark, sf_dir, "documents"), short_exact=True)


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, class_id, copies, links) of every embedding, linked by a cosine similarity of at least 0.9."""
    from segtide.llm import embedding_dedup

    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
