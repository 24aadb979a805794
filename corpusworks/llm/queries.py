"""The registered query of each operator: production parameters, the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusworks.llm import ann, decontam, html, langid, mixing, pii, quality, secrets, simhash, spelling, substrings, toxicity, whitening
from corpusworks.llm.common import remainder, table

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def held_out(modulus: int, fold: int):
    return F.coalesce(remainder("doc_id", modulus) == fold, F.lit(False)).alias("held_out")


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain: the language of the documents that ``labels`` covers."""
    covered = labels.select("doc_id").where("doc_id is not null").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(covered, "doc_id", "left_semi")


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, domain_labels(docs, table(spark, sf_dir, "labels")))


@query
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.learn(pages))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.learn(docs))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = substrings.cut(docs, substrings.repeats(docs))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op5_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d
), w AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i:i + 19], ' ')) AS h FROM p WHERE i + 19 <= len(ws)
), late AS (
  SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM late
), kept AS (
  SELECT p.doc_id, count(*) AS n, string_agg(p.ws[p.i], ' ' ORDER BY p.i) AS t
  FROM p ANTI JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", held_out(4, 2), "lang_pred", "score")


@query
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


SQL["op10_neighbours"] = """
WITH v AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id)::INT AS rank,
       c.vec_id, list_inner_product(q.e, c.e) AS score
FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0
QUALIFY rank <= 20
"""


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents")).select("*", F.filter("spans", lambda s: s["base"]).alias("base"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda k: k == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
