"""Registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import (
    alignment,
    co_training,
    decontamination,
    hard_negatives,
    html_extraction,
    kneser_ney,
    near_dedup,
    packing,
    pii,
    quality_rules,
    suffix_dedup,
    token_counts,
    token_orc,
)
from marketlens.llm.common import documents, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op2_token_orc(spark, folder):
    path = scratch(spark, "tokens")
    token_orc.write_tokens(documents(spark, folder), path)
    rows = token_orc.read_tokens(spark, path)
    return token_orc.with_starts(token_orc.checksums(rows), rows).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op5_token_counts(spark, folder):
    return token_counts.token_counts(documents(spark, folder))


@query
def op6_packing(spark, folder):
    return packing.packed(documents(spark, folder))


@query
def op8_near_dedup(spark, folder):
    return near_dedup.near_duplicates(documents(spark, folder))


@query
def op1_suffix_dedup(spark, folder):
    return suffix_dedup.digests(documents(spark, folder))


@query
def op4_lm_scores(spark, folder):
    return kneser_ney.held_out_scores(documents(spark, folder))


def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


@query
def op7_quality_classifier(spark, folder):
    docs = documents(spark, folder)
    return co_training.scores(docs, co_training.train(docs, labels(spark, folder)))


def benchmark(spark, folder):
    return spark.read.parquet(f"{folder}/benchmark.parquet")


@query
def op9_decontamination(spark, folder):
    return decontamination.contaminated(documents(spark, folder), benchmark(spark, folder))


@query
def op3_quality_rules(spark, folder):
    return quality_rules.judged(documents(spark, folder), labels(spark, folder))


@query
def op10_pii(spark, folder):
    return pii.replaced(documents(spark, folder))


@query
def op11_hard_negatives(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.col("label").cast("long")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(hard_negatives.prepared(moved))


ORACLE["op11_hard_negatives"] = """
WITH taking AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scores AS (
  SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM taking a JOIN taking b ON a.id % 100 = 0 AND a.id <> b.id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p
JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id) <= 10
"""


@query
def op12_alignment(spark, folder):
    return alignment.link_scores(documents(spark, folder))


@query
def op13_html_extraction(spark, folder):
    return html_extraction.extracted(spark.read.parquet(f"{folder}/pages.parquet"))
