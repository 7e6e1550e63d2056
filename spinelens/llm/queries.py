"""One registered query per operator, with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinelens.llm import (
    brown_lm, cross_tokenizer, decontaminate, fingerprints, hard_negatives, line_dedup, near_dedup, packing, quality_classifier,
    quality_rules, sharding, token_counts, url_filter,
)

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark, d):
    """Pieces of all documents in windows of at most 2048 tokens."""
    return packing.pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query
def op2_line_dedup(spark, d):
    """Every line that an earlier line makes superfluous, with that line."""
    return line_dedup.duplicate_lines(table(spark, d, "documents"), min_words=1, edit_words=2).drop("row_key")


@query
def op3_quality_rules(spark, d):
    """Base counts and verdict of every document."""
    return quality_rules.judge(table(spark, d, "documents"), table(spark, d, "labels")).drop("failed_rules")


@query
def op4_near_dedup(spark, d):
    """Components of documents whose two-word shingles agree to four fifths."""
    return near_dedup.near_duplicates(table(spark, d, "documents"), k=2, percent=80)


@query
def op5_sharding(spark, d):
    """Slot and shard of every document among 64 shards."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sharding.place(docs, [f"shard-{i:02}" for i in range(64)]).select("doc_id", "slot", "shard")


@query
def op6_token_counts(spark, d):
    """Tokens of every document, and whether they exceed 512."""
    counts = token_counts.token_counts(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op8_url_filter(spark, d):
    """Host, path, rule and verdict of every page."""
    return url_filter.judge_urls(table(spark, d, "pages")).drop("trust", "distrust")


@query
def op9_decontaminate(spark, d):
    """Benchmark items found in documents."""
    return decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("row_key")


@query
def op10_quality_classifier(spark, d):
    """Calibrated quality score of every document; positive from 0.3."""
    scores = quality_classifier.score_documents(table(spark, d, "documents"), table(spark, d, "labels"))
    return scores.withColumn("predicted", F.expr("CAST(score >= 0.3 AS INT)"))


@query
def op7_lm_scoring(spark, d):
    """Class-bigram and unigram log probabilities of every document."""
    return brown_lm.score_texts(table(spark, d, "documents"))


@query
def op11_cross_tokenizer(spark, d):
    """Groups, links and corpus-wide link counts of every document under two tokenizers."""
    return cross_tokenizer.align(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_fingerprints(spark, d):
    """Threshold-scaled fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.fingerprints(table(spark, d, "documents"))


@query
def op13_hard_negatives(spark, d):
    """Negatives just below each positive of every hundredth vector, some of whose labels are shifted."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    vectors = table(spark, d, "embeddings").withColumn("label", label)
    return hard_negatives.mine(vectors, anchor="vec_id % 100 = 0")
