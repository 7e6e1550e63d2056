"""From raw documents to packed training windows: five stages, each on all that the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinelens.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from spinelens.llm._store import ensure_checkpoint_dir, settle, sized

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_KEY = line_dedup.row_key("doc_id", "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``row_key`` is in ``gone``; rows equal in id and text share a key."""
    gone = settle(gone.select(F.col("row_key").alias("__row")).distinct())
    return docs.withColumn("__row", F.expr(_KEY)).join(sized(gone), "__row", "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs of their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed = docs.withColumn("row_key", F.expr(_KEY))
    verdicts = quality_rules.judge(keyed, labels, keep=("row_key",))
    return _without(docs, verdicts.where("NOT kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line makes superfluous; emptied documents go."""
    kept = line_dedup.without_lines(docs, line_dedup.duplicate_lines(docs))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, similarity 0.8."""
    found = near_dedup.near_duplicates(docs, k=5, percent=80)
    gone = settle(found.where("NOT kept").select("doc_id").distinct())
    return docs.join(sized(gone), "doc_id", "left_anti").select(*COLUMNS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items, also not with other numbers, names or units."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.leaks(docs, benchmark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in full windows, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near_copies),
    ("decontamination", benchmarks),
    ("packing", packed),
]

#: Near-duplicate components, cutoffs under binomial bounds and token ids are beyond SQL. tests/llm holds the near
#: copies against brute force, the quality stage against op3, and checks that no verbatim item and no document is lost or left.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
