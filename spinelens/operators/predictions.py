"""Sampling and summary of a batch prediction run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinelens import vocab


def sample_images(images: DataFrame, n: int, key: Column | None = None, seed: int = 42) -> DataFrame:
    """``n`` images without replacement (all of them if there are fewer), repeatable by seed.

    A top-k over a hash of the image id; no full sort and no row order involved.
    """
    draw = key if key is not None else F.xxhash64(F.lit(seed), "image_id")
    return images.withColumn("__draw", draw).orderBy("__draw", "image_id").limit(n).drop("__draw")


def prediction_stats(
    sampled: DataFrame, vertebrae: DataFrame, cfh: DataFrame,
    threshold: float = vocab.BATCH_CONFIDENCE,
) -> DataFrame:
    """The four counters of a run.

    Every sampled image counts, also one without any detection. All three inputs go through one
    global aggregate.
    """
    wanted = sampled.select("image_id")
    counted = ["total_images", "corner_detections", "corner_keypoints", "cfh_detections"]

    def ones(df: DataFrame, **values: str) -> DataFrame:
        return df.selectExpr(*[f"CAST({values.get(c, '0')} AS BIGINT) AS {c}" for c in counted])

    def detected(df: DataFrame) -> DataFrame:
        return df.filter(F.col("confidence") >= threshold).join(wanted, "image_id", "left_semi")

    rows = (
        ones(wanted, total_images="1")
        .unionByName(ones(detected(vertebrae), corner_detections="1",
                          corner_keypoints="coalesce(size(keypoints), 0)"))
        .unionByName(ones(detected(cfh), cfh_detections="1"))
    )
    return rows.agg(*[F.expr(f"coalesce(sum({c}), 0L) AS {c}") for c in counted])


def prediction_ratios(stats: DataFrame) -> DataFrame:
    """Detections per image and keypoints per detection, 0 for an empty denominator."""
    def ratio(num: str, den: str) -> str:
        return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / {den} ELSE 0e0 END"

    return stats.selectExpr(
        "*", f"{ratio('corner_detections', 'total_images')} AS vertebrae_per_image",
        f"{ratio('corner_keypoints', 'corner_detections')} AS keypoints_per_vertebra",
    )


def detection_total(boxes: DataFrame) -> DataFrame:
    """Number of boxes of a run."""
    return boxes.agg(F.expr("count(1) AS total_detections"))
