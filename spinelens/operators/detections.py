"""Detector boxes -> normalised detections, flat rows and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens import vocab
from spinelens.functions import names
from spinelens.operators.measurements import first_box

NORMALISED_BOX = (
    "array((x1 + x2) / 2 / image_width, (y1 + y2) / 2 / image_height,"
    " (x2 - x1) / image_width, (y2 - y1) / image_height)"
)


def confident(boxes: DataFrame, threshold: float) -> DataFrame:
    return boxes.filter(F.col("confidence") >= threshold)


def normalise_vertebrae(
    boxes: DataFrame, threshold: float = vocab.VERTEBRA_CONFIDENCE
) -> DataFrame:
    """Confident boxes as detections: class name, normalised centre/size box and keypoints.

    ``keypoints_px`` is optional.
    """
    kept = confident(boxes, threshold)
    keypoints = []
    if "keypoints_px" in boxes.columns:
        keypoints = ["transform(keypoints_px, k -> named_struct("
                     "'x', k.x / image_width, 'y', k.y / image_height)) AS keypoints"]
    return kept.selectExpr(
        "image_id", "det_idx", f"{names.class_name()} AS label", "confidence",
        f"{NORMALISED_BOX} AS bbox", *keypoints, "image_width", "image_height",
    )


def normalise_cfh(boxes: DataFrame, threshold: float = vocab.CFH_CONFIDENCE) -> DataFrame:
    """The femoral head of each image: the first of its confident boxes."""
    first = first_box(confident(boxes, threshold))
    return first.selectExpr(
        "image_id", "det_idx", "confidence", f"{NORMALISED_BOX} AS bbox",
        "image_width", "image_height",
    ).withColumn("center", F.expr("named_struct('x', bbox[0], 'y', bbox[1])"))


def attach_cfh(images: DataFrame, cfh: DataFrame) -> DataFrame:
    """Image rows with their optional femoral head as a nullable struct."""
    return images.join(
        cfh.selectExpr("image_id", "struct(confidence, bbox, center) AS cfh"), "image_id", "left")


def detection_documents(
    images: DataFrame, vertebrae: DataFrame, cfh: DataFrame, most: int = 300
) -> dict[str, DataFrame]:
    """One detection document per image of ``images`` (image_id, image_width, image_height).

    ``documents``: the normalised vertebra detections in detection order (empty for an image without any), the optional
    femoral head, and the size. A document holds at most ``most`` detections, as many as the detector returns for an
    image; the detections of images with more are the rows of ``overflow``, and their documents hold none
    (``n_vertebrae`` tells). So no image gathers more than a bounded list.
    """
    counts = vertebrae.groupBy("image_id").agg(F.expr("count(1) AS n_vertebrae"))
    sized = vertebrae.drop("image_width", "image_height").join(counts, "image_id")
    fields = [c for c in sized.columns if c not in ("image_id", "n_vertebrae")]
    gathered = sized.where(F.col("n_vertebrae") <= most).groupBy("image_id").agg(
        F.expr(f"sort_array(collect_list(struct(det_idx, {', '.join(c for c in fields if c != 'det_idx')}))) AS vertebrae"))
    told = images.join(counts, "image_id", "left").join(gathered, "image_id", "left")
    kind = gathered.schema["vertebrae"].dataType.simpleString()
    documents = attach_cfh(told, cfh).selectExpr(
        "image_id", "coalesce(n_vertebrae, 0L) AS n_vertebrae",
        f"coalesce(vertebrae, CAST(array() AS {kind})) AS vertebrae", "cfh", "image_width", "image_height")
    return {"documents": documents, "overflow": sized.where(F.col("n_vertebrae") > most).drop("n_vertebrae")}


def detections_flat(boxes: DataFrame) -> DataFrame:
    """One output row per box with its pixel centre."""
    return boxes.selectExpr(
        "image", "x1", "y1", "x2", "y2", "confidence",
        "(x1 + x2) / 2 AS center_x", "(y1 + y2) / 2 AS center_y",
    )


def prediction_text(
    detections: DataFrame, threshold: float = vocab.SINGLE_CONFIDENCE
) -> DataFrame:
    """Text of each confident detection: a label line and a line per pixel keypoint."""
    lines = (
        "concat(array(concat(label, format_string(' %.4f', confidence))), transform(keypoints_px,"
        " (k, j) -> format_string('  Point%d: (%.2f, %.2f)', j + 1, k.x, k.y)))"
    )
    return confident(detections, threshold).selectExpr(
        "image_id", "det_idx", f"array_join({lines}, '\\n') AS text")
