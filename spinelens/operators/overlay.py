"""Pixel geometry of label rows and detections, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens import vocab
from spinelens.functions import boxes as B
from spinelens.functions import names
from spinelens.functions import points as P


def one_image(df: DataFrame, stem: str) -> DataFrame:
    return df.filter(F.col("stem") == stem)


def on_images(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Label rows with the size of their image; ``images`` holds one row per stem, and a stem with
    very many rows is split by the skew join."""
    return labels.join(images.select("stem", "width", "height"), "stem")


def overlay_boxes(sized: DataFrame) -> DataFrame:
    """Integer box corners and class name of each label row."""
    x1, x2 = B.pixel_corner("cx", "w", "width")
    y1, y2 = B.pixel_corner("cy", "h", "height")
    return sized.selectExpr(
        "stem", "line_no", "class_id", f"{names.class_name()} AS label",
        f"{x1} AS x1", f"{y1} AS y1", f"{x2} AS x2", f"{y2} AS y2",
    )


def _visible(sized: DataFrame) -> DataFrame:
    pixels = (
        "transform(filter(keypoints, k -> k.v > 0), k -> named_struct("
        "'x', CAST(k.x * width AS INT), 'y', CAST(k.y * height AS INT)))"
    )
    return sized.selectExpr("stem", "line_no", "class_id", f"{pixels} AS visible")


def overlay_points(sized: DataFrame) -> DataFrame:
    """Integer pixel position of every visible keypoint, numbered within its label row."""
    return _visible(sized).selectExpr(
        "stem", "line_no", "class_id", "posexplode(visible) AS (k, p)"
    ).selectExpr("stem", "line_no", "class_id", "k + 1 AS point_no", "p.x AS x", "p.y AS y")


def overlay_edges(sized: DataFrame) -> DataFrame:
    """Outline segments of the label rows that have all four keypoints visible."""
    quads = sized.filter("size(keypoints) = 4 AND " + " AND ".join(
        f"get(keypoints, {i}).v > 0" for i in range(4)))
    corners = quads.selectExpr("stem", "line_no", "class_id", *[
        f"CAST(get(keypoints, {i}).{c} * {extent} AS INT) AS {c}{i}"
        for i in range(4) for c, extent in (("x", "width"), ("y", "height"))])
    edges = ", ".join(f"{i}, x{i}, y{i}, x{(i + 1) % 4}, y{(i + 1) % 4}" for i in range(4))
    return corners.selectExpr(
        "stem", "line_no", "class_id", f"stack(4, {edges}) AS (edge, x1, y1, x2, y2)")


def prediction_edges(
    detections: DataFrame, confidence: float = vocab.SINGLE_CONFIDENCE,
    keypoint_confidence: float = vocab.KEYPOINT_CONFIDENCE,
) -> DataFrame:
    """Outline of each detection over its confident keypoints, closed from two points on.

    ``keypoints`` are pixel points with a confidence ``c``.
    """
    confident = (
        f"transform(filter(keypoints, k -> k.c > {keypoint_confidence!r}D), k -> named_struct("
        "'x', CAST(k.x AS INT), 'y', CAST(k.y AS INT)))"
    )
    return detections.filter(F.col("confidence") >= confidence).selectExpr(
        "image_id", "det_idx", f"{confident} AS visible"
    ).selectExpr(
        "image_id", "det_idx",
        f"inline(CASE WHEN size(visible) >= 2 THEN {P.quad_edges('visible')} END)"
    ).selectExpr("image_id", "det_idx", "edge", "start.x AS x1", "start.y AS y1",
                 "stop.x AS x2", "stop.y AS y2")


def known_class_only(df: DataFrame) -> DataFrame:
    """Rows of detector classes; batch drawing leaves the others out."""
    return df.withColumn("label", F.expr(names.class_name("class_id", None))).filter(
        "label IS NOT NULL")
