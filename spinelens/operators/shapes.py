"""Annotation documents -> shapes, and the shape filters of each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spinelens import vocab
from spinelens.functions import points as P


def explode_shapes(docs: DataFrame) -> DataFrame:
    """One row per shape, with its index in the document; documents without shapes give none."""
    passed = [c for c in docs.columns if c not in ("shapes", "_corrupt_record")]
    return docs.selectExpr(
        *passed, "posexplode(shapes) AS (shape_idx, shape)"
    ).selectExpr(
        *passed, "shape_idx", "shape.label AS label", "shape.shape_type AS shape_type",
        f"{P.points_from_pairs('shape.points')} AS points",
    )


def audited_shapes(shapes: DataFrame) -> DataFrame:
    """Shapes the audit looks at: labelled polygons and points."""
    return shapes.filter("label IS NOT NULL AND label <> '' AND shape_type IN ('polygon', 'point')")


def training_polygons(shapes: DataFrame) -> DataFrame:
    """Polygons of the pose build: at least four vertices and an ordinary vertebra label."""
    excluded = ", ".join(f"'{x}'" for x in vocab.NON_POLYGON_LABELS)
    return shapes.filter(
        f"shape_type = 'polygon' AND NOT coalesce(label IN ({excluded}), false)"
        " AND size(points) >= 4")


def single_point_labels(shapes: DataFrame) -> DataFrame:
    """Femoral-head points of the keypoint build: point shapes with at least one coordinate."""
    return shapes.filter(
        f"label = '{vocab.CFH_LABEL}' AND shape_type = 'point' AND size(points) > 0")


def loose_point_labels(shapes: DataFrame) -> DataFrame:
    """Femoral-head points of the box build: any shape type, several per document allowed."""
    return shapes.filter(f"label = '{vocab.CFH_LABEL}' AND size(points) > 0")


def reference_shapes(shapes: DataFrame) -> DataFrame:
    """Shapes whose height scales the boxes: any other label, any type, at least four points."""
    return shapes.filter(
        f"coalesce(label, '') <> '{vocab.CFH_LABEL}' AND size(points) >= 4")
