"""Explicit schemas for every reader; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

KEYPOINT = T.StructType([
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("v", T.IntegerType()),
])

RAW_SHAPE = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("shape_type", T.StringType()),
    T.StructField("points", T.ArrayType(T.ArrayType(T.DoubleType()))),
])

ANNOTATION = T.StructType([
    T.StructField("shapes", T.ArrayType(RAW_SHAPE)),
    T.StructField("imagePath", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

VERTEBRA = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("keypoints", T.ArrayType(POINT)),
])

CFH = T.StructType([
    T.StructField("confidence", T.DoubleType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("center", POINT),
])

DETECTIONS = T.StructType([
    T.StructField("image_id", T.StringType()),
    T.StructField("image_width", T.IntegerType()),
    T.StructField("image_height", T.IntegerType()),
    T.StructField("vertebrae", T.ArrayType(VERTEBRA)),
    T.StructField("cfh", CFH),
])

MEASUREMENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("points", T.ArrayType(POINT)),
])

KEYPOINTS_DOC = T.StructType([
    T.StructField("imageId", T.StringType()),
    T.StructField("imageWidth", T.IntegerType()),
    T.StructField("imageHeight", T.IntegerType()),
    T.StructField("measurements", T.ArrayType(MEASUREMENT)),
    T.StructField("standardDistance", T.DoubleType()),
    T.StructField("standardDistancePoints", T.ArrayType(POINT)),
])


def with_corrupt(schema: T.StructType) -> T.StructType:
    """``schema`` plus the column that keeps the text of an unparsable document."""
    return T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
