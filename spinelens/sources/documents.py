"""Detection and keypoints documents, checked on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinelens import schemas, vocab
from spinelens.functions import points as P

_VERTEBRA_OK = (
    "v -> v.label IS NOT NULL AND v.confidence IS NOT NULL AND v.bbox IS NOT NULL"
    " AND v.keypoints IS NOT NULL"
    " AND forall(v.keypoints, k -> k.x IS NOT NULL AND k.y IS NOT NULL)"
)
_CFH_OK = (
    "(cfh IS NULL OR (cfh.confidence IS NOT NULL AND cfh.bbox IS NOT NULL"
    " AND cfh.center.x IS NOT NULL AND cfh.center.y IS NOT NULL))"
)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detection documents, one JSON file each."""
    return (
        spark.read.schema(schemas.with_corrupt(schemas.DETECTIONS))
        .option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    )


def parse_detections(texts: DataFrame, column: str = "value") -> DataFrame:
    """Detection documents from a column of JSON texts."""
    parsed = F.from_json(column, schemas.with_corrupt(schemas.DETECTIONS),
                         {"columnNameOfCorruptRecord": "_corrupt_record"})
    return texts.select(parsed.alias("doc")).select("doc.*")


def check_detections(documents: DataFrame) -> DataFrame:
    """Adds ``problem``: the required part a document lacks, else NULL."""
    return documents.withColumn("problem", F.expr(
        "CASE WHEN _corrupt_record IS NOT NULL THEN 'not a detection document'"
        " WHEN image_width IS NULL OR image_height IS NULL THEN 'image size missing'"
        " WHEN vertebrae IS NULL THEN 'vertebrae missing'"
        f" WHEN NOT forall(vertebrae, {_VERTEBRA_OK}) THEN 'incomplete vertebra'"
        f" WHEN NOT {_CFH_OK} THEN 'incomplete cfh' END"))


def valid_detections(checked: DataFrame) -> DataFrame:
    return checked.filter("problem IS NULL").drop("problem", "_corrupt_record")


def rejected_detections(checked: DataFrame) -> DataFrame:
    return checked.filter("problem IS NOT NULL").select("image_id", "problem", "_corrupt_record")


def explode_detections(documents: DataFrame) -> DataFrame:
    """Valid detection documents as detection rows in list order."""
    return documents.selectExpr(
        "image_id", "image_width", "image_height", "posexplode(vertebrae) AS (det_idx, v)"
    ).selectExpr("image_id", "det_idx", "v.label AS label", "v.confidence AS confidence",
                 "v.bbox AS bbox", "v.keypoints AS keypoints", "image_width", "image_height")


def with_document_defaults(documents: DataFrame) -> DataFrame:
    """Keypoints documents with the default image id, standard distance and its points."""
    points = ", ".join(P.point(str(x), str(y)) for x, y in vocab.DEFAULT_STANDARD_POINTS)
    defaults = {
        "imageId": f"coalesce(imageId, '{vocab.DEFAULT_IMAGE_ID}')",
        "standardDistance": f"coalesce(standardDistance, {vocab.DEFAULT_STANDARD_DISTANCE}D)",
        "standardDistancePoints": f"coalesce(standardDistancePoints, array({points}))",
    }
    return documents.selectExpr(*[
        f"{defaults[c]} AS {c}" if c in defaults else c for c in documents.columns])


def read_keypoint_docs(spark: SparkSession, path: str) -> DataFrame:
    """Keypoints documents with defaults; documents without size or measurements are left to
    :func:`keypoint_doc_problem`."""
    docs = (
        spark.read.schema(schemas.with_corrupt(schemas.KEYPOINTS_DOC))
        .option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    )
    return with_document_defaults(docs)


def keypoint_doc_problem(documents: DataFrame) -> DataFrame:
    """Adds ``problem``: the required part a keypoints document lacks, else NULL."""
    return documents.withColumn("problem", F.expr(
        "CASE WHEN _corrupt_record IS NOT NULL THEN 'not a keypoints document'"
        " WHEN imageWidth IS NULL OR imageHeight IS NULL THEN 'image size missing'"
        " WHEN measurements IS NULL THEN 'measurements missing'"
        " WHEN NOT forall(measurements, m -> m.type IS NOT NULL AND m.points IS NOT NULL"
        " AND forall(m.points, p -> p.x IS NOT NULL AND p.y IS NOT NULL))"
        " THEN 'incomplete measurement' END"))


def explode_measurements(documents: DataFrame) -> DataFrame:
    """Keypoints documents as measurement rows in document order."""
    return documents.selectExpr(
        "imageId AS image_id", "posexplode(measurements) AS (ord, m)"
    ).selectExpr("image_id", "ord", "m.type AS type", "m.points AS points")
