"""Metrics of documents that arrive as JSON files.

Each document is one row and everything it needs is inside the row, so the stream keeps no state
and shuffles nothing; the batch operators run unchanged on it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spinelens import schemas
from spinelens.operators import measurements as M
from spinelens.operators import metrics as X
from spinelens.sources import documents as D


def stream_detections(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Arriving detection documents, checked: ``problem`` is NULL for a valid one."""
    stream = (
        spark.readStream.schema(schemas.with_corrupt(schemas.DETECTIONS))
        .option("multiLine", True).option("mode", "PERMISSIVE")
        .option("maxFilesPerTrigger", files_per_trigger).json(path)
    )
    return D.check_detections(stream)


def stream_keypoint_docs(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Arriving keypoints documents with defaults, checked."""
    stream = (
        spark.readStream.schema(schemas.with_corrupt(schemas.KEYPOINTS_DOC))
        .option("multiLine", True).option("mode", "PERMISSIVE")
        .option("maxFilesPerTrigger", files_per_trigger).json(path)
    )
    return D.keypoint_doc_problem(D.with_document_defaults(stream))


def measurements_of(detections: DataFrame) -> DataFrame:
    """Keypoints documents of valid detection documents; batch or stream."""
    return M.measurements_nested(M.spine_from_documents(D.valid_detections(detections)))


def metrics_of(keypoint_docs: DataFrame) -> DataFrame:
    """Metrics documents of valid keypoints documents; batch or stream."""
    if "problem" in keypoint_docs.columns:
        keypoint_docs = keypoint_docs.filter("problem IS NULL")
    return X.to_document(X.metrics_from_documents(keypoint_docs), key="imageId")


def start_metrics(
    documents: DataFrame, out: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append the metrics documents of a checked detection stream to ``out`` as JSON.

    Rejected documents are not in it; ``start_documents`` writes both in one query.
    """
    writer = (
        metrics_of(measurements_of(documents)).writeStream.format("json")
        .outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def rejects_of(detections: DataFrame) -> DataFrame:
    """``image_id, problem, _corrupt_record`` of all documents that give no metrics; batch or stream."""
    wrong = M.rejects(M.spine_from_documents(D.valid_detections(detections)))
    return D.rejected_detections(detections).unionByName(wrong.selectExpr(
        "image_id", "reason AS problem", "CAST(NULL AS STRING) AS _corrupt_record"))


def start_documents(
    documents: DataFrame, out: str, rejects: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """One query that writes the metrics documents of a checked detection stream to ``out`` and all others to ``rejects``.

    Each batch is parsed once, held while both sinks are written, and let go. A batch has a directory ``batch=<id>``
    in either sink, which a replayed batch writes anew, so nothing is there twice. Every document is in one of the two.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            metrics_of(measurements_of(held)).write.mode("overwrite").json(f"{out}/batch={batch_id}")
            rejects_of(held).write.mode("overwrite").json(f"{rejects}/batch={batch_id}")
        finally:
            held.unpersist()

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_rejects(
    documents: DataFrame, out: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append the rejected documents of a checked detection stream, with their problems, to ``out``."""
    writer = (
        D.rejected_detections(documents).writeStream.format("json")
        .outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
