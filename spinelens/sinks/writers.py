"""Writers. Tables go to Parquet; text and JSON forms are exports of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens.operators import audit as audits
from spinelens.operators import datasets
from spinelens.sinks import label_files


def write_audit(audit: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Per-sample records and, from the saved records, the corpus summary."""
    audit.write.mode(mode).parquet(f"{path}/audit_samples")
    saved = audit.sparkSession.read.parquet(f"{path}/audit_samples")
    audits.summary_rates(audits.audit_summary(saved)).write.mode(mode).json(f"{path}/audit_summary")


def write_selection(selection: DataFrame, path: str, mode: str = "errorifexists") -> None:
    selection.write.mode(mode).partitionBy("status").parquet(path)


def write_label_membership(members: DataFrame, path: str, mode: str = "errorifexists") -> None:
    members.write.mode(mode).parquet(path)


def write_pose_labels(labels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Typed label rows, the canonical form of a label dataset."""
    labels.write.mode(mode).parquet(path)


def export_label_text(
    labels: DataFrame, path: str, keypoints: bool = True, mode: str = "errorifexists"
) -> None:
    """One file ``<stem>.txt`` with the label lines of an image, in order, for datasets handed to a trainer."""
    lines = datasets.with_line(labels, keypoints).select("stem", "line_no", "line")
    label_files.write_label_files(lines, path, mode)


def write_detections_csv(flat: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Flat detections with a header line."""
    columns = ["image", "x1", "y1", "x2", "y2", "confidence", "center_x", "center_y"]
    flat.select(*columns).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Documents and counters as JSON lines."""
    df.write.mode(mode).json(path)


def write_text(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    df.select(F.col(column).cast("string")).write.mode(mode).text(path)
