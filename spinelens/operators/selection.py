"""Choice of the samples a dataset is built from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def selection_status(audit: DataFrame) -> DataFrame:
    """Every sample in exactly one of three groups. Point completeness is not required."""
    return audit.selectExpr(
        "sample_id",
        "CASE WHEN NOT has_annotation THEN 'no_annotation'"
        " WHEN NOT poly_complete THEN 'incomplete' ELSE 'valid' END AS status",
        "CASE WHEN has_annotation THEN size(missing_poly) END AS missing_count",
        "CASE WHEN has_annotation THEN missing_poly END AS missing_labels",
    )


def valid_samples(selection: DataFrame) -> DataFrame:
    return selection.filter("status = 'valid'").select("sample_id")


def selection_counts(selection: DataFrame) -> DataFrame:
    """Totals and percentages of the selection in one row."""
    return selection.agg(
        F.expr("count(1) AS total_samples"),
        F.expr("count_if(status = 'valid') AS valid_count"),
        F.expr("count_if(status <> 'valid') AS excluded_count"),
        F.expr("count_if(status = 'no_annotation') AS no_annotation_count"),
        F.expr("count_if(status = 'incomplete') AS incomplete_count"),
    ).selectExpr(
        "*", "try_divide(valid_count * 100e0, total_samples) AS valid_pct",
        "try_divide(excluded_count * 100e0, total_samples) AS excluded_pct",
    )


def sorted_selection(selection: DataFrame, status: str) -> DataFrame:
    """One group in report order: most missing labels first, then by sample id."""
    return selection.filter(F.col("status") == status).orderBy(
        F.desc_nulls_last("missing_count"), "sample_id")
