"""What a user calls: each function joins the operators of one stage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spinelens import vocab
from spinelens.operators import audit as A
from spinelens.operators import datasets as B
from spinelens.operators import detections as D
from spinelens.operators import measurements as M
from spinelens.operators import merge as G
from spinelens.operators import metrics as X
from spinelens.operators import overlay as O
from spinelens.operators import predictions as R
from spinelens.operators import selection as S
from spinelens.operators import shapes as H
from spinelens.operators import validate as V


def audit_dataset(
    samples: DataFrame, images: DataFrame, docs: DataFrame, labels: A.Labels
) -> dict[str, DataFrame]:
    """Audit records, corpus summary and missing counts of nested annotation documents.

    ``labels`` is a vocabulary as read (a table), or a list."""
    poly, point = A.split_vocabulary(labels)
    audit = A.audit_samples(samples, images, docs, H.explode_shapes(docs), poly, point)
    return {
        "samples": audit,
        "summary": A.audit_summary(audit),
        "missing": A.missing_by_label(audit, poly, point),
    }


def audit_report_tables(
    audit: DataFrame, poly: A.Labels, point: A.Labels, k: int = 50
) -> dict[str, DataFrame]:
    """Tables of the audit report; pass a saved audit, which is read once per table."""
    summary = A.audit_summary(audit)
    missing = A.missing_by_label(audit, poly, point)
    return {
        "summary": A.summary_rates(summary),
        "chart_series": missing,
        "missing_rank": A.missing_label_rank(missing),
        "no_annotation": A.unannotated(audit, k),
        "no_annotation_rest": A.not_listed(summary, "without_annotation", k),
        "poly_incomplete": A.top_incomplete(audit, "poly", k),
        "point_incomplete": A.top_incomplete(audit, "point", k),
    }


def label_membership_report(audit: DataFrame, first: str, second: str) -> dict[str, DataFrame]:
    return {
        "members": A.label_membership(audit, first, second),
        "counts": A.label_membership_counts(audit, first, second),
    }


def select_training(audit: DataFrame) -> dict[str, DataFrame]:
    status = S.selection_status(audit)
    return {"selection": status, "valid": S.valid_samples(status), "counts": S.selection_counts(status)}


build_pose_dataset = B.build_pose_dataset
build_point_dataset = B.build_point_dataset
build_box_dataset = B.build_box_dataset


def merge_label_datasets(
    corner_images: DataFrame, cfh_images: DataFrame, corners: DataFrame, points: DataFrame,
    corner_files: DataFrame | None = None, cfh_files: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Merged labels, images, counters and descriptor. The label-file lists count empty files too."""
    stats = G.merge_stats(corner_images, cfh_images, corners, points, corner_files, cfh_files)
    totals = stats.selectExpr(
        "total_images", "vertebra_objects + cfh_objects AS total_objects",
        "vertebra_objects", "cfh_objects")
    images = G.merge_images(corner_images, cfh_images)
    rows = G.merge_label_rows(corners, points).join(images.select("stem"), "stem", "left_semi")
    return {
        "labels": rows, "images": images, "stats": stats,
        "descriptor": G.dataset_descriptor(
            totals, vocab.MERGED_CLASSES, [4, 3], "vertebra corners and femoral-head keypoint"),
    }


def validate_label_dataset(
    image_stems: DataFrame, label_files: DataFrame, lines: DataFrame, kind: str
) -> dict[str, DataFrame]:
    return {
        "pairing": V.pairing_missing(image_stems, label_files),
        "totals": V.keypoint_totals(lines, label_files, kind),
        "classes": V.class_distribution(lines, kind),
        "violations": V.format_violations(lines, kind),
        "examples": V.format_examples(lines),
    }


def overlay_geometry(labels: DataFrame, images: DataFrame) -> dict[str, DataFrame]:
    sized = O.on_images(labels, images)
    return {
        "boxes": O.overlay_boxes(sized), "points": O.overlay_points(sized),
        "edges": O.overlay_edges(sized),
    }


def normalise_detections(vertebra_boxes: DataFrame, cfh_boxes: DataFrame) -> dict[str, DataFrame]:
    return {
        "vertebrae": D.normalise_vertebrae(vertebra_boxes), "cfh": D.normalise_cfh(cfh_boxes)}


def detection_documents(
    images: DataFrame, vertebra_boxes: DataFrame, cfh_boxes: DataFrame, most: int = 300
) -> dict[str, DataFrame]:
    """Raw boxes of both detectors as one document per image, also for images without any box."""
    parts = normalise_detections(vertebra_boxes, cfh_boxes)
    return D.detection_documents(images, parts["vertebrae"], parts["cfh"], most)


def prediction_summary(
    images: DataFrame, vertebrae: DataFrame, cfh: DataFrame, n: int
) -> dict[str, DataFrame]:
    """Counters and ratios of ``n`` sampled images."""
    sampled = R.sample_images(images, n)
    stats = R.prediction_stats(sampled, vertebrae, cfh)
    return {"sampled": sampled, "stats": stats, "ratios": R.prediction_ratios(stats)}


def detections_to_measurements(vertebrae: DataFrame, cfh: DataFrame | None = None) -> DataFrame:
    return M.measurements_nested(M.spine_by_image(vertebrae, cfh))


def measurements_to_metrics(measurements: DataFrame) -> DataFrame:
    return X.metrics_from_measurements(measurements)


def detections_to_metrics(vertebrae: DataFrame, cfh: DataFrame | None = None) -> DataFrame:
    return X.metrics_from_spine(M.spine_by_image(vertebrae, cfh))


def detections_to_metrics_normalised(
    vertebrae: DataFrame, cfh: DataFrame | None = None
) -> DataFrame:
    return X.metrics_normalised(M.spine_by_image(vertebrae, cfh))
