"""Registered queries: every operator over whole tables of a data directory.

Doubles are compared as scaled integers (``floor(x * 1e6 + 0.5)``), arrays as rows or texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinelens import vocab
from spinelens.functions import boxes as BX
from spinelens.functions import label_text
from spinelens.functions import points as P
from spinelens.operators import audit as A
from spinelens.operators import datasets as B
from spinelens.operators import detections as D
from spinelens.operators import evaluation as E
from spinelens.operators import measurements as M
from spinelens.operators import merge as G
from spinelens.operators import metrics as X
from spinelens.operators import overlay as O
from spinelens.operators import predictions as R
from spinelens.operators import selection as SEL
from spinelens.operators import shapes as H
from spinelens.operators import validate as V
from spinelens.plans import composites as C
from spinelens.sources import documents as DOC
from spinelens.sources import files
from spinelens.sources import star_tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

POLY, POINT = ["V1", "V2", "V3"], ["P"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def scaled(expression: str, factor: str = "1e6") -> str:
    return f"CAST(floor(({expression}) * {factor} + 0.5e0) AS BIGINT)"


def _scaled_columns(df: DataFrame, keys: list[str], names: list[str], factor: str) -> DataFrame:
    return df.selectExpr(*keys, *[f"{scaled(n, factor)} AS {n}" for n in names])


def _spine(spark: SparkSession, d: str) -> DataFrame:
    return M.spine_by_image(T.vertebrae(spark, d), T.cfh_boxes(spark, d))


# --- measurements and metrics -------------------------------------------------------------------

@query
def metrics_wide(spark, d):
    return _scaled_columns(X.metrics_from_spine(_spine(spark, d)), ["image_id"], vocab.METRICS, "1e4")


@query
def metrics_long(spark, d):
    long = X.to_long(X.metrics_from_spine(_spine(spark, d)))
    return _scaled_columns(long, ["image_id", "metric"], ["value"], "1e4")


@query
def measurements_long(spark, d):
    return M.measurements_long(_spine(spark, d)).selectExpr(
        "image_id", "ord", "type", "posexplode(points) AS (k, p)"
    ).selectExpr("image_id", "ord", "type", "k AS point_no", f"{scaled('p.x')} AS x", f"{scaled('p.y')} AS y")


@query
def metrics_normalised(spark, d):
    return _scaled_columns(
        X.metrics_normalised(_spine(spark, d)), ["image_id"], vocab.NORMALISED_METRICS, "1e4")


@query
def metrics_normalised_given_s1(spark, d):
    """S1 given as the centre of L5 for images with a T12, estimated for the others."""
    spine = _spine(spark, d).withColumn("given", F.expr("CASE WHEN T12 IS NOT NULL THEN L5.center END"))
    return _scaled_columns(
        X.metrics_normalised(spine, s1="given"), ["image_id"], vocab.NORMALISED_METRICS, "1e4")


@query
def endplates(spark, d):
    plates = M.with_endplates(T.vertebrae(spark, d))
    parts = ["upper_anterior", "upper_posterior", "lower_anterior", "lower_posterior", "center"]
    return plates.selectExpr("image_id", "det_idx", *[
        f"{scaled(f'plates.{p}.{c}')} AS {p}_{c}" for p in parts for c in ("x", "y")])


@query
def last_label_wins(spark, d):
    kept = M.last_label_wins(T.vertebrae(spark, d).select("image_id", "label", "det_idx", "confidence"))
    return _scaled_columns(kept, ["image_id", "label", "det_idx"], ["confidence"], "1e6")


@query
def estimate_s1(spark, d):
    return _spine(spark, d).selectExpr("image_id", f"{P.estimate_s1('L5')} AS s1").filter(
        "s1 IS NOT NULL"
    ).selectExpr("image_id", f"{scaled('s1.x')} AS s1_x", f"{scaled('s1.y')} AS s1_y")


@query
def keypoint_rejects(spark, d):
    """Every 997th part loses a corner; its image is rejected with the first such label."""
    cut = T.vertebrae(spark, d).withColumn("keypoints", F.expr(
        "CASE WHEN det_idx div 100000 % 997 = 0 THEN slice(keypoints, 1, 3) ELSE keypoints END"))
    return M.rejects(M.spine_by_image(cut))


@query
def first_cfh_box(spark, d):
    first = M.first_box(T.cfh_boxes(spark, d))
    return first.selectExpr("image_id", "det_idx", f"{scaled('center.x')} AS x", f"{scaled('center.y')} AS y")


@query
def detection_overview(spark, d):
    found = M.detection_overview(T.vertebrae(spark, d), T.cfh_boxes(spark, d))
    return found.selectExpr(
        "image_id", "vertebra_count",
        f"array_join({M.sorted_labels('label_counts')}, ',') AS labels",
        "has_cfh", f"{scaled('cfh_confidence')} AS cfh_confidence")


@query
def metric_coverage(spark, d):
    rows = X.metric_coverage(X.metrics_from_spine(_spine(spark, d)))
    return rows.selectExpr("image_id", "metric", "available", "note")


@query
def coverage_by_metric(spark, d):
    rows = X.coverage_by_metric(X.metrics_from_spine(_spine(spark, d)))
    return _scaled_columns(rows, ["metric", "n_images", "n_available"], ["coverage"], "1e6")


@query
def last_measurement_wins(spark, d):
    kept = M.last_measurement_wins(T.measurement_rows(spark, d))
    return kept.selectExpr("image_id", "type", "ord", "size(points) AS n_points",
                           "CAST(points[0].x AS BIGINT) AS x0", "CAST(points[0].y AS BIGINT) AS y0")


@query
def metrics_from_measurements(spark, d):
    return _scaled_columns(X.metrics_from_measurements(T.measurement_rows(spark, d)),
                           ["image_id"], vocab.METRICS, "1e4")


@query
def measurement_point_counts(spark, d):
    return M.measurement_point_counts(T.measurement_rows(spark, d))


@query
def keypoint_document_metrics(spark, d):
    """Keypoints documents as JSON text -> defaults -> row-local metrics and scaled SVA."""
    parsed = T.keypoint_doc_texts(spark, d).select(
        F.from_json("value", DOC.schemas.KEYPOINTS_DOC).alias("doc")).select("doc.*")
    docs = DOC.with_document_defaults(parsed)
    wide = X.with_sva_mm(X.metrics_from_documents(docs))
    ranked = wide.selectExpr(
        "imageId", "imageWidth", "imageHeight", *[f"{scaled(m, '1e4')} AS {m}" for m in vocab.METRICS],
        f"{scaled('sva_mm', '1e4')} AS sva_mm")
    return ranked


@query
def detection_document_metrics(spark, d):
    """Detection documents as JSON text -> check -> row-local measurements -> metrics."""
    checked = DOC.check_detections(DOC.parse_detections(T.detection_doc_texts(spark, d)))
    spine = M.spine_from_documents(DOC.valid_detections(checked))
    wide = X.metrics_from_documents(M.measurements_nested(spine))
    return _scaled_columns(wide, ["imageId"], vocab.METRICS, "1e4")


@query
def document_measurement_counts(spark, d):
    """Measurements of every keypoints document, and the points of each of them."""
    parsed = T.keypoint_doc_texts(spark, d).select(
        F.from_json("value", DOC.schemas.KEYPOINTS_DOC).alias("doc")).select("doc.*")
    counts = M.document_measurement_counts(DOC.with_document_defaults(parsed))
    return counts.selectExpr("imageId", "n_measurements", "posexplode(point_counts) AS (ord, c)").selectExpr(
        "imageId", "n_measurements", "ord", "c.type AS type", "c.n_points AS n_points")


@query
def rejected_documents(spark, d):
    """Detection documents that lack their size or their list, with what they lack."""
    texts = T.detection_doc_texts(spark, d).selectExpr(
        "CASE WHEN endswith(get_json_object(value, '$.image_id'), '13') AND length(get_json_object(value, '$.image_id')) > 2"
        " THEN replace(value, '\"image_width\"', '\"image_wide\"')"
        " WHEN endswith(get_json_object(value, '$.image_id'), '29') THEN replace(value, '\"vertebrae\"', '\"spine\"')"
        " ELSE value END AS value")
    checked = DOC.check_detections(DOC.parse_detections(texts))
    return DOC.rejected_detections(checked).select("image_id", "problem")


@query
def detection_documents(spark, d):
    """One document per image of the image list: detections in order, the femoral head, the size."""
    images = T.table(spark, d, "orders").selectExpr("o_orderkey div 4 AS image_id").distinct().selectExpr(
        "image_id", "CAST(1500 + 100 * (image_id % 7) AS INT) AS image_width",
        "CAST(3000 + 100 * (image_id % 5) AS INT) AS image_height")
    raw = T.raw_boxes(spark, d)
    documents = C.detection_documents(images, raw, raw.filter("class_id = 3"))["documents"]
    return documents.selectExpr(
        "image_id", "image_width", "image_height", "n_vertebrae",
        f"array_join(transform(vertebrae, v -> concat(v.det_idx, ':', v.label, ':', {scaled('v.confidence')}, ':',"
        f" {scaled('v.bbox[0]')})), ' ') AS vertebrae",
        f"{scaled('cfh.confidence')} AS cfh_confidence", f"{scaled('cfh.center.x')} AS cfh_x")


# --- audit and selection ------------------------------------------------------------------------

def _audit(spark: SparkSession, d: str) -> DataFrame:
    return A.audit_samples(T.samples(spark, d), T.sample_images(spark, d), T.sample_docs(spark, d),
                           T.sample_shapes(spark, d), POLY, POINT)


@query
def audit_samples(spark, d):
    lists = ("poly_labels", "point_labels", "missing_poly", "missing_point")
    return _audit(spark, d).selectExpr(
        "sample_id", "image_count", "json_count", "has_annotation",
        *[f"array_join({c}, ',') AS {c}" for c in lists],
        "poly_complete", "point_complete", "fully_complete")


@query
def audit_summary(spark, d):
    return A.audit_summary(_audit(spark, d))


@query
def summary_rates(spark, d):
    names = ["images_per_sample", "with_annotation_pct", "without_annotation_pct",
             "poly_incomplete_pct", "point_incomplete_pct"]
    return _scaled_columns(A.summary_rates(A.audit_summary(_audit(spark, d))), [], names, "1e6")


@query
def missing_by_label(spark, d):
    rows = A.missing_by_label(_audit(spark, d), POLY, POINT)
    return _scaled_columns(rows, ["kind", "ord", "label", "missing_count"], ["missing_pct"], "1e6")


@query
def missing_label_rank(spark, d):
    rows = A.missing_label_rank(A.missing_by_label(_audit(spark, d), POLY, POINT))
    return A.with_rank(rows, F.desc("missing_count"), F.col("ord")).select(
        "label", "missing_count", "rank")


@query
def top_incomplete_poly(spark, d):
    return A.top_incomplete(_audit(spark, d), "poly", 50)


@query
def top_incomplete_point(spark, d):
    return A.top_incomplete(_audit(spark, d), "point", 10)


@query
def unannotated_samples(spark, d):
    return A.unannotated(_audit(spark, d), 20)


@query
def unannotated_rest(spark, d):
    return A.not_listed(A.audit_summary(_audit(spark, d)), "without_annotation", 20)


@query
def label_membership(spark, d):
    return A.label_membership(_audit(spark, d), "V6", "V7")


@query
def label_membership_counts(spark, d):
    rows = A.label_membership_counts(_audit(spark, d), "V6", "V7")
    keys = ["total_samples", "with_annotation", "first_count", "second_count", "both_count"]
    return _scaled_columns(rows, keys, ["first_pct", "second_pct", "both_pct"], "1e6")


@query
def selection_status(spark, d):
    return SEL.selection_status(_audit(spark, d)).selectExpr(
        "sample_id", "status", "missing_count", "array_join(missing_labels, ', ') AS missing_labels")


@query
def selection_counts(spark, d):
    rows = SEL.selection_counts(SEL.selection_status(_audit(spark, d)))
    keys = ["total_samples", "valid_count", "excluded_count", "no_annotation_count", "incomplete_count"]
    return _scaled_columns(rows, keys, ["valid_pct", "excluded_pct"], "1e6")


@query
def label_gaps(spark, d):
    return A.label_gaps(_audit(spark, d))


@query
def sorted_incomplete(spark, d):
    """All incomplete samples in report order."""
    listed = SEL.sorted_selection(SEL.selection_status(_audit(spark, d)), "incomplete")
    return listed.select("sample_id", "missing_count")


# --- polygons and label datasets ----------------------------------------------------------------

@query
def polygon_bbox_center(spark, d):
    return T.polygons(spark, d).selectExpr(
        "vec_id", f"{P.vertex_mean('points')} AS c", f"{P.bounds('points')} AS b",
    ).selectExpr(
        "vec_id", f"{scaled('c.x')} AS mean_x", f"{scaled('c.y')} AS mean_y",
        *[f"{scaled(f'b.{k}')} AS {k}" for k in ("x_min", "y_min", "x_max", "y_max")])


@query
def four_corners(spark, d):
    return T.polygons(spark, d).selectExpr(
        "vec_id", f"posexplode({P.four_corners('points')}) AS (corner_no, p)"
    ).selectExpr("vec_id", "corner_no", f"{scaled('p.x')} AS x", f"{scaled('p.y')} AS y")


def _pose(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return B.build_pose_dataset(
        T.corpus_selected(spark, d), T.corpus_docs(spark, d), T.corpus_images(spark, d))


def _points(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return B.build_point_dataset(
        T.corpus_selected(spark, d), T.corpus_docs(spark, d), T.corpus_images(spark, d))


def _flat_labels(labels: DataFrame) -> DataFrame:
    """Label rows with their keypoints as one text of scaled integers."""
    kp = f"transform(keypoints, k -> concat_ws(':', {scaled('k.x')}, {scaled('k.y')}, k.v))"
    return labels.selectExpr(
        "stem", "line_no", "class_id", *[f"{scaled(c)} AS {c}" for c in ("cx", "cy", "w", "h")],
        f"array_join({kp}, ' ') AS keypoints")


@query
def pose_rows(spark, d):
    return _flat_labels(_pose(spark, d)["labels"])


@query
def pose_manifest(spark, d):
    return _pose(spark, d)["manifest"]


@query
def pose_failures(spark, d):
    return _pose(spark, d)["failures"]


@query
def pose_failure_reasons(spark, d):
    return B.failure_reasons(_pose(spark, d)["failures"])


@query
def point_rows(spark, d):
    return _flat_labels(_points(spark, d)["labels"])


@query
def point_failures(spark, d):
    return _points(spark, d)["failures"]


@query
def failure_head(spark, d):
    """The first ten failed samples of the pose build, and how many the list leaves out."""
    return B.failure_head(_pose(spark, d)["failures"], 10)


@query
def point_rejects(spark, d):
    """Rows that the point build turns away: heads so far outside their image that the box has no inside."""
    moved = T.corpus_docs(spark, d).withColumn("shapes", F.expr(
        "transform(shapes, s -> CASE WHEN s.label = 'CFH' AND sample_id % 2 = 0 THEN named_struct('label', s.label,"
        " 'shape_type', s.shape_type, 'points', transform(s.points, p -> array(p[0] + 3000e0, p[1]))) ELSE s END)"))
    built = B.build_point_dataset(T.corpus_selected(spark, d), moved, T.corpus_images(spark, d))
    return built["rejects"].selectExpr("stem", *[f"{scaled(c)} AS {c}" for c in ("cx", "cy", "w", "h")])


@query
def exploded_shapes(spark, d):
    """One row per shape of every annotation document."""
    return H.explode_shapes(T.corpus_docs(spark, d)).selectExpr(
        "sample_id", "doc_path", "imagePath", "shape_idx", "label", "shape_type", "size(points) AS n_points",
        f"{scaled('points[0].x')} AS x0", f"{scaled('points[0].y')} AS y0")


@query
def point_box_clamped(spark, d):
    """Fixed-size boxes about the femoral-head candidates in pixels."""
    boxes = T.cfh_boxes(spark, d).selectExpr(
        "image_id", "det_idx", "image_width", "image_height",
        f"{BX.fixed_box('(center.x * image_width)', '(center.y * image_height)', 'image_width', 'image_height', 1200)} AS b",
    ).selectExpr("image_id", "det_idx", f"{P.bounds_to_norm_box('b', 'image_width', 'image_height')} AS box")
    return boxes.selectExpr("image_id", "det_idx", *[
        f"{scaled(f'box.{c}')} AS {c}" for c in ("cx", "cy", "w", "h")])


def _pixel_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Vertebra outlines in whole pixels, femoral-head candidates left out."""
    return T.vertebrae(spark, d, "l_partkey % 13 <> 0").selectExpr(
        "image_id", "array(" + ", ".join(
            f"named_struct('x', floor(keypoints[{i}].x * image_width),"
            f" 'y', floor(keypoints[{i}].y * image_height))" for i in range(4)) + ") AS points")


def _heads_with_height(spark: SparkSession, d: str) -> DataFrame:
    heights = B.reference_heights(_pixel_shapes(spark, d), ["image_id"])
    return T.cfh_boxes(spark, d).join(heights, "image_id", "left")


@query
def adaptive_box(spark, d):
    sized = _heads_with_height(spark, d).selectExpr(
        "image_id", "det_idx", "center", "image_width", "image_height",
        f"{BX.adaptive_side('avg_height', 'image_width', 'image_height')} AS side",
        f"{BX.blended_side('avg_height', 'image_width', 'image_height')} AS blended_side",
    )
    box = BX.point_to_norm_box(
        "(center.x * image_width)", "(center.y * image_height)", "side", "image_width", "image_height")
    return sized.selectExpr("image_id", "det_idx", "side", "blended_side", f"{box} AS box").selectExpr(
        "image_id", "det_idx", "side", "blended_side",
        *[f"{scaled(f'box.{c}')} AS {c}" for c in ("cx", "cy", "w", "h")])


def _boxes(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return B.build_box_dataset(T.corpus_docs(spark, d), T.corpus_images(spark, d))


@query
def box_rows(spark, d):
    return _flat_labels(_boxes(spark, d)["labels"])


@query
def box_counts(spark, d):
    return _boxes(spark, d)["counts"]


@query
def last_writer_wins(spark, d):
    images = T.sample_images(spark, d).withColumn("path", F.expr("concat(sample_id, '/', file_name)"))
    return B.last_writer_wins(images).select("stem", "sample_id", "file_name")


@query
def stem_collisions(spark, d):
    return B.stem_collisions(T.sample_images(spark, d))


# --- merge and validation -----------------------------------------------------------------------

@query
def merge_labels(spark, d):
    merged = G.merge_label_rows(T.corner_label_rows(spark, d), T.point_label_rows(spark, d))
    return _flat_labels(merged)


def _merge_images(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stems = T.label_images(spark, d)
    return (stems.filter("stem % 4 <> 1").selectExpr("stem", "concat('a', stem, '.png') AS file_name"),
            stems.filter("stem % 6 <> 1").selectExpr("stem", "concat('a', stem, '.jpg') AS file_name"))


@query
def merge_images(spark, d):
    return G.merge_images(*_merge_images(spark, d))


def _merge_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_stats(*_merge_images(spark, d), T.corner_label_rows(spark, d).filter("stem % 5 <> 2"),
                         T.point_label_rows(spark, d))


@query
def merge_stats(spark, d):
    return _merge_stats(spark, d)


@query
def descriptor_yaml(spark, d):
    totals = _merge_stats(spark, d).selectExpr(
        "total_images", "vertebra_objects + cfh_objects AS total_objects",
        "vertebra_objects", "cfh_objects")
    return G.descriptor_yaml(G.dataset_descriptor(totals, vocab.MERGED_CLASSES, [4, 3], "merged"))


@query
def pairing_missing(spark, d):
    """Customers as images, the customers of orders as label files."""
    images = T.table(spark, d, "customer").selectExpr("c_custkey AS stem")
    labels = T.table(spark, d, "orders").selectExpr("o_custkey AS stem")
    return V.pairing_missing(images, labels)


@query
def label_line_fields(spark, d):
    """Label text lines parsed into typed rows."""
    rows = files.parse_label_lines(T.label_lines(spark, d))
    kp = f"transform(keypoints, k -> concat_ws(':', {scaled('k.x', '1e3')}, {scaled('k.y', '1e3')}, k.v))"
    return rows.selectExpr(
        "stem", "line_no", "n_fields", "class_id",
        *[f"{scaled(c, '1e3')} AS {c}" for c in ("cx", "cy", "w", "h")],
        f"array_join({kp}, ' ') AS keypoints")


@query
def label_line_text(spark, d):
    """Typed rows written back as label text, each line with the keypoints it has."""
    rows = files.parse_label_lines(T.label_lines(spark, d)).filter("class_id IS NOT NULL")
    return rows.selectExpr("stem", "line_no", f"{label_text.format_line()} AS text")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return files.parse_label_lines(T.label_lines(spark, d))


def _label_files(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "orders").selectExpr("o_orderkey AS stem")


@query
def class_distribution(spark, d):
    rows = V.class_distribution(_lines(spark, d), "merged")
    return _scaled_columns(rows, ["class_id", "label", "n_objects"], ["pct"], "1e6")


@query
def keypoint_totals(spark, d):
    rows = V.keypoint_totals(_lines(spark, d), _label_files(spark, d), "merged")
    keys = ["total_objects", "total_keypoints", "vertebra_keypoints", "cfh_keypoints", "label_files"]
    return _scaled_columns(rows, keys, ["objects_per_file"], "1e6")


@query
def format_violations_vertebra(spark, d):
    """The vertebra kind accepts more than seventeen fields."""
    return V.format_violations(_lines(spark, d), "vertebra").select(
        "stem", "line_no", "n_fields", "class_id", "violation")


@query
def format_violations(spark, d):
    return V.format_violations(_lines(spark, d), "merged")


@query
def format_examples(spark, d):
    return V.format_examples(_lines(spark, d))


@query
def pairing_head(spark, d):
    missing = pairing_missing(spark, d).filter("missing = 'label'")
    return V.listing_head(missing, ["stem"], 5)


@query
def descriptor_violations(spark, d):
    totals = _merge_stats(spark, d).select("total_images")
    return V.descriptor_violations(G.dataset_descriptor(totals, vocab.MERGED_CLASSES, None, "merged"))


@query
def reference_heights(spark, d):
    rows = B.reference_heights(_pixel_shapes(spark, d), ["image_id"])
    return _scaled_columns(rows, ["image_id"], ["avg_height"], "1e6")


# --- overlays, detections, predictions ----------------------------------------------------------

def _sized_labels(spark: SparkSession, d: str) -> DataFrame:
    return O.on_images(T.label_rows(spark, d), T.label_images(spark, d))


@query
def overlay_boxes(spark, d):
    return O.overlay_boxes(_sized_labels(spark, d))


@query
def overlay_points(spark, d):
    return O.overlay_points(_sized_labels(spark, d))


@query
def overlay_edges(spark, d):
    return O.overlay_edges(_sized_labels(spark, d))


@query
def prediction_edges(spark, d):
    boxes = T.vertebrae(spark, d).withColumn("keypoints", F.expr(
        "transform(keypoints, (k, i) -> named_struct('x', k.x * image_width, 'y', k.y * image_height,"
        " 'c', ((det_idx + 37 * i) % 100) / 100e0))"))
    return O.prediction_edges(boxes)


@query
def detections_normalised(spark, d):
    boxes = T.raw_boxes(spark, d).withColumn("keypoints_px", F.expr(
        "array(named_struct('x', x1, 'y', y1), named_struct('x', x2, 'y', y2))"))
    rows = D.normalise_vertebrae(boxes)
    return rows.selectExpr(
        "image_id", "det_idx", "label", f"{scaled('confidence')} AS confidence",
        *[f"{scaled(f'bbox[{i}]')} AS {c}" for i, c in enumerate(("cx", "cy", "w", "h"))],
        f"{scaled('keypoints[1].x')} AS kx", f"{scaled('keypoints[1].y')} AS ky")


@query
def cfh_normalised(spark, d):
    rows = D.normalise_cfh(T.raw_boxes(spark, d), 0.25)
    return rows.selectExpr("image_id", "det_idx", f"{scaled('confidence')} AS confidence",
                           f"{scaled('center.x')} AS x", f"{scaled('center.y')} AS y")


@query
def known_class_boxes(spark, d):
    return O.known_class_only(T.raw_boxes(spark, d)).select("image_id", "det_idx", "label")


@query
def detections_flat(spark, d):
    flat = D.detections_flat(T.raw_boxes(spark, d).withColumn("image", F.expr("concat('img', image_id)")))
    names = ["x1", "y1", "x2", "y2", "confidence", "center_x", "center_y"]
    return _scaled_columns(flat, ["image"], names, "1e4")


@query
def prediction_text(spark, d):
    rows = T.raw_boxes(spark, d).selectExpr(
        "image_id", "det_idx", "concat('Class_', class_id) AS label",
        "(det_idx % 97) / 100e0 AS confidence",
        "array(named_struct('x', (det_idx % 8000) / 4e0, 'y', (det_idx % 5000) / 4e0)) AS keypoints_px")
    return D.prediction_text(rows)


def _draw():
    return F.expr("(image_id * 2654435761) % 4294967296")


@query
def sampled_images(spark, d):
    images = T.label_images(spark, d).selectExpr("stem AS image_id")
    return R.sample_images(images, 1000, _draw())


def _stats(spark: SparkSession, d: str) -> DataFrame:
    images = T.label_images(spark, d).selectExpr("stem AS image_id")
    return R.prediction_stats(
        R.sample_images(images, 1000, _draw()), T.vertebrae(spark, d), T.cfh_boxes(spark, d), 0.5)


@query
def prediction_stats(spark, d):
    return _stats(spark, d)


@query
def prediction_ratios(spark, d):
    return _scaled_columns(R.prediction_ratios(_stats(spark, d)), [],
                           ["vertebrae_per_image", "keypoints_per_vertebra"], "1e6")


@query
def detection_total(spark, d):
    return R.detection_total(D.confident(T.raw_boxes(spark, d), 0.25))


# --- scores -------------------------------------------------------------------------------------

@query
def match_detections(spark, d):
    pairs = E.match_detections(T.raw_boxes(spark, d), T.truth_boxes(spark, d))
    return _scaled_columns(pairs, ["image_id", "class_id", "truth_idx", "det_idx"],
                           ["confidence", "iou"], "1e6")


@query
def evaluation_by_class(spark, d):
    rows = E.evaluate_by_class(T.raw_boxes(spark, d), T.truth_boxes(spark, d))
    return _scaled_columns(rows, ["class_id", "n_truth"], ["precision", "recall", "ap50", "ap50_95"], "1e6")


@query
def evaluation(spark, d):
    rows = E.evaluate_detections(T.raw_boxes(spark, d), T.truth_boxes(spark, d))
    return _scaled_columns(rows, [], ["precision", "recall", "ap50", "ap50_95"], "1e6")
