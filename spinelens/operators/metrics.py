"""Measurement points -> sagittal alignment metrics, in wide, long, map and nested form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens import vocab
from spinelens.functions import angles as A
from spinelens.functions import points as P
from spinelens.operators.measurements import measurement_parts

# One point-array column per measurement type, in the order of MEASUREMENT_TYPES.
POINT_COLUMNS = [f"p{i}" for i in range(len(vocab.MEASUREMENT_TYPES))]


def _stored_points() -> dict[str, tuple[str, list[str]]]:
    """Condition and points of every type, read from :data:`POINT_COLUMNS`."""
    needed = [2, 4, 4, 4, 4, 4, 4, 2, 7, 3, 3, 2]  # fixed values: points a metric needs
    return {
        kind: (f"size({column}) >= {n}", [f"get({column}, {i})" for i in range(n)])
        for kind, column, n in zip(vocab.MEASUREMENT_TYPES, POINT_COLUMNS, needed)
    }


def _metric_values(points: dict[str, tuple[str, list[str]]]) -> dict[str, str]:
    """Metric formulas over the points of each measurement type."""
    def guarded(kind: str, value) -> str:
        present, pts = points[kind]
        return f"CASE WHEN {present} THEN {value(pts)} END"

    def slope(p: list[str]) -> str:
        return A.acute_to_horizontal(p[0], p[1])

    def slope_difference(p: list[str]) -> str:
        return f"abs({A.acute_to_horizontal(p[0], p[1])} - {A.acute_to_horizontal(p[2], p[3])})"

    def mid(p: str, q: str, c: str) -> str:
        return f"(({p}.{c} + {q}.{c}) / 2)"

    def pelvic_angle(p: list[str]) -> str:
        return A.three_point(P.mean_of(p[:4]), p[4], P.midpoint(p[5], p[6]))

    def incidence(p: list[str]) -> str:
        dx, dy = [f"{mid(p[1], p[2], c)} - {p[0]}.{c}" for c in ("x", "y")]
        return f"abs({A.acute_to_horizontal(p[1], p[2])} + 90 - degrees(atan2({dy}, {dx})))"

    def tilt(p: list[str]) -> str:
        dx, dy = [f"{mid(p[1], p[2], c)} - {p[0]}.{c}" for c in ("x", "y")]
        return f"abs(90 - degrees(atan2({dx}, {dy})))"

    formulas = {
        "T1_Slope": ("T1 Slope", slope),
        "Cervical_Lordosis": ("C2-C7 CL", slope_difference),
        "Thoracic_Kyphosis_T2_T5": ("TK T2-T5", slope_difference),
        "Thoracic_Kyphosis_T5_T12": ("TK T5-T12", slope_difference),
        "Lumbar_Lordosis": ("LL L1-S1", slope_difference),
        "Lumbar_Lordosis_L1_L4": ("LL L1-L4", slope_difference),
        "Lumbar_Lordosis_L4_S1": ("LL L4-S1", slope_difference),
        "SVA": ("SVA", lambda p: f"abs({p[0]}.x - {p[1]}.x)"),
        "TPA": ("TPA", pelvic_angle),
        "PI": ("PI", incidence),
        "PT": ("PT", tilt),
        "SS": ("SS", slope),
    }
    return {name: guarded(*spec) for name, spec in formulas.items()}


def _wide(with_points: DataFrame, passed: list[str]) -> DataFrame:
    return with_points.selectExpr(
        *passed, *[f"{v} AS {name}" for name, v in _metric_values(_stored_points()).items()])


def metrics_from_spine(spine: DataFrame) -> DataFrame:
    """Wide metrics straight from per-image endplates; the measurement points stay expressions."""
    values = _metric_values(measurement_parts())
    return spine.filter("bad_label IS NULL").selectExpr(
        "image_id", *[f"{v} AS {name}" for name, v in values.items()])


def metrics_from_measurements(measurements: DataFrame) -> DataFrame:
    """Wide metrics from long measurements; of a repeated type the last one (``ord``) counts.

    One aggregation with one buffer per known type, so a hot document is reduced map-side.
    """
    grouped = measurements.groupBy("image_id").agg(*[
        F.expr(f"max_by(points, ord) FILTER (WHERE type = '{t}') AS {c}")
        for t, c in zip(vocab.MEASUREMENT_TYPES, POINT_COLUMNS)
    ])
    return _wide(grouped, ["image_id"])


def metrics_from_documents(documents: DataFrame) -> DataFrame:
    """Wide metrics of nested keypoints documents, row-local; other columns pass through."""
    passed = [c for c in documents.columns if c != "measurements"]
    return _wide(documents.selectExpr(*passed, *[
        f"try_element_at(filter(measurements, m -> m.type = '{t}'), -1).points AS {c}"
        for t, c in zip(vocab.MEASUREMENT_TYPES, POINT_COLUMNS)
    ]), passed)


def with_sva_mm(documents: DataFrame) -> DataFrame:
    """Adds ``sva_mm``: SVA scaled by the document's standard distance (NULL for equal points)."""
    a, b = "get(standardDistancePoints, 0)", "get(standardDistancePoints, 1)"
    dx, dy = [f"({b}.{c} - {a}.{c})" for c in ("x", "y")]
    return documents.withColumn("sva_mm", F.expr(
        f"try_divide(SVA * standardDistance, sqrt({dx} * {dx} + {dy} * {dy}))"))


def to_long(wide: DataFrame, key: str = "image_id", names: list[str] | None = None) -> DataFrame:
    """Sparse long form: no row for a metric that could not be computed."""
    names = names or vocab.METRICS
    return wide.unpivot([key], names, "metric", "value").filter("value IS NOT NULL")


def to_document(wide: DataFrame, key: str = "image_id", names: list[str] | None = None) -> DataFrame:
    """Metrics documents ``(imageId, metrics MAP)`` with sparse keys."""
    entries = ", ".join(f"'{n}', {n}" for n in names or vocab.METRICS)
    return wide.selectExpr(
        f"{key} AS imageId", f"map_filter(map({entries}), (k, v) -> v IS NOT NULL) AS metrics")


def metric_coverage(wide: DataFrame, key: str = "image_id") -> DataFrame:
    """Every reported metric of every image, ``available`` telling whether it has a value."""
    return wide.unpivot([key], vocab.REPORTED_METRICS, "metric", "value").selectExpr(
        key, "metric", "value", "value IS NOT NULL AS available",
        "CASE WHEN value IS NULL THEN 'N/A (required vertebra missing)' END AS note",
    )


def coverage_by_metric(wide: DataFrame) -> DataFrame:
    """Share of images in which each reported metric could be computed."""
    counts = wide.agg(
        F.expr("count(1) AS n_images"),
        *[F.expr(f"count({m}) AS {m}") for m in vocab.REPORTED_METRICS],
    )
    return counts.unpivot(
        ["n_images"], vocab.REPORTED_METRICS, "metric", "n_available"
    ).selectExpr("metric", "n_images", "n_available",
                 "try_divide(CAST(n_available AS DOUBLE), n_images) AS coverage")


def metrics_normalised(spine: DataFrame, s1: str | None = None) -> DataFrame:
    """The alternative calculator: metrics on normalised coordinates, so distorted by the aspect
    ratio of the image. Not another version of :func:`metrics_from_spine`.

    ``s1`` names a point column with the centre of S1; where it is NULL, or without it, S1 is
    estimated from L5.
    """
    def plate(label: str, side: str) -> tuple[str, str]:
        return f"{label}.{side}_posterior", f"{label}.{side}_anterior"

    def direction(label: str, side: str) -> str:
        return A.direction_to_horizontal(*plate(label, side))

    values = {
        "T1_slope": direction("T1", "upper"),
        "cervical_lordosis": direction("C7", "lower"),
        "thoracic_kyphosis_T2_T5": A.between_lines(*plate("T2", "upper"), *plate("T5", "lower")),
        "thoracic_kyphosis_T5_T12": A.between_lines(*plate("T5", "upper"), *plate("T12", "lower")),
        "lumbar_lordosis": f"CASE WHEN s1 IS NOT NULL THEN {direction('L1', 'upper')} END",
        "T1_pelvic_angle": A.three_point("T1.center", "cfh_center", "s1"),
        "SVA": "abs(C7.upper_posterior.x - s1.x)",
        "pelvic_incidence": A.to_vertical("cfh_center", "s1"),
        "pelvic_tilt": "degrees(atan2(abs(s1.x - cfh_center.x), abs(s1.y - cfh_center.y)))",
        "sacral_slope": direction("L5", "lower"),
    }
    estimated = P.estimate_s1("L5")
    with_s1 = spine.filter("bad_label IS NULL").withColumn(
        "s1", F.expr(f"coalesce(`{s1}`, {estimated})" if s1 else estimated))
    return with_s1.selectExpr("image_id", *[f"{v} AS {k}" for k, v in values.items()])
