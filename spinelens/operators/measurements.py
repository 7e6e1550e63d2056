"""Detections -> ordered measurement points per image.

Long form: one row per detection, reduced first to one row per (image, label) and then to one row
per image. Nested form: one row per image document, array functions only, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens import vocab
from spinelens.functions import points as P
from spinelens.operators.winners import kept_rows


def last_label_wins(vertebrae: DataFrame, order_by: str = "det_idx") -> DataFrame:
    """One detection per (image, label): the one with the largest ``order_by``.

    With the default order a later detection overwrites an earlier one; ``order_by="confidence"``
    keeps the most confident one instead.
    """
    return kept_rows(vertebrae, ["image_id", "label"], [order_by])


def first_box(boxes: DataFrame) -> DataFrame:
    """The first box of each image in detector order (detectors emit boxes by confidence)."""
    return kept_rows(boxes, ["image_id"], ["det_idx"], last=False)


def with_endplates(df: DataFrame, keypoints: str = "keypoints", out: str = "plates") -> DataFrame:
    """Adds the endplates of a keypoint column, NULL unless it holds four points.

    Narrow projections instead of one expression: the eight coordinates, the height rank of each
    point by pairwise comparison (equal y: input order), and the plates picked by rank. All of it
    is primitive arithmetic in generated code, without a sort per row.
    """
    n = range(4)
    flat = df.selectExpr("*", *[
        f"get({keypoints}, {i}).{c} AS __{c}{i}" for i in n for c in ("x", "y")])

    def above(j: int, i: int) -> str:
        return f"CAST(__y{j} {'<=' if j < i else '<'} __y{i} AS INT)"

    ranked = flat.selectExpr("*", *[
        " + ".join(above(j, i) for j in n if j != i) + f" AS __r{i}" for i in n])

    def at_rank(r: int, c: str) -> str:
        cases = " ".join(f"WHEN __r{i} = {r} THEN __{c}{i}" for i in n)
        return f"CASE {cases} END AS __{c}_at{r}"

    ordered = ranked.selectExpr("*", *[at_rank(r, c) for r in n for c in ("x", "y")])
    picked = ordered.selectExpr(*df.columns, *[f"__{c}{i}" for i in n for c in ("x", "y")], *[
        f"{P.point(f'__x_at{r}', f'__y_at{r}')} AS __p{r}" for r in n])
    center = P.point("(__x0 + __x1 + __x2 + __x3) / 4", "(__y0 + __y1 + __y2 + __y3) / 4")
    plates = P.plates("__p0", "__p1", "__p2", "__p3", center)
    return picked.selectExpr(
        *df.columns, f"CASE WHEN size({keypoints}) = 4 THEN {plates} END AS {out}")


def spine_by_image(vertebrae: DataFrame, cfh: DataFrame | None = None) -> DataFrame:
    """One row per image with the endplates of every measured label and the femoral-head centre.

    ``vertebrae``: image_id, det_idx, label, keypoints, image_width, image_height.
    ``cfh``: image_id, det_idx, center, image_width, image_height; the first one per image counts.
    ``bad_label`` names the first detection without exactly four keypoints, else NULL.

    The last detection of a label is chosen per (image, label) on primitive columns, so the hash
    aggregate reduces a hot image in every map task. What reaches the image-level aggregate is one
    row per distinct label.
    """
    coords = [f"{c}{i}" for i in range(4) for c in ("x", "y")]
    rows = vertebrae.selectExpr(
        "image_id", "label", "det_idx", "image_width", "image_height",
        *[f"get(keypoints, {i}).{c} AS {c}{i}" for i in range(4) for c in ("x", "y")],
        "CASE WHEN coalesce(size(keypoints) <> 4, true) THEN det_idx END AS bad_at",
    )
    per_label = rows.groupBy("image_id", "label").agg(
        *[F.expr(f"max_by({c}, det_idx) AS {c}") for c in coords],
        F.expr("max(image_width) AS image_width"), F.expr("max(image_height) AS image_height"),
        F.expr("min(bad_at) AS bad_at"),
    )
    points = ", ".join(P.point(f"x{i}", f"y{i}") for i in range(4))
    measured = ", ".join(f"'{name}'" for name in vocab.MEASURED_LABELS)
    with_plates = with_endplates(per_label.selectExpr(
        "image_id", "label", "image_width", "image_height", "bad_at",
        f"CASE WHEN label IN ({measured}) THEN array({points}) END AS keypoints",
    )).drop("keypoints")
    images = with_plates.groupBy("image_id").agg(
        F.expr("max(image_width) AS image_width"), F.expr("max(image_height) AS image_height"),
        F.expr("min(CASE WHEN bad_at IS NOT NULL THEN"
               " named_struct('at', bad_at, 'label', coalesce(label, '')) END).label AS bad_label"),
        F.expr("map_from_entries(collect_list(CASE WHEN plates IS NOT NULL THEN"
               " named_struct('label', label, 'plates', plates) END)) AS plates"),
    )
    if cfh is None:
        joined = images.withColumn("cfh_center", F.expr("CAST(NULL AS struct<x:double,y:double>)"))
    else:
        # Both sides are aggregates on image_id, so this join adds no shuffle.
        heads = cfh.groupBy("image_id").agg(
            F.expr("min_by(center.x, det_idx) AS head_x"),
            F.expr("min_by(center.y, det_idx) AS head_y"),
            F.expr("max(image_width) AS head_width"), F.expr("max(image_height) AS head_height"),
        )
        joined = images.join(heads, "image_id", "full_outer").selectExpr(
            "image_id", "coalesce(image_width, head_width) AS image_width",
            "coalesce(image_height, head_height) AS image_height", "bad_label", "plates",
            f"CASE WHEN head_x IS NOT NULL THEN {P.point('head_x', 'head_y')} END AS cfh_center",
        )
    return joined.selectExpr(
        "image_id", "image_width", "image_height", "bad_label", "cfh_center",
        *[f"try_element_at(plates, '{name}') AS {name}" for name in vocab.MEASURED_LABELS],
    )


def spine_from_documents(documents: DataFrame) -> DataFrame:
    """Row-local form of :func:`spine_by_image` for nested detection documents."""
    passed = [c for c in documents.columns if c not in ("vertebrae", "cfh")]
    measured = ", ".join(f"'{name}'" for name in vocab.MEASURED_LABELS)
    bad = "get(filter(vertebrae, v -> coalesce(size(v.keypoints) <> 4, true)), 0)"
    return documents.selectExpr(
        *passed,
        f"CASE WHEN {bad} IS NOT NULL THEN coalesce({bad}.label, '') END AS bad_label",
        "cfh.center AS cfh_center",
        f"transform(filter(vertebrae, v -> v.label IN ({measured})), v -> named_struct("
        f"'label', v.label, 'plates', {P.endplates('v.keypoints')})) AS __found",
    ).selectExpr(*passed, "bad_label", "cfh_center", *[
        f"try_element_at(filter(__found, v -> v.label = '{name}'), -1).plates AS {name}"
        for name in vocab.MEASURED_LABELS
    ])


def rejects(spine: DataFrame) -> DataFrame:
    """Images turned away as a whole because one vertebra lacks its four keypoints."""
    return spine.filter("bad_label is not null").select(
        "image_id",
        F.concat(F.lit("keypoint count is not 4: "), "bad_label").alias("reason"),
    )


def require_four_keypoints(spine: DataFrame) -> DataFrame:
    """Strict mode: fail the job on the first bad image instead of routing it to rejects."""
    reason = F.concat(F.lit("keypoint count is not 4: "), "bad_label")
    return spine.withColumn("bad_label", F.when(
        F.col("bad_label").isNotNull(), F.raise_error(reason).cast("string")))


def measurement_parts() -> dict[str, tuple[str, list[str]]]:
    """Per measurement type the condition under which it exists, and its points in pixels."""
    def plate(label: str, side: str) -> list[str]:
        return [P.to_pixel(f"{label}.{side}_anterior"), P.to_pixel(f"{label}.{side}_posterior")]

    def given(parts: list[str], pts: list[str]) -> tuple[str, list[str]]:
        return " AND ".join(f"{name} IS NOT NULL" for name in parts), pts

    head = P.to_pixel("cfh_center")
    pelvis = given(["L5", "cfh_center"], [head, *plate("L5", "lower")])
    s1 = P.to_pixel(f"({P.estimate_s1('L5')})")
    return {
        "T1 Slope": given(["T1"], plate("T1", "upper")),
        "C2-C7 CL": given(["C2", "C7"], plate("C2", "lower") + plate("C7", "lower")),
        "TK T2-T5": given(["T2", "T5"], plate("T2", "upper") + plate("T5", "lower")),
        "TK T5-T12": given(["T5", "T12"], plate("T5", "upper") + plate("T12", "lower")),
        "LL L1-S1": given(["L1", "L5"], plate("L1", "upper") + plate("L5", "lower")),
        "LL L1-L4": given(["L1", "L4"], plate("L1", "upper") + plate("L4", "lower")),
        "LL L4-S1": given(["L4", "L5"], plate("L4", "upper") + plate("L5", "lower")),
        "SVA": given(["C7", "L5"], [P.to_pixel("C7.upper_posterior"), s1]),
        "TPA": given(["T1", "L5", "cfh_center"], [
            *plate("T1", "upper"), *plate("T1", "lower"), head, *plate("L5", "lower")]),
        "PI": pelvis,
        "PT": pelvis,
        "SS": given(["L5"], plate("L5", "lower")),
    }


def measurement_points() -> dict[str, str]:
    """Points of every measurement type in pixels, NULL where a required part is absent."""
    return {
        kind: f"CASE WHEN {present} THEN array({', '.join(pts)}) END"
        for kind, (present, pts) in measurement_parts().items()
    }


def measurements_nested(spine: DataFrame) -> DataFrame:
    """Keypoints documents: one row per accepted image with its measurements in spec order."""
    entries = ", ".join(
        f"named_struct('type', '{name}', 'points', {pts})"
        for name, pts in measurement_points().items()
    )
    standard = ", ".join(P.point(str(x), str(y)) for x, y in vocab.DEFAULT_STANDARD_POINTS)
    return spine.filter("bad_label IS NULL").selectExpr(
        f"coalesce(CAST(image_id AS STRING), '{vocab.DEFAULT_IMAGE_ID}') AS imageId",
        "image_width AS imageWidth", "image_height AS imageHeight",
        f"filter(array({entries}), m -> m.points IS NOT NULL) AS measurements",
        f"{vocab.DEFAULT_STANDARD_DISTANCE}D AS standardDistance",
        f"array({standard}) AS standardDistancePoints",
    )


def measurements_long(spine: DataFrame) -> DataFrame:
    """One row per (image, measurement), ``ord`` being the spec order."""
    entries = ", ".join(
        f"named_struct('ord', {i}, 'type', '{name}', 'points', {pts})"
        for i, (name, pts) in enumerate(measurement_points().items(), start=1)
    )
    return (
        spine.filter("bad_label IS NULL")
        .selectExpr("image_id", f"explode(array({entries})) AS m")
        .filter("m.points IS NOT NULL")
        .select("image_id", "m.ord", "m.type", "m.points")
    )


def last_measurement_wins(measurements: DataFrame) -> DataFrame:
    """One row per (image, type): the last one in document order."""
    return kept_rows(measurements.select("image_id", "type", "points", "ord"), ["image_id", "type"], ["ord"])


def detection_overview(vertebrae: DataFrame, cfh: DataFrame | None = None) -> DataFrame:
    """Per image: detection count, label multiset, femoral-head presence and confidence.

    Labels are counted per (image, label) before they are gathered, so the gathered list holds
    distinct labels only; :func:`sorted_labels` turns it back into the full sorted list.
    """
    rows = vertebrae.select("image_id", "label", F.lit(1).cast("bigint").alias("n"))
    if cfh is not None:
        first = first_box(cfh.select("image_id", "det_idx", "confidence"))
        rows = rows.unionByName(
            first.select("image_id", F.col("confidence").alias("cfh_confidence")),
            allowMissingColumns=True,
        )
    else:
        rows = rows.withColumn("cfh_confidence", F.lit(None).cast("double"))
    counted = rows.groupBy("image_id", "label").agg(
        F.sum("n").alias("n"), F.max("cfh_confidence").alias("cfh_confidence"),
    )
    return counted.groupBy("image_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("vertebra_count"),
        F.sort_array(F.collect_list(
            F.when(F.col("n").isNotNull(), F.struct("label", "n")))).alias("label_counts"),
        F.max("cfh_confidence").alias("cfh_confidence"),
        F.max("cfh_confidence").isNotNull().alias("has_cfh"),
    )


def sorted_labels(label_counts: str) -> str:
    """SQL text of the sorted label list with duplicates kept."""
    return f"flatten(transform({label_counts}, e -> array_repeat(e.label, CAST(e.n AS INT))))"


def measurement_point_counts(measurements: DataFrame) -> DataFrame:
    """Documents and points per measurement type."""
    return measurements.groupBy("type").agg(
        F.count(F.lit(1)).alias("n_measurements"),
        F.sum(F.size("points").cast("bigint")).alias("n_points"),
    )


def document_measurement_counts(documents: DataFrame) -> DataFrame:
    """Per keypoints document: number of measurements and points per type, row-local."""
    return documents.select(
        "imageId", F.size("measurements").alias("n_measurements"),
        F.transform("measurements", lambda m: F.struct(
            m["type"].alias("type"), F.size(m["points"]).alias("n_points"))).alias("point_counts"),
    )
