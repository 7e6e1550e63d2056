"""Annotation completeness per sample and over the corpus.

The expected labels are a vocabulary: a table, or a list for a short one. Its labels are numbered, and
whether a sample has a label is a bit of one BIGINT per 62 of them, so every summary is a hash aggregate
over a few numbers per sample, and a plan is equally large for any vocabulary. The full label lists are
only gathered when a caller selects them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spinelens import vocab

MASK_BITS = 62

#: Expected labels: a table with ``label`` and ``ord``, or a list in order.
Labels = DataFrame | list[str]


def split_vocabulary(labels: Labels) -> tuple[Labels, Labels]:
    """Expected polygon labels and expected point labels of a vocabulary, in file order."""
    if isinstance(labels, DataFrame):
        other = ", ".join(_quoted(vocab.NON_POLYGON_LABELS))
        point = labels.limit(0).unionByName(
            labels.sparkSession.range(1).selectExpr(f"'{vocab.CFH_LABEL}' AS label", "0 AS ord"), allowMissingColumns=True)
        return labels.where(f"label NOT IN ({other})"), point.select("label", "ord")
    return [x for x in labels if x not in vocab.NON_POLYGON_LABELS], [vocab.CFH_LABEL]


def _quoted(values: list[str]) -> list[str]:
    return ["'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]


def _expected(like: DataFrame, labels: Labels) -> DataFrame:
    """One row with the distinct expected labels in order, as ``labels``."""
    if isinstance(labels, DataFrame):
        ordered = "transform(sort_array(collect_list(struct(ord, label))), x -> x.label)"
        return labels.agg(F.expr(f"array_distinct({ordered}) AS labels"))
    distinct = ", ".join(_quoted(list(dict.fromkeys(labels))))
    return like.sparkSession.range(1).selectExpr(f"CAST(array({distinct}) AS ARRAY<STRING>) AS labels")


def _dictionary(like: DataFrame, poly_labels: Labels, point_labels: Labels) -> DataFrame:
    """``kind, label, number``: expected labels, numbered within their kind from 0."""
    def numbered(kind: str, labels: Labels) -> DataFrame:
        return _expected(like, labels).selectExpr(f"'{kind}' AS kind", "posexplode(labels) AS (number, label)")

    return numbered("polygon", poly_labels).unionByName(numbered("point", point_labels))


def audit_samples(
    samples: DataFrame, images: DataFrame, docs: DataFrame, shapes: DataFrame,
    poly_labels: Labels, point_labels: Labels,
) -> DataFrame:
    """One audit record per sample of the manifest, also for samples without any file.

    ``images`` and ``docs`` hold one row per file, ``shapes`` one row per labelled shape of any
    document of the sample. Each is reduced to one row per sample before the joins. Expected labels
    count once each; their tables are joined in, so they may be long.
    """
    image_counts = (
        images.filter(F.col("ext").isin(vocab.AUDIT_EXTENSIONS))
        .groupBy("sample_id").agg(F.expr("count(1) AS image_count"))
    )
    doc_counts = docs.groupBy("sample_id").agg(F.expr("count(1) AS json_count"))
    labelled = shapes.filter(
        "label IS NOT NULL AND label <> '' AND shape_type IN ('polygon', 'point')"
    ).selectExpr("sample_id", "shape_type AS kind", "label")
    # labels of one word of bits are disjoint from those of another; unexpected ones have none
    words = (
        labelled.join(_dictionary(shapes, poly_labels, point_labels), ["kind", "label"], "left")
        .withColumn("word", F.expr(f"number div {MASK_BITS}"))
        .groupBy("sample_id", "kind", "word").agg(
            F.expr(f"bit_or(shiftleft(1L, number % {MASK_BITS})) AS mask"),
            F.expr("collect_set(label) AS labels"))
    )
    found = words.groupBy("sample_id").agg(*[
        F.expr(f"{expression} AS {prefix}_{name}")
        for prefix, kind in (("poly", "polygon"), ("point", "point"))
        for name, expression in (
            ("present", f"sum(CASE WHEN kind = '{kind}' THEN bit_count(mask) END)"),
            ("labels", f"sort_array(flatten(collect_list(CASE WHEN kind = '{kind}' THEN labels END)))"))
    ])
    joined = (
        samples.select("sample_id")
        .join(image_counts, "sample_id", "left")
        .join(doc_counts, "sample_id", "left")
        .join(found, "sample_id", "left")
    )
    empty = "CAST(array() AS ARRAY<STRING>)"
    record = joined.selectExpr(
        "sample_id", "coalesce(image_count, 0L) AS image_count",
        "coalesce(json_count, 0L) AS json_count", "coalesce(json_count, 0L) > 0 AS has_annotation",
        f"coalesce(poly_labels, {empty}) AS poly_labels",
        f"coalesce(point_labels, {empty}) AS point_labels",
        "coalesce(poly_present, 0L) AS poly_present", "coalesce(point_present, 0L) AS point_present",
    )
    lists, sizes = {}, {}
    for kind, labels in (("poly", poly_labels), ("point", point_labels)):
        expected = _expected(shapes, labels)
        lists[f"missing_{kind}"] = F.array_except(expected.scalar(), F.col(f"{kind}_labels"))
        sizes[f"{kind}_complete"] = F.col(f"{kind}_present") == expected.select(F.size("labels").cast("bigint")).scalar()
    return record.select(
        "sample_id", "image_count", "json_count", "has_annotation", "poly_labels", "point_labels",
        *[c.alias(n) for n, c in {**lists, **sizes}.items()],
    ).selectExpr("*", "poly_complete AND point_complete AS fully_complete")


def audit_summary(audit: DataFrame) -> DataFrame:
    """One row of corpus totals; the incomplete counts cover annotated samples only."""
    return audit.agg(
        F.expr("count(1) AS total_samples"),
        F.expr("coalesce(sum(image_count), 0L) AS total_images"),
        F.expr("count_if(has_annotation) AS with_annotation"),
        F.expr("count_if(NOT has_annotation) AS without_annotation"),
        F.expr("count_if(has_annotation AND NOT poly_complete) AS poly_incomplete"),
        F.expr("count_if(has_annotation AND NOT point_complete) AS point_incomplete"),
    )


def summary_rates(summary: DataFrame) -> DataFrame:
    """Mean images per sample and percentages of all samples; NULL for an empty corpus."""
    def percent(column: str) -> str:
        return f"try_divide({column} * 100e0, total_samples) AS {column}_pct"

    return summary.selectExpr(
        "*", "try_divide(CAST(total_images AS DOUBLE), total_samples) AS images_per_sample",
        *[percent(c) for c in (
            "with_annotation", "without_annotation", "poly_incomplete", "point_incomplete")],
    )


def label_gaps(audit: DataFrame) -> DataFrame:
    """Row form of the missing lists: one row per sample and expected label it lacks."""
    kinds = [("polygon", "missing_poly"), ("point", "missing_point")]
    both = ", ".join(f"transform({c}, l -> named_struct('kind', '{k}', 'label', l))" for k, c in kinds)
    return audit.selectExpr("sample_id", f"inline(concat({both}))")


def missing_by_label(audit: DataFrame, poly_labels: Labels, point_labels: Labels) -> DataFrame:
    """Samples missing each expected label, over all samples, zeros included.

    The labels that samples have are counted once, together with the samples; what lacks is the rest.
    The window runs over the vocabulary's rows and one more.
    """
    kinds = ", ".join(
        f"transform({kind}_labels, l -> named_struct('kind', '{name}', 'label', l))"
        for kind, name in (("poly", "polygon"), ("point", "point")))
    counted = audit.selectExpr(
        f"inline(concat(array(named_struct('kind', 'all', 'label', '')), {kinds}))"
    ).groupBy("kind", "label").agg(F.expr("count(1) AS n"))
    points_from = _expected(audit, poly_labels).select(F.size("labels")).scalar()
    asked = _dictionary(audit, poly_labels, point_labels).select(
        "kind", "label",
        F.when(F.col("kind") == "polygon", F.col("number")).otherwise(F.col("number") + points_from).alias("ord"),
    ).unionByName(audit.sparkSession.range(1).selectExpr("'all' AS kind", "'' AS label", "-1 AS ord"))
    rows = asked.join(counted, ["kind", "label"], "left").selectExpr(
        "kind", "ord", "label", "coalesce(n, 0L) AS n", "max(CASE WHEN ord = -1 THEN coalesce(n, 0L) END) OVER () AS total")
    return rows.where("ord >= 0").selectExpr(
        "kind", "ord", "label", "total - n AS missing_count",
        "try_divide((total - n) * 100e0, total) AS missing_pct",
    )


def missing_label_rank(missing: DataFrame) -> DataFrame:
    """Labels that some sample misses, most missed first (ties in vocabulary order)."""
    return missing.filter("missing_count > 0").orderBy(F.desc("missing_count"), "ord")


def with_rank(limited: DataFrame, *order) -> DataFrame:
    """1-based list number of a list that ``limit`` has already cut to its reported length."""
    return limited.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _preview(column: str) -> str:
    return (
        f"concat(array_join(slice({column}, 1, 10), ', '),"
        f" CASE WHEN size({column}) > 10 THEN '...' ELSE '' END)"
    )


def top_incomplete(audit: DataFrame, kind: str = "poly", k: int = 50) -> DataFrame:
    """The ``k`` annotated samples that miss most labels, ties by sample id."""
    order = (F.desc(f"missing_{kind}_count"), F.col("sample_id"))
    listed = audit.filter(f"has_annotation AND NOT {kind}_complete").selectExpr(
        "sample_id", "image_count", "json_count",
        "size(missing_poly) AS missing_poly_count", "size(missing_point) AS missing_point_count",
        f"{_preview('missing_poly')} AS missing_poly_preview",
        f"{_preview('missing_point')} AS missing_point_preview",
    )
    return with_rank(listed.orderBy(*order).limit(k), *order)


def unannotated(audit: DataFrame, k: int = 50) -> DataFrame:
    """The first ``k`` samples without any document."""
    order = F.col("sample_id")
    listed = audit.filter("NOT has_annotation").select("sample_id", "image_count", "json_count")
    return with_rank(listed.orderBy(order).limit(k), order)


def not_listed(summary: DataFrame, column: str, k: int) -> DataFrame:
    """How many entries of a counted list a report of length ``k`` leaves out."""
    return summary.selectExpr(f"{column} AS total", f"greatest({column} - {k}L, 0L) AS not_listed")


def label_membership(audit: DataFrame, first: str, second: str) -> DataFrame:
    """Annotated samples that carry either polygon label, with the three membership flags."""
    a, b = _quoted([first, second])
    flags = audit.filter("has_annotation").selectExpr(
        "sample_id", f"array_contains(poly_labels, {a}) AS has_first",
        f"array_contains(poly_labels, {b}) AS has_second",
    )
    return flags.filter("has_first OR has_second").selectExpr(
        "*", "has_first AND has_second AS has_both")


def label_membership_counts(audit: DataFrame, first: str, second: str) -> DataFrame:
    """Counts of the membership lists and their share of all samples."""
    a, b = _quoted([first, second])
    has_a = f"has_annotation AND array_contains(poly_labels, {a})"
    has_b = f"has_annotation AND array_contains(poly_labels, {b})"
    return audit.agg(
        F.expr("count(1) AS total_samples"), F.expr("count_if(has_annotation) AS with_annotation"),
        F.expr(f"count_if({has_a}) AS first_count"), F.expr(f"count_if({has_b}) AS second_count"),
        F.expr(f"count_if(({has_a}) AND ({has_b})) AS both_count"),
    ).selectExpr("*", *[
        f"try_divide({c}_count * 100e0, total_samples) AS {c}_pct"
        for c in ("first", "second", "both")
    ])
