"""Checks of a label dataset: pairing, totals, class distribution, format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens import vocab
from spinelens.functions import names

# Fields per line, whether more are wrong, and valid class ids of each dataset kind.
KINDS = {
    "vertebra": {"fields": 17, "exact": False, "classes": (0, 17)},
    "cfh": {"fields": 8, "exact": True, "classes": (0, 0)},
    "merged": {"fields": 17, "exact": True, "classes": (0, 18)},
}


def pairing_missing(image_stems: DataFrame, label_stems: DataFrame) -> DataFrame:
    """Stems with an image but no label file, or the reverse.

    Both differences come out of one aggregation over the tagged union, which also removes
    repeated stems before the shuffle.
    """
    tagged = image_stems.selectExpr("stem", "true AS is_image").unionByName(
        label_stems.selectExpr("stem", "false AS is_image"))
    return tagged.groupBy("stem").agg(
        F.expr("bool_or(is_image) AS has_image"), F.expr("bool_or(NOT is_image) AS has_label"),
    ).filter("NOT (has_image AND has_label)").selectExpr(
        "stem", "CASE WHEN has_image THEN 'label' ELSE 'image' END AS missing")


def listing_head(df: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """First ``k`` rows of a listing."""
    return df.orderBy(*order).limit(k)


def class_distribution(lines: DataFrame, kind: str = "merged") -> DataFrame:
    """Objects per class among complete rows, as a share of all lines.

    ``lines``: n_fields, class_id. The total is a sum over the class counts, not a window over all class ids of a text.
    """
    n_classes = len(vocab.MERGED_CLASSES) if kind == "merged" else len(vocab.VERTEBRA_CLASSES)
    per_class = lines.groupBy("class_id").agg(
        F.expr("count(1) AS n_lines"),
        F.expr("count_if(n_fields >= 17 AND class_id IS NOT NULL) AS n_objects"),
    )
    total = per_class.agg(F.expr("sum(n_lines) AS total")).scalar()
    return per_class.filter("n_objects > 0").withColumn("total", total).selectExpr(
        "class_id", f"{names.class_name('class_id', 'Unknown_', n_classes)} AS label", "n_objects",
        "try_divide(n_objects * 100e0, total) AS pct")


def keypoint_totals(lines: DataFrame, label_files: DataFrame, kind: str = "merged") -> DataFrame:
    """Objects, visible keypoints and mean objects per label file.

    ``label_files`` lists one stem per file, also for files without a line.
    """
    complete = "n_fields >= 17"
    rules = {
        "vertebra": (f"4 * count_if({complete})", "0"),
        "cfh": ("0", "count(1)"),
        "merged": (f"4 * count_if({complete} AND class_id <> {vocab.CFH_CLASS_ID})",
                   f"count_if({complete} AND class_id = {vocab.CFH_CLASS_ID})"),
    }
    vertebra, cfh = rules[kind]
    tagged = lines.selectExpr("n_fields", "class_id", "true AS is_line").unionByName(
        label_files.selectExpr("CAST(NULL AS INT) AS n_fields", "CAST(NULL AS INT) AS class_id",
                               "false AS is_line"))

    def on_lines(expression: str) -> str:
        return expression.replace("count(1)", "count_if(is_line)")

    return tagged.agg(
        F.expr("count_if(is_line) AS total_objects"),
        F.expr(f"CAST({on_lines(vertebra)} AS BIGINT) AS vertebra_keypoints"),
        F.expr(f"CAST({on_lines(cfh)} AS BIGINT) AS cfh_keypoints"),
        F.expr("count_if(NOT is_line) AS label_files"),
    ).selectExpr(
        "total_objects", "vertebra_keypoints + cfh_keypoints AS total_keypoints",
        "vertebra_keypoints", "cfh_keypoints", "label_files",
        "try_divide(CAST(total_objects AS DOUBLE), label_files) AS objects_per_file",
    )


def format_violations(lines: DataFrame, kind: str = "merged") -> DataFrame:
    """Every line with a wrong field count or class id, with the rule it breaks."""
    spec = KINDS[kind]
    low, high = spec["classes"]
    wrong, least = ("<>", "") if spec["exact"] else ("<", "at least ")
    return lines.selectExpr(
        "stem", "line_no", "n_fields", "class_id",
        f"CASE WHEN n_fields {wrong} {spec['fields']} THEN"
        f" concat('expected {least}{spec['fields']} fields, found ', n_fields)"
        " WHEN class_id IS NULL THEN 'class id is not a number'"
        f" WHEN class_id < {low} OR class_id > {high} THEN"
        f" concat('class id ', class_id, ' outside {low}-{high}') END AS violation",
    ).filter("violation IS NOT NULL")


def format_examples(lines: DataFrame) -> DataFrame:
    """The first vertebra line and the first femoral-head line as format witnesses.

    One aggregate without groups: nothing is sorted, and each task hands on one line per kind.
    """
    firsts = ", ".join(
        f"min_by(named_struct('kind', '{kind}', 'stem', stem, 'line_no', line_no, 'line', line, 'n_fields', n_fields),"
        f" struct(stem, line_no)) FILTER (WHERE class_id {rule} {vocab.CFH_CLASS_ID})"
        for kind, rule in (("vertebra", "<"), ("cfh", "=")))
    return lines.agg(F.expr(f"array_compact(array({firsts})) AS firsts")).selectExpr("inline(firsts)").withColumn(
        "valid", F.expr("n_fields = 17"))


def descriptor_violations(
    descriptor: DataFrame, nc: int = 18, kpt_shape: tuple[int, ...] = (4, 3)
) -> DataFrame:
    """Rules a descriptor row breaks."""
    shape = f"array({', '.join(map(str, kpt_shape))})"
    return descriptor.selectExpr(
        "explode(filter(array("
        f"CASE WHEN nc IS DISTINCT FROM {nc} THEN"
        f" concat('nc: expected {nc}, found ', coalesce(CAST(nc AS STRING), 'nothing')) END,"
        f"CASE WHEN kpt_shape IS DISTINCT FROM {shape} THEN 'kpt_shape: expected {list(kpt_shape)}' END"
        "), v -> v IS NOT NULL)) AS violation")
