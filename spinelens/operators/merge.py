"""Union of a vertebra label dataset and a femoral-head label dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens import vocab
from spinelens.operators.numbering import number_within


def recode_and_pad(points: DataFrame) -> DataFrame:
    """One-keypoint rows as merged-class rows: class 18, first keypoint, three invisible ones.

    Rows without a complete keypoint are left out.
    """
    pad = "array_repeat(named_struct('x', 0e0, 'y', 0e0, 'v', 0), 3)"
    return points.filter("size(keypoints) >= 1").selectExpr(
        "stem", "line_no", f"{vocab.CFH_CLASS_ID} AS class_id", "cx", "cy", "w", "h",
        f"concat(slice(keypoints, 1, 1), {pad}) AS keypoints",
    )


def merge_label_rows(corners: DataFrame, points: DataFrame) -> DataFrame:
    """All vertebra rows of a stem followed by its femoral-head rows, renumbered."""
    columns = ["stem", "line_no", "class_id", "cx", "cy", "w", "h", "keypoints"]
    both = corners.select(*columns, F.lit(0).alias("src")).unionByName(
        recode_and_pad(points).select(*columns, F.lit(1).alias("src")))
    numbered = number_within(both, ["stem"], "src", "line_no", "merged_no")
    return numbered.withColumn("line_no", F.col("merged_no").cast("int")).drop("merged_no", "src")


def merge_images(left: DataFrame, right: DataFrame) -> DataFrame:
    """One image per stem of either dataset, the left one where both have it."""
    tagged = left.selectExpr("stem", "file_name", "0 AS src").unionByName(
        right.selectExpr("stem", "file_name", "1 AS src"))
    return tagged.groupBy("stem").agg(
        F.expr("min_by(file_name, src) AS file_name"),
        F.expr("bool_or(src = 0) AS in_corner"), F.expr("bool_or(src = 1) AS in_cfh"),
    )


def merge_stats(
    corner_images: DataFrame, cfh_images: DataFrame, corners: DataFrame, points: DataFrame,
    corner_files: DataFrame | None = None, cfh_files: DataFrame | None = None,
) -> DataFrame:
    """Image and object counters of the merged dataset.

    Label files may be listed separately so that an empty one still counts as present; without a
    list the stems of the rows are taken. All six inputs are reduced to flags and counts per stem
    in one aggregation. Labels of a stem without any image are not merged and not counted.
    """
    def tagged(df: DataFrame, **values: str) -> DataFrame:
        names = ("has_image", "has_corner", "has_cfh", "n_corner", "n_cfh")
        return df.selectExpr("stem", *[f"CAST({values.get(n, '0')} AS BIGINT) AS {n}" for n in names])

    parts = [
        tagged(corner_images, has_image="1"),
        tagged(cfh_images, has_image="1"),
        tagged(corners, has_corner="1", n_corner="1"),
        tagged(points, has_cfh="1", n_cfh="CASE WHEN size(keypoints) >= 1 THEN 1 ELSE 0 END"),
    ]
    if corner_files is not None:
        parts.append(tagged(corner_files, has_corner="1"))
    if cfh_files is not None:
        parts.append(tagged(cfh_files, has_cfh="1"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    per_stem = union.groupBy("stem").agg(
        *[F.expr(f"max({c}) AS {c}") for c in ("has_image", "has_corner", "has_cfh")],
        *[F.expr(f"sum({c}) AS {c}") for c in ("n_corner", "n_cfh")],
    ).filter("has_image = 1")
    return per_stem.agg(
        F.expr("count(1) AS total_images"),
        F.expr("count_if(has_corner = 1 AND has_cfh = 0) AS corner_only"),
        F.expr("count_if(has_corner = 0 AND has_cfh = 1) AS cfh_only"),
        F.expr("count_if(has_corner = 1 AND has_cfh = 1) AS both"),
        F.expr("coalesce(sum(n_corner), 0L) AS vertebra_objects"),
        F.expr("coalesce(sum(n_cfh), 0L) AS cfh_objects"),
    )


def dataset_descriptor(
    totals: DataFrame, class_names: list[str], kpt_shape: list[int] | None, description: str
) -> DataFrame:
    """Descriptor row of a dataset: class count, names, keypoint shape and its totals."""
    names = ", ".join(f"{i}, '{n}'" for i, n in enumerate(class_names))
    shape = f"array({', '.join(map(str, kpt_shape))})" if kpt_shape else "CAST(NULL AS ARRAY<INT>)"
    return totals.selectExpr(
        f"{len(class_names)} AS nc", f"map({names}) AS names", f"{shape} AS kpt_shape",
        f"'{description}' AS description", *totals.columns,
    )


def descriptor_yaml(descriptor: DataFrame) -> DataFrame:
    """YAML text of a descriptor row; every further column goes under ``dataset_info``."""
    fixed = ("nc", "names", "kpt_shape", "description")
    lines = ["'path: .'", "'train: images'", "'val: images'", "concat('nc: ', nc)", "'names:'",
             "array_join(transform(map_entries(names), e -> concat('  ', e.key, ': ', e.value)), '\\n')",
             "CASE WHEN kpt_shape IS NOT NULL THEN"
             " concat('kpt_shape: [', array_join(kpt_shape, ', '), ']') END",
             "'dataset_info:'", "concat('  description: \"', description, '\"')"]
    lines += [f"concat('  {c}: ', {c})" for c in descriptor.columns if c not in fixed]
    return descriptor.selectExpr(f"concat_ws('\\n', {', '.join(lines)}) AS yaml")
