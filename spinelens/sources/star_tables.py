"""Model views over the star-schema tables of a data directory.

Every view is a projection (or a bounded explode) of whole tables, so its size follows theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinelens import vocab

LABELS = ["C7", "T1", "T2", "T5", "T12", "L1", "L4", "L5", "C2", "T3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detector box per lineitem row, with half sizes and a tilt."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey div 4 AS image_id",
        "(l_orderkey % 4) * 1000000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber"
        " AS det_idx",
        "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
        "0.1e0 + 0.8e0 * ((l_partkey * 7919) % 1000) / 1000e0 AS cx",
        "0.1e0 + 0.8e0 * ((l_suppkey * 104729 + l_linenumber * 31) % 1000) / 1000e0 AS cy",
        "0.01e0 + 0.0004e0 * l_quantity AS hw",
        "0.01e0 + 0.1e0 * l_tax AS hh",
        "0.05e0 * (l_discount - 0.05e0) AS t",
        "0.1e0 + 0.9e0 * ((l_partkey + l_suppkey) % 97) / 96e0 AS confidence",
    ).selectExpr(
        "*", "CAST(1500 + 100 * (image_id % 7) AS INT) AS image_width",
        "CAST(3000 + 100 * (image_id % 5) AS INT) AS image_height",
    )


def vertebrae(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Vertebra detections with four normalised corners, of the line items that ``where`` holds for."""
    names = ", ".join(f"'{n}'" for n in LABELS)
    return _boxes(spark, sf_dir).filter(where).selectExpr(
        "image_id", "det_idx",
        f"get(array({names}), CAST(l_partkey % 10 AS INT)) AS label", "confidence",
        "array(named_struct('x', cx - hw, 'y', cy - hh + t), named_struct('x', cx + hw, 'y', cy - hh - t),"
        " named_struct('x', cx + hw, 'y', cy + hh - t), named_struct('x', cx - hw, 'y', cy + hh + t))"
        " AS keypoints",
        "image_width", "image_height",
    )


def cfh_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Femoral-head candidates; the first one of an image counts."""
    return _boxes(spark, sf_dir).filter("l_partkey % 13 = 0").selectExpr(
        "image_id", "det_idx", "confidence", "named_struct('x', cx, 'y', cy) AS center",
        "image_width", "image_height",
    )


def raw_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector output in pixels; class ids 18 and 19 are unknown to the detector."""
    return _boxes(spark, sf_dir).selectExpr(
        "image_id", "det_idx", "CAST(l_partkey % 20 AS INT) AS class_id", "confidence",
        "(cx - hw) * image_width AS x1", "(cy - hh) * image_height AS y1",
        "(cx + hw) * image_width AS x2", "(cy + hh) * image_height AS y2",
        "l_linenumber", "image_width", "image_height",
    )


def truth_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw boxes moved by up to 15 pixels, without every seventh one."""
    return raw_boxes(spark, sf_dir).filter("det_idx % 7 <> 0").selectExpr(
        "image_id", "det_idx AS truth_idx", "class_id",
        "x1 + 5 * (l_linenumber - 4) AS x1", "y1 + 5 * (l_linenumber - 4) AS y1",
        "x2 + 5 * (l_linenumber - 4) AS x2", "y2 + 5 * (l_linenumber - 4) AS y2",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"))


def sample_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero, one or two image files per sample; stems are shared by three samples each."""
    return (
        table(spark, sf_dir, "orders").filter("o_orderkey % 3 > 0")
        .selectExpr("o_orderkey AS sample_id",
                    "explode(sequence(1, CAST(o_orderkey % 3 AS INT))) AS k")
        .selectExpr(
            "sample_id",
            "concat('im', sample_id div 9, '_', k) AS stem",
            "CASE WHEN sample_id % 2 = 0 THEN 'png' ELSE 'jpg' END AS ext",
            "CAST(1000 + 100 * (sample_id % 4) AS INT) AS width",
            "CAST(2000 + 100 * (sample_id % 3) AS INT) AS height",
        )
        .withColumn("file_name", F.expr("concat(stem, '.', ext)"))
    )


def sample_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled shapes: a polygon per lineitem row and a point per returned row."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS sample_id", "l_linestatus AS doc_path",
        "explode(CASE WHEN l_returnflag = 'R' THEN"
        " array(named_struct('label', concat('V', l_linenumber), 'shape_type', 'polygon'),"
        "       named_struct('label', 'P', 'shape_type', 'point'))"
        " ELSE array(named_struct('label', concat('V', l_linenumber), 'shape_type', 'polygon')) END)"
        " AS shape",
    ).select("sample_id", "doc_path", "shape.label", "shape.shape_type")


def sample_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per annotation document of a sample."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS sample_id", "l_linestatus AS doc_path").distinct()


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 32-vertex polygon per embedding, ten per image stem, on 1000 x 1000 images."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "concat('img', vec_id div 10) AS stem", "CAST(vec_id % 10 AS INT) AS shape_idx",
        "CAST(label AS INT) AS class_id",
        "transform(sequence(0, 31), k -> named_struct("
        "'x', 500e0 + 1000e0 * CAST(get(embedding, 2 * k) AS DOUBLE),"
        "'y', 500e0 + 1000e0 * CAST(get(embedding, 2 * k + 1) AS DOUBLE))) AS points",
        "1000 AS width", "1000 AS height",
    )


def measurement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement rows with repeated types and one to seven points each."""
    kinds = ", ".join(f"'{t}'" for t in vocab.MEASUREMENT_TYPES)
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey div 4 AS image_id",
        "(l_orderkey % 4) * 1000000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS ord",
        f"get(array({kinds}), CAST(l_partkey % 12 AS INT)) AS type",
        "transform(sequence(1, 1 + CAST(l_suppkey % 7 AS INT)), k -> named_struct("
        "'x', CAST((l_partkey * 31 + k * 577) % 2000 AS DOUBLE),"
        "'y', CAST((l_suppkey * 17 + k * 839 + l_linenumber) % 4000 AS DOUBLE))) AS points",
    )


def keypoint_doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One keypoints document per embedding as JSON text; the first type comes twice."""
    def entry(j: int, n: int) -> str:
        kind = vocab.MEASUREMENT_TYPES[j % 12]
        return (
            f"named_struct('type', '{kind}', 'points', transform(sequence(0, {n - 1}), k ->"
            f" named_struct('x', 1000e0 * CAST(get(embedding, ({5 * j} + 2 * k) % 64) AS DOUBLE),"
            f" 'y', 1000e0 * CAST(get(embedding, ({5 * j} + 2 * k + 1) % 64) AS DOUBLE))))"
        )

    sizes = [2, 4, 4, 4, 4, 4, 3, 2, 7, 3, 4, 2, 2]
    entries = ", ".join(entry(j, n) for j, n in enumerate(sizes))
    return table(spark, sf_dir, "embeddings").selectExpr(
        "to_json(named_struct('imageId', CASE WHEN vec_id % 10 <> 0 THEN concat('d', vec_id) END,"
        " 'imageWidth', 2000, 'imageHeight', 4000,"
        f" 'measurements', array({entries}),"
        " 'standardDistance', CASE WHEN vec_id % 2 = 0 THEN 50e0 END)) AS value")


def detection_doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection document per embedding as JSON text: eight vertebrae, some with three
    keypoints, a femoral head in most of them."""
    names = ", ".join(f"'{n}'" for n in LABELS)
    return table(spark, sf_dir, "embeddings").selectExpr(
        "to_json(named_struct('image_id', concat('d', vec_id), 'image_width', 2000, 'image_height', 4000,"
        " 'vertebrae', transform(sequence(0, 7), j -> named_struct("
        f"'label', get(array({names}), CAST((vec_id + 3 * j + j div 4) % 10 AS INT)),"
        " 'confidence', 0.5e0, 'bbox', array(0.5e0, 0.5e0, 0.1e0, 0.1e0), 'keypoints',"
        " transform(sequence(0, CASE WHEN vec_id % 50 = 7 AND j = 5 THEN 2 ELSE 3 END), k ->"
        " named_struct('x', CAST(get(embedding, CAST(8 * j + 2 * k AS INT)) AS DOUBLE),"
        " 'y', CAST(get(embedding, CAST(8 * j + 2 * k + 1 AS INT)) AS DOUBLE))))),"
        " 'cfh', CASE WHEN vec_id % 4 <> 0 THEN named_struct('confidence', 0.9e0,"
        " 'bbox', array(0.5e0, 0.5e0, 0.1e0, 0.1e0), 'center', named_struct("
        "'x', CAST(get(embedding, 0) AS DOUBLE) + 0.5e0, 'y', CAST(get(embedding, 1) AS DOUBLE))) END"
        ")) AS value")


def corpus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotation document per ten embeddings: polygons with all kinds of labels and sizes,
    zero to two femoral-head points.

    ``vec_id`` is a key, so a document gathers at most twenty shapes.
    """
    label = (
        "CASE WHEN label < 8 THEN get(array('C7', 'L1', 'L2', 'L3', 'L4', 'L5', 'T1', 'T2'), CAST(label AS INT))"
        " WHEN label = 8 THEN 'T13' ELSE 'X9' END"
    )
    pairs = (
        "transform(sequence(0, CASE WHEN vec_id % 13 = 0 THEN 2 ELSE 31 END), k -> array("
        "500e0 + 1000e0 * CAST(get(embedding, 2 * k) AS DOUBLE),"
        "500e0 + 1000e0 * CAST(get(embedding, 2 * k + 1) AS DOUBLE)))"
    )
    polygon = (
        f"named_struct('label', {label}, 'shape_type',"
        f" CASE WHEN vec_id % 17 = 0 THEN 'rectangle' ELSE 'polygon' END, 'points', {pairs})"
    )
    head = "named_struct('label', 'CFH', 'shape_type', 'point', 'points', slice(%s, 1, 1))" % pairs
    return (
        table(spark, sf_dir, "embeddings").filter("vec_id div 10 % 9 <> 4").selectExpr(
            "vec_id div 10 AS sample_id", "vec_id",
            "CASE WHEN (vec_id % 10 = 3 AND vec_id div 10 % 4 <> 0)"
            "  OR (vec_id % 10 = 7 AND vec_id div 10 % 5 = 0)"
            f" THEN array({head}, {polygon}) ELSE array({polygon}) END AS part")
        .groupBy("sample_id").agg(F.expr(
            "flatten(transform(sort_array(collect_list(struct(vec_id, part))), e -> e.part)) AS shapes"))
        .selectExpr(
            "sample_id", "'a.json' AS doc_path", "shapes",
            "CASE WHEN sample_id % 6 = 0 THEN '' WHEN sample_id % 6 = 3 THEN 'none.png'"
            " ELSE concat('im', sample_id div 2, '_1.', CASE WHEN sample_id % 2 = 0 THEN 'png' ELSE 'jpg' END)"
            " END AS imagePath")
    )


def corpus_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero to two images per document; neighbouring samples share stems, some sizes are unknown."""
    return (
        table(spark, sf_dir, "embeddings").selectExpr("vec_id div 10 AS sample_id").distinct()
        .filter("sample_id % 3 > 0")
        .selectExpr("sample_id", "explode(sequence(1, CAST(sample_id % 3 AS INT))) AS k")
        .selectExpr(
            "sample_id", "concat('im', sample_id div 2, '_', k) AS stem",
            "CASE WHEN sample_id % 2 = 0 THEN 'png' ELSE 'jpg' END AS ext",
            "CASE WHEN sample_id % 11 = 2 AND k = 1 THEN NULL"
            " ELSE CAST(1000 + 100 * (sample_id % 4) AS INT) END AS width",
            "CAST(1100 + 100 * (sample_id % 3) AS INT) AS height",
        ).selectExpr("*", "concat(stem, '.', ext) AS file_name",
                     "concat(sample_id, '/', stem, '.', ext) AS path")
    )


def corpus_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id div 10 AS sample_id").filter(
        "sample_id % 7 <> 5").distinct()


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label text lines: 17 fields, every eleventh part cut to nine, some class ids not numbers."""
    box = "a, b, a, b"
    keypoints = ", ".join("a, b, '2'" for _ in range(4))
    class_text = ("CASE WHEN l_partkey % 101 = 0 THEN concat('x', l_partkey % 20)"
                  " ELSE CAST(l_partkey % 20 AS STRING) END AS class_text")
    number = "concat('0.', lpad(CAST((l_suppkey * {} + l_linenumber) % 1000 AS STRING), 3, '0'))"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS stem", "l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS line_no",
        "l_partkey", class_text, f"{number.format(7)} AS a", f"{number.format(8)} AS b",
    ).selectExpr(
        "stem", "line_no",
        f"CASE WHEN l_partkey % 11 = 0 THEN concat_ws(' ', class_text, {box}, a, b, '2', '0.5')"
        f" ELSE concat_ws('  ', class_text, {box}, {keypoints}) END AS line",
    )


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed label rows, the last keypoint invisible in every seventh part."""
    return _boxes(spark, sf_dir).selectExpr(
        "image_id AS stem", "det_idx AS line_no", "CAST(l_partkey % 20 AS INT) AS class_id", "cx", "cy",
        "2 * hw AS w", "2 * hh AS h",
        "array(named_struct('x', cx - hw, 'y', cy - hh + t, 'v', 2), named_struct('x', cx + hw, 'y', cy - hh - t, 'v', 2),"
        " named_struct('x', cx + hw, 'y', cy + hh - t, 'v', 2),"
        " named_struct('x', cx - hw, 'y', cy + hh + t, 'v', CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE 2 END))"
        " AS keypoints",
    )


def label_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image per stem of :func:`label_rows`."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 4 AS stem").distinct().selectExpr(
        "stem", "CAST(1500 + 100 * (stem % 7) AS INT) AS width",
        "CAST(3000 + 100 * (stem % 5) AS INT) AS height")


def corner_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-keypoint rows of one dataset of a merge, several per stem."""
    return _merge_rows(spark, sf_dir, 4).filter("l_partkey % 3 <> 0").drop("l_partkey")


def point_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-keypoint rows of the other dataset; some have no complete keypoint."""
    return _merge_rows(spark, sf_dir, 1).filter("l_partkey % 5 = 0").drop("l_partkey")


def _merge_rows(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return _boxes(spark, sf_dir).selectExpr(
        "image_id AS stem", "l_partkey",
        "det_idx AS line_no", "CAST(l_partkey % 18 AS INT) AS class_id",
        "cx", "cy", "2 * hw AS w", "2 * hh AS h",
        f"CASE WHEN {n} = 1 AND l_partkey % 4 = 0 THEN CAST(array() AS ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, v: INT>>)"
        f" ELSE transform(sequence(1, {n}), k -> named_struct('x', cx + hw / k, 'y', cy - hh / k, 'v', 2)) END"
        " AS keypoints",
    )
