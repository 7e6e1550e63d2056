"""Label datasets from annotation documents: pose rows, one-point rows and box rows.

Geometry is computed once per document, before the document meets its images. A document is one
row with its shapes nested, so a build shuffles documents and image names by sample and never
gathers shapes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spinelens import vocab
from spinelens.functions import boxes as B
from spinelens.functions import label_text, names
from spinelens.functions import points as P
from spinelens.operators.winners import kept_rows

KEYPOINT_TYPE = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, v: INT>>"


def first_documents(docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The first document of each sample in path order; paths are unique inside a sample.

    The choice is made on samples and paths alone. ``rows`` (``docs`` itself, if not given) may be anything computed row by
    row from the documents: it is moved once, dealt by sample and path, so a sample with very many documents is no
    hot key, and meets the chosen paths without being sorted.
    """
    first = docs.select("sample_id", "doc_path").groupBy("sample_id").agg(F.expr("min(doc_path) AS doc_path"))
    return (docs if rows is None else rows).join(first.hint("shuffle_hash"), ["sample_id", "doc_path"], "left_semi")


def pose_objects(docs: DataFrame) -> DataFrame:
    """Per document the pose objects of its training polygons, in shape order.

    ``n_polygons`` counts the training polygons, ``objects`` holds those with a known class.
    """
    excluded = ", ".join(f"'{x}'" for x in vocab.NON_POLYGON_LABELS)
    polygons = (
        "filter(shapes, s -> s.shape_type = 'polygon' AND size(s.points) >= 4"
        f" AND NOT coalesce(s.label IN ({excluded}), false))"
    )
    known = (
        f"filter(transform(polygons, s -> named_struct('class_id', CAST({names.class_id('s.label')} AS INT),"
        f" 'points', {P.points_from_pairs('s.points')})), s -> s.class_id IS NOT NULL)"
    )
    geometry = (
        f"transform(known, s -> named_struct('class_id', s.class_id, 'bounds', {P.bounds('s.points')},"
        f" 'corners', {P.four_corners('s.points')}))"
    )
    passed = [c for c in docs.columns if c != "shapes"]
    return (
        docs.selectExpr(*passed, f"{polygons} AS polygons")
        .selectExpr(*passed, "coalesce(size(polygons), 0) AS n_polygons", f"{known} AS known")
        .selectExpr(*passed, "n_polygons", "coalesce(size(known), 0) AS n_objects",
                    f"{geometry} AS objects")
    )


def point_objects(docs: DataFrame) -> DataFrame:
    """Per document the number of femoral-head points and the first one's coordinates."""
    heads = (
        f"filter(shapes, s -> s.label = '{vocab.CFH_LABEL}' AND s.shape_type = 'point'"
        " AND size(s.points) > 0)"
    )
    passed = [c for c in docs.columns if c != "shapes"]
    return docs.selectExpr(
        *passed, f"coalesce(size({heads}), 0) AS n_points",
        f"get(get({heads}, 0).points, 0) AS pair",
    ).selectExpr(*passed, "n_points",
                 f"CASE WHEN n_points = 1 THEN {P.point('get(pair, 0)', 'get(pair, 1)')} END AS head")


def build_images(images: DataFrame, selected: DataFrame) -> DataFrame:
    """Image files of the selected samples with an extension of the build."""
    return images.filter(F.col("ext").isin(vocab.BUILD_EXTENSIONS)).join(
        selected.select("sample_id"), "sample_id", "left_semi")


def last_writer_wins(images: DataFrame) -> DataFrame:
    """One image per stem: the label file of a stem is overwritten by the later sample, and inside
    a sample by the later extension."""
    ranked = images.withColumn("__rank", F.expr(names.extension_rank()))
    return kept_rows(ranked, ["stem"], ["sample_id", "__rank"]).drop("__rank")


def stem_collisions(images: DataFrame) -> DataFrame:
    """Stems that more than one image file writes to."""
    return images.groupBy("stem").agg(
        F.expr("count(1) AS n_writers"), F.expr("min(sample_id) AS first_sample"),
        F.expr("max(sample_id) AS last_sample"),
    ).filter("n_writers > 1")


def image_manifest(images: DataFrame) -> DataFrame:
    """Which source file ends up under which destination name."""
    last = kept_rows(images.select("file_name", "sample_id", "path"), ["file_name"], ["sample_id"])
    return last.selectExpr("path AS src_path", "file_name AS dst_name", "sample_id")


def _written(images: DataFrame, ready: DataFrame) -> DataFrame:
    return images.filter("width > 0 AND height > 0").join(
        ready.select("sample_id"), "sample_id", "left_semi")


def _image_counts(images: DataFrame) -> DataFrame:
    return images.groupBy("sample_id").agg(
        F.expr("count(1) AS n_images"),
        F.expr("count_if(width > 0 AND height > 0) AS n_readable"),
    )


def _failures(selected: DataFrame, docs: DataFrame, images: DataFrame, invalid: str,
              writes: str) -> DataFrame:
    """Selected samples that give no label file, with the first reason that applies."""
    status = selected.select("sample_id").join(docs, "sample_id", "left").join(
        _image_counts(images), "sample_id", "left")
    return status.selectExpr(
        "sample_id",
        "CASE WHEN doc_path IS NULL THEN 'No JSON file'"
        " WHEN coalesce(n_images, 0) = 0 THEN 'No image file'"
        " WHEN unreadable THEN 'Unreadable JSON file'"
        f" {invalid}"
        f" WHEN NOT ({writes}) OR n_readable = 0 THEN 'Processed 0 images' END AS reason",
    ).filter("reason IS NOT NULL")


def _with_unreadable(docs: DataFrame) -> DataFrame:
    if "_corrupt_record" not in docs.columns:
        return docs.withColumn("unreadable", F.lit(False))
    return docs.withColumn("unreadable", F.expr("_corrupt_record IS NOT NULL")).drop("_corrupt_record")


def _first_selected(selected: DataFrame, docs: DataFrame, objects) -> DataFrame:
    """What ``objects`` makes of the first document of each selected sample.

    Geometry is computed row by row before anything is moved, so no shuffle carries shapes.
    """
    wanted = docs.select("sample_id", "doc_path").join(selected.select("sample_id"), "sample_id", "left_semi")
    read = docs.select("sample_id", "doc_path", "shapes", *[c for c in docs.columns if c == "_corrupt_record"])
    return first_documents(wanted, objects(_with_unreadable(read)))


def build_pose_dataset(
    selected: DataFrame, docs: DataFrame, images: DataFrame
) -> dict[str, DataFrame]:
    """Pose label rows of the selected samples, the image manifest and the failed samples.

    The first document of a sample applies to every image of the sample.
    """
    objects = _first_selected(selected, docs, pose_objects)
    usable = build_images(images, selected)
    written = _written(usable, objects.filter("n_objects > 0"))
    box = P.bounds_to_norm_box("object.bounds", "width", "height")
    corners = (
        "transform(object.corners, p ->"
        " named_struct('x', p.x / width, 'y', p.y / height, 'v', 2))"
    )
    rows = (
        last_writer_wins(written.select("stem", "sample_id", "ext", "width", "height"))
        .join(objects.filter("n_objects > 0").select("sample_id", "objects"), "sample_id")
        .selectExpr("stem", "width", "height", "posexplode(objects) AS (pos, object)")
        .selectExpr("stem", "pos + 1 AS line_no", "object.class_id AS class_id", f"{box} AS box",
                    f"{corners} AS keypoints")
        .select("stem", "line_no", "class_id", "box.*", "keypoints")
    )
    return {
        "labels": rows,
        "manifest": image_manifest(written),
        "failures": _failures(
            selected, objects.drop("objects"), usable,
            "WHEN n_polygons = 0 THEN 'No valid annotations'", "n_objects > 0"),
    }


def build_point_dataset(
    selected: DataFrame, docs: DataFrame, images: DataFrame
) -> dict[str, DataFrame]:
    """One-keypoint label rows, boxes of negative size, manifest and failed samples.

    A sample needs exactly one femoral-head point in its first document.
    """
    objects = _first_selected(selected, docs, point_objects)
    usable = build_images(images, selected)
    written = _written(usable, objects.filter("n_points = 1"))
    box = P.bounds_to_norm_box("bounds", "width", "height")
    rows = (
        last_writer_wins(written.select("stem", "sample_id", "ext", "width", "height"))
        .join(objects.filter("n_points = 1").select("sample_id", "head"), "sample_id")
        .selectExpr("stem", "width", "height", "head",
                    f"{B.fixed_box('head.x', 'head.y', 'width', 'height')} AS bounds")
        .selectExpr(
            "stem", "1 AS line_no", "0 AS class_id", f"{box} AS box",
            "array(named_struct('x', head.x / width, 'y', head.y / height, 'v', 2)) AS keypoints")
        .select("stem", "line_no", "class_id", "box.*", "keypoints")
    )
    return {
        "labels": rows.filter("w >= 0 AND h >= 0"),
        "rejects": rows.filter("NOT (w >= 0 AND h >= 0)"),
        "manifest": image_manifest(written),
        "failures": _failures(
            selected, objects.drop("head"), usable,
            "WHEN n_points <> 1 THEN"
            " concat('CFH keypoints count: ', n_points, ' (expected 1)')", "n_points = 1"),
    }


def failure_head(failures: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` failed samples by id, each with its rank and with how many samples the list leaves out."""
    total = failures.agg(F.expr("count(1) AS total")).scalar()
    listed = failures.select("sample_id", "reason").orderBy("sample_id").limit(k)
    ranked = listed.withColumn("rank", F.row_number().over(Window.orderBy("sample_id")))
    return ranked.withColumn("not_listed", F.greatest(total - F.lit(k), F.lit(0)))


def failure_reasons(failures: DataFrame) -> DataFrame:
    """Failed samples per reason, most frequent first."""
    return failures.groupBy("reason").agg(F.expr("count(1) AS n_samples")).orderBy(
        F.desc("n_samples"), "reason")


def named_images(docs: DataFrame, images: DataFrame) -> DataFrame:
    """Each document, or what was computed from it, with the one image its ``imagePath`` names.

    Documents without a name are left out; ``found`` is false where the file is absent or has no
    readable size. Image names are unique inside a sample, so no document is multiplied; a sample
    that holds a large share of the documents is split by the skew join.
    """
    sized = images.select("sample_id", F.col("file_name").alias("imagePath"), "stem", "width", "height")
    return docs.filter("imagePath IS NOT NULL AND imagePath <> ''").join(
        sized, ["sample_id", "imagePath"], "left"
    ).withColumn("found", F.expr("coalesce(width > 0 AND height > 0, false)"))


def box_parts(docs: DataFrame) -> DataFrame:
    """Per document its femoral-head points and the mean height of its reference shapes, row by row."""
    heads = f"filter(shapes, s -> s.label = '{vocab.CFH_LABEL}' AND size(s.points) > 0)"
    references = (
        f"filter(shapes, s -> coalesce(s.label, '') <> '{vocab.CFH_LABEL}' AND size(s.points) >= 4)"
    )
    height = (
        "transform(refs, s -> array_max(transform(s.points, p -> get(p, 1)))"
        " - array_min(transform(s.points, p -> get(p, 1))))"
    )
    mean = "CASE WHEN size(heights) > 0 THEN aggregate(heights, 0e0, (a, h) -> a + h) / size(heights) END"
    passed = ["sample_id", "doc_path", "imagePath"]
    return (
        docs.selectExpr(*passed, f"{heads} AS heads", f"{references} AS refs")
        .selectExpr(*passed,
                    f"transform(heads, s -> {P.point('get(get(s.points, 0), 0)', 'get(get(s.points, 0), 1)')}) AS heads",
                    f"{height} AS heights")
        .selectExpr(*passed, "coalesce(heads, array()) AS heads", f"{mean} AS avg_height")
    )


def box_objects(named: DataFrame, multiplier: float = vocab.BOX_MULTIPLIER) -> DataFrame:
    """Per document on its image the femoral-head points and the box side in pixels."""
    return named.selectExpr(
        "sample_id", "doc_path", "stem", "width", "height", "found", "heads",
        f"{B.adaptive_side('avg_height', 'width', 'height', multiplier)} AS side")


def build_box_dataset(
    docs: DataFrame, images: DataFrame, multiplier: float = vocab.BOX_MULTIPLIER
) -> dict[str, DataFrame]:
    """Femoral-head box rows of all samples, the copied images and the conversion counters.

    The last document of a stem, by sample and path, is chosen on these columns; its points come by a join.
    """
    objects = box_objects(named_images(box_parts(docs), images), multiplier)
    kept = objects.filter("found AND size(heads) > 0")
    named = kept.select("stem", "sample_id", "doc_path")
    last = named.groupBy("stem").agg(F.expr("max(struct(sample_id, doc_path)) AS kept")).selectExpr("stem", "kept.*")
    box = B.point_to_norm_box("head.x", "head.y", "side", "width", "height")
    rows = (
        kept.join(last.hint("shuffle_hash"), ["stem", "sample_id", "doc_path"], "left_semi")
        .selectExpr("stem", "side", "width", "height", "posexplode(heads) AS (pos, head)")
        .selectExpr("stem", "pos + 1 AS line_no", "0 AS class_id", f"{box} AS box",
                    f"CAST(array() AS {KEYPOINT_TYPE}) AS keypoints")
        .select("stem", "line_no", "class_id", "box.*", "keypoints")
    )
    counts = objects.agg(
        F.expr("count_if(found AND size(heads) > 0) AS total_images"),
        F.expr("coalesce(sum(CASE WHEN found THEN size(heads) END), 0L) AS total_objects"),
        F.expr("count_if(NOT found) AS skipped"),
    )
    return {"labels": rows, "images": kept.select("sample_id", "doc_path", "stem"), "counts": counts}


def reference_heights(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """Mean height of the reference shapes of each document, for shapes in long form."""
    return shapes.selectExpr(
        *keys, "array_max(points.y) - array_min(points.y) AS shape_height"
    ).groupBy(*keys).agg(F.expr("avg(shape_height) AS avg_height"))


def with_line(labels: DataFrame, keypoints: bool = True) -> DataFrame:
    """Adds the text form of a label row."""
    return labels.withColumn(
        "line", F.expr(label_text.format_line(keypoints="keypoints" if keypoints else None)))
