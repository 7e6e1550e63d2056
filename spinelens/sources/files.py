"""Annotation, image and label files below a corpus directory ``<root>/<sample>/<file>``.

Spark's file sources do not list files of zero bytes, hidden names and empty directories; those come
from the listing source, so every sample, document, image and label file is counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinelens import schemas, vocab
from spinelens.functions import label_text, names
from spinelens.sources import listing
from spinelens.sources.image_sizes import with_image_size


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample manifest, one ``sample_id`` per line."""
    return (
        spark.read.text(path).selectExpr("trim(value) AS sample_id").filter("sample_id <> ''")
    )


def list_samples(spark: SparkSession, path: str) -> DataFrame:
    """One ``sample_id`` per directory of the corpus, also for empty ones."""
    return listing.samples(listing.list_corpus(spark, path))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotation document; an unreadable one keeps its text in ``_corrupt_record``.

    Documents that Spark does not list come from the listing; an empty one is unreadable.
    """
    docs = (
        spark.read.schema(schemas.ANNOTATION)
        .option("multiLine", True).option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
        .json(path)
    )
    read = docs.selectExpr(
        f"{names.parent_name('_metadata.file_path')} AS sample_id",
        f"{names.last_part('_metadata.file_path')} AS doc_path",
        "shapes", "imagePath", "_corrupt_record",
    )
    other = listing.files(listing.list_corpus(spark, path), ["json"]).where(listing.skipped_by_spark())
    parsed = F.from_json(F.col("text"), schemas.ANNOTATION, {"mode": "PERMISSIVE"})
    rest = listing.with_content(other).selectExpr(
        "sample_id", "file_name AS doc_path", "coalesce(CAST(content AS STRING), '') AS text",
    ).withColumn("doc", parsed)
    return read.unionByName(rest.selectExpr(
        "sample_id", "doc_path", "doc.shapes", "doc.imagePath",
        "CASE WHEN trim(text) = '' THEN text ELSE doc._corrupt_record END AS _corrupt_record"))


def read_label_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Expected labels of a vocabulary file with their line order, blanks dropped."""
    text = spark.read.text(path, wholetext=True)
    return (
        text.selectExpr("posexplode(split(value, '\\\\r?\\\\n')) AS (ord, line)")
        .selectExpr("trim(line) AS label", "ord").filter("label <> ''")
    )


def vocab_labels(vocabulary: DataFrame) -> list[str]:
    """All labels of a short vocabulary, in order, as a list. The audit operators also take the table itself."""
    return [row["label"] for row in vocabulary.orderBy("ord").collect()]


def read_image_files(
    spark: SparkSession, path: str, extensions: list[str] | None = None
) -> DataFrame:
    """One row per image file with one of the extensions (case-sensitive), empty files included. File
    contents are not read."""
    return _named(listing.files(
        listing.list_corpus(spark, path), extensions or vocab.AUDIT_EXTENSIONS))


def _named(files: DataFrame) -> DataFrame:
    rest = [c for c in files.columns if c not in ("sample_id", "file_name", "path", "length")]
    return files.selectExpr("sample_id", "file_name", f"{names.stem('file_name')} AS stem",
                            f"{names.extension('file_name')} AS ext", "path", *rest)


def read_sized_images(spark: SparkSession, path: str) -> DataFrame:
    """Build images with their width and height from the file headers, NULL where a file is unreadable.

    The corpus is listed once; of each image the first kilobytes are read.
    """
    images = listing.files(listing.list_corpus(spark, path), vocab.BUILD_EXTENSIONS)
    return _named(with_image_size(images.drop("length")))


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of label text files, numbered in file order. Each file is one small text."""
    text = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return text.selectExpr(
        f"{names.stem(names.last_part('_metadata.file_path'))} AS stem",
        "posexplode(split(regexp_replace(value, '\\\\n$', ''), '\\\\n')) AS (pos, line)",
        "length(value) = 0 AS empty",
    ).filter("NOT empty").selectExpr("stem", "pos + 1 AS line_no", "line")


def read_label_files(spark: SparkSession, path: str) -> DataFrame:
    """Stems of the label files found in a directory, also of empty ones."""
    found = listing.files(listing.list_corpus(spark, path, flat=True), ["txt"])
    return found.selectExpr(f"{names.stem('file_name')} AS stem")


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """Label lines as typed rows; what is not a number becomes NULL.

    The field array comes out of a one-element generator. A later filter on a parsed column then
    stays above it; pushed below, it would split every line again for each use of a field.
    """
    passed = lines.columns
    return lines.selectExpr(*passed, f"explode(array({label_text.fields()})) AS fields").selectExpr(
        *passed, "size(fields) AS n_fields", "try_cast(get(fields, 0) AS INT) AS class_id",
        "try_cast(get(fields, 1) AS DOUBLE) AS cx", "try_cast(get(fields, 2) AS DOUBLE) AS cy",
        "try_cast(get(fields, 3) AS DOUBLE) AS w", "try_cast(get(fields, 4) AS DOUBLE) AS h",
        f"{label_text.keypoint_fields()} AS keypoints",
    )


def read_class_names(descriptor: DataFrame) -> DataFrame:
    """Class ids and labels of a dataset descriptor row."""
    return descriptor.selectExpr("explode(names) AS (class_id, label)")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """A saved audit."""
    return spark.read.parquet(path)
