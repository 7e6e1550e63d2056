"""Listing, image headers and label files on disk."""

import json
import os
import random
import struct

import pytest

from spinelens.sinks.label_files import write_label_files
from spinelens.sources import files, image_sizes, listing
from spinelens.sources.storage import opened
from test_corpus import png


def jpeg(width, height, sof=0xC0, junk=(), tail=b"\xff\xd9"):
    out = b"\xff\xd8"
    for mark, size in junk:
        out += bytes([0xFF, mark]) + struct.pack(">H", size + 2) + b"\xff\xc0" * (size // 2) + b"x" * (size % 2)
    return out + b"\xff\xff" + bytes([sof]) + struct.pack(">HBHHB", 17, 8, height, width, 3) + bytes(9) + tail


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("listed")
    for name in ("S1", "S2", "S3", "empty", "_odd"):
        (root / name).mkdir()
    (root / "notes.txt").write_text("no sample")
    doc = json.dumps({"shapes": [{"label": "L1", "shape_type": "point", "points": [[1, 2]]}], "imagePath": "a.png"})
    (root / "S1" / "a.json").write_text(doc)
    (root / "S1" / "zero.json").write_text("")
    (root / "S1" / ".hidden.json").write_text(doc)
    (root / "S1" / "_under.json").write_text("{broken")
    (root / "S2" / "zero.png").write_bytes(b"")
    (root / "S2" / "a.png").write_bytes(png(7, 9))
    (root / "S2" / "upper.PNG").write_bytes(png(7, 9))
    (root / "S2" / "deeper").mkdir()
    (root / "S2" / "deeper" / "b.png").write_bytes(png(7, 9))
    (root / "S3" / "only.dcm").write_bytes(b"")
    return root


def reference_counts(root):
    """Images and documents per sample as a plain directory walk counts them."""
    out = {}
    for folder in root.iterdir():
        if folder.is_dir():
            names = [p.name for p in folder.iterdir() if p.is_file()]
            out[folder.name] = (sum(n.endswith((".png", ".jpg", ".jpeg", ".dcm")) for n in names), sum(n.endswith(".json") for n in names))
    return out


def test_counts_with_empty_files_and_directories(spark, corpus):
    samples = files.list_samples(spark, str(corpus))
    images = files.read_image_files(spark, str(corpus)).groupBy("sample_id").count().withColumnRenamed("count", "images")
    docs = files.read_annotations(spark, str(corpus)).groupBy("sample_id").count().withColumnRenamed("count", "docs")
    rows = samples.join(images, "sample_id", "left").join(docs, "sample_id", "left").fillna(0).collect()
    assert {r.sample_id: (r.images, r.docs) for r in rows} == reference_counts(corpus)


def test_documents_that_spark_skips(spark, corpus):
    docs = {r.doc_path: r for r in files.read_annotations(spark, str(corpus)).collect()}
    assert set(docs) == {"a.json", "zero.json", ".hidden.json", "_under.json"}
    assert docs[".hidden.json"].shapes == docs["a.json"].shapes and docs[".hidden.json"]._corrupt_record is None
    assert docs["zero.json"].shapes is None and docs["zero.json"]._corrupt_record == ""
    assert docs["_under.json"].shapes is None and docs["_under.json"]._corrupt_record == "{broken"


def test_listing_in_many_tasks(spark, tmp_path):
    for i in range(37):
        (tmp_path / f"S{i:02d}").mkdir()
        (tmp_path / f"S{i:02d}" / f"{i}.txt").write_text("x" * i)
    listing.list_corpus(spark, str(tmp_path))
    found = spark.read.format("corpus_files").option("directories", 5).load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 8
    assert {(r.sample_id, r.file_name, r.length) for r in listing.files(found, ["txt"]).collect()} == {
        (f"S{i:02d}", f"{i}.txt", i) for i in range(37)}
    uri = listing.list_corpus(spark, f"file://{tmp_path}")
    assert uri.where("file_name = '3.txt'").first().path == f"file://{tmp_path}/S03/3.txt"


def test_listing_of_nothing(spark, tmp_path):
    assert listing.list_corpus(spark, str(tmp_path)).collect() == []
    flat = listing.list_corpus(spark, str(tmp_path), flat=True)
    assert [r.file_name for r in flat.collect()] == [None]
    assert files.read_label_files(spark, str(tmp_path)).collect() == []


def test_header_sizes(spark, tmp_path):
    (tmp_path / "S").mkdir()
    contents = {
        "plain.jpg": (jpeg(640, 480), (640, 480)), "progressive.jpeg": (jpeg(3, 5, 0xC2), (3, 5)),
        "exif.jpg": (jpeg(11, 12, junk=[(0xE1, 65_000), (0xE2, 65_001), (0xFE, 0)]), (11, 12)),
        "png.jpg": (png(30, 20), (30, 20)), "a.png": (png(400, 600), (400, 600)), "jpeg.png": (jpeg(8, 9), (8, 9)),
        "empty.png": (b"", None), "short.png": (png(5, 5)[:20], None), "no_header.png": (png(5, 5)[:8] + b"\0" * 40, None),
        "zero.png": (png(5, 5)[:16] + bytes(8) + b"rest", None), "short.jpg": (jpeg(5, 5)[:8], None), "text.jpg": (b"nothing at all", None),
        "tables.jpg": (b"\xff\xd8\xff\xda\0\x08" + bytes(20), None), "cut.jpg": (jpeg(5, 5, junk=[(0xE1, 9000)])[:5000], None),
        "loop.jpg": (b"\xff\xd8\xff\xe0\0\0" + bytes(50), None),
    }
    for name, (content, _) in contents.items():
        (tmp_path / "S" / name).write_bytes(content)
    got = {r.file_name: (r.width, r.height) for r in files.read_sized_images(spark, str(tmp_path)).collect()}
    assert got == {n: s or (None, None) for n, (_, s) in contents.items()}
    gone = spark.createDataFrame([("/no/such/file.png",), (None,)], "path string")
    assert [(r.width, r.height) for r in image_sizes.with_image_size(gone).collect()] == [(None, None)] * 2


def test_only_headers_are_read(tmp_path):
    path = tmp_path / "large.png"
    with open(path, "wb") as file:
        file.write(png(4000, 3000)[:33])
        file.truncate(1 << 30)
    system, plain = opened(str(path))
    with system.open_input_file(plain) as file:
        read = []

        class Counted:
            size = file.size

            def read_at(self, n, at):
                read.append(n)
                return file.read_at(n, at)

        assert image_sizes.header_size(image_sizes._Window(Counted())) == (4000, 3000)
    assert sum(read) <= image_sizes.HEAD


def lines_of(spark, rows, partitions=4):
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "stem string, line_no int, line string").repartition(partitions)


def test_one_file_per_stem_with_a_hot_one(spark, tmp_path):
    rows = [("hot", i, f"0 {i}") for i in range(3000)] + [(f"im{i % 300:03d}", i, f"1 {i}") for i in range(6000)]
    rows += [("empty", 0, None), ("gap", 2, "last"), ("gap", 1, None), ("gap", 0, "first"), (None, 1, "no stem"), ("é 漢", 1, "ü")]
    out = tmp_path / "labels"
    lines = lines_of(spark, list(rows))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_label_files(lines, str(out))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {}
    for stem, _, line in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1])):
        want.setdefault(stem, []).extend([line] if line is not None else [])
    assert {p.name: p.read_text() for p in out.iterdir()} == {f"{s}.txt": "\n".join(w) for s, w in want.items()}
    assert sorted(os.listdir(tmp_path)) == ["labels"]
    with pytest.raises(FileExistsError):
        write_label_files(lines, str(out))
    write_label_files(lines_of(spark, [("other", 1, "x")]), str(out), mode="ignore")
    assert (out / "hot.txt").exists()
    write_label_files(lines_of(spark, [("other", 1, "x")]), str(out), mode="overwrite")
    assert os.listdir(out) == ["other.txt"] and os.listdir(tmp_path) == ["labels"]


def test_hot_stem_is_dealt_to_several_tasks(spark):
    rows = spark.range(9000).selectExpr("'hot' AS stem", "CAST(id AS INT) AS line_no")
    tasks = rows.repartitionByRange("stem", "line_no").selectExpr("spark_partition_id() AS p").groupBy("p").count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert tasks.agg({"count": "max"}).first()[0] < 9000 / 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_failed_task_leaves_nothing(spark, tmp_path):
    rows = [(f"im{i:02d}", 1, "x") for i in range(50)] + [("im25/up", 1, "x")]
    with pytest.raises(Exception, match="no file can be named"):
        write_label_files(lines_of(spark, rows), str(tmp_path / "labels"))
    assert os.listdir(tmp_path) == []


def test_no_lines(spark, tmp_path):
    write_label_files(lines_of(spark, []), str(tmp_path / "labels"))
    assert os.listdir(tmp_path / "labels") == []
