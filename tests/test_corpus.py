"""A small corpus on disk: audit, selection, dataset builds, merge, validation, exports."""

import json
import struct
import zlib

import pytest

from spinelens import vocab
from spinelens.operators import audit as A
from spinelens.operators import datasets as B
from spinelens.operators import merge as G
from spinelens.operators import overlay as O
from spinelens.operators import predictions as R
from spinelens.operators import selection as SEL
from spinelens.operators import shapes as H
from spinelens.operators import validate as V
from spinelens.plans import composites as C
from spinelens.sinks import writers
from spinelens.sources import files

LABELS = ["C7", "CFH", "L1", "L2", "S1", "T1", "T13"]
SQUARE = [[100, 100], [200, 100], [200, 180], [100, 180]]


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    body = zlib.compress(b"".join(b"\0" + bytes(width) for _ in range(height)))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def polygon(label, points=SQUARE):
    return {"label": label, "shape_type": "polygon", "points": points}


def head(x=150.0, y=300.0, kind="point"):
    return {"label": "CFH", "shape_type": kind, "points": [[x, y]]}


ALL = [polygon(x) for x in ("C7", "L1", "L2", "T1")]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")

    def sample(name, docs=(), images=()):
        folder = root / name
        folder.mkdir()
        for doc, content in docs:
            (folder / doc).write_text(content if isinstance(content, str) else json.dumps(content))
        for image, size in images:
            (folder / image).write_bytes(png(*size) if size else b"not an image")

    def doc(shapes, image="a.png"):
        return {"shapes": shapes, "imagePath": image}

    sample("S0001", [("a.json", doc(ALL + [head()], "im1.png"))], [("im1.png", (400, 600)), ("im1.dcm", None)])
    # labels are joined over both documents; only the first one is built from
    sample("S0002", [("a.json", doc(ALL[:3] + [head(), head(5, 5)], "gone.png")),
                     ("b.json", doc([polygon("T1"), polygon("S1"), polygon("")], "im2.png"))],
           [("im2.png", (400, 600))])
    sample("S0003", [("a.json", "{broken")], [("im3.png", (400, 600))])
    sample("S0004")  # neither image nor document
    sample("S0005", [("a.json", doc(ALL + [polygon("T13"), {"label": "L5", "shape_type": "rectangle", "points": SQUARE},
                                           polygon("L3", SQUARE[:3])], "im1.png"))],
           [("im1.png", (800, 600)), ("odd.png", None)])
    sample("S0006", [("a.json", {"imagePath": "im6.png"})], [("im6.png", (400, 600))])
    sample("S0007", [("a.json", doc(ALL + [head(3, 4, "circle")]))], [])
    (root / "samples.txt").write_text("\n".join(f"S{i:04d}" for i in range(1, 8)) + "\n\n")
    (root / "label.txt").write_text("\n".join(LABELS[:3]) + "\r\n\n " + "\n".join(LABELS[3:]) + "\n")
    return root


@pytest.fixture(scope="module")
def tables(spark, corpus):
    samples = files.read_samples(spark, str(corpus / "samples.txt"))
    docs = files.read_annotations(spark, str(corpus))
    listed = files.read_image_files(spark, str(corpus))
    sized = files.read_sized_images(spark, str(corpus))
    labels = files.vocab_labels(files.read_label_vocab(spark, str(corpus / "label.txt")))
    return {"samples": samples, "docs": docs, "listed": listed, "sized": sized, "labels": labels,
            "audit": C.audit_dataset(samples, listed, docs, labels)}


def by(df, key):
    return {row[key]: row for row in df.collect()}


def test_vocabulary_keeps_file_order(tables):
    assert tables["labels"] == LABELS
    assert A.split_vocabulary(LABELS) == (["C7", "L1", "L2", "T1"], ["CFH"])


def test_long_vocabulary(spark):
    long = spark.range(1500).selectExpr("concat('L', id) AS label", "id AS ord")
    assert files.vocab_labels(long) == [f"L{i}" for i in range(1500)]


def test_lines_with_more_keypoints(spark):
    text = "3 0.1 0.2 0.3 0.4 " + " ".join(f"0.{i} 0.{i} 2" for i in range(1, 7))
    lines = spark.createDataFrame([("s", 1, text), ("s", 2, "4 0.1 0.2 0.3 0.4 0.5"), ("s", 3, "")], "stem string, line_no int, line string")
    rows = {r.line_no: r for r in files.parse_label_lines(lines).collect()}
    assert [k.x for k in rows[1].keypoints] == [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]
    assert rows[2].keypoints == [] and rows[3].keypoints == []
    from spinelens.operators import validate as V
    wrong = {r.line_no for r in V.format_violations(files.parse_label_lines(lines), "vertebra").collect()}
    assert wrong == {2, 3}


def test_audit(tables):
    got = by(tables["audit"]["samples"], "sample_id")
    assert len(got) == 7
    s1, s2, s3, s4 = (got[f"S000{i}"] for i in (1, 2, 3, 4))
    assert (s1.image_count, s1.json_count, s1.fully_complete) == (2, 1, True)
    assert s2.poly_labels == ["C7", "L1", "L2", "S1", "T1"] and s2.poly_complete and s2.json_count == 2
    assert (s3.json_count, s3.has_annotation, s3.missing_poly) == (1, True, ["C7", "L1", "L2", "T1"])
    assert (s4.image_count, s4.has_annotation, s4.missing_point) == (0, False, ["CFH"])
    assert got["S0007"].point_labels == []
    summary = tables["audit"]["summary"].first()
    assert tuple(summary) == (7, 7, 6, 1, 2, 4)
    missing = by(tables["audit"]["missing"], "label")
    assert missing["T1"].missing_count == 3 and missing["CFH"].missing_count == 5
    rates = A.summary_rates(tables["audit"]["summary"]).first()
    assert rates.images_per_sample == 1.0 and rates.poly_incomplete_pct == pytest.approx(200 / 7)


def test_empty_corpus_has_null_rates(tables):
    empty = tables["audit"]["samples"].filter("false")
    rates = A.summary_rates(A.audit_summary(empty)).first()
    assert (rates.total_samples, rates.total_images, rates.images_per_sample) == (0, 0, None)


def test_report_tables(tables):
    audit = tables["audit"]["samples"]
    report = C.audit_report_tables(audit, ["C7", "L1", "L2", "T1"], ["CFH"], k=1)
    assert [tuple(r)[:1] for r in report["poly_incomplete"].collect()] == [("S0003",)]
    assert report["poly_incomplete"].first().missing_poly_preview == "C7, L1, L2, T1"
    assert tuple(report["no_annotation_rest"].first()) == (1, 0)
    assert report["missing_rank"].first().label == "CFH"
    long = audit.selectExpr("array('a','b','c','d','e','f','g','h','i','j','k') AS m")
    assert long.selectExpr(f"{A._preview('m')} AS p").first().p == "a, b, c, d, e, f, g, h, i, j..."


def test_membership_and_selection(tables, spark, tmp_path):
    audit = tables["audit"]["samples"]
    members = C.label_membership_report(audit, "S1", "T13")
    assert {tuple(r) for r in members["members"].collect()} == {
        ("S0002", True, False, False), ("S0005", False, True, False)}
    selection = C.select_training(audit)
    status = {r.sample_id: r.status for r in selection["selection"].collect()}
    assert status == {"S0001": "valid", "S0002": "valid", "S0003": "incomplete", "S0004": "no_annotation",
                      "S0005": "valid", "S0006": "incomplete", "S0007": "valid"}
    assert tuple(selection["counts"].first())[:5] == (7, 4, 3, 1, 2)
    assert [r.sample_id for r in SEL.sorted_selection(selection["selection"], "incomplete").collect()] == ["S0003", "S0006"]
    writers.write_audit(audit, str(tmp_path / "audit"))
    saved = files.read_audit(spark, str(tmp_path / "audit" / "audit_samples"))
    assert saved.count() == 7 and spark.read.json(str(tmp_path / "audit" / "audit_summary")).first().total_samples == 7
    writers.write_selection(selection["selection"], str(tmp_path / "selection"))
    assert spark.read.parquet(str(tmp_path / "selection")).filter("status = 'valid'").count() == 4


def test_image_sizes(tables):
    sized = {(r.sample_id, r.file_name): (r.width, r.height) for r in tables["sized"].collect()}
    assert sized[("S0001", "im1.png")] == (400, 600) and sized[("S0005", "odd.png")] == (None, None)
    assert ("S0001", "im1.dcm") not in sized


def test_other_image_formats(spark, tmp_path):
    folder = tmp_path / "S0001"
    folder.mkdir()
    (folder / "a.jpg").write_bytes(png(30, 20))  # decoded by content
    (folder / "b.jpeg").write_bytes(b"nothing")
    got = {r.file_name: (r.width, r.height) for r in files.read_sized_images(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": (30, 20), "b.jpeg": (None, None)}


def all_samples(tables):
    return tables["samples"]


def test_pose_build(tables):
    built = C.build_pose_dataset(all_samples(tables), tables["docs"], tables["sized"])
    rows = built["labels"].orderBy("stem", "line_no").collect()
    # S0005 overwrites the label file of S0001; T13, the rectangle and the triangle are left out
    im1 = [r for r in rows if r.stem == "im1"]
    assert [(r.line_no, r.class_id) for r in im1] == [(1, 0), (2, 1), (3, 2), (4, 6)]
    assert (im1[0].cx, im1[0].cy, im1[0].w, im1[0].h) == pytest.approx((150 / 800, 140 / 600, 100 / 800, 80 / 600))
    assert [(k.x * 800, k.y * 600, k.v) for k in im1[0].keypoints] == [
        (pytest.approx(x), pytest.approx(y), 2) for x, y in SQUARE]
    assert [r.class_id for r in rows if r.stem == "im2"] == [0, 1, 2]
    failures = {r.sample_id: r.reason for r in built["failures"].collect()}
    assert failures == {"S0003": "Unreadable JSON file", "S0004": "No JSON file",
                        "S0006": "No valid annotations", "S0007": "No image file"}
    manifest = {r.dst_name: r.sample_id for r in built["manifest"].collect()}
    assert manifest == {"im1.png": "S0005", "im2.png": "S0002"}
    assert B.stem_collisions(tables["sized"]).first().stem == "im1"


def test_processed_no_image(tables, spark):
    docs = spark.createDataFrame([("S1", "a.json", [("X", "polygon", [[float(v) for v in p] for p in SQUARE])])],
                                 "sample_id string, doc_path string, shapes array<struct<label string, shape_type string,"
                                 " points array<array<double>>>>")
    images = spark.createDataFrame([("S1", "a.png", "a", "png", "S1/a.png", 10, 10)],
                                   "sample_id string, file_name string, stem string, ext string, path string, width int, height int")
    built = C.build_pose_dataset(docs.select("sample_id"), docs, images)
    assert built["failures"].first().reason == "Processed 0 images"
    assert built["labels"].count() == 0


def test_point_build(tables):
    built = C.build_point_dataset(all_samples(tables), tables["docs"], tables["sized"])
    row = built["labels"].first()
    assert (row.stem, row.line_no, row.class_id) == ("im1", 1, 0)
    assert (row.cx, row.cy, row.w, row.h) == pytest.approx((150 / 400, 300 / 600, 64 / 400, 64 / 600))
    failures = {r.sample_id: r.reason for r in built["failures"].collect()}
    assert failures["S0002"] == "CFH keypoints count: 2 (expected 1)"
    assert failures["S0005"] == "CFH keypoints count: 0 (expected 1)"
    reasons = [tuple(r) for r in B.failure_reasons(built["failures"]).collect()]
    assert reasons[0] == ("CFH keypoints count: 0 (expected 1)", 2)


def test_box_build(tables):
    built = C.build_box_dataset(tables["docs"], tables["sized"])
    rows = {r.stem: r for r in built["labels"].collect()}
    assert set(rows) == {"im1"}
    side = int(80.0 * vocab.BOX_MULTIPLIER)
    assert (rows["im1"].w, rows["im1"].h) == pytest.approx((side / 400, side / 600))
    counts = built["counts"].first()
    # S0002/a.json and S0007 name absent files
    assert tuple(counts) == (1, 1, 2)


def test_shape_filters(tables):
    shapes = H.explode_shapes(tables["docs"])
    assert {r.label for r in H.training_polygons(shapes).filter("sample_id = 'S0005'").collect()} == {"C7", "L1", "L2", "T1"}
    assert {r.label for r in H.reference_shapes(shapes).filter("sample_id = 'S0005'").collect()} == {
        "C7", "L1", "L2", "T1", "T13", "L5"}
    assert H.single_point_labels(shapes).count() == 3 and H.loose_point_labels(shapes).count() == 4
    assert H.audited_shapes(shapes).filter("label = ''").count() == 0


def test_merge_validate_export(tables, spark, tmp_path):
    pose = C.build_pose_dataset(all_samples(tables), tables["docs"], tables["sized"])
    points = C.build_point_dataset(all_samples(tables), tables["docs"], tables["sized"])
    images = [df.selectExpr("regexp_replace(dst_name, '[.].*', '') AS stem", "dst_name AS file_name")
              for df in (pose["manifest"], points["manifest"])]
    merged = C.merge_label_datasets(*images, pose["labels"], points["labels"])
    assert tuple(merged["stats"].first()) == (2, 1, 0, 1, 7, 1)
    rows = merged["labels"].orderBy("stem", "line_no").collect()
    last = [r for r in rows if r.stem == "im1"][-1]
    assert (last.line_no, last.class_id) == (5, 18)
    assert [(k.x, k.y, k.v) for k in last.keypoints[1:]] == [(0.0, 0.0, 0)] * 3
    descriptor = merged["descriptor"].first()
    assert (descriptor.nc, descriptor.kpt_shape, descriptor.total_objects) == (19, [4, 3], 8)
    assert V.descriptor_violations(merged["descriptor"]).first().violation == "nc: expected 18, found 19"
    assert by(files.read_class_names(merged["descriptor"]), "class_id")[18].label == "CFH"
    assert "kpt_shape: [4, 3]\ndataset_info:" in G.descriptor_yaml(merged["descriptor"]).first().yaml

    out = str(tmp_path / "labels")
    writers.export_label_text(merged["labels"], out)
    assert sorted(p.name for p in (tmp_path / "labels").iterdir()) == ["im1.txt", "im2.txt"]
    lines = (tmp_path / "labels" / "im2.txt").read_text().split("\n")
    assert len(lines) == 3 and all(len(l.split()) == 17 for l in lines)
    assert lines[0] == ("0 0.375000 0.233333 0.250000 0.133333 0.250000 0.166667 2 0.500000 0.166667 2"
                        " 0.500000 0.300000 2 0.250000 0.300000 2")
    writers.write_pose_labels(merged["labels"], str(tmp_path / "typed"))
    assert spark.read.parquet(str(tmp_path / "typed")).count() == 8

    folder = tmp_path / "text"
    folder.mkdir()
    (folder / "im2.txt").write_text("\n".join(lines))
    (folder / "empty.txt").write_text("")
    (folder / "bad.txt").write_text("19 0.1 0.1 0.1 0.1" + " 0.1 0.1 2" * 4 + "\n\t1  0.5\nx\n")
    read = files.parse_label_lines(files.read_label_lines(spark, str(folder)))
    listed = files.read_label_files(spark, str(folder))
    assert sorted(r.stem for r in listed.collect()) == ["bad", "empty", "im2"]
    label_files = listed
    checks = C.validate_label_dataset(
        spark.createDataFrame([("im2",), ("other",)], "stem string"), label_files, read, "merged")
    assert {tuple(r) for r in checks["pairing"].collect()} == {("other", "label"), ("empty", "image"), ("bad", "image")}
    assert tuple(checks["totals"].first())[:5] == (6, 16, 16, 0, 3)
    assert [(r.line_no, r.violation) for r in checks["violations"].orderBy("line_no").collect()] == [
        (1, "class id 19 outside 0-18"), (2, "expected 17 fields, found 2"), (3, "expected 17 fields, found 1")]
    assert by(checks["classes"], "class_id")[19].label == "Unknown_19"
    assert by(checks["examples"], "kind")["vertebra"].stem == "bad"
    back = read.filter("stem = 'im2'").orderBy("line_no").collect()
    assert (back[0].class_id, back[0].keypoints[2].y, back[0].keypoints[2].v) == (0, 0.3, 2)


def test_overlay(tables):
    pose = C.build_pose_dataset(all_samples(tables), tables["docs"], tables["sized"])
    sized = tables["sized"].filter("sample_id = 'S0002'")
    shown = C.overlay_geometry(O.one_image(pose["labels"], "im2"), sized)
    assert [tuple(r)[3:] for r in shown["boxes"].orderBy("line_no").collect()][0] == ("C7", 100, 100, 200, 180)
    edges = shown["edges"].filter("line_no = 1").orderBy("edge").collect()
    assert [(e.x1, e.y1) for e in edges] == [(e.x2, e.y2) for e in edges[-1:] + edges[:-1]]
    assert shown["points"].count() == 12


def test_prediction_counts(spark):
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string")
    vertebrae = spark.createDataFrame(
        [("a", .9, [1, 2, 3, 4]), ("a", .2, [1, 2, 3, 4]), ("b", .3, None), ("z", .9, [1])],
        "image_id string, confidence double, keypoints array<int>")
    cfh = spark.createDataFrame([("a", .25)], "image_id string, confidence double")
    got = C.prediction_summary(images, vertebrae, cfh, 10)
    assert tuple(got["stats"].first()) == (3, 2, 4, 1)
    assert tuple(got["ratios"].first())[4:] == (pytest.approx(2 / 3), 2.0)
    none = R.prediction_ratios(R.prediction_stats(images.limit(0), vertebrae, cfh)).first()
    assert tuple(none) == (0, 0, 0, 0, 0.0, 0.0)


def test_csv_and_text_exports(spark, tmp_path):
    from spinelens.operators import detections as D
    raw = spark.createDataFrame([("i.png", 0, 1., 2., 3., 6., .5)],
                                "image string, det_idx int, x1 double, y1 double, x2 double, y2 double, confidence double")
    writers.write_detections_csv(D.detections_flat(raw), str(tmp_path / "csv"))
    text = max((p.read_text() for p in (tmp_path / "csv").glob("*.csv")), key=len).splitlines()
    assert text == ["image,x1,y1,x2,y2,confidence,center_x,center_y", "i.png,1.0,2.0,3.0,6.0,0.5,2.0,4.0"]
    det = spark.createDataFrame([("i", 0, "T1", .51234, [(1.5, 2.25)])],
                                "image_id string, det_idx int, label string, confidence double,"
                                " keypoints_px array<struct<x: double, y: double>>")
    writers.write_text(D.prediction_text(det), "text", str(tmp_path / "txt"))
    assert "".join(p.read_text() for p in (tmp_path / "txt").glob("*.txt")) == "T1 0.5123\n  Point1: (1.50, 2.25)\n"
    joined = D.attach_cfh(spark.createDataFrame([("i",), ("j",)], "image_id string"), spark.createDataFrame(
        [("i", .9, [.5], (.1, .2))], "image_id string, confidence double, bbox array<double>, center struct<x: double, y: double>"))
    assert {r.image_id: r.cfh is None for r in joined.collect()} == {"i": False, "j": True}


def test_vocabulary_as_a_table(spark, corpus, tables):
    """The table of a vocabulary gives what its list gives."""
    vocabulary = files.read_label_vocab(spark, str(corpus / "label.txt"))
    audit = C.audit_dataset(tables["samples"], tables["listed"], tables["docs"], vocabulary)
    for part in ("samples", "summary", "missing"):
        assert sorted(map(str, audit[part].collect())) == sorted(map(str, tables["audit"][part].collect())), part
    none = C.audit_dataset(tables["samples"], tables["listed"], tables["docs"], vocabulary.limit(0))
    assert {r.poly_complete for r in none["samples"].collect()} == {True}
    assert [(r.kind, r.label) for r in none["missing"].collect()] == [("point", "CFH")]


def test_plan_of_a_long_vocabulary(spark):
    """100,000 labels over many words of bits: the plan of 20, and right results."""
    samples = spark.range(40).selectExpr("id AS sample_id")
    images = samples.selectExpr("sample_id", "'png' AS ext")
    docs = samples.selectExpr("sample_id", "'a.json' AS doc_path")
    shapes = samples.selectExpr("sample_id", "explode(sequence(0, 99999, IF(sample_id = 0, 1, 997 + CAST(sample_id AS INT)))) AS k").selectExpr(
        "sample_id", "concat('L', k) AS label", "'polygon' AS shape_type")
    sizes = {}
    for n in (20, 100_000):
        vocabulary = spark.range(n).selectExpr("concat('L', id) AS label", "CAST(id AS INT) AS ord")
        poly, point = A.split_vocabulary(vocabulary)
        audit = A.audit_samples(samples, images, docs, shapes, poly, point)
        text = A.missing_by_label(audit, poly, point)._jdf.queryExecution().executedPlan().toString()
        sizes[n] = (len(text.splitlines()), len(audit._jdf.queryExecution().executedPlan().toString().splitlines()))
    assert sizes[20] == sizes[100_000]
    rows = {r.sample_id: r for r in audit.collect()}
    assert [i for i, r in rows.items() if r.poly_complete] == [0]
    assert len(rows[1].missing_poly) == 100_000 - 101 and rows[1].missing_poly[:2] == ["L1", "L2"]
    missing = by(A.missing_by_label(audit, poly, point), "label")
    assert (missing["L0"].missing_count, missing["L1"].missing_count, missing["L99999"].ord) == (0, 39, 99_999)
    assert len(missing) == 100_001 and missing["CFH"].ord == 100_000 and missing["CFH"].missing_pct == 100.0


def test_repeated_expected_labels_count_once(spark, tables):
    audit = A.audit_samples(tables["samples"], tables["listed"], tables["docs"], H.explode_shapes(tables["docs"]), ["C7", "C7", "it's"], ["CFH"])
    assert {tuple(r.missing_poly) for r in audit.collect()} == {("it's",), ("C7", "it's")}
