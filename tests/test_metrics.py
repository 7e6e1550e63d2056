import random

import pytest
from pyspark.sql import functions as F

import plain
from spinelens import vocab
from spinelens.operators import measurements as M
from spinelens.operators import metrics as X
from spinelens.plans import composites as C

VERTEBRAE = ("image_id string, det_idx long, label string, confidence double,"
             " keypoints array<struct<x: double, y: double>>, image_width int, image_height int")
CFH = ("image_id string, det_idx long, confidence double, center struct<x: double, y: double>,"
       " image_width int, image_height int")
STARTS = {"T1": .1, "C2": .2, "C7": .3, "T2": .35, "T5": .45, "T12": .6, "L1": .65, "L4": .8, "L5": .85}


def quad(y):
    return [(0.1, y), (0.2, y), (0.1, y + 0.05), (0.2, y + 0.05)]


def vertebrae(spark, rows):
    """rows: (image, index, label, quad)"""
    return spark.createDataFrame([
        (i, n, label, 0.9, [{"x": x, "y": y} for x, y in q], 1920, 1080) for i, n, label, q in rows
    ], VERTEBRAE)


def heads(spark, rows):
    return spark.createDataFrame(
        [(i, n, 0.9, {"x": x, "y": y}, 1920, 1080) for i, n, x, y in rows], CFH)


@pytest.fixture(scope="module")
def golden(spark):
    rows = [("S0001", n, label, quad(y)) for n, (label, y) in enumerate(STARTS.items())]
    return M.spine_by_image(vertebrae(spark, rows), heads(spark, [("S0001", 0, 0.5, 0.95)]))


def test_synthetic_spine(golden):
    long = M.measurements_long(golden).orderBy("ord").collect()
    assert [r.type for r in long] == vocab.MEASUREMENT_TYPES
    assert [len(r.points) for r in long] == [2, 4, 4, 4, 4, 4, 4, 2, 7, 3, 3, 2]
    m = X.metrics_from_spine(golden).first()
    for name in vocab.METRICS:
        want = {"SVA": 96.0, "TPA": 48.3818, "PI": 265.4057, "PT": 184.5943}.get(name, 0.0)
        assert m[name] == pytest.approx(want, abs=1e-4), name


def test_all_forms_agree(golden):
    wide = X.metrics_from_spine(golden).first()
    long = X.metrics_from_measurements(M.measurements_long(golden)).first()
    nested = X.metrics_from_documents(M.measurements_nested(golden)).first()
    doc = X.to_document(X.metrics_from_spine(golden)).first()
    assert [wide[m] for m in vocab.METRICS] == [long[m] for m in vocab.METRICS]
    assert [wide[m] for m in vocab.METRICS] == [nested[m] for m in vocab.METRICS]
    assert doc.metrics == {m: wide[m] for m in vocab.METRICS}


def test_keypoints_document_defaults(golden):
    doc = M.measurements_nested(golden).first()
    assert (doc.imageId, doc.imageWidth, doc.imageHeight, doc.standardDistance) == ("S0001", 1920, 1080, 100.0)
    assert [(p.x, p.y) for p in doc.standardDistancePoints] == [(0.0, 0.0), (200.0, 0.0)]
    scaled = X.with_sva_mm(X.metrics_from_documents(M.measurements_nested(golden))).first()
    assert scaled.sva_mm == pytest.approx(48.0)


def test_missing_parts_leave_metrics_out(spark):
    rows = [("S0001", 0, "T1", quad(.1)), ("S0001", 1, "L1", quad(.6)), ("S0002", 0, "T3", quad(.2))]
    spine = M.spine_by_image(vertebrae(spark, rows), heads(spark, [("S0003", 0, .5, .5)]))
    assert [tuple(r)[:2] for r in X.to_long(X.metrics_from_spine(spine)).collect()] == [("S0001", "T1_Slope")]
    docs = {r.imageId: r.measurements for r in M.measurements_nested(spine).collect()}
    assert {k: len(v) for k, v in docs.items()} == {"S0001": 1, "S0002": 0, "S0003": 0}
    coverage = {r.metric: r.n_available for r in X.coverage_by_metric(X.metrics_from_spine(spine)).collect()}
    assert coverage == {m: int(m == "T1_Slope") for m in vocab.REPORTED_METRICS}


def test_last_detection_of_a_label_counts(spark):
    rows = [("S0001", 5, "T1", [(0, 0), (1, 1), (0, 2), (1, 3)]), ("S0001", 2, "T1", quad(.1))]
    df = vertebrae(spark, [(i, n, l, [(float(x), float(y)) for x, y in q]) for i, n, l, q in rows])
    assert M.last_label_wins(df).first().det_idx == 5
    assert X.metrics_from_spine(M.spine_by_image(df)).first().T1_Slope == pytest.approx(
        plain.acute((0, 0), (1920, 1080)))
    chosen = df.withColumn("confidence", F.expr("CASE WHEN det_idx = 2 THEN 0.99 ELSE 0.5 END"))
    assert M.last_label_wins(chosen, "confidence").first().det_idx == 2


def test_bad_keypoint_count_rejects_the_whole_image(spark):
    rows = [("S0001", 0, "T1", quad(.1)), ("S0001", 1, "T9", quad(.2)[:3]), ("S0001", 2, "L3", quad(.3) * 2),
            ("S0002", 0, "T1", quad(.1))]
    spine = M.spine_by_image(vertebrae(spark, rows))
    assert [tuple(r) for r in M.rejects(spine).collect()] == [("S0001", "keypoint count is not 4: T9")]
    assert [r.image_id for r in X.metrics_from_spine(spine).collect()] == ["S0002"]
    with pytest.raises(Exception, match="keypoint count is not 4"):
        M.require_four_keypoints(spine).collect()


def test_measurement_guards_and_repeats(spark):
    schema = "image_id string, ord long, type string, points array<struct<x: double, y: double>>"

    def pts(*values):
        return [{"x": float(x), "y": float(y)} for x, y in values]

    df = spark.createDataFrame([
        ("S0001", 0, "T1 Slope", pts((0, 0), (1, 1))), ("S0001", 9, "T1 Slope", pts((0, 0), (1, 0))),
        ("S0001", 2, "TPA", pts((0, 0), (1, 1), (2, 2), (3, 3))), ("S0001", 3, "PI", pts((0, 0), (4, 4))),
        ("S0001", 4, "SS", pts((0, 0))), ("S0001", 5, "other", pts((0, 0))),
        ("S0001", 6, "PT", pts((0, 0), (1, 1), (3, 1), (9, 9))),
    ], schema)
    got = {r.metric: r.value for r in X.to_long(X.metrics_from_measurements(df)).collect()}
    assert got == {"T1_Slope": 0.0, "PT": pytest.approx(90 - 63.43494882)}
    counts = {r.type: (r.n_measurements, r.n_points) for r in M.measurement_point_counts(df).collect()}
    assert counts["T1 Slope"] == (2, 4)


def test_normalised_calculator(spark):
    rng = random.Random(11)
    labels = vocab.MEASURED_LABELS + ["T3"]
    images, head, rows = {}, {}, []
    for i in range(150):
        key = f"S{i:04d}"
        chosen = rng.sample(labels, rng.randint(1, len(labels)))
        images[key] = {l: [(rng.random(), rng.random()) for _ in range(4)] for l in chosen}
        rows += [(key, n, l, q) for n, (l, q) in enumerate(images[key].items())]
        if i % 3:
            head[key] = (rng.random(), rng.random())
    wide = C.detections_to_metrics_normalised(
        vertebrae(spark, rows), heads(spark, [(k, 0, x, y) for k, (x, y) in head.items()]))
    for row in wide.collect():
        want = plain.normalised_metrics(images[row.image_id], head.get(row.image_id))
        for name in vocab.NORMALISED_METRICS:
            if name in want:
                assert row[name] == pytest.approx(want[name], abs=1e-6), (row.image_id, name)
            else:
                assert row[name] is None


def test_overview_keeps_duplicate_labels(spark):
    rows = [("S0001", 0, "T2", quad(.1)), ("S0001", 1, "T1", quad(.2)), ("S0001", 2, "T2", quad(.3))]
    found = M.detection_overview(vertebrae(spark, rows), heads(spark, [("S0001", 0, .5, .5), ("S0002", 1, .5, .5)]))
    got = {r.image_id: r for r in found.selectExpr(
        "image_id", "vertebra_count", "has_cfh", f"{M.sorted_labels('label_counts')} AS labels").collect()}
    assert (got["S0001"].vertebra_count, got["S0001"].labels, got["S0001"].has_cfh) == (3, ["T1", "T2", "T2"], True)
    assert (got["S0002"].vertebra_count, got["S0002"].labels) == (0, [])
