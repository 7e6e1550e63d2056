"""Larger tables: keys wider than those of the given ones, and what is moved per row."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import connect, differences
from spinelens.functions import label_text
from spinelens.operators import evaluation as E
from spinelens.plans.oracles import ORACLES
from spinelens.plans.queries import QUERIES
from spinelens.sources import star_tables as T


@pytest.fixture(scope="module")
def wide_dir(sf_dir, tmp_path_factory):
    """Line items of suppliers past 10,000, as tables from 60 times sf0.1 on have them."""
    path = tmp_path_factory.mktemp("wide")
    duckdb.sql(f"COPY (SELECT * REPLACE (l_suppkey + l_suppkey % 7 * 10000 AS l_suppkey)"
               f" FROM read_parquet('{sf_dir}/lineitem.parquet')) TO '{path}/lineitem.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["adaptive_box", "reference_heights"])
def test_wide_supplier_keys(spark, wide_dir, name):
    assert differences(QUERIES[name](spark, wide_dir), connect(wide_dir), ORACLES[name]) is None


@pytest.mark.parametrize("operator", ["match_detections", "evaluate_detections", "evaluate_by_class"])
def test_matching_moves_few_probes(spark, sf_dir, monkeypatch, operator):
    """What is shuffled of the true boxes is less than two rows each."""
    plain, moved = E.truth_probes, []
    monkeypatch.setattr(E, "truth_probes", lambda *given: moved.append(plain(*given)) or moved[-1])
    truth = T.truth_boxes(spark, sf_dir)
    getattr(E, operator)(T.raw_boxes(spark, sf_dir), truth)
    assert len(moved) == 1 and moved[0].count() < 2 * truth.count()


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75])
def test_best_truth_of_boxes_of_all_sizes(spark, threshold):
    rng = random.Random(5)
    boxes = []
    for i in range(600):
        w, h = 10 ** rng.uniform(-2, 4), 10 ** rng.uniform(-2, 4)
        x, y = rng.uniform(-500, 500), rng.uniform(-500, 500)
        boxes.append((i, x, y, x + w, y + h))
        for _ in range(3):
            a, b = w * rng.uniform(0.6, 1.6), h * rng.uniform(0.7, 1.4)
            dx, dy = w * rng.uniform(-0.3, 0.3), h * rng.uniform(-0.3, 0.3)
            boxes.append((i, x + dx, y + dy, x + dx + a, y + dy + b))
    kinds = "image_id int, class_id int, x1 double, y1 double, x2 double, y2 double"
    p = spark.createDataFrame([(i, 0, *b, k, 0.5) for k, (i, *b) in enumerate(boxes)], f"{kinds}, det_idx long, confidence double")
    t = spark.createDataFrame([(i, 0, *b, k) for k, (i, *b) in enumerate(boxes) if k % 4], f"{kinds}, truth_idx long")

    def iou(a, b):
        o = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return o / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - o)

    want = {}
    for k, (i, *b) in enumerate(boxes):
        best = min((-iou(b, boxes[j][1:]), j) for j in range(4 * i, 4 * i + 4) if j % 4)
        if -best[0] >= threshold:
            want[k] = best[1]
    assert {r.det_idx: r.truth_idx for r in E.best_truth(p, t, threshold).collect()} == want and len(want) > 1800


def test_label_text_equals_the_formatter(spark):
    """Ordinary numbers are written by a cast; the text is the formatter's for all numbers."""
    assert label_text.format_line(keypoints=None).count("AS DECIMAL(16, 6)") == 4
    assert label_text.format_line().count("AS DECIMAL(16, 6)") == 6
    rows = spark.range(3000).selectExpr(
        "CASE WHEN id % 97 > 0 THEN CAST(id AS INT) END AS class_id",
        "(id * 7919 % 1000000 + 0.5e0) / 1e6 AS cx", "(id - 1500) / 1e9 AS cy", "rand(3) * pow(10e0, id % 30 - 12) AS w",
        "CASE id % 6 WHEN 0 THEN -0e0 WHEN 1 THEN 0e0 WHEN 2 THEN double('NaN') WHEN 3 THEN double('Infinity') WHEN 4 THEN 1e9 END AS h",
        "CASE id % 4 WHEN 0 THEN array() WHEN 1 THEN array(named_struct('x', rand(7), 'y', -rand(8), 'v', 2), NULL)"
        " WHEN 2 THEN array(named_struct('x', 0.0000005e0, 'y', 1e0, 'v', CAST(NULL AS INT))) END AS keypoints").localCheckpoint()
    head = "format_string('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h)"
    tail = "array_join(transform(keypoints, k -> format_string(' %.6f %.6f %d', k.x, k.y, k.v)), '')"
    assert rows.where(f"NOT ({label_text.format_line()} <=> concat({head}, {tail}))").count() == 0
    assert rows.where(f"NOT ({label_text.format_line(keypoints=None)} <=> {head})").count() == 0


@pytest.mark.parametrize("operator", ["evaluate_detections", "evaluate_by_class"])
def test_scores_move_each_box_about_once(spark, sf_dir, operator):
    """All exchanges by image together carry less than 1.5 rows per box."""
    pred, true = T.raw_boxes(spark, sf_dir), T.truth_boxes(spark, sf_dir)
    df = getattr(E, operator)(pred, true)
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        elif node.nodeName() != "ReusedExchange":
            if node.nodeName() == "Exchange" and "image_id" in node.simpleString(100):
                total += node.metrics().apply("shuffleRecordsWritten").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    assert 0 < total < 1.5 * (pred.count() + true.count())


def test_matching_over_tiles_equals_plain_matching(spark):
    """Boxes over many tiles of all signs, copies, boxes without an inside and without an image."""
    rng = random.Random(11)
    boxes = []
    for i in range(1200):
        w, h = 10 ** rng.uniform(-1, 3), 10 ** rng.uniform(-1, 3)
        x, y = rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)
        boxes += [(x + a * w, y + b * h, x + a * w + w, y + b * h + h) for a, b in ((0, 0), (rng.uniform(-.3, .3), rng.uniform(-.3, .3)))]
    boxes += boxes[:50] + [(5.0, 5.0, 5.0, 9.0), (9.0, 1.0, 3.0, 2.0)]
    kinds = "image_id int, class_id int, x1 double, y1 double, x2 double, y2 double"
    found = [(1, k % 2, *b, k, k * 37 % 101 / 101) for k, b in enumerate(boxes)] + [(None, 0, 0.0, 0.0, 1.0, 1.0, 9999, 0.5)]
    true = [(1, k % 2, b[0] + 0.1, *b[1:], k) for k, b in enumerate(boxes) if k % 5] + [(1, None, 0.0, 0.0, 1.0, 1.0, 9999)]
    p = spark.createDataFrame(found, f"{kinds}, det_idx long, confidence double")
    t = spark.createDataFrame(true, f"{kinds}, truth_idx long")

    def iou(a, b):
        o = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return o / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - o)

    def proper(row):
        return row[4] > row[2] and row[5] > row[3]

    want = {c: dict.fromkeys(range(len(E.THRESHOLDS)), 0) for c in (0, 1)}
    best: dict = {}
    for row in filter(proper, found[:-1]):
        near = [(-iou(row[2:6], o[2:6]), o[6]) for o in true[:-1] if o[1] == row[1] and proper(o)]
        if near and -min(near)[0] >= 0.5:
            score, index = min(near)
            for i, lim in enumerate(E.THRESHOLDS):
                if -score >= lim:
                    best[row[1], index, i] = max(best.get((row[1], index, i), 0), row[7])
    for c, _, i in best:
        want[c][i] += 1
    got = {r.class_id: r for r in E._levels(p, t).groupBy("class_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_truth", *[f"tp{i}" for i in range(len(E.THRESHOLDS))])]).collect()}
    for c in (0, 1):
        assert [got[c][f"tp{i}"] for i in want[c]] == list(want[c].values()) and want[c][0] > 500
        assert got[c].n == sum(r[1] == c for r in found[:-1]) and got[c].n_truth == sum(r[1] == c for r in true[:-1])
