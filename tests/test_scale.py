"""Hot keys, plans and the bucketed helpers."""

import random

import pytest
from pyspark.sql import functions as F

from spinelens.operators import evaluation as E
from spinelens.operators import measurements as M
from spinelens.operators import numbering as N
from spinelens.operators import overlay as O
from spinelens.plans.queries import QUERIES
from spinelens.sources import star_tables as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_have_no_python_and_no_cartesian_product(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert forbidden not in text, forbidden


def test_scan_reads_only_needed_columns(spark, sf_dir):
    text = plan(QUERIES["pairing_missing"](spark, sf_dir))
    assert "ReadSchema: struct<c_custkey:bigint>" in text and "ReadSchema: struct<o_custkey:bigint>" in text
    summary = plan(QUERIES["audit_summary"](spark, sf_dir))
    assert "collect_set" not in summary


def test_number_within_equals_row_number_for_a_hot_group(spark):
    rows = spark.range(30000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 500) END AS stem",
        "CAST(id % 2 AS INT) AS src", "(id * 7919) % 30011 AS line_no")
    got = N.number_within(rows, ["stem"], "src", "line_no", "pos", rows=1024)
    want = rows.withColumn("want", F.expr("row_number() OVER (PARTITION BY stem ORDER BY src, line_no)"))
    joined = got.join(want, ["stem", "src", "line_no"])
    assert joined.count() == 30000 and joined.filter("pos <> want").count() == 0


@pytest.mark.parametrize("descending", [True, False])
def test_running_by_score_equals_one_window(spark, descending):
    rows = spark.range(5000).selectExpr(
        "CAST(id % 3 AS INT) AS k", "((id * 37) % 997) / 997e0 AS score", "id % 11 AS v"
    ).groupBy("k", "score").agg(F.expr("sum(v) AS v"))
    got = N.running_by_score(rows, ["k"], "score", {"s": "sum(v)", "m": "max(v)"}, descending, buckets=16)
    order = "DESC" if descending else "ASC"
    want = rows.selectExpr("k", "score", *[
        f"{f}(v) OVER (PARTITION BY k ORDER BY score {order}) AS w{f[0]}" for f in ("sum", "max")])
    joined = got.join(want, ["k", "score"])
    assert joined.count() == rows.count()
    assert joined.filter("s <> ws OR m <> wm").count() == 0


def test_hot_image_is_reduced_before_the_shuffle(spark):
    rows = spark.range(60000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0L ELSE id END AS image_id", "id AS det_idx", "'T1' AS label",
        "array(named_struct('x', 0.1e0, 'y', 0.1e0), named_struct('x', 0.2e0, 'y', id / 60000e0),"
        " named_struct('x', 0.1e0, 'y', 1.5e0), named_struct('x', 0.2e0, 'y', 1.5e0)) AS keypoints",
        "1000 AS image_width", "1000 AS image_height")
    spine = M.spine_by_image(rows)
    hot = spine.filter("image_id = 0").first()
    assert spine.count() == 40001
    assert hot.T1.upper_anterior.y == pytest.approx(59997 / 60000)
    text = plan(spine)
    assert text.index("max_by") < text.rindex("partial_max_by")
    assert "hashpartitioning(image_id" in text and "SortAggregate" not in text.split("partial_max_by")[1]


def test_skewed_image_join_is_split(spark):
    """With thresholds scaled down to the test the join on a hot stem runs as a skew join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        labels = spark.range(0, 40000, 1, 8).selectExpr(
            "CASE WHEN id % 2 = 0 THEN 0L ELSE id END AS stem", "id AS line_no", "0 AS class_id",
            "rand(1) AS cx", "rand(2) AS cy", "rand(3) AS w", "rand(4) AS h")
        images = spark.range(40000).selectExpr("id AS stem", "1000 AS width", "1000 AS height")
        joined = O.overlay_boxes(O.on_images(labels, images))
        assert len(joined.collect()) == 40000
        assert "skew=true" in plan(joined)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_matching_equals_brute_force(spark):
    rng = random.Random(3)

    def boxes(n):
        out = []
        for i in range(n):
            x, y, w, h = rng.uniform(0, 300), rng.uniform(0, 300), rng.choice([20, 40, 90]), rng.choice([15, 30, 64, 70])
            box = (x, y, x + w, y + h)
            out += [(i % 2, rng.randint(0, 1), *box)] * rng.choice([1, 1, 2])
            dx, dy = rng.uniform(-8, 8), rng.uniform(-8, 8)
            out.append((i % 2, out[-1][1], x + dx, y + dy, x + w + dx, y + h + dy))
        return out

    raw = boxes(120)
    preds = [(*b, i, rng.randint(0, 20) / 20) for i, b in enumerate(raw)]
    truths = [(*b, i) for i, b in enumerate(raw) if i % 3 != 1]
    p = spark.createDataFrame(preds, "image_id int, class_id int, x1 double, y1 double, x2 double, y2 double, det_idx long, confidence double")
    t = spark.createDataFrame(truths, "image_id int, class_id int, x1 double, y1 double, x2 double, y2 double, truth_idx long")

    def iou(a, b):
        o = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return o / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - o)

    pointed = {}
    for a in preds:
        near = [(-iou(a, b), b[6]) for b in truths if a[:2] == b[:2]]
        if near and -min(near)[0] >= 0.5:
            pointed.setdefault(min(near)[1], []).append((-a[7], a[6]))
    want = {(k, min(v)[1]) for k, v in pointed.items()}
    got = {(r.truth_idx, r.det_idx) for r in E.match_detections(p, t).collect()}
    assert got == want and len(want) > 50


def test_scores_by_hand(spark):
    cols = "image_id int, class_id int, x1 double, y1 double, x2 double, y2 double"
    t = spark.createDataFrame([(1, 0, 0., 0., 10., 10., 0), (2, 0, 0., 0., 10., 10., 0)], cols + ", truth_idx long")
    p = spark.createDataFrame([
        (1, 0, 0., 0., 10., 10., 0, .9), (1, 0, 50., 50., 60., 60., 1, .8), (2, 0, 0., 0., 10., 10., 0, .7),
    ], cols + ", det_idx long, confidence double")
    row = E.evaluate_by_class(p, t).first()
    assert row.ap50 == pytest.approx(0.5 * 1 + 0.5 * 2 / 3) and row.ap50_95 == pytest.approx(row.ap50)
    assert (row.precision, row.recall) == (pytest.approx(2 / 3), 1.0)


def test_sampling_is_repeatable_and_capped(spark, sf_dir):
    from spinelens.operators import predictions as R
    images = T.label_images(spark, sf_dir).selectExpr("stem AS image_id")
    a = {r.image_id for r in R.sample_images(images, 20).collect()}
    assert a == {r.image_id for r in R.sample_images(images.repartition(3), 20).collect()} and len(a) == 20
    assert R.sample_images(images, 10 ** 6).count() == images.count()


def test_evaluation_reads_each_input_once(spark, sf_dir):
    df = QUERIES["evaluation_by_class"](spark, sf_dir)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 2  # predictions and true boxes, views of one table
    assert final.count("Exchange hashpartitioning") - final.count("ReusedExchange") <= 11


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75])
def test_probes_find_every_pair(spark, threshold):
    """Boxes of all sizes and shapes: every pair above the threshold meets, with few probes per true box."""
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        w, h = 10 ** rng.uniform(-1, 3), 10 ** rng.uniform(-1, 3)
        x, y = rng.uniform(-500, 500), rng.uniform(-500, 500)
        rows.append((i, x, y, x + w, y + h))
        for k in range(2):
            a, b = w * rng.uniform(0.5, 2), h * rng.uniform(0.7, 1.4)
            dx, dy = w * rng.uniform(-0.3, 0.3), h * rng.uniform(-0.3, 0.3)
            rows.append((i, x + dx, y + dy, x + dx + a, y + dy + b))
    kinds = "x1 double, y1 double, x2 double, y2 double"
    p = spark.createDataFrame([(i, 0, *b, k, 0.5) for k, (i, *b) in enumerate(rows)],
                              f"image_id int, class_id int, {kinds}, det_idx long, confidence double")
    t = spark.createDataFrame([(i, 0, *b, k) for k, (i, *b) in enumerate(rows)], f"image_id int, class_id int, {kinds}, truth_idx long")
    grouped = {}
    for k, (i, *b) in enumerate(rows):
        grouped.setdefault(i, []).append((k, b))

    def iou(a, b):
        o = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return o / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - o)

    true = E._distinct(t, ["image_id", "class_id", "x1", "y1", "x2", "y2"], "truth_idx")
    pred = E._distinct(p, ["image_id", "class_id", "x1", "y1", "x2", "y2", "confidence"], "det_idx")
    probes = E.truth_probes(true, threshold)
    met = {(r.det_idx, r.truth_idx) for r in E._prediction_cells(pred).join(
        probes, ["image_id", "class_id", *E._CELL]).select("det_idx", "truth_idx").collect()}
    want = {(a, b) for group in grouped.values() for a, x in group for b, y in group if iou(x, y) >= threshold}
    assert want <= met and len(want) > len(rows)
    if threshold == 0.5:
        assert probes.count() <= 12 * len(rows)


def test_a_hot_image_does_not_pair_all_boxes(spark):
    """20,000 boxes side by side in one image: candidates grow with the boxes, not with their square."""
    boxes = spark.range(20000).selectExpr(
        "1 AS image_id", "0 AS class_id", "id % 200 * 30e0 AS x1", "id div 200 * 30e0 AS y1",
        "id % 200 * 30e0 + 28 AS x2", "id div 200 * 30e0 + 28 AS y2", "id AS det_idx", "(id * 7919) % 20011 / 20011e0 AS confidence")
    true = boxes.withColumnRenamed("det_idx", "truth_idx")
    keys = ["image_id", "class_id", "x1", "y1", "x2", "y2"]
    pairs = E._prediction_cells(E._distinct(boxes, [*keys, "confidence"], "det_idx")).join(
        E.truth_probes(E._distinct(true, keys, "truth_idx")), ["image_id", "class_id", *E._CELL])
    assert pairs.count() < 40 * 20000
    row = E.evaluate_by_class(boxes, true).first()
    assert (row.n_truth, row.recall, row.ap50_95) == (20000, 1.0, pytest.approx(1.0))




def test_builds_move_no_shapes(spark, sf_dir, tmp_path):
    """Documents are chosen on sample and path; what is shuffled or sorted is computed from shapes, not shapes."""
    from spinelens.operators import datasets as B
    T.corpus_docs(spark, sf_dir).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    selected, images = T.corpus_selected(spark, sf_dir), T.corpus_images(spark, sf_dir)
    built = [B.build_pose_dataset(selected, docs, images), B.build_point_dataset(selected, docs, images), B.build_box_dataset(docs, images)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for parts in built:
            for name, df in parts.items():
                executed = df._jdf.queryExecution().executedPlan()
                for node in executed_nodes(executed):
                    if node.nodeName() in ("Exchange", "Sort", "SortAggregate") or "Exchange" in node.nodeName():
                        output = node.child().output().mkString(",") if node.nodeName() != "ReusedExchange" else ""
                        assert "shapes" not in output, (name, node.nodeName(), output)
                        if node.nodeName() == "SortAggregate":
                            assert "objects" not in output and "heads" not in output, (name, output)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def executed_nodes(plan):
    """All nodes of a physical plan, also behind adaptive execution."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from executed_nodes(children.apply(i))


def test_detection_documents_of_a_hot_image_are_bounded(spark):
    from spinelens.operators import detections as D
    rows = spark.range(900).selectExpr("IF(id < 800, 1, 2 + id % 50) AS image_id", "CAST(id AS INT) AS det_idx", "'T1' AS label",
                                       "0.5e0 AS confidence", "array(0.1e0, 0.1e0, 0.1e0, 0.1e0) AS bbox", "10 AS image_width", "10 AS image_height")
    images = spark.range(60).selectExpr("id AS image_id", "10 AS image_width", "10 AS image_height")
    cfh = rows.limit(0).selectExpr("image_id", "confidence", "bbox", "named_struct('x', 1e0, 'y', 1e0) AS center")
    found = D.detection_documents(images, rows, cfh, most=300)
    docs = {r.image_id: r for r in found["documents"].collect()}
    assert len(docs) == 60 and (docs[1].n_vertebrae, docs[1].vertebrae) == (800, []) and found["overflow"].count() == 800
    assert (docs[0].n_vertebrae, docs[0].vertebrae, docs[0].cfh) == (0, [], None)
    assert [v.det_idx for v in docs[2].vertebrae] == [800, 850] and docs[2].vertebrae[0].label == "T1"


@pytest.mark.parametrize("name", ["last_label_wins", "first_cfh_box", "last_measurement_wins"])
def test_kept_rows_are_not_sorted(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert "SortAggregate" not in plan(df)


def test_kept_rows_of_a_hot_key(spark):
    from spinelens.operators.winners import kept_rows
    rows = spark.range(30000).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id % 500)) AS k", "id AS n", "id % 7 AS m", "array(id) AS payload")
    want = {r.k: r.n for r in rows.groupBy("k").agg(F.max("n").alias("n")).collect()}
    for columns in (["k", "n", "m"], ["k", "n", "payload"]):
        got = kept_rows(rows.select(*columns), ["k"], ["n"]).collect()
        assert {r.k: r.n for r in got} == want and len(got) == len(want)
        assert all(r[2] in (r.n % 7, [r.n]) for r in got)
    first = {r.k: r.n for r in kept_rows(rows, ["k"], ["m", "n"], last=False).collect()}
    assert first["hot"] == 0 and len(first) == len(want)
    nulls = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (None, 3, "c")], "k int, n int, p string")
    assert [tuple(r) for r in kept_rows(nulls, ["k"], ["n"]).collect()] == [(1, 2, "b")]
    assert kept_rows(nulls.limit(0), ["k"], ["n"]).collect() == []
