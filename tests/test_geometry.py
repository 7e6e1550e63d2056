import random

import pytest
from pyspark.sql import functions as F

import plain
from spinelens import schemas
from spinelens.functions import boxes as B
from spinelens.functions import names
from spinelens.functions import points as P
from spinelens.operators import measurements as M


def polygons(n, seed=7):
    rng = random.Random(seed)
    shapes = []
    for i in range(n):
        k = rng.choice([4, 5, 8, 12, 40])
        if i % 5 == 0:  # integer grids give ties and repeated vertices
            shapes.append([(float(rng.randint(0, 4)), float(rng.randint(0, 4))) for _ in range(k)])
        else:
            shapes.append([(rng.uniform(0, 2000), rng.uniform(0, 3000)) for _ in range(k)])
    return shapes


def frame(spark, shapes):
    rows = [(i, [{"x": x, "y": y} for x, y in s]) for i, s in enumerate(shapes)]
    return spark.createDataFrame(rows, "id int, points array<struct<x: double, y: double>>")


def test_four_corners_match_the_plain_rule(spark):
    shapes = polygons(300)
    got = frame(spark, shapes).selectExpr("id", f"{P.four_corners('points')} AS c").collect()
    for row in got:
        assert [(p.x, p.y) for p in row.c] == plain.corners(shapes[row.id]), row.id


def test_four_corners_follow_translation_and_scaling(spark):
    shapes = [s for i, s in enumerate(polygons(60, seed=3)) if i % 5]
    moved = [[(4 * x + 1024, 4 * y - 512) for x, y in s] for s in shapes]
    base = frame(spark, shapes).selectExpr("id", f"{P.four_corners('points')} AS c").collect()
    other = {r.id: r.c for r in frame(spark, moved).selectExpr(
        "id", f"{P.four_corners('points')} AS c").collect()}
    for row in base:
        assert len({(p.x, p.y) for p in row.c}) == 4
        assert [(pytest.approx(4 * p.x + 1024), pytest.approx(4 * p.y - 512)) for p in row.c] == [
            (p.x, p.y) for p in other[row.id]]


def test_too_few_vertices_give_no_corners(spark):
    df = frame(spark, [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], []])
    assert df.selectExpr(f"{P.four_corners('points')} AS c").filter("c IS NOT NULL").count() == 0
    assert df.selectExpr(f"{P.vertex_mean('points')} AS m").filter("m IS NULL").count() == 1


@pytest.mark.parametrize("whole_table", [True, False])
def test_endplates(spark, whole_table):
    rng = random.Random(5)
    quads = [[(float(rng.randint(0, 3)), float(rng.randint(0, 3))) for _ in range(4)] for _ in range(400)]
    df = frame(spark, quads).withColumnRenamed("points", "keypoints")
    if whole_table:
        df = M.with_endplates(df)
    else:
        df = df.withColumn("plates", F.expr(P.endplates("keypoints")))
    for row in df.collect():
        want, p = plain.plates(quads[row.id]), row.plates
        assert ((p.upper_anterior.x, p.upper_anterior.y), (p.upper_posterior.x, p.upper_posterior.y)) == want["u"]
        assert ((p.lower_anterior.x, p.lower_anterior.y), (p.lower_posterior.x, p.lower_posterior.y)) == want["l"]
        assert (p.center.x, p.center.y) == pytest.approx(want["c"])


def test_endplates_need_four_points(spark):
    df = frame(spark, [[(0.0, 0.0)] * 3, [(0.0, 0.0)] * 5]).withColumnRenamed("points", "keypoints")
    assert M.with_endplates(df).filter("plates IS NOT NULL").count() == 0


def one(spark, expression):
    return spark.range(1).selectExpr(f"{expression} AS v").first().v


def test_fixed_box_is_cut_before_its_centre_is_taken(spark):
    box = one(spark, B.fixed_box("10e0", "500e0", "1000", "1000"))
    assert (box.x_min, box.x_max, box.y_min, box.y_max) == (0.0, 42.0, 468.0, 532.0)
    outside = one(spark, B.fixed_box("1100e0", "500e0", "1000", "1000"))
    assert outside.x_max - outside.x_min < 0


def test_box_sides(spark):
    assert one(spark, B.default_side("2014", "4648")) == max(int(2014 * 0.06), int(4648 * 0.04))
    assert one(spark, B.adaptive_side("CAST(NULL AS DOUBLE)", "2014", "4648")) == 185
    assert one(spark, B.adaptive_side("111.1e0", "2014", "4648")) == int(111.1 * 1.8)
    assert one(spark, B.adaptive_side("111.1e0", "2014", "4648", 2.5)) == int(111.1 * 2.5)
    want = max(int((int(2014 * .06) + int(100.5 * 1.8)) / 2), int((int(4648 * .04) + int(100.5 * 1.8)) / 2))
    assert one(spark, B.blended_side("100.5e0", "2014", "4648")) == want


def test_norm_box_values_are_cut_one_by_one(spark):
    box = one(spark, B.point_to_norm_box("-5e0", "2000e0", "1500", "1000", "1000"))
    assert (box.cx, box.cy, box.w, box.h) == (0.0, 1.0, 1.0, 1.0)


def test_pixel_corner_truncates_twice(spark):
    low, high = B.pixel_corner("0.1234e0", "0.0519e0", "1000")
    c, s = int(0.1234 * 1000), int(0.0519 * 1000)
    assert (one(spark, low), one(spark, high)) == (int(c - s / 2), int(c + s / 2))


def test_class_and_file_names(spark):
    assert one(spark, names.class_name("0")) == "C7"
    assert one(spark, names.class_name("17")) == "T12"
    assert one(spark, names.class_name("18")) == "Class_18"
    assert one(spark, names.class_name("18", "Unknown_", 19)) == "CFH"
    assert one(spark, names.class_name("25", None)) is None
    assert one(spark, names.class_id("'L5'")) == 5
    assert one(spark, names.class_id("'S1'")) is None
    assert one(spark, names.stem("'a.b.png'")) == "a.b"
    assert one(spark, names.extension("'a.b.PNG'")) == "PNG"


def test_schema_of_documents_is_explicit():
    assert [f.name for f in schemas.DETECTIONS] == [
        "image_id", "image_width", "image_height", "vertebrae", "cfh"]
