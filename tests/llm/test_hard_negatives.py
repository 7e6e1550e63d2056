"""Hard negatives against all inner products in plain Python, and the tree's bounds."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from spinelens.llm import cover_tree, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id int, anchor string, tree int, data int"


def frame(spark, rows):
    return spark.createDataFrame([Row(vec_id=i, embedding=v, label=c, id=1, anchor="x", tree=2, data=3) for i, v, c in rows], SCHEMA)


def plain(rows, is_anchor, low=30, high=90):
    kept = []
    for i, v, c in rows:
        if c is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], c))
    for a, (anchor, q, label) in enumerate(kept):
        if not is_anchor(anchor):
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i is None, i, c) for b, (i, v, c) in enumerate(kept) if b != a]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        for p, _, positive, c in [s for s in scored if s[3] == label][:5]:
            window = [s for s in scored if s[3] != label and low * -p <= 100 * -s[0] <= high * -p][:10]
            for rank, (n, _, negative, _) in enumerate(window, 1):
                yield (anchor, positive, rank, negative, -p, -n)


def got(df, anchor):
    return Counter(tuple(r) for r in hard_negatives.mine(df, anchor=anchor).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_given_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert got(table, "vec_id % 20 = 0") == Counter(plain(rows, lambda i: i % 20 == 0))


@pytest.mark.parametrize("values", [64, 1 << 20])
def test_clusters_copies_and_awkward_rows(spark, monkeypatch, values):
    monkeypatch.setattr(hard_negatives, "TREE_VALUES", values)
    monkeypatch.setattr(hard_negatives, "BATCH", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 4)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=4) * 0.05).tolist(), int(i % 5)) for i in range(240)]
    rows += [(1000 + i, centres[1].tolist(), int(i % 3)) for i in range(120)]  # a third of all rows are equal
    rows += [(1, rows[1][1], 1), (1, rows[1][1], 1), (None, centres[1].tolist(), 1), (None, centres[2].tolist(), 2)]
    rows += [(2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan")] * 4, 1), (2003, [float("inf")] * 4, 2), (2004, [1.0], None),
             (2005, [], 1), (2010, [0.5], 2), (2015, [0.0] * 4, 0), (2020, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 3), (2025, [1e4] * 4, 4)]
    assert got(frame(spark, rows).repartition(3), "vec_id % 5 = 0") == Counter(plain(rows, lambda i: i is not None and i % 5 == 0))


def test_no_rows_no_anchors_one_label(spark):
    assert got(frame(spark, []), None) == Counter()
    rows = [(i, [float(i), 1.0], 1) for i in range(30)]
    assert got(frame(spark, rows), "vec_id = 99") == Counter()
    assert got(frame(spark, rows), "vec_id < 9") == Counter()
    few = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.5, 0.0], 2)]
    assert got(frame(spark, few), "vec_id = 1") == Counter({(1, 2, 1, 3, 65536, 32768): 1})


def test_tree_covers_and_skips():
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.integers(-800, 800, 8) + rng.integers(-9, 9, (300, 8)) for _ in range(20)])
    nodes = cover_tree.build(points)
    tree = cover_tree.Tree(cover_tree.frame(nodes, points, np.arange(len(points)), np.zeros(len(points), np.int64)))
    assert len(tree.centre) > 20 and sorted(tree.order.tolist()) == list(range(len(points)))
    for q in points[::777]:
        length = float(np.linalg.norm(q))
        low, high = tree.bounds(np.arange(len(tree.centre)), q, length)
        scores = tree.scores(slice(None), q)
        for node in range(len(tree.centre)):
            inside = scores[tree.lo[node] : tree.hi[node]]
            assert low[node] <= inside.min() and inside.max() <= high[node]
        best, window = cover_tree.Best(5), cover_tree.Best(7, 1000, int(scores.max() * 0.5))
        looked = tree.search(q, [best, window], np.ones(len(points), bool))
        order = sorted(range(len(points)), key=lambda i: (-int(points[i] @ q), i))
        assert best.ids.tolist() == order[:5]
        assert window.ids.tolist() == [i for i in order if 1000 <= int(points[i] @ q) <= int(scores.max() * 0.5)][:7]
        assert looked < len(points) / 2


def test_exact_beyond_doubles():
    points = np.array([[1 << 40, 3], [1 << 40, 4], [-(1 << 40), 5]])
    tree = cover_tree.Tree(cover_tree.frame(cover_tree.build(points), points, np.arange(3), np.zeros(3, np.int64)))
    found = cover_tree.Best(2)
    tree.search(np.array([1 << 20, 1]), [found], np.ones(3, bool))
    assert found.scores.tolist() == [(1 << 60) + 4, (1 << 60) + 3]
