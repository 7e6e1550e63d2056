"""Many queries look at a tree together: few numpy calls however many they are, and the rows of all inner products."""

import numpy as np
import pytest

from spinelens.llm import cover_tree, hard_negatives
from spinelens.llm.spill_runs import unpacked


def tree_of(points, ids=None, labels=None):
    ids = np.arange(len(points)) if ids is None else ids
    labels = np.zeros(len(points), np.int64) if labels is None else labels
    return cover_tree.Tree(cover_tree.frame(cover_tree.build(points, ids, labels), points, ids, labels))


def unit(rng, n, d=64):
    x = rng.normal(size=(n, d))
    return np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)


def first(scores, ids, k, low, high):
    some = [(-s, i) for s, i in zip(scores, ids) if low <= s <= high]
    return [(-s, i) for s, i in sorted(some)[:k]]


def held(lists, q):
    return [[(int(s), int(i)) for s, i in zip(lists.scores[q, l, :n], lists.ids[q, l, :n])] for l, n in enumerate(lists.count[q])]


def test_few_blocks_for_many_queries(monkeypatch):
    rng, blocks = np.random.default_rng(3), []
    points, vectors = unit(rng, 4000), unit(rng, 700)
    tree, block = tree_of(points), cover_tree.Tree._block
    monkeypatch.setattr(cover_tree.Tree, "_block", lambda self, lists, who, *more: blocks.append(len(who)) or block(self, lists, who, *more))
    low, high = np.tile([[-1 << 40, 9000, 9000]], (700, 1)), np.tile([[1 << 40, 20000, 24000]], (700, 1))
    lists = cover_tree.Lists(4, low, high)
    assert tree.find(cover_tree.Queries(vectors), lists, np.arange(700)) == 700 * 4000
    lists.settle()
    assert len(blocks) < 40 and lists.waiting == 0
    for q in range(0, 700, 61):
        assert held(lists, q) == [first(points @ vectors[q], range(4000), 4, low[q, l], high[q, l]) for l in range(3)]


def test_equal_rows_are_looked_at_once():
    rng = np.random.default_rng(4)
    points = np.concatenate([unit(rng, 50, 8), np.tile(unit(rng, 1, 8), (3000, 1)), unit(rng, 50, 8)])
    ids = rng.permutation(len(points))
    tree = tree_of(points, ids)
    lists = cover_tree.Lists(6, *np.tile([[[-1 << 40]], [[1 << 40]]], (1, 120, 1)))
    assert tree.find(cover_tree.Queries(points[:120]), lists, np.arange(120)) == 120 * 101
    lists.settle()
    for q in range(120):
        assert held(lists, q) == [first((points @ points[q]).tolist(), ids.tolist(), 6, -1 << 40, 1 << 40)]


def awkward(kind, rng):
    if kind == "ties":  # few scores, each of very many rows
        return rng.integers(-1, 2, (3000, 3))
    if kind == "clusters":
        return np.concatenate([rng.integers(-800, 800, 8) + rng.integers(-9, 9, (400, 8)) for _ in range(12)])
    return rng.integers(-9, 9, (600, 5)) * 10 ** rng.integers(0, 9, (600, 1))  # exact in singles, in doubles, in neither


@pytest.mark.parametrize("kind", ["ties", "clusters", "magnitudes"])
def test_positives_and_negatives_of_a_batch(kind):
    rng = np.random.default_rng(6)
    points = awkward(kind, rng)
    n = len(points)
    ids, labels = rng.permutation(n) // 2, np.sort(rng.integers(0, 4, n))
    cuts = [0, n // 3, n // 2, n]  # some trees have several labels
    trees = [tree_of(points[a:b], ids[a:b], labels[a:b]) for a, b in zip(cuts, cuts[1:])]
    anchors = rng.choice(n, 90, replace=False)
    tree, place = np.searchsorted(cuts, anchors, "right") - 1, anchors - np.array(cuts)[np.searchsorted(cuts, anchors, "right") - 1]
    lens, flat, none = np.full(90, points.shape[1]), points[anchors].reshape(-1), np.zeros(90, np.int64)

    def searched(counts, windows, is_first):
        of = hard_negatives._Anchors([(tree, place, labels[anchors], lens, flat, counts, windows)], 3, 5, 30, 90, is_first)
        for number, t in enumerate(trees):
            (of.positives if is_first else of.negatives)(number, t)
        out = {}
        for _, data in of.found():
            trees_, places, counts, scores, ids_ = unpacked(data)
            at = 0
            for i, c in enumerate(counts.tolist()):
                row, l = divmod(i, len(counts) // len(places))
                out.setdefault(cuts[trees_[row]] + int(places[row]), []).append(list(zip(scores[at : at + c].tolist(), ids_[at : at + c].tolist())))
                at += c
        return out

    exact = points.astype(object)
    near, windows = searched(none, np.zeros(0, np.int64), True), []
    for a in anchors.tolist():
        rows = [b for b in range(n) if labels[b] == labels[a] and b != a]
        assert near[a] == [first((exact[rows] @ exact[a]).tolist(), ids[rows].tolist(), 3, -1 << 99, 1 << 99)]
        windows += [s for s, _ in near[a][0]]
    hard = searched(np.array([len(near[a][0]) for a in anchors.tolist()]), np.array(windows), False)
    for a in anchors.tolist():
        rows = np.flatnonzero(labels != labels[a])
        scores = (exact[rows] @ exact[a]).tolist()
        want = [first(scores, ids[rows].tolist(), 5, -(-30 * p // 100), 90 * p // 100) for p, _ in near[a][0]]
        assert hard[a][: len(want)] == want and not any(hard[a][len(want) :])
