"""Cover trees over norm-augmented integer vectors, searched by inner product, many queries at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from spinelens.llm.spill_runs import packed, unpacked

#: A node's children lie within its radius divided by so much, or further levels down.
BASE = 1.5
#: Nodes with so few distinct points are not divided: looking at each costs less than bounds of parts.
LEAF = 256
#: A node's children have so many points on average, or it is not divided.
CROWD = 32
#: Points of a node by which it is seen whether points lie near each other at all.
TRIED = 64
#: Relative slack of bounds, far above the rounding of double sums of products.
SLACK = 1e-9
#: The same for radii, which are roots of differences.
ROUND = 1e-6
#: Sums of products are exact in doubles, and in singles, if no partial sum can pass these.
EXACT, EXACT_SINGLE = 1 << 52, (1 << 24) - 16
#: Queries and points whose scores are computed at a time, and the first points of a query.
QUERIES, POINTS, FIRST = 256, 1024, 32
#: Rows found that wait to be sorted into lists.
PENDING = 1 << 15
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _spots(points: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with equal vectors of a label side by side, by id, and where each such spot starts."""
    odd = np.random.default_rng(1).integers(1, MOST, points.shape[1], dtype=np.uint64) | np.uint64(1)
    by = np.lexsort((ids, points.astype(np.int64).view(np.uint64) @ odd, labels))
    new = np.ones(len(by), bool)
    new[1:] = (labels[by[1:]] != labels[by[:-1]]) | (points[by[1:]] != points[by[:-1]]).any(axis=1)
    return by, np.flatnonzero(new)


def build(points: np.ndarray, ids: np.ndarray | None = None, labels: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """A tree over the rows of ``points`` (integers, not empty): the order of rows, and nodes with their centres and covering radii.

    Equal points of a label are one spot, its rows in the order of ids; nodes are ranges of spots. Each point gets one more
    component that brings it to the longest point's norm, so nearness on that sphere is nearness in inner products. A
    node's centres are chosen farthest first until every point is within the next level's radius: centres lie further
    apart than that, and each point goes to its nearest one. A node stays a leaf if it has few points or if its children
    would have few, which a try with some of its points mostly tells: looking at each costs no more then.
    """
    ids = np.arange(len(points)) if ids is None else ids
    labels = np.zeros(len(points), np.int64) if labels is None else labels
    by, first = _spots(points, ids, labels)
    x = points[by[first]].astype(np.float64)
    norms = np.einsum("ij,ij->i", x, x)
    sphere = float(norms.max())
    x = np.c_[x, np.sqrt(np.maximum(sphere - norms, 0))]

    def distances(rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 * sphere - 2 * (x[rows] @ x[centre]), 0))

    def crowded(rows: np.ndarray, bound: float) -> bool:
        tried = rows[:: max(1, len(rows) // TRIED)]
        near = np.count_nonzero((x[rows] @ x[tried].T).max(axis=1) >= sphere - bound * bound / 2)
        return near >= min(CROWD * len(tried), len(rows) // 2)

    order = np.arange(len(x))
    centre, radius, lo, hi, child_lo, child_hi = [0], [float(distances(order, 0).max())], [0], [len(x)], [0], [0]
    level = [radius[0]]
    node = 0
    while node < len(centre):
        rows = order[lo[node] : hi[node]]
        bound = level[node] / BASE
        while len(rows) > LEAF and radius[node] > 0 and crowded(rows, bound):
            near = distances(rows, centre[node])
            owner, centres = np.zeros(len(rows), np.int64), [centre[node]]
            while (far := int(near.argmax())) >= 0 and near[far] > bound and CROWD * len(centres) <= len(rows):
                other = distances(rows, rows[far])
                other[far] = 0.0
                closer = other < near
                owner[closer] = len(centres)
                near = np.minimum(near, other)
                centres.append(int(rows[far]))
            if len(centres) == 1:
                bound = min(bound, radius[node]) / BASE
                continue
            if CROWD * len(centres) > len(rows):
                break
            moved = np.argsort(owner, kind="stable")
            order[lo[node] : hi[node]] = rows[moved]
            starts = np.searchsorted(owner[moved], np.arange(len(centres) + 1))
            child_lo[node], child_hi[node] = len(centre), len(centre) + len(centres)
            radius += np.maximum.reduceat(near[moved], starts[:-1]).tolist()
            for i, c in enumerate(centres):
                centre.append(c)
                hi.append(int(starts[i + 1]) + lo[node])
                lo.append(int(starts[i]) + lo[node])
                level.append(bound)
                child_lo.append(0)
                child_hi.append(0)
            break
        node += 1
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    counts = np.diff(first, append=len(by))[order]
    starts = np.cumsum(counts) - counts
    return {
        "order": by[np.repeat(first[order] - starts, counts) + np.arange(len(by))], "first": starts,
        "centre": place[np.array(centre)], "radius": np.array(radius), "lo": np.array(lo), "hi": np.array(hi),
        "child_lo": np.array(child_lo), "child_hi": np.array(child_hi), "sphere": np.array([sphere])}


def small(values: np.ndarray) -> np.ndarray:
    """A copy in 16 bits if they hold all values."""
    return values.astype(np.int16 if -(1 << 15) < values.min(initial=0) and values.max(initial=0) < 1 << 15 else np.int64)


_NAMES = ("first", "centre", "lo", "hi", "child_lo", "child_hi")


def frame(tree: dict[str, np.ndarray], points: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> bytes:
    """The tree with its points and labels (a row per spot) and ids (in tree order), as bytes."""
    order = tree["order"]
    spots = order[tree["first"]]
    return packed(*(tree[n].astype(np.int32) for n in _NAMES), tree["radius"].view(np.int64), tree["sphere"].view(np.int64),
                  order.astype(np.int32), ids[order], labels[spots], small(points[spots]).reshape(-1), np.array([points.shape[1]]))


def ranked(who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``who``, higher scores and smaller ids, and the number of each within its ``who``."""
    least, most = int(scores.min(initial=0)), int(scores.max(initial=0))
    if (int(who.max(initial=0)) + 1) * (most - least + 1) < MOST:
        key = who * (most - least + 1) + (most - scores)
        order = np.argsort(key)
        key = key[order]
        same = np.r_[False, key[1:] == key[:-1]]
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        order[tied] = order[tied][np.lexsort((ids[order[tied]], key[tied]))]
    else:
        order = np.lexsort((ids, ~scores, who))
    starts = np.flatnonzero(np.diff(who[order], prepend=-1))
    return order, np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))


class Lists:
    """Per query and list the first ``k`` rows with scores from ``low`` to ``high`` (a row per query): higher scores first, ties by smaller id."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = (np.zeros((*low.shape, k), np.int64) for _ in range(2))
        self.count = np.zeros(low.shape, np.int64)
        # a further row has a score above its list's floor, or that score and not more than the last id
        self.floor, self.last = low.copy(), np.full(low.shape, MOST)
        self.least = low.min(axis=1)
        self.step = np.full(len(low), FIRST)
        self.pending: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.pending.append((who, scores, ids))
        self.waiting += len(who)

    def settle(self) -> None:
        if not self.pending:
            return
        who, scores, ids = (np.concatenate(x) for x in zip(*self.pending))
        self.pending, self.waiting = [], 0
        for l in range(self.low.shape[1]):
            floor = self.floor[who, l]
            some = np.flatnonzero((scores <= self.high[who, l]) & ((scores > floor) | (scores == floor) & (ids <= self.last[who, l])))
            if not len(some):
                continue
            at = np.unique(who[some])
            held = np.arange(self.k) < self.count[at, l][:, None]
            w = np.r_[who[some], np.repeat(at, self.count[at, l])]
            s, i = np.r_[scores[some], self.scores[at, l][held]], np.r_[ids[some], self.ids[at, l][held]]
            order, rank = ranked(w, s, i)
            order, rank = order[rank < self.k], rank[rank < self.k]
            w = w[order]
            self.scores[w, l, rank], self.ids[w, l, rank] = s[order], i[order]
            self.count[at, l] = np.diff(np.searchsorted(w, np.r_[at, MOST]))
            full = at[self.count[at, l] == self.k]
            self.floor[full, l], self.last[full, l] = self.scores[full, l, -1], self.ids[full, l, -1]
            self.least[full] = self.floor[full].min(axis=1)


class Best:
    """The first ``k`` rows of one list."""

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)


class Queries:
    """Vectors (a row each) that search together; their lists are those from ``start`` on."""

    def __init__(self, vectors: np.ndarray, start: int = 0):
        self.vectors, self.start = vectors, start
        doubles = vectors.astype(np.float64)
        self.lengths = np.sqrt(np.einsum("ij,ij->i", doubles, doubles))


class Tree:
    """A tree read back; ``find`` descends with many queries, best nodes first."""

    def __init__(self, data: bytes):
        *nodes, radius, sphere, order, self.ids, self.labels, points, dim = unpacked(data)
        self.first, self.centre, self.lo, self.hi, self.child_lo, self.child_hi = (n.astype(np.int64) for n in nodes)
        self.order = order.astype(np.int64)
        self.counts = np.diff(self.first, append=len(order))
        self.points = points.reshape(len(self.labels), int(dim[0]))
        self.kinds: dict[type, np.ndarray] = {}
        self.norm = norm = float(np.sqrt(sphere.view(np.float64)[0]))
        # the angle that a node's radius, a chord of the sphere, spans
        chord = radius.view(np.float64) * (1 + SLACK) + ROUND * norm
        self.angle = 2 * np.arcsin(np.minimum(chord / (2 * norm), 1.0)) if norm else np.zeros(len(radius))
        self.buffers: dict[type, np.ndarray] = {}

    def values(self, kind: type) -> np.ndarray:
        if kind not in self.kinds:
            self.kinds[kind] = self.points.astype(kind)
        return self.kinds[kind]

    def kind(self, length: float) -> type:
        """Numbers in which all sums of products with vectors of this length are exact."""
        most = length * self.norm
        return np.float32 if most < EXACT_SINGLE else np.float64 if most < EXACT else object

    def scores(self, rows: slice | np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact integer inner products."""
        kind = self.kind(float(np.linalg.norm(query.astype(np.float64))))
        d = min(len(query), self.points.shape[1])
        return (self.values(kind)[rows, :d] @ query[:d].astype(kind)).astype(np.int64)

    def bounds(self, nodes: np.ndarray, queries: np.ndarray, lengths: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score in each node: a cap of the sphere around its centre."""
        d = min(queries.shape[-1], self.points.shape[1])
        reach = np.asarray(lengths * self.norm)[..., None]
        products = queries[..., :d].astype(np.float64) @ self.points[self.centre[nodes], :d].astype(np.float64).T
        turn = np.arccos(np.clip(products / np.where(reach > 0, reach, 1.0), -1.0, 1.0))
        slack = reach * SLACK
        angle = self.angle[nodes]
        return (reach * np.cos(np.minimum(turn + angle + SLACK, np.pi)) - slack,
                reach * np.cos(np.maximum(turn - angle - SLACK, 0.0)) + slack)

    def find(self, queries: Queries, lists: Lists, some: np.ndarray, only: int | None = None,
             allowed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, spare: int = 0) -> int:
        """Add all rows that belong to the lists of ``some`` of the queries; the number of scores computed is returned.

        A node is left out for queries of whose lists each lies outside its bounds, by window or by the last row of a
        full list. ``only`` is a label to which rows are held. ``allowed`` tells of numbers in the lists and rows which
        pairs count; apart from whole spots it refuses at most ``spare`` rows of a spot.
        """
        if only is not None and (self.labels != only).any():
            return self._scan(queries, lists, some, np.flatnonzero(self.labels == only), allowed, spare)

        def needed(of: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            at = queries.start + of
            return ((high[:, None] >= lists.floor[at]) & (low[:, None] <= lists.high[at])).any(axis=1)

        def visit(node: int, of: np.ndarray) -> int:
            if not self.child_hi[node]:
                return self._scan(queries, lists, of, slice(self.lo[node], self.hi[node]), allowed, spare)
            nodes = np.arange(self.child_lo[node], self.child_hi[node])
            low, high = self.bounds(nodes, queries.vectors[of], queries.lengths[of])
            looked = 0
            for i in np.argsort(-high.mean(axis=0)).tolist():
                lists.settle()
                if len(still := of[needed(of, low[:, i], high[:, i])]):
                    looked += visit(int(nodes[i]), still)
            return looked

        low, high = self.bounds(np.zeros(1, np.int64), queries.vectors[some], queries.lengths[some])
        some = some[needed(some, low[:, 0], high[:, 0])]
        return visit(0, some) if len(some) else 0

    def _scan(self, queries: Queries, lists: Lists, some: np.ndarray, spots: slice | np.ndarray, allowed, spare: int) -> int:
        most = np.asarray(queries.lengths[some] * self.norm)
        d = min(queries.vectors.shape[1], self.points.shape[1])
        looked = 0
        for kind, part in ((np.float32, most < EXACT_SINGLE), (np.float64, (most >= EXACT_SINGLE) & (most < EXACT)), (object, most >= EXACT)):
            if not part.any():
                continue
            points = self.values(kind)[spots, :d]
            numbers = np.arange(len(self.labels))[spots]
            of = some[part]
            for k in range(0, len(of), QUERIES):
                now = of[k : k + QUERIES]
                who, vectors = queries.start + now, queries.vectors[now, :d].astype(kind)
                step, at = int(lists.step[who].min()), 0
                while at < len(points):
                    self._block(lists, who, vectors, points[at : at + step], numbers[at : at + step], allowed, spare)
                    at += step
                    if step < POINTS or lists.waiting >= PENDING:
                        lists.settle()
                    step = min(2 * step, POINTS)
                lists.step[who] = step
                looked += len(now) * len(points)
        return looked

    def _block(self, lists: Lists, who: np.ndarray, vectors: np.ndarray, points: np.ndarray, spots: np.ndarray, allowed, spare: int) -> None:
        """Scores of some queries and points, and what of them may belong to a list."""
        if vectors.dtype == object:
            scores = (vectors @ points.T).astype(np.int64)
        else:
            buffer = self.buffers.setdefault(vectors.dtype, np.empty(QUERIES * POINTS, vectors.dtype))
            scores = np.dot(vectors, points.T, out=buffer[: len(vectors) * len(points)].reshape(len(vectors), len(points)))
        # few queries have a hit among so many points: the greatest scores tell them faster than comparing each
        some = np.flatnonzero(scores.max(axis=1) >= lists.least[who].astype(scores.dtype))
        if not len(some):
            return
        who, scores = who[some], scores[some]
        hit = scores >= lists.least[who].astype(scores.dtype)[:, None]
        found = np.count_nonzero(hit)
        if found > hit.size >> 8:
            hit &= scores <= lists.high[who].max(axis=1).astype(scores.dtype)[:, None]
            found = np.count_nonzero(hit)
        if found > hit.size >> 5:
            least = self.ids[self.first[spots]]
            every = np.zeros(hit.shape, bool)
            for l in range(lists.low.shape[1]):
                floor, high = (x[who, l].astype(scores.dtype)[:, None] for x in (lists.floor, lists.high))
                every |= (scores <= high) & ((scores > floor) | (scores == floor) & (least <= lists.last[who, l][:, None]))
            hit &= every
        i, j = np.divmod(np.flatnonzero(hit), len(points))
        score, spot = scores[i, j].astype(np.int64), spots[j]
        counts = np.minimum(self.counts[spot], lists.k + spare)
        rows = self.first[spot]
        if len(counts) and counts.max() > 1:
            ends = np.cumsum(counts)
            rows = np.repeat(rows - ends + counts, counts) + np.arange(ends[-1])
            i, score = np.repeat(i, counts), np.repeat(score, counts)
        if allowed is not None:
            kept = allowed(who[i], rows)
            i, score, rows = i[kept], score[kept], rows[kept]
        lists.add(who[i], score, self.ids[rows])

    def search(self, query: np.ndarray, wanted: list[Best], allowed: np.ndarray) -> int:
        """Add all rows (of ``allowed``, a mask) that belong to ``wanted``; the number of scores computed is returned."""
        whole = [[LEAST if w.low == -np.inf else int(np.ceil(w.low)) for w in wanted], [MOST if w.high == np.inf else int(np.floor(w.high)) for w in wanted]]
        lists = Lists(max(w.k for w in wanted), *(np.array([x], np.int64) for x in whole))
        looked = self.find(Queries(query[None]), lists, np.zeros(1, np.int64), None, lambda _, rows: allowed[rows], len(self.ids))
        lists.settle()
        for l, w in enumerate(wanted):
            n = lists.count[0, l]
            scores, ids = np.r_[w.scores, lists.scores[0, l, :n]], np.r_[w.ids, lists.ids[0, l, :n]]
            order = ranked(np.zeros(len(ids), np.int64), scores, ids)[0][: w.k]
            w.scores, w.ids = scores[order], ids[order]
        return looked
