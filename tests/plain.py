"""Row-at-a-time formulas in plain Python, the tests' own yardstick."""

from __future__ import annotations

import math


def mean(points):
    return sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)


def corners(points):
    cx, cy = mean(points)
    dist = [math.sqrt((x - cx) ** 2 + (y - cy) ** 2) for x, y in points]
    ang = [math.atan2(y - cy, x - cx) for x, y in points]
    by_distance = sorted(range(len(points)), key=lambda i: (-dist[i], i))
    chosen = [by_distance[0]]
    while len(chosen) < 4:
        target = ang[chosen[-1]] + math.pi / 2
        free = [i for i in by_distance if i not in chosen]

        def near(i):
            d = abs(ang[i] - target)
            return min(d, 2 * math.pi - d) <= math.pi / 4

        chosen.append(next((i for i in free if dist[i] > 0 and near(i)), free[0]))
    return [points[i] for i in sorted(chosen, key=lambda i: ang[i])]


def plates(quad):
    order = sorted(range(4), key=lambda i: quad[i][1])

    def pair(i, j):
        a, b = quad[order[i]], quad[order[j]]
        return (b, a) if a[0] < b[0] else (a, b)

    return {"u": pair(0, 1), "l": pair(2, 3), "c": mean(quad)}


def acute(p, q):
    return math.degrees(math.atan2(abs(q[1] - p[1]), abs(q[0] - p[0])))


def direction(p, q):
    return abs(math.degrees(math.atan2(q[1] - p[1], q[0] - p[0])))


def between(v1, v2):
    cos = (v1[0] * v2[0] + v1[1] * v2[1]) / (math.hypot(*v1) * math.hypot(*v2) + 1e-10)
    return math.degrees(math.acos(max(-1.0, min(1.0, cos))))


def sub(p, q):
    return p[0] - q[0], p[1] - q[1]


def s1_of(l5):
    (ax, ay), (bx, by) = l5["l"]
    mid = (ay + by) / 2
    upper = (l5["u"][0][1] + l5["u"][1][1]) / 2
    return (ax + bx) / 2, mid + abs(mid - upper) * 1.2


def normalised_metrics(quads, head):
    """The normalised calculator from ``label -> quad`` and an optional femoral-head centre."""
    v = {k: plates(q) for k, q in quads.items()}
    s1 = s1_of(v["L5"]) if "L5" in v else None
    out = {}

    def slope(label, side):
        ant, post = v[label][side]
        return direction(post, ant)

    def lines(a, b):
        (aa, ap), (ba, bp) = v[a]["u"], v[b]["l"]
        return between(sub(aa, ap), sub(ba, bp))

    if "T1" in v:
        out["T1_slope"] = slope("T1", "u")
    if "C7" in v:
        out["cervical_lordosis"] = slope("C7", "l")
    if "T2" in v and "T5" in v:
        out["thoracic_kyphosis_T2_T5"] = lines("T2", "T5")
    if "T5" in v and "T12" in v:
        out["thoracic_kyphosis_T5_T12"] = lines("T5", "T12")
    if "L1" in v and s1:
        out["lumbar_lordosis"] = slope("L1", "u")
    if "T1" in v and head and s1:
        out["T1_pelvic_angle"] = between(sub(v["T1"]["c"], head), sub(s1, head))
    if "C7" in v and s1:
        out["SVA"] = abs(v["C7"]["u"][1][0] - s1[0])
    if head and s1:
        out["pelvic_incidence"] = between((0, 1), sub(s1, head))
        dx, dy = sub(s1, head)
        out["pelvic_tilt"] = math.degrees(math.atan2(abs(dx), abs(dy)))
    if "L5" in v:
        out["sacral_slope"] = slope("L5", "l")
    return out
