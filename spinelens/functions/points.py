"""Points, boxes and polygon geometry."""

from __future__ import annotations


def point(x: str, y: str) -> str:
    return f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))"


def let(value: str, name: str, body: str) -> str:
    """Bind ``value`` to ``name`` once for use inside higher-order functions, where Catalyst does
    not share common subexpressions."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def points_from_pairs(pairs: str) -> str:
    """``[[x, y], ...]`` as an array of points."""
    return f"transform({pairs}, pair -> {point('get(pair, 0)', 'get(pair, 1)')})"


def to_pixel(p: str, width: str = "image_width", height: str = "image_height") -> str:
    return point(f"{p}.x * {width}", f"{p}.y * {height}")


def midpoint(p: str, q: str) -> str:
    return point(f"({p}.x + {q}.x) / 2", f"({p}.y + {q}.y) / 2")


def vertex_mean(points: str) -> str:
    """Mean of the vertices (not the area centroid); NULL for an empty array."""
    total = (
        f"aggregate({points}, {point('0', '0')}, (acc, p) -> {point('acc.x + p.x', 'acc.y + p.y')},"
        f" acc -> {point(f'acc.x / size({points})', f'acc.y / size({points})')})"
    )
    return f"CASE WHEN size({points}) > 0 THEN {total} END"


def bounds(points: str) -> str:
    """Axis-aligned bounds of a point array."""
    return (
        f"named_struct('x_min', array_min({points}.x), 'y_min', array_min({points}.y),"
        f" 'x_max', array_max({points}.x), 'y_max', array_max({points}.y))"
    )


def bounds_to_norm_box(b: str, width: str, height: str) -> str:
    """Bounds in pixels -> centre and size as fractions of the image."""
    return (
        f"named_struct('cx', (({b}.x_min + {b}.x_max) / 2) / {width},"
        f" 'cy', (({b}.y_min + {b}.y_max) / 2) / {height},"
        f" 'w', ({b}.x_max - {b}.x_min) / {width}, 'h', ({b}.y_max - {b}.y_min) / {height})"
    )


def four_corners(points: str) -> str:
    """Four cross-shaped corners of a polygon, ordered by angle about the vertex mean.

    The first corner is the vertex farthest from the mean. Each further corner is the farthest unused
    vertex within 45 degrees of a quarter turn from the previous one, or, when there is none, the
    farthest unused vertex. Ties go to the smaller vertex index. The angular difference is
    ``min(d, 2*pi - d)`` with d up to 3*pi, so it can be negative and then counts as near; that
    is part of the definition.
    """
    by_distance = (
        f"sort_array(transform({points}, (p, i) -> named_struct("
        "'nd', -sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)), 'i', i,"
        " 'a', atan2(p.y - c.y, p.x - c.x), 'x', p.x, 'y', p.y)))"
    )
    near = (
        "get(filter(ranked, q -> NOT array_contains(acc.i, q.i) AND q.nd < 0 AND"
        " least(abs(q.a - target), 2 * pi() - abs(q.a - target)) <= pi() / 4), 0)"
    )
    farthest = "get(filter(ranked, q -> NOT array_contains(acc.i, q.i)), 0)"
    step = f"concat(acc, array(coalesce({let('element_at(acc, -1).a + pi() / 2', 'target', near)}, {farthest})))"
    picked = f"aggregate(sequence(1, 3), slice(ranked, 1, 1), (acc, turn) -> {step})"
    ranked = let(by_distance, "ranked", picked)
    corners = let(vertex_mean(points), "c", ranked)
    by_angle = (
        f"sort_array(transform({corners}, (q, k) ->"
        " named_struct('a', q.a, 'k', k, 'x', q.x, 'y', q.y)))"
    )
    return (
        f"CASE WHEN size({points}) >= 4 THEN"
        f" transform({by_angle}, q -> {point('q.x', 'q.y')}) END"
    )


def mean_of(pts: list[str]) -> str:
    n = len(pts)
    xs, ys = [" + ".join(f"{p}.{c}" for p in pts) for c in ("x", "y")]
    return point(f"({xs}) / {n}", f"({ys}) / {n}")


def plates(p0: str, p1: str, p2: str, p3: str, center: str) -> str:
    """Endplates from four points ordered top to bottom: within a plate the smaller x is posterior,
    on equal x the second point of the pair."""
    def anterior(a: str, b: str) -> str:
        return f"CASE WHEN {a}.x < {b}.x THEN {b} ELSE {a} END"

    def posterior(a: str, b: str) -> str:
        return f"CASE WHEN {a}.x < {b}.x THEN {a} ELSE {b} END"

    return (
        f"named_struct('upper_anterior', {anterior(p0, p1)}, 'upper_posterior', {posterior(p0, p1)},"
        f" 'lower_anterior', {anterior(p2, p3)}, 'lower_posterior', {posterior(p2, p3)},"
        f" 'center', {center})"
    )


def endplates(keypoints: str) -> str:
    """Upper and lower endplates of a four-point vertebra, as one expression.

    The two points with smaller y form the upper plate (equal y: input order). For whole tables use
    :func:`spinelens.operators.measurements.with_endplates`, which stays in generated code.
    """
    ordered = (
        f"transform(sort_array(transform({keypoints}, (p, i) ->"
        f" named_struct('y', p.y, 'i', i, 'x', p.x))), o -> {point('o.x', 'o.y')})"
    )
    ranked = [f"get(byheight, {i})" for i in range(4)]
    center = mean_of([f"get({keypoints}, {i})" for i in range(4)])
    split = let(ordered, "byheight", plates(*ranked, center))
    return f"CASE WHEN size({keypoints}) = 4 THEN {split} END"


def estimate_s1(l5: str) -> str:
    """S1 endplate midpoint, 1.2 L5 heights below the lower L5 endplate."""
    mid_y = f"(({l5}.lower_anterior.y + {l5}.lower_posterior.y) / 2)"
    upper_y = f"(({l5}.upper_anterior.y + {l5}.upper_posterior.y) / 2)"
    s1 = point(f"({l5}.lower_anterior.x + {l5}.lower_posterior.x) / 2",
               f"{mid_y} + abs({mid_y} - {upper_y}) * 1.2e0")
    return f"CASE WHEN {l5} IS NOT NULL THEN {s1} END"


def quad_edges(points: str) -> str:
    """Segments from each point to the next one, closing the outline."""
    return (
        f"transform({points}, (p, i) -> named_struct('edge', i, 'start', p,"
        f" 'stop', get({points}, (i + 1) % size({points}))))"
    )
