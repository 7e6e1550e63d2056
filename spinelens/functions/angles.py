"""Angles between points and lines, in degrees."""

from __future__ import annotations

EPSILON = "1e-10"  # keeps the cosine defined for zero-length vectors


def acute_to_horizontal(p: str, q: str) -> str:
    """Unsigned slope of a segment, 0 to 90."""
    return f"degrees(atan2(abs({q}.y - {p}.y), abs({q}.x - {p}.x)))"


def direction_to_horizontal(p: str, q: str) -> str:
    """Unsigned direction of a segment, 0 to 180."""
    return f"abs(degrees(atan2({q}.y - {p}.y, {q}.x - {p}.x)))"


def _arccos_degrees(cosine: str) -> str:
    # greatest/least skip NULLs, so a missing point has to be kept out of them.
    return (
        f"CASE WHEN ({cosine}) IS NOT NULL THEN"
        f" degrees(acos(greatest(-1e0, least(1e0, {cosine})))) END"
    )


def _between(ax: str, ay: str, bx: str, by: str) -> str:
    norms = (
        f"(sqrt(({ax}) * ({ax}) + ({ay}) * ({ay})) * sqrt(({bx}) * ({bx}) + ({by}) * ({by}))"
        f" + {EPSILON})"
    )
    return _arccos_degrees(f"(({ax}) * ({bx}) + ({ay}) * ({by})) / {norms}")


def between_lines(p1: str, p2: str, p3: str, p4: str) -> str:
    return _between(f"{p2}.x - {p1}.x", f"{p2}.y - {p1}.y", f"{p4}.x - {p3}.x", f"{p4}.y - {p3}.y")


def three_point(p1: str, vertex: str, p3: str) -> str:
    return _between(
        f"{p1}.x - {vertex}.x", f"{p1}.y - {vertex}.y", f"{p3}.x - {vertex}.x", f"{p3}.y - {vertex}.y"
    )


def to_vertical(p: str, q: str) -> str:
    """Angle of p -> q with the direction (0, 1)."""
    dx, dy = f"({q}.x - {p}.x)", f"({q}.y - {p}.y)"
    return _arccos_degrees(f"{dy} / (sqrt({dx} * {dx} + {dy} * {dy}) + {EPSILON})")
