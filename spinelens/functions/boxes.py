"""Box arithmetic of the point and box label builds."""

from __future__ import annotations

from spinelens import vocab


def fixed_box(x: str, y: str, width: str, height: str, size: int = vocab.POINT_BOX_PX) -> str:
    """Bounds of a fixed-size box about a point, cut at the image border before its centre and
    size are taken. A point far outside the image gives a negative size."""
    half = size / 2
    return (
        f"named_struct('x_min', greatest(0e0, {x} - {half}D), 'y_min', greatest(0e0, {y} - {half}D),"
        f" 'x_max', least(CAST({width} AS DOUBLE), {x} + {half}D),"
        f" 'y_max', least(CAST({height} AS DOUBLE), {y} + {half}D))"
    )


def default_side(width: str, height: str) -> str:
    """Box side without reference shapes: 6 % of the width or 4 % of the height."""
    return f"greatest(CAST({width} * 0.06e0 AS INT), CAST({height} * 0.04e0 AS INT))"


def adaptive_side(
    avg_height: str, width: str, height: str, multiplier: float = vocab.BOX_MULTIPLIER
) -> str:
    """Box side from the mean reference height, or the default where there is none."""
    return (
        f"CASE WHEN {avg_height} IS NULL THEN {default_side(width, height)}"
        f" ELSE CAST({avg_height} * {multiplier!r}D AS INT) END"
    )


def blended_side(avg_height: str, width: str, height: str) -> str:
    """Mean of the default and the 1.8-fold reference height per axis, the larger one."""
    ref = f"CAST({avg_height} * 1.8e0 AS INT)"
    per_axis = [
        f"CAST((CAST({extent} AS INT) + {ref}) / 2 AS INT)"
        for extent in (f"{width} * 0.06e0", f"{height} * 0.04e0")
    ]
    return (
        f"CASE WHEN {avg_height} IS NULL THEN {default_side(width, height)}"
        f" ELSE greatest({per_axis[0]}, {per_axis[1]}) END"
    )


def clamp01(value: str) -> str:
    """Value cut to [0, 1]; NULL stays NULL (greatest/least skip NULLs)."""
    return f"CASE WHEN {value} IS NOT NULL THEN greatest(0e0, least(1e0, {value})) END"


def point_to_norm_box(x: str, y: str, side: str, width: str, height: str) -> str:
    """Normalised square box about a point, each of its four values cut to [0, 1] on its own."""
    return (
        f"named_struct('cx', {clamp01(f'({x} / {width})')}, 'cy', {clamp01(f'({y} / {height})')},"
        f" 'w', {clamp01(f'({side} / {width})')}, 'h', {clamp01(f'({side} / {height})')})"
    )


def pixel_corner(center: str, size: str, extent: str) -> tuple[str, str]:
    """Pixel interval of a normalised centre and size, truncated twice like integer drawing."""
    c, s = f"CAST({center} * {extent} AS INT)", f"CAST({size} * {extent} AS INT)"
    return f"CAST({c} - {s} / 2 AS INT)", f"CAST({c} + {s} / 2 AS INT)"
