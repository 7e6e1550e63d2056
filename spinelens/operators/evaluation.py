"""Detector scores: precision, recall, AP50 and AP50-95 against true boxes.

Matching follows the published practice of the detector's training tool: every prediction points to
the true box of its image and class with the largest IoU, and a true box accepts the most confident
prediction that points to it. Ties go to the smaller index.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# IoU thresholds of AP50-95.
THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]

_KEYS = ["image_id", "class_id"]
_BOX = ["x1", "y1", "x2", "y2"]
_CELL = ["level_x", "cell_x", "level_y", "cell_y"]
# Width of a class of extents when boxes are matched: wider classes give fewer probes to move and more candidates a cell.
BASE = 16

_INSIDE = "x2 > x1 AND y2 > y1"
# Tiles are the unit of dealing; two tiles of one image and class that share a number are dealt together.
_TILE = ["level_x", "tile_x", "level_y", "tile_y"]
# Cells along the side of a tile, as a power of two.
TILE = 4


def _distinct(boxes: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Equal boxes once, with their first index and their number ``n``. Boxes without image or class take no part."""
    return boxes.where("image_id IS NOT NULL AND class_id IS NOT NULL").groupBy(*keys).agg(
        F.expr(f"min({index}) AS {index}"), F.expr("count(1) AS n"))


def _proper(distinct: DataFrame, *columns: str) -> DataFrame:
    """Boxes with an inside.

    Sides that mention the number of copies keep every condition on them, also those that Spark infers from a join,
    above the aggregate that counts. So all uses of the distinct boxes share its exchange and the input is read once.
    """
    return distinct.selectExpr(*_KEYS, *columns, *[f"CASE WHEN n > 0 THEN {c} END AS {c}" for c in _BOX]).where(
        _INSIDE)


def _level(size: str, base: int) -> str:
    return f"CAST(floor(log2({size}) / {log2(base)!r}D) AS INT)"


def _prediction_cells(predictions: DataFrame, base: int = 4) -> DataFrame:
    """Each box in the one cell of its classes of width and height."""
    return _proper(predictions, "det_idx", "confidence").selectExpr(
        *_KEYS, "det_idx", "confidence", *[f"{c} AS p_{c}" for c in _BOX],
        *[f"{_level(f'{a}2 - {a}1', base)} AS level_{a}" for a in "xy"],
    ).selectExpr(
        "*", *[f"CAST(floor((p_{a}1 + p_{a}2) / 2 / pow({base}e0, level_{a} + 1)) AS BIGINT) AS cell_{a}" for a in "xy"])


def _ranges(boxes: DataFrame, threshold: float, base: int, true: str = "true") -> DataFrame:
    """A row per box and pair of classes of extents that may hold a partner, with the cells from ``first_`` to ``last_`` of both axes,
    the box's own cell among them (``home_``) and whether an axis has one class (``single_``).

    Rows that ``true`` does not hold for are predictions, which only have their own cell; boxes without an inside have no cell.
    """
    t, wide = f"{threshold!r}D", "1.000001e0"
    rows = boxes.selectExpr("*", *[f"CASE WHEN {_INSIDE} THEN {a}2 - {a}1 END AS size_{a}" for a in "xy"])
    for a in "xy":
        least, most = (_level(f"size_{a}{f}", base) for f in (f" * {t} / {wide}", f" / {t} * {wide}"))
        rows = rows.selectExpr("*", f"{_level(f'size_{a}', base)} AS own_{a}").selectExpr(
            "*", f"CASE WHEN {true} THEN sequence({least}, {most}) ELSE sequence(own_{a}, own_{a}) END AS levels_{a}",
        ).selectExpr("*", f"explode_outer(levels_{a}) AS level_{a}")
    rows = rows.selectExpr("*", *[
        e for a in "xy" for e in (f"pow({base}e0, level_{a}) AS low_{a}", f"pow({base}e0, level_{a} + 1) AS side_{a}")])
    least = " * ".join(f"greatest(low_{a}, size_{a} * {t})" for a in "xy")
    most = " * ".join(f"least(side_{a}, size_{a} / {t})" for a in "xy")
    rows = rows.filter(
        f"size_x IS NULL OR NOT {true} OR"
        f" {least} * {t} <= size_x * size_y * {wide} AND {most} * {wide} >= size_x * size_y * {t}")
    for a in "xy":
        # the extent of the class at which the distance may be largest
        at = (f"least(greatest(size_{a}, low_{a}), side_{a})" if threshold >= 0.5
              else f"least(side_{a}, size_{a} / {t})")
        rows = rows.selectExpr(
            "*", f"CASE WHEN {true} THEN (({at} + size_{a}) / 2 - {t} * greatest({at}, size_{a})) * {wide} + 1e-6 * size_{a} ELSE 0e0 END AS reach_{a}",
            f"({a}1 + {a}2) / 2 AS centre_{a}",
        ).selectExpr(
            "*", *[f"CAST(floor((centre_{a} {sign} reach_{a}) / side_{a}) AS BIGINT) AS {end}_{a}" for sign, end in (("-", "first"), ("+", "last"))],
            f"CASE WHEN level_{a} = own_{a} THEN CAST(floor(centre_{a} / side_{a}) AS BIGINT) END AS home_{a}", f"size(levels_{a}) = 1 AS single_{a}")
    return rows


def _tiled(*columns: str) -> str:
    return f"hash({', '.join(columns)})"


def truth_probes(truth: DataFrame, threshold: float = 0.5, base: int = 4, tiles: bool = False) -> DataFrame:
    """Each true box once per cell that may hold a prediction with IoU >= ``threshold``: at 0.5 about nine times for
    base 4, four times for base 16.

    ``truth``: image_id, class_id, x1..y2, truth_idx, n. On either axis IoU >= t asks that the extents p and s keep a ratio
    of at least t and the centres a distance of at most (p + s) / 2 - t * max(p, s); the areas keep the ratio, too.
    A class of extents reaches from a power of ``base`` to the next one, which is the side of its cells: an axis has one
    or two classes to probe, and pairs of classes whose areas do not fit are left out. Boxes without overlap number at
    most ``base`` squared a cell, so candidates grow with the boxes, not with their square. Bounds are slightly widened, which
    keeps pairs at the very edge of the threshold.

    With ``tiles``, each box, also one without an inside, comes once per tile of ``1 << TILE`` cells a side, with the number
    ``place`` of the tile and ``mark``: 2 in the tile that the box itself lies in, else 1; ``n`` is not asked for.
    """
    if tiles:
        rows = _ranges(truth, threshold, base)
        for a in "xy":
            rows = rows.selectExpr("*", f"explode_outer(sequence(shiftright(first_{a}, {TILE}), shiftright(last_{a}, {TILE}))) AS tile_{a}")
        home = " AND ".join(f"tile_{a} = shiftright(home_{a}, {TILE})" for a in "xy")
        return rows.selectExpr(
            *_KEYS, "truth_idx", *_BOX, f"{_tiled(*_TILE)} AS place",
            f"CAST(CASE WHEN size_x IS NULL OR coalesce({home}, false) THEN 2 ELSE 1 END AS TINYINT) AS mark")
    rows = _ranges(_proper(truth, "truth_idx"), threshold, base)
    for a in "xy":
        rows = rows.selectExpr("*", f"explode(sequence(first_{a}, last_{a})) AS cell_{a}")
    return rows.selectExpr(*_KEYS, "truth_idx", *[f"{c} AS t_{c}" for c in _BOX], *_CELL)


def _tiles(predictions: DataFrame, truth: DataFrame, threshold: float, base: int) -> DataFrame:
    """Predictions and true boxes dealt once, by image, class and tile; there equal boxes become one, with their first index ``idx``
    and their number ``n`` (true boxes: in the tile they lie in, else 0)."""
    some = "image_id IS NOT NULL AND class_id IS NOT NULL"
    own = _ranges(predictions.where(some), threshold, base, "false").selectExpr(
        *_KEYS, "det_idx AS idx", "confidence", *_BOX,
        f"{_tiled('level_x', f'shiftright(first_x, {TILE})', 'level_y', f'shiftright(first_y, {TILE})')} AS place", "CAST(0 AS TINYINT) AS mark")
    probes = truth_probes(truth.where(some), threshold, base, True).selectExpr(
        *_KEYS, "truth_idx AS idx", "CAST(NULL AS DOUBLE) AS confidence", *_BOX, "place", "mark")
    return own.unionByName(probes).repartition(*_KEYS, "place").selectExpr("*", "mark > 0 AS is_true").groupBy(
        *_KEYS, "place", "is_true", *_BOX, "confidence").agg(
        F.expr("min(idx) AS idx"), F.expr("sum(CASE WHEN mark = 1 THEN 0L ELSE 1L END) AS n"))


def _pointing(predictions: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """Per tile its distinct boxes: predictions with the true box ``best`` (worse: minus IoU, truth_idx, alone) they point to, true
    boxes in the cells where predictions look for them, ``home`` in one of them. ``alone``: no other tile has such predictions.

    A prediction lies in one cell, so what it may point to is gathered there; no row leaves its tile.
    """
    rows = _ranges(_tiles(predictions, truth, threshold, BASE), threshold, BASE, "is_true")
    for a in "xy":
        rows = rows.selectExpr("*", f"explode_outer(sequence(first_{a}, last_{a})) AS cell_{a}")
    here = _tiled("level_x", f"shiftright(cell_x, {TILE})", "level_y", f"shiftright(cell_y, {TILE})")
    home = " AND ".join(f"cell_{a} = home_{a}" for a in "xy")
    alone = " AND ".join(f"single_{a} AND shiftright(first_{a}, {TILE}) = shiftright(last_{a}, {TILE})" for a in "xy")
    rows = rows.where(f"place = {here}").selectExpr(
        *_KEYS, "place", "is_true", "idx", "confidence", "n", *_BOX, f"{_tiled(*_CELL)} AS cell", "size_x IS NOT NULL AS inside",
        f"size_x IS NULL OR coalesce({home}, false) AS home", f"coalesce({alone}, true) AS alone")
    cell = Window.partitionBy(*_KEYS, "place", "cell")
    near = F.collect_list(F.expr(f"CASE WHEN is_true AND inside THEN struct(idx, {', '.join(_BOX)}, alone) END")).over(cell)
    overlap = ("greatest(0e0, least(x2, t.x2) - greatest(x1, t.x1)) * greatest(0e0, least(y2, t.y2) - greatest(y1, t.y1))")
    met = f"transform(near, t -> struct(t.idx, t.alone, {overlap} AS o, (x2 - x1) * (y2 - y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS areas))"
    scored = f"transform({met}, m -> struct(-(m.o / (m.areas - m.o)) AS worse, m.idx AS truth_idx, m.alone))"
    return rows.withColumn("near", near).selectExpr(
        *_KEYS, "place", "is_true", "idx", "confidence", "n", "home", "alone",
        f"CASE WHEN NOT is_true AND inside AND size(near) > 0 THEN array_min(filter({scored}, m -> m.worse <= -{threshold!r}D)) END AS best")


def best_truth(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """For every distinct prediction box the true box it points to, where IoU >= ``threshold``.

    ``predictions``: image_id, class_id, x1..y2, det_idx, confidence; ``truth``: image_id, class_id,
    x1..y2, truth_idx. Copies of a true box have the same IoU, so all predictions point to the first of them, and of equal
    predictions only the first can be accepted: copies meet in a tile and are reduced there.
    Candidates come from a grid (``truth_probes``), so boxes side by side in one image do not meet.
    """
    return _pointing(predictions, truth, threshold).where("best IS NOT NULL").selectExpr(
        *_KEYS, "idx AS det_idx", "confidence", "best.truth_idx AS truth_idx", "-best.worse AS iou")


def match_detections(
    predictions: DataFrame, truth: DataFrame, threshold: float = 0.5
) -> DataFrame:
    """Accepted pairs at one IoU threshold."""
    first = Window.partitionBy(*_KEYS, "truth_idx").orderBy(F.desc("confidence"), "det_idx")
    pointing = best_truth(predictions, truth, threshold)
    return pointing.withColumn("place", F.row_number().over(first)).where("place = 1").select(
        *_KEYS, "truth_idx", "det_idx", "confidence", "iou")


def _levels(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Per class and confidence: predictions ``n`` and, per IoU threshold, accepted ones ``tp0``..; true boxes of a class
    at confidence -1.

    Each input is read and moved once: its boxes are matched and counted where they were dealt to. A true box keeps, per
    threshold, the highest confidence that points to it. What one tile knows is summed by confidence at once; only true boxes
    with predictions in several tiles are moved again.
    """
    steps = range(len(THRESHOLDS))
    # a prediction that points to a box is told to the box and counted at its confidence
    told = _pointing(predictions, truth, THRESHOLDS[0]).selectExpr(
        "*", "explode(CASE WHEN is_true THEN IF(home, array(0), array()) WHEN best IS NULL THEN array(1) ELSE array(1, 2) END) AS kind",
    ).selectExpr(
        *_KEYS, "place", "CASE kind WHEN 0 THEN idx WHEN 2 THEN best.truth_idx END AS truth_idx",
        "CASE kind WHEN 0 THEN alone WHEN 1 THEN false ELSE best.alone END AS alone", "CASE WHEN kind = 1 THEN confidence END AS level",
        "CASE WHEN kind = 1 THEN n ELSE 0L END AS n", "CASE WHEN kind = 0 THEN n ELSE 0L END AS n_truth",
        "CASE WHEN kind = 2 THEN confidence END AS confidence", "CASE WHEN kind = 2 THEN -best.worse END AS iou")
    local = told.groupBy(*_KEYS, "place", "truth_idx", "alone", "level").agg(
        F.expr("sum(n) AS n"), F.expr("sum(n_truth) AS n_truth"),
        *[F.expr(f"max(CASE WHEN iou >= {t!r}D THEN confidence END) AS c{i}") for i, t in enumerate(THRESHOLDS)])
    given = f"array_distinct(filter(array({', '.join(f'c{i}' for i in steps)}), c -> c IS NOT NULL))"
    # kind 0: predictions at a confidence, 1: boxes of a class, 2: accepted at a confidence, 3: to be completed from other tiles
    parts = local.selectExpr(
        *_KEYS, "truth_idx", "n", "n_truth", *[f"c{i}" for i in steps],
        "explode(concat(CASE WHEN n > 0 THEN array(named_struct('kind', 0, 'level', level)) ELSE array() END,"
        " CASE WHEN n_truth > 0 THEN array(named_struct('kind', 1, 'level', -1e0)) ELSE array() END,"
        f" CASE WHEN c0 IS NULL THEN array() WHEN alone THEN transform({given}, c -> named_struct('kind', 2, 'level', c))"
        " ELSE array(named_struct('kind', 3, 'level', CAST(NULL AS DOUBLE))) END)) AS x",
    ).selectExpr(
        "CASE WHEN x.kind = 3 THEN image_id END AS image_id", "class_id", "CASE WHEN x.kind = 3 THEN truth_idx END AS truth_idx",
        "x.kind = 3 AS open", "x.level AS level", "CASE WHEN x.kind = 0 THEN n ELSE 0L END AS n",
        "CASE WHEN x.kind = 1 THEN n_truth ELSE 0L END AS n_truth",
        *[f"CASE WHEN x.kind = 2 AND c{i} = x.level THEN 1L ELSE 0L END AS tp{i}" for i in steps],
        *[f"CASE WHEN x.kind = 3 THEN c{i} END AS c{i}" for i in steps])
    known = parts.groupBy(*_KEYS, "truth_idx", "open", "level").agg(
        F.expr("sum(n) AS n"), F.expr("sum(n_truth) AS n_truth"), *[F.expr(f"sum(tp{i}) AS tp{i}") for i in steps],
        *[F.expr(f"max(c{i}) AS c{i}") for i in steps])
    return known.selectExpr(
        "class_id", "open", "n", "n_truth", *[f"{c}{i}" for i in steps for c in ("tp", "c")],
        f"explode(CASE WHEN open THEN {given} ELSE array(level) END) AS confidence",
    ).selectExpr("class_id", "confidence", "n", "n_truth", *[
        f"CASE WHEN NOT open THEN tp{i} WHEN c{i} = confidence THEN 1L ELSE 0L END AS tp{i}" for i in steps],
    ).groupBy("class_id", "confidence").agg(*[
        F.expr(f"sum({c}) AS {c}") for c in ("n", *[f"tp{i}" for i in steps], "n_truth")])


def evaluate_by_class(predictions: DataFrame, truth: DataFrame, buckets: int = 256) -> DataFrame:
    """Per class of the truth: precision and recall at the best F1 (IoU 0.5), AP50, AP50-95.

    AP is the area under the interpolated curve: each recall step times the largest precision at this
    or any higher recall. Predictions of equal confidence enter the curve together.

    Each threshold is a ``step`` of its own. Rows are dealt by class, step and bucket of confidence; running sums and
    running maxima of a bucket are completed by those of the buckets before and behind it.
    """
    steps = range(len(THRESHOLDS))
    key, parts = ["class_id", "step"], ["class_id", "step", "bucket"]
    rows = _levels(predictions, truth).selectExpr(
        "class_id", f"CAST(floor(CASE WHEN n >= 0 THEN confidence END * {buckets}) AS INT) AS bucket", "confidence", "n",
        "n_truth", f"posexplode(array({', '.join(f'tp{i}' for i in steps)})) AS (step, tp)",
    ).where("bucket IS NOT NULL")  # said here, as one side of a join would infer it alone
    from_top = Window.partitionBy(*parts).orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", F.sum("n").over(from_top).alias("cum_n"), F.sum("tp").over(from_top).alias("cum_tp"))
    totals = local.groupBy(*parts).agg(
        F.max("cum_n").alias("all_n"), F.max("cum_tp").alias("all_tp"), F.sum("n_truth").alias("own_truth"))
    above = Window.partitionBy(*key).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *parts, *[F.coalesce(F.sum(f"all_{c}").over(above), F.lit(0)).alias(f"before_{c}") for c in ("n", "tp")],
        F.sum("own_truth").over(Window.partitionBy(*key)).alias("of_class"))
    # the own count is asked for only so that both uses of ``local`` have the same columns
    curve = local.join(before, parts).where("of_class > 0 AND n_truth >= 0").selectExpr(
        *parts, "confidence", "of_class", "tp",
        "2e0 * (cum_tp + before_tp) / (cum_n + before_n + of_class) AS f1",
        "CAST(cum_tp + before_tp AS DOUBLE) / of_class AS recall",
        "CASE WHEN tp > 0 THEN CAST(cum_tp + before_tp AS DOUBLE) / (cum_n + before_n) END AS precision")
    from_bottom = Window.partitionBy(*parts).orderBy("confidence").rowsBetween(Window.unboundedPreceding, 0)
    enveloped = curve.withColumn("top", F.max("precision").over(from_bottom))
    best = ("max(CASE WHEN step = 0 AND tp > 0 THEN"
            " named_struct('f1', f1, 'confidence', confidence, 'p', precision, 'r', recall) END) AS at")
    # equal maxima of a bucket are one row from here on
    tops = enveloped.groupBy(*parts, "top").agg(
        F.expr("sum(tp) AS tp"), F.expr("max(of_class) AS n_truth"), F.expr(best))
    behind = tops.groupBy(*parts).agg(F.max("top").alias("top")).select(
        *parts, F.max("top").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("behind"))
    return tops.join(behind, parts).groupBy("class_id").agg(
        F.expr("max(n_truth) AS n_truth"), F.expr("max(at) AS at"),
        F.expr("coalesce(sum(CASE WHEN step = 0 THEN tp * greatest(top, behind) END), 0e0) AS area50"),
        F.expr("coalesce(sum(tp * greatest(top, behind)), 0e0) AS area"),
    ).selectExpr(
        "class_id", "n_truth", "coalesce(at.p, 0e0) AS precision", "coalesce(at.r, 0e0) AS recall",
        "area50 / n_truth AS ap50", f"area / n_truth / {len(THRESHOLDS)} AS ap50_95")


def evaluate_detections(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """The four scores of a run: means over the classes of the truth."""
    return evaluate_by_class(predictions, truth).agg(
        F.expr("avg(precision) AS precision"), F.expr("avg(recall) AS recall"),
        F.expr("avg(ap50) AS ap50"), F.expr("avg(ap50_95) AS ap50_95"))
