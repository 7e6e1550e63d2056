"""DuckDB SQL of the registered queries, over the same tables.

Written on windows and joins where the Spark side uses aggregates and array functions, so that the
two do not share a method.
"""

from __future__ import annotations

from spinelens import vocab

ORACLES: dict[str, str] = {}


def _scaled(expression: str, factor: str = "1e6") -> str:
    return f"CAST(floor(({expression}) * {factor} + 0.5e0) AS BIGINT)"


def _names(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --- detections of lineitem ---------------------------------------------------------------------

_DET = """
det AS (
  SELECT l_orderkey // 4 AS image_id,
         (l_orderkey % 4) * 1000000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS det_idx,
         l_partkey, l_suppkey, l_linenumber,
         ['C7','T1','T2','T5','T12','L1','L4','L5','C2','T3'][CAST(l_partkey % 10 AS INT) + 1] AS label,
         0.1e0 + 0.8e0 * ((l_partkey * 7919) % 1000) / 1000e0 AS cx,
         0.1e0 + 0.8e0 * ((l_suppkey * 104729 + l_linenumber * 31) % 1000) / 1000e0 AS cy,
         0.01e0 + 0.0004e0 * l_quantity AS hw, 0.01e0 + 0.1e0 * l_tax AS hh,
         0.05e0 * (l_discount - 0.05e0) AS t,
         0.1e0 + 0.9e0 * ((l_partkey + l_suppkey) % 97) / 96e0 AS confidence,
         1500 + 100 * ((l_orderkey // 4) % 7) AS img_w, 3000 + 100 * ((l_orderkey // 4) % 5) AS img_h
  FROM lineitem)"""

_CORNERS = """
corners AS (
  SELECT image_id, det_idx, label, i,
         CASE i WHEN 0 THEN cx - hw WHEN 1 THEN cx + hw WHEN 2 THEN cx + hw ELSE cx - hw END AS x,
         CASE i WHEN 0 THEN cy - hh + t WHEN 1 THEN cy - hh - t WHEN 2 THEN cy + hh - t ELSE cy + hh + t END AS y
  FROM det, range(4) AS r(i))"""


def _plates(source: str, keys: str) -> str:
    """Endplates of four corner rows per key: rank by height, then compare x inside each pair."""
    return f"""
by_height AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY y, i) AS r FROM {source}),
quads AS (
  SELECT {keys},
         {', '.join(f'max({c}) FILTER (WHERE r = {r}) AS {c}{r}' for r in (1, 2, 3, 4) for c in 'xy')},
         {', '.join(f'max({c}) FILTER (WHERE i = {i}) AS k{c}{i}' for i in range(4) for c in 'xy')}
  FROM by_height GROUP BY {keys}),
plates AS (
  SELECT {keys},
         CASE WHEN x1 < x2 THEN x2 ELSE x1 END AS uax, CASE WHEN x1 < x2 THEN y2 ELSE y1 END AS uay,
         CASE WHEN x1 < x2 THEN x1 ELSE x2 END AS upx, CASE WHEN x1 < x2 THEN y1 ELSE y2 END AS upy,
         CASE WHEN x3 < x4 THEN x4 ELSE x3 END AS lax, CASE WHEN x3 < x4 THEN y4 ELSE y3 END AS lay,
         CASE WHEN x3 < x4 THEN x3 ELSE x4 END AS lpx, CASE WHEN x3 < x4 THEN y3 ELSE y4 END AS lpy,
         (kx0 + kx1 + kx2 + kx3) / 4 AS mx, (ky0 + ky1 + ky2 + ky3) / 4 AS my
  FROM quads)"""


_PLATE_FIELDS = ["uax", "uay", "upx", "upy", "lax", "lay", "lpx", "lpy", "mx", "my"]
_PIVOT = ",\n".join(
    f"max({f}) FILTER (WHERE label = '{name}') AS {name}_{f}"
    for name in vocab.MEASURED_LABELS for f in _PLATE_FIELDS)

_SPINE = f"""WITH {_DET}, {_CORNERS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY det_idx DESC) AS latest FROM det),
kept AS (
  SELECT c.* FROM corners c JOIN ranked USING (image_id, det_idx, label) WHERE latest = 1),
{_plates('kept', 'image_id, label')},
heads AS (
  SELECT image_id, cx AS head_x, cy AS head_y FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_idx) AS first FROM det WHERE l_partkey % 13 = 0)
  WHERE first = 1),
sizes AS (SELECT DISTINCT image_id, img_w, img_h FROM det),
spine AS (
  SELECT s.image_id, any_value(s.img_w) AS w, any_value(s.img_h) AS h,
         any_value(head_x) AS head_x, any_value(head_y) AS head_y, {_PIVOT}
  FROM sizes s LEFT JOIN plates USING (image_id) LEFT JOIN heads USING (image_id)
  GROUP BY s.image_id)"""


def _px(name: str, part: str) -> tuple[str, str]:
    return f"({name}_{part}x * w)", f"({name}_{part}y * h)"


def _acute(p: tuple[str, str], q: tuple[str, str]) -> str:
    return f"degrees(atan2(abs({q[1]} - {p[1]}), abs({q[0]} - {p[0]})))"


def _three(p, v, q) -> str:
    ax, ay, bx, by = f"({p[0]} - {v[0]})", f"({p[1]} - {v[1]})", f"({q[0]} - {v[0]})", f"({q[1]} - {v[1]})"
    return _angle(ax, ay, bx, by)


def _angle(ax: str, ay: str, bx: str, by: str) -> str:
    cos = (f"({ax} * {bx} + {ay} * {by}) / (sqrt({ax} * {ax} + {ay} * {ay})"
           f" * sqrt({bx} * {bx} + {by} * {by}) + 1e-10)")
    return (f"CASE WHEN {cos} IS NULL THEN NULL WHEN {cos} > 1 THEN degrees(acos(1e0))"
            f" WHEN {cos} < -1 THEN degrees(acos(-1e0)) ELSE degrees(acos({cos})) END")


def _points_of() -> dict[str, list[tuple[str, str]]]:
    def plate(n, side):
        return [_px(n, side + "a"), _px(n, side + "p")]

    head = ("(head_x * w)", "(head_y * h)")
    mid_y = "((L5_lay + L5_lpy) / 2)"
    s1 = ("(((L5_lax + L5_lpx) / 2) * w)",
          f"(({mid_y} + abs({mid_y} - ((L5_uay + L5_upy) / 2)) * 1.2e0) * h)")
    pelvis = [head, *plate("L5", "l")]
    return {
        "T1 Slope": plate("T1", "u"), "C2-C7 CL": plate("C2", "l") + plate("C7", "l"),
        "TK T2-T5": plate("T2", "u") + plate("T5", "l"), "TK T5-T12": plate("T5", "u") + plate("T12", "l"),
        "LL L1-S1": plate("L1", "u") + plate("L5", "l"), "LL L1-L4": plate("L1", "u") + plate("L4", "l"),
        "LL L4-S1": plate("L4", "u") + plate("L5", "l"), "SVA": [_px("C7", "up"), s1],
        "TPA": plate("T1", "u") + plate("T1", "l") + pelvis, "PI": pelvis, "PT": pelvis,
        "SS": plate("L5", "l"),
    }


def _metric_sql(points: dict[str, list[tuple[str, str]]]) -> dict[str, str]:
    """Formulas from points; a missing point makes the value NULL."""
    def diff(t):
        p = points[t]
        return f"abs({_acute(p[0], p[1])} - {_acute(p[2], p[3])})"

    def mid(p, q):
        return f"(({p[0]} + {q[0]}) / 2)", f"(({p[1]} + {q[1]}) / 2)"

    tpa, pi, pt = points["TPA"], points["PI"], points["PT"]
    t1 = (f"(({' + '.join(p[0] for p in tpa[:4])}) / 4)", f"(({' + '.join(p[1] for p in tpa[:4])}) / 4)")
    s_pi, s_pt = mid(pi[1], pi[2]), mid(pt[1], pt[2])
    sva = points["SVA"]
    return {
        "T1_Slope": _acute(*points["T1 Slope"][:2]),
        "Cervical_Lordosis": diff("C2-C7 CL"),
        "Thoracic_Kyphosis_T2_T5": diff("TK T2-T5"),
        "Thoracic_Kyphosis_T5_T12": diff("TK T5-T12"),
        "Lumbar_Lordosis": diff("LL L1-S1"),
        "Lumbar_Lordosis_L1_L4": diff("LL L1-L4"),
        "Lumbar_Lordosis_L4_S1": diff("LL L4-S1"),
        "SVA": f"abs({sva[0][0]} - {sva[1][0]})",
        "TPA": _three(t1, tpa[4], mid(tpa[5], tpa[6])),
        "PI": f"abs({_acute(pi[1], pi[2])} + 90 - degrees(atan2({s_pi[1]} - {pi[0][1]}, {s_pi[0]} - {pi[0][0]})))",
        "PT": f"abs(90 - degrees(atan2({s_pt[0]} - {pt[0][0]}, {s_pt[1]} - {pt[0][1]})))",
        "SS": _acute(*points["SS"][:2]),
    }


_METRICS = _metric_sql(_points_of())
_WIDE = f"{_SPINE}, wide AS (SELECT image_id, {', '.join(f'{v} AS {k}' for k, v in _METRICS.items())} FROM spine)"

ORACLES["metrics_wide"] = (
    f"{_WIDE} SELECT image_id, {', '.join(f'{_scaled(m, "1e4")} AS {m}' for m in vocab.METRICS)} FROM wide"
)
ORACLES["metrics_long"] = f"{_WIDE} " + " UNION ALL ".join(
    f"SELECT image_id, '{m}' AS metric, {_scaled(m, '1e4')} AS value FROM wide WHERE {m} IS NOT NULL"
    for m in vocab.METRICS)
ORACLES["measurements_long"] = f"{_SPINE} SELECT image_id, CAST(ord AS INT) AS ord, type, CAST(point_no AS INT) AS point_no, {_scaled('x')} AS x, {_scaled('y')} AS y FROM (" + " UNION ALL ".join(
    f"SELECT image_id, {i} AS ord, '{t}' AS type, {k} AS point_no, {p[0]} AS x, {p[1]} AS y FROM spine"
    f" WHERE {' AND '.join(f'{q[0]} IS NOT NULL' for q in pts)}"
    for i, (t, pts) in enumerate(_points_of().items(), start=1) for k, p in enumerate(pts)) + ")"


def _direction(n: str, side: str) -> str:
    return f"abs(degrees(atan2({n}_{side}ay - {n}_{side}py, {n}_{side}ax - {n}_{side}px)))"


def _lines(n1: str, s1: str, n2: str, s2: str) -> str:
    return _angle(*[f"({n}_{s}a{c} - {n}_{s}p{c})" for n, s in ((n1, s1), (n2, s2)) for c in "xy"])


_NORMALISED = {
    "T1_slope": _direction("T1", "u"),
    "cervical_lordosis": _direction("C7", "l"),
    "thoracic_kyphosis_T2_T5": _lines("T2", "u", "T5", "l"),
    "thoracic_kyphosis_T5_T12": _lines("T5", "u", "T12", "l"),
    "lumbar_lordosis": f"CASE WHEN s1x IS NOT NULL THEN {_direction('L1', 'u')} END",
    "T1_pelvic_angle": _three(("T1_mx", "T1_my"), ("head_x", "head_y"), ("s1x", "s1y")),
    "SVA": "abs(C7_upx - s1x)",
    "pelvic_incidence": _angle("0e0", "1e0", "(s1x - head_x)", "(s1y - head_y)"),
    "pelvic_tilt": "degrees(atan2(abs(s1x - head_x), abs(s1y - head_y)))",
    "sacral_slope": _direction("L5", "l"),
}
_S1 = (
    "s1 AS (SELECT *, (L5_lax + L5_lpx) / 2 AS s1x, ((L5_lay + L5_lpy) / 2)"
    " + abs(((L5_lay + L5_lpy) / 2) - ((L5_uay + L5_upy) / 2)) * 1.2e0 AS s1y FROM spine)"
)
ORACLES["metrics_normalised"] = f"{_SPINE}, {_S1} SELECT image_id, " + ", ".join(
    f"{_scaled(v, '1e4')} AS {k}" for k, v in _NORMALISED.items()) + " FROM s1"
ORACLES["metrics_normalised_given_s1"] = (
    f"{_SPINE}, {_S1}, g AS (SELECT * REPLACE ("
    "CASE WHEN T12_lax IS NOT NULL AND L5_mx IS NOT NULL THEN L5_mx ELSE s1x END AS s1x,"
    " CASE WHEN T12_lax IS NOT NULL AND L5_mx IS NOT NULL THEN L5_my ELSE s1y END AS s1y) FROM s1) SELECT image_id, "
    + ", ".join(f"{_scaled(v, '1e4')} AS {k}" for k, v in _NORMALISED.items()) + " FROM g")
ORACLES["estimate_s1"] = (
    f"{_SPINE}, {_S1} SELECT image_id, {_scaled('s1x')} AS s1_x, {_scaled('s1y')} AS s1_y"
    " FROM s1 WHERE s1x IS NOT NULL")

_PART_NAMES = {"ua": "upper_anterior", "up": "upper_posterior", "la": "lower_anterior",
               "lp": "lower_posterior", "m": "center"}
ORACLES["endplates"] = (
    f"WITH {_DET}, numbered AS (SELECT *, row_number() OVER () AS rid FROM det), "
    + _CORNERS.replace("SELECT image_id, det_idx, label, i,", "SELECT rid, image_id, det_idx, i,")
    .replace("FROM det,", "FROM numbered,")
    + f", {_plates('corners', 'rid, image_id, det_idx')} SELECT image_id, det_idx, "
    + ", ".join(f"{_scaled(f'{s}{c}')} AS {n}_{c}" for s, n in _PART_NAMES.items() for c in "xy")
    + " FROM plates")
ORACLES["last_label_wins"] = f"""WITH {_DET}
SELECT image_id, label, det_idx, {_scaled('confidence')} AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY det_idx DESC) AS n FROM det) WHERE n = 1"""
ORACLES["keypoint_rejects"] = f"""WITH {_DET}
SELECT image_id, 'keypoint count is not 4: ' || label AS reason FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_idx) AS n FROM det
  WHERE (det_idx // 100000) % 997 = 0) WHERE n = 1"""
ORACLES["first_cfh_box"] = f"""WITH {_DET}
SELECT image_id, det_idx, {_scaled('cx')} AS x, {_scaled('cy')} AS y FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_idx) AS n FROM det WHERE l_partkey % 13 = 0)
WHERE n = 1"""
ORACLES["detection_overview"] = f"""WITH {_DET},
heads AS (SELECT image_id, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_idx) AS n FROM det WHERE l_partkey % 13 = 0)
  WHERE n = 1)
SELECT d.image_id, count(*) AS vertebra_count, string_agg(label, ',' ORDER BY label) AS labels,
       max(h.confidence) IS NOT NULL AS has_cfh, {_scaled('max(h.confidence)')} AS cfh_confidence
FROM det d LEFT JOIN heads h USING (image_id) GROUP BY d.image_id"""
ORACLES["metric_coverage"] = f"{_WIDE} " + " UNION ALL ".join(
    f"SELECT image_id, '{m}' AS metric, {m} IS NOT NULL AS available,"
    f" CASE WHEN {m} IS NULL THEN 'N/A (required vertebra missing)' END AS note FROM wide"
    for m in vocab.REPORTED_METRICS)
ORACLES["coverage_by_metric"] = f"{_WIDE} " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, count(*) AS n_images, count({m}) AS n_available,"
    f" {_scaled(f'CAST(count({m}) AS DOUBLE) / count(*)')} AS coverage FROM wide"
    for m in vocab.REPORTED_METRICS)

# --- measurement rows ---------------------------------------------------------------------------

_MEAS = f"""
meas AS (
  SELECT l_orderkey // 4 AS image_id,
         (l_orderkey % 4) * 1000000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS ord,
         {_names(vocab.MEASUREMENT_TYPES)}[CAST(l_partkey % 12 AS INT) + 1] AS type,
         CAST(1 + l_suppkey % 7 AS INT) AS n,
         {', '.join(f'CASE WHEN 1 + l_suppkey % 7 >= {k} THEN CAST((l_partkey * 31 + {k} * 577) % 2000 AS DOUBLE) END AS x{k}, CASE WHEN 1 + l_suppkey % 7 >= {k} THEN CAST((l_suppkey * 17 + {k} * 839 + l_linenumber) % 4000 AS DOUBLE) END AS y{k}' for k in range(1, 8))}
  FROM lineitem),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, type ORDER BY ord DESC) AS r FROM meas)
  WHERE r = 1)"""
ORACLES["last_measurement_wins"] = f"""WITH {_MEAS}
SELECT image_id, type, ord, n AS n_points, CAST(x1 AS BIGINT) AS x0, CAST(y1 AS BIGINT) AS y0 FROM latest"""
ORACLES["measurement_point_counts"] = f"""WITH {_MEAS}
SELECT type, count(*) AS n_measurements, CAST(sum(n) AS BIGINT) AS n_points FROM meas GROUP BY type"""

# Points a metric needs.
_NEEDED = dict(zip(vocab.METRICS, [2, 4, 4, 4, 4, 4, 4, 2, 7, 3, 3, 2]))


def _by_type(source_columns: int, guard: bool = True) -> tuple[str, dict]:
    cols, points = [], {}
    for i, t in enumerate(vocab.MEASUREMENT_TYPES):
        points[t] = [(f"m{i}_x{k}", f"m{i}_y{k}") for k in range(1, source_columns + 1)]
        for k in range(1, source_columns + 1):
            cols += [f"max({c}{k}) FILTER (WHERE type = '{t}') AS m{i}_{c}{k}" for c in "xy"]
        cols.append(f"max(n) FILTER (WHERE type = '{t}') AS m{i}_n")
    return ", ".join(cols), points


_PIVOT_MEAS, _MEAS_POINTS = _by_type(7)
_FROM_MEAS = {
    m: f"CASE WHEN m{i}_n >= {_NEEDED[m]} THEN {sql} END"
    for i, (m, sql) in enumerate(_metric_sql(_MEAS_POINTS).items())
}
ORACLES["metrics_from_measurements"] = (
    f"WITH {_MEAS}, grouped AS (SELECT image_id, {_PIVOT_MEAS} FROM latest GROUP BY image_id)"
    " SELECT image_id, " + ", ".join(f"{_scaled(v, '1e4')} AS {k}" for k, v in _FROM_MEAS.items())
    + " FROM grouped")

# --- documents of embeddings --------------------------------------------------------------------

_DOC_SIZES = [2, 4, 4, 4, 4, 4, 3, 2, 7, 3, 4, 2, 2]


def _doc_point(j: int, k: int, c: int) -> str:
    return f"1000e0 * CAST(embedding[{(5 * j + 2 * k + c) % 64 + 1}] AS DOUBLE)"


_DOC_ROWS = " UNION ALL ".join(
    f"SELECT vec_id, {j} AS ord, '{vocab.MEASUREMENT_TYPES[j % 12]}' AS type, {n} AS n, "
    + ", ".join(
        f"{_doc_point(j, k, 0) if k < n else 'CAST(NULL AS DOUBLE)'} AS x{k + 1},"
        f" {_doc_point(j, k, 1) if k < n else 'CAST(NULL AS DOUBLE)'} AS y{k + 1}" for k in range(7))
    + " FROM embeddings" for j, n in enumerate(_DOC_SIZES))
ORACLES["keypoint_document_metrics"] = (
    f"WITH rows AS ({_DOC_ROWS}), latest AS (SELECT * FROM ("
    "SELECT *, row_number() OVER (PARTITION BY vec_id, type ORDER BY ord DESC) AS r FROM rows) WHERE r = 1),"
    f" grouped AS (SELECT vec_id, {_PIVOT_MEAS} FROM latest GROUP BY vec_id),"
    " wide AS (SELECT vec_id, " + ", ".join(f"{v} AS {k}" for k, v in _FROM_MEAS.items()) + " FROM grouped)"
    " SELECT CASE WHEN vec_id % 10 <> 0 THEN 'd' || vec_id ELSE 'lateral_spine' END AS imageId,"
    " 2000 AS imageWidth, 4000 AS imageHeight, "
    + ", ".join(f"{_scaled(m, '1e4')} AS {m}" for m in vocab.METRICS)
    + f", {_scaled('SVA * CASE WHEN vec_id % 2 = 0 THEN 50e0 ELSE 100e0 END / 200e0', '1e4')} AS sva_mm FROM wide")

_DOC_DET = """
dets AS (
  SELECT vec_id, j, i, ['C7','T1','T2','T5','T12','L1','L4','L5','C2','T3'][CAST((vec_id + 3 * j + j // 4) % 10 AS INT) + 1] AS label,
         CAST(embedding[8 * j + 2 * i + 1] AS DOUBLE) AS x, CAST(embedding[8 * j + 2 * i + 2] AS DOUBLE) AS y
  FROM embeddings, range(8) AS a(j), range(4) AS b(i) WHERE vec_id % 50 <> 7),
kept AS (
  SELECT * FROM (SELECT *, max(j) OVER (PARTITION BY vec_id, label) AS latest FROM dets) WHERE j = latest)"""
ORACLES["detection_document_metrics"] = (
    f"WITH {_DOC_DET}, {_plates('kept', 'vec_id, label')},"
    " spine AS (SELECT e.vec_id, 2000 AS w, 4000 AS h,"
    " any_value(CASE WHEN e.vec_id % 4 <> 0 THEN CAST(embedding[1] AS DOUBLE) + 0.5e0 END) AS head_x,"
    " any_value(CASE WHEN e.vec_id % 4 <> 0 THEN CAST(embedding[2] AS DOUBLE) END) AS head_y,"
    f" {_PIVOT} FROM (SELECT vec_id, embedding FROM embeddings) e JOIN plates USING (vec_id) GROUP BY e.vec_id)"
    " SELECT 'd' || vec_id AS imageId, "
    + ", ".join(f"{_scaled(v, '1e4')} AS {k}" for k, v in _METRICS.items()) + " FROM spine")

# --- audit --------------------------------------------------------------------------------------

_AUDIT = """WITH
docs AS (SELECT l_orderkey AS sample_id, count(DISTINCT l_linestatus) AS json_count FROM lineitem GROUP BY 1),
polys AS (SELECT DISTINCT l_orderkey AS sample_id, 'V' || l_linenumber AS label FROM lineitem),
pts AS (SELECT DISTINCT l_orderkey AS sample_id FROM lineitem WHERE l_returnflag = 'R'),
base AS (
  SELECT o_orderkey AS sample_id, CAST(o_orderkey % 3 AS BIGINT) AS image_count,
         coalesce(json_count, 0) AS json_count, coalesce(json_count, 0) > 0 AS has_annotation,
         p.sample_id IS NOT NULL AS has_p
  FROM orders LEFT JOIN docs d ON d.sample_id = o_orderkey LEFT JOIN pts p ON p.sample_id = o_orderkey),
lists AS (SELECT sample_id, string_agg(label, ',' ORDER BY label) AS poly_labels FROM polys GROUP BY 1),
gaps AS (
  SELECT b.sample_id, count(*) AS n_poly, string_agg(v.label, ',' ORDER BY v.label) AS missing_poly
  FROM base b CROSS JOIN (VALUES ('V1'), ('V2'), ('V3')) AS v(label)
  WHERE NOT EXISTS (SELECT 1 FROM polys p WHERE p.sample_id = b.sample_id AND p.label = v.label)
  GROUP BY 1),
audit AS (
  SELECT b.sample_id, image_count, json_count, has_annotation, coalesce(poly_labels, '') AS poly_labels,
         CASE WHEN has_p THEN 'P' ELSE '' END AS point_labels,
         coalesce(missing_poly, '') AS missing_poly, CASE WHEN has_p THEN '' ELSE 'P' END AS missing_point,
         coalesce(n_poly, 0) AS n_poly, CASE WHEN has_p THEN 0 ELSE 1 END AS n_point
  FROM base b LEFT JOIN lists USING (sample_id) LEFT JOIN gaps USING (sample_id))"""
ORACLES["audit_samples"] = f"""{_AUDIT}
SELECT sample_id, image_count, json_count, has_annotation, poly_labels, point_labels, missing_poly, missing_point,
       n_poly = 0 AS poly_complete, n_point = 0 AS point_complete, n_poly + n_point = 0 AS fully_complete FROM audit"""
_SUMMARY = f"""{_AUDIT}, summary AS (
SELECT count(*) AS total_samples, CAST(sum(image_count) AS BIGINT) AS total_images,
       count(*) FILTER (WHERE has_annotation) AS with_annotation,
       count(*) FILTER (WHERE NOT has_annotation) AS without_annotation,
       count(*) FILTER (WHERE has_annotation AND n_poly > 0) AS poly_incomplete,
       count(*) FILTER (WHERE has_annotation AND n_point > 0) AS point_incomplete FROM audit)"""
ORACLES["audit_summary"] = f"{_SUMMARY} SELECT * FROM summary"
ORACLES["summary_rates"] = (
    f"{_SUMMARY} SELECT {_scaled('CAST(total_images AS DOUBLE) / total_samples')} AS images_per_sample, "
    + ", ".join(f"{_scaled(f'{c} * 100e0 / total_samples')} AS {c}_pct" for c in (
        "with_annotation", "without_annotation", "poly_incomplete", "point_incomplete")) + " FROM summary")
_MISSING = f"""{_AUDIT}, expected(kind, ord, label) AS (
  VALUES ('polygon', 0, 'V1'), ('polygon', 1, 'V2'), ('polygon', 2, 'V3'), ('point', 3, 'P')),
missing AS (
  SELECT kind, ord, label,
         (SELECT count(*) FROM audit WHERE contains(CASE WHEN kind = 'point' THEN missing_point ELSE missing_poly END, label)) AS missing_count,
         (SELECT count(*) FROM audit) AS total FROM expected)"""
ORACLES["missing_by_label"] = (
    f"{_MISSING} SELECT kind, CAST(ord AS INT) AS ord, label, missing_count,"
    f" {_scaled('missing_count * 100e0 / total')} AS missing_pct FROM missing")
ORACLES["missing_label_rank"] = (
    f"{_MISSING} SELECT label, missing_count, CAST(row_number() OVER (ORDER BY missing_count DESC, ord) AS INT) AS rank"
    " FROM missing WHERE missing_count > 0")


def _top(kind: str, k: int) -> str:
    return f"""{_AUDIT} SELECT * FROM (
SELECT sample_id, image_count, json_count, CAST(n_poly AS INT) AS missing_poly_count,
       CAST(n_point AS INT) AS missing_point_count, replace(missing_poly, ',', ', ') AS missing_poly_preview,
       missing_point AS missing_point_preview,
       CAST(row_number() OVER (ORDER BY n_{kind} DESC, sample_id) AS INT) AS rank
FROM audit WHERE has_annotation AND n_{kind} > 0) WHERE rank <= {k}"""


ORACLES["top_incomplete_poly"] = _top("poly", 50)
ORACLES["top_incomplete_point"] = _top("point", 10)
ORACLES["unannotated_samples"] = f"""{_AUDIT} SELECT * FROM (
SELECT sample_id, image_count, json_count, CAST(row_number() OVER (ORDER BY sample_id) AS INT) AS rank
FROM audit WHERE NOT has_annotation) WHERE rank <= 20"""
ORACLES["unannotated_rest"] = (
    f"{_SUMMARY} SELECT without_annotation AS total, greatest(without_annotation - 20, 0) AS not_listed FROM summary")
_MEMBERS = f"""{_AUDIT}, members AS (
SELECT sample_id, EXISTS (SELECT 1 FROM polys p WHERE p.sample_id = a.sample_id AND label = 'V6') AS has_first,
       EXISTS (SELECT 1 FROM polys p WHERE p.sample_id = a.sample_id AND label = 'V7') AS has_second
FROM audit a WHERE has_annotation)"""
ORACLES["label_membership"] = (
    f"{_MEMBERS} SELECT *, has_first AND has_second AS has_both FROM members WHERE has_first OR has_second")
ORACLES["label_membership_counts"] = f"""{_MEMBERS}, c AS (
SELECT (SELECT count(*) FROM audit) AS total_samples, count(*) AS with_annotation,
       count(*) FILTER (WHERE has_first) AS first_count, count(*) FILTER (WHERE has_second) AS second_count,
       count(*) FILTER (WHERE has_first AND has_second) AS both_count FROM members)
SELECT *, """ + ", ".join(
    f"{_scaled(f'{c}_count * 100e0 / total_samples')} AS {c}_pct" for c in ("first", "second", "both")) + " FROM c"
_STATUS = """CASE WHEN NOT has_annotation THEN 'no_annotation' WHEN n_poly > 0 THEN 'incomplete' ELSE 'valid' END"""
ORACLES["selection_status"] = f"""{_AUDIT}
SELECT sample_id, {_STATUS} AS status, CASE WHEN has_annotation THEN CAST(n_poly AS INT) END AS missing_count,
       CASE WHEN has_annotation THEN replace(missing_poly, ',', ', ') END AS missing_labels FROM audit"""
ORACLES["selection_counts"] = f"""{_AUDIT}, s AS (SELECT {_STATUS} AS status FROM audit), c AS (
SELECT count(*) AS total_samples, count(*) FILTER (WHERE status = 'valid') AS valid_count,
       count(*) FILTER (WHERE status <> 'valid') AS excluded_count,
       count(*) FILTER (WHERE status = 'no_annotation') AS no_annotation_count,
       count(*) FILTER (WHERE status = 'incomplete') AS incomplete_count FROM s)
SELECT *, {_scaled('valid_count * 100e0 / total_samples')} AS valid_pct,
       {_scaled('excluded_count * 100e0 / total_samples')} AS excluded_pct FROM c"""

_SAMPLE_IMAGES = """
images AS (
  SELECT o_orderkey AS sample_id, 'im' || (o_orderkey // 9) || '_' || k AS stem,
         CASE WHEN o_orderkey % 2 = 0 THEN 'png' ELSE 'jpg' END AS ext
  FROM orders, range(1, 3) AS r(k) WHERE k <= o_orderkey % 3)"""
ORACLES["last_writer_wins"] = f"""WITH {_SAMPLE_IMAGES}
SELECT stem, sample_id, stem || '.' || ext AS file_name FROM (
  SELECT *, row_number() OVER (PARTITION BY stem ORDER BY sample_id DESC) AS n FROM images) WHERE n = 1"""
ORACLES["stem_collisions"] = f"""WITH {_SAMPLE_IMAGES}
SELECT stem, count(*) AS n_writers, min(sample_id) AS first_sample, max(sample_id) AS last_sample
FROM images GROUP BY stem HAVING count(*) > 1"""

# --- polygons -----------------------------------------------------------------------------------

_POLY = """
polys AS (
  SELECT vec_id, vec_id // 10 AS sample_id, label,
         list_transform(range(32), lambda k: 500e0 + 1000e0 * CAST(embedding[2 * k + 1] AS DOUBLE)) AS xs,
         list_transform(range(32), lambda k: 500e0 + 1000e0 * CAST(embedding[2 * k + 2] AS DOUBLE)) AS ys
  FROM embeddings),
centred AS (
  SELECT *, list_reduce(xs, lambda a, b: a + b) / 32 AS mx, list_reduce(ys, lambda a, b: a + b) / 32 AS my FROM polys)"""
ORACLES["polygon_bbox_center"] = f"""WITH {_POLY}
SELECT vec_id, {_scaled('mx')} AS mean_x, {_scaled('my')} AS mean_y, {_scaled('list_min(xs)')} AS x_min,
       {_scaled('list_min(ys)')} AS y_min, {_scaled('list_max(xs)')} AS x_max, {_scaled('list_max(ys)')} AS y_max
FROM centred"""


def _pick(n: int) -> str:
    """The n-th corner: near a quarter turn first, then the distance, then the vertex number."""
    used = " AND ".join(f"v.k <> p.k{i}" for i in range(1, n))
    prior = ", ".join(f"p.k{i}, p.a{i}" for i in range(1, n))
    target = f"(p.a{n - 1} + pi() / 2)"
    near = f"least(abs(v.a - {target}), 2 * pi() - abs(v.a - {target})) <= pi() / 4 AND v.d > 0"
    return f"""
pick{n} AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT p.vec_id, {prior}, v.k AS k{n}, v.a AS a{n},
           row_number() OVER (PARTITION BY p.vec_id ORDER BY CASE WHEN {near} THEN 0 ELSE 1 END, v.d DESC, v.k) AS r
    FROM pick{n - 1} p JOIN verts v ON v.vec_id = p.vec_id AND {used}) WHERE r = 1)"""


_FOUR = f"""{_POLY},
verts AS (
  SELECT vec_id, k, xs[k] AS x, ys[k] AS y,
         sqrt((xs[k] - mx) * (xs[k] - mx) + (ys[k] - my) * (ys[k] - my)) AS d, atan2(ys[k] - my, xs[k] - mx) AS a
  FROM centred, range(1, 33) AS r(k)),
pick1 AS (
  SELECT vec_id, k AS k1, a AS a1 FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, k) AS r FROM verts) WHERE r = 1),
{_pick(2)}, {_pick(3)}, {_pick(4)},
corner AS (
  SELECT u.vec_id, row_number() OVER (PARTITION BY u.vec_id ORDER BY v.a, u.turn) - 1 AS corner_no, v.x, v.y
  FROM (SELECT vec_id, 1 AS turn, k1 AS k FROM pick4 UNION ALL SELECT vec_id, 2, k2 FROM pick4
        UNION ALL SELECT vec_id, 3, k3 FROM pick4 UNION ALL SELECT vec_id, 4, k4 FROM pick4) u
  JOIN verts v ON v.vec_id = u.vec_id AND v.k = u.k)"""
ORACLES["four_corners"] = f"""WITH {_FOUR}
SELECT vec_id, CAST(corner_no AS INT) AS corner_no, {_scaled('x')} AS x, {_scaled('y')} AS y FROM corner"""

# --- label datasets from the corpus view --------------------------------------------------------

_CORPUS = f"""{_FOUR},
shapes AS (
  SELECT c.vec_id, sample_id, xs, ys,
         CASE WHEN label < 8 THEN ['C7','L1','L2','L3','L4','L5','T1','T2'][CAST(label AS INT) + 1]
              WHEN label = 8 THEN 'T13' ELSE 'X9' END AS name, CAST(label AS INT) AS label,
         vec_id % 17 <> 0 AS is_polygon, CASE WHEN vec_id % 13 = 0 THEN 3 ELSE 32 END AS n,
         (vec_id % 10 = 3 AND sample_id % 4 <> 0) OR (vec_id % 10 = 7 AND sample_id % 5 = 0) AS has_head
  FROM centred c WHERE sample_id % 9 <> 4),
docs AS (
  SELECT sample_id, count(*) FILTER (WHERE is_polygon AND n >= 4 AND label <> 8) AS n_polygons,
         count(*) FILTER (WHERE is_polygon AND n >= 4 AND label < 8) AS n_objects,
         count(*) FILTER (WHERE has_head) AS n_points
  FROM shapes GROUP BY sample_id),
all_samples AS (SELECT DISTINCT vec_id // 10 AS sample_id FROM embeddings),
selected AS (SELECT sample_id FROM all_samples WHERE sample_id % 7 <> 5),
images AS (
  SELECT sample_id, 'im' || (sample_id // 2) || '_' || k AS stem,
         CASE WHEN sample_id % 2 = 0 THEN 'png' ELSE 'jpg' END AS ext,
         CASE WHEN sample_id % 11 = 2 AND k = 1 THEN NULL ELSE 1000 + 100 * (sample_id % 4) END AS width,
         1100 + 100 * (sample_id % 3) AS height
  FROM all_samples, range(1, 3) AS r(k) WHERE k <= sample_id % 3),
image_counts AS (
  SELECT sample_id, count(*) AS n_images, count(width) AS n_readable FROM images GROUP BY sample_id)"""


def _winners(ready: str) -> str:
    return f"""
written AS (
  SELECT i.* FROM images i JOIN selected USING (sample_id) JOIN docs USING (sample_id)
  WHERE width IS NOT NULL AND {ready}),
winners AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY sample_id DESC) AS n FROM written) WHERE n = 1)"""


def _failed(invalid: str, ready: str) -> str:
    return f"""
failures AS (
  SELECT * FROM (
    SELECT s.sample_id,
           CASE WHEN d.sample_id IS NULL THEN 'No JSON file' WHEN n_images IS NULL THEN 'No image file'
                {invalid} WHEN NOT ({ready}) OR n_readable = 0 THEN 'Processed 0 images' END AS reason
    FROM selected s LEFT JOIN docs d USING (sample_id) LEFT JOIN image_counts USING (sample_id))
  WHERE reason IS NOT NULL)"""


_POSE_READY, _POINT_READY = "n_objects > 0", "n_points = 1"
_POSE_INVALID = "WHEN n_polygons = 0 THEN 'No valid annotations'"
_POINT_INVALID = "WHEN n_points <> 1 THEN 'CFH keypoints count: ' || n_points || ' (expected 1)'"
_BOX_COLUMNS = ", ".join(f"{_scaled(c)} AS {c}" for c in ("cx", "cy", "w", "h"))

ORACLES["pose_rows"] = f"""WITH {_CORPUS}, {_winners(_POSE_READY)},
rows AS (
  SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY s.vec_id) AS line_no, s.label AS class_id, s.vec_id, width, height,
         ((list_min(xs) + list_max(xs)) / 2) / width AS cx, ((list_min(ys) + list_max(ys)) / 2) / height AS cy,
         (list_max(xs) - list_min(xs)) / width AS w, (list_max(ys) - list_min(ys)) / height AS h
  FROM winners JOIN shapes s USING (sample_id) WHERE is_polygon AND s.n >= 4 AND s.label < 8)
SELECT stem, CAST(line_no AS INT) AS line_no, class_id, {_BOX_COLUMNS},
       (SELECT string_agg({_scaled('x / width')} || ':' || {_scaled('y / height')} || ':2', ' ' ORDER BY corner_no)
        FROM corner c WHERE c.vec_id = rows.vec_id) AS keypoints
FROM rows"""
ORACLES["pose_manifest"] = f"""WITH {_CORPUS}, {_winners(_POSE_READY)}
SELECT max(sample_id) || '/' || stem || '.' || ext AS src_path, stem || '.' || ext AS dst_name, max(sample_id) AS sample_id
FROM written GROUP BY stem, ext"""
ORACLES["pose_failures"] = f"WITH {_CORPUS}, {_failed(_POSE_INVALID, _POSE_READY)} SELECT * FROM failures"
ORACLES["pose_failure_reasons"] = (
    f"WITH {_CORPUS}, {_failed(_POSE_INVALID, _POSE_READY)}"
    " SELECT reason, count(*) AS n_samples FROM failures GROUP BY reason")
ORACLES["point_failures"] = f"WITH {_CORPUS}, {_failed(_POINT_INVALID, _POINT_READY)} SELECT * FROM failures"
ORACLES["point_rows"] = f"""WITH {_CORPUS}, {_winners(_POINT_READY)},
b AS (
  SELECT stem, width, height, xs[1] AS px, ys[1] AS py,
         greatest(0, xs[1] - 32e0) AS x0, greatest(0, ys[1] - 32e0) AS y0,
         least(width, xs[1] + 32e0) AS x1, least(height, ys[1] + 32e0) AS y1
  FROM winners JOIN shapes USING (sample_id) WHERE has_head),
r AS (SELECT *, ((x0 + x1) / 2) / width AS cx, ((y0 + y1) / 2) / height AS cy,
             (x1 - x0) / width AS w, (y1 - y0) / height AS h FROM b)
SELECT stem, 1 AS line_no, 0 AS class_id, {_BOX_COLUMNS},
       {_scaled('px / width')} || ':' || {_scaled('py / height')} || ':2' AS keypoints
FROM r WHERE w >= 0 AND h >= 0"""

_NAMED = f"""{_CORPUS},
named AS (
  SELECT d.sample_id, 'im' || (d.sample_id // 2) || '_1' AS stem, width, height,
         width IS NOT NULL AND height IS NOT NULL AS found
  FROM docs d LEFT JOIN images i ON i.sample_id = d.sample_id AND d.sample_id % 6 <> 3
       AND i.stem = 'im' || (d.sample_id // 2) || '_1'
  WHERE d.sample_id % 6 <> 0),
heights AS (
  SELECT sample_id, list(list_max(ys[1:n]) - list_min(ys[1:n]) ORDER BY vec_id) AS hs FROM shapes WHERE n >= 4 GROUP BY sample_id),
sized AS (
  SELECT named.*, n_points, CASE WHEN hs IS NULL THEN greatest(trunc(width * 0.06e0), trunc(height * 0.04e0))
                  ELSE trunc(list_reduce(hs, lambda a, b: a + b) / len(hs) * 1.8e0) END AS side
  FROM named JOIN docs USING (sample_id) LEFT JOIN heights USING (sample_id))"""
ORACLES["box_rows"] = f"""WITH {_NAMED},
last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY sample_id DESC) AS r FROM sized
                 WHERE found AND n_points > 0) WHERE r = 1),
rows AS (
  SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY vec_id) AS line_no,
         greatest(0, least(1, xs[1] / width)) AS cx, greatest(0, least(1, ys[1] / height)) AS cy,
         greatest(0, least(1, side / width)) AS w, greatest(0, least(1, side / height)) AS h
  FROM last JOIN shapes USING (sample_id) WHERE has_head)
SELECT stem, CAST(line_no AS INT) AS line_no, 0 AS class_id, {_BOX_COLUMNS}, '' AS keypoints FROM rows"""
ORACLES["box_counts"] = f"""WITH {_NAMED}
SELECT count(*) FILTER (WHERE found AND n_points > 0) AS total_images,
       CAST(coalesce(sum(n_points) FILTER (WHERE found), 0) AS BIGINT) AS total_objects,
       count(*) FILTER (WHERE NOT found) AS skipped FROM sized"""

ORACLES["point_box_clamped"] = f"""WITH {_DET}, b AS (
  SELECT image_id, det_idx, img_w, img_h, greatest(0, cx * img_w - 600e0) AS x0, greatest(0, cy * img_h - 600e0) AS y0,
         least(img_w, cx * img_w + 600e0) AS x1, least(img_h, cy * img_h + 600e0) AS y1
  FROM det WHERE l_partkey % 13 = 0)
SELECT image_id, det_idx, {_scaled('((x0 + x1) / 2) / img_w')} AS cx, {_scaled('((y0 + y1) / 2) / img_h')} AS cy,
       {_scaled('(x1 - x0) / img_w')} AS w, {_scaled('(y1 - y0) / img_h')} AS h FROM b"""
ORACLES["adaptive_box"] = f"""WITH {_DET},
h AS (
  SELECT image_id, avg(greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3)) AS avg_h FROM (
    SELECT image_id, floor((cy - hh + t) * img_h) AS y0, floor((cy - hh - t) * img_h) AS y1,
           floor((cy + hh - t) * img_h) AS y2, floor((cy + hh + t) * img_h) AS y3
    FROM det WHERE l_partkey % 13 <> 0) GROUP BY image_id),
s AS (
  SELECT d.*, avg_h, CAST(greatest(trunc(img_w * 0.06e0), trunc(img_h * 0.04e0)) AS INT) AS plain,
         CAST(trunc(avg_h * 1.8e0) AS INT) AS ref
  FROM det d LEFT JOIN h USING (image_id) WHERE l_partkey % 13 = 0),
r AS (
  SELECT *, coalesce(ref, plain) AS side,
         CASE WHEN ref IS NULL THEN plain ELSE CAST(greatest(trunc((trunc(img_w * 0.06e0) + ref) / 2),
              trunc((trunc(img_h * 0.04e0) + ref) / 2)) AS INT) END AS blended_side FROM s)
SELECT image_id, det_idx, side, blended_side,
       {_scaled('greatest(0, least(1, cx * img_w / img_w))')} AS cx, {_scaled('greatest(0, least(1, cy * img_h / img_h))')} AS cy,
       {_scaled('greatest(0, least(1, CAST(side AS DOUBLE) / img_w))')} AS w, {_scaled('greatest(0, least(1, CAST(side AS DOUBLE) / img_h))')} AS h
FROM r"""

# --- merge and validation -----------------------------------------------------------------------

_MERGE_BOX = f"{_scaled('cx')} AS cx, {_scaled('cy')} AS cy, {_scaled('2 * hw')} AS w, {_scaled('2 * hh')} AS h"
ORACLES["merge_labels"] = f"""WITH {_DET},
both_sets AS (
  SELECT *, 0 AS src, CAST(l_partkey % 18 AS INT) AS class_id, 4 AS n FROM det WHERE l_partkey % 3 <> 0
  UNION ALL SELECT *, 1, 18, 1 FROM det WHERE l_partkey % 5 = 0 AND l_partkey % 4 <> 0)
SELECT image_id AS stem, CAST(row_number() OVER (PARTITION BY image_id ORDER BY src, det_idx) AS INT) AS line_no,
       class_id, {_MERGE_BOX},
       {_scaled('cx + hw / 1')} || ':' || {_scaled('cy - hh / 1')} || ':2 ' ||
       CASE WHEN n = 1 THEN '0:0:0 0:0:0 0:0:0' ELSE
       {" || ' ' || ".join(f"{_scaled(f'cx + hw / {k}')} || ':' || {_scaled(f'cy - hh / {k}')} || ':2'" for k in (2, 3, 4))} END AS keypoints
FROM both_sets"""
_STEMS = "stems AS (SELECT DISTINCT l_orderkey // 4 AS stem FROM lineitem)"
ORACLES["merge_images"] = f"""WITH {_STEMS}
SELECT stem, 'a' || stem || CASE WHEN stem % 4 <> 1 THEN '.png' ELSE '.jpg' END AS file_name,
       stem % 4 <> 1 AS in_corner, stem % 6 <> 1 AS in_cfh FROM stems WHERE stem % 4 <> 1 OR stem % 6 <> 1"""
_MERGE_STATS = f"""{_STEMS},
l AS (SELECT l_orderkey // 4 AS stem, count(*) AS n FROM lineitem WHERE l_partkey % 3 <> 0 AND (l_orderkey // 4) % 5 <> 2 GROUP BY 1),
r AS (SELECT l_orderkey // 4 AS stem, count(*) FILTER (WHERE l_partkey % 4 <> 0) AS n FROM lineitem WHERE l_partkey % 5 = 0 GROUP BY 1),
per_stem AS (
  SELECT s.stem, l.n AS nl, r.n AS nr FROM stems s LEFT JOIN l USING (stem) LEFT JOIN r ON r.stem = s.stem
  WHERE s.stem % 4 <> 1 OR s.stem % 6 <> 1),
stats AS (
  SELECT count(*) AS total_images, count(*) FILTER (WHERE nl IS NOT NULL AND nr IS NULL) AS corner_only,
         count(*) FILTER (WHERE nl IS NULL AND nr IS NOT NULL) AS cfh_only,
         count(*) FILTER (WHERE nl IS NOT NULL AND nr IS NOT NULL) AS both,
         CAST(coalesce(sum(nl), 0) AS BIGINT) AS vertebra_objects, CAST(coalesce(sum(nr), 0) AS BIGINT) AS cfh_objects
  FROM per_stem)"""
ORACLES["merge_stats"] = f"WITH {_MERGE_STATS} SELECT * FROM stats"
_YAML_NAMES = "\n".join(f"  {i}: {n}" for i, n in enumerate(vocab.MERGED_CLASSES))
ORACLES["descriptor_yaml"] = f"""WITH {_MERGE_STATS}
SELECT 'path: .
train: images
val: images
nc: 19
names:
{_YAML_NAMES}
kpt_shape: [4, 3]
dataset_info:
  description: "merged"
  total_images: ' || total_images || '
  total_objects: ' || (vertebra_objects + cfh_objects) || '
  vertebra_objects: ' || vertebra_objects || '
  cfh_objects: ' || cfh_objects AS yaml FROM stats"""
ORACLES["pairing_missing"] = """
SELECT c_custkey AS stem, 'label' AS missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL
SELECT DISTINCT o_custkey, 'image' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"""


def _thousandths(i: int) -> str:
    return f"((l_suppkey * {7 + i % 2} + l_linenumber) % 1000)"


def _text(i: int) -> str:
    return f"'0.' || lpad(CAST({_thousandths(i)} AS VARCHAR), 3, '0')"


_LINE_BASE = """
base AS (
  SELECT *, l_orderkey AS stem, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS line_no,
         CAST(CASE WHEN l_partkey % 11 = 0 THEN 9 ELSE 17 END AS INT) AS n_fields,
         CASE WHEN l_partkey % 101 <> 0 THEN CAST(l_partkey % 20 AS INT) END AS class_id
  FROM lineitem)"""


def _kp(i: int) -> str:
    return f"{_thousandths(4 + 2 * i)} || ':' || {_thousandths(5 + 2 * i)} || ':2'"


def _line_keypoint(i: int) -> str:
    return f"' ' || {_text(4 + 2 * i)} || '000 ' || {_text(5 + 2 * i)} || '000 2'"


ORACLES["label_line_fields"] = f"""WITH {_LINE_BASE}
SELECT stem, line_no, n_fields, class_id,
       {', '.join(f'{_thousandths(i)} AS {c}' for i, c in enumerate(('cx', 'cy', 'w', 'h')))},
       {_kp(0)} || CASE WHEN n_fields = 17 THEN ' ' || {" || ' ' || ".join(_kp(i) for i in (1, 2, 3))} ELSE '' END AS keypoints
FROM base"""
ORACLES["label_line_text"] = f"""WITH {_LINE_BASE}
SELECT stem, line_no, CAST(class_id AS VARCHAR) || ' ' || {" || '000 ' || ".join(_text(i) for i in range(4))} || '000' ||
       {_line_keypoint(0)} || CASE WHEN n_fields = 17 THEN {" || ".join(map(_line_keypoint, (1, 2, 3)))} ELSE '' END AS text
FROM base WHERE class_id IS NOT NULL"""
ORACLES["class_distribution"] = f"""WITH {_LINE_BASE}
SELECT class_id, CASE WHEN class_id < 19 THEN {_names(vocab.MERGED_CLASSES)}[class_id + 1]
                      ELSE 'Unknown_' || class_id END AS label, count(*) AS n_objects,
       {_scaled('count(*) * 100e0 / (SELECT count(*) FROM base)')} AS pct
FROM base WHERE n_fields >= 17 AND class_id IS NOT NULL GROUP BY class_id"""
ORACLES["keypoint_totals"] = f"""WITH {_LINE_BASE}, t AS (
SELECT count(*) AS total_objects,
       4 * count(*) FILTER (WHERE n_fields >= 17 AND class_id <> 18) AS vertebra_keypoints,
       count(*) FILTER (WHERE n_fields >= 17 AND class_id = 18) AS cfh_keypoints,
       (SELECT count(*) FROM orders) AS label_files FROM base)
SELECT total_objects, vertebra_keypoints + cfh_keypoints AS total_keypoints, vertebra_keypoints, cfh_keypoints,
       label_files, {_scaled('CAST(total_objects AS DOUBLE) / label_files')} AS objects_per_file FROM t"""
ORACLES["format_violations_vertebra"] = f"""WITH {_LINE_BASE}
SELECT stem, line_no, n_fields, class_id,
       CASE WHEN n_fields < 17 THEN 'expected at least 17 fields, found ' || n_fields
            WHEN class_id IS NULL THEN 'class id is not a number' ELSE 'class id ' || class_id || ' outside 0-17' END AS violation
FROM base WHERE n_fields < 17 OR class_id IS NULL OR class_id > 17"""
ORACLES["format_violations"] = f"""WITH {_LINE_BASE}
SELECT stem, line_no, n_fields, class_id,
       CASE WHEN n_fields = 9 THEN 'expected 17 fields, found 9' WHEN class_id IS NULL THEN 'class id is not a number'
            ELSE 'class id ' || class_id || ' outside 0-18' END AS violation
FROM base WHERE n_fields = 9 OR class_id IS NULL OR class_id > 18"""
_FULL_LINE = f"""CASE WHEN n_fields = 17 THEN CAST(class_id AS VARCHAR) || '  ' || {" || '  ' || ".join(_text(i) for i in range(4))} ||
 {" || ".join(f"'  ' || {_text(4 + 2 * i)} || '  ' || {_text(5 + 2 * i)} || '  2'" for i in range(4))}
 ELSE CAST(class_id AS VARCHAR) || ' ' || {" || ' ' || ".join(_text(i) for i in range(6))} || ' 2 0.5' END"""
ORACLES["format_examples"] = f"""WITH {_LINE_BASE}
SELECT kind, stem, line_no, line, n_fields, n_fields = 17 AS valid FROM (
  SELECT CASE WHEN class_id < 18 THEN 'vertebra' ELSE 'cfh' END AS kind, stem, line_no, n_fields, {_FULL_LINE} AS line,
         row_number() OVER (PARTITION BY class_id < 18 ORDER BY stem, line_no) AS r
  FROM base WHERE class_id <= 18) WHERE r = 1"""

# --- overlays, detections, predictions ----------------------------------------------------------

_UNKNOWN = f"CASE WHEN class_id < 18 THEN {_names(vocab.VERTEBRA_CLASSES)}[class_id + 1] ELSE 'Class_' || class_id END"
_INTERVAL = "CAST(trunc(trunc({c} * {e}) {op} trunc({s} * {e}) / 2) AS INT)"


def _interval(c: str, s: str, e: str, op: str) -> str:
    return _INTERVAL.format(c=c, s=s, e=e, op=op)


ORACLES["overlay_boxes"] = f"""WITH {_DET}, lab AS (SELECT *, CAST(l_partkey % 20 AS INT) AS class_id FROM det)
SELECT image_id AS stem, det_idx AS line_no, class_id, {_UNKNOWN} AS label,
       {_interval('cx', '(2 * hw)', 'img_w', '-')} AS x1, {_interval('cy', '(2 * hh)', 'img_h', '-')} AS y1,
       {_interval('cx', '(2 * hw)', 'img_w', '+')} AS x2, {_interval('cy', '(2 * hh)', 'img_h', '+')} AS y2 FROM lab"""
_KP_ROWS = f"""WITH {_DET}, kp AS (
  SELECT image_id AS stem, det_idx AS line_no, CAST(l_partkey % 20 AS INT) AS class_id, l_partkey, i,
         CAST(trunc((CASE i WHEN 0 THEN cx - hw WHEN 1 THEN cx + hw WHEN 2 THEN cx + hw ELSE cx - hw END) * img_w) AS INT) AS x,
         CAST(trunc((CASE i WHEN 0 THEN cy - hh + t WHEN 1 THEN cy - hh - t WHEN 2 THEN cy + hh - t ELSE cy + hh + t END) * img_h) AS INT) AS y
  FROM det, range(4) AS r(i))"""
ORACLES["overlay_points"] = f"""{_KP_ROWS}
SELECT stem, line_no, class_id, CAST(i + 1 AS INT) AS point_no, x, y FROM kp WHERE i < 3 OR l_partkey % 7 <> 0"""
ORACLES["overlay_edges"] = f"""{_KP_ROWS}, quad AS (
  SELECT stem, line_no, class_id, l_partkey, i, x, y, row_number() OVER () AS rid FROM kp WHERE l_partkey % 7 <> 0)
SELECT stem, line_no, class_id, CAST(i AS INT) AS edge, x AS x1, y AS y1, x2, y2 FROM (
  SELECT q.stem, q.line_no, q.class_id, q.i, q.x, q.y, n.x AS x2, n.y AS y2
  FROM (SELECT *, row_number() OVER (PARTITION BY stem, line_no, i ORDER BY rid) AS c FROM quad) q
  JOIN (SELECT *, row_number() OVER (PARTITION BY stem, line_no, i ORDER BY rid) AS c FROM quad) n
    ON n.stem = q.stem AND n.line_no = q.line_no AND n.i = (q.i + 1) % 4 AND n.c = q.c)"""
def _corner(i: int) -> str:
    x = ("cx - hw", "cx + hw", "cx + hw", "cx - hw")[i]
    y = ("cy - hh + t", "cy - hh - t", "cy + hh - t", "cy + hh + t")[i]
    return f"{{'i': {i}, 'x': CAST(trunc(({x}) * img_w) AS INT), 'y': CAST(trunc(({y}) * img_h) AS INT)}}"


ORACLES["prediction_edges"] = f"""WITH {_DET}, visible AS (
  SELECT image_id, det_idx, list_filter([{', '.join(_corner(i) for i in range(4))}],
                                        lambda p: ((det_idx + 37 * p.i) % 100) / 100e0 > 0.5e0) AS v
  FROM det WHERE confidence >= 0.5e0),
edges AS (SELECT *, unnest(range(len(v))) AS pos FROM visible WHERE len(v) >= 2)
SELECT image_id, det_idx, CAST(pos AS INT) AS edge, v[pos + 1].x AS x1, v[pos + 1].y AS y1,
       v[(pos + 1) % len(v) + 1].x AS x2, v[(pos + 1) % len(v) + 1].y AS y2 FROM edges"""

_RAW = f"""WITH {_DET}, raw AS (
  SELECT image_id, det_idx, CAST(l_partkey % 20 AS INT) AS class_id, confidence, img_w, img_h,
         (cx - hw) * img_w AS x1, (cy - hh) * img_h AS y1, (cx + hw) * img_w AS x2, (cy + hh) * img_h AS y2 FROM det)"""
ORACLES["detections_normalised"] = f"""{_RAW}
SELECT image_id, det_idx, {_UNKNOWN} AS label, {_scaled('confidence')} AS confidence,
       {_scaled('(x1 + x2) / 2 / img_w')} AS cx, {_scaled('(y1 + y2) / 2 / img_h')} AS cy,
       {_scaled('(x2 - x1) / img_w')} AS w, {_scaled('(y2 - y1) / img_h')} AS h,
       {_scaled('x2 / img_w')} AS kx, {_scaled('y2 / img_h')} AS ky FROM raw WHERE confidence >= 0.2e0"""
ORACLES["cfh_normalised"] = f"""{_RAW}
SELECT image_id, det_idx, {_scaled('confidence')} AS confidence,
       {_scaled('(x1 + x2) / 2 / img_w')} AS x, {_scaled('(y1 + y2) / 2 / img_h')} AS y FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_idx) AS r FROM raw WHERE confidence >= 0.25e0) WHERE r = 1"""
ORACLES["known_class_boxes"] = f"{_RAW} SELECT image_id, det_idx, {_UNKNOWN} AS label FROM raw WHERE class_id < 18"
ORACLES["detections_flat"] = f"{_RAW} SELECT 'img' || image_id AS image, " + ", ".join(
    f"{_scaled(c, '1e4')} AS {c}" for c in ("x1", "y1", "x2", "y2", "confidence")
) + f", {_scaled('(x1 + x2) / 2', '1e4')} AS center_x, {_scaled('(y1 + y2) / 2', '1e4')} AS center_y FROM raw"
ORACLES["prediction_text"] = f"""{_RAW}
SELECT image_id, det_idx, 'Class_' || class_id || ' 0.' || lpad(CAST(det_idx % 97 AS VARCHAR), 2, '0') || '00' || chr(10) ||
       '  Point1: (' || (det_idx % 8000) // 4 || '.' || lpad(CAST(det_idx % 4 * 25 AS VARCHAR), 2, '0') || ', '
       || (det_idx % 5000) // 4 || '.' || lpad(CAST(det_idx % 4 * 25 AS VARCHAR), 2, '0') || ')' AS text
FROM raw WHERE det_idx % 97 >= 50"""
_SAMPLED = """sampled AS (
  SELECT image_id FROM (SELECT DISTINCT l_orderkey // 4 AS image_id FROM lineitem)
  ORDER BY (image_id * 2654435761) % 4294967296, image_id LIMIT 1000)"""
ORACLES["sampled_images"] = f"WITH {_SAMPLED} SELECT * FROM sampled"
_RUN = f"""WITH {_DET}, {_SAMPLED}, stats AS (
SELECT (SELECT count(*) FROM sampled) AS total_images,
       count(*) AS corner_detections, 4 * count(*) AS corner_keypoints,
       count(*) FILTER (WHERE l_partkey % 13 = 0) AS cfh_detections
FROM det WHERE confidence >= 0.5e0 AND image_id IN (SELECT image_id FROM sampled))"""
ORACLES["prediction_stats"] = f"{_RUN} SELECT * FROM stats"
ORACLES["prediction_ratios"] = (
    f"{_RUN} SELECT {_scaled('CAST(corner_detections AS DOUBLE) / total_images')} AS vertebrae_per_image,"
    f" {_scaled('CAST(corner_keypoints AS DOUBLE) / corner_detections')} AS keypoints_per_vertebra FROM stats")

# --- scores -------------------------------------------------------------------------------------

_EVAL = f"""WITH {_DET},
pred AS (
  SELECT row_number() OVER () AS rid, image_id, det_idx, CAST(l_partkey % 20 AS INT) AS class_id, confidence, l_linenumber,
         (cx - hw) * img_w AS x1, (cy - hh) * img_h AS y1, (cx + hw) * img_w AS x2, (cy + hh) * img_h AS y2 FROM det),
truth AS (
  SELECT image_id, det_idx AS truth_idx, class_id, x1 + 5 * (l_linenumber - 4) AS x1, y1 + 5 * (l_linenumber - 4) AS y1,
         x2 + 5 * (l_linenumber - 4) AS x2, y2 + 5 * (l_linenumber - 4) AS y2 FROM pred WHERE det_idx % 7 <> 0),
candidates AS (
  SELECT p.rid, p.image_id, p.class_id, p.det_idx, p.confidence, t.truth_idx,
         greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) * greatest(0, least(p.y2, t.y2) - greatest(p.y1, t.y1)) AS o,
         (p.x2 - p.x1) * (p.y2 - p.y1) AS pa, (t.x2 - t.x1) * (t.y2 - t.y1) AS ta
  FROM pred p JOIN truth t ON p.image_id = t.image_id AND p.class_id = t.class_id),
pointing AS (
  SELECT * FROM (
    SELECT *, o / (pa + ta - o) AS iou,
           row_number() OVER (PARTITION BY rid ORDER BY o / (pa + ta - o) DESC, truth_idx) AS r FROM candidates)
  WHERE r = 1)"""
ORACLES["match_detections"] = f"""{_EVAL}
SELECT image_id, class_id, truth_idx, det_idx, {_scaled('confidence')} AS confidence, {_scaled('iou')} AS iou FROM (
  SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY image_id, truth_idx ORDER BY confidence DESC, det_idx) AS r
  FROM pointing WHERE iou >= 0.5e0) WHERE r = 1"""
_SCORES = f"""{_EVAL},
steps(step, lim) AS (VALUES {', '.join(f'({i}, {t}e0)' for i, t in enumerate(
    (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)))}),
hit AS (
  SELECT * FROM (
    SELECT rid, det_idx, step,
           row_number() OVER (PARTITION BY image_id, truth_idx, step ORDER BY confidence DESC, det_idx) AS r
    FROM pointing JOIN steps ON iou >= lim) WHERE r = 1),
n_truth AS (SELECT class_id, count(*) AS n_truth FROM truth GROUP BY class_id),
flagged AS (
  SELECT p.class_id, s.step, p.confidence, CASE WHEN h.det_idx IS NULL THEN 0 ELSE 1 END AS tp
  FROM pred p CROSS JOIN steps s LEFT JOIN hit h ON h.rid = p.rid AND h.step = s.step),
levels AS (SELECT class_id, step, confidence, count(*) AS n, sum(tp) AS tp FROM flagged GROUP BY ALL),
curve AS (
  SELECT *, sum(tp) OVER w AS cum_tp, sum(n) OVER w AS cum_n FROM levels
  WINDOW w AS (PARTITION BY class_id, step ORDER BY confidence DESC)),
scored AS (
  SELECT c.*, n_truth, CAST(cum_tp AS DOUBLE) / cum_n AS p, CAST(cum_tp AS DOUBLE) / n_truth AS r,
         2e0 * cum_tp / (cum_n + n_truth) AS f1 FROM curve c JOIN n_truth USING (class_id)),
envelope AS (
  SELECT *, max(p) OVER (PARTITION BY class_id, step ORDER BY confidence) AS env,
         row_number() OVER (PARTITION BY class_id, step ORDER BY f1 DESC, confidence DESC) AS best FROM scored),
classes AS (
  SELECT class_id, any_value(n_truth) AS n_truth, max(p) FILTER (WHERE step = 0 AND best = 1) AS precision,
         max(r) FILTER (WHERE step = 0 AND best = 1) AS recall,
         sum(tp * env) FILTER (WHERE step = 0) / any_value(n_truth) AS ap50,
         sum(tp * env) / any_value(n_truth) / 10 AS ap50_95 FROM envelope GROUP BY class_id)"""
_SCORE_COLUMNS = ("precision", "recall", "ap50", "ap50_95")
ORACLES["evaluation_by_class"] = f"{_SCORES} SELECT class_id, n_truth, " + ", ".join(
    f"{_scaled(c)} AS {c}" for c in _SCORE_COLUMNS) + " FROM classes"
ORACLES["evaluation"] = f"{_SCORES} SELECT " + ", ".join(
    f"{_scaled(f'avg({c})')} AS {c}" for c in _SCORE_COLUMNS) + " FROM classes"

# --- further listings ---------------------------------------------------------------------------

ORACLES["label_gaps"] = f"""{_AUDIT}
SELECT b.sample_id, 'polygon' AS kind, v.label FROM base b CROSS JOIN (VALUES ('V1'), ('V2'), ('V3')) AS v(label)
WHERE NOT EXISTS (SELECT 1 FROM polys p WHERE p.sample_id = b.sample_id AND p.label = v.label)
UNION ALL SELECT sample_id, 'point', 'P' FROM base WHERE NOT has_p"""
ORACLES["sorted_incomplete"] = f"""{_AUDIT}
SELECT sample_id, CAST(n_poly AS INT) AS missing_count FROM audit WHERE has_annotation AND n_poly > 0"""
ORACLES["pairing_head"] = f"""SELECT * FROM ({ORACLES['pairing_missing']}) WHERE missing = 'label' ORDER BY stem LIMIT 5"""
ORACLES["descriptor_violations"] = """
SELECT 'nc: expected 18, found 19' AS violation FROM (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'kpt_shape: expected [4, 3]' FROM (SELECT count(*) FROM lineitem)"""
ORACLES["reference_heights"] = f"""WITH {_DET}
SELECT image_id, {_scaled('avg(greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3))')} AS avg_height FROM (
  SELECT image_id, floor((cy - hh + t) * img_h) AS y0, floor((cy - hh - t) * img_h) AS y1,
         floor((cy + hh - t) * img_h) AS y2, floor((cy + hh + t) * img_h) AS y3
  FROM det WHERE l_partkey % 13 <> 0) GROUP BY image_id"""
ORACLES["detection_total"] = f"{_RAW} SELECT count(*) AS total_detections FROM raw WHERE confidence >= 0.25e0"

# --- documents, shapes and rejects --------------------------------------------------------------

ORACLES["failure_head"] = f"""WITH {_CORPUS}, {_failed(_POSE_INVALID, _POSE_READY)}
SELECT sample_id, reason, CAST(row_number() OVER (ORDER BY sample_id) AS INT) AS rank,
       greatest((SELECT count(*) FROM failures) - 10, 0) AS not_listed
FROM failures ORDER BY sample_id LIMIT 10"""
ORACLES["exploded_shapes"] = f"""WITH {_CORPUS},
parts AS (
  SELECT sample_id, vec_id, 0 AS turn, 'CFH' AS label, 'point' AS shape_type, 1 AS n_points, xs, ys FROM shapes WHERE has_head
  UNION ALL
  SELECT sample_id, vec_id, 1, name, CASE WHEN is_polygon THEN 'polygon' ELSE 'rectangle' END, n, xs, ys FROM shapes)
SELECT sample_id, 'a.json' AS doc_path,
       CASE WHEN sample_id % 6 = 0 THEN '' WHEN sample_id % 6 = 3 THEN 'none.png'
            ELSE 'im' || (sample_id // 2) || '_1.' || CASE WHEN sample_id % 2 = 0 THEN 'png' ELSE 'jpg' END END AS imagePath,
       CAST(row_number() OVER (PARTITION BY sample_id ORDER BY vec_id, turn) - 1 AS INT) AS shape_idx, label, shape_type,
       CAST(n_points AS INT) AS n_points, {_scaled('xs[1]')} AS x0, {_scaled('ys[1]')} AS y0
FROM parts"""
ORACLES["point_rejects"] = f"""WITH {_CORPUS}, {_winners(_POINT_READY)},
heads AS (
  SELECT stem, width, height, xs[1] + CASE WHEN sample_id % 2 = 0 THEN 3000e0 ELSE 0e0 END AS px, ys[1] AS py
  FROM winners JOIN shapes USING (sample_id) WHERE has_head),
b AS (
  SELECT stem, width, height, greatest(0, px - 32e0) AS x0, greatest(0, py - 32e0) AS y0,
         least(width, px + 32e0) AS x1, least(height, py + 32e0) AS y1 FROM heads),
r AS (SELECT stem, ((x0 + x1) / 2) / width AS cx, ((y0 + y1) / 2) / height AS cy,
             (x1 - x0) / width AS w, (y1 - y0) / height AS h FROM b)
SELECT stem, {_BOX_COLUMNS} FROM r WHERE NOT (w >= 0 AND h >= 0)"""
ORACLES["document_measurement_counts"] = (
    f"WITH rows AS ({_DOC_ROWS}) SELECT CASE WHEN vec_id % 10 <> 0 THEN 'd' || vec_id ELSE 'lateral_spine' END AS imageId,"
    f" {len(_DOC_SIZES)} AS n_measurements, CAST(ord AS INT) AS ord, type, CAST(n AS INT) AS n_points FROM rows")
ORACLES["detection_documents"] = f"""{_RAW},
listed AS (
  SELECT image_id, count(*) AS n_vertebrae, string_agg(
    det_idx || ':' || {_UNKNOWN} || ':' || {_scaled('confidence')} || ':' || {_scaled('(x1 + x2) / 2 / img_w')}, ' ' ORDER BY det_idx) AS vertebrae
  FROM raw WHERE confidence >= 0.2e0 GROUP BY image_id),
head AS (
  SELECT image_id, {_scaled('confidence')} AS cfh_confidence, {_scaled('(x1 + x2) / 2 / img_w')} AS cfh_x FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_idx) AS r FROM raw WHERE class_id = 3 AND confidence >= {vocab.CFH_CONFIDENCE}e0)
  WHERE r = 1),
images AS (SELECT DISTINCT o_orderkey // 4 AS image_id FROM orders)
SELECT image_id, CAST(1500 + 100 * (image_id % 7) AS INT) AS image_width, CAST(3000 + 100 * (image_id % 5) AS INT) AS image_height,
       coalesce(n_vertebrae, 0) AS n_vertebrae, coalesce(vertebrae, '') AS vertebrae, cfh_confidence, cfh_x
FROM images LEFT JOIN listed USING (image_id) LEFT JOIN head USING (image_id)"""
ORACLES["rejected_documents"] = """
SELECT 'd' || vec_id AS image_id,
       CASE WHEN vec_id % 100 = 13 THEN 'image size missing' ELSE 'vertebrae missing' END AS problem
FROM embeddings WHERE vec_id % 100 IN (13, 29)"""
