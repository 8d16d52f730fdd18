"""The registered queries in another engine's SQL (DuckDB), written apart from the plans.

One chain of common table expressions; a query selects from the end it needs.
"""

from __future__ import annotations

import random

from streetlens.config import DEFAULT, LAYER_RGB
from streetlens.functions.vocabulary import KEYWORDS, class_colours
from streetlens.sources.adapters import CLASS_NAMES, SCENE_RECT

FX = "CAST(128.00000000000003 AS DOUBLE)"


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _flag(keywords: str, name: str = "name") -> str:
    words = ", ".join(f"'{k}'" for k in KEYWORDS[keywords])
    return f"len(list_filter([{words}], lambda k: contains(lower({name}), k))) > 0 AS is_{keywords}"


FLAGS = ", ".join(_flag(k) for k in KEYWORDS)
YAW = "CASE dir WHEN 'left' THEN -90 WHEN 'front' THEN 0 WHEN 'right' THEN 90 ELSE 180 END"


def _z(v: str) -> str:
    return f"{_d(2.5)} / (({v} - {_d(128.0)}) / {FX})"


def _cell(source: str, keys: str, yaw: str = YAW, ox: int = 120, oy: int = 120, width: int = 240, height: int = 240) -> str:
    """Rows of a source (u, z) with col and row, those off the grid left out."""
    return f"""
SELECT * FROM (SELECT {keys}, CAST(round_even({_d(float(ox))} + (z * s + x * c) / {_d(0.5)}, 0) AS INT) AS col, CAST(round_even({_d(float(oy))} + (-z * c + x * s) / {_d(0.5)}, 0) AS INT) AS "row"
  FROM (SELECT *, (u - {_d(128.0)}) / {FX} * CAST(z AS DOUBLE) AS x, sin(radians(CAST({yaw} AS DOUBLE))) AS s, cos(radians(CAST({yaw} AS DOUBLE))) AS c FROM (SELECT * REPLACE (CAST(z AS DOUBLE) AS z), z AS z0 FROM {source})))
WHERE col >= 0 AND col < {width} AND "row" >= 0 AND "row" < {height}"""


def _smooth(source: str) -> str:
    return f"""
SELECT * REPLACE (CAST(median(CAST(CAST(z AS FLOAT) AS DOUBLE)) OVER (PARTITION BY pano, dir, layer ORDER BY i RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS FLOAT) AS z) FROM {source}"""


def _link(source: str) -> str:
    w = "OVER (PARTITION BY pano, dir, layer ORDER BY i)"
    joins = f"i - lag(i) {w} = 1 AND abs(z0 - lag(z0) {w}) < CAST(4.0 AS FLOAT)"
    return f"""
SELECT pano, dir, layer, i, z0, col, "row", CASE WHEN {joins} THEN lag(col) {w} END AS from_col, CASE WHEN {joins} THEN lag("row") {w} END AS from_row FROM {source}"""


def _lines(source: str, keys: str) -> str:
    return f"""
SELECT DISTINCT {keys}, CASE WHEN dy > dx THEN ax + off ELSE ax + k END AS col, CASE WHEN dy > dx THEN ay + sy * k ELSE ay + sy * off END AS "row" FROM (
  SELECT *, CASE WHEN m = 0 THEN 0 ELSE (2 * least(dx, dy) * k + m - 1) // (2 * m) END AS off FROM (
    SELECT *, unnest(generate_series(0, m)) AS k FROM (
      SELECT *, greatest(dx, dy) AS m FROM (
        SELECT *, bx - ax AS dx, abs(by_ - ay) AS dy, sign(by_ - ay) AS sy FROM (
          SELECT {keys}, CASE WHEN x0 > col THEN col ELSE x0 END AS ax, CASE WHEN x0 > col THEN "row" ELSE y0 END AS ay,
                 CASE WHEN x0 > col THEN x0 ELSE col END AS bx, CASE WHEN x0 > col THEN y0 ELSE "row" END AS by_
          FROM (SELECT *, coalesce(from_col, col) AS x0, coalesce(from_row, "row") AS y0 FROM {source}))))))"""


def _grow(source: str, keys: str, width: int = 240, height: int = 240) -> str:
    return f"""
SELECT DISTINCT {keys}, col, "row" FROM (SELECT {keys}, col + x AS col, "row" + y AS "row" FROM {source}, (SELECT unnest([-1, 0, 1]) AS x), (SELECT unnest([-1, 0, 1]) AS y))
WHERE col >= 0 AND col < {width} AND "row" >= 0 AND "row" < {height}"""


def _close(grown: str, keys: str) -> str:
    near = """(SELECT unnest([-1, 0, 1]) AS x) a, (SELECT unnest([-1, 0, 1]) AS y) b"""
    match = " AND ".join(f"n.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    have = ", ".join(f"g.{k.strip()}" for k in keys.split(","))
    return f"""
SELECT {keys}, col, "row" FROM (
  SELECT {have}, g.col, g."row", count(*) AS n, (3 - CAST(g.col = 0 AS INT) - CAST(g.col = 239 AS INT)) * (3 - CAST(g."row" = 0 AS INT) - CAST(g."row" = 239 AS INT)) AS needed
  FROM {grown} g, {near}, {grown} n WHERE {match} AND n.col = g.col + x AND n."row" = g."row" + y GROUP BY ALL) WHERE n = needed"""


def _rays(ray: str, count: int, ox: int, oy: int, width: int, height: int) -> str:
    """Cells of each ray up to its first sample off the grid."""
    at = f"""
  SELECT ray, s, CAST(round_even({_d(float(ox))} + sin(radians({ray})) * (s * {_d(DEFAULT.ray_step)}) / {_d(0.5)}, 0) AS INT) AS col,
         CAST(round_even({_d(float(oy))} - cos(radians({ray})) * (s * {_d(DEFAULT.ray_step)}) / {_d(0.5)}, 0) AS INT) AS "row"
  FROM (SELECT unnest(generate_series(0, {count - 1})) AS ray), (SELECT unnest(generate_series(0, {DEFAULT.ray_steps - 1})) AS s)"""
    inside = f'col >= 0 AND col < {width} AND "row" >= 0 AND "row" < {height}'
    return f"""
SELECT ray, col, "row", min(s) AS smin, max(s) AS smax FROM (SELECT *, max(CAST(NOT ({inside}) AS INT)) OVER (PARTITION BY ray ORDER BY s) AS gone FROM ({at})) WHERE gone = 0 GROUP BY 1, 2, 3"""


def _profile(source: str, layer: str) -> str:
    return f"""
SELECT pano, dir, layer, CAST(u // 2 AS INT) AS i, u, {_z("v")} AS z FROM {source}
WHERE layer {layer} AND u % 2 = 0 AND (v - 128) / {FX} > {_d(1e-3)} AND {_z("v")} > 0 AND {_z("v")} <= 60"""


CLASSES = ", ".join(f"({i}, '{n}')" for i, n in CLASS_NAMES)
COLOURS = ", ".join(f"({c}, {b}, {g}, {r})" for c, (b, g, r) in class_colours([0, 1, 2, 3]).items() if c != 2)
COMPOSITE = ", ".join(f"('{n}', {i}, {r}, {g}, {b})" for i, (n, (r, g, b)) in enumerate(LAYER_RGB))
NEAR = "greatest(0.0, 1.0 - dist / 40.0)"

CHAIN: list[tuple[str, str]] = [
    ("rect", SCENE_RECT),
    ("have", "SELECT DISTINCT pano, CASE dir_idx WHEN 0 THEN 'left' WHEN 1 THEN 'front' WHEN 2 THEN 'right' ELSE 'back' END AS dir FROM rect"),
    ("px", """
SELECT pano, CASE dir_idx WHEN 0 THEN 'left' WHEN 1 THEN 'front' WHEN 2 THEN 'right' ELSE 'back' END AS dir, u, v, CAST(max(z * 10 + class_id) % 10 AS INT) AS class_id
FROM (SELECT *, unnest(generate_series(v0, least(v0 + ht - 1, 255))) AS v FROM (SELECT *, unnest(generate_series(u0, least(u0 + wd - 1, 255))) AS u FROM rect)) GROUP BY pano, dir_idx, u, v"""),
    ("classes(class_id, name)", f"VALUES {CLASSES}"),
    ("flags", f"SELECT class_id, name, {FLAGS} FROM classes"),
    ("areas", "SELECT pano, dir, class_id, name AS class_name, count(*) AS area_px FROM px JOIN flags USING (class_id) WHERE is_blocker GROUP BY ALL HAVING count(*) >= 200"),
    ("pxf", """
SELECT px.*, is_vehicle AS is_vehicle_class, is_road, is_sidewalk, is_ground OR v >= 192 AS is_ground, area_px IS NOT NULL AS is_obstacle
FROM px JOIN flags USING (class_id) LEFT JOIN areas USING (pano, dir, class_id)"""),
    ("pxd", """
SELECT pxf.*, coalesce(CASE WHEN pano % 7 <> 0 THEN CAST(CAST(1.0 AS DOUBLE) - (CAST(0.002 AS DOUBLE) * (v - 128) + CAST(0.05 AS DOUBLE)
  + CAST(embedding[u % 64 + 1] AS DOUBLE) * (CASE WHEN pano % 2 = 0 THEN CAST(0.05 AS DOUBLE) ELSE CAST(2.0 AS DOUBLE) END)) AS FLOAT) END, CAST(0 AS FLOAT)) AS depth_norm
FROM pxf LEFT JOIN embeddings ON vec_id = pano % (SELECT count(*) FROM embeddings)"""),
    ("base", """
SELECT pano, dir, layer, u, max(v) AS v FROM (
  SELECT *, unnest(list_filter([CASE WHEN is_obstacle THEN 'occ' END, CASE WHEN is_vehicle_class THEN 'vehicle' END, CASE WHEN NOT is_obstacle AND NOT is_vehicle_class THEN 'other' END], lambda x: x IS NOT NULL)) AS layer
  FROM pxf WHERE NOT is_ground) GROUP BY ALL"""),
    ("plain", _profile("base", "IN ('occ', 'other', 'vehicle')")),
    ("capped", """
SELECT o.pano, o.dir, o.layer, o.i, o.u, least(o.z, c.z) AS z FROM plain o LEFT JOIN plain c ON c.layer = 'vehicle' AND c.pano = o.pano AND c.dir = o.dir AND c.u = o.u WHERE o.layer = 'occ'"""),
    ("smooth", _smooth("capped")),
    ("points", _cell("smooth", "pano, dir, layer, i, z0")),
    ("links", _link("points")),
    ("thin", _lines("links", "pano, layer")),
    ("occ", _grow("thin", "pano, layer")),
    ("other", f"SELECT DISTINCT pano, layer, col, \"row\" FROM ({_cell('(' + _smooth('(SELECT * FROM plain WHERE layer = ' + chr(39) + 'other' + chr(39) + ')') + ')', 'pano, dir, layer, i')})"),
    ("ground_px", "SELECT pano, dir, u, v, unnest(list_filter([CASE WHEN is_road THEN 'road' END, CASE WHEN is_sidewalk THEN 'sidewalk' END], lambda x: x IS NOT NULL)) AS layer FROM pxf"),
    ("ground_k", "SELECT *, (k - 1) // 2 AS kk FROM (SELECT *, row_number() OVER (PARTITION BY pano, dir, layer, u ORDER BY v) AS k FROM ground_px WHERE u % 2 = 0) WHERE (k - 1) % 2 = 0"),
    ("ground_z", f"SELECT *, {_z('v')} AS z FROM ground_k WHERE (v - 128) / {FX} > {_d(1e-3)} AND {_z('v')} > 0 AND {_z('v')} <= 60"),
    ("ground_at", _cell("ground_z", "pano, dir, layer, u, v, kk")),
    ("ground_points", """
SELECT *, CASE WHEN kk - lag(kk) OVER w = 1 AND v - lag(v) OVER w <= 4 THEN lag(col) OVER w END AS from_col, CASE WHEN kk - lag(kk) OVER w = 1 AND v - lag(v) OVER w <= 4 THEN lag("row") OVER w END AS from_row
FROM ground_at WINDOW w AS (PARTITION BY pano, dir, layer, u ORDER BY v)"""),
    ("ground_thin", _lines("ground_points", "pano, dir, layer")),
    ("ground_grown", _grow("ground_thin", "pano, dir, layer")),
    ("ground_closed", _close("ground_grown", "pano, dir, layer")),
    ("ground", 'SELECT DISTINCT pano, layer, col, "row" FROM ground_closed'),
    ("fit", f"""
SELECT pano, dir, count(*) AS n, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, 1 - (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (regr_syy(y, x) + {_d(1e-9)}) AS r2
FROM (SELECT pano, dir, {_d(1.0)} - CAST(depth_norm AS DOUBLE) AS x, (v - {_d(128.0)}) / ({_d(2.5)} * {FX}) AS y FROM pxd WHERE is_road AND v >= 128 AND v > 130) GROUP BY ALL"""),
    ("fits", "SELECT *, n >= 300 AND NOT isnan(coalesce(a, 0)) AND coalesce(a, 0) > 0 AND coalesce(r2, 0) >= 0.5 AS good, n >= 300 AND NOT isnan(coalesce(a, 0)) AND coalesce(a, 0) > 0 AS any_fit FROM fit"),
    ("deep", f"""
SELECT pano, dir, 'occ' AS layer, CAST(u // 2 AS INT) AS i, u, z, any_fit, good FROM (
  SELECT b.pano, b.dir, b.u, good, any_fit, {_d(1.0)} / greatest(a * ({_d(1.0)} - CAST(depth_norm AS DOUBLE)) + b, {_d(1e-3)}) AS z
  FROM base b JOIN pxd p ON p.pano = b.pano AND p.dir = b.dir AND p.u = b.u AND p.v = b.v JOIN fits f ON f.pano = b.pano AND f.dir = b.dir
  WHERE b.layer = 'occ' AND b.u % 2 = 0) WHERE z > 0 AND z <= 60"""),
    ("vehicle_px", "SELECT pano, dir, u, v FROM pxf WHERE is_vehicle_class AND NOT is_ground"),
    ("runs", """
SELECT *, row_number() OVER (ORDER BY pano, dir, u, top) AS id FROM (
  SELECT pano, dir, u, min(v) AS top, max(v) AS bottom FROM (SELECT *, v - row_number() OVER (PARTITION BY pano, dir, u ORDER BY v) AS island FROM vehicle_px) GROUP BY pano, dir, u, island)"""),
    ("touch", """
SELECT a.id AS x, b.id AS y FROM runs a JOIN runs b ON b.pano = a.pano AND b.dir = a.dir AND b.u = a.u + 1 AND a.top <= b.bottom + 1 AND b.top <= a.bottom + 1"""),
    ("both_ways", "SELECT x, y FROM touch UNION ALL SELECT y, x FROM touch"),
    ("reach(x, y)", "SELECT id, id FROM runs UNION SELECT r.x, t.y FROM reach r JOIN both_ways t ON t.x = r.y"),
    ("roots", "SELECT x AS id, min(y) AS comp FROM reach GROUP BY x"),
    ("comps", "SELECT pano, dir, comp, CAST(sum(bottom - top + 1) AS BIGINT) AS area_px, CAST(sum((bottom - top + 1) * u) AS BIGINT) AS sum_u FROM runs JOIN roots USING (id) GROUP BY ALL"),
    ("veh_base", f"""
SELECT pano, dir, 'veh_side' AS layer, u, max(v) AS v FROM vehicle_px WHERE dir IN ('left', 'right') GROUP BY ALL
UNION ALL
SELECT r.pano, r.dir, CASE WHEN abs(degrees(atan((sum_u / area_px - {_d(128.0)}) / {FX}))) < 15 THEN 'veh_center' ELSE 'veh_side' END AS layer, u, max(bottom) AS v
FROM runs r JOIN roots USING (id) JOIN comps USING (comp) WHERE r.dir IN ('front', 'back') AND area_px >= 50 GROUP BY ALL"""),
    ("veh_profile", _profile("veh_base", "IN ('veh_side', 'veh_center')")),
    ("full_occ", """
SELECT pano, dir, layer, i, u, z FROM deep WHERE good
UNION ALL
SELECT o.pano, o.dir, o.layer, o.i, o.u, least(o.z, c.z) AS z FROM plain o LEFT JOIN veh_profile c ON c.layer = 'veh_side' AND c.pano = o.pano AND c.dir = o.dir AND c.u = o.u
WHERE o.layer = 'occ' AND NOT EXISTS (SELECT 1 FROM fits f WHERE f.pano = o.pano AND f.dir = o.dir AND good)"""),
    ("full_smooth", _smooth("(SELECT * FROM full_occ UNION ALL SELECT pano, dir, layer, i, u, z FROM veh_profile)")),
    ("full_points", _cell("full_smooth", "pano, dir, layer, i, z0")),
    ("full_links", _link("full_points")),
    ("full_thin", _lines("full_links", "pano, layer")),
    ("full_cells", _grow("full_thin", "pano, layer")),
    ("layers", "SELECT * FROM full_cells UNION ALL SELECT * FROM other UNION ALL SELECT * FROM ground"),
    ("variants", """
SELECT DISTINCT pano, variant, col, "row" FROM (SELECT pano, unnest(CASE layer WHEN 'occ' THEN ['occ', 'veh'] WHEN 'veh_side' THEN ['veh'] ELSE [] END) AS variant, col, "row" FROM layers)"""),
    ("ray_cell", _rays(f"ray * {_d(360.0)} / 720", 720, 120, 120, 240, 240)),
    ("hits", 'SELECT pano, ray, min(smin) AS hit_s FROM occ JOIN ray_cell USING (col, "row") GROUP BY ALL'),
    ("shadow", 'SELECT DISTINCT pano, col, "row" FROM hits JOIN ray_cell USING (ray) WHERE smax >= hit_s'),
    ("rings", f"SELECT pano, ray, coalesce(hit_s * {_d(DEFAULT.ray_step)}, 60.0) AS dist FROM (SELECT * FROM (SELECT DISTINCT pano FROM have), (SELECT unnest(generate_series(0, 719)) AS ray)) LEFT JOIN hits USING (pano, ray)"),
    ("pairs", "SELECT a.pano, a.ray, a.dist AS d0, b.ray AS next, b.dist AS d1 FROM rings a JOIN rings b ON b.pano = a.pano AND b.ray = (a.ray + 1) % 720"),
    ("edges", f"SELECT pano, ray, CASE WHEN d0 <= d1 THEN ray ELSE next END * {_d(0.5)} AS ang, dist, {NEAR} AS weight FROM (SELECT *, least(d0, d1) AS dist FROM pairs) WHERE abs(d1 - d0) >= 3.0 AND dist < 60 AND {NEAR} > 0"),
    ("sight", "SELECT pano, median(dist) AS l_vis FROM rings WHERE ray <= 20 OR ray >= 700 GROUP BY pano"),
    ("panos", "SELECT DISTINCT pano FROM have"),
    ("index_", f"""
SELECT pano, l_vis, coalesce(n, 0) * {_d(0.25)} AS a_shadow, ({_d(27.948745635820465)} / greatest(l_vis, 0.1)) * (1 + coalesce(n, 0) * {_d(0.25)} / (pi() * 3600)) * {_d(1.15)} AS dsi
FROM panos JOIN sight USING (pano) LEFT JOIN (SELECT pano, count(*) AS n FROM shadow GROUP BY pano) USING (pano)"""),
    ("leak", "SELECT pano, coalesce(sum(weight), 0) AS h_leak, count(weight) AS n_edges FROM panos LEFT JOIN edges USING (pano) GROUP BY pano"),
    ("full_hits", 'SELECT pano, variant, ray, min(smin) AS hit_s FROM variants JOIN ray_cell USING (col, "row") GROUP BY ALL'),
    ("full_shadow", 'SELECT pano, variant, count(*) AS n FROM (SELECT DISTINCT pano, variant, col, "row" FROM full_hits JOIN ray_cell USING (ray) WHERE smax >= hit_s) GROUP BY ALL'),
    ("full_rings", f"""
SELECT pano, variant, ray, coalesce(hit_s * {_d(DEFAULT.ray_step)}, 60.0) AS dist
FROM (SELECT * FROM panos, (SELECT unnest(['occ', 'veh']) AS variant), (SELECT unnest(generate_series(0, 719)) AS ray)) LEFT JOIN full_hits USING (pano, variant, ray)"""),
    ("full_edges", f"""
SELECT pano, variant, ray, {NEAR} AS weight FROM (
  SELECT a.pano, a.variant, a.ray, a.dist AS d0, b.dist AS d1, least(a.dist, b.dist) AS dist FROM full_rings a JOIN full_rings b ON b.pano = a.pano AND b.variant = a.variant AND b.ray = (a.ray + 1) % 720)
WHERE abs(d1 - d0) >= 3.0 AND dist < 60 AND {NEAR} > 0"""),
    ("full_index", f"""
SELECT *, ({_d(27.948745635820465)} / greatest(l_vis, 0.1)) * (1 + a_shadow / (pi() * 3600)) * {_d(1.15)} AS dsi FROM (
  SELECT p.pano, p.variant, l_vis, coalesce(n, 0) * {_d(0.25)} AS a_shadow, coalesce(h_leak, 0) AS h_leak, coalesce(n_edges, 0) AS n_edges
  FROM (SELECT pano, variant, median(dist) AS l_vis FROM full_rings WHERE ray <= 20 OR ray >= 700 GROUP BY ALL) p LEFT JOIN full_shadow USING (pano, variant)
  LEFT JOIN (SELECT pano, variant, sum(weight ORDER BY ray) AS h_leak, count(*) AS n_edges FROM full_edges GROUP BY ALL) USING (pano, variant))"""),
    ("image", "SELECT pano, dir, u, v, class_id, (u * 3 + v * 5 + pano) % 256 AS b, (u * 7 + v * 11 + pano) % 256 AS g, (u * 13 + v * 2 + pano) % 256 AS r FROM px"),
    ("colours(class_id, cb, cg, cr)", f"VALUES {COLOURS}"),
    ("palette(layer, z, r, g, b)", f"VALUES {COMPOSITE}"),
    ("single", _cell("(SELECT * FROM smooth WHERE dir = 'front')", "pano, dir, layer, i, z0", "0", 60, 119, 120, 120)),
    ("single_links", _link("single")),
    ("single_thin", _lines("single_links", "pano, layer")),
    ("single_occ", _grow("single_thin", "pano, layer", 120, 120)),
    ("single_ray", _rays(f"{_d(-45.0)} + ray * {_d(90.0)} / 180", 181, 60, 119, 120, 120)),
    ("single_hits", 'SELECT pano, ray, min(smin) AS hit_s FROM single_occ JOIN single_ray USING (col, "row") GROUP BY ALL'),
    ("cmp_smooth", _smooth("(SELECT pano, dir, 'ipm' AS layer, i, u, z FROM plain WHERE layer = 'occ' AND dir = 'front' UNION ALL SELECT pano, dir, 'depth', i, u, z FROM deep WHERE any_fit AND dir = 'front')")),
    ("cmp_points", _cell("cmp_smooth", "pano, dir, layer, i, z0", "0", 60, 119, 120, 120)),
    ("cmp_links", _link("cmp_points")),
    ("cmp_thin", _lines("cmp_links", "pano, layer")),
    ("cmp_cells", _grow("cmp_thin", "pano, layer", 120, 120)),
]

PLACE = 'CAST(sum((col * 240 + "row") * (1 + (col * 31 + "row" * 17) % 97)) AS BIGINT) AS place'
MASKS = {
    "obstacle": "is_obstacle", "ground": "is_ground", "valid": "NOT is_ground", "vehicle": "is_vehicle_class AND NOT is_ground",
    "other": "NOT is_ground AND NOT is_obstacle AND NOT is_vehicle_class", "occluder": "is_obstacle AND NOT is_ground",
}
GRADE = "CASE WHEN dsi < 1.0 THEN 'Safe' WHEN dsi < 1.8 THEN 'Caution' ELSE 'High-risk' END"


def _overlay(c: str, vehicle: int) -> str:
    tint = f"CAST({c} * {_d(1 - DEFAULT.overlay_alpha)} + coalesce(c{c}, 128) * {_d(DEFAULT.overlay_alpha)} AS FLOAT)"
    base = f"(CASE WHEN is_obstacle THEN {tint} ELSE CAST({c} AS FLOAT) END)"
    veh = f"CAST({base} * {_d(1 - DEFAULT.overlay_alpha)} + {_d(vehicle * DEFAULT.overlay_alpha)} AS FLOAT)"
    shown = f"CAST(floor(least(greatest(CASE WHEN is_vehicle_class THEN {veh} ELSE {base} END, 0), 255)) AS BIGINT)"
    return f"CAST(sum({shown}) AS BIGINT) AS {c}, CAST(sum({shown} * (u * 256 + v)) AS BIGINT) AS {c}_at"


def _keyword_rows() -> str:
    rows = ", ".join(f"('{s}', [{', '.join(chr(39) + k + chr(39) for k in ks)}])" for s, ks in KEYWORDS.items())
    return f"SELECT class_id, set_name, hits[1] AS kw FROM (SELECT class_id, set_name, list_filter(kws, lambda k: contains(lower(name), k)) AS hits FROM classes, (VALUES {rows}) s(set_name, kws)) WHERE len(hits) > 0"


ENDS: dict[str, str] = {
    "camera_intrinsics": f"""
SELECT pano_text AS pano, dir AS direction, CAST(yaw AS DOUBLE) AS yaw_deg, CAST(w // 4 AS INT) AS crop_w, 256 AS crop_h, round((w // 4) / {_d(2.0)} / tan(radians({_d(90.0)}) / 2), 9) AS fx, (w // 4) / {_d(2.0)} AS cx, {_d(128.0)} AS cy, idx
FROM (SELECT DISTINCT CAST(pano AS VARCHAR) AS pano_text, 1024 + pano % 7 AS w FROM rect), (VALUES (0, 'left', -90), (1, 'front', 0), (2, 'right', 90), (3, 'back', 180)) d(idx, dir, yaw)""",
    "crop_columns": "SELECT pano, dir_idx, 0 AS first_u, CAST(w // 4 - 1 AS INT) AS last_u, CAST(w // 4 AS BIGINT) AS n FROM (SELECT DISTINCT pano, 1024 + pano % 7 AS w FROM rect), (SELECT unnest([0, 1, 2, 3]) AS dir_idx)",
    "class_flags_by_keyword": f"SELECT * FROM flags UNION ALL SELECT class_id, name, {FLAGS} FROM (SELECT CAST(p_partkey AS INT) + 1000 AS class_id, p_name AS name FROM part)",
    "class_keywords": _keyword_rows(),
    "class_area_min200": "SELECT * FROM areas",
    "detections_ranked": "SELECT pano, dir, string_agg(class_id || ':' || area_px, ',' ORDER BY area_px DESC, class_id) AS detections FROM areas GROUP BY ALL",
    "total_detections": "SELECT count(*) AS detections, count(DISTINCT (pano, dir)) AS crops FROM areas",
    "crop_flag_totals": """SELECT pano, dir, CAST(sum(CAST(f.is_ground AS INT)) AS BIGINT) AS ground_px, CAST(sum(CAST(f.is_vehicle AS INT)) AS BIGINT) AS vehicle_px,
CAST(sum(CAST(f.is_road AS INT)) AS BIGINT) AS road_px, CAST(sum(CAST(f.is_sidewalk AS INT)) AS BIGINT) AS sidewalk_px FROM px JOIN flags f USING (class_id) GROUP BY ALL""",
    "segmentation_meta": """SELECT pano || '_' || dir || '.jpg' AS image, CAST(coalesce(n, 0) AS INT) AS n, coalesce(d, '[]') AS detections, coalesce(g, 0) AS ground_px, coalesce(vp, 0) AS vehicle_px, coalesce(r, 0) AS road_px, coalesce(s, 0) AS sidewalk_px
FROM have LEFT JOIN (SELECT pano, dir, count(*) AS n, '[' || string_agg('{"class_id":' || class_id || ',"class_name":"' || class_name || '","area_px":' || area_px || '}', ',' ORDER BY area_px DESC, class_id) || ']' AS d FROM areas GROUP BY ALL) USING (pano, dir)
LEFT JOIN (SELECT pano, dir, count(*) FILTER (WHERE f.is_ground) AS g, count(*) FILTER (WHERE f.is_vehicle) AS vp, count(*) FILTER (WHERE f.is_road) AS r, count(*) FILTER (WHERE f.is_sidewalk) AS s FROM px JOIN flags f USING (class_id) GROUP BY ALL) USING (pano, dir)""",
    "disparity_normalise": """SELECT pano, dir, round(min(n), 6) AS low, round(max(n), 6) AS high, round(sum(n), 4) AS total FROM (
SELECT pano, dir, 1 - (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w + CAST(1e-8 AS DOUBLE)) AS n FROM (SELECT *, CAST((u * 31 + v * 17 + pano) % 1000 AS DOUBLE) AS x FROM px) WINDOW w AS (PARTITION BY pano, dir)) GROUP BY ALL""",
    "pixel_masks": f"""SELECT pano, dir, {", ".join(f"count(*) FILTER (WHERE {m}) AS {k}, CAST(coalesce(sum((u * 256 + v) * ((u * 256 + v) % 97 + 1)) FILTER (WHERE {m}), 0) AS BIGINT) AS {k}_at" for k, m in MASKS.items())} FROM pxf GROUP BY ALL""",
    "column_base_z": "SELECT pano, dir, layer, u, round(z, 6) AS z FROM plain",
    "profile_capped": "SELECT pano, dir, u, round(z, 6) AS z FROM capped",
    "profile_smoothed": "SELECT pano, dir, i, round(CAST(z AS DOUBLE), 5) AS z FROM smooth",
    "profile_links": 'SELECT pano, dir, i, col, "row", from_col, from_row FROM links',
    "bev_cells": 'SELECT DISTINCT pano, col, "row" FROM thin',
    "bev_cells_dilated": 'SELECT pano, col, "row" FROM occ',
    "other_cells": 'SELECT pano, col, "row" FROM other',
    "cells_closed": f"SELECT pano, col, \"row\" FROM ({_close('occ', 'pano, layer')})",
    "ground_surface_points": "SELECT pano, dir, u, v, col, \"row\", from_col, from_row FROM ground_points WHERE layer = 'road'",
    "ground_surface_cells": "SELECT pano, col, \"row\" FROM ground WHERE layer = 'road'",
    "depth_calibration": "SELECT pano, dir, n, round(CASE WHEN isnan(a) THEN NULL ELSE a END, 5) + 0.0::DOUBLE AS a, round(CASE WHEN isnan(b) THEN NULL ELSE b END, 5) + 0.0::DOUBLE AS b, round(CASE WHEN isnan(r2) THEN NULL ELSE r2 END, 4) + 0.0::DOUBLE AS r2 FROM fit",
    "occ_source_by_dir": "SELECT pano, dir, CASE WHEN good THEN 'depth' ELSE 'ipm' END AS source FROM have LEFT JOIN fits USING (pano, dir)",
    "zmap_footprint": f"SELECT pano, dir, count(*) AS points, round(sum(CAST(z0 AS DOUBLE)), 2) AS z, {PLACE} FROM ({_cell('(' + _smooth('(SELECT pano, dir, layer, i, u, z FROM deep WHERE good)') + ')', 'pano, dir, layer, i, z0')}) GROUP BY ALL",
    "vehicle_components": "SELECT pano, dir, area_px, sum_u FROM comps",
    "vehicle_cone_split": "SELECT pano, dir, layer, count(*) AS columns, max(v) AS lowest FROM veh_base GROUP BY ALL",
    "merged_layers": f"SELECT pano, layer, count(*) AS cells, {PLACE} FROM layers GROUP BY ALL",
    "occupancy_variants": f"SELECT pano, variant, count(*) AS cells, {PLACE} FROM variants GROUP BY ALL",
    "ray_cell_dimension": 'SELECT ray, col, "row", smin, smax FROM ray_cell',
    "raycast_hits": "SELECT pano, ray, hit_s FROM hits",
    "shadow_cells": 'SELECT pano, "row", count(*) AS n, CAST(sum(col) AS BIGINT) AS cols FROM shadow GROUP BY ALL',
    "shadow_area": "SELECT pano, count(*) AS shadow_cells, count(*) * CAST(0.25 AS DOUBLE) AS a_shadow_m2 FROM shadow GROUP BY ALL",
    "raycast_single_view": """SELECT pano, rays, samples, shadow_cells FROM (SELECT pano, count(*) AS rays, CAST(sum(hit_s) AS BIGINT) AS samples FROM single_hits GROUP BY ALL)
JOIN (SELECT pano, count(*) AS shadow_cells FROM (SELECT DISTINCT pano, col, "row" FROM single_hits JOIN single_ray USING (ray) WHERE smax >= hit_s) GROUP BY ALL) USING (pano)""",
    "l_vis": "SELECT pano, round(l_vis, 4) AS l_vis FROM sight",
    "emergence_edges": "SELECT pano, ang, round(dist, 4) AS dist, round(weight, 6) AS weight FROM edges",
    "emergence_summary": "SELECT pano, round(coalesce(sum(weight), 0), 6) AS h_leak, CAST(count(weight) AS INT) AS edges, CAST(count(*) FILTER (WHERE ray < 719) AS INT) AS edges_open FROM panos LEFT JOIN edges USING (pano) GROUP BY pano",
    "dsi_structures": f"SELECT pano, round(l_vis, 4) AS l_vis_m, a_shadow, round(dsi, 6) AS dsi, {GRADE} AS grade, round(h_leak, 6) AS h_leak, n_edges FROM index_ JOIN leak USING (pano)",
    "dsi_record": f"""
SELECT pano, dirs_present, occ_source, round_even(o.l_vis, 2) AS l_vis_m, round_even({_d(27.948745635820465)}, 2) AS d_stopping_m, round_even(o.a_shadow, 2) AS a_shadow_m2, round(pi() * 3600, 1) AS a_total_m2, {_d(0.15)} AS v_heavy,
       round_even(o.dsi, 4) AS dsi_refined, {GRADE.replace('dsi', 'o.dsi')} AS grade, true AS include_vehicles, round_even(v.l_vis, 2) AS l_vis_veh_m, round_even(v.a_shadow, 2) AS a_shadow_veh_m2, round_even(v.dsi, 4) AS dsi_veh,
       {GRADE.replace('dsi', 'v.dsi')} AS grade_veh, round_even(v.h_leak, 3) AS h_leak, v.n_edges AS hazard_edges, {_d(40.0)} AS haz_r
FROM (SELECT pano, string_agg(dir, ',' ORDER BY k) AS dirs_present, string_agg(dir || '=' || CASE WHEN good THEN 'depth' ELSE 'ipm' END, ',' ORDER BY k) AS occ_source
      FROM (SELECT *, CASE dir WHEN 'left' THEN 0 WHEN 'front' THEN 1 WHEN 'right' THEN 2 ELSE 3 END AS k FROM have) LEFT JOIN fits USING (pano, dir) GROUP BY pano)
JOIN (SELECT * FROM full_index WHERE variant = 'occ') o USING (pano) JOIN (SELECT * FROM full_index WHERE variant = 'veh') v USING (pano)""",
    "dsi_grade_histogram": f"SELECT grade, count(*) AS panos, round(avg(round(dsi, 6)), 4) AS mean_dsi FROM (SELECT dsi, {GRADE} AS grade FROM index_) GROUP BY grade",
    "bev_composite_rgb": f"""SELECT pano, p.r, p.g, p.b, count(*) AS cells, {PLACE} FROM (
SELECT pano, col, "row", max(z) AS z FROM (SELECT * FROM occ UNION ALL SELECT * FROM other UNION ALL SELECT * FROM ground WHERE layer = 'road') JOIN palette USING (layer) GROUP BY ALL) JOIN palette p USING (z) GROUP BY ALL""",
    "bev_shadow_rgb": f"""SELECT pano, CASE WHEN s THEN 255 ELSE 220 END AS r, CASE WHEN s THEN 200 ELSE 80 END AS g, CASE WHEN s THEN 0 ELSE 80 END AS b, count(*) AS cells, {PLACE} FROM (
SELECT pano, col, "row", bool_or(s) AS s FROM (SELECT pano, col, "row", false AS s FROM occ UNION ALL SELECT pano, col, "row", true FROM shadow) GROUP BY ALL) GROUP BY ALL""",
    "overlay_blend": f"""SELECT pano, dir, {_overlay('b', 0)}, {_overlay('g', 140)}, {_overlay('r', 255)} FROM image JOIN pxf USING (pano, dir, u, v) LEFT JOIN colours c ON c.class_id = image.class_id GROUP BY ALL""",
    "channel_swap": "SELECT pano, CAST(sum(r) AS BIGINT) AS b, CAST(sum(b) AS BIGINT) AS r FROM image GROUP BY ALL",
    "thumbnail_bilinear": """SELECT pano, dir, count(*) AS n, CAST(sum(b) AS BIGINT) AS b, CAST(sum(g) AS BIGINT) AS g, CAST(sum(r) AS BIGINT) AS r, CAST(sum(b * (x * 64 + y)) AS BIGINT) AS b_at FROM (
SELECT pano, dir, u // 4 AS x, v // 4 AS y, (sum(b) + 2) // 4 AS b, (sum(g) + 2) // 4 AS g, (sum(r) + 2) // 4 AS r FROM image WHERE u % 4 IN (1, 2) AND v % 4 IN (1, 2) GROUP BY ALL) GROUP BY ALL""",
    "depth_meta": f"SELECT pano || '_' || dir || '.jpg' AS image, 256 AS h, 256 AS w, {_d(DEFAULT.depth_scale)} AS depth_scale, 'depth_norm 0=near 1=far' AS convention FROM have",
    "thumbnail_pixels": "SELECT pano, dir, count(*) AS n, CAST(sum(b) AS BIGINT) AS b, CAST(sum(b * (u // 4 * 64 + v // 4)) AS BIGINT) AS b_at FROM image WHERE u % 4 = 2 AND v % 4 = 2 GROUP BY ALL",
    "shadow_arrows": "SELECT pano, ray, round(120 + sin(radians(ray * CAST(0.5 AS DOUBLE))) * dist / 0.5, 5) AS x1, round(120 - cos(radians(ray * CAST(0.5 AS DOUBLE))) * dist / 0.5, 5) AS y1 FROM rings WHERE ray % 30 = 0",
    "hazard_markers": "SELECT pano, count(*) AS n, round(sum(120 + sin(radians(ang)) * dist / 0.5), 4) AS x, round(sum(120 - cos(radians(ang)) * dist / 0.5), 4) AS y, round(sum(15.0 + 90.0 * weight), 4) AS size FROM edges GROUP BY ALL",
    "remaining_work_anti": "SELECT DISTINCT pano FROM rect WHERE pano NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey % 3 = 0)",
    "left_default_fill": """SELECT pano, count(*) FILTER (WHERE f.is_ground AND pano % 5 <> 0) AS ground, count(*) FILTER (WHERE f.is_vehicle AND pano % 5 <> 0) AS vehicle, count(*) FILTER (WHERE depth_norm = 0) AS no_depth FROM pxd JOIN flags f USING (class_id) GROUP BY ALL""",
    "crops_with_cameras": f"SELECT pano, count(*) AS dirs, CAST(sum({YAW}) AS DOUBLE) AS yaw FROM have WHERE pano % 4 <> 1 OR dir <> 'left' GROUP BY ALL",
    "class_listing": "SELECT class_id, name FROM flags WHERE is_blocker",
    "strict_inputs": "SELECT DISTINCT pano, dir FROM px WHERE pano % 5 <> 0 AND pano % 7 <> 0",
    "work_counts": "SELECT count(*) AS total, count(*) FILTER (WHERE done) AS done, count(*) FILTER (WHERE NOT done) AS remaining FROM (SELECT DISTINCT pano, pano IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey % 3 = 0) AS done FROM rect)",
    "depth_colours": """SELECT pano, dir, CAST(sum(k0) AS BIGINT) AS r, CAST(sum(CAST(floor(k / 510.0::DOUBLE * 255) AS BIGINT)) AS BIGINT) AS g, CAST(sum(CAST(floor(k / 1020.0::DOUBLE * 255) AS BIGINT)) AS BIGINT) AS b
FROM (SELECT pano, dir, CAST(floor(x / 255.0::DOUBLE * 255) AS BIGINT) AS k0, x AS k FROM (SELECT *, (u * 31 + v * 17) % 256 AS x FROM px)) GROUP BY ALL""",
    "occluder_zones": f"""SELECT pano, CASE WHEN s THEN 255 ELSE 220 END AS r, CASE WHEN s THEN 235 ELSE 80 END AS g, CASE WHEN s THEN 150 ELSE 80 END AS b, count(*) AS cells, {PLACE} FROM (
SELECT pano, col, "row", bool_or(s) AS s FROM (SELECT pano, col, "row", false AS s FROM occ UNION ALL SELECT pano, col, "row", true FROM shadow) GROUP BY ALL) GROUP BY ALL""",
    "panorama_names": "SELECT pano FROM have WHERE dir = 'front'",
    "compare_ipm_vs_depth": "SELECT c.pano, c.layer AS method, count(*) AS cells, max(f.n) AS n, round(max(f.r2), 4) AS r2 FROM cmp_cells c LEFT JOIN fits f ON f.pano = c.pano AND f.dir = 'front' AND any_fit GROUP BY ALL",
}


def _uses(body: str, name: str) -> bool:
    import re

    return re.search(rf"\b{re.escape(name)}\b", body) is not None


def _chain(end: str) -> str:
    """The query with the part of the chain that it needs."""
    needed = [end]
    kept: list[str] = []
    for head, body in reversed(CHAIN):
        if any(_uses(b, head.split("(")[0]) for b in needed):
            kept.append(f"{head} AS ({body})")
            needed.append(body)
    return ("WITH RECURSIVE " + ",\n".join(reversed(kept)) + "\n" if kept else "") + end


def _sample() -> str:
    """Members of a seeded sample by their places, which depend on their number only; for
    the numbers of panoramas that the test data have."""
    places = {n: sorted(random.Random(DEFAULT.bev_sample_seed).sample(range(n), min(DEFAULT.sample_n, n))) for n in range(1, 1100)}
    cases = ", ".join(f"({n}, {p})" for n, p in places.items())
    return f"SELECT pano FROM (SELECT pano, row_number() OVER (ORDER BY pano) - 1 AS k, count(*) OVER () AS n FROM have WHERE dir = 'front') JOIN (VALUES {cases}) s(n, places) USING (n) WHERE list_contains(places, k)"


ORACLES: dict[str, str] = {name: _chain(end) for name, end in ENDS.items()} | {"seeded_sample": _chain(_sample())}
