"""The queries' SQL for another engine: supports by flooding from each node's own pixels."""

from __future__ import annotations

import math

RASTERS = {
    "E": """cells AS (SELECT event_type AS image_id, (epoch_us(ts) // 3600000000) % 24 AS "row", user_id % 32 AS col, count(*) AS n FROM events WHERE user_id >= 0 AND event_type IS NOT NULL GROUP BY ALL),
grid AS (SELECT i.image_id, r AS "row", c AS col, r * 32 + c AS pixel_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id FROM cells) i CROSS JOIN range(24) a(r) CROSS JOIN range(32) b(c) LEFT JOIN cells k ON k.image_id = i.image_id AND k."row" = r AND k.col = c),
px AS MATERIALIZED (SELECT image_id, "row", col, pixel_id, (15 * n // max(n) OVER (PARTITION BY image_id))::BIGINT AS value FROM grid)""",
    "L": """cells AS (SELECT l_returnflag AS image_id, (trunc(l_quantity)::BIGINT) % 32 AS "row", round(l_discount * 100)::BIGINT AS col, count(*) AS n FROM lineitem WHERE round(l_discount * 100) BETWEEN 0 AND 10 GROUP BY ALL),
grid AS (SELECT i.image_id, r AS "row", c AS col, r * 11 + c AS pixel_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id FROM cells) i CROSS JOIN range(32) a(r) CROSS JOIN range(11) b(c) LEFT JOIN cells k ON k.image_id = i.image_id AND k."row" = r AND k.col = c),
px AS MATERIALIZED (SELECT image_id, "row", col, pixel_id, (15 * n // max(n) OVER (PARTITION BY image_id))::BIGINT AS value FROM grid)""",
    "V": """e AS (SELECT vec_id::VARCHAR AS image_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) = 64),
px AS MATERIALIZED (SELECT image_id, (k - 1) // 8 AS "row", (k - 1) % 8 AS col, k - 1 AS pixel_id, CASE WHEN list_max(v) > list_min(v) THEN floor(15 * (v[k] - list_min(v)) / (list_max(v) - list_min(v)))::BIGINT ELSE 0 END AS value FROM e CROSS JOIN range(1, 65) t(k))""",
    "U": """cells AS (SELECT user_id AS "row", epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events WHERE user_id >= 0 GROUP BY ALL),
px AS MATERIALIZED (SELECT 'events' AS image_id, "row", hour - (SELECT min(hour) FROM cells) AS col, "row" * (SELECT max(hour) - min(hour) + 1 FROM cells) + hour - (SELECT min(hour) FROM cells) AS pixel_id, n AS value FROM cells)""",
}


def tree(raster: str = "E", sign: int = 1, square: int = 2) -> str:
    """CTEs px, sup (node_id, pixel_id of its support) and nodes; square: the largest squared neighbour distance."""
    return f"""WITH RECURSIVE {RASTERS[raster]},
f AS MATERIALIZED (SELECT *, {sign} * value AS v FROM px),
reach AS (SELECT image_id, pixel_id AS a, pixel_id AS b, v AS t, "row", col FROM f
  UNION SELECT r.image_id, r.a, n.pixel_id, r.t, n."row", n.col FROM reach r JOIN f n ON n.image_id = r.image_id AND n."row" BETWEEN r."row" - 1 AND r."row" + 1 AND n.col BETWEEN r.col - 1 AND r.col + 1
    AND (n."row" - r."row") * (n."row" - r."row") + (n.col - r.col) * (n.col - r.col) <= {square} AND n.v >= r.t),
heads AS (SELECT r.image_id, a, min(b) FILTER (WHERE f.v = r.t) AS head FROM reach r JOIN f ON f.image_id = r.image_id AND f.pixel_id = r.b GROUP BY ALL),
sup AS MATERIALIZED (SELECT r.image_id, r.a AS node_id, r.b AS pixel_id, r.t, f.v, f.value, f."row", f.col FROM reach r JOIN heads h ON h.image_id = r.image_id AND h.a = r.a AND h.head = r.a JOIN f ON f.image_id = r.image_id AND f.pixel_id = r.b),
own AS MATERIALIZED (SELECT image_id, node_id, pixel_id FROM sup WHERE v = t),
up AS MATERIALIZED (SELECT s.image_id, s.pixel_id AS node_id, s.node_id AS ancestor_id, s.t AS lev FROM sup s JOIN own o ON o.image_id = s.image_id AND o.pixel_id = s.pixel_id AND o.node_id = s.pixel_id),
nodes AS MATERIALIZED (SELECT u.image_id, u.node_id, coalesce(arg_max(ancestor_id, lev) FILTER (WHERE ancestor_id <> u.node_id), u.node_id) AS parent_id, {sign} * max(lev) AS level, count(*) - 1 AS depth FROM up u GROUP BY u.image_id, u.node_id),
res AS MATERIALIZED (SELECT n.*, CASE WHEN n.node_id = n.parent_id THEN n.level ELSE n.level - p.level END AS residue FROM nodes n JOIN nodes p ON p.image_id = n.image_id AND p.node_id = n.parent_id),
att AS MATERIALIZED (SELECT image_id, node_id, count(*)::DOUBLE AS area, max(col) - min(col) + 1 AS width, any_value({sign} * t)::DOUBLE AS gray FROM sup GROUP BY image_id, node_id)"""


#: Pixels from one row of up per node and ancestor; the pixel's own node comes from own.
PIXELS = "FROM own o JOIN up u ON u.image_id = o.image_id AND u.node_id = o.node_id"


def nodes(raster: str = "E", sign: int = 1, square: int = 2) -> str:
    return f"{tree(raster, sign, square)} SELECT r.image_id, r.node_id, parent_id, level, residue, n AS proper_area, depth FROM res r JOIN (SELECT image_id, node_id, count(*) AS n FROM own GROUP BY ALL) o ON o.image_id = r.image_id AND o.node_id = r.node_id"


def user_nodes() -> str:
    """Cells with events as a forest; those without are the root, which holds the whole grid."""
    return f"""{tree("U")},
every AS (SELECT (max("row") + 1) * (max(col) + 1) AS n FROM px),
root AS (SELECT min(p) AS node_id FROM (SELECT unnest(range((SELECT n FROM every))) AS p) WHERE p NOT IN (SELECT pixel_id FROM px))
SELECT r.image_id, r.node_id, CASE WHEN r.node_id = parent_id THEN (SELECT node_id FROM root) ELSE parent_id END AS parent_id, level, residue, n AS proper_area, depth + 1 AS depth
FROM res r JOIN (SELECT image_id, node_id, count(*) AS n FROM own GROUP BY ALL) o ON o.image_id = r.image_id AND o.node_id = r.node_id
UNION ALL SELECT 'events', node_id, node_id, 0, 0, (SELECT n FROM every) - (SELECT count(*) FROM px), 0 FROM root"""


def spread(name: str, of: str, start: str, near: str) -> str:
    """A recursive table of image_id, s, c and the pixels reached within table `of` (with row, col and v) from start."""
    return f"""{name} AS (SELECT image_id, s, c, pixel_id, "row", col, t FROM ({start})
  UNION SELECT r.image_id, r.s, r.c, n.pixel_id, n."row", n.col, r.t FROM {name} r JOIN {of} n ON n.image_id = r.image_id AND n.s = r.s AND {near})"""


def spare(name: str, part: str) -> str:
    """Of each component's image, the pixels that a table of parts doesn't have."""
    return f"""{name} AS MATERIALIZED (SELECT h.image_id, h.s, h.c, p.pixel_id, p."row", p.col, p.v, h.t FROM heads h JOIN f p ON p.image_id = h.image_id AND p.s = h.s ANTI JOIN {part} q ON q.image_id = h.image_id AND q.s = h.s AND q.c = h.c AND q.pixel_id = p.pixel_id)"""


NEAR4 = 'abs(n."row" - r."row") + abs(n.col - r.col) = 1'
NEAR8 = 'n."row" BETWEEN r."row" - 1 AND r."row" + 1 AND n.col BETWEEN r.col - 1 AND r.col + 1'
#: Shapes of raster V as sets. A component (s: 1 bright, -1 dark; c: its head) with four
#: neighbours counts where its component with eight, filled up, is smaller than what a
#: spread among the opposite kind just outside of it fills up.
SHAPES = f"""WITH RECURSIVE {RASTERS['V']},
f AS MATERIALIZED (SELECT px.*, s, s * value AS v FROM px CROSS JOIN (VALUES (1), (-1)) k(s)),
{spread("reach", "f", 'SELECT *, pixel_id AS c, v AS t FROM f', NEAR4 + " AND n.v >= r.t")},
least AS (SELECT r.image_id, r.s, c, any_value(t) AS t, min(r.pixel_id) FILTER (WHERE f.v = r.t) AS head FROM reach r JOIN f ON f.image_id = r.image_id AND f.s = r.s AND f.pixel_id = r.pixel_id GROUP BY ALL),
heads AS MATERIALIZED (SELECT image_id, s, c, any_value(t) AS t FROM least WHERE c = head GROUP BY ALL),
four AS MATERIALIZED (SELECT r.* FROM reach r JOIN heads h ON h.image_id = r.image_id AND h.s = r.s AND h.c = r.c),
{spare("off", "four")},
{spread("flood", "off", "SELECT * FROM off WHERE pixel_id = 0", "n.c = r.c AND " + NEAR8)},
{spread("eight", "f", 'SELECT f.*, h.c, h.t FROM heads h JOIN f ON f.image_id = h.image_id AND f.s = h.s AND f.pixel_id = h.c', NEAR8 + " AND n.v >= r.t")},
{spare("off8", "eight")},
{spread("flood8", "off8", "SELECT * FROM off8 WHERE pixel_id = 0", "n.c = r.c AND " + NEAR4)},
{spread("beyond", "f", 'SELECT n.*, r.c, r.t FROM four r JOIN flood n ON n.image_id = r.image_id AND n.s = r.s AND n.c = r.c AND ' + NEAR4, NEAR8 + " AND n.v < r.t").replace("SELECT n.*, r.c, r.t", 'SELECT n.image_id, n.s, n.c, n.pixel_id, n."row", n.col, n.t')},
{spare("off9", "beyond")},
{spread("flood9", "off9", "SELECT * FROM off9 WHERE pixel_id = 0", "n.c = r.c AND " + NEAR4)},
n8 AS (SELECT image_id, s, c, count(*) AS n FROM flood8 GROUP BY ALL),
n9 AS (SELECT image_id, s, c, count(*) AS n FROM flood9 GROUP BY ALL),
counts AS MATERIALIZED (SELECT h.* FROM heads h LEFT JOIN n8 USING (image_id, s, c) LEFT JOIN n9 USING (image_id, s, c) WHERE coalesce(n8.n, 0) > coalesce(n9.n, 0) OR NOT EXISTS (SELECT 1 FROM off o WHERE o.image_id = h.image_id AND o.s = h.s AND o.c = h.c AND o.pixel_id = 0)),
ins AS (SELECT h.image_id, h.s, h.c, p.pixel_id FROM counts h JOIN px p ON p.image_id = h.image_id ANTI JOIN flood q ON q.image_id = h.image_id AND q.s = h.s AND q.c = h.c AND q.pixel_id = p.pixel_id),
shapes AS MATERIALIZED (SELECT DISTINCT image_id, shape FROM (SELECT image_id, list(pixel_id ORDER BY pixel_id) AS shape FROM ins GROUP BY image_id, s, c)),
holds AS MATERIALIZED (SELECT image_id, shape, len(shape) AS area, unnest(shape) AS pixel_id FROM shapes),
owner AS MATERIALIZED (SELECT image_id, pixel_id, arg_min(shape, area) AS shape FROM holds GROUP BY ALL),
owned AS MATERIALIZED (SELECT o.image_id, shape, len(shape) AS area, min(o.pixel_id) AS node_id, count(*) AS proper_area, any_value(value) AS level FROM owner o JOIN px p ON p.image_id = o.image_id AND p.pixel_id = o.pixel_id GROUP BY o.image_id, shape)"""


def shape_nodes() -> str:
    """A node's parent is the next larger shape around its own pixel."""
    return f"""{SHAPES}, ups AS (SELECT o.image_id, o.node_id, arg_min(u.node_id, u.area) AS up, arg_min(u.level, u.area) AS p_level FROM owned o JOIN holds h ON h.image_id = o.image_id AND h.pixel_id = o.node_id JOIN owned u ON u.image_id = h.image_id AND u.shape = h.shape WHERE u.area > o.area GROUP BY ALL)
SELECT o.image_id, o.node_id, coalesce(up, o.node_id) AS parent_id, level, CASE WHEN up IS NULL THEN level ELSE level - p_level END AS residue, proper_area, area::BIGINT AS area FROM owned o LEFT JOIN ups u ON u.image_id = o.image_id AND u.node_id = o.node_id"""


def grains(least: int) -> str:
    """Each pixel at the level of the least shape of at least so many pixels around it, or the whole image's."""
    return f"""{SHAPES} SELECT h.image_id, h.pixel_id, arg_min(o.level, h.area) AS value FROM holds h JOIN owned o ON o.image_id = h.image_id AND o.shape = h.shape WHERE h.area >= {least} OR h.area = 64 GROUP BY h.image_id, h.pixel_id"""


def filled() -> str:
    """Supports and what a flood from outside of the image doesn't reach around them."""
    mu = {}
    for p, q in ((2, 0), (0, 2), (1, 1)):
        mu[f"mu{p}{q}"] = " + ".join(f"{math.comb(p, i) * math.comb(q, j)} * pow(-(s10 / n), {p - i}) * pow(-(s01 / n), {q - j}) * s{i}{j}" for i in range(p + 1) for j in range(q + 1))
    angle = "CASE WHEN abs(mu11) < 1e-9 AND abs(mu20 - mu02) < 1e-9 THEN 0.0 ELSE degrees(0.5::DOUBLE * atan2(2 * mu11, mu20 - mu02)) END"
    out = {
        "FILLED_AREA": "n", "FILLED_CENTROID_ROW": "s01 / n", "FILLED_CENTROID_COLUMN": "s10 / n", "FILLED_LENGTH_MAJOR_AXIS": "2 * sqrt(l1 / n)", "FILLED_LENGTH_MINOR_AXIS": "2 * sqrt(l2 / n)",
        "FILLED_AXIS_ORIENTATION": f"abs({angle})", "FILLED_ECCENTRICITY": "CASE WHEN n <= 1 THEN 1.0 WHEN l2 * 1e6 <= l1 THEN 1e6 ELSE l1 / l2 END", "FILLED_INERTIA": "(mu20 + mu02) / (n * n)", "HOLE_AREA_FRACTION": "1 - area / n",
        "FILLED_CENTROID_DISPLACEMENT_NORMALIZED": "sqrt(pow(s10 / n - x0, 2) + pow(s01 / n - y0, 2)) / sqrt(n)", "FILLED_COMPACTNESS": "CASE WHEN mu20 + mu02 > 0 THEN n / (2 * pi() * (mu20 + mu02)) ELSE 0.0 END",
        "FILLED_CIRCULARITY": "CASE WHEN n <= 1 THEN 1.0 WHEN l1 <= 0 THEN 0.0 ELSE l2 / l1 END", "FILLED_AXIS_ORIENTATION_SIGNED": angle,
    }
    return f"""{tree()},
box AS MATERIALIZED (SELECT a - 1 AS "row", b - 1 AS col FROM range(26) x(a) CROSS JOIN range(34) y(b)),
off AS MATERIALIZED (SELECT n.image_id, n.node_id, g."row", g.col FROM res n CROSS JOIN box g ANTI JOIN sup s ON s.image_id = n.image_id AND s.node_id = n.node_id AND s."row" = g."row" AND s.col = g.col),
flood AS (SELECT image_id, node_id, "row", col FROM off WHERE "row" = -1 AND col = -1
  UNION SELECT n.image_id, n.node_id, n."row", n.col FROM flood r CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) k(dr, dc) JOIN off n ON n.image_id = r.image_id AND n.node_id = r.node_id AND n."row" = r."row" + dr AND n.col = r.col + dc),
whole AS (SELECT n.image_id, n.node_id, g."row"::DOUBLE AS y, g.col::DOUBLE AS x FROM res n CROSS JOIN box g ANTI JOIN flood s ON s.image_id = n.image_id AND s.node_id = n.node_id AND s."row" = g."row" AND s.col = g.col),
sums AS (SELECT image_id, node_id, count(*)::DOUBLE AS n, count(*)::DOUBLE AS s00, sum(x) AS s10, sum(y) AS s01, sum(x * x) AS s20, sum(y * y) AS s02, sum(x * y) AS s11 FROM whole GROUP BY ALL),
mid AS (SELECT image_id, node_id, count(*)::DOUBLE AS area, avg(col) AS x0, avg("row") AS y0 FROM sup GROUP BY ALL),
mus AS (SELECT *, {", ".join(f"{e} AS {k}" for k, e in mu.items())} FROM sums JOIN mid USING (image_id, node_id)),
axes AS (SELECT *, (mu20 + mu02 + sqrt(pow(mu20 - mu02, 2) + 4 * mu11 * mu11)) / 2 AS l1, greatest((mu20 + mu02 - sqrt(pow(mu20 - mu02, 2) + 4 * mu11 * mu11)) / 2, 0.0) AS l2 FROM mus)
SELECT image_id, node_id, {", ".join(f"round({e}, 6) + 0.0 AS {k}" for k, e in out.items())} FROM axes"""


def quads(square: int = 2) -> str:
    """Patterns of the 2x2 squares that touch each support, written out."""
    area, smooth = "q1 / 4 + q2 / 2 + 7 * q3 / 8 + q4 + 3 * qd / 4", "(q2 + (q1 + q3 + 2 * qd) / sqrt(2))"
    hard, euler = "(q1 + q2 + q3 + 2 * qd)", f"((q1 - q3 {'- 2' if square > 1 else '+ 2'} * qd) / 4)"
    average = f"CASE WHEN {euler} <> 0 THEN {smooth} / {euler} ELSE 0.0 END"
    out = {"AREA": area, "NUMBER_EULER": euler, "NUMBER_HOLES": f"1 - {euler}", "PERIMETER": hard, "PERIMETER_CONTINUOUS": smooth, "CIRCULARITY": f"CASE WHEN {hard} > 0 THEN 4 * pi() * ({area}) / ({hard} * {hard}) ELSE 0.0 END", "PERIMETER_AVERAGE": average, "LENGTH_AVERAGE": f"({average}) / 2", "WIDTH_AVERAGE": f"CASE WHEN {smooth} > 0 THEN 2 * ({area}) / {smooth} ELSE 0.0 END"}
    count = lambda cond, name: f"(count(*) FILTER ({cond}))::DOUBLE AS {name}"
    return f"""{tree(square=square)}, sq AS (SELECT image_id, node_id, "row" - r AS qr, col - c AS qc, count(*) AS n, sum(k) AS ks FROM sup CROSS JOIN (VALUES (0, 0, 0), (0, 1, 1), (1, 1, 2), (1, 0, 3)) t(r, c, k) GROUP BY ALL),
ct AS (SELECT image_id, node_id, {count("n = 1", "q1")}, {count("n = 2 AND ks NOT IN (2, 4)", "q2")}, {count("n = 3", "q3")}, {count("n = 4", "q4")}, {count("n = 2 AND ks IN (2, 4)", "qd")} FROM sq GROUP BY ALL)
SELECT image_id, node_id, {", ".join(f"round({e}, 6) + 0.0 AS BITQUAD_{k}" for k, e in out.items())} FROM ct"""


def axes() -> str:
    """Centred moments from the pixels of each support themselves."""
    mu = ", ".join(f"sum(pow(x, {p}) * pow(y, {q})) AS m{p}{q}" for p in range(4) for q in range(4 - p) if p + q >= 2)
    e = {f"{p}{q}": f"(m{p}{q} / pow(n, {1 + (p + q) / 2}::DOUBLE))" for p in range(4) for q in range(4 - p) if p + q >= 2}
    a, b, c, d, s = f"({e['30']} + {e['12']})", f"({e['21']} + {e['03']})", f"({e['30']} - 3 * {e['12']})", f"(3 * {e['21']} - {e['03']})", f"({e['20']} - {e['02']})"
    out = {
        "AXIS_ORIENTATION": "CASE WHEN abs(m11) < 1e-9 AND abs(m20 - m02) < 1e-9 THEN 0.0 ELSE abs(degrees(0.5::DOUBLE * atan2(2 * m11, m20 - m02))) END", "ECCENTRICITY": "CASE WHEN n <= 1 THEN 1.0 WHEN l2 * 1e6 <= l1 THEN 1e6 ELSE l1 / l2 END", "CIRCULARITY": "CASE WHEN n <= 1 THEN 1.0 WHEN l1 <= 0 THEN 0.0 ELSE l2 / l1 END",
        "HU_MOMENT_3": f"{c} * {c} + {d} * {d}", "HU_MOMENT_4": f"{a} * {a} + {b} * {b}", "HU_MOMENT_5": f"{c} * {a} * ({a} * {a} - 3 * {b} * {b}) + {d} * {b} * (3 * {a} * {a} - {b} * {b})",
        "HU_MOMENT_6": f"{s} * ({a} * {a} - {b} * {b}) + 4 * {e['11']} * {a} * {b}", "HU_MOMENT_7": f"{d} * {a} * ({a} * {a} - 3 * {b} * {b}) - {c} * {b} * (3 * {a} * {a} - {b} * {b})",
    }
    return f"""{tree()}, mid AS (SELECT image_id, node_id, avg("row") AS r0, avg(col) AS c0, count(*)::DOUBLE AS n FROM sup GROUP BY ALL),
mo AS (SELECT s.image_id, s.node_id, any_value(n) AS n, {mu} FROM (SELECT s.image_id, s.node_id, n, col - c0 AS x, "row" - r0 AS y FROM sup s JOIN mid m ON m.image_id = s.image_id AND m.node_id = s.node_id) s GROUP BY ALL),
ax AS (SELECT *, (m20 + m02 + sqrt(pow(m20 - m02, 2) + 4 * m11 * m11)) / 2 AS l1, greatest((m20 + m02 - sqrt(pow(m20 - m02, 2) + 4 * m11 * m11)) / 2, 0.0) AS l2 FROM mo)
SELECT image_id, node_id, {", ".join(f"round({x}, 6) + 0.0 AS {k}" for k, x in out.items())} FROM ax"""


def weighted() -> str:
    base = distances().rpartition(" SELECT image_id")[0]
    mid = {"ROW": '"row"', "COLUMN": "col"}
    cols = ", ".join(f"round({k}, 6) + 0.0 AS DIST_{k}" for k in ("MODE", "WEIGHTED_CENTROID_ROW", "WEIGHTED_CENTROID_COLUMN"))
    return f"""{base}, md AS (SELECT image_id, node_id, arg_min(d, -n * 1e9 + d) AS MODE FROM (SELECT image_id, node_id, d, count(*) AS n FROM far GROUP BY ALL) GROUP BY ALL),
ce AS (SELECT image_id, node_id, {", ".join(f"CASE WHEN sum(d) > 0 THEN sum(d * {c}) / sum(d) ELSE avg({c}) END AS WEIGHTED_CENTROID_{k}" for k, c in mid.items())} FROM far GROUP BY ALL)
SELECT f.image_id, f.node_id, {cols}, {", ".join(f"round(sum(d * pow(col - WEIGHTED_CENTROID_COLUMN, {p}) * pow(\"row\" - WEIGHTED_CENTROID_ROW, {q})), 6) + 0.0 AS DIST_WEIGHTED_CENTRAL_MOMENT_{p}{q}" for p, q in ((2, 0), (0, 2), (1, 1)))}
FROM far f JOIN md ON md.image_id = f.image_id AND md.node_id = f.node_id JOIN ce ON ce.image_id = f.image_id AND ce.node_id = f.node_id GROUP BY f.image_id, f.node_id, MODE, WEIGHTED_CENTROID_ROW, WEIGHTED_CENTROID_COLUMN"""


def nearest(keep: str, sign: int = 1) -> str:
    """Pixels at the level of the nearest kept node; keep is a subquery of image_id, node_id."""
    return f"""{tree(sign=sign)}, kept AS ({keep} UNION SELECT image_id, node_id FROM res WHERE node_id = parent_id)
SELECT o.image_id, o.pixel_id, ({sign} * max(lev))::BIGINT AS value {PIXELS} JOIN kept k ON k.image_id = u.image_id AND k.node_id = u.ancestor_id GROUP BY o.image_id, o.pixel_id"""


SCORE1 = "1 / (1 + exp(-2.0::DOUBLE * (0.02::DOUBLE * area - 0.1::DOUBLE * gray + 0.5::DOUBLE)))"
SCORE2 = "1 / (1 + exp(-0.7::DOUBLE * (gray - 5.0::DOUBLE)))"


def _stat_rows() -> str:
    return "st AS (SELECT count(*) AS n, sum(area) AS s, sum(area * area) AS q, min(area) AS lo, max(area) AS hi, sum(gray) AS s2, sum(gray * gray) AS q2, min(gray) AS lo2, max(gray) AS hi2 FROM att)"


def _normal(mode: str) -> str:
    def form(x: str, s: str, q: str, lo: str, hi: str) -> str:
        if mode == "minmax01":
            return f"({x} - {lo}) / greatest({hi} - {lo}, 1e-6)"
        z = f"(({x} - {s} / n) / sqrt(greatest({q} / n - ({s} / n) * ({s} / n), 1e-6)))"
        return z if mode == "zscore" else f"0.05::DOUBLE + 0.95::DOUBLE * (least(greatest({z}, -3.0), 3.0) + 3) / 6"

    return f"{tree()}, {_stat_rows()} SELECT image_id, node_id, round({form('area', 's', 'q', 'lo', 'hi')}, 6) + 0.0 AS area, round({form('gray', 's2', 'q2', 'lo2', 'hi2')}, 6) + 0.0 AS gray_level FROM att, st"


PREDICTIONS = "p AS (SELECT lang, quality AS label, round(n_chars / (n_chars + 1000.0::DOUBLE), 3) AS score FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"
PATCHES = f"""WITH {RASTERS['E']},
starts AS (SELECT DISTINCT least(a * 6, 16) AS pr, least(b * 6, 24) AS pc FROM range(4) x(a) CROSS JOIN range(5) y(b)),
cut AS (SELECT i.image_id, pr, pc, l AS lr, m AS lc, pr + l - 2 AS "row", pc + m - 2 AS col, l BETWEEN 2 AND 9 AND m BETWEEN 2 AND 9 AS core FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN starts CROSS JOIN range(12) a(l) CROSS JOIN range(12) b(m)),
got AS (SELECT c.*, coalesce(value, 0) AS value FROM cut c LEFT JOIN px ON px.image_id = c.image_id AND px."row" = c."row" AND px.col = c.col)"""
SIDE = """LEFT JOIN sup {a} ON {a}.image_id = s.image_id AND {a}.node_id = s.node_id AND {a}."row" = s."row" + {r} AND {a}.col = s.col + {c}"""
MU = "sum(col * col) - sum(col) * sum(col) / count(*)::DOUBLE AS m20, sum(\"row\" * \"row\") - sum(\"row\") * sum(\"row\") / count(*)::DOUBLE AS m02, sum(\"row\" * col) - sum(\"row\") * sum(col) / count(*)::DOUBLE AS m11"

KIN = """size AS (SELECT image_id, ancestor_id AS node_id, count(*) AS n FROM up GROUP BY ALL),
kids AS (SELECT image_id, parent_id AS node_id, count(*) AS kids, min(node_id) AS first_child FROM res WHERE node_id <> parent_id GROUP BY ALL)"""
WINNERS = """win AS (SELECT r.image_id, r.node_id, r.depth, row_number() OVER (PARTITION BY r.image_id, parent_id ORDER BY area DESC, r.node_id) = 1 AS wins FROM res r JOIN att a ON a.image_id = r.image_id AND a.node_id = r.node_id WHERE r.node_id <> parent_id),
lost AS (SELECT u.image_id, u.node_id, arg_max(w.node_id, w.depth) FILTER (WHERE NOT wins) AS stop FROM up u LEFT JOIN win w ON w.image_id = u.image_id AND w.node_id = u.ancestor_id WHERE NOT EXISTS (SELECT 1 FROM res k WHERE k.image_id = u.image_id AND k.parent_id = u.node_id AND k.node_id <> u.node_id) GROUP BY u.image_id, u.node_id),
ext AS (SELECT l.image_id, l.node_id, coalesce(area, 'inf'::DOUBLE) AS extinction FROM lost l LEFT JOIN att a ON a.image_id = l.image_id AND a.node_id = l.stop)"""


def distances(suffix: str = "") -> str:
    """Distances of each support pixel to the nearest pixel of the support's four-contour."""
    beside = " ".join(SIDE.format(a=a, r=r, c=c) for a, r, c in (("n", -1, 0), ("w", 0, -1), ("e", 0, 1), ("z", 1, 0)))
    mid = {"ROW": '"row"', "COLUMN": "col"}
    forms = {
        "MAX_DIST": "max(d)", "MAX_SQUARED_DIST": "max(d2)::DOUBLE", "DIST_SQUARED_SUM": "sum(d2)::DOUBLE", "DIST_SQUARED_MEAN": "avg(d2)", "DIST_RMS": "sqrt(avg(d2))", "DIST_SQUARED_VARIANCE": "var_pop(d2)",
        "MAX_DIST_CENTER_ROW": 'floor(min("row" * 1000 + col) FILTER (WHERE d2 = top) / 1000)', "MAX_DIST_CENTER_COLUMN": '(min("row" * 1000 + col) FILTER (WHERE d2 = top) % 1000)::DOUBLE', "MAX_DIST_PLATEAU_AREA": "(count(*) FILTER (WHERE d2 = top))::DOUBLE",
        **{f"MAX_DIST_PLATEAU_CENTROID_{k}": f"avg({c}) FILTER (WHERE d2 = top)" for k, c in mid.items()},
        "DIST_SUM": "sum(d)", "DIST_MEAN": "avg(d)", "DIST_VARIANCE": "var_pop(d)", "DIST_MEDIAN": "quantile_disc(d, 0.5)", "DIST_Q25": "quantile_disc(d, 0.25)", "DIST_Q75": "quantile_disc(d, 0.75)", "DIST_Q90": "quantile_disc(d, 0.9)",
        "DIST_ENTROPY": "entropy(d2)", "DIST_POSITIVE_AREA": "(count(*) FILTER (WHERE d2 > 0))::DOUBLE", "DIST_LEVEL_COUNT": "count(DISTINCT d2)::DOUBLE",
    }
    columns = ", ".join(f"round({form}, 6) + 0.0 AS {name}{suffix}" for name, form in forms.items())
    return f"""{tree()}, edge AS MATERIALIZED (SELECT s.image_id, s.node_id, s."row", s.col FROM sup s {beside} WHERE n.pixel_id IS NULL OR w.pixel_id IS NULL OR e.pixel_id IS NULL OR z.pixel_id IS NULL),
near AS (SELECT s.image_id, s.node_id, s."row", s.col, min((s."row" - x."row") * (s."row" - x."row") + (s.col - x.col) * (s.col - x.col)) AS d2 FROM sup s JOIN edge x ON x.image_id = s.image_id AND x.node_id = s.node_id GROUP BY ALL),
far AS (SELECT *, sqrt(d2::DOUBLE) AS d, max(d2) OVER (PARTITION BY image_id, node_id) AS top FROM near) SELECT image_id, node_id, {columns} FROM far GROUP BY image_id, node_id"""


TOP = "top AS (SELECT r.image_id, r.node_id, area, (row_number() OVER (PARTITION BY r.image_id ORDER BY area DESC, r.node_id))::INTEGER AS rank FROM res r JOIN att a ON a.image_id = r.image_id AND a.node_id = r.node_id WHERE r.node_id <> parent_id)"
MANIFEST = """con AS (SELECT o_orderkey AS position, o_custkey AS entry_key FROM orders WHERE o_orderstatus <> 'P'),
ent AS (SELECT c_custkey AS entry_key, CASE WHEN c_acctbal >= 0 THEN 'ready' ELSE 'failed' END AS state, length(c_name) AS size_bytes FROM customer WHERE c_nationkey > 4)"""

ORACLES: dict[str, str] = {
    **{f"rasterize_{n}": f'WITH {RASTERS[k]} SELECT image_id, "row", col, pixel_id, value FROM px' for n, k in (("events", "E"), ("lineitem", "L"), ("embeddings", "V"))},
    "flat_zones": f"""WITH RECURSIVE {RASTERS['L']},
reach AS (SELECT image_id, pixel_id AS a, pixel_id AS b, value, "row", col FROM px UNION SELECT r.image_id, r.a, n.pixel_id, r.value, n."row", n.col FROM reach r JOIN px n ON n.image_id = r.image_id AND n.value = r.value AND abs(n."row" - r."row") + abs(n.col - r.col) = 1)
SELECT image_id, zone_id, count(*) AS area, any_value(value) AS value FROM (SELECT image_id, a, min(b) AS zone_id, any_value(value) AS value FROM reach GROUP BY image_id, a) GROUP BY image_id, zone_id""",
    "user_tree_nodes": user_nodes(),
    "shape_tree_nodes": shape_nodes(),
    "grain_filter": grains(4),
    "attributes_filled": filled(),
    "attributes_quads": quads(),
    "attributes_quads_4": quads(1),
    "attributes_axes": axes(),
    "attributes_weighted": weighted(),
    "max_tree_nodes": nodes(),
    "max_tree_nodes_4": nodes(square=1),
    "min_tree_nodes": nodes(sign=-1),
    "vector_tree_nodes": nodes("V"),
    "attributes_basic": f"""{tree()}, b AS (SELECT image_id, node_id, count(*)::DOUBLE AS a, any_value(t)::DOUBLE AS level, sum(value)::DOUBLE AS vol, avg(value) AS mean, var_pop(value) AS var, max(value)::DOUBLE AS top, min(col)::DOUBLE AS c0, max(col)::DOUBLE AS c1, min("row")::DOUBLE AS r0, max("row")::DOUBLE AS r1 FROM sup GROUP BY image_id, node_id)
SELECT image_id, node_id, a AS AREA, level AS GRAY_LEVEL, vol AS VOLUME, round(mean, 6) AS MEAN_GRAY_LEVEL, round(var, 6) AS GRAY_LEVEL_VARIANCE, top - level AS GRAY_LEVEL_HEIGHT, c1 - c0 + 1 AS BOUNDING_BOX_WIDTH, r1 - r0 + 1 AS BOUNDING_BOX_HEIGHT, round(sqrt((c1 - c0 + 1) * (c1 - c0 + 1) + (r1 - r0 + 1) * (r1 - r0 + 1)), 6) AS DIAGONAL_LENGTH,
round(a / ((c1 - c0 + 1) * (r1 - r0 + 1)), 6) AS RECTANGULARITY, round((greatest(c1 - c0, r1 - r0) + 1) / (least(c1 - c0, r1 - r0) + 1), 6) AS RATIO_WH, c0 AS BOX_COLUMN_MIN, c1 AS BOX_COLUMN_MAX, r0 AS BOX_ROW_MIN, r1 AS BOX_ROW_MAX FROM b""",
    "attributes_moments": f"""{tree()}, m AS (SELECT image_id, node_id, count(*)::DOUBLE AS a, {MU} FROM sup GROUP BY image_id, node_id)
SELECT image_id, node_id, round(m20, 6) + 0.0 AS CENTRAL_MOMENT_20, round(m02, 6) + 0.0 AS CENTRAL_MOMENT_02, round(m11, 6) + 0.0 AS CENTRAL_MOMENT_11, round((m20 + m02) / (a * a), 6) + 0.0 AS HU_MOMENT_1, round((m20 + m02) / (a * a), 6) + 0.0 AS INERTIA, CASE WHEN m20 + m02 > 0 THEN round(a / (2 * pi() * (m20 + m02)), 6) ELSE 0 END AS COMPACTNESS, round(m20 + m02, 6) + 0.0 AS RAW_INERTIA FROM m""",
    "attributes_contour": f"""{tree()} SELECT s.image_id, s.node_id, count(*) FILTER (WHERE n.pixel_id IS NULL OR w.pixel_id IS NULL OR e.pixel_id IS NULL OR z.pixel_id IS NULL)::DOUBLE AS CONTOUR_PIXELS,
(4 * count(*) - count(n.pixel_id) - count(w.pixel_id) - count(e.pixel_id) - count(z.pixel_id))::DOUBLE AS CONTOUR_PERIMETER, (count(*) - count(n.pixel_id))::DOUBLE AS CONTOUR_SIDE_NORTH, (count(*) - count(w.pixel_id))::DOUBLE AS CONTOUR_SIDE_WEST, (count(*) - count(e.pixel_id))::DOUBLE AS CONTOUR_SIDE_EAST, (count(*) - count(z.pixel_id))::DOUBLE AS CONTOUR_SIDE_SOUTH
FROM sup s {SIDE.format(a='n', r=-1, c=0)} {SIDE.format(a='w', r=0, c=-1)} {SIDE.format(a='e', r=0, c=1)} {SIDE.format(a='z', r=1, c=0)} GROUP BY s.image_id, s.node_id""",
    "attributes_topology": f"""{tree()}, k AS (SELECT image_id, parent_id AS node_id, count(*) AS kids FROM res WHERE node_id <> parent_id GROUP BY ALL), b AS (SELECT u.image_id, u.ancestor_id AS node_id, count(*) - 1 AS below, max(r.depth) AS deepest FROM up u JOIN res r ON r.image_id = u.image_id AND r.node_id = u.node_id GROUP BY ALL)
SELECT r.image_id, r.node_id, depth::DOUBLE AS DEPTH_NODE, (kids IS NULL)::INT::DOUBLE AS IS_LEAF_NODE, (r.node_id = parent_id)::INT::DOUBLE AS IS_ROOT_NODE, coalesce(kids, 0)::DOUBLE AS NUM_CHILDREN_NODE, below::DOUBLE AS NUM_DESCENDANTS_NODE, (deepest - depth)::DOUBLE AS SUBTREE_HEIGHT
FROM res r JOIN b ON b.image_id = r.image_id AND b.node_id = r.node_id LEFT JOIN k ON k.image_id = r.image_id AND k.node_id = r.node_id""",
    "attributes_shape": f"""{tree()}, c AS (SELECT image_id, node_id, count(*)::DOUBLE AS a, avg(col) AS cx, avg("row") AS cy FROM sup GROUP BY ALL),
m AS (SELECT s.image_id, s.node_id, any_value(a) AS a, sum((col - cx) * (col - cx)) AS m20, sum(("row" - cy) * ("row" - cy)) AS m02, sum((col - cx) * ("row" - cy)) AS m11, sum((col - cx) ** 3) AS m30, sum(("row" - cy) ** 3) AS m03, sum((col - cx) ** 2 * ("row" - cy)) AS m21, sum((col - cx) * ("row" - cy) ** 2) AS m12 FROM sup s JOIN c ON c.image_id = s.image_id AND c.node_id = s.node_id GROUP BY s.image_id, s.node_id),
l AS (SELECT *, sqrt((m20 - m02) ** 2 + 4 * m11 * m11) AS w FROM m),
v AS (SELECT u.image_id, u.ancestor_id AS node_id, sum(CASE WHEN u.node_id = u.ancestor_id THEN area ELSE area * (1 + abs(residue)) END) AS volume FROM up u JOIN res r ON r.image_id = u.image_id AND r.node_id = u.node_id JOIN att t ON t.image_id = u.image_id AND t.node_id = u.node_id GROUP BY ALL)
SELECT l.image_id, l.node_id, round(m30, 6) + 0.0 AS CENTRAL_MOMENT_30, round(m03, 6) + 0.0 AS CENTRAL_MOMENT_03, round(m21, 6) + 0.0 AS CENTRAL_MOMENT_21, round(m12, 6) + 0.0 AS CENTRAL_MOMENT_12, round(((m20 - m02) ** 2 + 4 * m11 * m11) / a ** 4, 6) + 0.0 AS HU_MOMENT_2,
round(2 * sqrt((m20 + m02 + w) / 2 / a), 6) + 0.0 AS LENGTH_MAJOR_AXIS, round(2 * sqrt(greatest((m20 + m02 - w) / 2, 0) / a), 6) + 0.0 AS LENGTH_MINOR_AXIS, round(volume, 6) + 0.0 AS RELATIVE_VOLUME FROM l JOIN v ON v.image_id = l.image_id AND v.node_id = l.node_id""",
    "attributes_branches": f"""{tree()}, {KIN}, h AS (SELECT u.image_id, u.ancestor_id AS node_id, max(r.depth) - min(r.depth) AS height, count(*) AS n, count(*) FILTER (WHERE kids IS NULL) AS ends FROM up u JOIN res r ON r.image_id = u.image_id AND r.node_id = u.node_id LEFT JOIN kids k ON k.image_id = u.image_id AND k.node_id = u.node_id GROUP BY ALL),
b AS (SELECT r.image_id, parent_id AS node_id, max(height) - min(height) AS balance, avg(height) AS mean FROM res r JOIN h ON h.image_id = r.image_id AND h.node_id = r.node_id WHERE r.node_id <> parent_id GROUP BY ALL)
SELECT r.image_id, r.node_id, (CASE WHEN r.node_id = r.parent_id THEN 0 ELSE kids - 1 END)::DOUBLE AS NUM_SIBLINGS_NODE, ends::DOUBLE AS NUM_LEAF_DESCENDANTS_NODE, round(ends / n, 6) AS LEAF_RATIO_NODE, coalesce(balance, 0)::DOUBLE AS BALANCE_NODE, round(coalesce(mean, 0), 6) AS AVG_CHILD_HEIGHT_NODE
FROM res r JOIN h ON h.image_id = r.image_id AND h.node_id = r.node_id LEFT JOIN b ON b.image_id = r.image_id AND b.node_id = r.node_id LEFT JOIN kids k ON k.image_id = r.image_id AND k.node_id = r.parent_id""",
    "attributes_distance": distances(),
    "attributes_distance_exact": distances("_EXACT"),
    "tree_relatives": f"""{tree()}, {KIN} SELECT r.image_id, r.node_id, coalesce(k.kids, 0) AS num_children, CASE WHEN r.node_id = r.parent_id THEN 0 ELSE p.kids - 1 END AS num_siblings, k.first_child, CASE WHEN r.node_id <> r.parent_id THEN lead(r.node_id) OVER (PARTITION BY r.image_id, r.parent_id, r.node_id = r.parent_id ORDER BY r.node_id) END AS next_sibling, r.node_id = r.parent_id AS is_root, k.kids IS NULL AS is_leaf
FROM res r LEFT JOIN kids k ON k.image_id = r.image_id AND k.node_id = r.node_id LEFT JOIN kids p ON p.image_id = r.image_id AND p.node_id = r.parent_id""",
    "tree_summary": f"""{tree()}, {KIN} SELECT r.image_id, max(CASE WHEN r.node_id = parent_id THEN r.node_id END) AS root, count(*) AS num_nodes, count(*) FILTER (WHERE kids IS NULL) AS num_leaf_nodes, 768::BIGINT AS num_pixels, 24::BIGINT AS num_rows, 32::BIGINT AS num_columns FROM res r LEFT JOIN kids k ON k.image_id = r.image_id AND k.node_id = r.node_id GROUP BY r.image_id""",
    # Nodes by their root paths: a path comes before its continuations in preorder, after them in post-order.
    "tree_walk": f"""{tree()}, {KIN}, path AS (SELECT u.image_id, u.node_id, list(u.ancestor_id ORDER BY a.depth) AS p FROM up u JOIN res a ON a.image_id = u.image_id AND a.node_id = u.ancestor_id GROUP BY ALL),
walk AS (SELECT image_id, node_id, row_number() OVER (PARTITION BY image_id ORDER BY p) - 1 AS tpre, row_number() OVER (PARTITION BY image_id ORDER BY list_append(p, 4611686018427387904)) - 1 AS position FROM path)
SELECT w.image_id, w.node_id, tpre, tpre + n AS tpost, position FROM walk w JOIN size s ON s.image_id = w.image_id AND s.node_id = w.node_id""",
    "reconstructed_levels": f"WITH {RASTERS['E']} SELECT image_id, pixel_id, value FROM px",
    "extinction_values": f"{tree()}, {WINNERS} SELECT image_id, node_id, CASE WHEN isinf(extinction) THEN -1 ELSE extinction END::BIGINT AS extinction FROM ext",
    "extinction_top3": nearest(f"WITH {WINNERS}, best AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY extinction DESC, node_id) AS k FROM ext) SELECT DISTINCT u.image_id, u.ancestor_id AS node_id FROM up u JOIN best b ON b.image_id = u.image_id AND b.node_id = u.node_id WHERE k <= 3"),
    "pr_curve": f"WITH {PREDICTIONS}, c AS (SELECT score, sum(sum((label = 1)::INT)) OVER w AS tp, sum(sum((label <> 1)::INT)) OVER w AS fp, sum(sum((label = 1)::INT)) OVER () AS pos FROM p GROUP BY score WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT score AS threshold, round(tp / (tp + fp), 6) AS \"precision\", round(tp / pos, 6) AS recall, round(2 * tp / (tp + fp + pos), 6) AS f1 FROM c",
    "mean_by_lang": f"""WITH {PREDICTIONS}, c AS (SELECT lang, count(*) FILTER (WHERE score > 0.6 AND label = 1) AS tp, count(*) FILTER (WHERE score > 0.6 AND label <> 1) AS fp, count(*) FILTER (WHERE score <= 0.6 AND label = 1) AS fn, count(*) FILTER (WHERE score <= 0.6 AND label <> 1) AS tn FROM p GROUP BY lang)
SELECT round(avg((tp + tn) / (tp + fp + fn + tn)), 6) AS accuracy, round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 6) AS "precision", round(avg(tp / nullif(tp + fn, 0)), 6) AS recall, round(avg(tn / nullif(tn + fp, 0)), 6) AS specificity, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS f1, round(avg(coalesce(tp / nullif(tp + fp + fn, 0), 0)), 6) AS jaccard FROM c""",
    "prediction_errors": f"WITH {PREDICTIONS} SELECT round(avg((score - label) * (score - label)), 6) AS mse_score_label, round(avg(abs(score - label)), 6) AS mae_score_label FROM p",
    "prediction_losses": f"""WITH {PREDICTIONS}, q AS (SELECT lang, least(greatest(score, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS s, label::DOUBLE AS y FROM p), g AS (SELECT lang, 1 - (2 * sum(s * y) + 1) / (sum(s) + sum(y) + 1) AS dice, avg(-(2 * y * ln(s) + (1 - y) * ln(1 - s))) AS bce FROM q GROUP BY lang)
SELECT round(avg(dice), 6) AS dice, round(avg(bce), 6) AS bce, round(0.25::DOUBLE * avg(dice) + 0.75::DOUBLE * avg(bce), 6) AS loss FROM g""",
    "price_by_priority": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice / 1e5::DOUBLE), 6) AS mean, round(coalesce(stddev_samp(o_totalprice / 1e5::DOUBLE), 0), 6) AS std FROM orders GROUP BY ALL",
    "area_opening": nearest("SELECT u.image_id, u.node_id FROM up u JOIN att a ON a.image_id = u.image_id AND a.node_id = u.ancestor_id GROUP BY ALL HAVING min(area) >= 4"),
    "area_closing": nearest("SELECT u.image_id, u.node_id FROM up u JOIN att a ON a.image_id = u.image_id AND a.node_id = u.ancestor_id GROUP BY ALL HAVING min(area) >= 4", -1),
    "pruning_max_width": nearest("SELECT DISTINCT u.image_id, u.ancestor_id AS node_id FROM up u JOIN att a ON a.image_id = u.image_id AND a.node_id = u.node_id WHERE width >= 3"),
    "direct_width": nearest("SELECT image_id, node_id FROM att WHERE width >= 3"),
    "subtractive_width": f"{tree()} SELECT o.image_id, o.pixel_id, sum(CASE WHEN width >= 3 THEN residue ELSE 0 END)::BIGINT AS value {PIXELS} JOIN res r ON r.image_id = u.image_id AND r.node_id = u.ancestor_id JOIN att a ON a.image_id = u.image_id AND a.node_id = u.ancestor_id GROUP BY o.image_id, o.pixel_id",
    "soft_subtractive": f"{tree()} SELECT o.image_id, o.pixel_id, round(sum(residue * (area / (area + 8))), 6) + 0.0 AS value {PIXELS} JOIN res r ON r.image_id = u.image_id AND r.node_id = u.ancestor_id JOIN att a ON a.image_id = u.image_id AND a.node_id = u.ancestor_id GROUP BY o.image_id, o.pixel_id",
    "attribute_stats": f"{tree()}, {_stat_rows()} SELECT 'max::AREA' AS stat_key, n AS count, s AS sum, q AS sumsq, lo AS amin, hi AS amax FROM st UNION ALL SELECT 'max::GRAY_LEVEL', n, s2, q2, lo2, hi2 FROM st",
    **{f"normalize_{m}": _normal(m) for m in ("minmax01", "zscore", "clipped_zscore01")},
    "apply_specs": f"{tree()}, sc AS (SELECT image_id, node_id, 0 AS channel, {SCORE1} AS score FROM att UNION ALL SELECT image_id, node_id, 1, {SCORE2} FROM att) SELECT o.image_id, channel, o.pixel_id, round(sum(residue * score), 6) + 0.0 AS value {PIXELS} JOIN res r ON r.image_id = u.image_id AND r.node_id = u.ancestor_id JOIN sc a ON a.image_id = u.image_id AND a.node_id = u.ancestor_id GROUP BY o.image_id, channel, o.pixel_id",
    "edge_penalty": f"{tree()}, sc AS (SELECT image_id, node_id, {SCORE1} AS score FROM att) SELECT r.image_id, round(2 * avg(greatest(c.score - p.score, 0) * greatest(c.score - p.score, 0)), 6) + 0.0 AS penalty FROM res r JOIN sc c ON c.image_id = r.image_id AND c.node_id = r.node_id JOIN sc p ON p.image_id = r.image_id AND p.node_id = r.parent_id WHERE r.node_id <> r.parent_id GROUP BY r.image_id",
    "path_penalty": f"""{tree()}, sc AS (SELECT a.image_id, a.node_id, depth, {SCORE1} AS score FROM att a JOIN res r ON r.image_id = a.image_id AND r.node_id = a.node_id)
SELECT u.image_id, round(2 * avg(greatest(c.score - p.score, 0) * greatest(c.score - p.score, 0)), 6) + 0.0 AS penalty FROM up u JOIN sc c ON c.image_id = u.image_id AND c.node_id = u.node_id JOIN sc p ON p.image_id = u.image_id AND p.node_id = u.ancestor_id WHERE c.depth - p.depth BETWEEN 1 AND 2 GROUP BY u.image_id""",
    "patch_sums": f"{PATCHES} SELECT image_id, pr AS patch_row, pc AS patch_col, count(*) AS cells, sum(value)::BIGINT AS total, sum(CASE WHEN core THEN value ELSE 0 END)::BIGINT AS core_total FROM got GROUP BY ALL",
    "patch_round_trip": f'{PATCHES} SELECT image_id, "row", col, avg(value) AS value FROM got WHERE core GROUP BY ALL',
    "patch_overlap_add": f'{PATCHES} SELECT image_id, "row", col, sum(value)::BIGINT AS value FROM got WHERE "row" BETWEEN 0 AND 23 AND col BETWEEN 0 AND 31 GROUP BY ALL',
    "confusion_by_lang": f"""WITH {PREDICTIONS}, c AS (SELECT lang, count(*) FILTER (WHERE score >= 0.6 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.6 AND label <> 1) AS fp, count(*) FILTER (WHERE score < 0.6 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.6 AND label <> 1) AS tn FROM p GROUP BY lang),
d AS (SELECT *, (tp + fp + fn + tn)::DOUBLE AS n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn))::DOUBLE AS ch, sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS m FROM c)
SELECT lang, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, coalesce(round(tp / nullif(tp + fp, 0), 6), 0) AS "precision", coalesce(round(tp / nullif(tp + fn, 0), 6), 'nan'::DOUBLE) AS recall, coalesce(round(tn / nullif(tn + fp, 0), 6), 'nan'::DOUBLE) AS specificity, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) AS f1, coalesce(round(tp / nullif(tp + fp + fn, 0), 6), 0) AS jaccard, coalesce(round(((tp + tn) / n - ch / (n * n)) / nullif(1 - ch / (n * n), 0), 6), 0) + 0.0 AS kappa, coalesce(round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(m, 0), 6), 0) + 0.0 AS mcc FROM d""",
    "auc_by_lang": f"WITH {PREDICTIONS} SELECT a.lang, round(avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS auc FROM p a JOIN p b ON a.lang = b.lang AND a.label = 1 AND b.label <> 1 GROUP BY a.lang",
    "roc_curve": f"WITH {PREDICTIONS} SELECT score AS threshold, round(sum(sum((label <> 1)::INT)) OVER w / sum(sum((label <> 1)::INT)) OVER (), 6) AS fpr, round(sum(sum((label = 1)::INT)) OVER w / sum(sum((label = 1)::INT)) OVER (), 6) AS tpr FROM p GROUP BY score WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)",
    "grid_metrics": f"WITH {PREDICTIONS}, g AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label <> 1) AS fp, count(*) FILTER (WHERE score < threshold AND label = 1) AS fn, count(*) AS n FROM p, g GROUP BY threshold) SELECT threshold, round(tp / (tp + fp + fn + 1e-12), 6) AS iou, round(2 * tp / (2 * tp + fp + fn + 1e-12), 6) AS f1, round((tp + fp) / n, 6) AS foreground FROM c",
    "split_groups": """WITH n AS (SELECT g, row_number() OVER (ORDER BY md5('7:' || g), g) AS k, count(*) OVER () AS total FROM (SELECT DISTINCT c_nationkey::VARCHAR AS g FROM customer)),
s AS (SELECT g, CASE WHEN k <= total // 5 THEN 'test' WHEN k <= total - total // 5 THEN 'train' ELSE 'val' END AS split FROM n) SELECT split, count(DISTINCT g) AS n_groups, count(*) AS n_samples FROM customer JOIN s ON c_nationkey::VARCHAR = g GROUP BY split""",
    "test_split": "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY md5('5:' || o_orderkey), o_orderkey) <= (SELECT ceil(count(*) * 0.1::DOUBLE) FROM orders)",
    "order_penalty": f"""{tree()}, sc AS (SELECT image_id, node_id, area, {SCORE2} AS score FROM att), st AS (SELECT image_id, area - lag(area) OVER w AS gap, lag(score) OVER w - score AS fall FROM sc WINDOW w AS (PARTITION BY image_id ORDER BY area, node_id))
SELECT image_id, round(2.0::DOUBLE * avg(pow(greatest(fall, 0.0), 2)), 6) + 0.0 AS penalty FROM st WHERE gap > 0 GROUP BY image_id""",
    "crossing_groups": "SELECT 'group crosses' AS issue, o_custkey::VARCHAR AS id FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1",
    "price_distribution": "WITH m AS (SELECT o_orderpriority, count(o_totalprice) AS n, median(o_totalprice) AS median, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1) SELECT m.o_orderpriority, n, round(m.median, 6) AS median, round(low, 6) AS low, round(high, 6) AS high, round(median(abs(o_totalprice - m.median)), 6) AS mad FROM orders o JOIN m ON o.o_orderpriority = m.o_orderpriority GROUP BY ALL",
    "found_nodes": f"{tree()}, {TOP} SELECT image_id, node_id, area, rank FROM top WHERE rank <= 3",
    "subtree_walk": f"{tree()}, {TOP} SELECT t.image_id, t.node_id AS of_node, u.node_id, row_number() OVER (PARTITION BY t.image_id ORDER BY depth, u.node_id) - 1 AS position FROM top t JOIN up u ON u.image_id = t.image_id AND u.ancestor_id = t.node_id JOIN res r ON r.image_id = u.image_id AND r.node_id = u.node_id WHERE rank = 1",
    "node_masks": f"{tree()}, {TOP} SELECT t.image_id, t.node_id AS of_node, p.pixel_id, CASE WHEN s.pixel_id IS NULL THEN 0 ELSE 255 END::BIGINT AS value FROM top t JOIN px p ON p.image_id = t.image_id LEFT JOIN sup s ON s.image_id = p.image_id AND s.pixel_id = p.pixel_id AND s.node_id = t.node_id WHERE rank = 1",
    "tree_paths": f"""{tree()}, e AS (SELECT image_id, min(node_id) AS a, max(node_id) AS b FROM res GROUP BY ALL),
ua AS (SELECT e.image_id, ancestor_id AS n FROM e JOIN up u ON u.image_id = e.image_id AND u.node_id = a), ub AS (SELECT e.image_id, ancestor_id AS n FROM e JOIN up u ON u.image_id = e.image_id AND u.node_id = b),
top AS (SELECT ua.image_id, max(depth) AS d FROM ua JOIN ub ON ub.image_id = ua.image_id AND ub.n = ua.n JOIN res r ON r.image_id = ua.image_id AND r.node_id = ua.n GROUP BY ALL),
way AS (SELECT r.image_id, r.node_id, 0 AS half, -depth AS o FROM ua JOIN res r ON r.image_id = ua.image_id AND r.node_id = ua.n JOIN top t ON t.image_id = r.image_id WHERE depth >= d
  UNION ALL SELECT r.image_id, r.node_id, 1, depth FROM ub JOIN res r ON r.image_id = ub.image_id AND r.node_id = ub.n JOIN top t ON t.image_id = r.image_id WHERE depth > d)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY half, o) - 1 AS position, node_id FROM way""",
    "hierarchy": f"""{tree()}, size AS (SELECT image_id, count(*) AS n FROM px GROUP BY ALL), h AS (SELECT r.*, n + row_number() OVER (PARTITION BY r.image_id ORDER BY depth DESC, node_id) - 1 AS h_id FROM res r JOIN size s ON s.image_id = r.image_id)
SELECT h.image_id, h.h_id, p.h_id AS parent, h.level::DOUBLE AS altitude, area FROM h JOIN h p ON p.image_id = h.image_id AND p.node_id = h.parent_id JOIN att a ON a.image_id = h.image_id AND a.node_id = h.node_id
UNION ALL SELECT o.image_id, o.pixel_id, h.h_id, px.value::DOUBLE, NULL FROM own o JOIN h ON h.image_id = o.image_id AND h.node_id = o.node_id JOIN px ON px.image_id = o.image_id AND px.pixel_id = o.pixel_id""",
    "merged_nodes": nearest("SELECT image_id, node_id FROM res WHERE node_id % 2 = 0"),
    "pruned_nodes": nearest("SELECT u.image_id, u.node_id FROM up u JOIN res r ON r.image_id = u.image_id AND r.node_id = u.ancestor_id GROUP BY ALL HAVING bool_and(r.node_id % 5 <> 1 OR r.node_id = r.parent_id)"),
    "prepared_stats": " UNION ALL ".join(f"SELECT * FROM ({tree(sign=sign)} SELECT '{key}::' || a AS stat_key, count(*) AS count, sum(x) AS sum, sum(x * x) AS sumsq, min(x) AS amin, max(x) AS amax FROM (SELECT image_id, unnest(['AREA', 'GRAY_LEVEL']) AS a, unnest([area, gray]) AS x FROM att) WHERE image_id <> (SELECT max(image_id) FROM px) GROUP BY a)" for key, sign in (("max", 1), ("min", -1))),
    "prepared_entries": " UNION ALL ".join(
        f"""SELECT '{kind}' AS tree_key, rasters, built, 0::BIGINT AS built_again, nodes, area FROM ({tree("V", sign)}, c AS (SELECT image_id, list(value ORDER BY pixel_id) AS content FROM px GROUP BY image_id)
SELECT (SELECT count(*) FROM c) AS rasters, (SELECT count(DISTINCT content) FROM c) AS built, (SELECT count(*) FROM res) AS nodes, (SELECT count(*) FROM sup) AS area)"""
        for kind, sign in (("max", 1), ("min", -1))
    ),
    "manifest_states": f"WITH {MANIFEST} SELECT coalesce(state, 'missing') AS state, count(*) AS n, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM (SELECT DISTINCT entry_key FROM con) LEFT JOIN ent USING (entry_key) GROUP BY 1",
    "manifest_missing": f"WITH {MANIFEST} SELECT DISTINCT entry_key FROM con ANTI JOIN ent USING (entry_key)",
    "missing_entries": f"WITH {MANIFEST} SELECT DISTINCT entry_key FROM con ANTI JOIN (SELECT * FROM ent WHERE state = 'ready') USING (entry_key)",
    "entry_size_estimate": f"WITH {MANIFEST}, t AS (SELECT ceil(max(size_bytes) * 12)::BIGINT AS estimate, sum(size_bytes)::BIGINT AS used FROM ent) SELECT estimate, 1000000000 - used - estimate AS quota_left FROM t",
    "cache_issues": f"""WITH {MANIFEST}, i AS (SELECT 'metadata' AS scope, 'no contribution' AS issue FROM orders WHERE o_orderkey NOT IN (SELECT position FROM con)
  UNION ALL SELECT 'metadata', 'entry' FROM (SELECT DISTINCT entry_key FROM con ANTI JOIN (SELECT * FROM ent WHERE state = 'ready') USING (entry_key))
  UNION ALL SELECT 'payload', 'no payload' FROM ent WHERE state = 'ready' AND entry_key % 3 = 0
  UNION ALL SELECT 'metadata', 'positions' FROM (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS d, max(o_orderkey) AS m FROM orders) WHERE n - 1 <> m OR n <> d
  UNION ALL SELECT 'source', 'moved' FROM orders WHERE o_orderkey % 5 = 0) SELECT scope, issue, count(*) AS n FROM i GROUP BY ALL""",
}
