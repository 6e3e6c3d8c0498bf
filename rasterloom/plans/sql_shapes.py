"""DuckDB steps, by name, of the longer twins: growth, gradients, lines, hulls, seams and conics.

Each step reads ``px(img, x, y, v)`` of 8x8 rasters or steps before it.
"""

from __future__ import annotations

import math

from . import sql as Q

Step = tuple[str, str]


def components(near: str, source: str = "qv", name: str = "r", width: int = 8) -> Step:
    """Numbers of the regions of equal, non-zero q, from 1 in raster order."""
    return (name, f"""WITH RECURSIVE reach AS (
  SELECT img, x, y, q, y * {width} + x AS n FROM {source} WHERE q <> 0
  UNION SELECT b.img, b.x, b.y, b.q, a.n FROM reach a JOIN {source} b ON a.img = b.img AND a.q = b.q AND {near}),
roots AS (SELECT img, x, y, min(n) AS n FROM reach GROUP BY img, x, y)
SELECT q0.img, q0.x, q0.y, CAST(coalesce(k, 0) AS INTEGER) AS v FROM {source} q0 LEFT JOIN (SELECT img, x, y, dense_rank() OVER (PARTITION BY img ORDER BY n) AS k FROM roots) z ON q0.img = z.img AND q0.x = z.x AND q0.y = z.y""")


def grown(source: str, low: float, high: float, name: str = "r") -> Step:
    """255 where growth in six directions from ``high`` through ``low`` leads."""
    return (name, f"""WITH RECURSIVE reach AS (SELECT img, x, y FROM {source} WHERE v >= {high}
  UNION SELECT b.img, b.x, b.y FROM reach a JOIN {source} b ON a.img = b.img AND b.v >= {low} AND (b.x - a.x, b.y - a.y) IN ((1, 0), (1, 1), (0, 1), (-1, -1), (-1, 0), (-1, 1)))
SELECT s.img, s.x, s.y, CASE WHEN reach.img IS NOT NULL THEN 255 ELSE 0 END AS v FROM {source} s LEFT JOIN reach ON s.img = reach.img AND s.x = reach.x AND s.y = reach.y""")


def gradient(horizontal: dict, vertical: dict, source: str = "px", name: str = "grad", width: int = 8) -> Step:
    """gx and gy of every place, within 16 bits, and m, the root of their squares."""
    both = {o: (horizontal.get(o, 0), vertical.get(o, 0)) for o in {*horizontal, *vertical}}
    k = ", ".join(f"({dx}, {dy}, {a}, {b})" for (dx, dy), (a, b) in both.items())
    return (name, f"""SELECT *, sqrt(CAST(gx * gx + gy * gy AS DOUBLE)) AS m FROM (
  SELECT a.img, a.x, a.y, sum(k.a * b.v) AS gx, sum(k.b * b.v) AS gy FROM {source} a CROSS JOIN (VALUES {k}) k(dx, dy, a, b)
  JOIN {source} b ON b.img = a.img AND b.x = greatest(0, least({width - 1}, a.x + dx)) AND b.y = greatest(0, least(7, a.y + dy)) GROUP BY a.img, a.x, a.y)""")


#: magnitudes that are no less than both neighbours along the gradient; 0 at the border
THIN: Step = ("thin", """WITH s AS (SELECT *, CASE WHEN d < 0 THEN d + 180 ELSE d END AS angle FROM (SELECT *, degrees(atan2(CAST(gy AS DOUBLE), CAST(gx AS DOUBLE))) AS d FROM grad)),
o AS (SELECT *, CASE WHEN angle >= 157.5 OR angle < 22.5 THEN 1 WHEN angle < 67.5 THEN 1 WHEN angle < 112.5 THEN 0 ELSE 1 END AS dx, CASE WHEN angle >= 157.5 OR angle < 22.5 THEN 0 WHEN angle < 67.5 THEN 1 WHEN angle < 112.5 THEN 1 ELSE -1 END AS dy FROM s)
SELECT o.img, o.x, o.y, CASE WHEN o.x BETWEEN 1 AND 6 AND o.y BETWEEN 1 AND 6 AND o.m >= a.m AND o.m >= b.m THEN o.m ELSE 0 END AS v FROM o LEFT JOIN grad a ON a.img = o.img AND a.x = o.x + dx AND a.y = o.y + dy LEFT JOIN grad b ON b.img = o.img AND b.x = o.x - dx AND b.y = o.y - dy""")

#: the value whose share in the target reaches a value's own, or the one before if that is strictly nearer
MATCHED: tuple[Step, ...] = (
    ("tv", "SELECT img, CAST(CASE WHEN v <= 80 THEN 0 WHEN v >= 180 THEN 255 ELSE (v - 80) * 255 // 100 END AS INTEGER) AS v FROM px"),
    ("sp", "SELECT p.img, CAST(b.v AS INTEGER) AS v, (SELECT count(*) FROM px q WHERE q.img = p.img AND q.v <= b.v) / 64.0::DOUBLE AS p FROM (SELECT DISTINCT img FROM px) p CROSS JOIN range(256) b(v)"),
    ("tp", "SELECT img, list(p ORDER BY v) AS ps FROM (SELECT p.img, b.v, (SELECT count(*) FROM tv q WHERE q.img = p.img AND q.v <= b.v) / 64.0::DOUBLE AS p FROM (SELECT DISTINCT img FROM px) p CROSS JOIN range(256) b(v)) GROUP BY img"),
    ("hi", "SELECT sp.img, v, p, ps, CAST(least(255, len(list_filter(ps, lambda z: z < p))) AS INTEGER) AS k FROM sp JOIN tp ON sp.img = tp.img"),
    ("new", "SELECT img, v, CASE WHEN k > 0 AND p - ps[greatest(k, 1)] < ps[k + 1] - p THEN k - 1 ELSE k END AS w FROM hi"),
    ("r", "SELECT px.img, x, y, CAST(w AS INTEGER) AS v FROM px JOIN new ON px.img = new.img AND px.v = new.v"),
)


def cells(orientations: int, signed: bool, cell: int, name: str = "cells") -> Step:
    """Trilinear votes of magnitudes into cells and orientations."""
    full = 2 * math.pi if signed else math.pi
    turned = "CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END"
    turned = turned if signed else f"CASE WHEN {turned} >= pi() THEN {turned} - pi() ELSE {turned} END"
    return (name, f"""WITH a AS (SELECT img, m, x, y, {turned} AS t FROM (SELECT *, atan2(CAST(gy AS DOUBLE), CAST(gx AS DOUBLE)) AS t FROM grad)),
p AS (SELECT img, m, (x + 0.5) / {cell} - 0.5 AS px_, (y + 0.5) / {cell} - 0.5 AS py_, CASE WHEN o < 0 THEN o + {orientations} ELSE o END AS o FROM (SELECT *, t / CAST({full / orientations!r} AS DOUBLE) - 0.5 AS o FROM a)),
w AS (SELECT img, floor(px_) + i AS cx, floor(py_) + j AS cy, (floor(o) + k) % {orientations} AS bin,
  (CASE i WHEN 1 THEN px_ - floor(px_) ELSE 1 - (px_ - floor(px_)) END) * (CASE j WHEN 1 THEN py_ - floor(py_) ELSE 1 - (py_ - floor(py_)) END) * (CASE k WHEN 1 THEN o - floor(o) ELSE 1 - (o - floor(o)) END) * m / {cell * cell} AS v
  FROM p, range(2) a(i), range(2) b(j), range(2) c(k))
SELECT img, CAST(cx AS INTEGER) AS cx, CAST(cy AS INTEGER) AS cy, CAST(bin AS INTEGER) AS bin, sum(v) AS v FROM w WHERE cx BETWEEN 0 AND {8 // cell - 1} AND cy BETWEEN 0 AND {8 // cell - 1} GROUP BY ALL""")


def blocks(cell: int, block: int, stride: int) -> tuple[Step, ...]:
    """Blocks of cells at a stride, each divided by its norm."""
    last = 8 // cell - block
    return (
        ("placed", f"SELECT img, CAST(l // {stride} AS INTEGER) AS bx, CAST(t // {stride} AS INTEGER) AS by_, CAST(cells.cx - l AS INTEGER) AS cx, CAST(cells.cy - t AS INTEGER) AS cy, bin, v FROM cells, range(0, {last + 1}, {stride}) a(l), range(0, {last + 1}, {stride}) b(t) WHERE cells.cx - l BETWEEN 0 AND {block - 1} AND cells.cy - t BETWEEN 0 AND {block - 1}"),
        ("r", 'SELECT img, bx, by_ AS "by", cx, cy, bin, round(CASE WHEN n > 0 THEN v / n ELSE 0 END, 5) AS v FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY img, bx, by_)) AS n FROM placed)'),
    )


def lines(white: str, votes: int, radius: int) -> tuple[Step, ...]:
    """Hough lines: votes of the white places that no other line within ``radius`` beats."""
    return (
        ("vote", f"SELECT img, CAST(trunc(x * cos(radians(CAST(t AS DOUBLE))) + y * sin(radians(CAST(t AS DOUBLE)))) AS INTEGER) AS r, CAST(t AS INTEGER) AS angle, CAST(count(*) AS INTEGER) AS votes FROM px, range(180) a(t) WHERE {white} GROUP BY ALL HAVING count(*) >= {votes}"),
        ("line", f"SELECT * FROM vote a WHERE NOT EXISTS (SELECT 1 FROM vote b WHERE a.img = b.img AND abs(a.r - b.r) <= {radius} AND abs(a.angle - b.angle) <= {radius} AND (b.votes > a.votes OR (b.votes = a.votes AND (b.r, b.angle) < (a.r, a.angle))))"),
    )


#: corners of the convex hull of pt(grp, x, y): starts of edges with every point on one side or on the edge, from the lowest on
HULL: tuple[Step, ...] = (
    ("one", "SELECT DISTINCT grp, x, y FROM pt"),
    ("corner", """SELECT grp, x, y FROM one WHERE (SELECT count(*) FROM one o WHERE o.grp = one.grp) = 1
  UNION SELECT p.grp, p.x, p.y FROM one p JOIN one q ON p.grp = q.grp AND (p.x, p.y) <> (q.x, q.y)
  WHERE NOT EXISTS (SELECT 1 FROM one r WHERE r.grp = p.grp AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0
    OR ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 AND (r.x - p.x) * (r.x - q.x) + (r.y - p.y) * (r.y - q.y) > 0)))"""),
    ("low", "SELECT grp, arg_min(x, (y, x)) AS x0, min(y) AS y0 FROM corner GROUP BY grp"),
    ("hull", "SELECT corner.grp, CAST(row_number() OVER (PARTITION BY corner.grp ORDER BY CASE WHEN x = x0 AND y = y0 THEN -1 ELSE atan2(y - y0, x - x0) END) - 1 AS INTEGER) AS seq, x, y FROM corner JOIN low ON corner.grp = low.grp"),
)
#: the least rectangle along an edge of the hull, moved out to integers
BOX: tuple[Step, ...] = (
    *HULL,
    ("edge", "SELECT a.grp, a.seq, (b.x - a.x) / sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS ux, (b.y - a.y) / sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS uy FROM hull a JOIN hull b ON a.grp = b.grp AND b.seq = a.seq + 1 WHERE (SELECT max(seq) FROM hull h WHERE h.grp = a.grp) >= 2"),
    ("span", "SELECT e.grp, e.seq, any_value(ux) AS ux, any_value(uy) AS uy, min(ux * x + uy * y) AS d0, max(ux * x + uy * y) AS d1, min(ux * y - uy * x) AS c0, max(ux * y - uy * x) AS c1 FROM edge e JOIN hull h ON e.grp = h.grp GROUP BY e.grp, e.seq"),
    ("best", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round((d1 - d0) * (c1 - c0), 9), seq) AS k FROM span) WHERE k = 1"),
    ("turn", "SELECT grp, round(d * ux - c * uy, 9) AS x, round(d * uy + c * ux, 9) AS y FROM best, LATERAL (SELECT unnest([d0, d0, d1, d1]) AS d, unnest([c0, c1, c0, c1]) AS c)"),
    ("side", "SELECT *, row_number() OVER (PARTITION BY grp ORDER BY x, y) > 2 AS is_right FROM turn"),
    ("named", "SELECT *, row_number() OVER (PARTITION BY grp, is_right ORDER BY y) > 1 AS is_low FROM side"),
    ("r", """SELECT grp, CAST(CASE WHEN is_right THEN CASE WHEN is_low THEN 2 ELSE 1 END ELSE CASE WHEN is_low THEN 3 ELSE 0 END END AS INTEGER) AS seq, CASE WHEN is_right THEN ceil(x) ELSE floor(x) END + 0.0::DOUBLE AS x, CASE WHEN is_low THEN ceil(y) ELSE floor(y) END + 0.0::DOUBLE AS y FROM named
  UNION ALL SELECT h.grp, CAST(k AS INTEGER), h.x, h.y FROM hull h, range(4) z(k) WHERE (SELECT max(seq) FROM hull m WHERE m.grp = h.grp) = 0
  UNION ALL SELECT h.grp, CAST(k AS INTEGER), h.x, h.y FROM hull h, range(4) z(k) WHERE (SELECT max(seq) FROM hull m WHERE m.grp = h.grp) = 1 AND h.seq = CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END"""),
)

def seam(grad: str = "grad", tag: str = "") -> tuple[Step, ...]:
    """The seam of least Sobel magnitude; each step back compares with the least value seen so far."""
    energy, cost, way = f"energy{tag}", f"cost{tag}", f"way{tag}"
    return (
        (energy, f"SELECT img, y, list(CAST(floor(m) AS BIGINT) ORDER BY x) AS e FROM {grad} GROUP BY img, y"),
        (cost, f"""WITH RECURSIVE c AS (SELECT img, y, e AS cost FROM {energy} WHERE y = 0
  UNION ALL SELECT n.img, n.y, list_transform(n.e, lambda v, i: v + least(coalesce(c.cost[i - 1], 9223372036854775807), c.cost[i], coalesce(c.cost[i + 1], 9223372036854775807))) FROM c JOIN {energy} n ON n.img = c.img AND n.y = c.y + 1) SELECT * FROM c"""),
        (way, f"""WITH RECURSIVE s AS (SELECT img, y, list_position(cost, list_min(cost)) AS i, list_min(cost) AS held FROM {cost} WHERE y = 7
  UNION ALL SELECT img, y, CASE WHEN i < len(cost) AND cost[i + 1] < h THEN i + 1 ELSE j END, CASE WHEN i < len(cost) AND cost[i + 1] < h THEN cost[i + 1] ELSE h END FROM (
    SELECT c.img, c.y, s.i, c.cost, CASE WHEN s.i > 1 AND c.cost[s.i - 1] < c.cost[s.i] THEN s.i - 1 ELSE s.i END AS j, CASE WHEN s.i > 1 AND c.cost[s.i - 1] < c.cost[s.i] THEN c.cost[s.i - 1] ELSE s.held END AS h
    FROM s JOIN {cost} c ON c.img = s.img AND c.y = s.y - 1)) SELECT * FROM s"""),
        (f"seam{tag}", f"SELECT img, y, CAST(i - 1 AS INTEGER) AS x FROM {way}"),
    )


def circle(radius: int) -> Step:
    """Offsets (x, y) of the octant from the top to the diagonal, by midpoint tests, and their mirror images."""
    return ("off", f"""WITH RECURSIVE o AS (SELECT 0 AS x, {radius} AS y, {1 - radius} AS p
  UNION ALL SELECT x + 1, CASE WHEN p >= 0 THEN y - 1 ELSE y END, p + 2 * (x + 1) + 1 - CASE WHEN p >= 0 THEN 2 * (y - 1) ELSE 0 END FROM o WHERE x + 1 <= CASE WHEN p >= 0 THEN y - 1 ELSE y END)
SELECT x, y FROM o UNION SELECT y, x FROM o""")


def ellipse(rx: int, ry: int) -> Step:
    """Offsets (x, y) of the quadrant from the top to the side: x moves in the flat part, then y in the steep one."""
    a, b = rx * rx, ry * ry
    flat = f"2 * {b} * x < 2 * {a} * y"
    return ("off", f"""WITH RECURSIVE f AS (SELECT 0 AS n, 0 AS x, {ry} AS y, CAST({b - a * ry + 0.25 * a} AS DOUBLE) AS t
  UNION ALL SELECT n + 1, x + 1, CASE WHEN t >= 0 THEN y - 1 ELSE y END, t + {b} + 2 * {b} * (x + 1) - CASE WHEN t >= 0 THEN 2 * {a} * (y - 1) ELSE 0 END FROM f WHERE {flat}),
s AS (SELECT x, y, {b} * (x + 0.5) * (x + 0.5) + {a} * (y - 1) * (y - 1) - {a * b}::DOUBLE AS t FROM f WHERE NOT ({flat})
  UNION ALL SELECT CASE WHEN t <= 0 THEN x + 1 ELSE x END, y - 1, t + {a} - 2 * {a} * (y - 1) + CASE WHEN t <= 0 THEN 2 * {b} * (x + 1) ELSE 0 END FROM s WHERE y > 0)
SELECT x, y FROM f UNION SELECT x, y FROM s""")


def drawn(cx: int, cy: int, filled: bool, color: int) -> Step:
    """The raster with the offsets mirrored around a centre, or with the spans between them, in a colour."""
    hit = f"y IN ({cy} + o.y, {cy} - o.y) AND " + (f"px.x BETWEEN {cx} - o.x AND {cx} + o.x" if filled else f"px.x IN ({cx} + o.x, {cx} - o.x)")
    return ("r", f"SELECT img, x, y, CASE WHEN EXISTS (SELECT 1 FROM off o WHERE {hit.replace('y IN', 'px.y IN', 1)}) THEN {color} ELSE v END AS v FROM px")


#: img, x, y, score, orientation of the two best corners: the angle of the raster's weighted middle, counted from 15 places before its first row and column
ORIENTED: tuple[Step, ...] = (
    ("best", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, y, x) AS k FROM corner) WHERE k <= 2"),
    ("moment", "SELECT img, sum((x - 15) * v) AS mx, sum((y - 15) * v) AS my FROM px GROUP BY img"),
    ("r", "SELECT best.img, x, y, score, round(-atan2(CAST(my AS DOUBLE), CAST(mx AS DOUBLE)), 9) AS orientation FROM best JOIN moment ON best.img = moment.img"),
)

#: sizes of the classes of 300 numbers
TREES: tuple[Step, ...] = (
    ("edge", "SELECT DISTINCT img % 300 AS a, CAST(x * 37 + y * 5 AS BIGINT) AS b FROM px WHERE v > 200"),
    ("tie", "SELECT a, b FROM edge UNION SELECT b, a FROM edge"),
    ("root", "WITH RECURSIVE reach AS (SELECT n AS a, n AS b FROM range(300) z(n) UNION SELECT reach.a, tie.b FROM reach JOIN tie ON reach.b = tie.a) SELECT a, min(b) AS root FROM reach GROUP BY a"),
    ("r", "SELECT root, CAST(count(*) AS INTEGER) AS n FROM root GROUP BY root"),
)


def without_seam(source: str, seam_: str, name: str) -> Step:
    """The raster without a seam's places; what is right of them moves left."""
    return (name, f"SELECT s.img, CAST(CASE WHEN s.x > k.x THEN s.x - 1 ELSE s.x END AS INTEGER) AS x, s.y, s.v FROM {source} s JOIN {seam_} k ON s.img = k.img AND s.y = k.y WHERE s.x <> k.x")


def segments(source: str, key: str, name: str = "mark") -> Step:
    """(key, x, y): the places of segments x0, y0, x1, y1, along their longer axis; the other has moved ceil(i * slope - 1/2) after i steps."""
    return (name, f"""WITH t AS (SELECT *, abs(y1 - y0) > abs(x1 - x0) AS steep FROM {source}),
u AS (SELECT {key}, steep, CASE WHEN steep THEN y0 ELSE x0 END AS a0, CASE WHEN steep THEN x0 ELSE y0 END AS b0, CASE WHEN steep THEN y1 ELSE x1 END AS a1, CASE WHEN steep THEN x1 ELSE y1 END AS b1 FROM t),
o AS (SELECT {key}, steep, least(a0, a1) AS a0, greatest(a0, a1) AS a1, CASE WHEN a0 > a1 THEN b1 ELSE b0 END AS b0, CASE WHEN a0 > a1 THEN b0 ELSE b1 END AS b1 FROM u),
s AS (SELECT *, unnest(range(CAST(trunc(a1) AS BIGINT) - CAST(trunc(a0) AS BIGINT) + 1)) AS i FROM o),
m AS (SELECT {key}, steep, trunc(a0) + i AS along, trunc(b0) + CASE WHEN b0 < b1 THEN 1 ELSE -1 END * CASE WHEN a1 > a0 THEN greatest(0, ceil((2 * i * abs(b1 - b0) - (a1 - a0)) / (2 * (a1 - a0)))) ELSE 0 END AS across FROM s)
SELECT DISTINCT {key}, CAST(CASE WHEN steep THEN across ELSE along END AS INTEGER) AS x, CAST(CASE WHEN steep THEN along ELSE across END AS INTEGER) AS y FROM m""")


#: where the lines of line(img, r, angle) meet the box of 8 x 8: the first two of right, left, bottom and top
MET: Step = ("met", """WITH l AS (SELECT img, angle, r::DOUBLE AS r, sin(radians(angle)) AS s, cos(radians(angle)) AS c FROM line),
p AS (SELECT *, CASE WHEN angle = 0 THEN [{'x': r, 'y': 0.0::DOUBLE, 'ok': r BETWEEN 0 AND 8}, {'x': r, 'y': 8.0::DOUBLE, 'ok': r BETWEEN 0 AND 8}]
  WHEN angle = 90 THEN [{'x': 0.0::DOUBLE, 'y': r, 'ok': r BETWEEN 0 AND 8}, {'x': 8.0::DOUBLE, 'y': r, 'ok': r BETWEEN 0 AND 8}]
  ELSE [{'x': 8.0::DOUBLE, 'y': (r - 8 * c) / s, 'ok': (r - 8 * c) / s BETWEEN 0 AND 8}, {'x': 0.0::DOUBLE, 'y': r / s, 'ok': r / s BETWEEN 0 AND 8},
        {'x': (r - 8 * s) / c, 'y': 8.0::DOUBLE, 'ok': (r - 8 * s) / c BETWEEN 0 AND 8}, {'x': r / c, 'y': 0.0::DOUBLE, 'ok': r / c BETWEEN 0 AND 8}] END AS pts FROM l),
k AS (SELECT img, list_filter(pts, lambda z: z.ok) AS f FROM p)
SELECT img, f[1].x AS x0, f[1].y AS y0, f[2].x AS x1, f[2].y AS y1 FROM k WHERE len(f) > 1""")


def bezier(start: tuple[float, float], end: tuple[float, float], a: tuple[float, float], b: tuple[float, float]) -> Step:
    """A cubic curve as floor(sqrt(length^2 + 800) / 8) segments between places rounded half away from zero."""
    dist = lambda p, q: f"sqrt(pow({p[0] - q[0]}::DOUBLE, 2) + pow({p[1] - q[1]}::DOUBLE, 2))"
    at = lambda k, t: f"({start[k]}::DOUBLE * pow(1 - {t}, 3) + 3 * {a[k]}::DOUBLE * pow(1 - {t}, 2) * {t} + 3 * {b[k]}::DOUBLE * (1 - {t}) * pow({t}, 2) + {end[k]}::DOUBLE * pow({t}, 3))"
    rounded = lambda v: f"sign(round({v}, 9)) * floor(abs(round({v}, 9)) + 0.5)"
    return ("seg", f"""WITH n AS (SELECT CAST(floor(sqrt(pow({dist(start, a)} + {dist(a, b)} + {dist(b, end)}, 2) + 800) / 8) AS BIGINT) AS n), i AS (SELECT n, unnest(range(n)) AS i FROM n),
t AS (SELECT i / n::DOUBLE AS t, (i + 1) / n::DOUBLE AS u FROM i)
SELECT 0 AS one, {rounded(at(0, 't'))} AS x0, {rounded(at(1, 't'))} AS y0, {rounded(at(0, 'u'))} AS x1, {rounded(at(1, 'u'))} AS y1 FROM t""")


def simplified(epsilon: float) -> tuple[Step, ...]:
    """Places of pt(grp, seq, x, y) that stay: from chord to chord, the farthest place if it is farther than ``epsilon``."""
    far = "abs((xs[b] - xs[a]) * (ys[i] - ys[a]) - (ys[b] - ys[a]) * (xs[i] - xs[a])) / sqrt(pow(xs[b] - xs[a], 2) + pow(ys[b] - ys[a], 2))"
    return (
        ("arc", "SELECT grp, list(x ORDER BY seq) AS xs, list(y ORDER BY seq) AS ys FROM pt GROUP BY grp"),
        ("chord", f"""WITH RECURSIVE c AS (SELECT grp, xs, ys, CAST(1 AS BIGINT) AS a, CAST(len(xs) AS BIGINT) AS b FROM arc
  UNION ALL SELECT grp, xs, ys, unnest([a, k]), unnest([k, b]) FROM (
    SELECT grp, xs, ys, a, b, list_max(ds) AS d, a + list_position(ds, list_max(ds)) AS k FROM (SELECT *, list_transform(range(a + 1, b), lambda i: {far}) AS ds FROM c WHERE b - a >= 2 AND (xs[a] <> xs[b] OR ys[a] <> ys[b])))
  WHERE d > {epsilon}) SELECT * FROM c"""),
        ("stay", "SELECT DISTINCT grp, xs, ys, unnest([a, b]) AS i FROM chord"),
        ("r", "SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY i) - 1 AS INTEGER) AS seq, xs[i] AS x, ys[i] AS y FROM stay"),
    )


def even(seed: int, *of: str) -> str:
    """A number between 0 and 1 from the MD5 of a seed and columns."""
    return f"((CAST('0x' || md5(concat_ws('|', '{seed}', {', '.join(of)}))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296)"


def stars(side: int, bins: int) -> tuple[Step, ...]:
    """The cells' histograms as stars: rays both ways from the middle, in single precision, the highest bin on top."""
    turn = f"CAST(CAST(pi() AS FLOAT) * CAST(b AS FLOAT) / CAST({bins} AS FLOAT) + CASE t WHEN 1 THEN CAST(pi() AS FLOAT) ELSE CAST(0 AS FLOAT) END AS FLOAT)"
    end = lambda sign, f: f"CAST(CAST({side // 2} AS FLOAT) {sign} CAST({side / 2} AS FLOAT) * CAST({f}({turn}) AS FLOAT) AS DOUBLE)"
    return (
        ("ray", f"SELECT CAST(b AS INTEGER) AS b, {side // 2}::DOUBLE AS x0, {side // 2}::DOUBLE AS y0, {end('-', 'sin')} AS x1, {end('+', 'cos')} AS y1 FROM range({bins}) a(b), range(2) c(t)"),
        segments("ray", "b"),
        ("top", "SELECT x AS sx, y AS sy, max(b) AS ray FROM mark GROUP BY x, y"),
        ("place", f"SELECT img, cx, cy, CAST(sx AS INTEGER) AS sx, CAST(sy AS INTEGER) AS sy FROM (SELECT DISTINCT img, cx, cy FROM cells), range({side}) a(sx), range({side}) b(sy)"),
        ("r", f"SELECT p.img, p.cx * {side} + p.sx AS x, p.cy * {side} + p.sy AS y, {Q.clamp('coalesce(c.v, 0)')} AS v FROM place p LEFT JOIN top ON top.sx = p.sx AND top.sy = p.sy LEFT JOIN cells c ON c.img = p.img AND c.cx = p.cx AND c.cy = p.cy AND c.bin = top.ray"),
    )


def smooth_polygon(points: list[tuple[int, int]], color: int) -> str:
    """A convex polygon filled by even-odd spans, then its edges' weighted places blended in order."""
    ring = ", ".join(f"({k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for k, (a, b) in enumerate(zip(points, [*points[1:], points[0]], strict=True)))
    return f"""WITH RECURSIVE {Q.EMB.strip()},
ring AS (SELECT * FROM (VALUES {ring}) e(k, x0, y0, x1, y1)),
met AS (SELECT y, x0 + (y - y0)::DOUBLE / (y1 - y0) * (x1 - x0) AS hit_at FROM ring, range(8) a(y) WHERE y0 <> y1 AND y > least(y0, y1) AND y < greatest(y0, y1)
  UNION ALL SELECT y0, x0 FROM ring WHERE y1 > y0 UNION ALL SELECT y1, x1 FROM ring WHERE y0 > y1),
span AS (SELECT y, min(sign(hit_at) * floor(abs(hit_at) + 0.5)) AS a, max(sign(hit_at) * floor(abs(hit_at) + 0.5)) AS b FROM met GROUP BY y),
turned AS (SELECT k, abs(y1 - y0) > abs(x1 - x0) AS steep, CASE WHEN abs(y1 - y0) > abs(x1 - x0) THEN [y0, x0, y1, x1] ELSE [x0, y0, x1, y1] END AS q FROM ring),
ordered AS (SELECT k, steep, CASE WHEN q[1] > q[3] THEN [q[3], q[4], q[1], q[2]] ELSE q END AS q FROM turned),
step AS (SELECT k, steep, q, unnest(range(q[3] - q[1] + 1)) AS i FROM ordered),
line AS (SELECT k, steep, i, q[1] + i AS along, q[2] + CASE WHEN q[3] <> q[1] THEN (q[4] - q[2])::DOUBLE / (q[3] - q[1]) ELSE 0 END * i AS hit_at FROM step),
two AS (SELECT k, steep, i, j, along, trunc(hit_at) + j AS across, CASE j WHEN 0 THEN 1 - (hit_at - trunc(hit_at)) ELSE hit_at - trunc(hit_at) END AS w FROM line, range(2) a(j)),
mark AS MATERIALIZED (SELECT CAST(CASE WHEN steep THEN across ELSE along END AS INTEGER) AS x, CAST(CASE WHEN steep THEN along ELSE across END AS INTEGER) AS y, w, row_number() OVER (PARTITION BY CASE WHEN steep THEN across ELSE along END, CASE WHEN steep THEN along ELSE across END ORDER BY k, i, j) AS n FROM two),
drawn AS (
  SELECT px.img, px.x, px.y, CAST(0 AS BIGINT) AS n, CASE WHEN px.x BETWEEN span.a AND span.b THEN {color} ELSE v END AS v FROM px LEFT JOIN span ON px.y = span.y
  UNION ALL SELECT d.img, d.x, d.y, m.n, {Q.clamp(f"{color} * w + d.v * (1 - w)")} FROM drawn d JOIN mark m ON m.x = d.x AND m.y = d.y AND m.n = d.n + 1)
SELECT img, x, y, CAST(arg_max(v, n) AS INTEGER) AS v FROM drawn GROUP BY img, x, y"""
