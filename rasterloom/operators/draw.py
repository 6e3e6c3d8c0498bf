"""Drawing: generators of places, then an upsert into the raster.

A shape is a small table (seq, x, y); later places win.  Filled shapes are spans that
Spark expands, so a shape's size on the driver is its outline, not its area.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E

Span = tuple[int, int, int]  # y, first x, last x


def _round(v: float) -> int:
    """Half away from zero."""
    return int(math.copysign(math.floor(abs(v) + 0.5), v))


def line_points(start: tuple[float, float], end: tuple[float, float]) -> list[tuple[int, int]]:
    """Places of a segment along its longer axis: the minor axis has moved ceil(i * slope - 1/2) after i steps."""
    (x0, y0), (x1, y1) = start, end
    steep = abs(y1 - y0) > abs(x1 - x0)
    if steep:
        x0, y0, x1, y1 = y0, x0, y1, x1
    if x0 > x1:
        x0, y0, x1, y1 = x1, y1, x0, y0
    dx, dy, way = x1 - x0, abs(y1 - y0), 1 if y0 < y1 else -1
    out = []
    for i in range(int(x1) - int(x0) + 1):
        moved = max(0, math.ceil((2 * i * dy - dx) / (2 * dx))) if dx else 0
        p = (int(x0) + i, int(y0) + way * moved)
        out.append(p[::-1] if steep else p)
    return out


def wu_points(start: tuple[int, int], end: tuple[int, int]) -> list[tuple[int, int, float]]:
    """(x, y, weight): two places for each step of an anti-aliased segment."""
    (x0, y0), (x1, y1) = start, end
    steep = abs(y1 - y0) > abs(x1 - x0)
    if steep:
        x0, y0, x1, y1 = y0, x0, y1, x1
    if x0 > x1:
        x0, y0, x1, y1 = x1, y1, x0, y0
    slope = (y1 - y0) / (x1 - x0) if x1 != x0 else 0.0
    out = []
    for i in range(x1 - x0 + 1):
        at = y0 + slope * i
        low = int(at)
        for y, weight in ((low, 1 - (at - low)), (low + 1, at - low)):
            out.append((y, x0 + i, weight) if steep else (x0 + i, y, weight))
    return out


def circle_offsets(radius: int) -> list[tuple[int, int]]:
    """(x, y) of the octant from the top to the diagonal."""
    out, y, p = [], radius, 1 - radius
    for x in range(radius + 2):
        if x > y:
            break
        out.append((x, y))
        if p >= 0:
            y -= 1
        p += 2 * (x + 1) + 1 - (2 * y if p >= 0 else 0)
    return out


def ellipse_offsets(rx: int, ry: int) -> list[tuple[int, int]]:
    """(x, y) of the quadrant from the top to the side, by midpoint tests."""
    a, b = float(rx * rx), float(ry * ry)
    x, y = 0, ry
    out = [(x, y)]
    test = b - a * ry + 0.25 * a
    while 2 * b * x < 2 * a * y:  # the flat part: x moves on each step
        x += 1
        y -= test >= 0
        test += b + 2 * b * x - (2 * a * y if out[-1][1] != y else 0)
        out.append((x, y))
    test = b * (x + 0.5) ** 2 + a * (y - 1) ** 2 - a * b
    while y > 0:  # the steep part: y moves on each step
        y -= 1
        wide = test <= 0
        x += wide
        test += a - 2 * a * y + (2 * b * x if wide else 0)
        out.append((x, y))
    return out


def ellipse_points(center: tuple[int, int], rx: int, ry: int) -> list[tuple[int, int]]:
    cx, cy = center
    if rx == ry:
        near = [p for x, y in circle_offsets(rx) for p in ((x, y), (y, x))]
    else:
        near = ellipse_offsets(rx, ry)
    return [(cx + i * x, cy + j * y) for x, y in near for i in (1, -1) for j in (1, -1)]


def ellipse_spans(center: tuple[int, int], rx: int, ry: int) -> list[Span]:
    cx, cy = center
    if rx == ry:
        near = [p for x, y in circle_offsets(rx) for p in ((x, y), (y, x))]
    else:
        near = ellipse_offsets(rx, ry)
    return [(cy + j * y, cx - x, cx + x) for x, y in near for j in (1, -1)]


def rect_points(left: int, top: int, width: int, height: int) -> list[tuple[int, int]]:
    right, bottom = left + width - 1, top + height - 1
    sides = (((left, top), (right, top)), ((left, bottom), (right, bottom)), ((left, top), (left, bottom)), ((right, top), (right, bottom)))
    return [p for a, b in sides for p in line_points(a, b)]


def cross_points(x: int, y: int) -> list[tuple[int, int]]:
    return [(x, y - 1), (x - 1, y), (x, y), (x + 1, y), (x, y + 1)]


def _edges(poly: list[tuple[float, float]]) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    ring = list(poly) if poly[0] == poly[-1] else [*poly, poly[0]]
    return list(zip(ring, ring[1:], strict=False))


def polygon_spans(poly: list[tuple[int, int]], height: int) -> list[Span]:
    """Even-odd spans of each scan line within the raster's rows."""
    if not poly:
        return []
    clip = lambda y: max(0, min(y, height - 1))
    out = []
    for y in range(clip(min(p[1] for p in poly)), clip(max(p[1] for p in poly)) + 1):
        at: list[int] = []
        for (x0, y0), (x1, y1) in _edges(poly):
            if not min(y0, y1) <= y <= max(y0, y1):
                continue
            if y0 == y1:
                at += (x0, x1)
            elif y in (y0, y1):  # a vertex counts for the edge that goes on below it
                at += [x for x, other in ((x0, y1), (x1, y0)) if other > y]
            else:
                at.append(_round(x0 + (y - y0) / (y1 - y0) * (x1 - x0)))
        at.sort()
        out += [(y, a, b) for a, b in zip(at[::2], at[1::2], strict=False)]
    return out


def polygon_outline(poly: list[tuple[float, float]]) -> list[tuple[int, int]]:
    if len(poly) < 2:
        raise ValueError("an outline has two points at least")
    return [p for a, b in _edges(poly) for p in line_points(a, b)]


def bezier_points(start: tuple[float, float], end: tuple[float, float], a: tuple[float, float], b: tuple[float, float]) -> list[tuple[int, int]]:
    """A cubic curve as floor(sqrt(length^2 + 800) / 8) segments between rounded places."""
    length = math.dist(start, a) + math.dist(a, b) + math.dist(b, end)
    n = int(math.sqrt(length * length + 800) / 8)

    def at(t: float) -> tuple[int, int]:
        m = 1 - t
        return tuple(_round(start[k] * m**3 + 3 * a[k] * m * m * t + 3 * b[k] * m * t * t + end[k] * t**3) for k in (0, 1))

    return [p for i in range(n) for p in line_points(at(i / n), at((i + 1) / n))]


# ---- upserts -----------------------------------------------------------------------------------


def paint(r: DataFrame, points: Iterable[tuple[int, int]], color: list[int]) -> DataFrame:
    """Writes ``color`` (a value per channel) at places of every raster; places outside are dropped."""
    return paint_spans(r, [(y, x, x) for x, y in points], color)


def paint_spans(r: DataFrame, spans: Iterable[Span], color: list[int]) -> DataFrame:
    """Writes ``color`` on spans of every raster."""
    rows = sorted({(int(y), int(a), int(b)) for y, a, b in spans if a <= b})
    marks = r.sparkSession.createDataFrame(rows, "y int, a int, b int").groupBy("y").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    value = F.element_at(F.array(*[F.lit(v) for v in color]), F.col("c") + 1)
    hit = F.exists("spans", lambda s: (F.col("x") >= s["a"]) & (F.col("x") <= s["b"]))
    return r.join(marks, "y", "left").select("img", "w", "h", "c", "x", "y", F.when(hit, value).otherwise(F.col("v")).alias("v"))


def paint_weighted(r: DataFrame, points: list[tuple[int, int, float]], color: list[int], blend: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``blend(colour, old, weight)`` at weighted places; a place met twice blends twice, in order."""
    order: dict[tuple[int, int], list[float]] = {}
    for x, y, weight in points:
        order.setdefault((x, y), []).append(float(weight))
    marks = r.sparkSession.createDataFrame([(x, y, w) for (x, y), w in order.items()], "x int, y int, weights array<double>")
    value = F.element_at(F.array(*[F.lit(v) for v in color]), F.col("c") + 1)
    new = F.aggregate(F.coalesce("weights", F.array().cast("array<double>")), F.col("v").cast("int"), lambda old, w: blend(value, old, w).cast("int"))
    return r.join(marks, ["x", "y"], "left").select("img", "w", "h", "c", "x", "y", new.alias("v"))


def composite(r: DataFrame, marks: DataFrame) -> DataFrame:
    """``r``, rasters of four channels of 8 bits, with translucent ``marks(seq, y, a, b, c0, c1, c2, c3)`` blended in order.

    A mark covers places a to b of row y in every raster.  Each place folds the marks over it by ``seq``, one after the
    other, each result narrowed to 8 bits before the next; a place that a shape meets twice is blended twice.
    """
    rows = marks.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("seq", "a", "b", "c0", "c1", "c2", "c3"))).alias("marks"))
    pixels = r.groupBy("img", "w", "h", "x", "y").agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).cast("int").alias(f"c{c}") for c in range(4)])
    names = [f"c{c}" for c in range(4)]
    over = F.filter(F.coalesce("marks", F.array().cast(rows.schema["marks"].dataType)), lambda m: (m["a"] <= F.col("x")) & (F.col("x") <= m["b"]))
    blended = lambda old, m: F.struct(*[v.cast("int").alias(n) for n, v in zip(names, E.source_over([m[n] for n in names], [old[n] for n in names]), strict=True)])
    folded = pixels.join(rows, "y", "left").withColumn("out", F.aggregate(over, F.struct(*names), blended))
    return folded.select("img", "w", "h", "x", "y", F.posexplode(F.array(*[F.col(f"out.{n}") for n in names])).alias("c", "v")).select("img", "w", "h", "c", "x", "y", "v")


def mark_rows(spark: SparkSession, layers: list[tuple[Iterable[Span], list[int]]]) -> DataFrame:
    """Marks of :func:`composite` for shapes, given as spans with their colours, in drawing order."""
    listed = ((*span, color) for spans, color in layers for span in spans)
    rows = [(seq, int(y), int(a), int(b), *map(int, color)) for seq, (y, a, b, color) in enumerate(listed)]
    return spark.createDataFrame(rows, "seq int, y int, a int, b int, c0 int, c1 int, c2 int, c3 int")


def point_spans(points: Iterable[tuple[int, int]]) -> list[Span]:
    return [(y, x, x) for x, y in points]


def draw_line(r: DataFrame, start: tuple[float, float], end: tuple[float, float], color: list[int]) -> DataFrame:
    return paint(r, line_points(start, end), color)


def draw_filled_rect(r: DataFrame, left: int, top: int, width: int, height: int, color: list[int]) -> DataFrame:
    """A projection: no join."""
    value = F.element_at(F.array(*[F.lit(v) for v in color]), F.col("c") + 1)
    hit = F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1)
    return r.withColumn("v", F.when(hit, value).otherwise(F.col("v")))


def draw_polygon(r: DataFrame, poly: list[tuple[int, int]], color: list[int]) -> DataFrame:
    height = r.agg(F.max("h")).first()[0] or 0
    return paint_spans(r, [*polygon_spans(poly, height), *((y, x, x) for x, y in polygon_outline(poly))], color)


def draw_antialiased_polygon(r: DataFrame, poly: list[tuple[int, int]], color: list[int], blend: Callable[[Column, Column, Column], Column]) -> DataFrame:
    height = r.agg(F.max("h")).first()[0] or 0
    filled = paint_spans(r, polygon_spans(poly, height), color)
    return paint_weighted(filled, [p for a, b in _edges(poly) for p in wu_points(a, b)], color, blend)


# ---- segments that come from a table ---------------------------------------------------------------


def segment_places(segments: DataFrame) -> DataFrame:
    """``segments(img, x0, y0, x1, y1)`` as (img, x, y): the places of :func:`line_points`, made by Spark."""
    steep = F.abs(F.col("y1") - F.col("y0")) > F.abs(F.col("x1") - F.col("x0"))
    turned = segments.select("img", steep.alias("steep"), *[F.when(steep, F.col(a)).otherwise(F.col(b)).cast("double").alias(n) for n, a, b in (("a0", "y0", "x0"), ("b0", "x0", "y0"), ("a1", "y1", "x1"), ("b1", "x1", "y1"))])
    back = F.col("a0") > F.col("a1")
    one_way = turned.select("img", "steep", *[F.when(back, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("a0", "a1"), ("b0", "b1"), ("a1", "a0"), ("b1", "b0"))])
    dx, dy, i = F.col("a1") - F.col("a0"), F.abs(F.col("b1") - F.col("b0")), F.col("i")
    moved = F.when(dx > 0, F.greatest(F.lit(0), F.ceil(F.try_divide(2 * i * dy - dx, 2 * dx)))).otherwise(0)
    steps = one_way.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a1").cast("int") - F.col("a0").cast("int"))))
    along = F.col("a0").cast("int") + i
    across = (F.col("b0").cast("int") + F.when(F.col("b0") < F.col("b1"), moved).otherwise(-moved)).cast("int")
    return steps.select("img", F.when(F.col("steep"), across).otherwise(along).alias("x"), F.when(F.col("steep"), along).otherwise(across).alias("y"))


def draw_segments(r: DataFrame, segments: DataFrame, color: list[int]) -> DataFrame:
    """Each raster's own segments, in one colour."""
    marks = segment_places(segments).distinct().withColumn("marked", F.lit(True))
    value = F.when(F.col("marked"), F.element_at(F.array(*[F.lit(v) for v in color]), F.col("c") + 1)).otherwise(F.col("v"))
    return r.join(marks, ["img", "x", "y"], "left").select("img", "w", "h", "c", "x", "y", value.alias("v"))


def intersection_points(lines: DataFrame) -> DataFrame:
    """``lines(img, w, h, r, angle)`` with x0, y0, x1, y1: where x cos(angle) + y sin(angle) = r meets the box of sides w and h; null where it doesn't.

    Of more than two meeting points (at corners) the first two of right, left, bottom and top count.
    """
    r, w, h = (F.col(c).cast("double") for c in ("r", "w", "h"))
    s, c = F.sin(F.radians("angle")), F.cos(F.radians("angle"))
    zero = F.lit(0.0)
    point = lambda x, y, ok: F.struct(x.alias("x"), y.alias("y"), ok.alias("ok"))
    on_side = lambda y: F.coalesce(y.between(zero, h), F.lit(False))
    on_end = lambda x: F.coalesce(x.between(zero, w), F.lit(False))
    right, left, bottom, top = F.try_divide(r - w * c, s), F.try_divide(r, s), F.try_divide(r - h * s, c), F.try_divide(r, c)
    slanted = F.filter(F.array(point(w, right, on_side(right)), point(zero, left, on_side(left)), point(bottom, h, on_end(bottom)), point(top, zero, on_end(top))), lambda p: p["ok"])
    upright = F.array(point(r, zero, on_end(r)), point(r, h, on_end(r)))
    level = F.array(point(zero, r, on_side(r)), point(w, r, on_side(r)))
    found = F.filter(F.when(F.col("angle") == 0, upright).when(F.col("angle") == 90, level).otherwise(slanted), lambda p: p["ok"])
    met = lines.withColumn("found", F.when(F.size(found) > 1, found))
    return met.select(*lines.columns, *[F.get("found", F.lit(i))[a].alias(f"{a}{i}") for i in (0, 1) for a in ("x", "y")])


def draw_polar_lines(r: DataFrame, lines: DataFrame, color: list[int]) -> DataFrame:
    """``lines(img, r, angle)``, such as Hough lines, drawn on their rasters."""
    sized = lines.select("img", "r", "angle").join(r.groupBy("img").agg(F.max("w").alias("w"), F.max("h").alias("h")), "img")
    return draw_segments(r, intersection_points(sized).where("x0 is not null"), color)


def draw_haar_feature(r: DataFrame, columns: int, rows: int, sign: int, block_w: int, block_h: int, left: int, top: int) -> DataFrame:
    """A feature of ``columns`` by ``rows`` blocks, signs alternating: positive blocks white, negative ones black."""
    i, j = F.floor((F.col("x") - left) / block_w), F.floor((F.col("y") - top) / block_h)
    inside = F.col("x").between(left, left + columns * block_w - 1) & F.col("y").between(top, top + rows * block_h - 1)
    white = ((i + j + (0 if sign > 0 else 1)) % 2 == 0) | (F.col("c") == 3)
    return r.withColumn("v", F.when(inside, F.when(white, 255).otherwise(0)).otherwise(F.col("v")))


def star_places(side: int, bins: int, signed: bool) -> dict[tuple[int, int], int]:
    """Places of a square of ``side`` and the bin whose ray from the centre is drawn there last; angles in single precision."""
    out = {}
    one = np.float32
    centre, reach = float(side // 2), one(side / 2)
    for b in range(bins):
        for turn in (one(0),) if signed else (one(0), one(math.pi)):
            angle = one((2 if signed else 1) * math.pi) * one(b) / one(bins) + turn
            end = (float(one(centre) - reach * np.sin(angle)), float(one(centre) + reach * np.cos(angle)))
            for x, y in line_points((centre, centre), end):
                if 0 <= x < side and 0 <= y < side:
                    out[x, y] = b
    return out


def render_hist_grid(cells: DataFrame, side: int, bins: int, signed: bool) -> DataFrame:
    """``cells(img, cx, cy, bin, v)`` as a gray raster: a star of ``side`` for each cell, a ray's intensity its bin's value."""
    from ..functions.expr import clamp_trunc

    places = star_places(side, bins, signed)
    star = cells.sparkSession.createDataFrame([(x, y, places.get((x, y), -1)) for y in range(side) for x in range(side)], "px int, py int, ray int")
    grid = cells.groupBy("img", "cx", "cy").agg(F.map_from_entries(F.collect_list(F.struct("bin", "v"))).alias("hist"))
    sides = grid.groupBy("img").agg(((F.max("cx") + 1) * side).alias("w"), ((F.max("cy") + 1) * side).alias("h"))
    value = F.coalesce(F.try_element_at("hist", F.col("ray")), F.lit(0.0))
    placed = grid.join(sides, "img").crossJoin(F.broadcast(star))  # side * side places, whatever the cells
    return placed.select("img", "w", "h", F.lit(0).alias("c"), (F.col("cx") * side + F.col("px")).alias("x"), (F.col("cy") * side + F.col("py")).alias("y"), clamp_trunc(value).alias("v"))
