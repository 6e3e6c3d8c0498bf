"""Point lists: measures by windows, hulls and simplification per group.

Tables have (grp, seq, x, y).  Hulls need a group's points together, so those
operators take a group per task call; a group is one outline.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POINTS = "grp long, seq int, x double, y double"


def _ring():
    return W.partitionBy("grp").orderBy("seq"), W.partitionBy("grp").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def arc_length(points: DataFrame, closed: bool = False) -> DataFrame:
    """(grp, length); a closed arc of more than two points returns to its first."""
    line, whole = _ring()
    dx, dy = F.col("x") - F.lag("x").over(line), F.col("y") - F.lag("y").over(line)
    back = F.when((F.row_number().over(line) == 1) & (F.count("*").over(whole) > 2), F.hypot(F.col("x") - F.last("x").over(whole), F.col("y") - F.last("y").over(whole)))
    step = F.coalesce(F.hypot(dx, dy), back if closed else F.lit(None).cast("double"), F.lit(0.0))
    return points.withColumn("step", step).groupBy("grp").agg(F.sum("step").alias("length"))


def oriented_contour_area(points: DataFrame) -> DataFrame:
    """(grp, area) by the shoelace formula, signed; 0 for fewer than three points."""
    line, whole = _ring()
    px, py = F.coalesce(F.lag("x").over(line), F.last("x").over(whole)), F.coalesce(F.lag("y").over(line), F.last("y").over(whole))
    part = F.when(F.count("*").over(whole) < 3, 0.0).otherwise(px * F.col("y") - F.col("x") * py)
    return points.withColumn("part", part).groupBy("grp").agg((F.sum("part") * 0.5).alias("area"))


def contour_area(points: DataFrame) -> DataFrame:
    return oriented_contour_area(points).withColumn("area", F.abs("area"))


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull from the lowest (then leftmost) point, by two monotone chains."""
    p = np.unique(points, axis=0)
    p = p[np.lexsort((p[:, 0], p[:, 1]))]
    if len(p) < 3:
        return p

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and np.cross(np.trunc(out[-1]) - np.trunc(out[-2]), np.trunc(q) - np.trunc(out[-1])) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def _box(hull: np.ndarray) -> np.ndarray:
    """The least rectangle with a side along an edge of the hull's open outline: top left, top right, bottom right, bottom left.

    For the unit vector u of an edge, the rectangle's sides are the extents of the dot products u.p and of the cross
    products u x p over the hull, and p = (u.p) u + (u x p) u' with u' a quarter turn of u.  The two corners of least x are
    the left ones, and of either side the one of least y is the top one.  Corners move outwards to integers: left and top
    ones down, right and bottom ones up.
    """
    if len(hull) < 3:
        return hull[[0, -1, -1, 0]]
    edge = np.diff(hull, axis=0)
    u = edge / np.hypot(edge[:, 0], edge[:, 1])[:, None]
    dot, cross = u @ hull.T, np.outer(u[:, 0], hull[:, 1]) - np.outer(u[:, 1], hull[:, 0])
    best = int(np.round(np.ptp(dot, 1) * np.ptp(cross, 1), 9).argmin())
    (ux, uy), along, across = u[best], dot[best], cross[best]
    corners = [(d * ux - c * uy, d * uy + c * ux) for d in (along.min(), along.max()) for c in (across.min(), across.max())]
    by_x = sorted(np.round(corners, 9).tolist())
    (top_left, bottom_left), (top_right, bottom_right) = (sorted(side, key=lambda p: p[1]) for side in (by_x[:2], by_x[2:]))
    outwards = {0: (math.floor, math.floor), 1: (math.ceil, math.floor), 2: (math.ceil, math.ceil), 3: (math.floor, math.ceil)}
    return np.array([[move(v) for move, v in zip(outwards[i], p, strict=True)] for i, p in enumerate((top_left, top_right, bottom_right, bottom_left))], float)


def _simplified(points: np.ndarray, epsilon: float, closed: bool) -> np.ndarray:
    """Douglas-Peucker with an explicit stack."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        chord = points[b] - points[a]
        size = math.hypot(*chord)
        if b - a < 2 or size == 0:  # a chord without length has no distances
            continue
        off = np.abs(np.cross(chord, points[a + 1 : b] - points[a])) / size
        k = int(off.argmax())
        if off[k] > epsilon:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    out = points[keep]
    return out[:-1] if closed else out


def _grouped(points: DataFrame, run) -> DataFrame:
    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        out = run(frame[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"grp": frame["grp"].iloc[0], "seq": np.arange(len(out), dtype=np.int32), "x": out[:, 0], "y": out[:, 1]})

    return points.select("grp", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy("grp").applyInPandas(each, POINTS)


def convex_hull(points: DataFrame) -> DataFrame:
    return _grouped(points, _hull)


def min_area_rect(points: DataFrame) -> DataFrame:
    return _grouped(points, lambda p: _box(_hull(p)))


def approximate_polygon(points: DataFrame, epsilon: float, closed: bool) -> DataFrame:
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    return _grouped(points, lambda p: _simplified(p, epsilon, closed))


# ---- rectangles as columns ---------------------------------------------------------------------


def rect(left: Column | int, top: Column | int, width: Column | int, height: Column | int) -> Column:
    """A rectangle; its right and bottom sides belong to it."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(value(left).alias("left"), value(top).alias("top"), value(width).alias("width"), value(height).alias("height"))


def rect_right(r: Column) -> Column:
    return r["left"] + r["width"] - 1


def rect_bottom(r: Column) -> Column:
    return r["top"] + r["height"] - 1


def rect_contains(r: Column, x: Column, y: Column) -> Column:
    return x.between(r["left"], rect_right(r)) & y.between(r["top"], rect_bottom(r))


def rect_intersect(a: Column, b: Column) -> Column:
    """The common rectangle, null where there is none."""
    left, top = F.greatest(a["left"], b["left"]), F.greatest(a["top"], b["top"])
    right, bottom = F.least(rect_right(a), rect_right(b)), F.least(rect_bottom(a), rect_bottom(b))
    return F.when((right >= left) & (bottom >= top), rect(left, top, right - left + 1, bottom - top + 1))


def line_distance(px: Column, py: Column, qx: Column, qy: Column, x: Column, y: Column) -> Column:
    """Distance of (x, y) from the line through p and q; NaN where they coincide."""
    size = F.hypot(qx - px, qy - py)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(F.abs((qx - px) * (y - py) - (qy - py) * (x - px)) / F.when(size == 0, 1.0).otherwise(size))
