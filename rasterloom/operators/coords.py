"""Geometry of the grid as projections on coordinates, and warps by inverse mapping."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from . import stencil as T


def _moved(r: DataFrame, x: Column, y: Column, swap: bool = False) -> DataFrame:
    w, h = (F.col("h"), F.col("w")) if swap else (F.col("w"), F.col("h"))
    return r.select("img", w.alias("w"), h.alias("h"), "c", x.alias("x"), y.alias("y"), "v")


def crop(r: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """A rectangle of each raster; the range filter reaches the scan.  It must lie inside."""
    if min(left, top) < 0 or min(width, height) < 1:
        raise ValueError("a rectangle has sides and a place in the raster")
    inside = r.where(F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1))
    ok = F.assert_true((F.col("w") >= left + width) & (F.col("h") >= top + height), "the rectangle leaves the raster")
    return inside.where(ok.isNull()).select("img", F.lit(width).alias("w"), F.lit(height).alias("h"), "c", (F.col("x") - left).alias("x"), (F.col("y") - top).alias("y"), "v")


def flip_horizontal(r: DataFrame) -> DataFrame:
    return _moved(r, F.col("w") - 1 - F.col("x"), F.col("y"))


def flip_vertical(r: DataFrame) -> DataFrame:
    return _moved(r, F.col("x"), F.col("h") - 1 - F.col("y"))


def rotate90(r: DataFrame) -> DataFrame:
    """Clockwise."""
    return _moved(r, F.col("h") - 1 - F.col("y"), F.col("x"), swap=True)


def rotate180(r: DataFrame) -> DataFrame:
    return _moved(r, F.col("w") - 1 - F.col("x"), F.col("h") - 1 - F.col("y"))


def rotate270(r: DataFrame) -> DataFrame:
    return _moved(r, F.col("y"), F.col("w") - 1 - F.col("x"), swap=True)


def replace(bottom: DataFrame, top: DataFrame, x: int, y: int) -> DataFrame:
    """Pastes ``top`` (of the same img) at (x, y), clipped."""
    over = top.select("img", "c", (F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"), F.col("v").alias("t"))
    return bottom.join(over, ["img", "c", "x", "y"], "left").select("img", "w", "h", "c", "x", "y", F.coalesce("t", "v").alias("v"))


def overlay(bottom: DataFrame, top: DataFrame, x: int, y: int) -> DataFrame:
    """Source-over blend of four-channel rasters of 8 bits at (x, y), clipped."""
    def pixel(r: DataFrame, name: str, dx: int, dy: int) -> DataFrame:
        return r.groupBy("img", "w", "h", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")).agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(f"{name}{c}") for c in range(4)])

    both = pixel(bottom, "b", 0, 0).join(pixel(top, "t", x, y).drop("w", "h"), ["img", "x", "y"], "left")
    out = E.source_over([F.col(f"t{c}") for c in range(4)], [F.col(f"b{c}") for c in range(4)])
    return both.select("img", "w", "h", "x", "y", F.posexplode(F.array(*out)).alias("c", "v")).select("img", "w", "h", "c", "x", "y", "v")


# ---- warps ------------------------------------------------------------------------------


@dataclasses.dataclass(frozen=True)
class Projection:
    """A 3x3 transform of the plane, row-major, with last element 1."""

    matrix: tuple[float, ...]

    @staticmethod
    def from_matrix(matrix: list[float]) -> Projection | None:
        m = np.array(matrix, np.float64).reshape(3, 3)
        if abs(np.linalg.det(m)) < 1e-10 or m[2, 2] == 0:
            return None
        return Projection(tuple((m / m[2, 2]).ravel().tolist()))

    @staticmethod
    def translate(tx: float, ty: float) -> Projection:
        return Projection((1.0, 0.0, tx, 0.0, 1.0, ty, 0.0, 0.0, 1.0))

    @staticmethod
    def rotate(theta: float) -> Projection:
        s, c = math.sin(theta), math.cos(theta)
        return Projection((c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0))

    @staticmethod
    def scale(sx: float, sy: float) -> Projection:
        return Projection((sx, 0.0, 0.0, 0.0, sy, 0.0, 0.0, 0.0, 1.0))

    @staticmethod
    def from_control_points(from_: list[tuple[float, float]], to: list[tuple[float, float]]) -> Projection | None:
        """The homography that maps four points to four others."""
        rows, right = [], []
        for (x, y), (u, v) in zip(from_, to, strict=True):
            rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
            right += [u, v]
        found, _, rank, _ = np.linalg.lstsq(np.array(rows, float), np.array(right, float), rcond=None)
        return Projection.from_matrix([*found, 1.0]) if rank == 8 else None

    def __mul__(self, other: Projection) -> Projection:
        """Applies ``other`` first."""
        m = np.array(self.matrix).reshape(3, 3) @ np.array(other.matrix).reshape(3, 3)
        return Projection(tuple((m / m[2, 2]).ravel().tolist()))

    def and_then(self, other: Projection) -> Projection:
        return other * self

    def invert(self) -> Projection:
        m = np.linalg.inv(np.array(self.matrix).reshape(3, 3))
        return Projection(tuple((m / m[2, 2]).ravel().tolist()))

    def kind(self) -> str:
        a, b, _, d, e, _, g, h, _ = self.matrix
        if abs(g) > 1e-10 or abs(h) > 1e-10:
            return "projection"
        return "translation" if max(abs(a - 1), abs(b), abs(d), abs(e - 1)) < 1e-10 else "affine"

    def columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The image of a point, as expressions made for the transform's kind."""
        a, b, c, d, e, f, g, h, i = (F.lit(float(v)) for v in self.matrix)
        if self.kind() == "translation":
            return x + c, y + f
        if self.kind() == "affine":
            return a * x + b * y + c, d * x + e * y + f
        bottom = g * x + h * y + i
        return (a * x + b * y + c) / bottom, (d * x + e * y + f) / bottom


def _taps(grid: DataFrame, source: DataFrame, x: Column, y: Column, side: int, first: int, border: str | int) -> DataFrame:
    """``grid`` with ``t``, the array of source values at the ``side`` x ``side`` taps from (x + first, y + first) on, row by row.

    Each place of the grid is one row, sent to the source's tile that holds its first tap (moved into the raster);
    a tile has the ``side - 1`` places beyond it too, and looks all taps up.  Taps that go around the
    border and come back elsewhere meet the source on their places.
    """
    left, top = (x + first).cast("bigint"), (y + first).cast("bigint")
    if border == "wrap" and side > 1:
        return _joined_taps(grid, source, [left + k for k in range(side)], [top + k for k in range(side)])
    inside = (lambda at, n: F.pmod(at, n)) if border == "wrap" else (lambda at, n: E.clip_to(at, F.lit(0), n - 1))
    asked = grid.withColumn("ax", F.least(F.greatest(left, F.lit(-side)), F.col("sw").cast("bigint")) if border != "wrap" else inside(left, F.col("sw")))
    asked = asked.withColumn("ay", F.least(F.greatest(top, F.lit(-side)), F.col("sh").cast("bigint")) if border != "wrap" else inside(top, F.col("sh")))
    tile = lambda at, n: F.floor(inside(F.col(at), F.col(n)) / T.TILE).cast("int")
    asked = asked.select("*", tile("ax", "sw").alias("tx"), tile("ay", "sh").alias("ty"), F.lit(1).alias("asks")).withColumn("ax", F.col("ax").cast("int")).withColumn("ay", F.col("ay").cast("int"))
    held = T.tiled(source.select("img", "w", "h", "c", "x", "y", "v"), 0, side - 1, 0, side - 1)
    held = held.select("img", "c", "tx", "ty", F.lit(0).alias("asks"), F.col("x").alias("ax"), F.col("y").alias("ay"), "v")
    key, own = ["img", "c", "tx", "ty"], grid.columns
    rows = asked.unionByName(held, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, "ay", "ax")
    kind = source.schema["v"].dataType.simpleString()
    fill = border if isinstance(border, int) else 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in T.whole_groups(batches, key):
            group = T.group_numbers(table, key)
            ax, ay, asks = (table.column(n).to_numpy() for n in ("ax", "ay", "asks"))
            is_held = asks == 0
            chosen = np.flatnonzero(~is_held)
            if not len(chosen) or not is_held.any():
                continue
            v = table.column("v").filter(pa.array(is_held)).to_numpy()
            numbers = np.unique(group[is_held])  # each asked tile is held
            among, mine = np.searchsorted(numbers, group[is_held]), np.searchsorted(numbers, group[chosen])
            places = T.Places(among, ax[is_held], ay[is_held])
            values = np.full(places.total, fill, v.dtype)
            values[places.at(among, ax[is_held], ay[is_held])] = v
            px, py = ax[chosen][:, None] + np.tile(np.arange(side), side), ay[chosen][:, None] + np.repeat(np.arange(side), side)
            if border == "replicate":
                px = np.clip(px, 0, table.column("sw").to_numpy()[chosen].astype(np.int64)[:, None] - 1)
                py = np.clip(py, 0, table.column("sh").to_numpy()[chosen].astype(np.int64)[:, None] - 1)
            at = places.at(mine[:, None], px, py)
            t = np.where(at < 0, np.asarray(fill, v.dtype), values[at])
            lists = pa.ListArray.from_arrays(np.arange(len(chosen) + 1, dtype=np.int32) * (side * side), pa.array(t.ravel()))
            yield pa.RecordBatch.from_arrays([*(table.column(n).take(pa.array(chosen)).combine_chunks() for n in own), lists], [*own, "t"])

    schema = ", ".join(f"{n} {t}" for n, t in grid.dtypes)
    return rows.mapInArrow(read, f"{schema}, t array<{kind}>")


def _joined_taps(grid: DataFrame, source: DataFrame, xs: list[Column], ys: list[Column]) -> DataFrame:
    """The taps of places that go around the border: one row per tap meets the source on its place."""
    places = F.array(*[F.struct(x.alias("sx"), y.alias("sy")) for y in ys for x in xs])
    rows = grid.select("*", F.posexplode(places).alias("k", "s"))
    rows = rows.withColumn("sx", F.pmod("s.sx", F.col("sw")).cast("int")).withColumn("sy", F.pmod("s.sy", F.col("sh")).cast("int")).drop("s")
    src = source.select("img", "c", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("v"))
    met = rows.join(src, ["img", "c", "sx", "sy"], "left")
    return met.groupBy(*grid.columns).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("v", F.lit(0)).alias("v")))), lambda s: s["v"]).alias("t"))


def output_grid(r: DataFrame, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """(img, w, h, sw, sh, c, x, y): every place of an output of the given size (the source's by default)."""
    rasters = r.select("img", F.col("w").alias("sw"), F.col("h").alias("sh"), "c").distinct()
    rasters = rasters.withColumn("w", (width if width is not None else F.col("sw")).cast("int")).withColumn("h", (height if height is not None else F.col("sh")).cast("int"))
    rows = rasters.where("w > 0 and h > 0").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))


def warp_with(r: DataFrame, mapping: Callable[[Column, Column], tuple[Column, Column]], interpolation: str = "nearest", border: str | int = 0, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Each output place reads the source at ``mapping(x, y)``.

    ``interpolation``: nearest, bilinear or bicubic.  ``border``: a value, "replicate" or "wrap".
    """
    grid = output_grid(r, width, height)
    fx, fy = mapping(F.col("x").cast("double"), F.col("y").cast("double"))
    grid = grid.withColumn("fx", fx).withColumn("fy", fy)
    x, y = F.col("fx"), F.col("fy")
    if interpolation == "nearest":
        out = _taps(grid, r, F.floor(x + 0.5), F.floor(y + 0.5), 1, 0, border).withColumn("v", F.element_at("t", 1))
    elif interpolation == "bilinear":
        t = _taps(grid, r, F.floor(x), F.floor(y), 2, 0, border)
        rx, ry = x - F.floor(x), y - F.floor(y)
        at = lambda k: F.element_at("t", k + 1)
        lerp = lambda p, q, k: E.clamp_trunc(p * (1.0 - k) + q * k)
        out = t.withColumn("v", lerp(lerp(at(0), at(1), rx), lerp(at(2), at(3), rx), ry))
    elif interpolation == "bicubic":
        t = _taps(grid, r, F.floor(x), F.floor(y), 4, -1, border)

        def cubic(p: list[Column], k: Column) -> Column:
            a, b, c, d = p
            return E.clamp_trunc(b + 0.5 * k * (c - a + k * (2.0 * a - 5.0 * b + 4.0 * c - d + k * (3.0 * (b - c) + d - a))))

        lines = [cubic([F.element_at("t", 4 * j + i + 1) for i in range(4)], x - F.floor(x)) for j in range(4)]
        out = t.withColumn("v", cubic(lines, y - F.floor(y)))
    else:
        raise ValueError(f"no interpolation {interpolation}")
    return out.select("img", "w", "h", "c", "x", "y", F.col("v").cast("int").alias("v"))


def warp(r: DataFrame, projection: Projection, interpolation: str = "nearest", border: str | int = 0, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Moves the raster by ``projection`` (each output place is mapped back)."""
    return warp_with(r, projection.invert().columns, interpolation, border, width, height)


def translate(r: DataFrame, tx: int, ty: int, border: str | int = 0) -> DataFrame:
    return warp_with(r, lambda x, y: (x - tx, y - ty), "nearest", border)


def rotate(r: DataFrame, center: tuple[float, float], theta: float, interpolation: str = "nearest", border: str | int = 0) -> DataFrame:
    cx, cy = center
    return warp(r, Projection.translate(cx, cy) * Projection.rotate(theta) * Projection.translate(-cx, -cy), interpolation, border)


def rotate_about_center(r: DataFrame, theta: float, interpolation: str = "nearest", border: str | int = 0) -> DataFrame:
    """About (w/2, h/2) of each raster, whatever its size."""
    s, c = math.sin(-theta), math.cos(-theta)
    cx, cy = F.col("sw") / 2.0, F.col("sh") / 2.0
    return warp_with(r, lambda x, y: ((x - cx) * c - (y - cy) * s + cx, (x - cx) * s + (y - cy) * c + cy), interpolation, border)


def rotate_about_center_no_crop(r: DataFrame, theta: float, interpolation: str = "nearest", border: str | int = 0) -> DataFrame:
    """The same in an output that holds the whole turned raster."""
    s, c = math.sin(-theta), math.cos(-theta)
    w, h = F.col("sw"), F.col("sh")
    width = F.ceil(h * abs(math.sin(theta)) + w * abs(math.cos(theta)))
    height = F.ceil(h * abs(math.cos(theta)) + w * abs(math.sin(theta)))
    ox, oy = F.col("w") / 2.0, F.col("h") / 2.0
    return warp_with(r, lambda x, y: ((x - ox) * c - (y - oy) * s + w / 2.0, (x - ox) * s + (y - oy) * c + h / 2.0), interpolation, border, width, height)
