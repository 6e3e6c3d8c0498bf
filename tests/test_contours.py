"""Contours against border following on a whole grid."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_large_rasters import raster, spiral

from rasterloom.operators import outlines as O

RING, EAST = O.RING, O.EAST


class _Borders:
    """Border following on a grid of marks: 0 is outside, 1 unvisited, +-n on border n."""

    def __init__(self, white: np.ndarray):
        self.h, self.w = white.shape
        self.marks = np.zeros((self.h + 2, self.w + 2), np.int64)
        self.marks[1:-1, 1:-1] = white
        self.found: list[tuple[list[tuple[int, int]], str, int | None]] = []

    def turn(self, x: int, y: int, start: int, step: int) -> int | None:
        """The first direction from ``start`` on, clockwise (1) or back (-1), that leads inside."""
        for k in range(8):
            d = (start + step * k) % 8
            if self.marks[y + 1 + RING[d, 1], x + 1 + RING[d, 0]]:
                return d
        return None

    def follow(self, x: int, y: int, start: int, number: int) -> list[tuple[int, int]]:
        first = self.turn(x, y, start, 1)
        if first is None:
            self.marks[y + 1, x + 1] = -number
            return [(x, y)]
        goal = (x + RING[first, 0], y + RING[first, 1])
        points, at, back = [], (x, y), first
        while True:
            points.append((int(at[0]), int(at[1])))
            ahead = self.turn(at[0], at[1], back - 1, -1)  # back from the place we came from
            turned = (back - 1 - ahead) % 8  # directions that were outside
            passed_east = any((back - 1 - k) % 8 == EAST for k in range(turned))
            here = self.marks[at[1] + 1, at[0] + 1]
            if at[0] + 1 == self.w or passed_east:
                self.marks[at[1] + 1, at[0] + 1] = -number
            elif here == 1:
                self.marks[at[1] + 1, at[0] + 1] = number
            after = (at[0] + RING[ahead, 0], at[1] + RING[ahead, 1])
            if after == (x, y) and at == goal:
                return points
            at, back = after, (ahead + 4) % 8

    def scan(self) -> list[tuple[list[tuple[int, int]], str, int | None]]:
        for y in range(self.h):
            last = 1
            for x in range(self.w):
                here = self.marks[y + 1, x + 1]
                if not here:
                    continue
                kind = None
                if here == 1 and x > 0 and not self.marks[y + 1, x]:
                    kind, start = "outer", 0
                elif here > 0 and x + 1 < self.w and not self.marks[y + 1, x + 2]:
                    kind, start = "hole", EAST
                    last = here if here > 1 else last
                if kind:
                    parent = None
                    if last > 1:
                        parent = int(last) - 2
                        if self.found[parent][1] == kind:
                            parent = self.found[parent][2]
                    self.found.append((self.follow(x, y, start, len(self.found) + 2), kind, parent))
                here = self.marks[y + 1, x + 1]
                last = abs(here) if here != 1 else last
        return self.found


def brute(values, threshold=0):
    return [(k, i, int(x), int(y), kind, parent) for k, (points, kind, parent) in enumerate(_Borders(values > threshold).scan()) for i, (x, y) in enumerate(points)]


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.img, []).append((r.contour, r.seq, r.x, r.y, r.border, r.parent))
    return {k: sorted(v, key=lambda p: p[:2]) for k, v in out.items()}


def check(spark, made):
    r = None
    for i, values in enumerate(made):
        one = raster(spark, values, i)
        r = one if r is None else r.unionByName(one)
    got = found(O.find_contours(r))
    for i, values in enumerate(made):
        assert got.get(i, []) == brute(values), values.tolist()


@pytest.mark.parametrize("seed", range(2))
def test_random_rasters(spark, seed):
    """Of many sizes and densities; dense and narrow ones have rows that touch both sides, so borders begin late."""
    rng = np.random.default_rng(seed)
    check(spark, [(rng.random((rng.integers(1, 12), rng.integers(1, 12))) < rng.choice([0.1, 0.5, 0.75, 0.9])).astype(int) for _ in range(150)])


def test_borders_that_begin_late(spark):
    """Full first rows, holes beside the place where the outer border begins, single columns and places."""
    text = ["111 101 111", "1111 0101 1111", "11111 01011 11011 11111", "1", "10 01", "111 111 010 111", "1111 0110 1001 1111", "1 0 1", "0110 0000 1111", "11111 10001 10101 10001 11111", "111111 010101 111111 101011 111111"]
    check(spark, [np.array([[int(c) for c in row] for row in t.split()]) for t in text])


def test_nested_and_long_borders(spark):
    rings = np.zeros((41, 41), int)
    for k in range(0, 20, 2):
        rings[k : 41 - k, k : 41 - k] = 1
        rings[k + 1 : 40 - k, k + 1 : 40 - k] = 0
    check(spark, [np.pad(rings, 1), rings, np.pad(spiral(60)[0], 2), np.tile([[0, 1, 0], [1, 0, 1], [0, 1, 0]], (9, 9))])


def test_no_rows(spark):
    r = raster(spark, np.ones((2, 2), int))
    assert O.find_contours(r.where("false")).collect() == []
    assert O.find_contours(r, 5).collect() == []
    assert dict(O.find_contours(r.withColumn("c", F.lit(0))).dtypes) == {"img": "bigint", "contour": "int", "seq": "int", "x": "int", "y": "int", "border": "string", "parent": "int"}
