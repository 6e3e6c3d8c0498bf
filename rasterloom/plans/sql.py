"""DuckDB SQL fragments for the registered queries' twins."""

from __future__ import annotations

#: embeddings as 8x8 rasters
EMB = """
px AS MATERIALIZED (
  SELECT vec_id AS img, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y,
         CAST(floor(least(255.0, greatest(0.0, (CAST(embedding[i + 1] AS DOUBLE) + 0.6) * 212.5))) AS INTEGER) AS v
  FROM embeddings, range(64) t(i))"""

#: embeddings as rasters of 5x5 tiles
MOSAIC = """
px AS MATERIALIZED (
  SELECT g.img, CAST(t % 5 * 8 + i % 8 AS INTEGER) AS x, CAST(t // 5 * 8 + i // 8 AS INTEGER) AS y,
         CAST(floor(least(255.0, greatest(0.0, (CAST(coalesce(embedding[i + 1], -1) AS DOUBLE) + 0.6) * 212.5))) AS INTEGER) AS v
  FROM (SELECT DISTINCT vec_id // 25 AS img FROM embeddings) g CROSS JOIN range(25) a(t) CROSS JOIN range(64) b(i) LEFT JOIN embeddings e ON e.vec_id = g.img * 25 + t)"""

#: truncates toward zero between the limits of a type
CLAMP = "CAST(trunc(least({hi}, greatest({lo}, {e}))) AS INTEGER)"


def clamp(e: str, lo: int = 0, hi: int = 255) -> str:
    return CLAMP.format(e=e, lo=float(lo), hi=float(hi))


def kernel_values(k: dict) -> str:
    return ", ".join(f"({dx}, {dy}, {w})" for (dx, dy), w in k.items())


def near(k: dict, source: str = "px", size: int = 8) -> str:
    """Every place with its neighbours at a kernel's offsets (edges repeat): img, x, y, dx, dy, w, v."""
    return f"""SELECT a.img, a.x, a.y, k.dx, k.dy, k.w, b.v AS v, a.v AS centre FROM {source} a CROSS JOIN (VALUES {kernel_values(k)}) k(dx, dy, w)
JOIN {source} b ON b.img = a.img AND b.x = greatest(0, least({size - 1}, a.x + k.dx)) AND b.y = greatest(0, least({size - 1}, a.y + k.dy))"""


def inside(k: dict, source: str = "px") -> str:
    """The same without repeated edges: neighbours outside are absent."""
    return f"""SELECT a.img, a.x, a.y, k.dx, k.dy, b.v AS v, a.v AS centre FROM {source} a CROSS JOIN (VALUES {kernel_values(k)}) k(dx, dy, w)
JOIN {source} b ON b.img = a.img AND b.x = a.x + k.dx AND b.y = a.y + k.dy"""


def filtered(k: dict, finish: str, source: str = "px") -> str:
    """img, x, y, v of a correlation; ``finish`` uses ``s``."""
    return f"SELECT img, x, y, {finish} AS v FROM (SELECT img, x, y, sum(w * v) AS s FROM ({near(k, source)}) GROUP BY img, x, y)"


def chain(*steps: tuple[str, str], source: str = EMB) -> str:
    """WITH over the rasters and named steps; the last step is the result."""
    return "WITH " + ",\n".join([source.strip(), *(f"{n} AS MATERIALIZED ({q})" for n, q in steps)]) + f"\nSELECT * FROM {steps[-1][0]}"
