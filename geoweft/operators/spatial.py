"""Grid, viewport and tile operators over 2-D positions."""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions.scalar import tile_distance, world_to_tile
from geoweft.plans.lineage import broadcast_if_small

# Bounds of the grid resolution and of the adaptive level of detail.
MIN_BITS, MAX_BITS, LOD_LIMIT = 4, 8, 1000


def f32(v: float) -> float:
    try:
        return struct.unpack("f", struct.pack("f", v))[0]
    except OverflowError:
        return math.copysign(math.inf, v)


def grid_bits(entity_count: int) -> int:
    if entity_count <= 0:
        return MIN_BITS
    half = math.log2(entity_count) / 2
    return max(MIN_BITS, min(MAX_BITS, math.floor(half + 0.5)))


def tile_of(v: float, count: int) -> int:
    """world_to_tile for a driver-side scalar."""
    v = f32(v)
    if math.isnan(v):
        return 0
    scaled = f32(v + 1.0) / 2.0 * count
    return 0 if scaled <= 0 else count - 1 if scaled >= count - 1 else math.floor(scaled)


def with_cells(positions: DataFrame, bits: int) -> DataFrame:
    n = 1 << bits
    return positions.withColumns({"gx": world_to_tile("x", n), "gy": world_to_tile("y", n)})


def tile_range(min_x, min_y, max_x, max_y, lod: int) -> dict[str, int]:
    n = 1 << lod
    a, b, c, d = tile_of(min_x, n), tile_of(min_y, n), tile_of(max_x, n), tile_of(max_y, n)
    return {"min_tx": a, "min_ty": b, "max_tx": c, "max_ty": d, "center_tx": (a + c) // 2, "center_ty": (b + d) // 2}


def cell_estimate(r: dict[str, int], bits: int, lod: int) -> int:
    """Cells to visit for a tile range at a level of detail."""
    ratio = 1 << max(0, bits - lod)
    return (r["max_tx"] - r["min_tx"] + 1) * ratio * (r["max_ty"] - r["min_ty"] + 1) * ratio


def choose_lod(bounds, bits: int, limit: int | None) -> int:
    """One level less where more than half of the grid is covered and the limit is small."""
    cells = cell_estimate(tile_range(*bounds, bits), bits, bits)
    return bits - 1 if limit is not None and limit < LOD_LIMIT and bits > 1 and cells > (1 << (2 * bits)) // 2 else bits


def coarse_bounds(cells: DataFrame, bounds, bits: int, lod: int | None = None) -> DataFrame:
    """Rows of all cells that overlap the bounds at ``lod``; no exact test."""
    lod = bits if lod is None else min(lod, bits)
    r, s = tile_range(*bounds, lod), bits - lod
    gx, gy = F.shiftright("gx", s), F.shiftright("gy", s)
    return cells.where(gx.between(r["min_tx"], r["max_tx"]) & gy.between(r["min_ty"], r["max_ty"]))


def viewport(cells: DataFrame, bounds, bits: int, limit: int | None = None, ordered: bool = False) -> DataFrame:
    """Positions inside the closed rectangle, compared in single precision.

    NaN or inverted bounds and a limit of 0 give no rows. Where x and y are stored columns, their
    bounds reach the scan, and the statistics of files sorted by cell (Graph.save) skip row
    groups; the cell range itself is computed and prunes nothing. With a limit the rows come in
    the grid's visiting order at the chosen level of detail (a top-k, not a full sort).
    """
    b = [f32(v) for v in bounds]
    if any(math.isnan(v) for v in b) or b[0] > b[2] or b[1] > b[3] or limit == 0:
        return cells.where(F.lit(False))
    lit = lambda v: F.lit(v).cast("float")
    inside = F.col("x").between(lit(b[0]), lit(b[2])) & F.col("y").between(lit(b[1]), lit(b[3]))
    hits = coarse_bounds(cells, b, bits).where(inside & ~F.isnan("x") & ~F.isnan("y"))
    if not ordered and limit is None:
        return hits
    s = bits - choose_lod(b, bits, limit)
    hits = hits.orderBy(F.shiftright("gy", s), F.shiftright("gx", s), "gy", "gx", "entity_id")
    return hits if limit is None else hits.limit(limit)


#: Levels of the cells that viewport requests are joined on, and the cells in a row that a request may cover at a level.
LEVELS, MOST_CELLS = (10, 7, 4), 4


def viewport_batch(positions: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request_id, min_x, min_y, max_x, max_y) joined on cells, then tested exactly.

    A request goes to the finest of LEVELS at which it covers at most MOST_CELLS cells a side
    (to the coarsest, where it may cover all, if there is none), so small requests meet the
    positions of small cells only. Requests are broadcast if their rows are few enough (a
    checked size); else both sides are shuffled by level and cell, and AQE splits dense cells.
    The exact test is a residual condition of the same join.
    """
    r = requests.select("request_id", *[F.col(k).cast("float").alias(k) for k in ("min_x", "min_y", "max_x", "max_y")])
    r = r.where((F.col("min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("max_y")))
    r = r.where(~(F.isnan("min_x") | F.isnan("min_y") | F.isnan("max_x") | F.isnan("max_y")))
    tile = lambda c, level: world_to_tile(c, 1 << level)
    few = lambda lo, hi, level: tile(hi, level) - tile(lo, level) < MOST_CELLS
    fits = [(few("min_x", "max_x", v) & few("min_y", "max_y", v), v) for v in LEVELS[:-1]]
    level = F.coalesce(*[F.when(ok, F.lit(v)) for ok, v in fits], F.lit(LEVELS[-1]))
    at = lambda c: F.coalesce(*[F.when(F.col("_level") == v, tile(c, v)) for v in LEVELS])
    span = lambda lo, hi: F.explode(F.sequence(at(lo), at(hi)))
    r = r.withColumn("_level", level).withColumn("_cx", span("min_x", "max_x")).withColumn("_cy", span("min_y", "max_y"))
    r = broadcast_if_small(r, 48)
    own = F.explode(F.array(*[F.struct(F.lit(v).alias("_level"), tile("x", v).alias("_cx"), tile("y", v).alias("_cy")) for v in LEVELS]))
    p = positions.select("entity_id", "x", "y").where(~F.isnan("x") & ~F.isnan("y"))
    p = p.select("entity_id", "x", "y", own.alias("_at")).select("entity_id", "x", "y", "_at.*")
    hit = (p["x"] >= r["min_x"]) & (p["x"] <= r["max_x"]) & (p["y"] >= r["min_y"]) & (p["y"] <= r["max_y"])
    same = [p[c] == r[c] for c in ("_level", "_cx", "_cy")]
    return p.join(r, [*same, hit]).select("request_id", p["entity_id"])


def grid_cell_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("gx", "gy").agg(F.count("*").alias("n"))


def grid_offsets(cells: DataFrame) -> DataFrame:
    """Start of each occupied cell in cell order; at most 4**MAX_BITS rows reach the window."""
    w = Window.orderBy("gy", "gx").rowsBetween(Window.unboundedPreceding, -1)
    return grid_cell_counts(cells).withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))


def cell(cells: DataFrame, tx: int, ty: int) -> DataFrame:
    return cells.where((F.col("gx") == tx) & (F.col("gy") == ty))


def nearest_tiles(cells: DataFrame, bounds, bits: int, k: int) -> DataFrame:
    """Occupied tiles of the bounds ranked by distance to the centre tile."""
    r = tile_range(*bounds, bits)
    t = grid_cell_counts(coarse_bounds(cells, bounds, bits))
    d = tile_distance("gx", "gy", F.lit(r["center_tx"]), F.lit(r["center_ty"]))
    return t.withColumn("distance", d).orderBy("distance", "gy", "gx").limit(k)
