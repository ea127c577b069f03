"""Elevation rasters in long form (grid, r, c, h): sampling over many grids, tiles, sections and reprojection.

Points meet grids by whole degrees and cells by (grid, r, c), both equi-joins, so neither rasters nor points are gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: points a side of a tile, DEM units in a map unit, 2^24 map units to a circle.
SIDE, UNITS, CIRCLE = 64, 256, 1 << 24


def grids_of(cells: DataFrame) -> DataFrame:
    """One row a grid of read rasters: its corner, cell sizes, width, height, and place by name."""
    g = cells.groupBy("grid").agg(*[F.first(c).alias(c) for c in ("west", "north", "cell_lon", "cell_lat")], (F.max("c") + 1).alias("width"), (F.max("r") + 1).alias("height"))
    return g.withColumn("place", F.col("grid"))


def covered(points: DataFrame, grids: DataFrame, x: str, y: str, side: float = 1.0) -> DataFrame:
    """Points with every grid whose closed box holds them, and their fractional cell (_cf, _rf); they meet by squares of `side`."""
    east = F.col("west") + (F.col("width") - 1) * F.col("cell_lon")
    south = F.col("north") - (F.col("height") - 1) * F.col("cell_lat")
    g = grids.withColumn("_east", east).withColumn("_south", south)
    cell = lambda c: F.floor(F.col(c) / side)
    g = g.withColumn("_x", F.explode(F.sequence(cell("west"), cell("_east")))).withColumn("_y", F.explode(F.sequence(cell("_south"), cell("north"))))
    p = points.withColumn("_x", cell(x)).withColumn("_y", cell(y))
    inside = F.col(x).between(F.col("west"), F.col("_east")) & F.col(y).between(F.col("_south"), F.col("north"))
    met = p.join(g, ["_x", "_y"]).where(inside)
    return met.withColumn("_cf", (F.col(x) - F.col("west")) / F.col("cell_lon")).withColumn("_rf", (F.col("north") - F.col(y)) / F.col("cell_lat"))


def _weighted(met: DataFrame, cells: DataFrame, key: list[str], wanted: Column, need: Column, value: str) -> DataFrame:
    """Sum of weight * height over the wanted cells (array of r, c, w), null unless all `need` cells have a height."""
    near = met.select(*key, "grid", need.alias("_need"), F.explode(wanted).alias("_w")).select(*key, "grid", "_need", "_w.*")
    held = cells.select("grid", F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("h").alias("_h")).where("_h is not null")
    got = near.join(held, ["grid", "_r", "_c"])
    total = got.groupBy(*key, "grid").agg(F.count("*").alias("_n"), F.first("_need").alias("_need"), F.sum(F.col("_weight") * F.col("_h")).alias(value))
    return total.where("_n = _need").select(*key, "grid", value)


def _cells(rows: list[Column], cols: list[Column], wr: list[Column], wc: list[Column]) -> Column:
    return F.array(*[F.struct(r.cast("int").alias("_r"), c.cast("int").alias("_c"), (a * b).alias("_weight")) for r, a in zip(rows, wr, strict=True) for c, b in zip(cols, wc, strict=True)])


def bilinear_cells() -> tuple[Column, Column]:
    """The four cells around a point with their weights; on the last row or column the nearest cell."""
    cf, rf = F.col("_cf"), F.col("_rf")
    c, r = F.floor(cf), F.floor(rf)
    edge = (c + 1 >= F.col("width")) | (r + 1 >= F.col("height"))
    qx, qy = cf - c, rf - r
    nearest = F.array(F.struct(F.floor(rf + 0.5).cast("int").alias("_r"), F.floor(cf + 0.5).cast("int").alias("_c"), F.lit(1.0).alias("_weight")))
    return F.when(edge, nearest).otherwise(_cells([r, r + 1], [c, c + 1], [1 - qy, qy], [1 - qx, qx])), F.when(edge, 1).otherwise(4)


def cubic_weights(t: Column) -> list[Column]:
    """Weights of the four neighbours in a Catmull-Rom spline."""
    t2, t3 = t * t, t * t * t
    return [0.5 * (2 * t2 - t - t3), 0.5 * (2 - 5 * t2 + 3 * t3), 0.5 * (t + 4 * t2 - 3 * t3), 0.5 * (t3 - t2)]


def bicubic_cells() -> tuple[Column, Column]:
    """The sixteen cells around a point with their weights, none where they leave the grid."""
    c, r = F.floor("_cf"), F.floor("_rf")
    inside = (c >= 1) & (r >= 1) & (c + 2 < F.col("width")) & (r + 2 < F.col("height"))
    wanted = _cells([r + k for k in range(-1, 3)], [c + k for k in range(-1, 3)], cubic_weights(F.col("_rf") - r), cubic_weights(F.col("_cf") - c))
    return F.when(inside, wanted), F.lit(16)


def sampled(points: DataFrame, cells: DataFrame, key: list[str], method: str = "auto", grids: DataFrame | None = None, x: str = "lon", y: str = "lat", side: float = 1.0) -> DataFrame:
    """Points + h of the first grid (by `place`) that has a height there; null if none has.

    `method`: auto or bilinear; bicubic, which falls back to bilinear in a grid where a neighbour is missing.
    """
    grids = grids_of(cells) if grids is None else grids
    met = covered(points.select(*key, x, y), grids, x, y, side)
    found = _weighted(met, cells, key, *bilinear_cells(), "_two")
    if method == "bicubic":
        fine = _weighted(met, cells, key, *bicubic_cells(), "_three")
        found = found.join(fine, [*key, "grid"], "full").select(*key, "grid", F.coalesce("_three", "_two").alias("_two"))
    best = found.join(grids.select("grid", "place"), "grid").groupBy(*key).agg(F.min_by("_two", "place").alias("h"))
    return points.join(best, key, "left")


def rounded_heights(points: DataFrame, void: int = -32768) -> DataFrame:
    """Heights as whole numbers, halves away from zero, a fixed value where there is none."""
    h = F.col("h")
    return points.withColumn("h", F.coalesce(F.when(h >= 0, F.floor(h + 0.5)).otherwise(F.ceil(h - 0.5)), F.lit(void)).cast("int"))


def sample_points(spark, top: float, left: float, rows: int, cols: int, step_lat: float, step_lon: float) -> DataFrame:
    """A grid of points from its north-west corner: r, c, lat, lon."""
    n = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))
    return n.withColumn("lat", F.lit(top) - F.col("r") * step_lat).withColumn("lon", F.lit(left) + F.col("c") * step_lon)


def dem_tiles(raster: DataFrame, size: int = SIDE) -> DataFrame:
    """Least, greatest and void count of every size x size tile of every grid."""
    keys = ["grid"] if "grid" in raster.columns else []
    tile = [F.floor(F.col(c) / size).cast("int").alias(f"tile_{c}") for c in ("r", "c")]
    return raster.groupBy(*keys, *tile).agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count_if(F.col("h").isNull()).alias("voids"))


def tile_layout(points: Column, distance: Column, size: int = SIDE) -> tuple[Column, Column]:
    """(tiles, points of the last tile) along a side: the last holds 32 to 95 points, or fewer if it is the only one."""
    reach = points + distance
    full = F.floor(reach / (distance * size))
    rest = F.ceil((reach - full * distance * size) / distance)
    own = rest >= size // 2
    return F.greatest(full + own.cast("int"), F.lit(1)).cast("int"), F.when(own | (full == 0), rest).otherwise(rest + size).cast("int")


def aligned(north: Column, west: Column, distance: Column) -> tuple[Column, Column]:
    """A section's top moved up and left side moved left to multiples of the distance, beyond where they already are."""
    cut = lambda v: v - F.when(v >= 0, v % distance).otherwise(-((-v) % distance))
    top = F.when(north >= 0, cut(north) + F.when(cut(north) < 0x3FFFFFFF - distance, distance).otherwise(0)).otherwise(cut(north))
    left = F.when(west >= 0, cut(west)).otherwise(cut(west) - F.when(cut(west) > -(1 << 31) + distance, distance).otherwise(0))
    return top, left


def aligned_distance(distance: Column) -> Column:
    """A distance on the 16-unit raster."""
    return (F.floor((distance + 8) / 16) * 16).cast("int")


def reprojected_grid(cells: DataFrame, forward: Callable[[Column, Column], tuple[Column, Column]], box: tuple[float, float, float, float], cell_lat: float, cell_lon: float, grids: DataFrame) -> DataFrame:
    """Cells of a projected grid on a raster of degrees (box: west, south, east, north), by inverse mapping and bilinear samples.

    `forward`: (lon, lat) to the source's (x, y).
    """
    west, south, east, north = box
    cols, rows = math.ceil((east - west) / cell_lon) + 1, math.ceil((north - south) / cell_lat) + 1
    p = sample_points(cells.sparkSession, north, west, rows, cols, cell_lat, cell_lon)
    x, y = forward(F.col("lon"), F.col("lat"))
    side = grids.agg(F.max(F.greatest(F.col("width") * F.col("cell_lon"), F.col("height") * F.col("cell_lat")))).first()[0]
    return sampled(p.withColumn("x", x).withColumn("y", y), cells, ["r", "c"], "bilinear", grids, "x", "y", side).select("r", "c", "lat", "lon", "h")
