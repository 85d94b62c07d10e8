"""Gridded heights: bilinear samples and normals, one join with overlapping tiles of the raster."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.functions.columns import dbl


@dataclass(frozen=True)
class Grid:
    """World bounds and cell counts; samples are (nx + 1) x (nz + 1)."""

    xmin: float
    xmax: float
    zmin: float
    zmax: float
    nx: int
    nz: int

    @property
    def dx(self) -> float:
        return (self.xmax - self.xmin) / self.nx

    @property
    def dz(self) -> float:
        return (self.zmax - self.zmin) / self.nz


#: Cells along a tile's side.
TILE = 8
#: Samples along it: those of its cells and of one more cell all round, which central differences reach.
_SIDE = TILE + 3


def tiles(raster: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ti, tk, heights): the samples of a tile and its halo by their place, row by row.

    A sample goes to the one to four tiles it is in or beside, so the raster is shuffled about twice its size, and a point finds
    all samples it needs in one row.
    """

    def near(c: str) -> Column:
        # Sample s belongs to the tiles t with t * TILE - 1 <= s <= t * TILE + TILE + 1.
        low, high = F.ceil((F.col(c) - TILE - 1) / TILE).cast("int"), F.floor((F.col(c) + 1) / TILE).cast("int")
        return F.explode(F.sequence(low, high))

    rows = raster.select(*keys, "i", "k", "hgt", near("i").alias("ti")).select("*", near("k").alias("tk"))
    place = (F.col("i") - F.col("ti") * TILE + 1) * _SIDE + F.col("k") - F.col("tk") * TILE + 1
    tile = [*keys, "ti", "tk"]
    # Dealt by tile once for both groupings.
    rows = rows.select(*tile, place.cast("int").alias("__at"), "hgt").repartition(*[F.col(c) for c in tile])
    one = rows.groupBy(*tile, "__at").agg(F.max("hgt").alias("hgt"))
    return one.groupBy(*tile).agg(F.map_from_entries(F.collect_list(F.struct("__at", "hgt"))).alias("heights"))


def _locate(x: Column, z: Column, grid: Grid) -> tuple[Column, Column, Column, Column]:
    """Cell (i, k) and the place in it, clamped to the bounds."""

    def axis(value: Column, lo: float, hi: float, n: int) -> tuple[Column, Column]:
        f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / (hi - lo))) * float(n)
        cell = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(f).cast("int")))
        return cell, f - cell

    (ci, du), (ck, dv) = axis(x, grid.xmin, grid.xmax, grid.nx), axis(z, grid.zmin, grid.zmax, grid.nz)
    return ci, ck, du, dv


def _with_tile(points: DataFrame, raster: DataFrame, grid: Grid, keys: Sequence[str], x: str, z: str) -> DataFrame:
    ci, ck, _, _ = _locate(dbl(x), dbl(z), grid)
    at = points.withColumns({"ti": F.floor(ci / TILE).cast("int"), "tk": F.floor(ck / TILE).cast("int")})
    return at.join(tiles(raster, keys), [*keys, "ti", "tk"], "left")


def _heights(met: DataFrame, grid: Grid, places: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds the bilinear height of each place from the tile that the row has; places lie at most one cell from the row's own.

    Cells are columns of their own, so that generated code works them out once.
    """
    cells, heights = {}, {}
    for name, (x, z) in places.items():
        ci, ck, du, dv = _locate(x, z, grid)
        at = (ci - F.col("ti") * TILE + 1) * _SIDE + ck - F.col("tk") * TILE + 1
        cells |= {f"__at_{name}": at, f"__du_{name}": du, f"__dv_{name}": dv}
        h = lambda a, b, name=name: F.col("heights")[F.col(f"__at_{name}") + a * _SIDE + b]
        du, dv = F.col(f"__du_{name}"), F.col(f"__dv_{name}")
        h0 = h(0, 0) * (F.lit(1.0) - du) + h(1, 0) * du
        h1 = h(0, 1) * (F.lit(1.0) - du) + h(1, 1) * du
        heights[name] = h0 * (F.lit(1.0) - dv) + h1 * dv
    return met.withColumns(cells).withColumns(heights)


def _sides(x: Column, z: Column, grid: Grid) -> dict[str, tuple[Column, Column]]:
    """Places one cell to each side."""
    return {"__l": (x - grid.dx, z), "__r": (x + grid.dx, z), "__d": (x, z - grid.dz), "__u": (x, z + grid.dz)}


def _normal(grid: Grid) -> dict[str, Column]:
    """Unit normal from central differences one cell away."""
    rise_x, rise_z = F.col("__r") - F.col("__l"), F.col("__u") - F.col("__d")
    ex, ez = 2.0 * grid.dx, 2.0 * grid.dz
    nx, ny, nz = -rise_x * ez, F.lit(ex * ez), -rise_z * ex
    length = F.sqrt(nx * nx + ny * ny + nz * nz)
    return {"nx": nx / length, "ny": ny / length, "nz": nz / length}


def raster_sample(
    points: DataFrame, raster: DataFrame, grid: Grid, keys: Sequence[str] = (), x: str = "x", z: str = "z", out: str = "height"
) -> DataFrame:
    """Bilinear height at (x, z), clamped to the bounds; null where a corner is missing."""
    met = _with_tile(points, raster, grid, keys, x, z)
    return _heights(met, grid, {"__h": (dbl(x), dbl(z))}).select(*points.columns, F.col("__h").alias(out))


def raster_normal(
    points: DataFrame, raster: DataFrame, grid: Grid, point_keys: Sequence[str], keys: Sequence[str] = (), x: str = "x", z: str = "z"
) -> DataFrame:
    """point_keys and the unit normal (nx, ny, nz) of each point; null where a sample is missing."""
    met = _with_tile(points, raster, grid, keys, x, z)
    sides = _heights(met, grid, _sides(dbl(x), dbl(z), grid))
    return sides.select(*point_keys, *[e.alias(n) for n, e in _normal(grid).items()])


def raster_surface(points: DataFrame, raster: DataFrame, grid: Grid, keys: Sequence[str] = (), x: str = "x", z: str = "z", out: str = "height") -> DataFrame:
    """Height and unit normal of each point at once."""
    met = _with_tile(points, raster, grid, keys, x, z)
    found = _heights(met, grid, {"__h": (dbl(x), dbl(z)), **_sides(dbl(x), dbl(z), grid)})
    return found.select(*points.columns, F.col("__h").alias(out), *[e.alias(n) for n, e in _normal(grid).items()])
