"""Terrain attributes of a raster held as rows (r, c, elevation).

Gradients are windows along rows and columns.  Ray marches (horizon, wind shelter) cut the raster into tiles with a halo as
wide as the longest ray and march inside each tile, vectorised over its pixels: only the pixels are shuffled, each to the tiles
around it, and no rows are made for directions and steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.functions import physics as ph
from tarnspark.session import cut

#: Side of a tile in pixels.
TILE = 128


def gradient(dem: DataFrame, res: float, value: str = "elevation") -> DataFrame:
    """``dem`` with dx (along columns) and dy (along rows): central inside, one-sided at the edges."""

    def along(line: str, at: str) -> Column:
        w = Window.partitionBy(line).orderBy(at)
        before, after, own = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        return F.when(before.isNotNull() & after.isNotNull(), (after - before) / (2.0 * res)).when(after.isNotNull(), (after - own) / res).when(before.isNotNull(), (own - before) / res)

    return dem.withColumns({"dx": along("r", "c"), "dy": along("c", "r")})


def slope_aspect(dem: DataFrame, res: float) -> DataFrame:
    """``dem`` with slope and aspect in degrees."""
    g = gradient(dem, res)
    slope = F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))))
    aspect = ph.mod360(F.degrees(F.atan2(-F.col("dx"), -F.col("dy"))))
    return g.withColumns({"slope": slope, "aspect": aspect})


def _steepest(own: pa.Table, r: int, c: int, ny: int, nx: int, n_directions: int, steps: int, res: float, north: int) -> np.ndarray:
    """(pixel, direction): the largest of (height on the ray - ``sign`` * own height) / distance for the pixels of a tile whose halo begins at
    (r, c); NaN where no point of the ray lies inside the raster.  Heights between cells are bilinear, edges repeat."""
    side = TILE + 2 * (steps + 1) + 1
    at_r, at_c = own["r"].to_numpy() - r, own["c"].to_numpy() - c
    z = np.full((side + 1, side + 1), np.nan)
    z[at_r, at_c] = own["elevation"].to_numpy()
    east = np.where(np.isnan(z[:-1, 1:]), z[:-1, :-1], z[:-1, 1:])
    up = np.where(np.isnan(z[1:, :-1]), z[:-1, :-1], z[1:, :-1])
    both = np.where(np.isnan(z[1:, 1:]), np.where(np.isnan(z[:-1, 1:]), up, east), z[1:, 1:])
    inner = own["inner"].to_numpy()
    pr, pc, here = at_r[inner], at_c[inner], own["elevation"].to_numpy()[inner]
    sign = 1.0 if north < 0 else -1.0
    out = np.full((len(pr), n_directions), np.nan)
    for i in range(n_directions):
        dr, dc = north * math.cos(2 * math.pi * i / n_directions), math.sin(2 * math.pi * i / n_directions)
        for k in range(1, steps + 1):
            tr, tc = (pr + r) + dr * k, (pc + c) + dc * k
            inside = (tr >= 0) & (tc >= 0) & ((tr < ny - 1) & (tc < nx - 1) if north < 0 else (tr <= ny - 1) & (tc <= nx - 1))
            if not inside.any():
                continue
            r0, c0 = np.floor(tr), np.floor(tc)
            fr, fc = tr - r0, tc - c0
            a, b = np.where(inside, r0 - r, 0).astype(np.int64), np.where(inside, c0 - c, 0).astype(np.int64)
            h = z[a, b] * (1.0 - fr) * (1.0 - fc) + east[a, b] * (1.0 - fr) * fc + up[a, b] * fr * (1.0 - fc) + both[a, b] * fr * fc
            out[:, i] = np.fmax(out[:, i], np.where(inside, sign * (h - here) / (k * res), np.nan))
    return out


def _march(dem: DataFrame, n_directions: int, steps: int, res: float, north: int) -> DataFrame:
    """(r, c, direction, angle): the largest angle in degrees along each ray, upwards for ``north`` < 0 (towards smaller rows), else downwards;
    null where the ray leaves the raster at once."""
    ny, nx = (int(x or 0) for x in dem.agg(F.max("r") + 1, F.max("c") + 1).first())
    halo = steps + 1

    def tiles(at: str, size: int) -> Column:
        lowest, highest = F.floor((F.col(at) - halo) / TILE), F.floor((F.col(at) + halo) / TILE)
        return F.explode(F.sequence(F.greatest(lowest, F.lit(0)), F.least(highest, F.lit(max(0, (size - 1) // TILE)))))

    spread = dem.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("elevation").cast("double").alias("elevation"), tiles("r", ny).alias("tr"))
    spread = spread.select("*", tiles("c", nx).alias("tc"))
    inner = (F.floor(F.col("r") / TILE) == F.col("tr")) & (F.floor(F.col("c") / TILE) == F.col("tc"))

    def march(key: tuple, own: pa.Table) -> pa.Table:
        tr, tc = (k.as_py() for k in key)
        ratio = _steepest(own, tr * TILE - halo, tc * TILE - halo, ny, nx, n_directions, steps, res, north)
        kept = own.filter(own["inner"])
        angle = np.degrees(np.arctan(ratio)).ravel()
        columns = [pa.array(np.repeat(kept[x].to_numpy(), n_directions).astype(np.int32)) for x in ("r", "c")]
        directions = pa.array(np.tile(np.arange(n_directions, dtype=np.int32), kept.num_rows))
        return pa.table([*columns, directions, pa.array(angle, mask=np.isnan(angle))], names=["r", "c", "direction", "angle"])

    return spread.withColumn("inner", inner).groupBy("tr", "tc").applyInArrow(march, "r int, c int, direction int, angle double")


def horizon(dem: DataFrame, n_directions: int, max_distance: float, res: float) -> DataFrame:
    """(r, c, direction, horizon): the highest elevation angle along each ray, 0 at least; north is towards smaller rows."""
    seen = _march(dem, n_directions, int(max_distance / res), res, -1)
    return seen.select("r", "c", "direction", F.greatest(F.coalesce("angle", F.lit(0.0)), F.lit(0.0)).alias("horizon"))


def sky_view_factor(horizons: DataFrame) -> DataFrame:
    """(r, c, svf): the mean squared cosine of the horizon over directions."""
    cosine = F.cos(F.radians(F.greatest(F.col("horizon"), F.lit(0.0))))
    return horizons.groupBy("r", "c").agg(F.avg(cosine * cosine).alias("svf"))


def winstral_sx(dem: DataFrame, n_directions: int, max_distance: float, res: float) -> DataFrame:
    """(r, c, direction, sx): the highest angle down to upwind cells, 0 where there is none; north is towards larger rows."""
    seen = _march(dem, n_directions, int(max_distance / res), res, 1)
    return seen.select("r", "c", "direction", F.coalesce("angle", F.lit(0.0)).alias("sx"))


#: Neighbours of D8 in the order that breaks ties.
D8 = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def flow_direction(dem: DataFrame, res: float) -> DataFrame:
    """(r, c, to_r, to_c): the neighbour of steepest descent; null for a pit.  Ties go to the first of ``D8``."""
    near = dem.select("r", "c", "elevation", F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(res * math.hypot(a, b)).alias("dist")) for i, (a, b) in enumerate(D8)))).alias("d"))
    near = near.select("r", "c", "elevation", "d.k", "d.dist", (F.col("r") + F.col("d.dr")).alias("to_r"), (F.col("c") + F.col("d.dc")).alias("to_c"))
    other = dem.select(F.col("r").alias("to_r"), F.col("c").alias("to_c"), F.col("elevation").alias("z2"))
    drop = ((F.col("elevation") - F.col("z2")) / F.col("dist")).alias("drop")
    best = near.join(other, ["to_r", "to_c"]).select("r", "c", drop, "k", "to_r", "to_c").where("drop > 0").groupBy("r", "c").agg(F.max(F.struct("drop", (-F.col("k")).alias("k"), "to_r", "to_c")).alias("b"))
    return dem.select("r", "c").join(best, ["r", "c"], "left").select("r", "c", "b.to_r", "b.to_c")


def flow_accumulation(directions: DataFrame) -> DataFrame:
    """(r, c, basin_r, basin_c, cells): the pit that each cell drains to, and how many cells drain through it, itself included.

    Pointers are doubled until every cell has reached its pit; accumulation sums along the same powers.
    """
    hop = directions.select("r", "c", "to_r", "to_c")
    cells = directions.select("r", "c", F.lit(1).cast("long").alias("cells"))
    while hop.where("to_r is not null").limit(1).count():
        sent = hop.where("to_r is not null").join(cells, ["r", "c"]).groupBy(F.col("to_r").alias("r"), F.col("to_c").alias("c")).agg(F.sum("cells").alias("more"))
        cells = cut(cells.join(sent, ["r", "c"], "left").select("r", "c", (F.col("cells") + F.coalesce("more", F.lit(0))).alias("cells")))
        nxt = hop.select(F.col("r").alias("to_r"), F.col("c").alias("to_c"), F.col("to_r").alias("n_r"), F.col("to_c").alias("n_c"))
        hop = cut(hop.join(nxt, ["to_r", "to_c"], "left").select("r", "c", F.col("n_r").alias("to_r"), F.col("n_c").alias("to_c")))
    root = cut(directions.select("r", "c", F.coalesce("to_r", "r").alias("p_r"), F.coalesce("to_c", "c").alias("p_c")))
    while True:
        nxt = root.select(F.col("r").alias("p_r"), F.col("c").alias("p_c"), F.col("p_r").alias("q_r"), F.col("p_c").alias("q_c"))
        new = cut(root.join(nxt, ["p_r", "p_c"]).select("r", "c", F.col("q_r"), F.col("q_c"), ((F.col("p_r") != F.col("q_r")) | (F.col("p_c") != F.col("q_c"))).alias("moved")))
        root = new.select("r", "c", F.col("q_r").alias("p_r"), F.col("q_c").alias("p_c"))
        if not new.where("moved").limit(1).count():
            break
    return root.join(cells, ["r", "c"]).select("r", "c", F.col("p_r").alias("basin_r"), F.col("p_c").alias("basin_c"), "cells")


def hillshade(dem: DataFrame, res: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    g = gradient(dem, res)
    return g.withColumn("shade", ph.hillshade(F.col("dx"), F.col("dy"), azimuth, altitude))
