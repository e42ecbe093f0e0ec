"""Interpolation joins between grid cells and spatial units.

Every theta join is rewritten as an equi-join on integer grid indices or as an expression on a row.
The coarse grid is folded once into 2 x 2 blocks, a shuffle of the coarse data only; units then find their block
by one equi-join and interpolate on the row, so the fine output (time x unit) is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side of at most so many bytes is broadcast, by the count of its rows and their width; rows that a task makes, about.
BROADCAST_BYTES, TASK_ROWS = 32 << 20, 250_000


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if a count that stops early finds that it is within ``limit`` bytes."""
    rows = limit // max(1, df._jdf.schema().defaultSize())
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fan_out(grid: DataFrame, units: DataFrame, keys: Sequence[str]) -> int:
    """Partitions for blocks of the grid by what they make: one row for each key and unit.  The blocks themselves are so
    small that partitions by their size would make all of it in a few tasks."""
    rows = grid.select(*keys).distinct().count() * units.count()
    return max(grid.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def bracket(value: Column, first: float, step: float, n: int) -> tuple[Column, Column]:
    """(upper index, fraction) of a coordinate on a regular ascending axis.

    The upper index is the number of axis values strictly below, held within 1 and n - 1; the
    fraction isn't held within [0, 1], so points outside extrapolate.
    """
    upper = F.least(F.greatest(F.ceil((value - first) / step).cast("int"), F.lit(1)), F.lit(n - 1))
    return upper, (value - (F.lit(first) + (upper - 1) * F.lit(step))) / step


def with_weights(units: DataFrame, lat0: float, lon0: float, step: float, n_lat: int, n_lon: int) -> DataFrame:
    """``units`` (lat, lon) with j1, i1 and the fractions t, s."""
    j1, t = bracket(F.col("lat"), lat0, step, n_lat)
    i1, s = bracket(F.col("lon"), lon0, step, n_lon)
    return units.withColumns({"j1": j1, "i1": i1, "t": t, "s": s})


def cell_blocks(grid: DataFrame, values: Sequence[str], keys: Sequence[str] = ("time",), parts: int | None = None) -> DataFrame:
    """Rows (keys, j1, i1, corners): each value of a block's four cells, in an array of structs:
    south-west, south-east, north-west, north-east.  Incomplete blocks at the border are left out.  ``parts``: see ``fan_out``."""
    corners = F.explode(F.array(*(F.struct(F.lit(dj).alias("dj"), F.lit(di).alias("di")) for dj in (0, 1) for di in (0, 1))))
    spread = grid.select(*keys, "lat_idx", "lon_idx", *values, corners.alias("k"))
    at = [(F.col("lat_idx") + 1 - F.col("k.dj")).cast("int").alias("j1"), (F.col("lon_idx") + 1 - F.col("k.di")).cast("int").alias("i1")]
    own = F.struct((F.col("k.dj") * 2 + F.col("k.di")).alias("q"), *values)
    spread = spread.select(*keys, *at, own.alias("v"))
    spread = spread.repartition(parts, *keys, "j1", "i1") if parts else spread  # the grouping below keeps this partitioning
    blocks = spread.groupBy(*keys, "j1", "i1").agg(F.sort_array(F.collect_list("v")).alias("corners"))  # four entries
    return blocks.where(F.size("corners") == 4)


def corner_weights() -> list[Column]:
    t, s = F.col("t"), F.col("s")
    return [(1.0 - t) * (1.0 - s), (1.0 - t) * s, t * (1.0 - s), t * s]


def bilinear(value: str, corners: str = "corners") -> Column:
    """The weighted sum of a block's corners in a fixed order."""
    a, b, c, d = (w * F.col(corners)[q][value] for q, w in enumerate(corner_weights()))
    return a + b + c + d


def with_bracket(rows: DataFrame, target: Column, z: str = "z_levels", corners: str = "level_corners") -> DataFrame:
    """``rows`` with _above and _below: (height, index) of the levels next to ``target`` at the unit, once for all variables.

    Levels strictly above and below count; a level exactly at the target doesn't when others bracket it.  Levels without height are passed by.
    """
    weights = corner_weights()

    def height(k: Column) -> Column:
        a, b, c, d = (w * F.col(corners)[q][z][k] for q, w in enumerate(weights))
        return a + b + c + d

    count = F.size(F.col(corners)[0][z])
    heights = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(height(k).alias("z"), k.alias("k")))
    rows = rows.withColumn("_heights", F.when(count > 0, heights)).withColumn("_target", target)
    above = F.array_min(F.filter("_heights", lambda p: p["z"] > F.col("_target")))
    below = F.array_max(F.filter("_heights", lambda p: p["z"] < F.col("_target")))
    return rows.withColumns({"_above": above, "_below": below}).drop("_heights")


def at_bracket(value: str, corners: str = "level_corners") -> Column:
    """``value`` at the target of ``with_bracket``: between its two levels, the nearest one where all lie on one side, else the first."""
    weights = corner_weights()

    def at(k: Column) -> Column:
        a, b, c, d = (w * F.col(corners)[q][value][k] for q, w in enumerate(weights))
        return a + b + c + d

    above, below, target = F.col("_above"), F.col("_below"), F.col("_target")
    span = above["z"] - below["z"]
    between = at(below["k"]) * ((above["z"] - target) / span) + at(above["k"]) * ((target - below["z"]) / span)
    return F.when(above.isNotNull() & below.isNotNull(), between).when(above.isNotNull(), at(above["k"])).when(below.isNotNull(), at(below["k"])).otherwise(at(F.lit(0)))


def interpolate(grid: DataFrame, units_w: DataFrame, values: Sequence[str], keys: Sequence[str] = ("time",)) -> DataFrame:
    """One row per key and unit: the units' columns and each value at the unit."""
    joined = cell_blocks(grid, values, keys, fan_out(grid, units_w, keys)).join(small(units_w), ["j1", "i1"])
    return joined.select(*keys, *units_w.columns, *(bilinear(v).alias(v) for v in values))


def nearest_index(value: Column, first: float, step: float, n: int) -> Column:
    """The index of the nearest axis value; ties go to the lower index."""
    return F.least(F.greatest(F.ceil((value - first) / step - 0.5).cast("int"), F.lit(0)), F.lit(n - 1))


def at_height(z: Column, v: Column, target: Column) -> Column:
    """``v`` interpolated at height ``target`` from arrays of level heights and values.

    Levels strictly above and below count; a level exactly at the target doesn't when others bracket it.  Only
    levels on one side give the nearest of them, and no such level the first.
    """
    pairs = F.filter(F.zip_with(z, v, lambda a, b: F.struct(a.alias("z"), b.alias("v"))), lambda p: p["z"].isNotNull())
    above = F.array_min(F.filter(pairs, lambda p: p["z"] > target))
    below = F.array_max(F.filter(pairs, lambda p: p["z"] < target))
    span = above["z"] - below["z"]
    between = below["v"] * ((above["z"] - target) / span) + above["v"] * ((target - below["z"]) / span)
    return F.when(above.isNotNull() & below.isNotNull(), between).when(above.isNotNull(), above["v"]).when(below.isNotNull(), below["v"]).otherwise(v[0])


def level_arrays(plev: DataFrame, values: Sequence[str], keys: Sequence[str] = ("time", "lat_idx", "lon_idx")) -> DataFrame:
    """Long level rows folded into one row per key, an array over ascending levels for each value."""
    rows = F.sort_array(F.collect_list(F.struct("level", *values)))  # as many entries as there are levels
    return plev.groupBy(*keys).agg(rows.alias("_l")).select(*keys, *(F.col(f"_l.{v}").alias(v) for v in values))
