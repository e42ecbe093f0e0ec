"""Building, trimming, merging and smoothing of grids and rasters."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.functions import physics as ph


def regular_grid(spark: SparkSession, west: float, south: float, east: float, north: float, step: float = 0.25) -> DataFrame:
    """(latitude, longitude) of the multiples of ``step`` inside the box, or around a box that holds none."""
    i0, i1 = math.ceil(south / step), math.floor(north / step)
    j0, j1 = math.ceil(west / step), math.floor(east / step)
    if i0 > i1:
        i0, i1 = i1, i0
    if j0 > j1:
        j0, j1 = j1, j0
    return spark.range(i0, i1 + 1).select(F.col("id").alias("i")).select((F.col("i") * step).alias("latitude"), F.explode(F.sequence(F.lit(j0), F.lit(j1))).alias("j")).select("latitude", (F.col("j") * step).alias("longitude"))


def chunk_id(time: Column, reference: str = "2024-01-01", hours: int = 504, first: int = 975) -> Column:
    """The number of the archive chunk that holds an hour."""
    since = (F.unix_timestamp(time.cast("timestamp")) - F.unix_timestamp(F.lit(reference).cast("timestamp"))) / 3600
    return (F.floor(since / hours) + first).cast("int")


def from_speed_direction(speed: Column, degrees: Column) -> tuple[Column, Column]:
    a = F.radians(degrees)
    return -speed * F.sin(a), -speed * F.cos(a)


def outer_merge(patches: Sequence[DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The union of sparse patches, one row per key; of several values the first patch's that isn't null."""
    from tarnspark.sources.registry import merge_sources

    return merge_sources(patches, keys, values)


def stitch_tiles(tiles: DataFrame, value: str = "elevation") -> DataFrame:
    """(r, c, value) of tile rows (tile, r, c, value): where tiles overlap the first with a value wins."""
    good = F.when(F.col(value).isNotNull(), F.struct("tile", value))
    return tiles.groupBy("r", "c").agg(F.min(good).alias("b")).select("r", "c", F.col(f"b.{value}").alias(value))


def trim_nodata(dem: DataFrame, value: str = "elevation") -> DataFrame:
    """``dem`` cut to the rows and columns between the first and last that hold a value, numbered from 0."""
    box = dem.where(F.col(value).isNotNull()).agg(*(f(x).alias(f"{n}{x}") for x in "rc" for f, n in ((F.min, "a"), (F.max, "b"))))
    kept = dem.crossJoin(F.broadcast(box)).where("r between ar and br and c between ac and bc")
    return kept.withColumns({"r": F.col("r") - F.col("ar"), "c": F.col("c") - F.col("ac")}).drop("ar", "br", "ac", "bc")


def group_boxes(points: DataFrame, group: str, buffer_m: float = 0.0) -> DataFrame:
    """(group, west, south, east, north) of points (lon, lat), widened by a distance in m."""
    box = points.groupBy(group).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    dy = buffer_m / 111_320.0
    dx = F.lit(buffer_m) / (F.cos(F.radians((F.col("south") + F.col("north")) / 2.0)) * 111_320.0)
    return box.select(group, (F.col("west") - dx).alias("west"), (F.col("south") - dy).alias("south"), (F.col("east") + dx).alias("east"), (F.col("north") + dy).alias("north"))


def smooth(dem: DataFrame, sigma: float = 2.0, value: str = "elevation", reach: int | None = None) -> DataFrame:
    """(r, c, value): Gaussian smoothing whose weights are normalised over the values that are there.

    The kernel is separable: a pass along rows and one along columns, each a bounded explode and a partial sum.
    """
    n = reach or math.ceil(3 * sigma)
    kernel = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(math.exp(-k * k / (2 * sigma * sigma))).alias("w")) for k in range(-n, n + 1))))
    there = dem.where(F.col(value).isNotNull())
    along = there.select("r", "c", F.col(value).alias("v"), kernel.alias("d")).select("r", (F.col("c") + F.col("d.k")).alias("c"), (F.col("d.w") * F.col("v")).alias("s"), F.col("d.w").alias("w")).groupBy("r", "c").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    both = along.select("r", "c", "s", "w", kernel.alias("d")).select((F.col("r") + F.col("d.k")).alias("r"), "c", (F.col("d.w") * F.col("s")).alias("s"), (F.col("d.w") * F.col("w")).alias("w")).groupBy("r", "c").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    return there.select("r", "c").join(both, ["r", "c"]).select("r", "c", (F.col("s") / F.col("w")).alias(value))


def stride(raster: DataFrame, n: int) -> DataFrame:
    return raster.where((F.col("r") % n == 0) & (F.col("c") % n == 0))


def silhouette(df: DataFrame, features: Sequence[str], cluster: str, bound: int = 50_000) -> DataFrame:
    """One row, the mean silhouette over a sample of at most ``bound`` rows (those of least hash), exact on it.

    The sample's coordinates, bounded by the parameter, are sent to every task; each task measures its rows against them.
    """
    order, n_rows = F.xxhash64(*features, cluster), df.count()
    thin = df.where(F.pmod(order, F.lit(1 << 40)) < int((1 << 40) * bound / n_rows)) if n_rows > bound else df
    sample = thin.select(cluster, *features).orderBy(order, *features).limit(bound)
    held = sample.toPandas()
    points, labels = held[list(features)].to_numpy(float), held[cluster].to_numpy()
    names, code = np.unique(labels, return_inverse=True)
    sizes = np.bincount(code, minlength=len(names))
    sent = df.sparkSession.sparkContext.broadcast((points, code, sizes))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, k, n = sent.value
        for batch in batches:
            x = batch[list(features)].to_numpy(float)
            own = np.searchsorted(names, batch[cluster].to_numpy())
            out = np.zeros(len(x))
            for i in range(0, len(x), 64):
                d = np.sqrt(((x[i : i + 64, None, :] - p[None]) ** 2).sum(2))
                sums = np.stack([np.bincount(k, row, len(n)) for row in d])
                o = own[i : i + 64]
                at = np.arange(len(o))
                a = sums[at, o] / np.maximum(n[o] - 1, 1)
                means = sums / n
                means[at, o] = np.inf
                b = means.min(1)
                out[i : i + 64] = np.where(n[o] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            yield pd.DataFrame({"s": out})

    rows = df.sparkSession.createDataFrame(held)
    return rows.mapInPandas(measure, "s double").agg(F.avg("s").alias("silhouette"))


def best_k(df: DataFrame, features: Sequence[str], ks: Sequence[int], seed: int = 42) -> list[tuple[int, float]]:
    """(k, silhouette) for each k, best first."""
    from tarnspark.operators.units import kmeans

    found = [(k, silhouette(kmeans(df, features, k, seed), features, "cluster").first()[0]) for k in ks]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def least_clusters(pixels: DataFrame, lat0: float, lon0: float, step: float = 0.25) -> int:
    """The number of coarse cells that the pixels (lat, lon) touch; fewer clusters would lose coarse detail."""
    return pixels.select(F.floor((F.col("lat") - lat0) / step + 0.5).alias("a"), F.floor((F.col("lon") - lon0) / step + 0.5).alias("b")).distinct().count()


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """(north-south, east-west)."""
    return F.lit(111_320.0), F.cos(F.radians(lat)) * 111_320.0


def catchments_table(df: DataFrame) -> DataFrame:
    """Catchment rows with their required columns and ids as strings."""
    if missing := {"id", "downstream_id"} - set(df.columns):
        raise ValueError(f"catchments lack {', '.join(sorted(missing))}")
    return df.withColumns({c: F.col(c).cast("string") for c in ("id", "downstream_id")})


def rate_of_change(amount: Column, seconds: Column) -> Column:
    return amount / seconds


def hourly_to_page(forcing: DataFrame, scales: dict[str, float]) -> DataFrame:
    """(unit_id, days, values): each unit's daily means packed as int16 arrays in the order of days, for a page."""
    d = forcing.groupBy("unit_id", F.to_date("time").alias("day")).agg(*(F.avg(v).alias(v) for v in scales))
    entry = F.struct("day", *(ph.pack_int16(F.col(v), s).alias(v) for v, s in scales.items()))
    rows = d.groupBy("unit_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return rows.select("unit_id", F.col("e.day").alias("days"), *(F.col(f"e.{v}").alias(v) for v in scales))
