"""Spatial units: response units, zonal statistics, clusters, catchments and their neighbourhood."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.functions import physics as ph


def circular_mean(degrees: Column) -> Column:
    r = F.radians(degrees)
    return ph.mod360(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))))


def zonal_stats(pixels: DataFrame, by: str, pixel_area: float) -> DataFrame:
    """Mean coordinates and attributes, circular mean aspect and area of each zone; pixels with no zone (null or negative) are left out."""
    mean = lambda x, default: F.coalesce(F.avg(x), F.lit(default)).alias(x)
    return (
        pixels.where(F.col(by) >= 0).groupBy(by)
        .agg(F.avg("r").alias("y"), F.avg("c").alias("x"), F.avg("elevation").alias("elevation"), mean("slope", 0.0), circular_mean(F.col("aspect")).alias("aspect"), mean("svf", 1.0), F.count("*").alias("pixels"), (F.count("*") * pixel_area).alias("area_m2"))
    )


def dense_label(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df`` with a dense number for each distinct combination of keys, in their order; the window sees the combinations only."""
    distinct = df.select(*keys).where(" and ".join(f"{k} is not null" for k in keys)).distinct()
    numbered = distinct.withColumn(name, F.row_number().over(Window.orderBy(*keys)) - 1)
    return df.join(numbered, list(keys), "left")


def hru_labels(pixels: DataFrame, band_width: float, n_aspects: int) -> DataFrame:
    """``pixels`` (elevation, aspect, and catchment if there) with band, aspect_class and unit_idx."""
    low = pixels.agg(F.min("elevation").alias("_low"))
    out = pixels.crossJoin(F.broadcast(low)).withColumns({"band": ph.elevation_band(F.col("elevation"), F.col("_low"), band_width), "aspect_class": ph.aspect_class(F.col("aspect"), n_aspects)}).drop("_low")
    return dense_label(out, ["band", "aspect_class", *(["catchment"] if "catchment" in pixels.columns else [])], "unit_idx")


def adjacency(labelled: DataFrame, label: str) -> DataFrame:
    """(a, b): labels of 4-neighbour pixels that differ, both ways."""
    right = F.lead(label).over(Window.partitionBy("r").orderBy("c"))
    up = F.lead(label).over(Window.partitionBy("c").orderBy("r"))
    near = labelled.select(F.col(label).alias("a"), right.alias("_right"), up.alias("_up"))
    pairs = near.select("a", F.explode(F.array("_right", "_up")).alias("b")).where("a != b and a >= 0 and b >= 0")
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def overlap_weights(pixels: DataFrame, cluster: str, catchment: str) -> DataFrame:
    """(catchment, cluster, weight): the share of a catchment's pixels, those without a cluster included in the whole."""
    counted = pixels.where(F.col(catchment).isNotNull()).groupBy(catchment, cluster).count()
    total = F.sum("count").over(Window.partitionBy(catchment))
    return counted.select(catchment, cluster, (F.col("count") / total).alias("weight")).where(F.col(cluster) >= 0)


def renumber_large(pixels: DataFrame, label: str, least: int) -> DataFrame:
    """``pixels`` with ``label`` numbered from 1 for those of at least ``least`` pixels, 0 for the rest."""
    kept = pixels.where(F.col(label) > 0).groupBy(label).count().where(F.col("count") >= least)
    numbers = kept.select(label, F.row_number().over(Window.orderBy(label)).alias("_n"))
    return pixels.join(numbers, label, "left").withColumn(label, F.coalesce("_n", F.lit(0))).drop("_n")


def terrain_features(pixels: DataFrame) -> DataFrame:
    """``pixels`` with the features of clustering: cosine and sine of aspect, and the slope's parts to the north (sx, also northness) and to the east (sy)."""
    a, steep = F.radians("aspect"), F.sin(F.radians("slope"))
    north = steep * F.cos(a)
    return pixels.withColumns({"cos_aspect": F.cos(a), "sin_aspect": F.sin(a), "northness": north, "sx": north, "sy": steep * F.sin(a)})


def feature_columns(pixels: DataFrame, features: Sequence[str]) -> list[str]:
    """The wanted features that clustering can use: svf is left out where it isn't there yet, any other one that is missing raises ValueError."""
    if missing := [f for f in features if f not in pixels.columns and f != "svf"]:
        raise ValueError(f"no features {', '.join(missing)}")
    return [f for f in features if f in pixels.columns]


def standardise(df: DataFrame, features: Sequence[str], weights: Sequence[float] | None = None) -> DataFrame:
    """Population standardisation of the features; a constant one is centred only; then weights."""
    stats = df.agg(*(F.avg(f).alias(f"_m_{f}") for f in features), *(F.stddev_pop(f).alias(f"_s_{f}") for f in features))
    w = dict(zip(features, weights or [1.0] * len(features), strict=True))
    out = df.crossJoin(F.broadcast(stats))
    out = out.withColumns({f: (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")).otherwise(1.0) * w[f] for f in features})
    return out.drop(*(f"_{k}_{f}" for k in "ms" for f in features))


def kmeans(df: DataFrame, features: Sequence[str], k: int, seed: int = 42, name: str = "cluster") -> DataFrame:
    """``df`` with the cluster of each row; rows with a missing feature have none."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    full = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="skip").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="_f", predictionCol=name, initMode="k-means||").fit(full).transform(full).drop("_f")


def stratified_kmeans(df: DataFrame, features: Sequence[str], stratum: str, k: int, seed: int = 42, name: str = "cluster") -> DataFrame:
    """k clusters shared out among the strata by their pixels, one at least for each, with ids that don't overlap."""
    counts = df.groupBy(stratum).count().orderBy(stratum).collect()
    total, offset, parts = sum(r["count"] for r in counts), 0, []
    for r in counts:
        own = max(1, min(r["count"], round(k * r["count"] / total)))
        parts.append(kmeans(df.where(F.col(stratum) == r[stratum]), features, own, seed, name).withColumn(name, F.col(name) + offset))
        offset += own
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cluster_metrics(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """One row: n, k, inertia, calinski_harabasz, davies_bouldin, all exact.

    Davies-Bouldin compares centroids pairwise, as many as there are clusters.
    """
    c = df.groupBy(cluster).agg(F.count("*").alias("n"), *(F.avg(f).alias(f"_c_{f}") for f in features))
    square = lambda a, b: sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b, strict=True)), F.lit(0.0))
    within = df.join(F.broadcast(c), cluster).groupBy(cluster).agg(F.sum(square(features, [f"_c_{f}" for f in features])).alias("w"), F.avg(F.sqrt(square(features, [f"_c_{f}" for f in features]))).alias("s"))
    own = c.join(within, cluster)
    g = df.agg(*(F.avg(f).alias(f"_g_{f}") for f in features))
    between = own.crossJoin(F.broadcast(g)).agg(F.sum("w").alias("inertia"), F.sum(F.col("n") * square([f"_c_{f}" for f in features], [f"_g_{f}" for f in features])).alias("b"), F.count("*").alias("k"), F.sum("n").alias("n"))
    other = own.select(F.col(cluster).alias("_o"), F.col("s").alias("s2"), *(F.col(f"_c_{f}").alias(f"_d_{f}") for f in features))
    ratio = (F.col("s") + F.col("s2")) / F.sqrt(square([f"_c_{f}" for f in features], [f"_d_{f}" for f in features]))
    db = own.join(F.broadcast(other), F.col(cluster) != F.col("_o")).groupBy(cluster).agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    ch = (F.col("b") / (F.col("k") - 1)) / (F.col("inertia") / (F.col("n") - F.col("k")))
    return between.crossJoin(F.broadcast(db)).select("n", "k", "inertia", ch.alias("calinski_harabasz"), "davies_bouldin")


def nearest_pixel(points: DataFrame, dem: DataFrame, x0: float, y0: float, res: float, n_rows: int, n_cols: int, values: Sequence[str] = ("elevation",)) -> DataFrame:
    """``points`` (x, y) with r, c and the values of the nearest pixel of a regular raster with its first pixel at (x0, y0); half-way goes up, outside to the edge."""
    index = lambda at, first, n: F.least(F.greatest(F.floor((F.col(at) - first) / res + 0.5).cast("int"), F.lit(0)), F.lit(n - 1))
    placed = points.withColumns({"r": index("y", y0, n_rows), "c": index("x", x0, n_cols)})
    return placed.join(dem.select("r", "c", *values), ["r", "c"], "left")


def of_types(units: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """The units of some surface types."""
    return units.where(F.col("surface_type").isin(list(kinds)))


def at_least(areas: DataFrame, least_m2: float, column: str = "area_m2") -> DataFrame:
    """The polygons or units of an area of ``least_m2`` or more."""
    return areas.where(F.col(column) >= least_m2)


def finite(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows whose features are all there and finite."""
    for f in features:
        x = F.col(f).cast("double")
        df = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df


def masked(pixels: DataFrame, mask: DataFrame, features: Sequence[str]) -> DataFrame:
    """``pixels`` with the features of those outside of ``mask`` (r, c) set to null."""
    inside = mask.select("r", "c").distinct().withColumn("_in", F.lit(True))
    joined = pixels.join(inside, ["r", "c"], "left")
    return joined.withColumns({f: F.when(F.col("_in"), F.col(f)) for f in features}).drop("_in").select(*pixels.columns)


def unit_elevation(dem: DataFrame, membership: DataFrame, n_units: int, nodata: int = -1) -> DataFrame:
    """(unit_idx, elevation, pixels) of units 0 to n_units - 1: the mean elevation, missing heights counting as 0; null for a unit without pixels."""
    spark = dem.sparkSession
    of = membership.where(F.col("unit_idx") != nodata).join(dem.select("r", "c", "elevation"), ["r", "c"], "left")
    means = of.groupBy("unit_idx").agg((F.sum(F.coalesce(F.nanvl("elevation", F.lit(0.0)), F.lit(0.0))) / F.count("*")).alias("elevation"), F.count("*").alias("pixels"))
    every = spark.range(n_units).select(F.col("id").cast("int").alias("unit_idx"))
    return every.join(means, "unit_idx", "left").select("unit_idx", "elevation", F.coalesce("pixels", F.lit(0)).alias("pixels"))


def point_in_ring(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Even-odd ray casting against one closed ring of literals."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(point columns, polygon_id) for points (x, y) inside of polygons (polygon_id, ring array<struct<x,y>>).

    Both sides meet in grid cells of side ``cell``: a polygon stands in every cell of its bounding box; the ring is then
    cast row by row.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    span = lambda v: F.explode(F.sequence(F.floor(F.array_min(v) / cell), F.floor(F.array_max(v) / cell)))
    boxed = polygons.withColumn("_cx", span(xs)).withColumn("_cy", span(ys))
    located = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    edges = F.arrays_zip(F.col("ring").alias("p"), F.concat(F.slice("ring", F.lit(2), F.size("ring")), F.slice("ring", 1, 1)).alias("q"))
    crosses = lambda e: ((e["p"]["y"] > F.col("y")) != (e["q"]["y"] > F.col("y"))) & (F.col("x") < (F.col("y") - e["p"]["y"]) * (e["q"]["x"] - e["p"]["x"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"])
    return located.join(boxed, ["_cx", "_cy"]).where(F.size(F.filter(edges, crosses)) % 2 == 1).select(*points.columns, "polygon_id")


SURFACE_CODES = {"open": 0, "glacier": 1, "forest": 2, "rock": 3, "water": 4}


def reclassify(code: Column, mapping: dict[int, int]) -> Column:
    out = F.lit(None)
    for k, v in mapping.items():
        out = F.when(code == k, v).otherwise(out)
    return F.coalesce(out.cast("int"), F.lit(0))


def overlay_glacier(code: Column, glacier: Column) -> Column:
    return F.when(glacier, SURFACE_CODES["glacier"]).otherwise(code)
