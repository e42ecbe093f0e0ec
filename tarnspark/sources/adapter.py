"""Forcing, units and terrain derived from the driver's relational tables, the same in any SQL engine."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.functions import physics as ph
from tarnspark.operators.interp import with_weights

LAT0, LON0, STEP, N_LAT, N_LON = 42.0, 76.0, 0.25, 5, 5
LEVELS = ((300, 9200.0), (500, 5500.0), (700, 3000.0), (850, 1500.0), (1000, 100.0))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def hours(self) -> DataFrame:
        return self.table("events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).agg(ph.decimals(F.avg("value"), 4).alias("ev"))

    @cached_property
    def grid(self) -> DataFrame:
        cell = F.col("n_nationkey")
        row = F.floor(cell / 5).cast("int")
        return self.table("nation").select(
            cell.alias("cell"), row.alias("lat_idx"), (cell % 5).alias("lon_idx"), (F.lit(LAT0) + row * STEP).alias("latitude"), (F.lit(LON0) + (cell % 5) * STEP).alias("longitude"), (cell * 40.0 + 1500.0).alias("z_surf")
        )

    @cached_property
    def units(self) -> DataFrame:
        k = F.col("s_suppkey")
        kind = F.when(k % 4 == 0, "open").when(k % 4 == 1, "glacier").when(k % 4 == 2, "forest").otherwise("rock")
        slope = (k * 7 % 46) * 1.0
        return self.table("supplier").select(
            k.alias("unit_id"), (F.lit(42.0) + (k * 37 % 100) / 100.0).alias("lat"), (F.lit(76.0) + (k * 61 % 100) / 100.0).alias("lon"), ((F.col("s_acctbal") + 1000.0) / 4.0 + 1000.0).alias("elevation"),
            slope.alias("slope"), ((k * 53 % 360) * 1.0).alias("aspect"), kind.alias("surface_type"), (1.0 - slope / 180.0).alias("svf"), ((k * 13 % 41 - 20) * 1.0).alias("sx"),
        )

    @cached_property
    def units_w(self) -> DataFrame:
        return with_weights(self.units, LAT0, LON0, STEP, N_LAT, N_LON)

    @cached_property
    def surface(self) -> DataFrame:
        dz = F.col("z_surf") - 1500.0
        ev = F.col("ev")
        sun = F.sin(F.radians((F.hour("time") - 1.0) * 15.0))
        return self.hours.crossJoin(F.broadcast(self.grid)).select(
            "time", "cell", "lat_idx", "lon_idx", "latitude", "longitude", "z_surf",
            (ev / 10.0 + 268.0 - dz * 0.0065).alias("t2m"), (ev / 20.0 + 263.0 - dz * 0.006).alias("d2m"), (85000.0 - dz * 10.0).alias("sp"), (ev * 0.01).alias("tp"),
            (ev / 25.0 + 3.0).alias("u10"), ((F.col("lon_idx") - 2) * 1.0).alias("v10"), (ev / 2.0 + 250.0).alias("strd"), ph.decimals(F.greatest(F.lit(0.0), sun * 650.0), 4).alias("ssrd"),
        )

    @cached_property
    def plev(self) -> DataFrame:
        level = F.explode(F.array(*(F.struct(F.lit(p).alias("level"), F.lit(z).alias("z")) for p, z in LEVELS))).alias("l")
        f = self.surface.select("*", level).withColumns({"level": F.col("l.level"), "z": F.col("l.z")})
        return f.select(
            "time", "lat_idx", "lon_idx", "level", "z", (F.col("t2m") - (F.col("z") - F.col("z_surf")) * 0.0065).alias("t"), (F.col("u10") * (F.col("z") / 4000.0 + 1.0)).alias("u"), F.col("v10").alias("v"),
            ph.decimals(F.exp(-F.col("z") / 2500.0) * 0.006, 12).alias("q"),
        )

    @cached_property
    def dem(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(F.floor(k / 50).cast("int").alias("r"), (k % 50).cast("int").alias("c"), (F.col("p_retailprice") * 10.0).alias("elevation"))

    @cached_property
    def series(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("cell"), F.col("ts").alias("time"), F.col("event_id").alias("tiebreak"), "value")

    @cached_property
    def cells(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(k.alias("i"), (F.col("c_acctbal") / 100.0 + 50.0).alias("swe"), ((k * 13 % 41 - 20) * 1.0).alias("sx"), (k % 9 + 2.0).alias("wind"), ((k * 7 % 61) * 1.0).alias("slope"), ((k % 5) * 10.0 + 100.0).alias("area"))

    @cached_property
    def edges(self) -> DataFrame:
        n = self.table("customer").agg(F.count("*").alias("n"))
        slots = F.explode(F.array(*(F.struct(F.lit(s).alias("slot"), F.lit(w).alias("w")) for s, w in ((1, 0.5), (2, 0.3), (3, 0.2))))).alias("k")
        return self.table("customer").crossJoin(F.broadcast(n)).select("c_custkey", "n", slots).select(F.col("c_custkey").alias("i"), F.col("k.slot").alias("slot"), ((F.col("c_custkey") + F.col("k.slot")) % F.col("n")).alias("j"), F.col("k.w").alias("weight"))

    @cached_property
    def membership(self) -> DataFrame:
        """Vertical stripes of ten units, none in the last columns."""
        return self.dem.select("r", "c", F.when(F.col("c") < 45, F.floor(F.col("c") / 5).cast("int")).otherwise(-1).alias("unit_idx"))

    @cached_property
    def catchments(self) -> DataFrame:
        """A tree of catchments: each drains to the one of half its number."""
        k = F.col("s_suppkey")
        return self.table("supplier").select(k.cast("string").alias("id"), F.when(k > 1, F.floor(k / 2).cast("string")).otherwise("0").alias("downstream_id"))
