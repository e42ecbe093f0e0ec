"""Stores of forcing as partitioned Parquet: write, append, read, resume, rechunk, and text exports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.operators import aggregate, checks, ingest

# Units of the outputs, kept as column metadata.
UNITS = {
    "temperature": "K", "pressure": "Pa", "humidity_specific": "kg kg-1", "humidity_relative": "1", "wind_speed": "m s-1", "wind_direction": "degree", "shortwave_direct": "W m-2",
    "shortwave_diffuse": "W m-2", "longwave": "W m-2", "precipitation": "mm", "rainfall": "mm", "snowfall": "mm",
}


def with_metadata(df: DataFrame) -> DataFrame:
    for c, unit in UNITS.items():
        if c in df.columns:
            df = df.withMetadata(c, {"units": unit})
    return df


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by day, one shuffle that brings each day's rows together so that no task writes many small files."""
    out = with_metadata(df).withColumn("day", F.to_date("time"))
    out.repartition("day").sortWithinPartitions("time").write.mode(mode).partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str, days: tuple[str, str] | None = None) -> DataFrame:
    """The store's rows; a range of days prunes partitions."""
    df = spark.read.parquet(path)
    return (df.where(F.col("day").between(*days)) if days else df).drop("day")


def existing_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("day").distinct()


def append(df: DataFrame, path: str) -> None:
    """Adds the rows that are newer than the store's last."""
    stored = df.sparkSession.read.parquet(path)
    last = stored.agg(F.max("time")).first()[0]
    write(df if last is None else df.where(F.col("time") > F.lit(last).cast("timestamp_ntz")), path, "append")


def finalize(stored: DataFrame, daily: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Stored rows and daily ones without repeats; what is stored, then what came first, wins."""
    ranked = stored.withColumn("_rank", F.lit(0))
    for k, d in enumerate(daily, 1):
        ranked = ranked.unionByName(d.withColumn("_rank", F.lit(k)))
    return ingest.dedup_first(ranked, key, ["_rank"]).drop("_rank")


def download(days: DataFrame, path: str, fetch: Callable[[str], DataFrame]) -> int:
    """Fetches the days (day) that the store lacks, one by one, and appends them; the number of days fetched."""
    spark = days.sparkSession
    try:
        have = existing_days(spark, path)
        lacking = days.join(have, "day", "left_anti")
    except Exception as e:  # no store yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lacking = days
    wanted = [str(r["day"]) for r in lacking.orderBy("day").collect()]
    for day in wanted:
        write(fetch(day), path, "append")
    return len(wanted)


def end_day(available: DataFrame, requested: str, slack: int = 10) -> str:
    """The last available day not after the one requested, if at most ``slack`` days before it."""
    last = available.where(F.col("day") <= F.lit(requested).cast("date")).agg(F.max("day")).first()[0]
    from datetime import date, timedelta

    if last is None or date.fromisoformat(requested) - last > timedelta(days=slack):
        raise ValueError(f"nothing is available within {slack} days before {requested}")
    return last.isoformat()


WRITERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fsm": aggregate.fsm_lines, "fsm2": aggregate.fsm_lines, "smet": aggregate.smet_lines, "crocus": aggregate.crocus_columns, "cryogrid": aggregate.cryogrid_columns, "csv": lambda df: df,
}
ALIASES = {"snowpack": "smet", "safran": "crocus"}


def writer(name: str) -> Callable[[DataFrame], DataFrame]:
    name = ALIASES.get(name, name)
    if name not in WRITERS:
        raise ValueError(f"unknown format {name!r}; there are {', '.join(sorted(WRITERS))}")
    return WRITERS[name]


def export(forcing: DataFrame, name: str, path: str, units: DataFrame | None = None, warn: bool = False) -> None:
    """Checked, laid out and written: one folder for each unit, but FSM2 as lines by time and unit in files that follow each other.

    Snow models' inputs are checked once more in their own units.  SMET needs ``units`` (unit_id, lat, lon, elevation) for its headers, HBV for its evaporation.
    """
    name = ALIASES.get(name, name)
    step = aggregate.time_step(forcing)
    checks.require_valid(forcing, step, warn=warn)
    if name in ("smet", "hbv") and units is None:
        raise ValueError(f"{name} needs the units")
    if name in ("fsm", "fsm2"):
        laid = aggregate.fsm_text(checks.require_valid(aggregate.fsm_inputs(forcing, step), bounds=checks.FSM_BOUNDS, warn=warn))
        if name == "fsm2":
            laid.orderBy("time", "unit_id").select(F.col("line").alias("value")).write.text(path)
            return
    elif name == "hbv":
        days = aggregate.hbv_text(aggregate.hbv_daily(forcing, units)).select("unit_id", F.lit(99).alias("number"), F.col("day").alias("time"), "line")
        heads = F.posexplode(F.array(*(F.lit(x) for x in aggregate.HBV_HEADER))).alias("number", "line")
        laid = days.unionByName(days.select("unit_id").distinct().select("unit_id", heads).withColumn("time", F.lit(None).cast("date")))
    else:
        laid = writer(name)(forcing)
    if name == "smet":
        from datetime import datetime, timezone

        heads = aggregate.smet_header(units, datetime.now(timezone.utc).isoformat()).join(forcing.select("unit_id").distinct(), "unit_id", "left_semi")
        body = laid.select("unit_id", F.lit(99).alias("number"), "time", "line")
        laid = heads.select("unit_id", "number", F.lit(None).cast(laid.schema["time"].dataType).alias("time"), "line").unionByName(body)
    if "line" in laid.columns:
        order = [c for c in ("unit_id", "number", "time") if c in laid.columns]
        laid.repartition("unit_id").sortWithinPartitions(*order).select("unit_id", F.col("line").alias("value")).write.partitionBy("unit_id").text(path)
    else:
        laid.repartition("unit_id").sortWithinPartitions("unit_id", "time").write.partitionBy("unit_id").option("header", True).csv(path)
