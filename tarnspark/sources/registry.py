"""Forcing sources: readers by name, projection and predicates that reach the scan, and multi-source merging."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.operators import ingest

#: Names under which a coordinate may stand in foreign data.
COORDINATES = {"time": ("time", "valid_time", "datetime"), "latitude": ("latitude", "lat", "y"), "longitude": ("longitude", "lon", "x"), "level": ("level", "pressure_level", "isobaricInhPa")}
#: Long names of foreign schemas.
RENAMES = {
    "2m_temperature": "t2m", "temperature_2m": "t2m", "2m_dewpoint_temperature": "d2m", "dewpoint_2m": "d2m", "surface_pressure": "sp", "total_precipitation": "tp", "precipitation": "tp",
    "surface_solar_radiation_downwards": "ssrd", "surface_thermal_radiation_downwards": "strd", "10m_u_component_of_wind": "u10", "10m_v_component_of_wind": "v10", "geopotential": "z",
    "temperature": "t", "specific_humidity": "q", "u_component_of_wind": "u", "v_component_of_wind": "v", "relative_humidity": "r", "toa_incident_solar_radiation": "tisr",
}
SURFACE = ("t2m", "d2m", "sp", "ssrd", "strd", "tp", "z_surf", "u10", "v10", "tisr")
LEVELS = ("z", "t", "u", "v", "q", "r")
#: Native resolution in m.
RESOLUTIONS = {"era5": 31000.0, "hres": 9000.0, "icon": 6500.0, "cosmo": 1000.0, "gfs": 28000.0, "custom": 10000.0}


@dataclass(frozen=True)
class Request:
    """What to read: box (west, south, east, north), days (both included), variables, levels, hours of the day."""

    bbox: tuple[float, float, float, float] | None = None
    days: tuple[str, str] | None = None
    variables: Sequence[str] | None = None
    levels: Sequence[int] | None = None
    every_hours: int = 1


@dataclass(frozen=True)
class Spec:
    """Where a source's tables lie and how their columns are called; ``prefer`` names a fallback order."""

    surface: str
    levels: str | None = None
    format: str = "parquet"
    mapping: Mapping[str, str] = field(default_factory=dict)
    options: Mapping[str, str] = field(default_factory=dict)


_READERS: dict[str, Callable[[SparkSession, Spec, Request], tuple[DataFrame, DataFrame | None]]] = {}


def register(name: str):
    def add(f):
        _READERS[name] = f
        return f

    return add


def available() -> list[str]:
    return sorted(_READERS)


def resolution(name: str) -> float:
    return RESOLUTIONS.get(name, RESOLUTIONS["custom"])


def load(spark: SparkSession, name: str, spec: Spec, request: Request = Request()) -> tuple[DataFrame, DataFrame | None]:
    """(surface rows, level rows) of a registered source."""
    if name not in _READERS:
        raise ValueError(f"unknown source {name!r}; there are {', '.join(available())}")
    return _READERS[name](spark, spec, request)


def validate_mapping(columns: Sequence[str], mapping: Mapping[str, str], required: Sequence[str]) -> list[str]:
    """Warnings about a rename map; ValueError if a required variable would be missing."""
    got = {mapping.get(c, RENAMES.get(c, c)) for c in columns}
    if missing := sorted(set(required) - got):
        raise ValueError(f"missing after renaming: {', '.join(missing)}")
    return [f"{k} is not in the data" for k in mapping if k not in columns]


def canonical(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Foreign names to canonical ones: the map's first, then known long names and coordinates."""
    names = {}
    for c in df.columns:
        new = mapping.get(c) or RENAMES.get(c) or next((k for k, alts in COORDINATES.items() if c in alts), c)
        if new != c and new not in df.columns and new not in names.values():
            names[c] = new
    return df.withColumnsRenamed(names)


def narrow(df: DataFrame, request: Request, kept: Sequence[str]) -> DataFrame:
    """Projection and predicates of a request, in forms that Catalyst pushes to the scan."""
    keys = [c for c in ("time", "level", "latitude", "longitude", "lat_idx", "lon_idx", "cell", "member") if c in df.columns]
    wanted = [v for v in kept if v in df.columns and (request.variables is None or v in request.variables)]
    if request.days is not None:
        df = df.where(ingest.in_days(F.col("time"), *request.days))
        if "day" in df.columns:  # a store partitioned by day: whole folders are left out
            df = df.where(F.col("day").between(*(F.lit(d).cast("date") for d in request.days)))
    if request.bbox is not None:
        df = df.where(ingest.in_bbox(F.col("latitude"), F.col("longitude"), *request.bbox))
    if request.levels is not None and "level" in df.columns:
        df = df.where(F.col("level").isin(list(request.levels)))
    if request.every_hours > 1:
        df = df.where(ingest.every_hours(F.col("time"), request.every_hours))
    return df.select(*keys, *wanted)


def _read(spark: SparkSession, spec: Spec, path: str) -> DataFrame:
    return canonical(spark.read.format(spec.format).options(**spec.options).load(path), spec.mapping)


@register("custom")
@register("era5")
def tables(spark: SparkSession, spec: Spec, request: Request) -> tuple[DataFrame, DataFrame | None]:
    """Tables of any format that Spark reads; one that holds both kinds is split by columns."""
    surface = _read(spark, spec, spec.surface)
    levels = _read(spark, spec, spec.levels) if spec.levels else None
    return narrow(surface, request, SURFACE), None if levels is None else narrow(levels, request, LEVELS)


def _wrapped(request: Request) -> Request:
    """The request with its box in longitudes from 0 to 360, so that its predicate is one on the stored column."""
    if request.bbox is None:
        return request
    west, south, east, north = request.bbox
    if east - west >= 360:
        return replace(request, bbox=(0.0, south, 360.0, north))
    return replace(request, bbox=(west % 360, south, east % 360, north))


@register("archive")
def archive(spark: SparkSession, spec: Spec, request: Request) -> tuple[DataFrame, DataFrame | None]:
    """Global archives with longitudes from 0 to 360 and hourly precipitation at any step.

    The box is wrapped, not the column, so that it reaches the scan; longitudes are wrapped in what is read.  Precipitation is multiplied by the median
    step's hours, and of the wanted levels those that are stored are read.
    """
    inside = _wrapped(request)
    own = lambda df: df.withColumn("longitude", ingest.wrap_longitude(F.col("longitude")))
    surface = own(narrow(_read(spark, spec, spec.surface), inside, SURFACE))
    if "tp" in surface.columns:
        step = ingest.median_step(surface.select("time").distinct().orderBy("time").limit(8).withColumn("one", F.lit(1)), ["one"], ["time"]).first()
        surface = surface if step is None else ingest.scale_precipitation(surface, step["step_s"])
    if not spec.levels:
        return surface, None
    stored = _read(spark, spec, spec.levels)
    levels = own(narrow(ingest.kept_levels(stored, request.levels) if request.levels is not None else stored, replace(inside, levels=None), LEVELS))
    return surface, levels


def select_backend(start: str, end: str, levels: bool, present: Sequence[str]) -> str:
    """The first backend that is present: for pressure levels google, cds; else openmeteo, s3, google, cds."""
    if start > end:
        raise ValueError("start is after end")
    for name in ("google", "cds") if levels else ("openmeteo", "s3", "google", "cds"):
        if name in present:
            return name
    raise ValueError("no backend is available")


def merge_sources(frames: Sequence[DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key; each value from the first source that has it."""
    tagged = [f.select(*keys, F.lit(k).alias("_rank"), *(F.col(v) if v in f.columns else F.lit(None).cast("double").alias(v) for v in values)) for k, f in enumerate(frames)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    first = lambda v: F.min_by(F.when(F.col(v).isNotNull(), F.col(v)), F.when(F.col(v).isNotNull(), F.col("_rank"))).alias(v)
    return rows.groupBy(*keys).agg(*(first(v) for v in values))


def surface_with_levels(surface: DataFrame, levels: DataFrame, keys: Sequence[str] = ("time", "lat_idx", "lon_idx")) -> DataFrame:
    """Surface rows and the nested profiles of the same cell and time, outer on both sides."""
    return surface.join(levels, list(keys), "full_outer")
