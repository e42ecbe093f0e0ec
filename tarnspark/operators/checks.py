"""Validation of forcing and of run specifications."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.operators import interp

# Bounds of each output in the units that the engine writes.
BOUNDS: dict[str, tuple[float, float]] = {
    "temperature": (173.15, 333.15),
    "humidity_relative": (0.0, 1.05),
    "humidity_specific": (0.0, 0.05),
    "shortwave_direct": (-1.0, 2000.0),
    "shortwave_diffuse": (-1.0, 1000.0),
    "longwave": (40.0, 700.0),
    "wind_speed": (0.0, 75.0),
    "pressure": (25000.0, 110000.0),
}
# Amounts of a step, in mm an hour at most.
AMOUNTS, MOST_AN_HOUR = ("precipitation", "rainfall", "snowfall"), 300.0
# Bounds of a snow model's inputs in its units.
FSM_BOUNDS: dict[str, tuple[float, float]] = {
    "SW": (-1.0, 3000.0),
    "LW": (40.0, 700.0),
    "Sf": (-1e-9, 300.0 / 3600.0),
    "Rf": (-1e-9, 300.0 / 3600.0),
    "Ta": (173.15, 333.15),
    "RH": (0.0, 105.0),
    "Ua": (0.0, 75.0),
    "Ps": (25000.0, 110000.0),
}


def bounds_of(step_seconds: float = 3600.0) -> dict[str, tuple[float, float]]:
    """``BOUNDS``, and those of amounts for steps of this length; a step shorter than an hour counts as one."""
    return BOUNDS | {v: (-1e-6, MOST_AN_HOUR * max(step_seconds / 3600.0, 1.0)) for v in AMOUNTS}


def _hint() -> Column:
    """What is probably wrong with a variable out of its bounds."""
    v, high, most = F.col("variable"), F.col("high"), F.col("most")
    return (
        F.when((v == "humidity_relative") & (most > 1.5), "percent instead of a fraction")
        .when((v == "RH") & (most > 0) & (most <= 1.05), "a fraction instead of percent")
        .when((v == "RH") & (most > 105), "percent times 100")
        .when(v.isin("temperature", "Ta") & (most < 80), "degrees Celsius instead of kelvin")
        .when(v.isin("pressure", "Ps") & (most < 2000), "hectopascal instead of pascal")
        .when(v.isin(*AMOUNTS, "Sf", "Rf") & (most > high), "metres instead of millimetres, or an amount instead of a rate")
        .when(most > high * 100, "a factor of 100 or 1000 too large")
        .otherwise("outside the physical range")
    )


def check_ranges(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(variable, least, most, n, status, hint): one pass over the data, then a row for each variable that is there.

    A variable without any finite value is skipped.  Relative humidity in percent that never exceeds 1.05 in 24 values or more fails too.
    """
    known = [v for v in bounds if v in df.columns]
    finite = lambda v: F.when(~F.isnan(F.col(v).cast("double")) & (F.abs(F.col(v).cast("double")) != float("inf")), F.col(v).cast("double"))
    any_ = lambda v: F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double"))
    stats = df.agg(*(c for v in known for c in (F.min(any_(v)).alias(f"{v}_a"), F.max(any_(v)).alias(f"{v}_b"), F.count(finite(v)).alias(f"{v}_n"))))
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(f"{v}_a").alias("least"), F.col(f"{v}_b").alias("most"), F.col(f"{v}_n").alias("n"), F.lit(float(bounds[v][0])).alias("low"), F.lit(float(bounds[v][1])).alias("high")) for v in known)))
    r = stats.select(rows.alias("r")).select("r.*")
    fraction = (F.col("variable") == "RH") & (F.col("most") <= 1.05) & (F.col("n") >= 24)
    status = F.when(F.col("n") == 0, "skipped").when(fraction | (F.col("least") < F.col("low")) | (F.col("most") > F.col("high")), "fail").otherwise("pass")
    return r.withColumn("status", status).select("variable", "least", "most", "n", "status", F.when(F.col("status") == "fail", _hint()).alias("hint"))


def check_forcing(forcing: DataFrame, step_seconds: float = 3600.0) -> DataFrame:
    """``check_ranges`` of the engine's outputs."""
    return check_ranges(forcing, bounds_of(step_seconds))


def check_fsm_inputs(inputs: DataFrame) -> DataFrame:
    """``check_ranges`` of a snow model's inputs, already in its units."""
    return check_ranges(inputs, FSM_BOUNDS)


def require_valid(df: DataFrame, step_seconds: float = 3600.0, bounds: Mapping[str, tuple[float, float]] | None = None, warn: bool = False) -> DataFrame:
    """``df``, or ValueError naming what is out of range and why; with ``warn`` a warning instead."""
    bad = check_ranges(df, bounds or bounds_of(step_seconds)).where("status = 'fail'").collect()
    if bad:
        text = "out of range: " + "; ".join(f"{r['variable']} {r['least']:.4g} to {r['most']:.4g}, {r['hint']}" for r in bad)
        if not warn:
            raise ValueError(text)
        warnings.warn(text, stacklevel=2)
    return df


# Pressure levels in hPa and their heights in m.
LEVEL_HEIGHTS = {
    1000: 100, 975: 300, 950: 500, 925: 750, 900: 1000,
    875: 1250, 850: 1500, 825: 1750, 800: 2000, 775: 2250,
    750: 2500, 700: 3000, 650: 3600, 600: 4200, 550: 4900,
    500: 5500, 450: 6200, 400: 7200, 350: 8100, 300: 9200,
    250: 10400, 200: 11800, 150: 13600, 100: 16200,
}


def pressure_height(level: float) -> float:
    """The height of a pressure level, linear between the known ones; 0 below them, the highest above."""
    known = sorted(LEVEL_HEIGHTS.items())
    if level > known[-1][0]:
        return 0.0
    if level <= known[0][0]:
        return float(known[0][1])
    above = next(k for k, (p, _) in enumerate(known) if p >= level)
    (p0, z0), (p1, z1) = known[above - 1], known[above]
    return z1 + (z0 - z1) * (p1 - level) / (p1 - p0)


@dataclass(frozen=True)
class Check:
    category: str
    status: str
    message: str


def preflight(bbox: Sequence[float] | None, start: str, end: str, levels: Sequence[int], mode: str, n_clusters: int, n_pixels: int) -> list[Check]:
    """What can be told before a run from its specification."""
    out = []
    add = lambda category, ok, text, bad="fail": out.append(Check(category, "pass" if ok else bad, text))
    if bbox is not None:
        west, south, east, north = bbox
        add("bbox", south < north and -90 <= south and north <= 90 and -180 <= west <= 360 and -180 <= east <= 360, f"box {tuple(bbox)}")
    add("time", start <= end, f"{start} to {end}")
    if mode == "full":
        heights = sorted(pressure_height(p) for p in levels)
        add("levels", len(heights) >= 2, f"{len(heights)} levels")
        if heights:
            add("levels", max((b - a for a, b in zip(heights, heights[1:], strict=False)), default=0) <= 2000, "gap between levels", "warn")
            add("levels", heights[0] <= 500, "lowest level", "warn")
    else:
        add("mode", not levels, "pressure levels are not read in simple mode", "warn")
    add("clusters", n_clusters >= 5, f"{n_clusters} clusters", "warn")
    add("clusters", n_clusters <= 0.1 * n_pixels, f"{n_clusters} clusters of {n_pixels} pixels", "warn")
    return out


def preflight_table(spark, checks: Sequence[Check]) -> DataFrame:
    return spark.createDataFrame([(c.category, c.status, c.message) for c in checks], "category string, status string, message string")


def status_counts(checks: DataFrame) -> DataFrame:
    """One row of a table of checks: how many passed, warn and fail, and whether none fails."""
    count = lambda k: F.count(F.when(F.col("status") == k, 1))
    return checks.agg(count("pass").alias("n_pass"), count("warn").alias("n_warn"), count("fail").alias("n_fail"), (count("fail") == 0).alias("ok"))


# Minutes at best and worst for so many pixels, minutes for a day of data by backend, milliseconds for a unit and step.
SETUP_MINUTES = ((1_000_000, 0.5, 2.0), (10_000_000, 2.0, 8.0), (50_000_000, 5.0, 15.0), (None, 10.0, 30.0))
FETCH_MINUTES = {"google": (0.3, 0.7), "s3zarr": (0.2, 0.5), "cds": (1.5, 3.0), "hybrid": (0.3, 1.0), "other": (0.5, 1.5)}
KERNEL_MS = {"python": 0.05, "rust": 0.005, "jax": 0.02}
MODEL_MS = {"fsm": 1.0, "fsm2": 0.1, "other": 0.5}


def estimate_stages(runs: DataFrame) -> DataFrame:
    """(run columns, stage, gb, minutes_low, minutes_high) of each planned run: n_pixels, full_svf, n_grid, n_days, steps_a_day, n_levels,
    backend, n_units, kernel, n_workers, n_variables, model ('none' for no model)."""
    c = F.col
    steps = c("n_days") * c("steps_a_day")
    pick = lambda at: F.coalesce(*(F.when(c("n_pixels") < n, row) if n else F.lit(row) for n, row in ((m, v[at]) for m, *v in SETUP_MINUTES)))
    slow = c("full_svf") & (c("n_pixels") > 1_000_000)
    by = lambda column, table, default: F.coalesce(*(F.when(c(column) == k, v) for k, v in table.items()), F.lit(default))
    days = lambda at: c("n_days") * by("backend", {k: v[at] for k, v in FETCH_MINUTES.items()}, FETCH_MINUTES["other"][at])
    kernel = c("n_units") * steps * by("kernel", KERNEL_MS, 0.05) / 1000.0 / F.greatest(c("n_workers"), F.lit(1)) / 60.0
    model = c("n_units") * steps * by("model", MODEL_MS, MODEL_MS["other"]) / 1000.0 / 60.0
    out_gb = c("n_units") * steps * c("n_variables") * 4.0 / 1e9
    stage = lambda name, gb, low, high: F.struct(F.lit(name).alias("stage"), gb.alias("gb"), low.alias("minutes_low"), high.alias("minutes_high"))
    stages = F.array(
        stage("terrain", c("n_pixels") * 20.0 / 1e9, pick(0) * F.when(slow, 2.0).otherwise(1.0), pick(1) * F.when(slow, 3.0).otherwise(1.0)),
        stage("fetch", steps * c("n_grid") * 4.0 * (c("n_levels") * 5 + 10) / 1e9 / 2.5, days(0), days(1)),
        stage("downscale", out_gb, kernel * 0.8, kernel * 1.5),
        stage("model", out_gb * 0.3, model * 0.8, model * 1.5),
    )
    return runs.select(*runs.columns, F.explode(stages).alias("s")).select(*runs.columns, "s.*").where((c("stage") != "model") | (c("model") != "none"))


def chunk_sizes(shape: Sequence[int], item_bytes: int, target_mb: float = 100.0) -> list[int]:
    """Sizes of chunks of about ``target_mb``: the largest dimension is halved, the first of equals, until a chunk fits."""
    chunk = list(shape)
    while math.prod(chunk) * item_bytes > target_mb * 1024 * 1024 and max(chunk) > 1:
        at = chunk.index(max(chunk))
        chunk[at] //= 2
    return chunk


def check_patches(units: DataFrame, patches: DataFrame, margin: float) -> DataFrame:
    """The units that no patch (west, south, east, north) covers with the margin; patches are broadcast if they are within ``interp.small``'s limit."""
    inside = (F.col("lon") >= F.col("west") + margin) & (F.col("lon") <= F.col("east") - margin) & (F.col("lat") >= F.col("south") + margin) & (F.col("lat") <= F.col("north") - margin)
    return units.join(interp.small(patches), inside, "left_anti")
