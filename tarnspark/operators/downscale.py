"""Downscaling of surface and pressure-level forcing to spatial units.

The requested outputs are resolved to groups (``tarnspark.plans.planner``), the groups to the
columns that they read; the rest is one chain of projections that Catalyst prunes and compiles.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.functions import physics as ph
from tarnspark.operators import interp
from tarnspark.plans.planner import OUTPUTS, resolve_groups


@dataclass(frozen=True)
class Settings:
    """Parameters of the physics.  ``strict_physics`` uses the true solar azimuth where the default takes north."""

    mode: str = "simple"
    lapse_rate: float = ph.LAPSE_RATE
    precip_gradient: float = 0.0
    t_snow: float = ph.T_SNOW
    t_rain: float = ph.T_RAIN
    phase_method: str = "air_temperature"
    wind_method: str = "log_profile"
    strict_physics: bool = False

    def __post_init__(self) -> None:
        if self.mode not in ("simple", "full"):
            raise ValueError(f"mode must be 'simple' or 'full', not {self.mode!r}")
        if not abs(self.lapse_rate) <= 0.02:
            raise ValueError("lapse_rate must lie within 0.02 K/m of 0")
        if not abs(self.precip_gradient) <= 0.01:
            raise ValueError("precip_gradient must lie within 0.01 of 0")
        if not self.t_snow < self.t_rain:
            raise ValueError("t_snow must be below t_rain")
        if self.phase_method not in ("air_temperature", "wet_bulb"):
            raise ValueError("phase_method must be 'air_temperature' or 'wet_bulb'")
        if self.wind_method not in ("log_profile", "winstral"):
            raise ValueError("wind_method must be 'log_profile' or 'winstral'")


#: What each group reads from the surface rows, besides the units.
SURFACE = {
    "temperature": ("t2m", "sp", "z_surf"),
    "wind": ("u10", "v10"),
    "humidity": ("d2m",),
    "radiation": ("ssrd", "strd", "d2m"),
    "precipitation": ("tp", "z_surf"),
}
LEVELS = {"temperature": ("z", "t"), "wind": ("z", "u", "v"), "humidity": ("z", "q")}


def at_units(surface: DataFrame, units_w: DataFrame, outputs: Iterable[str] | None, settings: Settings, plev: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The inputs of the groups interpolated to the units, and the groups."""
    groups = resolve_groups(outputs, set(surface.columns), settings.mode)
    wanted = sorted({v for g in groups for v in SURFACE[g] if v in surface.columns})
    values, keys = list(wanted), ("time", "member") if "member" in surface.columns else ("time",)
    parts = interp.fan_out(surface, units_w, keys)
    blocks = interp.cell_blocks(surface, values, keys, parts)
    names: list[str] = []
    if settings.mode == "full":
        if plev is None:
            raise ValueError("full mode needs pressure levels")
        names = sorted({v for g in groups for v in LEVELS.get(g, ())})
        nested = interp.level_arrays(plev, names, (*keys, "lat_idx", "lon_idx"))
        levels = interp.cell_blocks(nested.withColumnsRenamed({v: f"{v}_levels" for v in names}), [f"{v}_levels" for v in names], keys, parts).withColumnRenamed("corners", "level_corners")
        blocks = blocks.join(levels, [*keys, "j1", "i1"])  # coarse rows only, dealt alike on both sides
    joined = blocks.join(interp.small(units_w), ["j1", "i1"])
    if names:
        joined = interp.with_bracket(joined, F.col("elevation"))
    at_level = [interp.at_bracket(f"{v}_levels").alias(f"{v}_level") for v in names if v != "z"]
    return joined.select(*keys, *units_w.columns, *(interp.bilinear(v).alias(v) for v in values), *at_level), groups


def with_sun(rows: DataFrame, azimuth: bool) -> DataFrame:
    """``rows`` with _e and _a.  Steps are columns of their own, so that generated code stays in methods that compile."""
    if azimuth:
        e, a = ph.solar_geometry(F.col("time"), F.col("lat"), F.col("lon"))
        return rows.withColumns({"_e": e, "_a": a})
    rows = rows.withColumn("_doy", F.dayofyear("time").cast("double"))
    rows = rows.withColumns({"_delta": ph.declination(F.col("_doy")), "_eot": ph.equation_of_time(F.col("_doy"))})
    hour = F.hour("time").cast("double") + F.minute("time") / 60.0
    rows = rows.withColumn("_angle", F.radians((hour + F.col("lon") / 15.0 + F.col("_eot") - 12.0) * 15.0))
    rows = rows.withColumn("_sin", ph.sine_of_elevation(F.radians("lat"), F.col("_delta"), F.col("_angle")))
    rows = rows.withColumns({"_e": F.degrees(F.asin(ph.clip(F.col("_sin"), -1.0, 1.0))), "_a": F.lit(0.0)})
    return rows.drop("_doy", "_delta", "_eot", "_angle", "_sin")


def physics_columns(rows: DataFrame, groups: Iterable[str], settings: Settings) -> DataFrame:
    """``rows`` with the outputs of the groups, step by step."""
    full = settings.mode == "full"
    c, groups = F.col, list(groups)
    level: dict[str, Column] = {v: c(f"{v}_level") for v in ("t", "u", "v", "q")}
    if "temperature" in groups:
        rows = rows.withColumn("temperature", level["t"] if full else ph.lapse_rate_correction(c("t2m"), -settings.lapse_rate, c("elevation"), c("z_surf")))
        rows = rows.withColumn("pressure", ph.hypsometric_pressure(c("sp"), c("z_surf"), c("elevation"), c("t2m"), c("temperature")))
    if "wind" in groups:
        u, v = (level["u"], level["v"]) if full else (c("u10"), c("v10"))
        rows = rows.withColumns({"_u": u, "_v": v})
        z_from, z0_from = (ph.Z_FREE_AIR, ph.Z0_FREE_AIR) if full else (ph.Z_REFERENCE, ph.Z0_REFERENCE)
        kind = c("surface_type")
        speed = ph.log_profile(ph.wind_speed(c("_u"), c("_v")), z_from, ph.Z_REFERENCE, z0_from, ph.roughness(kind), 0.0, ph.displacement(kind))
        if settings.wind_method == "winstral" and "sx" in rows.columns:
            speed = ph.winstral_wind(speed, c("sx"))
        rows = rows.withColumns({"wind_speed": speed, "wind_direction": ph.wind_direction(c("_u"), c("_v"))}).drop("_u", "_v")
    if "humidity" in groups:
        rows = rows.withColumn("humidity_specific", level["q"] if full else ph.specific_humidity_from_dewpoint(c("d2m"), c("sp")))
        e = (ph.vapor_pressure_mixing if full else ph.vapor_pressure)(c("humidity_specific"), c("pressure"))
        rows = rows.withColumn("humidity_relative", ph.relative_humidity(e, c("temperature")))
    if "radiation" in groups:
        rows = with_sun(rows, settings.strict_physics).withColumn("_kt", ph.clearness_index(c("ssrd"), c("_e")))
        direct, diffuse = ph.partition_shortwave(c("ssrd"), c("_e"), c("_kt"))
        rows = rows.withColumns({"_direct": direct, "_diffuse": diffuse})
        vp = ph.saturation_vapor_pressure(c("d2m"))
        vp_unit = ph.vapor_pressure(c("humidity_specific"), c("pressure")) if "humidity" in groups else vp * (c("pressure") / c("sp"))
        rows = rows.withColumns({"_vp": vp, "_vp_unit": vp_unit})
        rows = rows.withColumns({
            "shortwave_direct": ph.slope_correction(c("_direct"), c("_e"), c("_a"), c("slope"), c("aspect")),
            "shortwave_diffuse": ph.diffuse_correction(c("_diffuse"), c("svf")),
            "longwave": ph.longwave_correction(c("strd"), c("t2m"), c("temperature"), c("_vp"), c("_vp_unit"), c("svf")),
        }).drop("_e", "_a", "_kt", "_direct", "_diffuse", "_vp", "_vp_unit")
    if "precipitation" in groups:
        rows = rows.withColumn("precipitation", ph.precipitation_gradient(c("tp"), c("elevation"), c("z_surf"), settings.precip_gradient))
        phase = ph.wet_bulb(c("temperature"), c("pressure"), c("humidity_specific")) if settings.phase_method == "wet_bulb" and "humidity" in groups else c("temperature")
        rain, snow = ph.phase_partition(c("precipitation"), phase, settings.t_rain, settings.t_snow)
        rain, snow = ph.air_temperature_guard(rain, snow, c("precipitation"), c("temperature"))
        rows = rows.withColumns({"rainfall": rain, "snowfall": snow})
    return rows


def downscale(surface: DataFrame, units_w: DataFrame, outputs: Iterable[str] | None = None, settings: Settings = Settings(), plev: DataFrame | None = None) -> DataFrame:
    """(time, unit_id) and the requested outputs, all by default; a ``member`` column of the surface stays a key."""
    wanted = list(outputs) if outputs is not None else None
    rows, groups = at_units(surface, units_w, wanted, settings, plev)
    done = physics_columns(rows, groups, settings)
    keys = [k for k in ("time", "member", "unit_id") if k in done.columns]
    return done.select(*keys, *(o for o in OUTPUTS if o in done.columns and (wanted is None or o in wanted)))
