"""Physics of downscaling as Column expressions: everything stays inside code generation.

Units are SI; missing is NULL and gives NULL.  ``None`` defaults are the engine's constants.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants and the engine's thresholds.
G = 9.80665
R_DRY = 287.05
SIGMA = 5.670374419e-8
SOLAR_CONSTANT = 1361.0
LAPSE_RATE = 0.0065
T_SNOW, T_RAIN, T_GUARD = 272.65, 275.65, 277.15
MIN_SIN_ELEVATION = 0.259
Z_REFERENCE, Z0_REFERENCE = 10.0, 0.03
Z_FREE_AIR, Z0_FREE_AIR = 50.0, 0.01
ROUGHNESS = {"glacier": 0.001, "open": 0.03, "rock": 0.01, "forest": 1.0}
DISPLACEMENT = {"forest": 10.0}

Number = Column | float | int


def c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clip(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL, which ``least`` and ``greatest`` alone would skip."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def at_least(x: Column, low: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def mod360(x: Column) -> Column:
    return x - 360.0 * F.floor(x / 360.0)


def decimals(x: Column, n: int) -> Column:
    """Half-up rounding that any engine computes alike."""
    return F.floor(x * 10.0**n + 0.5) / 10.0**n


# --- temperature and pressure --------------------------------------------------
def lapse_rate_correction(t: Column, gamma: Number, z_unit: Column, z_source: Column) -> Column:
    return t + c(gamma) * (z_unit - z_source)


def simple_lapse_rate(t: Column, z_source: Column, z_target: Column, lapse_rate: Number = LAPSE_RATE) -> Column:
    return t - c(lapse_rate) * (z_target - z_source)


def hypsometric_pressure(p_source: Column, z_source: Column, z_target: Column, t_source: Column, t_target: Column) -> Column:
    return p_source * F.exp((z_target - z_source) * (-G) / (F.lit(R_DRY) * ((t_source + t_target) / 2.0)))


# --- humidity -------------------------------------------------------------------
def saturation_vapor_pressure(t: Column) -> Column:
    """Bolton's formula, Pa."""
    return F.exp((t - 273.15) * 17.67 / (t - 29.65)) * 611.2


def specific_humidity_from_dewpoint(d2m: Column, p: Column) -> Column:
    e = saturation_vapor_pressure(d2m)
    return e * 0.622 / (p - e * 0.378)


def vapor_pressure(q: Column, p: Column) -> Column:
    return q * p / (q * 0.378 + 0.622)


def vapor_pressure_mixing(q: Column, p: Column) -> Column:
    mr = q / (1.0 - q)
    return mr * p / (mr + 0.62197)


def relative_humidity(e: Column, t: Column) -> Column:
    return clip(e / saturation_vapor_pressure(t), 0.0, 1.0)


def adjust_humidity(q: Column, t: Column, p: Column) -> tuple[Column, Column]:
    """(q, rh): specific humidity is conserved."""
    return q, relative_humidity(vapor_pressure_mixing(q, p), t)


def rh_percent(q: Column, t: Column, p: Column) -> Column:
    return clip(vapor_pressure_mixing(q, p) / saturation_vapor_pressure(t) * 100.0, 0.0, 100.0)


def q_from_rh(rh: Column, t: Column, p: Column) -> Column:
    e = rh * saturation_vapor_pressure(t)
    return e * 0.622 / (p - e * 0.378)


def wet_bulb(t: Column, p: Column, q: Column, steps: int = 20) -> Column:
    """Psychrometric wet-bulb temperature by a fixed number of Newton steps, not above ``t``."""
    e = vapor_pressure(q, p)
    gamma = p * 1004.0 / (0.622 * 2.501e6)

    def step(w: Column, _: Column) -> Column:
        es = saturation_vapor_pressure(w)
        slope = es * 17.67 * 243.5 / ((w - 29.65) * (w - 29.65))
        return w - (es - gamma * (t - w) - e) / (slope + gamma)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), t, step)
    return F.when(t.isNotNull() & p.isNotNull() & q.isNotNull(), F.least(found, t))


# --- precipitation ------------------------------------------------------------------
def precipitation_gradient(p: Column, z_unit: Column, z_source: Column, gradient: Number = 0.0) -> Column:
    return at_least(p * ((z_unit - z_source) * c(gradient) + 1.0), 0.0)


def phase_partition(p: Column, t: Column, t_rain: float = T_RAIN, t_snow: float = T_SNOW) -> tuple[Column, Column]:
    fraction = F.when(t >= t_rain, 1.0).when(t <= t_snow, 0.0).otherwise((t - t_snow) / (t_rain - t_snow))
    rain = p * fraction
    return rain, p - rain


def air_temperature_guard(rain: Column, snow: Column, p: Column, t: Column, guard: float = T_GUARD) -> tuple[Column, Column]:
    """Warm air gives rain whatever the phase temperature says."""
    return F.when(t > guard, p).otherwise(rain), F.when(t > guard, 0.0).otherwise(snow)


def phase_fraction(rain: Column, snow: Column) -> Column:
    return F.when(rain + snow > 0, rain / (rain + snow)).otherwise(0.5)


# --- radiation ----------------------------------------------------------------------
def diffuse_fraction(kt: Column) -> Column:
    """Erbs and others (1982)."""
    k = clip(kt, 0.0, 1.0)
    poly = F.lit(0.9511) - k * 0.1604 + k * k * 4.388 - k * k * k * 16.638 + k * k * k * k * 12.336
    return F.when(k <= 0.22, 1.0 - k * 0.09).when(k <= 0.80, poly).otherwise(F.when(k.isNotNull(), 0.165))


def partition_shortwave(sw: Column, elevation: Column, kt: Column) -> tuple[Column, Column]:
    diffuse = F.when(elevation <= 0, sw).otherwise(diffuse_fraction(kt) * sw)
    return F.when(elevation <= 0, 0.0).otherwise(sw - diffuse), diffuse


def slope_correction(direct: Column, elevation: Column, azimuth: Column, slope: Column, aspect: Column) -> Column:
    e, a, s, o = (F.radians(x) for x in (elevation, azimuth, slope, aspect))
    incidence = at_least(F.sin(e) * F.cos(s) + F.cos(e) * F.sin(s) * F.cos(a - o), 0.0)
    factor = F.when(F.sin(e) > 0.01, incidence / F.greatest(F.sin(e), F.lit(MIN_SIN_ELEVATION))).otherwise(0.0)
    return F.when(direct.isNotNull() & elevation.isNotNull(), F.least(direct * factor, F.lit(SOLAR_CONSTANT)))


def diffuse_correction(diffuse: Column, svf: Column) -> Column:
    return diffuse * svf


def clear_sky_emissivity(vp: Column, t: Column) -> Column:
    """Brutsaert (1975)."""
    return F.pow(at_least(vp / t, 0.0), F.lit(1.0) / 5.7) * 0.43 + 0.23


def longwave_correction(lw: Column, t_source: Column, t_unit: Column, vp_source: Column, vp_unit: Column, svf: Column) -> Column:
    fourth = lambda t: t * t * t * t * SIGMA
    cloud = at_least(lw / fourth(t_source) - clear_sky_emissivity(vp_source, t_source), 0.0)
    sky = F.when(cloud.isNotNull(), F.least(clear_sky_emissivity(vp_unit, t_unit) + cloud, F.lit(1.0)))
    return svf * sky * fourth(t_unit) + (1.0 - svf) * fourth(t_unit)


def declination(doy: Column) -> Column:
    return F.radians(F.sin(F.radians((doy - 81) * (360.0 / 365.0))) * 23.45)


def equation_of_time(doy: Column) -> Column:
    b = F.radians((doy - 81) * (360.0 / 365.0))
    return (F.sin(b * 2) * 9.87 - F.cos(b) * 7.53 - F.sin(b) * 1.5) / 60.0


def sine_of_elevation(phi: Column, delta: Column, angle: Column) -> Column:
    return F.sin(phi) * F.sin(delta) + F.cos(phi) * F.cos(delta) * F.cos(angle)


def solar_geometry(time: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(elevation, azimuth) in degrees; azimuth from north, 0 where the sun stands overhead."""
    doy = F.dayofyear(time).cast("double")
    hour = F.hour(time).cast("double") + F.minute(time) / 60.0
    angle = F.radians((hour + lon / 15.0 + equation_of_time(doy) - 12.0) * 15.0)
    phi, delta = F.radians(lat), declination(doy)
    sin_e = clip(sine_of_elevation(phi, delta, angle), -1.0, 1.0)
    elevation = F.degrees(F.asin(sin_e))
    cos_e = F.cos(F.radians(elevation))
    cos_a = clip((F.sin(delta) - F.sin(phi) * sin_e) / (F.cos(phi) * cos_e), -1.0, 1.0)
    morning = F.degrees(F.acos(cos_a))
    return elevation, F.when(cos_e > 0.001, F.when(angle > 0, 360.0 - morning).otherwise(morning)).otherwise(0.0)


def toa_shortwave(elevation: Column) -> Column:
    return at_least(F.sin(F.radians(elevation)), 0.0) * SOLAR_CONSTANT


def clearness_index(ssrd: Column, elevation: Column) -> Column:
    toa = toa_shortwave(elevation)
    return clip(F.when(toa > 1.0, ssrd / toa).otherwise(0.0), 0.0, 1.0)


def cloudy_longwave(t2m: Column, d2m: Column, cloud: Column) -> Column:
    """All-sky longwave from clear-sky emissivity and the square of the cloud fraction."""
    eps = clear_sky_emissivity(saturation_vapor_pressure(d2m), t2m)
    return (eps * (1.0 - cloud * cloud) + cloud * cloud) * SIGMA * t2m * t2m * t2m * t2m


def estimate_longwave(t2m: Column, d2m: Column, ssrd: Column, tisr: Column) -> Column:
    """Dilley and O'Brien's clear sky with Unsworth and Monteith's clouds, J/m2 an hour."""
    dc = d2m - 273.15
    e_hpa = F.exp(dc * 17.67 / (dc + 243.5)) * 611.2 / 100.0
    w = at_least(e_hpa / t2m * 4.65, 0.0)
    r = t2m / 273.16
    clear = r * r * r * r * r * r * 113.7 + 59.38 + F.sqrt(w / 25.0) * 96.96
    kt = clip(F.when(tisr > 10.0, ssrd / tisr).otherwise(0.0), 0.0, 1.0)
    cloud = clip(1.0 - kt / 0.75, 0.0, 1.0)
    return clip(clear * (F.pow(cloud, F.lit(2.75)) * 0.22 + 1.0), 50.0, 600.0) * 3600.0


# --- wind -----------------------------------------------------------------------
def by_surface(kind: Column, table: dict[str, float], default: float) -> Column:
    return reduce(lambda e, kv: e.when(kind == kv[0], kv[1]), table.items(), F.when(F.lit(False), default)).otherwise(default)


def roughness(kind: Column) -> Column:
    return by_surface(kind, ROUGHNESS, ROUGHNESS["open"])


def displacement(kind: Column) -> Column:
    return by_surface(kind, DISPLACEMENT, 0.0)


def log_profile(u: Column, z_from: Number, z_to: Number, z0_from: Number, z0_to: Number, d_from: Number, d_to: Number) -> Column:
    """Speed at another height and roughness; 0 where a height isn't above its roughness."""
    h_from, h_to = c(z_from) - c(d_from), c(z_to) - c(d_to)
    valid = (h_from > c(z0_from)) & (h_to > c(z0_to))
    return F.when(valid, u * F.log(h_to / c(z0_to)) / F.log(h_from / c(z0_from))).otherwise(F.when(u.isNotNull(), 0.0))


def winstral_wind(u: Column, sx: Column, alpha: float = 0.5, scale: float = 15.0) -> Column:
    return F.when(sx.isNotNull(), u * (F.tanh(sx / scale) * alpha + 1.0)).otherwise(u)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    return mod360(F.degrees(F.atan2(-u, -v)))


def transport_rate(ws: Column, sx: Column, threshold: float = 5.0, most: float = 0.1) -> Column:
    return F.when(ws.isNotNull() & sx.isNotNull(), F.least(F.greatest(ws - threshold, F.lit(0.0)) * F.greatest(sx, F.lit(0.0)) / 15.0 * 0.01, F.lit(most)))


# --- other ------------------------------------------------------------------------
def hamon_pet(t_celsius: Column, doy: Column, lat: Column) -> Column:
    """Potential evapotranspiration in mm a day; 0 at or below freezing, NULL where the sun doesn't rise or set."""
    delta = F.sin(doy * (2 * 3.141592653589793) / 365.0 - 1.39) * 0.409
    x = -F.tan(F.radians(lat)) * F.tan(delta)
    hours = F.when(F.abs(x) <= 1, F.acos(x) * (24.0 / 3.141592653589793))
    es = F.exp(t_celsius * 17.27 / (t_celsius + 237.3)) * 0.6108
    return F.when(t_celsius > 0, hours / 12.0 * (0.165 * 216.7) * es / (t_celsius + 273.3)).otherwise(F.when(t_celsius.isNotNull(), 0.0))


def surface_geopotential(t: Column, msl: Column, sp: Column) -> Column:
    return t * 287.0 * F.log(msl / sp)


def approximate_svf(slope_degrees: Column) -> Column:
    return (F.cos(F.radians(slope_degrees)) + 1.0) / 2.0


def elevation_band(z: Column, least: Column, width: float) -> Column:
    base = F.floor(least / width) * width
    return F.floor((z - base) / width).cast("int")


def aspect_class(aspect: Column, n: int) -> Column:
    w = 360.0 / n
    return F.floor(mod360(aspect + w / 2) / w).cast("int")


def hillshade(dx: Column, dy: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """0 to 1, from the gradients along columns and rows."""
    slope, aspect = F.atan(F.sqrt(dx * dx + dy * dy)), F.atan2(-dy, dx)
    alt, az = F.radians(F.lit(altitude)), F.radians(F.lit(azimuth))
    return clip(F.cos(alt) * F.cos(slope) + F.sin(alt) * F.sin(slope) * F.cos(az - aspect), 0.0, 1.0)


def pack_int16(x: Column, scale: float) -> Column:
    """Half-even, clipped; -32768 stands for missing."""
    return F.coalesce(clip(F.rint(x * scale), -32767.0, 32767.0), F.lit(-32768.0)).cast("short")


def water_year(time: Column, start_month: int = 9) -> Column:
    if start_month == 1:
        return F.year(time)
    return F.year(time) + F.when(F.month(time) >= start_month, 1).otherwise(0)


def water_year_start(time: Column, start_month: int = 9) -> Column:
    return F.make_date(water_year(time, start_month) - (0 if start_month == 1 else 1), F.lit(start_month), F.lit(1))


def day_of_water_year(time: Column, start_month: int = 9) -> Column:
    """From 0, at most 365."""
    return F.least(F.greatest(F.datediff(F.to_date(time), water_year_start(time, start_month)), F.lit(0)), F.lit(365))


def resolution_factor(source_m: Column, target_m: Column, kind: str = "linear", low: float = 0.1, high: float = 1.0) -> Column:
    """How much of a correction applies to data of one resolution brought to another."""
    ratio = source_m / target_m
    part = {"linear": 1.0 - 1.0 / ratio, "sqrt": 1.0 - 1.0 / F.sqrt(ratio), "log": F.least(F.log10(ratio) / 3.0, F.lit(1.0))}[kind]
    return clip(F.when(ratio <= 1, low).otherwise(part * (high - low) + low), low, high)


def correction_weight(kind: str, source_m: Column, target_m: Column, complexity: Column | None = None) -> Column:
    """The weight of a local correction ('lapse_rate', 'radiation', 'wind' or 'precipitation') for a source of one resolution brought to another;
    rough terrain (``complexity`` from 0 to 1) raises that of the lapse rate."""
    shape = {"lapse_rate": "sqrt", "wind": "sqrt", "radiation": "linear", "precipitation": "linear"}[kind]
    weight = resolution_factor(source_m, target_m, shape)
    if kind != "lapse_rate" or complexity is None:
        return weight
    return F.when(complexity.isNull(), weight).otherwise(F.least(F.lit(1.0), weight * (complexity * 0.5 + 1.0)))


def water_year_dates(wy: Column, start_month: int = 9) -> tuple[Column, Column]:
    """First and last day of a water year."""
    first = F.make_date(wy - (0 if start_month == 1 else 1), F.lit(start_month), F.lit(1))
    return first, F.date_sub(F.add_months(first, 12), 1)


def water_year_windows(start: Column, end: Column, start_month: int = 9) -> Column:
    """An array of (wy, first, last): the water years between two days, cut to them."""
    years = F.sequence(water_year(start, start_month), water_year(end, start_month))

    def window(wy: Column) -> Column:
        first, last = water_year_dates(wy, start_month)
        return F.struct(wy.alias("wy"), F.greatest(first, F.to_date(start)).alias("first"), F.least(last, F.to_date(end)).alias("last"))

    return F.when(F.to_date(start) <= F.to_date(end), F.transform(years, window))


def date_of_label(wy: Column, label: Column, base: int, start_month: int = 9) -> Column:
    """The day that a label of a day of a water year stands for, labels beginning at ``base`` (0 or 1)."""
    return F.date_add(water_year_dates(wy, start_month)[0], (label - base).cast("int"))
