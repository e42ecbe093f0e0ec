"""The named queries of the engine over the driver's tables, and their SQL forms.

Each query calls one operator on the adapter views; its SQL states the same result independently.
Values are compared after rounding by ``floor`` (see ``OFFSET``), which both engines compute alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.functions import physics as ph
from tarnspark.operators import aggregate, checks, downscale, graph, grids, ingest, interp, redistribute, terrain, units
from tarnspark.sources import store
from tarnspark.sources.adapter import LAT0, LON0, N_LAT, N_LON, STEP, Views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PRELUDE = """
WITH RECURSIVE hours AS (SELECT date_trunc('hour', ts) AS time, floor(avg(value)*1e4+0.5e0)/1e4 AS ev FROM events GROUP BY 1
), grid AS (SELECT n_nationkey AS cell, CAST(floor(n_nationkey/5e0) AS INT) AS lat_idx, n_nationkey % 5 AS lon_idx,
  42e0 + 0.25e0*floor(n_nationkey/5e0) AS latitude, 76e0 + 0.25e0*(n_nationkey % 5) AS longitude, 1500e0 + 40e0*n_nationkey AS z_surf FROM nation
), units AS (SELECT s_suppkey AS unit_id, 42e0 + (s_suppkey*37 % 100)/100e0 AS lat, 76e0 + (s_suppkey*61 % 100)/100e0 AS lon,
  1000e0 + (s_acctbal+1000e0)/4e0 AS elevation, (s_suppkey*7 % 46)*1e0 AS slope, (s_suppkey*53 % 360)*1e0 AS aspect,
  CASE s_suppkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'glacier' WHEN 2 THEN 'forest' ELSE 'rock' END AS surface_type,
  1e0 - (s_suppkey*7 % 46)*1e0/180e0 AS svf, (s_suppkey*13 % 41 - 20)*1e0 AS sx FROM supplier
), units_w AS (SELECT *, (lat-(42e0+0.25e0*(j1-1)))/0.25e0 AS t, (lon-(76e0+0.25e0*(i1-1)))/0.25e0 AS s FROM (
  SELECT *, least(greatest(CAST(ceil((lat-42e0)/0.25e0) AS INT),1),4) AS j1, least(greatest(CAST(ceil((lon-76e0)/0.25e0) AS INT),1),4) AS i1 FROM units) u
), surface AS (SELECT h.time, g.*, 268e0 + h.ev/10e0 - 0.0065e0*(g.z_surf-1500e0) AS t2m, 263e0 + h.ev/20e0 - 0.006e0*(g.z_surf-1500e0) AS d2m,
  85000e0 - 10e0*(g.z_surf-1500e0) AS sp, h.ev*1e-2 AS tp, 3e0 + h.ev/25e0 AS u10, (g.lon_idx-2)*1e0 AS v10, 250e0 + h.ev/2e0 AS strd,
  floor(greatest(0e0, 650e0*sin(radians((hour(h.time)-1e0)*15e0)))*1e4+0.5e0)/1e4 AS ssrd FROM hours h CROSS JOIN grid g
), plev AS (SELECT f.time, f.lat_idx, f.lon_idx, l.level, l.z, f.t2m - 0.0065e0*(l.z-f.z_surf) AS t, f.u10*(1e0+l.z/4000e0) AS u, f.v10 AS v,
  floor(0.006e0*exp(-l.z/2500e0)*1e12+0.5e0)/1e12 AS q
  FROM surface f CROSS JOIN (VALUES (300,9200e0),(500,5500e0),(700,3000e0),(850,1500e0),(1000,100e0)) AS l(level,z)
), dem AS (SELECT CAST(floor(p_partkey/50e0) AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c, p_retailprice*10e0 AS elevation FROM part
), series AS (SELECT user_id AS cell, ts AS time, event_id AS tiebreak, value FROM events
), cells AS (SELECT c_custkey AS i, 50e0 + c_acctbal/100e0 AS swe, (c_custkey*13 % 41 - 20)*1e0 AS sx, 2e0 + (c_custkey % 9) AS wind,
  (c_custkey*7 % 61)*1e0 AS slope, 100e0 + (c_custkey % 5)*10e0 AS area FROM customer
), edges AS (SELECT c.c_custkey AS i, k.slot, (c.c_custkey + k.slot) % n.n AS j, k.w AS weight FROM customer c CROSS JOIN (VALUES (1,0.5e0),(2,0.3e0),(3,0.2e0)) AS k(slot,w)
  CROSS JOIN (SELECT count(*) AS n FROM customer) n
), membership AS (SELECT r, c, CASE WHEN c < 45 THEN CAST(floor(c/5e0) AS INT) ELSE -1 END AS unit_idx FROM dem
), catchments AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey > 1 THEN CAST(CAST(floor(s_suppkey/2e0) AS BIGINT) AS VARCHAR) ELSE '0' END AS downstream_id FROM supplier
), corners AS (SELECT u.*, a.time, {corner_columns}
  FROM units_w u JOIN surface a ON a.lat_idx = u.j1-1 AND a.lon_idx = u.i1-1 JOIN surface b ON b.time = a.time AND b.lat_idx = u.j1-1 AND b.lon_idx = u.i1
  JOIN surface c ON c.time = a.time AND c.lat_idx = u.j1 AND c.lon_idx = u.i1-1 JOIN surface d ON d.time = a.time AND d.lat_idx = u.j1 AND d.lon_idx = u.i1
), gradients AS (SELECT r, c, elevation,
  CASE WHEN lag(elevation) OVER x IS NOT NULL AND lead(elevation) OVER x IS NOT NULL THEN (lead(elevation) OVER x - lag(elevation) OVER x)/60e0
    WHEN lead(elevation) OVER x IS NOT NULL THEN (lead(elevation) OVER x - elevation)/30e0 ELSE (elevation - lag(elevation) OVER x)/30e0 END AS dx,
  CASE WHEN lag(elevation) OVER y IS NOT NULL AND lead(elevation) OVER y IS NOT NULL THEN (lead(elevation) OVER y - lag(elevation) OVER y)/60e0
    WHEN lead(elevation) OVER y IS NOT NULL THEN (lead(elevation) OVER y - elevation)/30e0 ELSE (elevation - lag(elevation) OVER y)/30e0 END AS dy
  FROM dem WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)
), terrain AS (SELECT r, c, elevation, dx, dy, degrees(atan(sqrt(dx*dx+dy*dy))) AS slope,
  degrees(atan2(-dx,-dy)) - 360e0*floor(degrees(atan2(-dx,-dy))/360e0) AS aspect FROM gradients
)
"""
_INTERPOLATED = ("z_surf", "t2m", "d2m", "sp", "tp", "u10", "v10", "strd", "ssrd")
PRELUDE = PRELUDE.replace("{corner_columns}", ", ".join(f"(1e0-u.t)*(1e0-u.s)*a.{v} + (1e0-u.t)*u.s*b.{v} + u.t*(1e0-u.s)*c.{v} + u.t*u.s*d.{v} AS {v}" for v in _INTERPOLATED))


#: Values are compared after rounding; many have few decimals, and a tie isn't rounded alike after sums in another order.
OFFSET = 0.500123


def r(expression: str, n: int = 4) -> str:
    return f"floor(({expression})*1e{n}+{OFFSET}e0)/1e{n}"


def query(sql: str | None = None) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            _SQL[f.__name__] = PRELUDE + sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(name: str, n: int = 4, column: Column | None = None) -> Column:
    return (F.floor((F.col(name) if column is None else column) * 10.0**n + OFFSET) / 10.0**n).alias(name)


def _at_units(v: Views) -> DataFrame:
    return interp.interpolate(v.surface, v.units_w, _INTERPOLATED)


# --- SQL of the physics ---------------------------------------------------------
def es(t: str) -> str:
    return f"(611.2e0*exp(17.67e0*(({t})-273.15e0)/(({t})-29.65e0)))"


def clip(x: str, a: str = "0e0", b: str = "1e0") -> str:
    return f"least(greatest({x},{a}),{b})"


_B = "radians(360e0/365e0*(dayofyear(time)-81))"
_DECL = f"radians(23.45e0*sin({_B}))"
_EOT = f"((9.87e0*sin(2*{_B})-7.53e0*cos({_B})-1.5e0*sin({_B}))/60e0)"


def sin_elevation(lat: str, lon: str) -> str:
    angle = f"radians(15e0*(hour(time)+minute(time)/60e0+({lon})/15e0+{_EOT}-12e0))"
    return clip(f"sin(radians({lat}))*sin({_DECL})+cos(radians({lat}))*cos({_DECL})*cos({angle})", "-1e0")


def _steps(first: str, rh: str, u: str = "u10", v: str = "v10", height: str = "ln(10e0/0.03e0)") -> str:
    """Common steps of both modes from ``first`` (ta, p, q, se of each row of the forcing at units) to ``done``."""
    es_d = es("d2m")
    return f"""s2 AS ({first}
), s3 AS (SELECT *, q*p/(0.622e0+0.378e0*q) AS e, 1361e0*greatest(sin(radians(se)),0e0) AS toa FROM s2
), s4 AS (SELECT *, {clip(rh + "/" + es("ta"))} AS rh, {clip("CASE WHEN toa > 1e0 THEN ssrd/toa ELSE 0e0 END")} AS kt FROM s3
), s5 AS (SELECT *, CASE WHEN se <= 0 THEN ssrd ELSE ssrd*(CASE WHEN kt<=0.22e0 THEN 1e0-0.09e0*kt WHEN kt<=0.8e0 THEN 0.9511e0-0.1604e0*kt+4.388e0*kt*kt-16.638e0*kt*kt*kt+12.336e0*kt*kt*kt*kt ELSE 0.165e0 END) END AS dif,
  CASE WHEN ta >= 275.65e0 THEN 1e0 WHEN ta <= 272.65e0 THEN 0e0 ELSE (ta-272.65e0)/(275.65e0-272.65e0) END AS fr,
  CASE surface_type WHEN 'glacier' THEN 0.001e0 WHEN 'open' THEN 0.03e0 WHEN 'rock' THEN 0.01e0 ELSE 1e0 END AS z0, CASE WHEN surface_type='forest' THEN 10e0 ELSE 0e0 END AS dd FROM s4
), s6 AS (SELECT *, CASE WHEN se <= 0 THEN 0e0 ELSE ssrd-dif END AS direct,
  CASE WHEN 10e0-dd > z0 THEN sqrt({u}*{u}+{v}*{v})*ln((10e0-dd)/z0)/{height} ELSE 0e0 END AS ws,
  CASE WHEN ta > 277.15e0 THEN tp ELSE tp*fr END AS rain, CASE WHEN ta > 277.15e0 THEN 0e0 ELSE tp-tp*fr END AS snow FROM s5
), s7 AS (SELECT *, least(direct*(CASE WHEN sin(radians(se))>0.01e0 THEN greatest(sin(radians(se))*cos(radians(slope))+cos(radians(se))*sin(radians(slope))*cos(-radians(aspect)),0e0)/greatest(sin(radians(se)),0.259e0) ELSE 0e0 END),1361e0) AS swd,
  0.23e0+0.43e0*pow(greatest({es_d}/t2m,0e0),1e0/5.7e0) AS cs, 0.23e0+0.43e0*pow(greatest(e/ta,0e0),1e0/5.7e0) AS ct FROM s6
), done AS (SELECT *, svf*least(ct+greatest(strd/(5.670374419e-8*t2m*t2m*t2m*t2m)-cs,0e0),1e0)*5.670374419e-8*ta*ta*ta*ta + (1e0-svf)*5.670374419e-8*ta*ta*ta*ta AS lw FROM s7
)"""


def with_simple(body: str) -> str:
    """The simple mode step by step as ``done``, then ``body``."""
    es_d = es("d2m")
    first = f"""SELECT *, sp*exp(-9.80665e0*(elevation-z_surf)/(287.05e0*((t2m+ta)/2e0))) AS p, 0.622e0*{es_d}/(sp-0.378e0*{es_d}) AS q,
  degrees(asin({sin_elevation("lat", "lon")})) AS se FROM s1"""
    return f""", s1 AS (SELECT *, t2m - 0.0065e0*(elevation-z_surf) AS ta FROM corners
), {_steps(first, "e")} {body}"""


_WD = "degrees(atan2(-u10,-v10)) - 360e0*floor(degrees(atan2(-u10,-v10))/360e0)"
_ALL = {"temperature": ("ta", 4), "pressure": ("p", 2), "humidity_specific": ("q", 9), "humidity_relative": ("rh", 6), "wind_speed": ("ws", 4), "wind_direction": (_WD, 4), "shortwave_direct": ("swd", 3), "shortwave_diffuse": ("dif*svf", 3), "longwave": ("lw", 3), "precipitation": ("tp", 6), "rainfall": ("rain", 6), "snowfall": ("snow", 6)}
_FULL_OUT = ", ".join(f"{r(e, n)} AS {k}" for k, (e, n) in _ALL.items())


@query(with_simple(f"SELECT time, unit_id, {_FULL_OUT} FROM done"))
def downscale_simple(v: Views) -> DataFrame:
    out = downscale.downscale(v.surface, v.units_w)
    return out.select("time", "unit_id", *(_r(k, n) for k, (_, n) in _ALL.items()))


def with_full(body: str, values: tuple[str, ...] = ("t", "u", "v", "q")) -> str:
    w = {"a": "(1e0-u.t)*(1e0-u.s)", "b": "(1e0-u.t)*u.s", "c": "u.t*(1e0-u.s)", "d": "u.t*u.s"}
    mean = lambda x: " + ".join(f"{w[k]}*{k}.{x}" for k in "abcd")
    return f""", lev AS (SELECT u.unit_id, u.elevation AS zt, a.time, a.level, {mean("z")} AS z, {", ".join(f"{mean(x)} AS {x}" for x in values)}
  FROM units_w u JOIN plev a ON a.lat_idx = u.j1-1 AND a.lon_idx = u.i1-1 JOIN plev b ON b.time = a.time AND b.level = a.level AND b.lat_idx = u.j1-1 AND b.lon_idx = u.i1
  JOIN plev c ON c.time = a.time AND c.level = a.level AND c.lat_idx = u.j1 AND c.lon_idx = u.i1-1 JOIN plev d ON d.time = a.time AND d.level = a.level AND d.lat_idx = u.j1 AND d.lon_idx = u.i1
), br AS (SELECT unit_id, time, any_value(zt) AS zt, min(z) FILTER (z > zt) AS zu, max(z) FILTER (z < zt) AS zb, {", ".join(f"min_by({x}, z) FILTER (z > zt) AS {x}u, max_by({x}, z) FILTER (z < zt) AS {x}b" for x in values)} FROM lev GROUP BY 1, 2
), vert AS (SELECT unit_id, time, {", ".join(f"CASE WHEN zu IS NOT NULL AND zb IS NOT NULL THEN {x}b*((zu-zt)/(zu-zb))+{x}u*((zt-zb)/(zu-zb)) WHEN zu IS NOT NULL THEN {x}u ELSE {x}b END AS {x}" for x in values)} FROM br
) {body}"""


_FULL_STEPS = _steps(
    f"""SELECT c.*, x.t AS ta, x.u, x.v, x.q, sp*exp(-9.80665e0*(elevation-z_surf)/(287.05e0*((t2m+x.t)/2e0))) AS p, degrees(asin({sin_elevation("lat", "lon")})) AS se
  FROM (SELECT * EXCLUDE (t, s) FROM corners) c JOIN vert x USING (unit_id, time)""",
    "(q/(1e0-q)*p/(0.62197e0+q/(1e0-q)))", "u", "v", "ln(50e0/0.01e0)",
)
_FULL_ALL = _ALL | {"wind_direction": (_WD.replace("u10", "u").replace("v10", "v"), 4)}


@query(with_full(f", {_FULL_STEPS} SELECT time, unit_id, {', '.join(f'{r(e, n)} AS {k}' for k, (e, n) in _FULL_ALL.items())} FROM done"))
def downscale_full(v: Views) -> DataFrame:
    out = downscale.downscale(v.surface, v.units_w, None, downscale.Settings(mode="full"), v.plev)
    return out.select("time", "unit_id", *(_r(k, n) for k, (_, n) in _ALL.items()))


# --- interpolation ------------------------------------------------------------------
@query(f"SELECT time, unit_id, {r('t2m', 6)} AS t2m, {r('sp', 4)} AS sp, {r('tp', 8)} AS tp FROM corners")
def bilinear_interp(v: Views) -> DataFrame:
    return interp.interpolate(v.surface, v.units_w, ["t2m", "sp", "tp"]).select("time", "unit_id", _r("t2m", 6), _r("sp", 4), _r("tp", 8))


@query("SELECT u.unit_id, g.cell FROM units u JOIN grid g ON g.lat_idx = least(greatest(CAST(ceil((u.lat-42e0)/0.25e0-0.5e0) AS INT),0),4) AND g.lon_idx = least(greatest(CAST(ceil((u.lon-76e0)/0.25e0-0.5e0) AS INT),0),4)")
def nearest_cell(v: Views) -> DataFrame:
    at = v.units.withColumns({"lat_idx": interp.nearest_index(F.col("lat"), LAT0, STEP, N_LAT), "lon_idx": interp.nearest_index(F.col("lon"), LON0, STEP, N_LON)})
    return at.join(interp.small(v.grid.select("lat_idx", "lon_idx", "cell")), ["lat_idx", "lon_idx"]).select("unit_id", "cell")


def _vertical(v: Views, *values: str) -> DataFrame:
    names = [f"{x}_levels" for x in ("z", *values)]
    nested = interp.level_arrays(v.plev, ["z", *values]).withColumnsRenamed({x: f"{x}_levels" for x in ("z", *values)})
    blocks = interp.cell_blocks(nested, names, parts=interp.fan_out(v.surface, v.units_w, ["time"])).withColumnRenamed("corners", "level_corners")
    rows = interp.with_bracket(blocks.join(interp.small(v.units_w), ["j1", "i1"]), F.col("elevation"))
    return rows.select("time", "unit_id", *(interp.at_bracket(f"{x}_levels").alias(x) for x in values))


@query(with_full(f"SELECT time, unit_id, {r('t', 5)} AS t FROM vert", ("t",)))
def plev_interp_t(v: Views) -> DataFrame:
    return _vertical(v, "t").select("time", "unit_id", _r("t", 5))


@query(with_full(f"SELECT time, unit_id, {r('u', 5)} AS u, {r('v', 5)} AS v FROM vert", ("u", "v")))
def plev_interp_wind(v: Views) -> DataFrame:
    return _vertical(v, "u", "v").select("time", "unit_id", _r("u", 5), _r("v", 5))


@query(with_full(f"SELECT time, unit_id, {r('q', 9)} AS q FROM vert", ("q",)))
def plev_interp_q(v: Views) -> DataFrame:
    return _vertical(v, "q").select("time", "unit_id", _r("q", 9))


# --- physics, one kernel each ----------------------------------------------------------
@query(f"SELECT time, unit_id, {r('t2m - 0.0065e0*(elevation-z_surf)', 6)} AS temperature FROM corners")
def lapse_rate(v: Views) -> DataFrame:
    return _at_units(v).select("time", "unit_id", _r("temperature", 6, ph.simple_lapse_rate(F.col("t2m"), F.col("z_surf"), F.col("elevation"))))


@query(with_simple(f"SELECT time, unit_id, {r('p', 2)} AS pressure FROM done"))
def hypsometric_pressure(v: Views) -> DataFrame:
    return downscale.downscale(v.surface, v.units_w, ["pressure"]).select("time", "unit_id", _r("pressure", 2))


@query(with_simple(f"SELECT time, unit_id, {r('q', 9)} AS humidity_specific, {r('rh', 6)} AS humidity_relative FROM done"))
def humidity_simple(v: Views) -> DataFrame:
    return downscale.downscale(v.surface, v.units_w, ["humidity_specific", "humidity_relative"]).select("time", "unit_id", _r("humidity_specific", 9), _r("humidity_relative", 6))


#: A specific humidity that differs by row.
_Q = "(0.001e0 + 0.0001e0*cell)"


def _q() -> Column:
    return F.col("cell") * 0.0001 + 0.001


@query(f"SELECT time, cell, {r(clip(f'({_Q}/(1e0-{_Q})*sp/(0.62197e0+{_Q}/(1e0-{_Q})))/' + es('t2m')), 6)} AS rh, {r(clip(f'({_Q}/(1e0-{_Q})*sp/(0.62197e0+{_Q}/(1e0-{_Q})))/' + es('t2m') + '*100e0', '0e0', '100e0'), 4)} AS rh_percent FROM surface")
def humidity_adjust(v: Views) -> DataFrame:
    q = _q()
    _, rh = ph.adjust_humidity(q, F.col("t2m"), F.col("sp"))
    return v.surface.select("time", "cell", _r("rh", 6, rh), _r("rh_percent", 4, ph.rh_percent(q, F.col("t2m"), F.col("sp"))))


_STEP_SQL = f"w - ({es('w')} - g*(t-w) - e)/({es('w')}*(17.67e0*243.5e0)/((w-29.65e0)*(w-29.65e0)) + g)"


@query(f""", base AS (SELECT time, cell, t2m AS t, {_Q}*sp/(0.622e0+0.378e0*{_Q}) AS e, 1004e0*sp/(0.622e0*2.501e6) AS g FROM surface
), newton AS (SELECT time, cell, t, e, g, t AS w, 0 AS k FROM base UNION ALL SELECT time, cell, t, e, g, {_STEP_SQL}, k+1 FROM newton WHERE k < 20)
SELECT time, cell, {r("least(w,t)", 4)} AS wet_bulb FROM newton WHERE k = 20""")
def wet_bulb(v: Views) -> DataFrame:
    return v.surface.select("time", "cell", _r("wet_bulb", 4, ph.wet_bulb(F.col("t2m"), F.col("sp"), _q())))


@query(with_simple(f"SELECT time, unit_id, {r('rain', 6)} AS rainfall, {r('snow', 6)} AS snowfall FROM done"))
def phase_partition(v: Views) -> DataFrame:
    return downscale.downscale(v.surface, v.units_w, ["rainfall", "snowfall"]).select("time", "unit_id", _r("rainfall", 6), _r("snowfall", 6))


@query(f"SELECT time, unit_id, {r('greatest(tp*(1e0+0.0005e0*(elevation-z_surf)),0e0)', 6)} AS precipitation FROM corners")
def precip_gradient(v: Views) -> DataFrame:
    return _at_units(v).select("time", "unit_id", _r("precipitation", 6, ph.precipitation_gradient(F.col("tp"), F.col("elevation"), F.col("z_surf"), 0.0005)))


@query(with_simple(f"SELECT time, unit_id, {r('direct', 3)} AS direct, {r('dif', 3)} AS diffuse FROM done"))
def sw_partition(v: Views) -> DataFrame:
    e, _ = ph.solar_geometry(F.col("time"), F.col("lat"), F.col("lon"))
    direct, diffuse = ph.partition_shortwave(F.col("ssrd"), e, ph.clearness_index(F.col("ssrd"), e))
    return _at_units(v).select("time", "unit_id", _r("direct", 3, direct), _r("diffuse", 3, diffuse))


@query(with_simple(f"SELECT time, unit_id, {r('swd', 3)} AS shortwave_direct FROM done"))
def slope_correction(v: Views) -> DataFrame:
    return downscale.downscale(v.surface, v.units_w, ["shortwave_direct"]).select("time", "unit_id", _r("shortwave_direct", 3))


@query(with_simple(f"SELECT time, unit_id, {r('lw', 3)} AS longwave FROM done"))
def longwave(v: Views) -> DataFrame:
    return downscale.downscale(v.surface, v.units_w).select("time", "unit_id", _r("longwave", 3))


@query(f""", a AS (SELECT *, 1361e0*greatest(sin(radians(degrees(asin({sin_elevation("latitude", "longitude")})))),0e0) AS toa FROM surface
), b AS (SELECT *, CASE WHEN toa > 1e0 THEN 1e0-{clip("ssrd/toa")} END AS cf FROM a
), d AS (SELECT *, coalesce(cf, avg(cf) OVER (PARTITION BY cell, CAST(time AS DATE)), 0.5e0) AS f, 0.23e0+0.43e0*pow(greatest({es("d2m")}/t2m,0e0),1e0/5.7e0) AS ec FROM b)
SELECT time, cell, {r("(ec*(1e0-f*f)+f*f)*5.670374419e-8*t2m*t2m*t2m*t2m", 3)} AS strd FROM d""")
def longwave_synth(v: Views) -> DataFrame:
    return ingest.synthesize_longwave(v.surface.drop("strd")).select("time", "cell", _r("strd", 3))


_EHPA = "(611.2e0*exp(17.67e0*(d2m-273.15e0)/(d2m-273.15e0+243.5e0))/100e0)"


@query(f""", a AS (SELECT *, {clip("CASE WHEN ssrd*1.5e0 > 10e0 THEN ssrd/(ssrd*1.5e0) ELSE 0e0 END")} AS kt FROM surface
), b AS (SELECT *, {clip("1e0-kt/0.75e0")} AS cf FROM a)
SELECT time, cell, {r("3600e0*" + clip(f"(59.38e0+113.7e0*pow(t2m/273.16e0,6)+96.96e0*sqrt(greatest(4.65e0*({_EHPA}/t2m),0e0)/25e0))*(1e0+0.22e0*pow(cf,2.75e0))", "50e0", "600e0"), 0)} AS strd FROM b""")
def longwave_estimate(v: Views) -> DataFrame:
    return v.surface.select("time", "cell", _r("strd", 0, ph.estimate_longwave(F.col("t2m"), F.col("d2m"), F.col("ssrd"), F.col("ssrd") * 1.5)))


@query(with_simple(f"SELECT time, unit_id, {r('ws', 4)} AS wind_speed FROM done"))
def wind_log_profile(v: Views) -> DataFrame:
    return downscale.downscale(v.surface, v.units_w, ["wind_speed"]).select("time", "unit_id", _r("wind_speed", 4))


@query(with_simple(f"SELECT time, unit_id, {r('ws*(1e0+0.5e0*tanh(sx/15e0))', 4)} AS wind_speed FROM done"))
def wind_winstral(v: Views) -> DataFrame:
    return downscale.downscale(v.surface, v.units_w, ["wind_speed"], downscale.Settings(wind_method="winstral")).select("time", "unit_id", _r("wind_speed", 4))


@query(f"SELECT time, cell, {r('sqrt(u10*u10+v10*v10)', 6)} AS speed, {r(_WD, 5)} AS direction FROM surface")
def wind_speed_dir(v: Views) -> DataFrame:
    u, w = F.col("u10"), F.col("v10")
    return v.surface.select("time", "cell", _r("speed", 6, ph.wind_speed(u, w)), _r("direction", 5, ph.wind_direction(u, w)))


@query(f""", a AS (SELECT time, cell, latitude, radians(15e0*(hour(time)+minute(time)/60e0+longitude/15e0+{_EOT}-12e0)) AS ha, degrees(asin({sin_elevation("latitude", "longitude")})) AS se, {sin_elevation("latitude", "longitude")} AS sn FROM surface
), b AS (SELECT *, degrees(acos({clip(f"(sin({_DECL})-sin(radians(latitude))*sn)/(cos(radians(latitude))*cos(radians(se)))", "-1e0")})) AS az FROM a)
SELECT time, cell, {r("se", 4)} AS elevation, {r("CASE WHEN cos(radians(se)) > 0.001e0 THEN CASE WHEN ha > 0 THEN 360e0-az ELSE az END ELSE 0e0 END", 3)} AS azimuth FROM b""")
def solar_geometry(v: Views) -> DataFrame:
    e, a = ph.solar_geometry(F.col("time"), F.col("latitude"), F.col("longitude"))
    return v.surface.select("time", "cell", _r("elevation", 4, e), _r("azimuth", 3, a))


@query(f""", a AS (SELECT time, cell, ssrd, 1361e0*greatest(sin(radians(degrees(asin({sin_elevation("latitude", "longitude")})))),0e0) AS toa FROM surface)
SELECT time, cell, {r(clip("CASE WHEN toa > 1e0 THEN ssrd/toa ELSE 0e0 END"), 6)} AS kt FROM a""")
def clearness_index(v: Views) -> DataFrame:
    e, _ = ph.solar_geometry(F.col("time"), F.col("latitude"), F.col("longitude"))
    return v.surface.select("time", "cell", _r("kt", 6, ph.clearness_index(F.col("ssrd"), e)))


# --- ingest ---------------------------------------------------------------------------
@query(f""", s AS (SELECT time, lat_idx, lon_idx, count(*) AS n, sum(z) AS sz, sum(t) AS st, sum(z*t) AS szt, sum(z*z) AS szz FROM plev GROUP BY 1,2,3)
SELECT time, lat_idx, lon_idx, {r("(n*szt-sz*st)/(n*szz-sz*sz)", 7)} AS gamma FROM s""")
def lapse_fit(v: Views) -> DataFrame:
    return ingest.fit_lapse_rate(v.plev, ["time", "lat_idx", "lon_idx"]).select("time", "lat_idx", "lon_idx", _r("gamma", 7))


@query(f"SELECT time, cell, {r('ssrd/3600e0', 6)} AS ssrd, {r('strd/3600e0', 6)} AS strd, {r('tp*1000e0', 6)} AS tp, {r('z_surf/9.80665e0', 6)} AS z_surf FROM surface")
def unit_convert(v: Views) -> DataFrame:
    return ingest.convert_surface(v.surface).select("time", "cell", *(_r(x, 6) for x in ("ssrd", "strd", "tp", "z_surf")))


@query(f""", n AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM series WINDOW w AS (PARTITION BY cell ORDER BY time, tiebreak))
SELECT cell, time, tiebreak, {r("CASE WHEN abs(value-a) > 20e0 AND abs(b-value) > 20e0 AND sign(value-a) <> sign(b-value) THEN (a+b)*0.5e0 ELSE value END", 6)} AS value FROM n""")
def qc_spikes(v: Views) -> DataFrame:
    return ingest.repair_spikes(v.series, {"value": 20.0}, ["cell"], ["time", "tiebreak"]).select("cell", "time", "tiebreak", _r("value", 6))


@query(f"SELECT cell, time, tiebreak, {r('sum(value) OVER (PARTITION BY cell ORDER BY time, tiebreak ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 5)} AS total FROM series")
def rolling_accum(v: Views) -> DataFrame:
    return ingest.rolling_sum(v.series, "value", 3, ["cell"], ["time", "tiebreak"], "total").select("cell", "time", "tiebreak", _r("total", 5))


@query("SELECT cell, day, value, tiebreak FROM (SELECT cell, CAST(time AS DATE) AS day, value, tiebreak, row_number() OVER (PARTITION BY cell, CAST(time AS DATE) ORDER BY tiebreak) AS k FROM series) WHERE k = 1")
def dedup_first(v: Views) -> DataFrame:
    return ingest.dedup_first(v.series.select("cell", F.to_date("time").alias("day"), "value", "tiebreak"), ["cell", "day"], ["tiebreak"])


@query(""", kept AS (SELECT time FROM series WHERE day(time) % 3 <> 0
), d AS (SELECT CAST(unnest(range(CAST(min(CAST(time AS DATE)) AS TIMESTAMP), CAST(max(CAST(time AS DATE)) AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM kept)
SELECT day FROM d WHERE day NOT IN (SELECT CAST(time AS DATE) FROM kept)""")
def missing_days(v: Views) -> DataFrame:
    return ingest.missing_days(v.series.where(F.dayofmonth("time") % 3 != 0))


@query(""", old AS (SELECT * FROM hours WHERE time < (SELECT min(time) + INTERVAL 10 DAY FROM hours)
), new AS (SELECT time, ev + 1e0 AS ev FROM hours WHERE time >= (SELECT min(time) + INTERVAL 9 DAY FROM hours))
SELECT * FROM old UNION ALL SELECT * FROM new WHERE time > (SELECT max(time) FROM old)""")
def cache_append(v: Views) -> DataFrame:
    first = v.hours.agg(F.min("time").alias("m"))
    h = v.hours.crossJoin(F.broadcast(first))
    old = h.where(F.col("time") < F.col("m") + F.expr("interval 10 days")).drop("m")
    new = h.where(F.col("time") >= F.col("m") + F.expr("interval 9 days")).drop("m").withColumn("ev", F.col("ev") + 1.0)
    return ingest.append_newer(old, new)


@query("""SELECT cell, CAST(time AS DATE) AS day, coalesce(max(CASE WHEN tiebreak % 2 = 0 THEN value END), max(CASE WHEN tiebreak % 2 = 1 THEN value END)) AS value FROM series GROUP BY 1, 2""")
def expver_merge(v: Views) -> DataFrame:
    versions = v.series.select("cell", F.to_date("time").alias("day"), F.when(F.col("tiebreak") % 2 == 0, 1).otherwise(5).alias("expver"), "value")
    return ingest.merge_versions(versions, ["cell", "day"], "expver", ["value"])


@query(""", d AS (SELECT cell, epoch(date_trunc('second', time)) - epoch(date_trunc('second', lag(time) OVER (PARTITION BY cell ORDER BY time, tiebreak))) AS s, row_number() OVER (PARTITION BY cell ORDER BY time, tiebreak) AS n FROM series
), n AS (SELECT cell, s, count(*) AS k FROM d WHERE s IS NOT NULL AND n <= 48 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY k DESC, s) AS p FROM n)
SELECT cell, CAST(s AS BIGINT) AS step_s FROM o WHERE p = 1""")
def time_step_mode(v: Views) -> DataFrame:
    return ingest.modal_step(v.series, ["cell"], ["time", "tiebreak"])


@query(""", d AS (SELECT cell, epoch(date_trunc('second', time)) - epoch(date_trunc('second', lag(time) OVER (PARTITION BY cell ORDER BY time, tiebreak))) AS s FROM series)
SELECT cell, median(s) AS step_s FROM d WHERE s IS NOT NULL GROUP BY 1""")
def time_step_median(v: Views) -> DataFrame:
    return ingest.median_step(v.series, ["cell"], ["time", "tiebreak"])


@query(f"SELECT time, cell, {r('tp', 6)} AS a, {r('tp/3600e0*3600e0*3e0', 6)} AS b, {r('tp*3e0', 6)} AS c FROM surface")
def precip_amounts(v: Views) -> DataFrame:
    kinds = {"a": ingest.amounts(F.col("tp"), "kg m-2", 3.0), "b": ingest.amounts(F.col("tp") / 3600.0, "mm/s", 3.0), "c": ingest.amounts(F.col("tp"), "mm h-1", 3.0)}
    return v.surface.select("time", "cell", *(_r(k, 6, x) for k, x in kinds.items()))


@query(f""", w AS (SELECT * FROM surface WHERE hour(time) % 3 = 0), t AS (SELECT time FROM w GROUP BY 1 ORDER BY 1 LIMIT 8
), d AS (SELECT median(epoch(time) - epoch(b)) / 3600e0 AS h FROM (SELECT time, lag(time) OVER (ORDER BY time) AS b FROM t) WHERE b IS NOT NULL)
SELECT time, cell, {r('CASE WHEN h > 1 THEN tp*h ELSE tp END', 6)} AS tp FROM w, d""")
def precip_by_step(v: Views) -> DataFrame:
    """Hourly amounts at three-hourly stamps stand for the step."""
    coarse = v.surface.where(ingest.every_hours(F.col("time"), 3))
    first = coarse.select("time").distinct().orderBy("time").limit(8).withColumn("one", F.lit(1))
    step = ingest.median_step(first, ["one"], ["time"]).first()["step_s"]
    return ingest.scale_precipitation(coarse, step).select("time", "cell", _r("tp", 6))


@query(f"SELECT time, lat_idx, lon_idx, level, {r('t', 6)} AS t FROM plev WHERE level IN (500, 850)")
def level_intersection(v: Views) -> DataFrame:
    return ingest.kept_levels(v.plev, [500, 850, 925]).select("time", "lat_idx", "lon_idx", "level", _r("t", 6))


@query(f""", k AS (SELECT DISTINCT time, lat_idx, lon_idx FROM plev), w AS (SELECT * FROM k CROSS JOIN (VALUES (500), (850), (925)) AS l(level))
SELECT w.time, w.lat_idx, w.lon_idx, w.level, {r('p.t', 6)} AS t FROM w LEFT JOIN plev p ON p.time = w.time AND p.lat_idx = w.lat_idx AND p.lon_idx = w.lon_idx AND p.level = w.level""")
def level_reindex(v: Views) -> DataFrame:
    plev = v.plev.select("time", "lat_idx", "lon_idx", "level", "t")
    return ingest.reindex_levels(plev, [500, 850, 925], ["time", "lat_idx", "lon_idx"]).select("time", "lat_idx", "lon_idx", "level", _r("t", 6))


@query("SELECT time, cell FROM surface WHERE hour(time) % 6 = 0 AND latitude BETWEEN 42.25e0 AND 42.75e0 AND longitude BETWEEN 76.2e0 AND 76.8e0 AND time >= (SELECT min(time) FROM hours) + INTERVAL 1 DAY")
def bbox_time_slice(v: Views) -> DataFrame:
    first = v.hours.agg(F.min("time").alias("m"))
    inside = ingest.in_bbox(F.col("latitude"), F.col("longitude"), 76.2, 42.25, 76.8, 42.75) & ingest.every_hours(F.col("time"), 6)
    return v.surface.where(inside).crossJoin(F.broadcast(first)).where(F.col("time") >= F.col("m") + F.expr("interval 1 day")).select("time", "cell")


@query(""", k AS (SELECT time, lat_idx, lon_idx, level FROM plev WHERE NOT (hour(time) % 5 = 0 AND level = 300)
), s AS (SELECT time, list_sort(list_distinct(list(level))) AS ls FROM k GROUP BY 1), m AS (SELECT ls FROM s GROUP BY ls ORDER BY count(*) DESC, ls LIMIT 1)
SELECT time, lat_idx, lon_idx, level FROM k WHERE time IN (SELECT time FROM s WHERE ls = (SELECT ls FROM m))""")
def modal_level_set(v: Views) -> DataFrame:
    kept = v.plev.where(~((F.hour("time") % 5 == 0) & (F.col("level") == 300))).select("time", "lat_idx", "lon_idx", "level")
    return ingest.modal_level_set(kept, "time")


# --- terrain -----------------------------------------------------------------------------
RES = 30.0


@query(f"SELECT r, c, {r('slope', 5)} AS slope, {r('aspect', 4)} AS aspect FROM terrain")
def slope_aspect(v: Views) -> DataFrame:
    return terrain.slope_aspect(v.dem, RES).select("r", "c", _r("slope", 5), _r("aspect", 4))


def _march_sql(n: int, steps: int, north: int, angle: str) -> str:
    inside = "tr < ny-1 AND tc < nx-1" if north < 0 else "tr <= ny-1 AND tc <= nx-1"
    return f""", dirs AS (SELECT d, {north}e0*cos(2e0*pi()*d/{n}e0) AS dr, sin(2e0*pi()*d/{n}e0) AS dc FROM range({n}) t(d)
), pts AS (SELECT p.r, p.c, p.elevation, d.d, k*30e0 AS dist, p.r+d.dr*k AS tr, p.c+d.dc*k AS tc FROM dem p CROSS JOIN dirs d CROSS JOIN range(1, {steps + 1}) s(k)
), ins AS (SELECT *, CAST(floor(tr) AS INT) AS r0, CAST(floor(tc) AS INT) AS c0 FROM pts, (SELECT max(r)+1 AS ny, max(c)+1 AS nx FROM dem) WHERE tr >= 0 AND tc >= 0 AND {inside}
), quad AS (SELECT a.r, a.c, a.elevation AS a, coalesce(b.elevation, a.elevation) AS b, coalesce(c.elevation, a.elevation) AS cc, coalesce(d.elevation, CASE WHEN b.elevation IS NULL THEN coalesce(c.elevation, a.elevation) ELSE coalesce(b.elevation, a.elevation) END) AS dd
  FROM dem a LEFT JOIN dem b ON b.r=a.r AND b.c=a.c+1 LEFT JOIN dem c ON c.r=a.r+1 AND c.c=a.c LEFT JOIN dem d ON d.r=a.r+1 AND d.c=a.c+1
), z AS (SELECT i.*, q.a*(1-(tr-r0))*(1-(tc-c0)) + q.b*(1-(tr-r0))*(tc-c0) + q.cc*(tr-r0)*(1-(tc-c0)) + q.dd*(tr-r0)*(tc-c0) AS z FROM ins i JOIN quad q ON q.r=i.r0 AND q.c=i.c0
), best AS (SELECT r, c, d, max({angle}) AS h FROM z GROUP BY 1,2,3
), every AS (SELECT r, c, d FROM dem CROSS JOIN dirs)"""


@query(_march_sql(8, 100, -1, "degrees(atan2(z-elevation,dist))") + f"SELECT e.r, e.c, CAST(e.d AS INT) AS direction, {r('greatest(coalesce(h,0e0),0e0)', 4)} AS horizon FROM every e LEFT JOIN best USING (r, c, d)")
def horizon(v: Views) -> DataFrame:
    return terrain.horizon(v.dem, 8, 3000.0, RES).select("r", "c", "direction", _r("horizon", 4))


@query(_march_sql(8, 100, -1, "degrees(atan2(z-elevation,dist))") + f"SELECT e.r, e.c, {r('avg(cos(radians(greatest(coalesce(h,0e0),0e0)))*cos(radians(greatest(coalesce(h,0e0),0e0))))', 6)} AS svf FROM every e LEFT JOIN best USING (r, c, d) GROUP BY 1, 2")
def svf(v: Views) -> DataFrame:
    return terrain.sky_view_factor(terrain.horizon(v.dem, 8, 3000.0, RES)).select("r", "c", _r("svf", 6))


@query(_march_sql(36, 10, 1, "degrees(atan2(elevation-z,dist))") + f"SELECT e.r, e.c, CAST(e.d AS INT) AS direction, {r('coalesce(h,0e0)', 4)} AS sx FROM every e LEFT JOIN best USING (r, c, d)")
def winstral_sx(v: Views) -> DataFrame:
    return terrain.winstral_sx(v.dem, 36, 300.0, RES).select("r", "c", "direction", _r("sx", 4))


@query(f"SELECT r, c, {r(clip('cos(radians(45e0))*cos(atan(sqrt(dx*dx+dy*dy)))+sin(radians(45e0))*sin(atan(sqrt(dx*dx+dy*dy)))*cos(radians(315e0)-atan2(-dy,dx))'), 6)} AS shade FROM gradients")
def hillshade(v: Views) -> DataFrame:
    return terrain.hillshade(v.dem, RES).select("r", "c", _r("shade", 6))


_D8 = ", ".join(f"({k},{a},{b},{'30e0' if a == 0 or b == 0 else '30e0*sqrt(2e0)'})" for k, (a, b) in enumerate(terrain.D8))


_FLOW = f"""n AS (SELECT a.r, a.c, b.r AS to_r, b.c AS to_c, row_number() OVER (PARTITION BY a.r, a.c ORDER BY floor((a.elevation-b.elevation)/d.dist*1e9) DESC, d.k) AS p
  FROM dem a CROSS JOIN (VALUES {_D8}) AS d(k,dr,dc,dist) JOIN dem b ON b.r = a.r+d.dr AND b.c = a.c+d.dc WHERE a.elevation > b.elevation
), flow AS (SELECT e.r, e.c, n.to_r, n.to_c FROM dem e LEFT JOIN n ON n.r = e.r AND n.c = e.c AND n.p = 1)"""


@query(f", {_FLOW} SELECT r, c, to_r, to_c FROM flow")
def flow_direction(v: Views) -> DataFrame:
    return terrain.flow_direction(v.dem, RES)


@query(f""", {_FLOW}, path AS (SELECT r AS sr, c AS sc, r, c, to_r, to_c FROM flow UNION ALL SELECT p.sr, p.sc, f.r, f.c, f.to_r, f.to_c FROM path p JOIN flow f ON f.r = p.to_r AND f.c = p.to_c
), through AS (SELECT r, c, count(*) AS cells FROM path GROUP BY 1, 2)
SELECT p.sr AS r, p.sc AS c, p.r AS basin_r, p.c AS basin_c, t.cells FROM path p JOIN through t ON t.r = p.sr AND t.c = p.sc WHERE p.to_r IS NULL""")
def flow_accumulation(v: Views) -> DataFrame:
    return terrain.flow_accumulation(terrain.flow_direction(v.dem, RES))


# --- units --------------------------------------------------------------------------------
def _pixels(v: Views) -> DataFrame:
    t = terrain.slope_aspect(v.dem, RES)
    return t.select("r", "c", "elevation", _r("slope", 4).alias("slope"), _r("aspect", 3).alias("aspect"), (1.0 - _r("slope", 4) / 180.0).alias("svf"))


_HRU = f""", px AS (SELECT r, c, elevation, {r("slope", 4)} AS slope, {r("aspect", 3)} AS aspect, 1e0-{r("slope", 4)}/180e0 AS svf FROM terrain
), cls AS (SELECT *, CAST(floor((elevation-floor((SELECT min(elevation) FROM dem)/200e0)*200e0)/200e0) AS INT) AS band,
  CAST(floor(((aspect+45e0) - 360e0*floor((aspect+45e0)/360e0))/90e0) AS INT) AS aspect_class FROM px
), lab AS (SELECT *, CAST(dense_rank() OVER (ORDER BY band, aspect_class) - 1 AS INT) AS unit_idx FROM cls)"""


@query(_HRU + "SELECT r, c, band, aspect_class, unit_idx FROM lab")
def hru_labels(v: Views) -> DataFrame:
    return units.hru_labels(_pixels(v), 200.0, 4).select("r", "c", "band", "aspect_class", "unit_idx")


@query(_HRU + f"""SELECT unit_idx, {r("avg(r)", 6)} AS y, {r("avg(c)", 6)} AS x, {r("avg(elevation)", 4)} AS elevation, {r("avg(slope)", 5)} AS slope,
  {r("degrees(atan2(avg(sin(radians(aspect))),avg(cos(radians(aspect))))) - 360e0*floor(degrees(atan2(avg(sin(radians(aspect))),avg(cos(radians(aspect)))))/360e0)", 4)} AS aspect,
  {r("avg(svf)", 6)} AS svf, count(*) AS pixels, count(*)*900e0 AS area_m2 FROM lab GROUP BY 1""")
def zonal_stats(v: Views) -> DataFrame:
    z = units.zonal_stats(units.hru_labels(_pixels(v), 200.0, 4), "unit_idx", RES * RES)
    return z.select("unit_idx", _r("y", 6), _r("x", 6), _r("elevation", 4), _r("slope", 5), _r("aspect", 4), _r("svf", 6), "pixels", "area_m2")


@query(_HRU + """, e AS (SELECT a.unit_idx AS a, b.unit_idx AS b FROM lab a JOIN lab b ON (b.r=a.r AND b.c=a.c+1) OR (b.r=a.r+1 AND b.c=a.c) WHERE a.unit_idx <> b.unit_idx)
SELECT a, b FROM e UNION SELECT b, a FROM e""")
def adjacency(v: Views) -> DataFrame:
    return units.adjacency(units.hru_labels(_pixels(v), 200.0, 4), "unit_idx")


@query(f""", p AS (SELECT m.unit_idx, CAST(floor(m.r/7e0) AS INT) AS catchment FROM membership m)
SELECT catchment, unit_idx, {r("count(*)*1e0/any_value(n)", 9)} AS weight FROM p JOIN (SELECT catchment, count(*) AS n FROM p GROUP BY 1) USING (catchment) WHERE unit_idx >= 0 GROUP BY 1, 2""")
def cluster_weights(v: Views) -> DataFrame:
    px = v.membership.withColumn("catchment", F.floor(F.col("r") / 7).cast("int"))
    return units.overlap_weights(px, "unit_idx", "catchment").select("catchment", "unit_idx", _r("weight", 9))


_FEATURES = ("elevation", "slope", "cos_aspect", "sin_aspect", "svf")
_STD = ", ".join(f"{r(f'({f}-avg({f}) OVER ())/CASE WHEN stddev_pop({f}) OVER () > 0 THEN stddev_pop({f}) OVER () ELSE 1e0 END', 5)} AS {f}" for f in _FEATURES)


@query(_HRU + f", ft AS (SELECT *, cos(radians(aspect)) AS cos_aspect, sin(radians(aspect)) AS sin_aspect FROM px) SELECT r, c, {_STD} FROM ft")
def cluster_features(v: Views) -> DataFrame:
    return units.standardise(units.terrain_features(_pixels(v)), _FEATURES).select("r", "c", *(_r(f, 5) for f in _FEATURES))


@query(_HRU + f"SELECT r, c, {r('sin(radians(slope))*cos(radians(aspect))', 7)} AS sx, {r('sin(radians(slope))*sin(radians(aspect))', 7)} AS sy, {r('sin(radians(slope))*cos(radians(aspect))', 7)} AS northness FROM px")
def terrain_parts(v: Views) -> DataFrame:
    return units.terrain_features(_pixels(v)).select("r", "c", _r("sx", 7), _r("sy", 7), _r("northness", 7))


@query()
def kmeans_units(v: Views) -> DataFrame:
    return units.kmeans(units.standardise(units.terrain_features(_pixels(v)), _FEATURES), _FEATURES, 8).select("r", "c", "cluster")


@query(f""", p AS (SELECT elevation, c*1e0 AS x, unit_idx AS k FROM dem JOIN membership USING (r, c) WHERE unit_idx >= 0
), m AS (SELECT k, count(*) AS n, avg(elevation) AS ce, avg(x) AS cx FROM p GROUP BY 1
), w AS (SELECT k, sum((p.elevation-ce)*(p.elevation-ce)+(p.x-cx)*(p.x-cx)) AS w, avg(sqrt((p.elevation-ce)*(p.elevation-ce)+(p.x-cx)*(p.x-cx))) AS s FROM p JOIN m USING (k) GROUP BY 1
), g AS (SELECT avg(elevation) AS ge, avg(x) AS gx FROM p
), t AS (SELECT sum(n) AS n, count(*) AS k, sum(w) AS w, sum(n*((ce-ge)*(ce-ge)+(cx-gx)*(cx-gx))) AS b FROM m JOIN w USING (k) CROSS JOIN g
), d AS (SELECT a.k, max((wa.s+wb.s)/sqrt((a.ce-b.ce)*(a.ce-b.ce)+(a.cx-b.cx)*(a.cx-b.cx))) AS q FROM m a JOIN w wa ON wa.k=a.k JOIN m b ON b.k<>a.k JOIN w wb ON wb.k=b.k GROUP BY 1)
SELECT CAST(n AS BIGINT) AS n, k, {r("w", 1)} AS inertia, {r("(b/(k-1))/(w/(n-k))", 5)} AS calinski_harabasz, {r("(SELECT avg(q) FROM d)", 5)} AS davies_bouldin FROM t""")
def cluster_metrics(v: Views) -> DataFrame:
    px = v.dem.join(v.membership, ["r", "c"]).where("unit_idx >= 0").withColumn("x", F.col("c") * 1.0)
    return units.cluster_metrics(px, ["elevation", "x"], "unit_idx").select("n", "k", _r("inertia", 1), _r("calinski_harabasz", 5), _r("davies_bouldin", 5))


RINGS = {1: ((76.1, 42.1), (76.5, 42.1), (76.5, 42.6), (76.1, 42.5)), 2: ((76.4, 42.4), (76.9, 42.45), (76.7, 42.9))}


def _crossing(ring) -> str:
    return "+".join(f"CAST((({y1}e0 > lat) <> ({y2}e0 > lat)) AND lon < (lat-{y1}e0)*({x2 - x1!r}e0/{y2 - y1!r}e0)+{x1}e0 AS INT)" for (x1, y1), (x2, y2) in zip(ring, (*ring[1:], ring[0]), strict=True) if y1 != y2)


@query(" UNION ALL ".join(f"SELECT unit_id, {k} AS polygon_id FROM units WHERE ({_crossing(ring)}) % 2 = 1" for k, ring in RINGS.items()))
def polygon_mask(v: Views) -> DataFrame:
    rows = [(k, [{"x": x, "y": y} for x, y in ring]) for k, ring in RINGS.items()]
    polygons = v.spark.createDataFrame(rows, "polygon_id int, ring array<struct<x:double,y:double>>")
    return units.points_in_polygons(v.units.select("unit_id", F.col("lon").alias("x"), F.col("lat").alias("y")), polygons, 0.25).select("unit_id", "polygon_id")


@query("""SELECT u.unit_id, d.r, d.c, d.elevation FROM (SELECT unit_id, least(greatest(CAST(floor((lat-42e0)/0.02e0+0.5e0) AS INT), 0), (SELECT max(r) FROM dem)) AS r,
  least(greatest(CAST(floor((lon-76e0)/0.02e0+0.5e0) AS INT), 0), 49) AS c FROM units) u LEFT JOIN dem d USING (r, c)""")
def nearest_pixel(v: Views) -> DataFrame:
    points = v.units.select("unit_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    n_rows = v.dem.agg(F.max("r")).first()[0] + 1
    got = units.nearest_pixel(points, v.dem, 76.0, 42.0, 0.02, n_rows, 50)
    return got.select("unit_id", F.when(F.col("elevation").isNotNull(), F.col("r")).alias("r"), F.when(F.col("elevation").isNotNull(), F.col("c")).alias("c"), "elevation")


@query("SELECT unit_id, surface_type FROM units WHERE surface_type IN ('open', 'rock')")
def surface_filter(v: Views) -> DataFrame:
    return units.of_types(v.units, ["open", "rock"]).select("unit_id", "surface_type")


@query(_HRU + "SELECT unit_idx, count(*)*900e0 AS area_m2 FROM lab GROUP BY 1 HAVING count(*)*900e0 >= 45000e0")
def min_area(v: Views) -> DataFrame:
    z = units.zonal_stats(units.hru_labels(_pixels(v), 200.0, 4), "unit_idx", RES * RES)
    return units.at_least(z, 45_000.0).select("unit_idx", "area_m2")


@query("SELECT m.r, m.c, CASE WHEN m.unit_idx >= 0 THEN d.elevation END AS elevation FROM membership m JOIN dem d USING (r, c)")
def domain_mask(v: Views) -> DataFrame:
    return units.masked(v.dem, v.membership.where("unit_idx >= 0"), ["elevation"]).select("r", "c", "elevation")


@query(f"""SELECT k AS unit_idx, {r("avg(elevation)", 4)} AS elevation, count(elevation) AS pixels FROM range(12) t(k) LEFT JOIN (SELECT unit_idx, elevation FROM membership JOIN dem USING (r, c)) m ON m.unit_idx = k GROUP BY 1""")
def unit_elevation(v: Views) -> DataFrame:
    return units.unit_elevation(v.dem, v.membership, 12).select(F.col("unit_idx").cast("long").alias("unit_idx"), _r("elevation", 4), "pixels")


@query("""SELECT unit_id, CASE WHEN slope > 40e0 THEN 1 ELSE CASE unit_id % 5 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END END AS code FROM units""")
def surface_reclass(v: Views) -> DataFrame:
    code = units.reclassify(F.col("unit_id") % 5, {1: 2, 2: 3})
    return v.units.select("unit_id", units.overlay_glacier(code, F.col("slope") > 40).alias("code"))


# --- graphs ----------------------------------------------------------------------------------
@query("""SELECT id, upstream FROM (WITH RECURSIVE u AS (SELECT downstream_id AS id, id AS upstream FROM catchments WHERE downstream_id <> id
  UNION SELECT c.downstream_id, u.upstream FROM u JOIN catchments c ON c.id = u.id WHERE c.downstream_id <> c.id) SELECT * FROM u)""")
def upstream_closure(v: Views) -> DataFrame:
    return graph.upstream_closure(v.catchments)


@query(""", e AS (SELECT a.unit_id AS a, b.unit_id AS b FROM units a JOIN units b ON a.unit_id <> b.unit_id WHERE sqrt((a.lon-b.lon)*(a.lon-b.lon)+(a.lat-b.lat)*(a.lat-b.lat)) <= 0.06e0
), reach AS (SELECT unit_id AS a, unit_id AS b FROM units UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT a AS node, min(b) AS component FROM reach GROUP BY 1""")
def point_groups(v: Views) -> DataFrame:
    return graph.point_groups(v.units.select(F.col("unit_id").alias("node"), F.col("lon").alias("x"), F.col("lat").alias("y")), 0.06)


@query(_HRU + """, n AS (SELECT r, c, unit_idx, CAST(r AS BIGINT)*2147483648+c AS node FROM lab
), e AS (SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON a.unit_idx=b.unit_idx AND ((b.r=a.r AND abs(b.c-a.c)=1) OR (b.c=a.c AND abs(b.r-a.r)=1))
), reach AS (SELECT node AS a, node AS b FROM n UNION SELECT x.a, e.b FROM reach x JOIN e ON x.b = e.a)
SELECT n.r, n.c, n.unit_idx, m.part FROM n JOIN (SELECT a, min(b) AS part FROM reach GROUP BY 1) m ON m.a = n.node""")
def label_parts(v: Views) -> DataFrame:
    return graph.label_components(units.hru_labels(_pixels(v), 200.0, 4), "unit_idx")


# --- snow ------------------------------------------------------------------------------------
@query(f""", er AS (SELECT *, least(0.001e0*greatest(sx,0e0)*wind*swe, swe) AS erosion FROM cells
), sh AS (SELECT e.i, e.j, a.erosion*a.area AS mass, e.weight, e.weight*greatest(-b.sx,0e0) AS w, b.area AS area_j FROM edges e JOIN er a ON a.i=e.i JOIN cells b ON b.i=e.j WHERE a.erosion > 0
), dep AS (SELECT j, sum(mass*(CASE WHEN t > 0 THEN w/t ELSE weight END)/area_j) AS d FROM (SELECT *, sum(w) OVER (PARTITION BY i) AS t FROM sh) GROUP BY 1)
SELECT er.i, {r("swe-erosion+coalesce(d,0e0)", 6)} AS swe FROM er LEFT JOIN dep ON dep.j = er.i""")
def wind_transport(v: Views) -> DataFrame:
    return redistribute.wind_transport(v.cells, v.edges).select("i", _r("swe", 6))


@query(f""", cc AS (SELECT i, swe, slope, area, row_number() OVER (ORDER BY i) AS p FROM cells
), ee AS (SELECT a.p AS p, b.p AS q, e.slot, e.weight*a.area/b.area AS w FROM edges e JOIN cc a ON a.i = e.i JOIN cc b ON b.i = e.j WHERE e.weight > 0
), tl AS (SELECT cc.p, list({{'q': q, 'w': w}} ORDER BY slot) FILTER (q IS NOT NULL) AS t FROM cc LEFT JOIN ee ON ee.p = cc.p GROUP BY 1
), start AS (SELECT list(swe ORDER BY p) AS s, list(CASE WHEN slope > 30e0 THEN least(1e0, (slope-30e0)/30e0) ELSE 0e0 END ORDER BY p) AS f, list(coalesce(t, []) ORDER BY p) AS t FROM cc JOIN tl USING (p)
), run AS (SELECT 0 AS k, s FROM start UNION ALL SELECT k+1, CASE WHEN m > 0 AND len(g) > 0 THEN
    list_transform(s, lambda x, p: x - (CASE WHEN p = k+1 THEN m ELSE 0e0 END) + coalesce(list_sum(list_transform(list_filter(g, lambda z: z.q = p), lambda z: z.w*m)), 0e0)) ELSE s END
  FROM (SELECT run.k, run.s, run.s[run.k+1]*start.f[run.k+1] AS m, start.t[run.k+1] AS g FROM run, start WHERE run.k < len(run.s)))
SELECT cc.i, {r("run.s[cc.p]", 6)} AS swe FROM cc, run WHERE run.k = len(run.s)""")
def avalanche(v: Views) -> DataFrame:
    """Whole domains: cells that edges connect."""
    nodes, edges = v.cells.select(F.col("i").alias("node")), v.edges.select(F.col("i").alias("a"), F.col("j").alias("b"))
    domain = graph.components(nodes, edges.join(nodes, F.col("b") == F.col("node"), "left_semi")).select(F.col("node").alias("i"), F.col("component").alias("domain"))
    cells = v.cells.join(domain, "i")
    flows = v.edges.withColumnRenamed("weight", "flow").join(domain, "i")
    return redistribute.avalanche(cells, flows, "domain").select("i", _r("swe", 6))


@query(f"SELECT {r('sum(least(0.001e0*greatest(sx,0e0)*wind*swe, swe)*area)', 2)} AS mass FROM cells")
def eroded_mass(v: Views) -> DataFrame:
    return redistribute.eroded_mass(v.cells).select(_r("mass", 2))


@query(f"SELECT i, {r('least(0.01e0*greatest(wind-5e0,0e0)*greatest(sx,0e0)/15e0,0.1e0)', 8)} AS rate FROM cells")
def transport_rate(v: Views) -> DataFrame:
    return v.cells.select("i", _r("rate", 8, ph.transport_rate(F.col("wind"), F.col("sx"))))


# --- aggregates and exports -------------------------------------------------------------------
@query(with_simple(f"SELECT unit_id, CAST(time AS DATE) AS day, {r('avg(ta)', 4)} AS temperature, {r('sum(tp)', 4)} AS precipitation FROM done GROUP BY 1, 2"))
def daily_summary(v: Views) -> DataFrame:
    out = aggregate.daily(downscale.downscale(v.surface, v.units_w, ["temperature", "precipitation"]))
    return out.select("unit_id", "day", _r("temperature", 4), _r("precipitation", 4))


_DELTA = "(0.409e0*sin(2e0*pi()*dayofyear(day)/365e0-1.39e0))"


@query(with_simple(f""", dd AS (SELECT unit_id, any_value(lat) AS lat, CAST(time AS DATE) AS day, avg(ta)-273.15e0 AS t, sum(tp) AS pr FROM done GROUP BY unit_id, CAST(time AS DATE))
SELECT unit_id, day, {r("t", 4)} AS temperature, {r("pr", 4)} AS precipitation,
  {r(f"CASE WHEN t > 0 THEN 0.165e0*216.7e0*(24e0/pi()*acos(-tan(radians(lat))*tan({_DELTA}))/12e0)*(0.6108e0*exp(17.27e0*t/(t+237.3e0)))/(t+273.3e0) ELSE 0e0 END", 5)} AS pet FROM dd""".lstrip()))
def hamon_pet(v: Views) -> DataFrame:
    out = aggregate.hbv_daily(downscale.downscale(v.surface, v.units_w, ["temperature", "precipitation"]), v.units)
    return out.select("unit_id", "day", _r("temperature", 4), _r("precipitation", 4), _r("pet", 5))


@query(with_simple(f""", dd AS (SELECT unit_id, any_value(lat) AS lat, CAST(time AS DATE) AS day, avg(ta)-273.15e0 AS t, sum(tp) AS pr FROM done GROUP BY unit_id, CAST(time AS DATE)
), h AS (SELECT unit_id, day, {r("t", 2)} AS t, {r("pr", 3)} AS pr, {r(f"CASE WHEN t > 0 THEN 0.165e0*216.7e0*(24e0/pi()*acos(-tan(radians(lat))*tan({_DELTA}))/12e0)*(0.6108e0*exp(17.27e0*t/(t+237.3e0)))/(t+273.3e0) ELSE 0e0 END", 3)} AS pet FROM dd)
SELECT unit_id, day, printf('%s %.2f %.3f %.3f', strftime(day, '%Y%m%d'), t, pr, pet) AS line FROM h""".lstrip()))
def export_hbv(v: Views) -> DataFrame:
    out = aggregate.hbv_daily(downscale.downscale(v.surface, v.units_w, ["temperature", "precipitation"]), v.units)
    return aggregate.hbv_text(out.select("unit_id", "day", _r("temperature", 2), _r("precipitation", 3), _r("pet", 3)))


@query("""SELECT time, CAST(year(time) + CASE WHEN month(time) >= 9 THEN 1 ELSE 0 END AS INT) AS wy,
  CAST(least(date_diff('day', make_date(year(time) + CASE WHEN month(time) >= 9 THEN 0 ELSE -1 END, 9, 1), CAST(time AS DATE)), 365) AS INT) AS dowy FROM hours""")
def water_year(v: Views) -> DataFrame:
    return v.hours.select("time", ph.water_year(F.col("time")).cast("int").alias("wy"), ph.day_of_water_year(F.col("time")).cast("int").alias("dowy"))


@query(f""", f AS (SELECT time, cell AS unit_idx, t2m FROM surface)
SELECT f.time, m.r, m.c, {r("f.t2m", 6)} AS t2m FROM membership m JOIN f USING (unit_idx) UNION ALL SELECT t.time, m.r, m.c, NULL FROM membership m CROSS JOIN (SELECT DISTINCT time FROM f) t WHERE m.unit_idx < 0""")
def to_raster(v: Views) -> DataFrame:
    forcing = v.surface.select("time", F.col("cell").alias("unit_idx"), "t2m")
    return aggregate.to_raster(forcing, v.membership, ["t2m"]).select("time", "r", "c", _r("t2m", 6))


@query(with_simple(f"SELECT time, unit_id, CAST({clip('round_even(ta*100e0, 0)', '-32767e0', '32767e0')} AS SMALLINT) AS temperature FROM (SELECT time, unit_id, {r('ta', 3)} AS ta FROM done)"))
def page_pack(v: Views) -> DataFrame:
    out = downscale.downscale(v.surface, v.units_w, ["temperature"]).withColumn("temperature", _r("temperature", 3))
    return aggregate.packed(out, {"temperature": 100.0})


_OUT = ["temperature", "pressure", "humidity_specific", "humidity_relative", "wind_speed", "shortwave_direct", "shortwave_diffuse", "longwave", "precipitation", "rainfall", "snowfall"]


def _forcing(v: Views) -> DataFrame:
    return store.with_metadata(downscale.downscale(v.surface, v.units_w, _OUT))


def _rounded(df: DataFrame, digits: dict[str, int], *keys: str) -> DataFrame:
    return df.select(*keys, *(_r(x, n) for x, n in digits.items()))


_STEP_S = "(SELECT epoch(max(time)) - epoch(min(time)) FROM (SELECT time FROM hours ORDER BY time LIMIT 2))"
_FSM = {"SW": ("swd+dif*svf", 3), "LW": ("lw", 3), "Sf": (f"snow/{_STEP_S}", 9), "Rf": (f"rain/{_STEP_S}", 9), "Ta": ("ta", 3), "RH": ("rh*100e0", 4), "Ua": ("ws", 3), "Ps": ("p", 2)}
_FSM_SQL = ", ".join(f'{r(e, n)} AS "{k}"' for k, (e, n) in _FSM.items())


def _fsm_inputs(v: Views) -> DataFrame:
    return _rounded(aggregate.fsm_inputs(_forcing(v), aggregate.time_step(v.hours)), {k: n for k, (_, n) in _FSM.items()}, "unit_id", "time")


@query(with_simple(f"SELECT time, unit_id, {_FSM_SQL} FROM done"))
def export_fsm2(v: Views) -> DataFrame:
    return _fsm_inputs(v)


@query(with_simple(f""", fsm AS (SELECT time, unit_id, {_FSM_SQL} FROM done)
SELECT unit_id, time, printf('%4d %2d %2d %2d %10.4f %10.4f %12.6e %12.6e %8.3f %6.4f %8.3f %10.2f', year(time), month(time), day(time), hour(time), "SW", "LW", "Sf", "Rf", "Ta", "RH", "Ua", "Ps") AS line FROM fsm""".lstrip()))
def export_fsm(v: Views) -> DataFrame:
    return aggregate.fsm_text(_fsm_inputs(v))


_SMET = {"TA": ("ta", 2), "RH": ("rh*100e0", 2), "VW": ("ws", 2), "ISWR": ("swd+dif*svf", 2), "ILWR": ("lw", 2), "PSUM": ("tp", 4), "PSUM_PH": ("CASE WHEN rain+snow > 0 THEN rain/(rain+snow) ELSE 0.5e0 END", 4)}


@query(with_simple(f""", smet AS (SELECT time, unit_id, {', '.join(f'{r(e, n)} AS "{k}"' for k, (e, n) in _SMET.items())} FROM done)
SELECT unit_id, time, printf('%s %.2f %.2f %.2f %.2f %.2f %.4f %.4f', strftime(time, '%Y-%m-%dT%H:%M:%S'), "TA", "RH", "VW", "ISWR", "ILWR", "PSUM", "PSUM_PH") AS line FROM smet""".lstrip()))
def export_smet(v: Views) -> DataFrame:
    return aggregate.smet_text(_rounded(aggregate.smet_columns(_forcing(v)), {k: n for k, (_, n) in _SMET.items()}, "unit_id", "time"))


_CREATED = "2024-01-01T00:00:00"


@query(f""", u AS (SELECT unit_id, lat, lon, {r("elevation", 1)} AS z FROM units
), h AS (SELECT unit_id, ['SMET 1.1 ASCII', '[HEADER]', 'station_id       = ' || unit_id, 'station_name     = unit_' || unit_id, printf('latitude         = %.6f', lat), printf('longitude        = %.6f', lon),
  printf('altitude         = %.1f', z), 'nodata           = -999.0', 'tz               = 0', 'source           = tarnspark', 'creation_date    = {_CREATED}', 'fields           = timestamp TA RH VW ISWR ILWR PSUM PSUM_PH', '[DATA]'] AS l FROM u)
SELECT unit_id, CAST(k AS INT) AS number, l[k+1] AS line FROM h CROSS JOIN range(13) t(k)""")
def smet_header(v: Views) -> DataFrame:
    return aggregate.smet_header(v.units.withColumn("elevation", _r("elevation", 1)), _CREATED)


@query(with_simple(f"""SELECT unit_id, time, {r("ta", 4)} AS "Tair", {r("q", 9)} AS "Qair", {r("ws", 4)} AS "Wind", {r("swd", 3)} AS "DIR_SWdown", {r("dif*svf", 3)} AS "SCA_SWdown",
  {r("lw", 3)} AS "LWdown", {r(f"rain/{_STEP_S}", 9)} AS "Rainf", {r(f"snow/{_STEP_S}", 9)} AS "Snowf", {r("p", 2)} AS "PSurf", CAST(NULL AS DOUBLE) AS "Wind_DIR", {r("420e0*44.01e0/(28.97e0*1e6)", 12)} AS "CO2air" FROM done"""))
def export_crocus(v: Views) -> DataFrame:
    f = aggregate.crocus_columns(_forcing(v), aggregate.time_step(v.hours), wind_direction=True)
    return _rounded(f, {"Tair": 4, "Qair": 9, "Wind": 4, "DIR_SWdown": 3, "SCA_SWdown": 3, "LWdown": 3, "Rainf": 9, "Snowf": 9, "PSurf": 2, "CO2air": 12}, "unit_id", "time", "Wind_DIR")


@query(with_simple(f"""SELECT unit_id, time, {r("ta", 4)} AS "Tair", {r("q", 9)} AS q, {r("ws", 4)} AS wind, {r("swd+dif*svf", 3)} AS "Sin", {r("lw", 3)} AS "Lin", {r("p", 2)} AS p,
  {r(f"rain/{_STEP_S}/1000e0", 12)} AS rainfall, {r(f"snow/{_STEP_S}/1000e0", 12)} AS snowfall FROM done"""))
def export_cryogrid(v: Views) -> DataFrame:
    return _rounded(aggregate.cryogrid_columns(_forcing(v), aggregate.time_step(v.hours)), {"Tair": 4, "q": 9, "wind": 4, "Sin": 3, "Lin": 3, "p": 2, "rainfall": 12, "snowfall": 12}, "unit_id", "time")


@query(with_simple(f"""SELECT 0 AS number, CAST(NULL AS TIMESTAMP) AS time, 'time' || coalesce(string_agg(',u' || unit_id, '' ORDER BY unit_id), '') AS line FROM (SELECT DISTINCT unit_id FROM units WHERE unit_id IS NOT NULL)
UNION ALL SELECT 1, time, strftime(time, '%Y-%m-%d %H:%M:%S') || string_agg(',' || x, '' ORDER BY unit_id) FROM (
  SELECT time, unit_id, min(CASE WHEN ta IS NULL OR isnan(ta) THEN 'NaN' ELSE printf('%.4f', {r("ta", 4)}) END) AS x FROM done WHERE unit_id IS NOT NULL GROUP BY time, unit_id) GROUP BY time"""))
def export_csv_wide(v: Views) -> DataFrame:
    """All units as columns of a CSV file, by line."""
    number = ~F.isnan("temperature")  # the floor of what is none is 0
    out = downscale.downscale(v.surface, v.units_w, ["temperature"]).withColumn("temperature", F.when(number, _r("temperature", 4)))
    return aggregate.wide_lines(out, "temperature", v.units)


_BOUND_SQL = {k: tuple(f"{x:.17e}" for x in (a, b)) for k, (a, b) in (checks.BOUNDS | checks.FSM_BOUNDS).items()} | {k: ("-1e-6", f"300e0*greatest({_STEP_S}/3600e0, 1e0)") for k in checks.AMOUNTS}


def checked(values: dict[str, str], table: str) -> str:
    """SQL of the range checks of columns by name."""
    rows = " UNION ALL ".join(f"SELECT '{k}' AS variable, min({e}) AS a, max({e}) AS b, count({e}) AS n, {_BOUND_SQL[k][0]} AS lo, {_BOUND_SQL[k][1]} AS hi FROM {table}" for k, e in values.items())
    return f"""ck AS ({rows}
), st AS (SELECT *, CASE WHEN n = 0 THEN 'skipped' WHEN (variable = 'RH' AND b <= 1.05e0 AND n >= 24) OR a < lo OR b > hi THEN 'fail' ELSE 'pass' END AS status FROM ck)
SELECT variable, a AS least, b AS most, n, status, CASE WHEN status = 'fail' THEN CASE
  WHEN variable = 'humidity_relative' AND b > 1.5e0 THEN 'percent instead of a fraction' WHEN variable = 'RH' AND b > 0 AND b <= 1.05e0 THEN 'a fraction instead of percent'
  WHEN variable = 'RH' AND b > 105 THEN 'percent times 100' WHEN variable IN ('temperature', 'Ta') AND b < 80 THEN 'degrees Celsius instead of kelvin'
  WHEN variable IN ('pressure', 'Ps') AND b < 2000 THEN 'hectopascal instead of pascal'
  WHEN variable IN ('precipitation', 'rainfall', 'snowfall', 'Sf', 'Rf') AND b > hi THEN 'metres instead of millimetres, or an amount instead of a rate'
  WHEN b > hi*100 THEN 'a factor of 100 or 1000 too large' ELSE 'outside the physical range' END END AS hint FROM st"""


_CHECKED = [k for k in _ALL if k != "wind_direction"]
#: Wrong units of each variable, and nothing at all in one.
_WRONG = {"temperature": "{} - 273.15e0", "humidity_relative": "{} * 100e0", "pressure": "{} / 100e0", "precipitation": "{} * 1000e0 + 1000e0", "longwave": "{} * 1000e0", "wind_speed": "CAST(NULL AS DOUBLE)"}


@query(with_simple(f", o AS (SELECT {', '.join(f'{r(*_ALL[k])} AS {k}' for k in _CHECKED)} FROM done), ".lstrip() + checked({k: k for k in _CHECKED}, "o")))
def forcing_checks(v: Views) -> DataFrame:
    return checks.check_forcing(_rounded(_forcing(v), {k: _ALL[k][1] for k in _CHECKED}), aggregate.time_step(v.hours))


@query(with_simple(f", o AS (SELECT {', '.join(f'{r(*_ALL[k])} AS {k}' for k in _CHECKED)} FROM done), w AS (SELECT {', '.join(f'{_WRONG.get(k, "{}").format(k)} AS {k}' for k in _CHECKED)} FROM o), ".lstrip() + checked({k: k for k in _CHECKED}, "w")))
def forcing_hints(v: Views) -> DataFrame:
    """The same outputs in wrong units."""
    right = _rounded(_forcing(v), {k: _ALL[k][1] for k in _CHECKED})
    wrong = right.select(*(F.expr(_WRONG.get(k, "{}").format(f"`{k}`").replace("e0", "D")).alias(k) for k in _CHECKED))
    return checks.check_forcing(wrong, aggregate.time_step(v.hours))


@query(with_simple(f", fsm AS (SELECT {_FSM_SQL} FROM done), f1 AS (SELECT * REPLACE (\"RH\"/100e0 AS \"RH\") FROM fsm), ".lstrip() + checked({k: f'"{k}"' for k in _FSM}, "f1")))
def fsm_checks(v: Views) -> DataFrame:
    """The inputs of a snow model, humidity being a fraction by mistake."""
    return checks.check_fsm_inputs(_fsm_inputs(v).withColumn("RH", F.col("RH") / 100.0))


@query(with_simple(f"SELECT m.member, time, unit_id, {r('ta+m.member', 4)} AS temperature FROM done CROSS JOIN (VALUES (0),(1),(2)) AS m(member)"))
def ensemble_downscale(v: Views) -> DataFrame:
    members = v.surface.withColumn("member", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("t2m", F.col("t2m") + F.col("member"))
    return downscale.downscale(members, v.units_w, ["temperature"]).select("member", "time", "unit_id", _r("temperature", 4))


@query(f"""SELECT s_suppkey AS source, {r("CASE WHEN x <= 1 THEN 0.1e0 ELSE (1e0-1e0/x)*0.9e0+0.1e0 END", 8)} AS linear, {r("CASE WHEN x <= 1 THEN 0.1e0 ELSE (1e0-1e0/sqrt(x))*0.9e0+0.1e0 END", 8)} AS sqrt,
  {r("CASE WHEN x <= 1 THEN 0.1e0 ELSE least(log10(x)/3e0,1e0)*0.9e0+0.1e0 END", 8)} AS log FROM (SELECT s_suppkey, (s_suppkey*317 % 31000 + 50)/100e0 AS x FROM supplier)""")
def resolution_weights(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    src, target = (k * 317 % 31000 + 50) * 1.0, F.lit(100.0)
    return v.table("supplier").select(k.alias("source"), *(_r(m, 8, ph.resolution_factor(src, target, m)) for m in ("linear", "sqrt", "log")))


_SRC = "(s_suppkey*317 % 31000 + 50)/100e0"


@query(f""", x AS (SELECT s_suppkey AS source, {_SRC} AS x, CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 11)/10e0 END AS tc FROM supplier
), f AS (SELECT *, CASE WHEN x <= 1 THEN 0.1e0 ELSE (1e0-1e0/x)*0.9e0+0.1e0 END AS l, CASE WHEN x <= 1 THEN 0.1e0 ELSE (1e0-1e0/sqrt(x))*0.9e0+0.1e0 END AS q FROM x)
SELECT source, {r("CASE WHEN tc IS NULL THEN q ELSE least(1e0, q*(tc*0.5e0+1e0)) END", 8)} AS lapse_rate, {r("l", 8)} AS radiation, {r("q", 8)} AS wind, {r("l", 8)} AS precipitation FROM f""")
def correction_weights(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    src, target, rough = (k * 317 % 31000 + 50) * 1.0, F.lit(100.0), F.when(k % 3 > 0, (k % 11) / 10.0)
    kinds = {x: ph.correction_weight(x, src, target, rough) for x in ("lapse_rate", "radiation", "wind", "precipitation")}
    return v.table("supplier").select(k.alias("source"), *(_r(x, 8, w) for x, w in kinds.items()))


@query(""", d AS (SELECT unit_id, DATE '2019-01-15' + CAST(unit_id*13 % 400 AS INT) AS a, DATE '2020-08-20' + CAST(unit_id*29 % 900 AS INT) AS b FROM units
), y AS (SELECT *, unnest(range(CAST(year(a) + CASE WHEN month(a) >= 9 THEN 1 ELSE 0 END AS BIGINT), CAST(year(b) + CASE WHEN month(b) >= 9 THEN 1 ELSE 0 END AS BIGINT) + 1)) AS wy FROM d)
SELECT unit_id, CAST(wy AS INT) AS wy, greatest(make_date(wy-1, 9, 1), a) AS first, least(make_date(wy, 8, 31), b) AS last FROM y""")
def water_year_windows(v: Views) -> DataFrame:
    k = F.col("unit_id")
    a, b = F.date_add(F.lit("2019-01-15").cast("date"), (k * 13 % 400).cast("int")), F.date_add(F.lit("2020-08-20").cast("date"), (k * 29 % 900).cast("int"))
    return v.units.select("unit_id", F.explode(ph.water_year_windows(a, b)).alias("w")).select("unit_id", F.col("w.wy").cast("int").alias("wy"), "w.first", "w.last")


@query("SELECT unit_id, make_date(2019 + unit_id % 5, 9, 1) + CAST(unit_id*7 % 365 AS INT) AS day FROM units")
def water_year_labels(v: Views) -> DataFrame:
    k = F.col("unit_id")
    return v.units.select("unit_id", ph.date_of_label((k % 5 + 2020).cast("int"), k * 7 % 365 + 1, 1).alias("day"))


@query(""", x AS (SELECT s_suppkey AS entry_id, (s_suppkey*7919 % 1000 + 1) AS size, (s_suppkey*104729 % 100003) AS last_accessed FROM supplier
), w AS (SELECT *, coalesce(sum(size) OVER (ORDER BY last_accessed, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(size) OVER () AS t FROM x)
SELECT entry_id, size, last_accessed FROM w WHERE t - b > 3000""")
def lru_evict(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    entries = v.table("supplier").select(k.alias("entry_id"), (k * 7919 % 1000 + 1).alias("size"), (k * 104729 % 100003).alias("last_accessed"))
    return aggregate.evict_lru(entries, 3000)


@query(f""", x AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'era5' WHEN 1 THEN 'hres' ELSE 'icon' END AS source, (s_suppkey*7919 % 1000 + 1)*1048576 AS size FROM supplier)
SELECT CAST(count(*) AS BIGINT) AS entries, {r("sum(size)/1073741824e0", 6)} AS total_gb, {r("sum(size)/5368709120e0", 6)} AS utilization, CAST(count(*) FILTER (source = 'era5') AS BIGINT) AS era5 FROM x""")
def cache_stats(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    entries = v.table("supplier").select(F.when(k % 3 == 0, "era5").when(k % 3 == 1, "hres").otherwise("icon").alias("source"), ((k * 7919 % 1000 + 1) * 1_048_576).alias("size"))
    return aggregate.cache_stats(entries, 5 * 1024**3).select("entries", _r("total_gb", 6), _r("utilization", 6), F.col("by_source")["era5"].alias("era5"))


@query("""SELECT count(*) FILTER (s = 'pass') AS n_pass, count(*) FILTER (s = 'warn') AS n_warn, count(*) FILTER (s = 'fail') AS n_fail, count(*) FILTER (s = 'fail') = 0 AS ok
  FROM (SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'fail' WHEN s_suppkey % 3 = 0 THEN 'warn' ELSE 'pass' END AS s FROM supplier)""")
def preflight_counts(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    return checks.status_counts(v.table("supplier").select(F.when(k % 7 == 0, "fail").when(k % 3 == 0, "warn").otherwise("pass").alias("status")))


_RUNS = """SELECT s_suppkey AS run, s_suppkey*700000 AS n_pixels, s_suppkey % 2 = 0 AS full_svf, s_suppkey % 40 + 1 AS n_grid, s_suppkey % 300 + 1 AS n_days, 24 AS steps_a_day, s_suppkey % 8 AS n_levels,
  CASE s_suppkey % 5 WHEN 0 THEN 'google' WHEN 1 THEN 's3zarr' WHEN 2 THEN 'cds' WHEN 3 THEN 'hybrid' ELSE 'local' END AS backend, s_suppkey*3 AS n_units,
  CASE s_suppkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' ELSE 'jax' END AS kernel, s_suppkey % 6 AS n_workers, 11 AS n_variables, CASE s_suppkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'fsm' WHEN 2 THEN 'fsm2' ELSE 'snowpack' END AS model FROM supplier"""


@query(f""", runs AS ({_RUNS}), x AS (SELECT *, n_days*steps_a_day AS st, n_units*n_days*steps_a_day*n_variables*4e0/1e9 AS o FROM runs
), y AS (SELECT *, CASE backend WHEN 'google' THEN 0.3e0 WHEN 's3zarr' THEN 0.2e0 WHEN 'cds' THEN 1.5e0 WHEN 'hybrid' THEN 0.3e0 ELSE 0.5e0 END AS bl, CASE backend WHEN 'google' THEN 0.7e0 WHEN 's3zarr' THEN 0.5e0 WHEN 'cds' THEN 3e0 WHEN 'hybrid' THEN 1e0 ELSE 1.5e0 END AS bh,
  n_units*st*(CASE kernel WHEN 'python' THEN 0.05e0 WHEN 'rust' THEN 0.005e0 ELSE 0.02e0 END)/1000e0/greatest(n_workers, 1)/60e0 AS ds, n_units*st*(CASE model WHEN 'fsm' THEN 1e0 WHEN 'fsm2' THEN 0.1e0 ELSE 0.5e0 END)/1000e0/60e0 AS ms,
  CASE WHEN n_pixels < 1000000 THEN 0.5e0 WHEN n_pixels < 10000000 THEN 2e0 WHEN n_pixels < 50000000 THEN 5e0 ELSE 10e0 END AS tl, CASE WHEN n_pixels < 1000000 THEN 2e0 WHEN n_pixels < 10000000 THEN 8e0 WHEN n_pixels < 50000000 THEN 15e0 ELSE 30e0 END AS th,
  full_svf AND n_pixels > 1000000 AS slow FROM x
), z AS (SELECT run, 'terrain' AS stage, n_pixels*20e0/1e9 AS gb, tl*CASE WHEN slow THEN 2 ELSE 1 END AS a, th*CASE WHEN slow THEN 3 ELSE 1 END AS b FROM y
  UNION ALL SELECT run, 'fetch', st*n_grid*4e0*(n_levels*5+10)/1e9/2.5e0, n_days*bl, n_days*bh FROM y UNION ALL SELECT run, 'downscale', o, ds*0.8e0, ds*1.5e0 FROM y UNION ALL SELECT run, 'model', o*0.3e0, ms*0.8e0, ms*1.5e0 FROM y WHERE model <> 'none')
SELECT run, stage, {r("gb", 9)} AS gb, {r("a", 6)} AS minutes_low, {r("b", 6)} AS minutes_high FROM z""")
def stage_estimates(v: Views) -> DataFrame:
    v.table("supplier").createOrReplaceTempView("_tarnspark_supplier")
    runs = v.spark.sql(_RUNS.replace("FROM supplier", "FROM _tarnspark_supplier"))
    return checks.estimate_stages(runs).select("run", "stage", _r("gb", 9), _r("minutes_low", 6), _r("minutes_high", 6))


@query("SELECT count(*) AS units, min(elevation) AS lowest, max(elevation) AS highest, " + ", ".join(f"count(*) FILTER (surface_type = '{k}') AS n_{k}" for k in ("open", "glacier", "forest", "rock", "water")) + " FROM units")
def domain_summary(v: Views) -> DataFrame:
    return aggregate.domain_summary(v.units)




@query(f""", k AS (SELECT k, exp(-k*k/8e0) AS w FROM range(-6, 7) t(k)
), a AS (SELECT r, c+k AS c, sum(w*elevation) AS s, sum(w) AS w FROM dem CROSS JOIN k GROUP BY 1, 2
), b AS (SELECT r+k AS r, c, sum(k.w*s) AS s, sum(k.w*a.w) AS w FROM a CROSS JOIN k GROUP BY 1, 2)
SELECT r, c, {r("b.s/b.w", 4)} AS elevation FROM b JOIN dem USING (r, c)""".replace("JOIN dem USING (r, c)", "JOIN (SELECT r, c FROM dem) d USING (r, c)"))
def gaussian_smooth(v: Views) -> DataFrame:
    return grids.smooth(v.dem, 2.0).select("r", "c", _r("elevation", 4))


@query(""", t AS (SELECT 1 AS tile, r, c, elevation FROM dem WHERE c < 30 UNION ALL SELECT 2, r, c, elevation + 1e0 FROM dem WHERE c >= 20)
SELECT r, c, min_by(elevation, tile) AS elevation FROM t GROUP BY 1, 2""")
def stitch_tiles(v: Views) -> DataFrame:
    a = v.dem.where("c < 30").withColumn("tile", F.lit(1))
    b = v.dem.where("c >= 20").withColumns({"tile": F.lit(2), "elevation": F.col("elevation") + 1.0})
    return grids.stitch_tiles(a.unionByName(b))


@query(""", d AS (SELECT r, c, CASE WHEN r >= 1 AND c BETWEEN 5 AND 40 THEN elevation END AS elevation FROM dem
), b AS (SELECT min(r) AS ar, max(r) AS br, min(c) AS ac, max(c) AS bc FROM d WHERE elevation IS NOT NULL)
SELECT CAST(r - ar AS INT) AS r, CAST(c - ac AS INT) AS c, elevation FROM d, b WHERE r BETWEEN ar AND br AND c BETWEEN ac AND bc""")
def trim_nodata(v: Views) -> DataFrame:
    return grids.trim_nodata(v.dem.withColumn("elevation", F.when((F.col("r") >= 1) & F.col("c").between(5, 40), F.col("elevation")))).select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "elevation")


@query(f""", b AS (SELECT surface_type, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM units GROUP BY 1
), x AS (SELECT *, 1000e0/(cos(radians((s+n)/2e0))*111320e0) AS dx, 1000e0/111320e0 AS dy FROM b)
SELECT surface_type, {r("w-dx", 8)} AS west, {r("s-dy", 8)} AS south, {r("e+dx", 8)} AS east, {r("n+dy", 8)} AS north FROM x""")
def patch_boxes(v: Views) -> DataFrame:
    return grids.group_boxes(v.units, "surface_type", 1000.0).select("surface_type", _r("west", 8), _r("south", 8), _r("east", 8), _r("north", 8))


@query(f""", p AS (SELECT r, c, elevation AS x, c*100e0 AS y, unit_idx AS k FROM dem JOIN membership USING (r, c) WHERE unit_idx >= 0
), d AS (SELECT a.r, a.c, a.k, b.k AS o, sum(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS s, count(*) AS n FROM p a CROSS JOIN p b GROUP BY 1, 2, 3, 4
), m AS (SELECT r, c, max(CASE WHEN o = k THEN s/(n-1) END) AS a, min(CASE WHEN o <> k THEN s/n END) AS b FROM d GROUP BY 1, 2)
SELECT {r("avg((b-a)/greatest(a,b))", 6)} AS silhouette FROM m""")
def silhouette(v: Views) -> DataFrame:
    px = v.dem.join(v.membership, ["r", "c"]).where("unit_idx >= 0").select("unit_idx", F.col("elevation").alias("x"), (F.col("c") * 100.0).alias("y"))
    return grids.silhouette(px, ["x", "y"], "unit_idx").select(_r("silhouette", 6))


@query(f""", a AS (SELECT time, cell, t2m, NULL::DOUBLE AS tp FROM surface WHERE cell < 15), b AS (SELECT time, cell, t2m + 1e0 AS t2m, tp FROM surface WHERE cell >= 10)
SELECT coalesce(a.time, b.time) AS time, coalesce(a.cell, b.cell) AS cell, {r("coalesce(a.t2m, b.t2m)", 6)} AS t2m, {r("coalesce(a.tp, b.tp)", 8)} AS tp FROM a FULL JOIN b ON a.time = b.time AND a.cell = b.cell""")
def source_merge(v: Views) -> DataFrame:
    a = v.surface.where("cell < 15").select("time", "cell", "t2m")
    b = v.surface.where("cell >= 10").select("time", "cell", (F.col("t2m") + 1.0).alias("t2m"), "tp")
    return grids.outer_merge([a, b], ["time", "cell"], ["t2m", "tp"]).select("time", "cell", _r("t2m", 6), _r("tp", 8))


@query("SELECT time, CAST(floor((epoch(time) - epoch(TIMESTAMP '2024-01-01'))/3600e0/504e0) AS INT) + 975 AS chunk FROM hours")
def archive_chunks(v: Views) -> DataFrame:
    return v.hours.select("time", grids.chunk_id(F.col("time")).alias("chunk"))
