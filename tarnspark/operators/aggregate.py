"""Daily summaries, mapping to rasters, and export layouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.functions import physics as ph
from tarnspark.operators import interp

MEANS = ("temperature", "humidity_specific", "humidity_relative", "wind_speed", "pressure", "shortwave_direct", "shortwave_diffuse", "longwave")
SUMS = ("precipitation", "rainfall", "snowfall")


def daily(forcing: DataFrame, means: Sequence[str] = MEANS, sums: Sequence[str] = SUMS, gaps: bool = False) -> DataFrame:
    """(unit_id, day): means and sums of the columns that are there; with ``gaps`` empty days too (null means, zero sums)."""
    m, s = [v for v in means if v in forcing.columns], [v for v in sums if v in forcing.columns]
    out = forcing.groupBy("unit_id", F.to_date("time").alias("day")).agg(*(F.avg(v).alias(v) for v in m), *(F.sum(v).alias(v) for v in s))
    if gaps:
        span = forcing.groupBy("unit_id").agg(F.min(F.to_date("time")).alias("a"), F.max(F.to_date("time")).alias("b"))
        spine = span.select("unit_id", F.explode(F.sequence("a", "b")).alias("day"))
        out = spine.join(out, ["unit_id", "day"], "left").fillna(0.0, subset=s)
    return out


def hbv_daily(forcing: DataFrame, units: DataFrame) -> DataFrame:
    """(unit_id, day, temperature in Celsius, precipitation, pet)."""
    d = daily(forcing, ("temperature",), ("precipitation",)).withColumn("temperature", F.col("temperature") - 273.15)
    pet = ph.hamon_pet(F.col("temperature"), F.dayofyear("day").cast("double"), F.col("lat"))
    return d.join(units.select("unit_id", "lat"), "unit_id").select("unit_id", "day", "temperature", "precipitation", pet.alias("pet"))


HBV_HEADER = ("# HBV forcing file generated by tarnspark", "# Date T[C] P[mm] PET[mm]")


def hbv_text(daily_: DataFrame, date_format: str = "yyyyMMdd") -> DataFrame:
    """(unit_id, day, line) of ``hbv_daily``."""
    line = F.format_string("%s %.2f %.3f %.3f", F.date_format("day", date_format), F.col("temperature"), F.col("precipitation"), F.col("pet"))
    return daily_.select("unit_id", "day", line.alias("line"))


def to_raster(forcing: DataFrame, membership: DataFrame, values: Sequence[str]) -> DataFrame:
    """(time, r, c, values): every pixel at every time, null where its unit is missing or -1.

    ``forcing`` and ``membership`` share ``unit_idx``.
    """
    times = forcing.select("time").distinct()
    pixels = membership.where("unit_idx >= 0").join(forcing.select("time", "unit_idx", *values), "unit_idx").select("time", "r", "c", *values)
    bare = membership.where("unit_idx < 0 or unit_idx is null").select("r", "c").crossJoin(F.broadcast(times)).select("time", "r", "c", *(F.lit(None).cast("double").alias(v) for v in values))
    return pixels.unionByName(bare)


def wide(forcing: DataFrame, value: str, unit_ids: Sequence[object]) -> DataFrame:
    """One row per time with a column for each unit named: for a few, as the plan grows with them.  ``wide_lines`` takes any number."""
    return forcing.where(F.col("unit_id").isin(list(unit_ids))).groupBy("time").pivot("unit_id", list(unit_ids)).agg(F.first(value))


#: What a table for people has where there is no value; units of a line that are put together at once, at most.
MISSING, WIDE_UNITS = "NaN", 4096


def _fields(entries: str, before: Column) -> Column:
    """The text of sorted ``entries`` (first, last, text) of positions after ``before``; positions between them are missing, repeated ones left out."""
    last = F.concat(F.array(before), F.col(f"{entries}.last"))  # one more than the entries: that pair has no entry, hence no text
    gap = lambda x, p: F.concat(F.repeat(F.lit(f",{MISSING}"), x["first"] - p - 1), x["text"])
    return F.array_join(F.zip_with(entries, last, lambda x, p: F.when(x["first"] > p, gap(x, p))), "")


def wide_lines(forcing: DataFrame, value: str, units: DataFrame, fmt: str = "%.4f") -> DataFrame:
    """(number, time, line): a table with a row per time and a column for each of ``units``, as lines of CSV.  The header has number 0, the rows 1; they follow by time.

    Units are columns of the text only, so the plan is the same for any number of them.
    """
    ids = units.agg(F.sort_array(F.collect_set("unit_id")).alias("ids"))  # one row, as the header is one line
    n = units.agg(F.count_distinct("unit_id")).first()[0]
    names = F.array_join(F.transform("ids", lambda k: F.concat(F.lit(",u"), k.cast("string"))), "")
    head = ids.select(F.lit(0).alias("number"), F.lit(None).cast(forcing.schema["time"].dataType).alias("time"), F.concat(F.lit("time"), names).alias("line"))
    at = forcing.join(interp.small(ids.select(F.posexplode("ids").alias("_at", "unit_id"))), "unit_id")
    text = F.concat(F.lit(","), F.when(F.col(value).isNull() | F.isnan(value), MISSING).otherwise(F.format_string(fmt, value)))
    at = at.select("time", F.floor(F.col("_at") / WIDE_UNITS).alias("_part"), F.struct(F.col("_at").alias("first"), F.col("_at").alias("last"), text.alias("text")).alias("_x"))
    parts = at.groupBy("time", "_part").agg(F.sort_array(F.collect_list("_x")).alias("_e"))
    first, last = F.col("_e")[0]["first"], F.element_at("_e", -1)["last"]
    parts = parts.select("time", F.struct(first.alias("first"), last.alias("last"), _fields("_e", first - 1).alias("text")).alias("_x"))
    rows = parts.groupBy("time").agg(F.sort_array(F.collect_list("_x")).alias("_e"))
    line = F.concat(F.coalesce(F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.lit("")), _fields("_e", F.lit(-1)), F.repeat(F.lit(f",{MISSING}"), F.lit(n - 1) - last))
    return head.unionByName(rows.select(F.lit(1).alias("number"), "time", line.alias("line")))


def packed(forcing: DataFrame, scales: Mapping[str, float]) -> DataFrame:
    """(time, unit_id) and int16 values for a page."""
    return forcing.select("time", "unit_id", *(ph.pack_int16(F.col(v), s).alias(v) for v, s in scales.items()))


def rate(amount: Column, step_seconds: float) -> Column:
    return amount / step_seconds


def _stamp(fmt: str) -> Column:
    return F.date_format(F.col("time"), fmt)


def time_step(forcing: DataFrame) -> float:
    """Seconds from the first time to the second; an hour if there are fewer."""
    first = [r["time"] for r in forcing.select("time").distinct().orderBy("time").limit(2).collect()]
    return (first[1] - first[0]).total_seconds() if len(first) > 1 else 3600.0


def humidity_percent(forcing: DataFrame, column: str = "humidity_relative") -> Column:
    """Relative humidity in percent, by the column's metadata ("%" or "1"), else as a fraction if nothing exceeds 1.5."""
    units = str(forcing.schema[column].metadata.get("units", "")).strip()
    if units in ("%", "percent"):
        return F.col(column)
    if units != "1" and (forcing.agg(F.max(column)).first()[0] or 0.0) > 1.5:
        return F.col(column)
    return F.col(column) * 100.0


def fsm_inputs(forcing: DataFrame, step_seconds: float | None = None) -> DataFrame:
    """(unit_id, time, SW, LW, Sf, Rf, Ta, RH, Ua, Ps): what the snow models FSM and FSM2 read, in their units; rates by ``time_step`` if no step is given."""
    c, step = F.col, step_seconds or time_step(forcing)
    return forcing.select(
        "unit_id", "time", (c("shortwave_direct") + c("shortwave_diffuse")).alias("SW"), c("longwave").alias("LW"), rate(c("snowfall"), step).alias("Sf"), rate(c("rainfall"), step).alias("Rf"),
        c("temperature").alias("Ta"), humidity_percent(forcing).alias("RH"), c("wind_speed").alias("Ua"), c("pressure").alias("Ps"),
    )


def fsm_text(inputs: DataFrame) -> DataFrame:
    """(unit_id, time, line) of ``fsm_inputs``."""
    line = F.format_string(
        "%4d %2d %2d %2d %10.4f %10.4f %12.6e %12.6e %8.3f %6.4f %8.3f %10.2f",
        F.year("time"), F.month("time"), F.dayofmonth("time"), F.hour("time"), *(F.col(x) for x in ("SW", "LW", "Sf", "Rf", "Ta", "RH", "Ua", "Ps")),
    )
    return inputs.select("unit_id", "time", line.alias("line"))


def fsm_lines(forcing: DataFrame, step_seconds: float | None = None) -> DataFrame:
    """The lines of FSM and FSM2.  FSM has a file for each unit, FSM2 one file by time and unit (``store.export``)."""
    return fsm_text(fsm_inputs(forcing, step_seconds))


def smet_columns(forcing: DataFrame) -> DataFrame:
    """(unit_id, time, TA, RH, VW, ISWR, ILWR, PSUM, PSUM_PH); humidity in percent."""
    c = F.col
    return forcing.select(
        "unit_id", "time", c("temperature").alias("TA"), humidity_percent(forcing).alias("RH"), c("wind_speed").alias("VW"),
        (c("shortwave_direct") + c("shortwave_diffuse")).alias("ISWR"), c("longwave").alias("ILWR"), c("precipitation").alias("PSUM"), ph.phase_fraction(c("rainfall"), c("snowfall")).alias("PSUM_PH"),
    )


SMET_FIELDS = ("timestamp", "TA", "RH", "VW", "ISWR", "ILWR", "PSUM", "PSUM_PH")


def smet_text(columns: DataFrame, phase: bool = True) -> DataFrame:
    """(unit_id, time, line) of ``smet_columns``; without ``phase`` the last field is left out."""
    line = F.format_string("%s %.2f %.2f %.2f %.2f %.2f %.4f" + " %.4f" * phase, _stamp("yyyy-MM-dd'T'HH:mm:ss"), *(F.col(x) for x in SMET_FIELDS[1 : 8 if phase else 7]))
    return columns.select("unit_id", "time", line.alias("line"))


def smet_lines(forcing: DataFrame) -> DataFrame:
    return smet_text(smet_columns(forcing))


def smet_header(units: DataFrame, created: str, nodata: float = -999.0, phase: bool = True) -> DataFrame:
    """(unit_id, number, line): the lines before the data of each unit (unit_id, lat, lon, elevation)."""
    c = F.col
    lines = (
        F.lit("SMET 1.1 ASCII"), F.lit("[HEADER]"), F.concat(F.lit("station_id       = "), c("unit_id").cast("string")), F.concat(F.lit("station_name     = unit_"), c("unit_id").cast("string")),
        F.format_string("latitude         = %.6f", c("lat")), F.format_string("longitude        = %.6f", c("lon")), F.format_string("altitude         = %.1f", c("elevation")),
        F.lit(f"nodata           = {nodata}"), F.lit("tz               = 0"), F.lit("source           = tarnspark"), F.lit(f"creation_date    = {created}"),
        F.lit(f"fields           = {' '.join(SMET_FIELDS[: 8 if phase else 7])}"), F.lit("[DATA]"),
    )
    return units.select("unit_id", F.posexplode(F.array(*lines)).alias("number", "line"))


def crocus_columns(forcing: DataFrame, step_seconds: float | None = None, co2_ppm: float | None = 420.0, wind_direction: bool = False) -> DataFrame:
    """One row a unit and time; carbon dioxide in kg/kg from ppm, and a wind direction that the model fills in, if asked for."""
    c, step = F.col, step_seconds or time_step(forcing)
    more = [F.lit(None).cast("double").alias("Wind_DIR")] * wind_direction
    more += [] if co2_ppm is None else [F.lit(co2_ppm * 44.01 / (28.97 * 1e6)).alias("CO2air")]
    return forcing.select(
        "unit_id", "time", c("temperature").alias("Tair"), c("humidity_specific").alias("Qair"), c("wind_speed").alias("Wind"), c("pressure").alias("PSurf"),
        c("shortwave_direct").alias("DIR_SWdown"), c("shortwave_diffuse").alias("SCA_SWdown"), c("longwave").alias("LWdown"), rate(c("rainfall"), step).alias("Rainf"), rate(c("snowfall"), step).alias("Snowf"), *more,
    )


def cryogrid_columns(forcing: DataFrame, step_seconds: float | None = None) -> DataFrame:
    """One row a unit and time: temperature in kelvin, rain and snow in m/s of water."""
    c, step = F.col, step_seconds or time_step(forcing)
    return forcing.select(
        "unit_id", "time", c("temperature").alias("Tair"), c("humidity_specific").alias("q"), c("wind_speed").alias("wind"),
        (c("shortwave_direct") + c("shortwave_diffuse")).alias("Sin"), c("longwave").alias("Lin"), c("pressure").alias("p"),
        (rate(c("rainfall"), step) / 1000.0).alias("rainfall"), (rate(c("snowfall"), step) / 1000.0).alias("snowfall"),
    )


def domain_summary(units: DataFrame) -> DataFrame:
    """One row: units, lowest and highest elevation, a count for each surface type, and the total area if units have one."""
    kinds = ("open", "glacier", "forest", "rock", "water")
    area = [F.sum("area_m2").alias("area_m2")] if "area_m2" in units.columns else []
    return units.agg(F.count("*").alias("units"), F.min("elevation").alias("lowest"), F.max("elevation").alias("highest"), *area, *(F.count(F.when(F.col("surface_type") == k, 1)).alias(f"n_{k}") for k in kinds))


def blended_resolution(sources: DataFrame) -> DataFrame:
    """One row: the weighted mean of resolutions."""
    return sources.agg((F.sum(F.col("weight") * F.col("resolution_m")) / F.sum("weight")).alias("resolution_m"))


def evict_lru(entries: DataFrame, limit_bytes: int) -> DataFrame:
    """The cache entries to delete, least recently used first, so that the rest fits in the limit.  The index is metadata."""
    from pyspark.sql import Window

    total = entries.agg(F.sum("size").alias("_t"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("last_accessed", "entry_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return entries.crossJoin(F.broadcast(total)).withColumn("_b", before).where(F.col("_t") - F.col("_b") > limit_bytes).drop("_t", "_b")


def cache_stats(entries: DataFrame, limit_bytes: int) -> DataFrame:
    """One row: entries, total_gb, max_gb, utilization; and (source, entries) as a map."""
    by = entries.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    total = F.sum("s")
    sources = F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n"))))  # a row for each source
    use = (total / limit_bytes) if limit_bytes > 0 else F.lit(0.0)
    return by.agg(F.sum("n").alias("entries"), (total / 1024.0**3).alias("total_gb"), F.lit(limit_bytes / 1024.0**3).alias("max_gb"), use.alias("utilization"), sources.alias("by_source"))


def overlapping_entry(entries: DataFrame, source: str, west: float, south: float, east: float, north: float, start: str, end: str) -> DataFrame:
    """The most recently used cache entry of a source that overlaps box and period, if any."""
    c = F.col
    hit = entries.where((c("source") == source) & (c("west") <= east) & (c("east") >= west) & (c("south") <= north) & (c("north") >= south) & (c("t0") <= F.lit(end).cast("timestamp_ntz")) & (c("t1") >= F.lit(start).cast("timestamp_ntz")))
    return hit.orderBy(F.desc("last_accessed"), "entry_id").limit(1)
