"""Behaviour of operators on small, hand-made inputs."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tarnspark import catalog
from tarnspark.functions import boxes, sql
from tarnspark.operators import aggregate, checks, downscale, graph, grids, ingest, interp, redistribute, terrain, units
from tarnspark.plans import planner
from tarnspark.plans.config import Config
from tarnspark.sources import registry, store
from tarnspark.sources.adapter import Views
from tarnspark.streaming import append

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def grid(spark, f, n=3):
    return spark.createDataFrame([(T0, i, j, float(f(i, j))) for i in range(n) for j in range(n)], "time timestamp_ntz, lat_idx int, lon_idx int, v double")


def test_bilinear_is_exact_on_planes_and_outside(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.25, 0.5), (3, 2.5, -0.5)], "unit_id int, lat double, lon double")
    w = interp.with_weights(pts, 0.0, 0.0, 1.0, 3, 3)
    got = {r["unit_id"]: r["v"] for r in interp.interpolate(grid(spark, lambda i, j: 2 * i + 3 * j), w, ["v"]).collect()}
    assert got == pytest.approx({1: 0.0, 2: 4.0, 3: 3.5})


def test_level_at_the_target_is_ignored_between_others(spark):
    def at(z):
        df = spark.createDataFrame([([1000.0, 2000.0, 3000.0], [10.0, 99.0, 30.0], float(z))], "z array<double>, v array<double>, t double")
        return df.select(interp.at_height(F.col("z"), F.col("v"), F.col("t"))).first()[0]

    assert at(2000) == pytest.approx(20.0) and at(500) == 10.0 and at(5000) == 30.0


def test_tilted_plane(spark):
    dem = spark.createDataFrame([(r, c, 3000 + 0.5 * 30 * r) for r in range(6) for c in range(6)], "r int, c int, elevation double")
    got = terrain.slope_aspect(dem, 30.0).agg(F.min("slope"), F.max("slope"), F.min("aspect"), F.max("aspect")).first()
    assert got[0] == pytest.approx(26.565, abs=1e-3) == got[1] and got[2] == got[3] == pytest.approx(180.0)


def test_flat_terrain_sees_the_whole_sky(spark):
    dem = spark.createDataFrame([(r, c, 100.0) for r in range(5) for c in range(5)], "r int, c int, elevation double")
    assert {round(r["svf"], 9) for r in terrain.sky_view_factor(terrain.horizon(dem, 8, 90.0, 30.0)).collect()} == {1.0}
    assert {abs(round(r["sx"], 9)) for r in terrain.winstral_sx(dem, 8, 90.0, 30.0).collect()} == {0.0}


def test_flow_reaches_the_pit(spark):
    dem = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "r int, c int, elevation double")
    got = terrain.flow_accumulation(terrain.flow_direction(dem, 30.0))
    assert {(r["basin_r"], r["basin_c"]) for r in got.collect()} == {(0, 0)}
    assert got.where("r = 0 and c = 0").first()["cells"] == 16


def test_spikes_use_original_neighbours(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([1.0, 50.0, 2.0, 60.0, 3.0])], "cell int, k int, v double")
    assert [r[2] for r in rows(ingest.repair_spikes(df, {"v": 20.0}, ["cell"], ["k"]), "k")] == [1.0, 1.5, 55.0, 2.5, 3.0]


def test_rolling_sum_starts_short(spark):
    df = spark.createDataFrame([(1, k, 1.0) for k in range(5)], "cell int, k int, v double")
    assert [r[-1] for r in rows(ingest.rolling_sum(df, "v", 3, ["cell"], ["k"], "s"), "k")] == [1.0, 2.0, 3.0, 3.0, 3.0]


def test_first_stored_wins(spark):
    a = spark.createDataFrame([(1, "old")], "k int, v string")
    b = spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string")
    assert rows(store.finalize(a, [b], ["k"])) == [(1, "old"), (2, "new")]


def test_append_drops_late_rows_and_takes_all_of_an_empty_store(spark):
    old = spark.createDataFrame([(T0, 1)], "time timestamp_ntz, v int")
    new = spark.createDataFrame([(T0, 2), (T0 + dt.timedelta(hours=1), 3)], "time timestamp_ntz, v int")
    assert [r[1] for r in rows(ingest.append_newer(old, new))] == [1, 3]
    assert [r[1] for r in rows(ingest.append_newer(old.limit(0), new))] == [2, 3]


def test_wind_transport_keeps_mass_inside(spark):
    cells = spark.createDataFrame([(0, 100.0, 10.0, 5.0, 10.0), (1, 50.0, -10.0, 5.0, 20.0), (2, 50.0, 0.0, 5.0, 10.0)], "i long, swe double, sx double, wind double, area double")
    edges = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5)], "i long, j long, weight double")
    got = {r["i"]: r["swe"] for r in redistribute.wind_transport(cells, edges).collect()}
    assert got[0] < 100 and got[1] > 50 and got[2] == 50.0
    assert got[0] * 10 + got[1] * 20 + got[2] * 10 == pytest.approx(2500.0)


def test_avalanche_passes_deposits_on(spark):
    cells = spark.createDataFrame([(0, 0, 100.0, 60.0, 1.0), (0, 1, 0.0, 60.0, 1.0), (0, 2, 0.0, 0.0, 1.0)], "d int, i long, swe double, slope double, area double")
    edges = spark.createDataFrame([(0, 0, 1, 1, 1.0), (0, 1, 1, 2, 1.0)], "d int, i long, slot int, j long, flow double")
    assert {r["i"]: r["swe"] for r in redistribute.avalanche(cells, edges, "d").collect()} == {0: 0.0, 1: 0.0, 2: 100.0}


def test_upstream_closure_of_a_chain(spark):
    links = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "4"), ("4", "0")], "id string, downstream_id string")
    assert {u for i, u in rows(graph.upstream_closure(links)) if i == "4"} == {"1", "2", "3"}


def test_point_groups_chain(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.9, 0.0), (3, 1.8, 0.0), (4, 9.0, 0.0)], "node int, x double, y double")
    assert rows(graph.point_groups(pts, 1.0)) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_circular_mean_crosses_north(spark):
    px = spark.createDataFrame([(0, 0, 1.0, 1.0, 350.0, 1.0, 0), (0, 1, 1.0, 1.0, 10.0, 1.0, 0), (0, 2, 1.0, 1.0, 90.0, 1.0, -1)], "r int, c int, elevation double, slope double, aspect double, svf double, u int")
    got = units.zonal_stats(px, "u", 900.0).collect()
    assert len(got) == 1 and min(got[0]["aspect"], 360 - got[0]["aspect"]) < 1e-6 and got[0]["area_m2"] == 1800.0


def test_stratified_clusters_dont_share_ids(spark):
    px = spark.createDataFrame([(k, float(k % 7), k % 2) for k in range(60)], "k int, f double, s int")
    got = units.stratified_kmeans(px, ["f"], "s", 6).groupBy("cluster").agg(F.countDistinct("s").alias("n"))
    assert {r["n"] for r in got.collect()} == {1}


def test_to_raster_keeps_bare_pixels(spark):
    m = spark.createDataFrame([(0, 0, 0), (0, 1, -1)], "r int, c int, unit_idx int")
    f = spark.createDataFrame([(T0, 0, 5.0)], "time timestamp_ntz, unit_idx int, v double")
    assert rows(aggregate.to_raster(f, m, ["v"]), "c") == [(T0, 0, 0, 5.0), (T0, 0, 1, None)]


def test_checks_name_the_culprit(spark):
    f = spark.createDataFrame([(10.0, 0.5)], "temperature double, humidity_relative double")
    got = {r["variable"]: r["status"] for r in checks.check_forcing(f).collect()}
    assert got == {"temperature": "fail", "humidity_relative": "pass"}
    with pytest.raises(ValueError, match="temperature"):
        checks.require_valid(f)


def test_checks_tell_units(spark):
    f = spark.createDataFrame([(85.0, float("nan"), 5.0, None)] * 30, "RH double, Ua double, Ta double, Ps double")
    got = {r["variable"]: (r["status"], r["hint"]) for r in checks.check_fsm_inputs(f).collect()}
    assert got == {"RH": ("pass", None), "Ua": ("skipped", None), "Ta": ("fail", "degrees Celsius instead of kelvin"), "Ps": ("skipped", None)}
    few, day = (spark.createDataFrame([(0.7,)] * n, "RH double") for n in (23, 24))
    assert [checks.check_fsm_inputs(x).first()["status"] for x in (few, day)] == ["pass", "fail"]
    rain = spark.createDataFrame([(800.0,)], "rainfall double")
    assert [checks.check_forcing(rain, s).first()["status"] for s in (600.0, 3600.0, 3 * 3600.0)] == ["fail", "fail", "pass"]
    with pytest.warns(UserWarning, match="kelvin"):
        checks.require_valid(f, bounds=checks.FSM_BOUNDS, warn=True)


def forcing(spark):
    names = "temperature pressure humidity_specific humidity_relative wind_speed shortwave_direct shortwave_diffuse longwave precipitation rainfall snowfall".split()
    data = [(T0 + dt.timedelta(hours=3 * h), u, 270.123 + h, 71234.567, 0.004, 0.81234 - 0.1 * u, 3.4567, 400.05 + h, 33.3, 250.75, 1.5 + h, 0.5 + h, 1.0) for h in range(3) for u in (1, 2)]
    return spark.createDataFrame(data, "time timestamp_ntz, unit_id int, " + ", ".join(f"{n} double" for n in names)), data


def test_snow_model_files(spark, tmp_path):
    """Files as the models read them, written here by hand."""
    df, data = forcing(spark)
    line = lambda r: f"{r[0].year:4d} {r[0].month:2d} {r[0].day:2d} {r[0].hour:2d} {r[7] + r[8]:10.4f} {r[9]:10.4f} {r[12] / 10800:12.6e} {r[11] / 10800:12.6e} {r[2]:8.3f} {r[5] * 100:6.4f} {r[6]:8.3f} {r[3]:10.2f}"
    store.export(df, "fsm", str(tmp_path / "fsm"))
    store.export(df, "fsm2", str(tmp_path / "fsm2"))
    read = lambda p: [x for f in sorted(p.rglob("part-*")) for x in f.read_text().splitlines()]
    for u in (1, 2):
        assert read(tmp_path / "fsm" / f"unit_id={u}") == [line(r) for r in data if r[1] == u]
    assert read(tmp_path / "fsm2") == [line(r) for r in data]
    sites = spark.createDataFrame([(1, 42.5, 76.25, 3000.04), (2, 42.0, 76.0, 2500.0)], "unit_id int, lat double, lon double, elevation double")
    store.export(df, "snowpack", str(tmp_path / "smet"), sites)
    got = read(tmp_path / "smet" / "unit_id=1")
    assert got[:2] == ["SMET 1.1 ASCII", "[HEADER]"] and got[12] == "[DATA]" and "latitude         = 42.500000" in got and "altitude         = 3000.0" in got
    assert got[11] == "fields           = timestamp TA RH VW ISWR ILWR PSUM PSUM_PH"
    assert got[13] == f"{T0:%Y-%m-%dT%H:%M:%S} 270.12 71.23 3.46 433.35 250.75 1.5000 0.3333" and len(got) == 16
    with pytest.raises(ValueError, match="units"):
        store.export(df, "smet", str(tmp_path / "none"))
    store.export(df, "hbv", str(tmp_path / "hbv"), sites)
    got = read(tmp_path / "hbv" / "unit_id=2")
    assert got[1] == "# Date T[C] P[mm] PET[mm]" and got[2:] == [f"{T0:%Y%m%d} -2.03 7.500 0.000"]


def test_netcdf_layouts(spark):
    df, data = forcing(spark)
    crocus, cryogrid = aggregate.crocus_columns(df).first(), aggregate.cryogrid_columns(df).first()
    assert crocus["CO2air"] == pytest.approx(420 * 44.01 / 28.97e6) and "Wind_DIR" not in crocus.asDict() and crocus["Rainf"] == pytest.approx(data[0][11] / 10800)
    assert aggregate.crocus_columns(df, co2_ppm=None, wind_direction=True).columns[-1] == "Wind_DIR"
    assert cryogrid["Tair"] == data[0][2] and cryogrid["snowfall"] == pytest.approx(1.0 / 10800 / 1000)


def test_humidity_in_percent_by_units_or_size(spark):
    part, whole = (spark.createDataFrame([(x,)], "humidity_relative double") for x in (0.5, 50.0))
    one = lambda df: df.select(aggregate.humidity_percent(df)).first()[0]
    assert (one(part), one(whole)) == (50.0, 50.0)
    assert one(part.withMetadata("humidity_relative", {"units": "%"})) == 0.5 and one(whole.withMetadata("humidity_relative", {"units": "1"})) == 5000.0


def test_wide_has_every_unit(spark):
    df, data = forcing(spark)
    got = aggregate.wide(df, "temperature", [1, 2]).orderBy("time").collect()
    assert [(r["1"], r["2"]) for r in got] == [(a[2], b[2]) for a, b in zip(data[::2], data[1::2], strict=True)]


def test_wide_lines_hold_the_table_of_columns(spark, monkeypatch):
    """Read back, the lines are ``wide``'s rows, however units are put together; what is missing or not a number is NaN."""
    monkeypatch.setattr(aggregate, "WIDE_UNITS", 3)
    times, ids = [T0 + dt.timedelta(hours=h) for h in range(3)], [7, 2, 100, 11, 5, 23, 1, 60, 9, 40]
    data = [(t, k, 250.0 + k / 16 + h if (k + h) % 4 else None) for h, t in enumerate(times) for k in ids if (h, k) not in {(0, 1), (0, 2), (1, 11), (1, 23), (1, 40), (2, 60), (2, 100)}]
    df = spark.createDataFrame([*data, (times[0], 7, 0.5), (times[0], 999, 1.0), (times[1], 11, math.nan)], "time timestamp_ntz, unit_id long, x double")
    units = spark.createDataFrame([(k,) for k in [*ids, 7, None]], "unit_id long")
    lines = aggregate.wide_lines(df, "x", units).orderBy("number", "time").collect()
    table = [r["line"].split(",") for r in lines]
    assert table[0] == ["time", *(f"u{k}" for k in sorted(ids))] and [r["number"] for r in lines] == [0, 1, 1, 1]
    assert [r["time"] for r in lines] == [None, *times] and [r[0] for r in table[1:]] == [f"{t:%Y-%m-%d %H:%M:%S}" for t in times]
    expected = {(t, k): v for t, k, v in data} | {(times[0], 7): 0.5}  # a repeated unit has the first text; a unit that isn't asked for has no column
    for t, row in zip(times, table[1:], strict=True):
        assert row[1:] == [f"{v:.4f}" if (v := expected.get((t, k))) is not None else "NaN" for k in sorted(ids)]
    plain = spark.createDataFrame(data, df.schema)
    columns = aggregate.wide(plain, "x", sorted(ids)).orderBy("time").collect()
    back = [r["line"].split(",")[1:] for r in aggregate.wide_lines(plain, "x", units).where("number = 1").orderBy("time").collect()]
    assert [[None if x == "NaN" else float(x) for x in row] for row in back] == [list(r)[1:] for r in columns]


def test_wide_export_of_many_units_has_a_small_plan(spark, tmp_path):
    """As many fields as units in each line, but the same columns: a column for each of 60,000 units filled the driver.  One unit's height is no number."""
    for t in ("nation", "events"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    some = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").limit(1).drop("s_suppkey")
    many = some.crossJoin(spark.range(5000).withColumnRenamed("id", "s_suppkey"))
    many.withColumn("s_acctbal", F.when(F.col("s_suppkey") == 4999, math.nan).otherwise(F.col("s_acctbal"))).write.parquet(str(tmp_path / "supplier.parquet"))
    hours = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.date_trunc("hour", "ts")).distinct().count()
    df = catalog.queries()["export_csv_wide"](spark, str(tmp_path))
    assert df.columns == ["number", "time", "line"]
    got = df.select("number", F.size(F.split("line", ",")).alias("fields"), F.regexp_count("line", F.lit("NaN")).alias("gaps")).groupBy("number", "fields", "gaps").count().collect()
    assert sorted(map(tuple, got)) == [(0, 5001, 0, 1), (1, 5001, 1, hours)]


def test_chunk_sizes_and_amounts():
    assert checks.chunk_sizes((10, 10), 8) == [10, 10] and checks.chunk_sizes((8760, 100, 200), 4, 50) == [547, 100, 200]
    with pytest.raises(ValueError, match="units"):
        ingest.amounts(F.lit(1.0), "inch", 1.0)


def test_archives_wrap_the_box_and_scale_precipitation(spark, tmp_path):
    """The box, the days and the hours reach the scan as they are; longitudes are wrapped in what is read."""
    data = [(T0 + dt.timedelta(hours=6 * h), lat, lon, 270.0, 0.5) for h in range(8) for lat in (40.0, 42.0) for lon in (0.0, 10.0, 350.0)]
    spark.createDataFrame(data, "time timestamp_ntz, latitude double, longitude double, t2m double, tp double").write.parquet(str(tmp_path / "s"))
    levels = [(r[0], k, *r[1:4]) for r in data for k in (500, 850)]
    spark.createDataFrame(levels, "time timestamp_ntz, level int, latitude double, longitude double, t double").write.parquet(str(tmp_path / "l"))
    request = registry.Request(bbox=(-15.0, 41.0, 5.0, 43.0), days=(f"{T0:%Y-%m-%d}", f"{T0:%Y-%m-%d}"), levels=[850, 925])
    surface, plev = registry.load(spark, "archive", registry.Spec(str(tmp_path / "s"), str(tmp_path / "l")), request)
    got = surface.collect()
    assert {(r["latitude"], r["longitude"], r["tp"]) for r in got} == {(42.0, 0.0, 3.0), (42.0, -10.0, 3.0)} and len(got) == 8
    assert {(r["level"], r["longitude"]) for r in plev.collect()} == {(850, 0.0), (850, -10.0)}
    plan = surface._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "latitude" in pushed and "time" in pushed


def test_planner():
    assert planner.groups_of(["rainfall"]) == {"temperature", "precipitation"}
    assert planner.resolve_groups(None, {"t2m", "sp", "z_surf", "u10", "v10"}) == ["temperature", "wind"]
    with pytest.raises(ValueError, match="d2m"):
        planner.resolve_groups(["humidity_relative"], {"t2m", "sp", "z_surf"})
    with pytest.raises(ValueError, match="unknown"):
        planner.groups_of(["snow_depth"])
    assert planner.required_variables(["temperature"], "full") == ({"t2m", "sp", "z_surf"}, {"t", "z"})


@pytest.mark.parametrize("bad", [{"lapse_rate": 0.03}, {"lapse_rate": float("nan")}, {"t_snow": 280.0}, {"mode": "fast"}, {"precip_gradient": 0.02}])
def test_settings_are_validated(bad):
    with pytest.raises(ValueError):
        downscale.Settings(**bad)


def test_config():
    c = Config.from_dict({"domain": {"bbox": [76, 42, 77, 43]}, "output": {"variables": ["temperature"]}})
    assert c.groups({"t2m", "sp", "z_surf"}) == ["temperature"]
    with pytest.raises(ValueError):
        Config.from_dict({"domain": {}})
    with pytest.raises(ValueError):
        Config.from_dict({"domain": {"bbox": [0, 0, 1, 1]}, "clustering": {"method": "som"}})
    with pytest.warns(UserWarning):
        Config.from_dict({"domain": {"bbox": [0, 0, 1, 1]}, "forecast": {}})


def test_preflight():
    got = checks.preflight((1, 2, 3, 1), "2024-01-01", "2024-01-02", [500], "full", 3, 10)
    assert {(c.category, c.status) for c in got} >= {("bbox", "fail"), ("levels", "fail"), ("clusters", "warn")}
    assert checks.pressure_height(500) == 5500 and checks.pressure_height(1100) == 0 and checks.pressure_height(50) == 16200
    assert checks.pressure_height(525) == pytest.approx(5200)


def test_antimeridian_box(spark):
    df = spark.createDataFrame([(0.0, 179.0), (0.0, -179.0), (0.0, 0.0)], "lat double, lon double")
    assert df.where(ingest.in_bbox(F.col("lat"), F.col("lon"), 170.0, -10.0, -170.0, 10.0)).count() == 2


def test_source_renames_projects_and_pushes_down(spark, tmp_path):
    df = spark.createDataFrame([(T0 + dt.timedelta(hours=h), 1.0, 2.0, 280.0, 9.0) for h in range(48)], "valid_time timestamp_ntz, lat double, lon double, temperature_2m double, other double")
    df.write.parquet(str(tmp_path / "s"))
    surface, levels = registry.load(spark, "custom", registry.Spec(str(tmp_path / "s")), registry.Request(days=("2024-01-02", "2024-01-02"), every_hours=6))
    assert surface.columns == ["time", "latitude", "longitude", "t2m"] and levels is None and surface.count() == 4
    plan = surface._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan and "GreaterThanOrEqual(valid_time" in plan
    with pytest.raises(ValueError):
        registry.load(spark, "nowhere", registry.Spec("x"))
    with pytest.raises(ValueError, match="sp"):
        registry.validate_mapping(["temperature_2m"], {}, ["t2m", "sp"])


def test_sources_fall_back(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, None, None)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 9.0, 5.0), (2, 7.0, None), (3, 8.0, None)], "k int, x double, y double")
    assert rows(registry.merge_sources([a, b], ["k"], ["x", "y"])) == [(1, 1.0, 5.0), (2, 7.0, None), (3, 8.0, None)]
    assert registry.select_backend("a", "b", True, ["cds"]) == "cds"


def test_store_round_trip_and_export(spark, tmp_path):
    v = Views(spark, SF)
    out = downscale.downscale(v.surface, v.units_w, ["temperature", "pressure"])
    path = str(tmp_path / "store")
    store.write(out, path)
    assert store.read(spark, path).count() == out.count()
    day = store.existing_days(spark, path).orderBy("day").first()["day"]
    assert store.read(spark, path, (str(day), str(day))).select(F.to_date("time")).distinct().count() == 1
    store.append(out, path)  # nothing is newer
    assert store.read(spark, path).count() == out.count()
    store.export(out, "csv", str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == out.count()
    with pytest.raises(ValueError):
        store.writer("xls")
    assert store.writer("snowpack") is store.writer("smet")


def test_full_mode_needs_levels(spark):
    v = Views(spark, SF)
    with pytest.raises(ValueError, match="pressure levels"):
        downscale.downscale(v.surface, v.units_w, ["temperature"], downscale.Settings(mode="full"))


def test_output_isnt_shuffled(spark):
    """After the coarse blocks are made, only a broadcast join and projections follow, in as many tasks as there are cores at least."""
    v = Views(spark, SF)
    out = downscale.downscale(v.surface, v.units_w)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("== Final Plan ==") : plan.index("== Initial Plan ==")] if "== Final Plan ==" in plan else plan
    top = plan[: plan.index("BroadcastHashJoin")]
    assert "Exchange" not in top and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan and "SortMergeJoin" not in plan


def test_a_side_is_broadcast_by_its_bytes(spark):
    df = spark.range(1000)
    assert "broadcast" in interp.small(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in interp.small(df, 1000)._jdf.queryExecution().logical().toString().lower()


def test_a_bracket_is_that_of_each_height(spark):
    """The two levels of a block interpolated at the unit give what interpolating every level and then the height gives."""
    import itertools

    def cell(k):
        return [1000.0 + 5 * k, None if k == 9 else 2000.0 - k, 3500.0 + k], [280.0 + k, 270.0 - k, 255.0 + 2 * k]

    corners = [{"z_levels": cell(k)[0], "t_levels": cell(k)[1]} for k in range(4)]
    rows = [(corners, a, b, z) for a, b, z in itertools.product((0.0, 0.3), (0.2, 1.0), (500.0, 1000.0, 1700.0, 2600.0, 9000.0))]
    df = spark.createDataFrame(rows, "level_corners array<struct<z_levels:array<double>,t_levels:array<double>>>, t double, s double, elevation double")
    got = interp.with_bracket(df, F.col("elevation")).select("t", "s", "elevation", interp.at_bracket("t_levels").alias("v")).collect()
    for r in got:
        w = [(1 - r.t) * (1 - r.s), (1 - r.t) * r.s, r.t * (1 - r.s), r.t * r.s]
        zs, ts = ([sum(x * cell(q)[j][k] for q, x in enumerate(w)) for k in range(3)] for j in (0, 1))
        above, below = [z for z in zs if z > r.elevation], [z for z in zs if z < r.elevation]
        at = lambda z: ts[zs.index(z)]  # noqa: B023, E731
        if above and below:
            hi, lo = min(above), max(below)
            want = at(lo) * (hi - r.elevation) / (hi - lo) + at(hi) * (r.elevation - lo) / (hi - lo)
        else:
            want = at(min(above)) if above else at(max(below))
        assert r.v == pytest.approx(want)


def test_stream_appends_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(T0 + dt.timedelta(hours=h), 1, float(h)) for h in (0, 1, 1, 2)], "time timestamp, cell int, v double")
    df.write.parquet(src)
    stream = append.deduplicated(append.arriving(spark, src, df.schema), ["time", "cell"])
    q = append.append_to(stream, out, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 3


def test_smoothing_keeps_a_constant(spark):
    dem = spark.createDataFrame([(r, c, None if (r, c) == (2, 2) else 7.0) for r in range(5) for c in range(5)], "r int, c int, elevation double")
    got = grids.smooth(dem).collect()
    assert len(got) == 24 and all(x["elevation"] == pytest.approx(7.0) for x in got)


def test_grid_trim_and_boxes(spark):
    assert grids.regular_grid(spark, 76.1, 42.1, 76.9, 42.9).count() == 9
    dem = spark.createDataFrame([(r, c, 1.0 if 1 <= r <= 2 and c == 3 else None) for r in range(4) for c in range(5)], "r int, c int, elevation double")
    assert rows(grids.trim_nodata(dem).select("r", "c")) == [(0, 0), (1, 0)]
    assert boxes.split((170, -1, -170, 1)) == [(170, -1, 180.0, 1), (-180.0, -1, -170, 1)]
    assert boxes.parse_crs("utm32n") == "EPSG:32632" and boxes.parse_crs(4326) == "EPSG:4326"
    with pytest.raises(ValueError):
        boxes.parse_crs("moon")


def test_best_k_finds_two_blobs(spark):
    px = spark.createDataFrame([(float(k % 5) * 0.01 + 10.0 * (k % 2),) for k in range(40)], "x double")
    assert grids.best_k(px, ["x"], [2, 3])[0][0] == 2


def test_sql_functions_are_inlined(spark):
    names = sql.register(spark)
    assert "wind_direction" in names
    df = spark.sql("SELECT wind_direction(CAST(id AS DOUBLE), -1D) AS d, lapse_temperature(280D, 0D, 1000D) AS t FROM range(3)")
    assert df.first()["d"] == 0.0 and df.first()["t"] == pytest.approx(273.5)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_page_arrays(spark):
    f = spark.createDataFrame([(1, T0 + dt.timedelta(hours=h), float(h // 24)) for h in range(48)], "unit_id int, time timestamp_ntz, temperature double")
    got = grids.hourly_to_page(f, {"temperature": 10.0}).first()
    assert got["temperature"] == [0, 10] and len(got["days"]) == 2


def test_features_that_are_missing(spark):
    px = units.terrain_features(spark.createDataFrame([(0, 0, 10.0, 90.0)], "r int, c int, slope double, aspect double"))
    assert units.feature_columns(px, ["sx", "sy", "svf"]) == ["sx", "sy"]
    with pytest.raises(ValueError, match="elevation"):
        units.feature_columns(px, ["elevation"])
