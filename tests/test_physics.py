"""Known values, limits and conservation of the kernels."""

import math

import pytest
from pyspark.sql import functions as F

from tarnspark.functions import physics as ph


def value(spark, *columns):
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    return row[0] if len(columns) == 1 else tuple(row)


L = F.lit


def test_lapse_rate_cools_upwards(spark):
    assert value(spark, ph.simple_lapse_rate(L(280.0), L(1000.0), L(2000.0))) == pytest.approx(273.5)


def test_pressure_falls_with_height(spark):
    p = value(spark, ph.hypsometric_pressure(L(85000.0), L(1500.0), L(2500.0), L(280.0), L(273.5)))
    assert p == pytest.approx(85000 * math.exp(-9.80665 * 1000 / (287.05 * 276.75)))


def test_phase_conserves_mass(spark):
    for t, rain in ((270.0, 0.0), (280.0, 2.0), (274.15, 1.0)):
        got = value(spark, *ph.phase_partition(L(2.0), L(t)))
        assert sum(got) == pytest.approx(2.0) and got[0] == pytest.approx(rain)


def test_shortwave_conserves_energy(spark):
    for kt in (0.1, 0.5, 0.9):
        direct, diffuse = value(spark, *ph.partition_shortwave(L(500.0), L(30.0), L(kt)))
        assert direct + diffuse == pytest.approx(500.0) and direct >= 0
    assert value(spark, *ph.partition_shortwave(L(5.0), L(-1.0), L(0.5))) == (0.0, 5.0)


def test_wet_bulb_solves_the_psychrometer_equation(spark):
    t, p, q = 285.0, 85000.0, 0.004
    w = value(spark, ph.wet_bulb(L(t), L(p), L(q)))
    es = 611.2 * math.exp(17.67 * (w - 273.15) / (w - 29.65))
    e = q * p / (0.622 + 0.378 * q)
    assert w <= t and abs(es - 1004 * p / (0.622 * 2.501e6) * (t - w) - e) < 1e-6


def test_wind_direction_is_where_it_comes_from(spark):
    assert value(spark, ph.wind_direction(L(0.0), L(-5.0))) == pytest.approx(0.0)
    assert value(spark, ph.wind_direction(L(-5.0), L(0.0))) == pytest.approx(90.0)


def test_log_profile_is_zero_under_the_displacement(spark):
    assert value(spark, ph.log_profile(L(5.0), 10.0, 10.0, 0.03, 1.0, 0.0, 10.0)) == 0.0
    assert value(spark, ph.log_profile(L(5.0), 10.0, 10.0, 0.03, 0.03, 0.0, 0.0)) == pytest.approx(5.0)


def test_null_stays_null(spark):
    n = L(None).cast("double")
    got = value(spark, ph.clip(n, 0.0, 1.0), ph.relative_humidity(n, L(280.0)), ph.longwave_correction(n, L(280.0), L(280.0), L(800.0), L(800.0), L(1.0)), ph.wet_bulb(n, L(8e4), L(0.003)), ph.transport_rate(n, L(1.0)), ph.winstral_wind(n, L(1.0)))
    assert got == (None,) * 6


def test_sun_at_noon_on_the_equator(spark):
    e, _ = value(spark, *ph.solar_geometry(F.to_timestamp(L("2024-03-21 12:00:00")), L(0.0), L(0.0)))
    assert e > 87


def test_slope_facing_the_sun_gets_more(spark):
    flat = value(spark, ph.slope_correction(L(300.0), L(30.0), L(180.0), L(0.0), L(0.0)))
    south = value(spark, ph.slope_correction(L(300.0), L(30.0), L(180.0), L(30.0), L(180.0)))
    north = value(spark, ph.slope_correction(L(300.0), L(30.0), L(180.0), L(60.0), L(0.0)))
    assert flat == pytest.approx(300.0) and south > flat and north == 0.0


def test_water_year(spark):
    for day, wy, n in (("2023-08-31", 2023, 364), ("2023-09-01", 2024, 0), ("2024-08-31", 2024, 365)):
        assert value(spark, ph.water_year(F.to_date(L(day))), ph.day_of_water_year(F.to_date(L(day)))) == (wy, n)


def test_int16_rounds_half_to_even(spark):
    assert value(spark, ph.pack_int16(L(0.5), 1.0), ph.pack_int16(L(1.5), 1.0), ph.pack_int16(L(1e9), 1.0), ph.pack_int16(L(None).cast("double"), 1.0)) == (0, 2, 32767, -32768)


def test_resolution_factor(spark):
    assert value(spark, ph.resolution_factor(L(50.0), L(100.0))) == 0.1
    assert value(spark, ph.resolution_factor(L(31000.0), L(100.0), "log")) == pytest.approx(0.1 + 0.9 * math.log10(310) / 3)
