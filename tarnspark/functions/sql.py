"""The kernels as SQL functions of a session: temporary functions whose bodies Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters and body; no Python runs on the executors.
FUNCTIONS = {
    "lapse_temperature": ("t DOUBLE, z_source DOUBLE, z_target DOUBLE", "t - 0.0065D * (z_target - z_source)"),
    "hypsometric_pressure": ("p DOUBLE, z_source DOUBLE, z_target DOUBLE, t_source DOUBLE, t_target DOUBLE", "p * exp(-9.80665D * (z_target - z_source) / (287.05D * ((t_source + t_target) / 2)))"),
    "saturation_vapor_pressure": ("t DOUBLE", "611.2D * exp(17.67D * (t - 273.15D) / (t - 29.65D))"),
    "specific_humidity": ("d2m DOUBLE, p DOUBLE", "0.622D * 611.2D * exp(17.67D * (d2m - 273.15D) / (d2m - 29.65D)) / (p - 0.378D * 611.2D * exp(17.67D * (d2m - 273.15D) / (d2m - 29.65D)))"),
    "wind_speed": ("u DOUBLE, v DOUBLE", "sqrt(u * u + v * v)"),
    "wind_direction": ("u DOUBLE, v DOUBLE", "pmod(degrees(atan2(-u, -v)), 360D)"),
    "rain_fraction": ("t DOUBLE", "CASE WHEN t >= 275.65D THEN 1D WHEN t <= 272.65D THEN 0D ELSE (t - 272.65D) / 3D END"),
    "water_year": ("d DATE, start_month INT", "year(d) + CASE WHEN start_month > 1 AND month(d) >= start_month THEN 1 ELSE 0 END"),
}
_RETURNS = {"water_year": "INT"}


def register(spark: SparkSession) -> list[str]:
    for name, (parameters, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {_RETURNS.get(name, 'DOUBLE')} RETURN {body}")
    return sorted(FUNCTIONS)
