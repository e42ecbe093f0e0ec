"""Boxes (west, south, east, north) in degrees, and coordinate systems by name."""

from __future__ import annotations

Box = tuple[float, float, float, float]


def pad(box: Box, degrees: float) -> Box:
    west, south, east, north = box
    return west - degrees, max(-90.0, south - degrees), east + degrees, min(90.0, north + degrees)


def to_360(box: Box) -> Box:
    west, south, east, north = box
    return west % 360, south, east % 360, north


def north_west_south_east(box: Box) -> tuple[float, float, float, float]:
    """The order of area requests."""
    west, south, east, north = box
    return north, west, south, east


def crosses_antimeridian(box: Box) -> bool:
    return box[0] > box[2]


def split(box: Box) -> list[Box]:
    """The box as one or two that don't cross the antimeridian."""
    west, south, east, north = box
    return [(west, south, 180.0, north), (-180.0, south, east, north)] if crosses_antimeridian(box) else [box]


PRESETS = {"wgs84": "EPSG:4326", "latlon": "EPSG:4326", "web": "EPSG:3857"}


def parse_crs(name: str | int) -> str:
    """EPSG code of a preset, a number or a code; UTM as ``utm32n``."""
    text = str(name).strip().lower()
    if text in PRESETS:
        return PRESETS[text]
    if text.startswith("utm") and text[-1] in "ns" and text[3:-1].isdigit() and 1 <= int(text[3:-1]) <= 60:
        return f"EPSG:{(326 if text[-1] == 'n' else 327) * 100 + int(text[3:-1])}"
    digits = text.removeprefix("epsg:")
    if digits.isdigit():
        return f"EPSG:{int(digits)}"
    raise ValueError(f"unknown coordinate system {name!r}")


def is_geographic(crs: str) -> bool:
    return parse_crs(crs) == "EPSG:4326"
