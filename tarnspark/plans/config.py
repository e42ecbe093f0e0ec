"""A run's specification: plain dataclasses with validation, built from nested dicts (parsed YAML)."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from tarnspark.operators.downscale import Settings
from tarnspark.plans.planner import GROUP_OF, resolve_groups

#: Sections that are accepted and have no effect here.
IGNORED = frozenset({"forecast", "blending", "assimilation", "climate", "calibration", "hydrology", "glacier", "application", "validation_lab", "slurm", "feedback"})


@dataclass(frozen=True)
class Domain:
    bbox: tuple[float, float, float, float] | None = None
    dem: str | None = None
    spatial_mode: str = "clusters"

    def __post_init__(self) -> None:
        if self.bbox is None and self.dem is None:
            raise ValueError("a domain needs a bbox or a dem")
        if self.spatial_mode not in ("clusters", "polygons", "points", "catchments"):
            raise ValueError(f"spatial_mode {self.spatial_mode!r} is not supported")
        if self.bbox is not None:
            west, south, east, north = self.bbox
            if not (-180 <= west <= 180 and -180 <= east <= 180 and -90 <= south < north <= 90):
                raise ValueError("bbox is west, south, east, north in degrees")


@dataclass(frozen=True)
class Clustering:
    n_clusters: int = 50
    method: str = "kmeans"
    features: tuple[str, ...] = ("elevation", "slope", "cos_aspect", "sin_aspect", "svf")
    weights: tuple[float, ...] | None = None
    seed: int = 42

    def __post_init__(self) -> None:
        if self.method != "kmeans":
            raise ValueError("the clustering method is kmeans")
        if self.weights is not None and len(self.weights) != len(self.features):
            raise ValueError("one weight for each feature")


@dataclass(frozen=True)
class Input:
    source: str = "era5"
    surface: str = ""
    levels: str | None = None
    start: str = ""
    end: str = ""
    time_resolution: str = "1H"

    def __post_init__(self) -> None:
        if self.time_resolution not in ("1H", "2H", "3H", "6H"):
            raise ValueError("time_resolution is 1H, 2H, 3H or 6H")
        if self.start and self.end and self.start > self.end:
            raise ValueError("start is after end")


@dataclass(frozen=True)
class Output:
    path: str = ""
    format: str = "parquet"
    variables: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.format not in ("parquet", "csv", "fsm", "fsm2", "smet", "crocus", "cryogrid", "snowpack", "safran"):
            raise ValueError(f"unknown output format {self.format!r}")
        if unknown := [v for v in self.variables or () if v not in GROUP_OF]:
            raise ValueError(f"unknown variables: {', '.join(unknown)}")


@dataclass(frozen=True)
class Config:
    domain: Domain
    input: Input = field(default_factory=Input)
    clustering: Clustering = field(default_factory=Clustering)
    downscaling: Settings = field(default_factory=Settings)
    output: Output = field(default_factory=Output)

    @classmethod
    def from_dict(cls, given: Mapping[str, Any]) -> Config:
        kinds = {"domain": Domain, "input": Input, "clustering": Clustering, "downscaling": Settings, "output": Output}
        parts = {}
        for name, section in given.items():
            if name in IGNORED:
                warnings.warn(f"section {name!r} has no effect", stacklevel=2)
            elif name not in kinds:
                raise ValueError(f"unknown section {name!r}")
            else:
                parts[name] = build(kinds[name], section)
        return cls(**parts)

    def groups(self, available: set[str]) -> list[str]:
        return resolve_groups(self.output.variables, available, self.downscaling.mode)


def build(kind: type, section: Mapping[str, Any]):
    known = {f.name: f for f in fields(kind)}
    if unknown := [k for k in section if k not in known]:
        raise ValueError(f"{kind.__name__}: unknown keys {', '.join(unknown)}")
    made = {k: tuple(v) if isinstance(v, list) else v for k, v in section.items()}
    assert is_dataclass(kind)
    return kind(**made)


def pressure_mode(config: Config) -> str:
    return "full" if config.input.levels else "simple"
