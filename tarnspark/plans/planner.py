"""From requested outputs to groups and to the inputs that they need.

Pure functions on names.  A group needs other groups and input variables; groups whose inputs are missing
fall away when nothing was asked for by name, and are an error when something was.
"""

from __future__ import annotations

from collections.abc import Iterable

#: Outputs by group, in the order of the output columns.
GROUP_OUTPUTS = {
    "temperature": ("temperature", "pressure"),
    "humidity": ("humidity_specific", "humidity_relative"),
    "wind": ("wind_speed", "wind_direction"),
    "radiation": ("shortwave_direct", "shortwave_diffuse", "longwave"),
    "precipitation": ("precipitation", "rainfall", "snowfall"),
}
OUTPUTS = tuple(o for group in GROUP_OUTPUTS.values() for o in group)
GROUP_OF = {o: g for g, outs in GROUP_OUTPUTS.items() for o in outs}
NEEDS_GROUPS = {"humidity": ("temperature",), "radiation": ("temperature",), "precipitation": ("temperature",)}
NEEDS_SURFACE = {
    "temperature": {"t2m", "sp", "z_surf"},
    "humidity": {"d2m", "sp"},
    "wind": {"u10", "v10"},
    "radiation": {"ssrd", "strd", "d2m"},
    "precipitation": {"tp"},
}
NEEDS_LEVELS = {"temperature": {"t", "z"}, "humidity": {"q", "z"}, "wind": {"u", "v", "z"}}


def closure(groups: Iterable[str]) -> set[str]:
    out, todo = set(), list(groups)
    while todo:
        g = todo.pop()
        if g not in out:
            out.add(g)
            todo += NEEDS_GROUPS.get(g, ())
    return out


def groups_of(outputs: Iterable[str] | None) -> set[str]:
    """The groups that give the outputs, with those they depend on; None stands for all outputs."""
    if outputs is None:
        return set(GROUP_OUTPUTS)
    unknown = [o for o in outputs if o not in GROUP_OF]
    if unknown:
        raise ValueError(f"unknown outputs: {', '.join(unknown)}")
    return closure(GROUP_OF[o] for o in outputs)


def required_variables(outputs: Iterable[str] | None, mode: str = "simple") -> tuple[set[str], set[str]]:
    """(surface variables, level variables) that the outputs need."""
    surface, levels = set(), set()
    for g in groups_of(outputs):
        own = set(NEEDS_SURFACE[g])
        if mode == "full" and g in NEEDS_LEVELS:
            levels |= NEEDS_LEVELS[g]
            own = {"t2m", "sp", "z_surf"} if g == "temperature" else set()
        surface |= own
    return surface, levels


def resolve_groups(outputs: Iterable[str] | None, available: set[str], mode: str = "simple") -> list[str]:
    """Groups to compute, temperature first, then by name."""
    wanted = groups_of(outputs)
    lacking = {}
    for g in wanted:
        need = NEEDS_SURFACE[g] if mode == "simple" or g not in NEEDS_LEVELS or g == "temperature" else set()
        if missing := need - available:
            lacking[g] = missing
    if lacking and outputs is not None:
        raise ValueError("; ".join(f"{g} needs {', '.join(sorted(m))}" for g, m in sorted(lacking.items())))
    kept = {g for g in wanted if not closure([g]) & set(lacking)}
    if not kept:
        raise ValueError("no output can be computed from the available variables")
    return sorted(kept, key=lambda g: (g != "temperature", g))
