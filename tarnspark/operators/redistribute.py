"""Snow redistribution by wind and by avalanches over a table of neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def eroded_mass(cells: DataFrame, coefficient: float = 0.001) -> DataFrame:
    """One row: the mass that wind takes from all exposed cells; nothing is dealt out if it is 0."""
    lost = F.least(F.greatest("sx", F.lit(0.0)) * F.col("wind") * F.col("swe") * coefficient, "swe")
    return cells.agg(F.sum(lost * F.col("area")).alias("mass"))


def wind_transport(cells: DataFrame, edges: DataFrame, coefficient: float = 0.001) -> DataFrame:
    """(i, swe): exposed cells lose snow, sheltered neighbours gain it.

    ``cells``: i, swe, sx, wind, area; ``edges``: i, j, weight.  A cell's mass goes to its neighbours by weight and shelter,
    by weight alone if none is sheltered, and leaves the domain without neighbours.
    """
    lost = F.least(F.greatest("sx", F.lit(0.0)) * F.col("wind") * F.col("swe") * coefficient, "swe")
    eroded = cells.withColumn("erosion", lost)
    out = edges.join(eroded.where("erosion > 0").select("i", (F.col("erosion") * F.col("area")).alias("mass")), "i")
    out = out.join(cells.select(F.col("i").alias("j"), F.greatest(-F.col("sx"), F.lit(0.0)).alias("shelter"), F.col("area").alias("area_j")), "j")
    share = F.col("weight") * F.col("shelter")
    total = F.sum(share).over(Window.partitionBy("i"))
    part = F.when(total > 0, share / total).otherwise(F.col("weight"))
    gained = out.select("j", (F.col("mass") * part / F.col("area_j")).alias("d")).groupBy(F.col("j").alias("i")).agg(F.sum("d").alias("d"))
    return eroded.join(gained, "i", "left").select("i", (F.col("swe") - F.col("erosion") + F.coalesce("d", F.lit(0.0))).alias("swe"))


def avalanche(cells: DataFrame, edges: DataFrame, domain: str, threshold: float = 30.0) -> DataFrame:
    """(i, swe) after one pass in the order of i: a steep cell passes a part of its snow on, and later cells pass on what they got.

    The pass is sequential by definition: a cell moves what all cells before it passed on.  Cells that no edge connects to others are domains of
    their own, and each domain is one group, as large as its cells are many; ``cells``: domain, i, swe, slope, area; ``edges``: domain, i, j, flow.
    """

    def run(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("i")
        at = {i: k for k, i in enumerate(own["i"])}
        swe, area, slope = own["swe"].to_numpy(float).copy(), own["area"].to_numpy(float), own["slope"].to_numpy(float)
        onward: dict[int, list[tuple[int, float]]] = {}
        for i, j, f in links.sort_values(["i", "slot"])[["i", "j", "flow"]].itertuples(index=False):
            if f > 0 and j in at and i in at:
                onward.setdefault(at[i], []).append((at[j], f))
        for k in range(len(own)):
            moved = swe[k] * min(1.0, max(0.0, slope[k] - threshold) / threshold)
            if slope[k] > threshold and moved > 0 and (targets := onward.get(k)):
                swe[k] -= moved
                for j, f in targets:
                    swe[j] += moved * area[k] * f / area[j]
        return pd.DataFrame({"i": own["i"], "swe": swe})

    edges = edges.toDF(*edges.columns)  # both sides may come from one table
    return cells.groupBy(domain).cogroup(edges.groupBy(domain)).applyInPandas(run, "i long, swe double")
