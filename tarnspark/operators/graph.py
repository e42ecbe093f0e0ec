"""Graphs of catchments, points and raster labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.session import cut


def upstream_of(links: DataFrame) -> DataFrame:
    """(id, upstream): direct neighbours upstream from rows (id, downstream_id); null or '0' ends."""
    return links.where("downstream_id is not null and downstream_id != id").select(F.col("downstream_id").alias("id"), F.col("id").alias("upstream"))


def upstream_closure(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, upstream): all catchments that drain to each; paths double in length every round."""
    reach = cut(upstream_of(links).distinct())
    for _ in range(rounds):
        longer = reach.select("id", F.col("upstream").alias("m")).join(reach.select(F.col("id").alias("m"), "upstream"), "m").select("id", "upstream")
        new = cut(reach.unionByName(longer).distinct())
        if new.count() == reach.count():
            return new
        reach = new
    raise RuntimeError("the closure didn't settle")


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b) taken both ways."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("component")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = cut(hooked.join(jump, "component", "left").select("node", "old", F.coalesce("next", "component").alias("component")))
        labels = new.select("node", "component")
        if not new.where("old != component").limit(1).count():
            return labels
    raise RuntimeError("components didn't settle")


def point_groups(points: DataFrame, distance: float) -> DataFrame:
    """(node, component): single-linkage groups of points (node, x, y) at most ``distance`` apart.

    Points meet in cells of that side and the cells around, so only near ones are compared.
    """
    cell = lambda c: F.floor(F.col(c) / distance)
    own = points.withColumns({"cx": cell("x"), "cy": cell("y")})
    near = points.select(F.col("node").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(F.sequence(cell("x") - 1, cell("x") + 1)).alias("cx"), cell("y").alias("_cy"))
    near = near.select("b", "x2", "y2", "cx", F.explode(F.sequence(F.col("_cy") - 1, F.col("_cy") + 1)).alias("cy"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    edges = own.join(near, ["cx", "cy"]).where((F.col("node") < F.col("b")) & (F.sqrt(dx * dx + dy * dy) <= distance)).select(F.col("node").alias("a"), "b")
    return components(points, edges)


def label_components(labelled: DataFrame, label: str) -> DataFrame:
    """(r, c, label, part): connected pixels of equal label; ``part`` is the smallest pixel number of the part."""
    px = labelled.select("r", "c", label, (F.col("r").cast("long") * (1 << 31) + F.col("c")).alias("node"))
    other = px.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col(label).alias("l2"), F.col("node").alias("b"))
    step = px.select(F.col("node").alias("a"), label, F.explode(F.array(F.struct(F.col("r").alias("r2"), (F.col("c") + 1).alias("c2")), F.struct((F.col("r") + 1).alias("r2"), F.col("c").alias("c2")))).alias("d")).select("a", label, "d.r2", "d.c2")
    edges = step.join(other, ["r2", "c2"]).where(F.col(label) == F.col("l2")).select("a", "b")
    return px.join(components(px.select("node"), edges), "node").select("r", "c", label, F.col("component").alias("part"))
