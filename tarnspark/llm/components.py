"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.llm._scratch import save


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the component's smallest node.

    Each round every node takes the least label among itself and its neighbours (a partial
    minimum before the shuffle, so that a node with many links is no hot task) and then the label of that
    label; labels fall along whole paths at once.  Rounds end when nothing changes.
    """
    both = links.select("a", "b").where("a != b")
    both = save(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # what a node learns is also true for the node that was its label
        told = hooked.where("old != label").groupBy(F.col("old").alias("told")).agg(F.min("label").alias("better"))
        hooked = hooked.join(told, F.col("node") == F.col("told"), "left").select("node", "old", F.least("label", F.coalesce("better", "label")).alias("label"))
        hooked = save(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("at"), F.col("label").alias("next"))
        new = save(hooked.join(jump, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        changed = new.where("old != label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components didn't settle")
