"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedtide.session import materialise

MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of an edge (a, b); component is the smallest node reachable.

    Every round hands each node the smallest label among its neighbours and then the label of its label,
    so paths halve. Rounds end when no label changes; labels are written to the shared folder in between.
    Hubs are joined as rows and summed map-side, so no neighbourhood is gathered in one place.
    """
    both = materialise(
        edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct()
    )
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("low"))
                         .select(F.col("a").alias("node"), F.least("a", "low").alias("component")))
    for _ in range(MAX_ROUNDS):
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("low"))
        near = labels.join(seen, labels["node"] == seen["a"]).select(
            "node", F.col("component").alias("old"), F.least("component", "low").alias("near")
        )
        far = labels.select(F.col("node").alias("via"), F.col("component").alias("beyond"))
        moved = materialise(
            near.join(far, near["near"] == far["via"], "left")
            .select("node", "old", F.least("near", F.coalesce("beyond", "near")).alias("component"))
        )
        labels = moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
