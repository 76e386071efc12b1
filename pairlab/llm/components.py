"""Connected components of a link table, by joins and partial aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of one orderable type → (node, root): the smallest node reachable, for every node with a link.

    Each round every node takes the smallest root among its neighbours' roots,
    hooks it also onto its own root, and shortcuts; rounds end when no root
    changes.  No step gathers a node's neighbours: hot nodes are met only in
    equi-joins, which Spark may split, and in minima, which combine before the
    shuffle.  State is written to the shared folder each round.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter(F.col("a") != F.col("b")).distinct())
    state = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        seen = state.join(near, "node")
        hooks = seen.filter(F.col("near") < F.col("root")).select(F.col("root").alias("node"), F.col("near").alias("root"))
        lowered = (
            seen.select("node", F.least("root", "near").alias("root")).union(hooks).groupBy("node").agg(F.min("root").alias("root"))
        )
        up = lowered.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = lowered.join(up, "root", "left").select("node", F.coalesce(F.least("root", "up"), "root").alias("root"))
        changed_state = staged(jumped.join(state.select("node", F.col("root").alias("old")), "node").select("node", "root", (F.col("root") != F.col("old")).alias("changed")))
        state = changed_state.select("node", "root")
        if changed_state.filter("changed").isEmpty():
            return state
