"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Every round takes the least label of the neighbours and then that label's own label, so long chains
    shrink by more than half. A round is written to the shared folder, so a lost executor costs one round.
    Null ends are left out; no edges, no rows.
    """
    both = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b")
    links = cut_lineage(both.union(both.select("b", "a")).distinct(), "links")
    labels = cut_lineage(links.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        fresh = labels.join(near, labels.node == near.a).select("node", "component", F.least("component", "near").alias("next"))
        own = labels.select(F.col("node").alias("top"), F.col("component").alias("further"))
        moved = fresh.join(own, fresh.next == own.top).select("node", F.least("next", "further").alias("component"), (F.least("next", "further") < F.col("component")).alias("changed"))
        done = cut_lineage(moved, "labels")
        labels = done.select("node", "component")
        if done.filter("changed").isEmpty():
            return labels
