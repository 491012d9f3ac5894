"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitrogrid.llm.common import stored


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the smallest node of the component.

    Each round takes the smallest root among a node's neighbours and then the root's own root, so
    long chains shorten by half. A round is written to the shared folder before the next begins.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                  f"{label}-edges")
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("root")), label)
    while True:
        near = (
            both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("near")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        )
        least = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        following = stored(
            least.join(above, "root").select("node", "old", F.least("root", "top").alias("root")), label)
        changed = following.where("root <> old").limit(1).count()
        roots = following.select("node", "root")
        if not changed:
            return roots
