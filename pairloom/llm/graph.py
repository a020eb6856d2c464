"""Connected components by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.storage import stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node in ``links`` with root the smallest node it can reach.

    Links never change, so a node keeps its small degree and no join meets a growing star.
    Each round hangs a root below the smallest root across a link (one row per root, summed
    before the shuffle), then halves the depth until every node names its root. The jump joins
    many nodes with one parent, both sides read from stored tables, so that adaptive execution
    can split it. Null ends and loops are left out; no links give no rows.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = stored(links.select(lo.alias("a"), hi.alias("b")).distinct())
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = stored(nodes.withColumn("root", F.col("node")))
    while True:
        of_a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        across = links.join(of_a, "a").join(of_b, "b").where("ra <> rb")
        hooks = stored(
            across.select(F.greatest("ra", "rb").alias("node"), F.least("ra", "rb").alias("below"))
            .groupBy("node")
            .agg(F.min("below").alias("below"))
        )
        if hooks.isEmpty():
            return labels
        labels = stored(
            labels.join(hooks, "node", "left").select("node", F.coalesce("below", "root").alias("root"))
        )
        while True:
            up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = stored(labels.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            labels = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
