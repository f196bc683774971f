"""Connected components of an edge table, in DataFrame operations only.

Smallest-label hooking with pointer jumping: in each round every root takes the
smallest label next to its members, then every node takes its label's label. Rounds
grow with the logarithm of a component's diameter. Each round is cut off by
``checkpoint()`` in the folder that ``spark.checkpoint.dir`` names, so lost executors
cost one round at most. Nothing but two counts reaches the driver.

A node that holds a third of all edges only meets equi-joins of checkpointed
tables (which adaptive execution can split) and aggregates with partial results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kredenz.runtime import pin


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(u, v)``; the label is the smallest node reachable.

    Null ends and loops are left out; an empty table gives no rows. Repeated edges
    count once.
    """
    ends = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    links = pin(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = pin(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select(
        "node", F.least("node", "near").alias("label")
    ))
    if labels.isEmpty():
        return labels
    while True:
        at = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = pin(labels.join(at, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")))
        of_u = jumped.select(F.col("node").alias("u"), F.col("label").alias("a"))
        of_v = jumped.select(F.col("node").alias("v"), F.col("label").alias("b"))
        half = pin(links.join(of_u, "u").select("v", "a").distinct())
        hooks = pin(half.join(of_v, "v").where("b < a").groupBy(F.col("a").alias("label")).agg(F.min("b").alias("less")))
        if hooks.isEmpty():
            if jumped.where("moved").isEmpty():
                return jumped.select("node", "label")
            labels = jumped.select("node", "label")
            continue
        labels = pin(jumped.select("node", "label").join(hooks, "label", "left").select(
            "node", F.coalesce("less", "label").alias("label")
        ))
