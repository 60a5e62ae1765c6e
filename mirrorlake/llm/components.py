"""Connected components of a table of links, by rounds of hooking and pointer jumping.

Every round joins small tables by key and writes its labels to the shared folder, so the lineage stays
short and a lost executor costs one round.  Links and labels never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(links: DataFrame, root: str) -> DataFrame:
    """``links``: a, b (long).  Gives node, component (the least node reachable) for every node of a link."""
    spark = links.sparkSession
    edges = settle(spark, links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{root}/edges")
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a"))
    labels = settle(spark, both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), f"{root}/labels-0")
    turn = 0
    while True:
        turn += 1
        left, right = labels.select(F.col("node").alias("a"), F.col("component").alias("x")), labels.select(F.col("node").alias("b"), F.col("component").alias("y"))
        between = edges.join(left, "a").join(right, "b").where("x <> y").select("x", "y").distinct()
        # a label can itself be a node that has moved on: following labels of labels is part of the round
        jumps = labels.select(F.col("node").alias("x"), F.col("component").alias("y")).where("x <> y")
        hooks = between.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).unionAll(jumps).groupBy("x").agg(F.min("y").alias("y"))
        hooks = settle(spark, hooks, f"{root}/hooks-{turn}")
        twice = hooks.join(hooks.select(F.col("x").alias("y"), F.col("y").alias("z")), "y", "left").select("x", F.coalesce("z", "y").alias("to"))
        moved = labels.join(twice.withColumnRenamed("x", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"), (F.col("to").isNotNull()).alias("moved"))
        labels = settle(spark, moved, f"{root}/labels-{turn}")
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
