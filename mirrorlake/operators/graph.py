"""Graph operators by rounds of joins; every round is deduplicated and its lineage cut."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: list[str] = []
#: Folders written to the shared one, and the session that can remove them.
_WRITTEN: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    for path in _LOCAL:
        shutil.rmtree(path, ignore_errors=True)
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):  # a session that has ended can't be asked; the folder is then its owner's to remove
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(frame: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder (spark.checkpoint.dir) and read back.  The folder is removed when the driver's Python ends.

    Where none is set a local session makes its own folder; on a cluster there is none that all share, and this raises.
    """
    spark = frame.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="mirrorlake-"))
        root = _LOCAL[0]
    path, schema = f"{root.rstrip('/')}/cut-{uuid.uuid4().hex}", frame.schema
    if not _LOCAL:
        _WRITTEN.append((spark, path))
    frame.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): every node that a root reaches, itself included.  ``edges``: src, dst; ``roots``: root.

    Each round writes its new rows only; cycles end, since only new rows go on.
    """
    edges = cut(edges.select("src", "dst").distinct())
    seen = front = cut(roots.select("root", F.col("root").alias("node")).distinct())
    while True:
        step = front.join(edges, front.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, ["root", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionAll(front)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over undirected ``edges`` (a, b).

    Every node hooks to its least neighbour if that is lesser, hooks are followed to their ends by doubling, and the edges
    are contracted: a round leaves local minima only, at most half of the nodes that still have an edge.
    """
    every = cut(edges.select("a", "b").distinct())
    left = cut(every.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not left.isEmpty():
        hooks = cut(left.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("y")))
        while True:
            beyond = hooks.select(F.col("x").alias("y"), F.col("y").alias("z"))
            twice = cut(hooks.join(beyond, "y", "left").select("x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("moved")))
            hooks = twice.select("x", "y")
            if twice.where("moved").isEmpty():
                break
        rounds.append(hooks)
        ends = left
        for side in ("a", "b"):
            ends = ends.join(hooks.select(F.col("x").alias(side), F.col("y").alias(f"to_{side}")), side, "left").withColumn(side, F.coalesce(f"to_{side}", side)).drop(f"to_{side}")
        left = cut(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = every.select(F.col("a").alias("node")).union(every.select("b")).distinct().withColumn("component", F.col("node"))
    for hooks in rounds:
        labels = labels.join(hooks.withColumnRenamed("x", "component"), "component", "left").select("node", F.coalesce("y", "component").alias("component"))
    return cut(labels)


def colours(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """Colour refinement: a node's colour becomes the hash of its own and of its successors' sorted colours.  ``nodes``: node, colour."""
    for _ in range(rounds):
        around = edges.join(nodes.select(F.col("node").alias("dst"), F.col("colour").alias("c")), "dst").groupBy(F.col("src").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("around"))
        nodes = cut(nodes.join(around, "node", "left").select("node", F.md5(F.concat_ws("|", "colour", F.coalesce("around", F.lit("")))).alias("colour")))
    return nodes


def dominators(edges: DataFrame, root: int) -> DataFrame:
    """(graph, node, dominator): immediate dominators of what ``root`` reaches.  ``edges``: graph, src, dst.

    One artifact is one graph and one task; artifacts are spread over the cluster.
    """

    def solve(table):
        import pandas as pd

        after: dict[int, list[int]] = {}
        for s, t in zip(table["src"].tolist(), table["dst"].tolist(), strict=True):
            after.setdefault(s, []).append(t)
        order, seen, stack = [], {root}, [(root, iter(sorted(after.get(root, []))))]
        while stack:
            node, rest = stack[-1]
            nxt = next((t for t in rest if t not in seen), None)
            if nxt is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(sorted(after.get(nxt, [])))))
        rank = {n: i for i, n in enumerate(order)}
        before: dict[int, list[int]] = {}
        for s in order:
            for t in after.get(s, []):
                before.setdefault(t, []).append(s)
        above = {root: root}
        changed = True
        while changed:
            changed = False
            for n in reversed(order[:-1]):
                best = None
                for p in before.get(n, []):
                    if p in above:
                        q = p
                        if best is None:
                            best = q
                        while best != q:
                            if rank[best] < rank[q]:
                                best = above[best]
                            else:
                                q = above[q]
                if best != above.get(n):
                    above[n], changed = best, True
        rows = [(n, a) for n, a in above.items() if n != root]
        return pd.DataFrame({"graph": table["graph"].iloc[0], "node": [r[0] for r in rows], "dominator": [r[1] for r in rows]})

    return edges.groupBy("graph").applyInPandas(solve, "graph long, node long, dominator long")


def retained(tree: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, retained): bytes of a node and of all that it dominates.  ``tree``: node, dominator; ``sizes``: node, bytes.

    By doubling: sums over what lies less than k steps below a node, and ancestors k steps above, give those for 2k.
    Rounds are the logarithm of the tree's depth, and a round's rows are its nodes.
    """
    above = cut(tree.select("node", F.col("dominator").alias("up")).where("node <> up"))
    nodes = above.select("node").union(above.select("up")).distinct()
    sums = cut(nodes.join(sizes, "node", "full_outer").select("node", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")))
    while not above.isEmpty():
        below = above.join(sums, "node").groupBy(F.col("up").alias("node")).agg(F.sum("bytes").alias("more"))
        sums = cut(sums.join(below, "node", "left").select("node", (F.col("bytes") + F.coalesce("more", F.lit(0))).alias("bytes")))
        above = cut(above.join(above.select(F.col("node").alias("up"), F.col("up").alias("upper")), "up").select("node", F.col("upper").alias("up")))
    return sums.join(sizes.select("node"), "node", "left_semi").select("node", F.col("bytes").alias("retained"))
