"""Byte accounting over symbols and the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Duck, Spark
from ..operators import graph
from ..registry import register
from ..sources.relations import calls, symbols, units
from .sql import run, sql


@sql("duplicate_bytes", symbols)
def duplicate_bytes(d) -> str:
    return "SELECT content, count(*) AS copies, CAST(sum(bytes) - max(bytes) AS BIGINT) AS duplicated FROM symbols WHERE bytes > 0 GROUP BY content HAVING count(*) > 1"


@sql("duplicate_segments", units)
def duplicate_segments(d) -> str:
    return "SELECT md5(line) AS content, count(*) AS copies, CAST(sum(extent) - max(extent) AS BIGINT) AS duplicated FROM units WHERE extent >= 16 GROUP BY md5(line) HAVING count(*) > 1"


@sql("size_categories", symbols)
def size_categories(d) -> str:
    # what wasn't measured is null, never 0
    return """SELECT CAST(sum(bytes) AS BIGINT) AS observed, CAST((SELECT sum(x) FROM (SELECT sum(bytes) - max(bytes) AS x FROM symbols GROUP BY content) g) AS BIGINT) AS duplicated, CAST(sum(CASE WHEN class LIKE 'PROMO%' THEN bytes END) AS BIGINT) AS normalized FROM symbols"""


@sql("ownership_rollup", symbols)
def ownership_rollup(d) -> str:
    return """SELECT owner, class, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS symbols_ FROM symbols WHERE symbol % 10 <> 0 GROUP BY owner, class
UNION ALL SELECT 'outside symbols', 'remainder', CAST(sum(CASE WHEN symbol % 10 = 0 THEN bytes ELSE 0 END) AS BIGINT), count_if(symbol % 10 = 0) FROM symbols"""


@sql("attributed_bytes", symbols)
def attributed_bytes(d) -> str:
    # null unless every member but the canonical one is attributed
    return """SELECT content, CASE WHEN count_if(r > 1) = count_if(r > 1 AND symbol % 10 <> 0) THEN CAST(sum(CASE WHEN r > 1 THEN bytes ELSE 0 END) AS BIGINT) ELSE -1 END AS attributed FROM (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY symbol) AS r FROM symbols) s GROUP BY content HAVING count(*) > 1"""


@sql("line_proportional_bytes")
def line_proportional_bytes(d) -> str:
    return """SELECT p, f, round(p_size * covered * 1e0 / extent, 6) AS bytes FROM (SELECT l_partkey AS p, l_suppkey AS f, max(l_linenumber) - min(l_linenumber) + 1 AS covered, sum(max(l_linenumber) - min(l_linenumber) + 1) OVER (PARTITION BY l_partkey) AS extent FROM lineitem GROUP BY l_partkey, l_suppkey) x JOIN part ON p = p_partkey"""


@sql("fanout_units")
def fanout_units(d) -> str:
    return "SELECT p_name, count(*) AS bodies, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY p_name HAVING count(*) > 1"


@sql("edge_corroboration", calls)
def edge_corroboration(d) -> str:
    return "SELECT src, dst, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = c.src AND l.l_suppkey = c.dst % 100) AS corroborated FROM calls c"


@sql("evidence_merge")
def evidence_merge(d) -> str:
    return """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'first' WHEN a.k IS NULL THEN 'second' WHEN a.v = b.v THEN 'reinforced' ELSE 'conflict' END AS state FROM (SELECT l_orderkey AS k, min(l_suppkey) AS v FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey) a
FULL OUTER JOIN (SELECT l_orderkey AS k, min(l_suppkey) AS v FROM lineitem WHERE l_linenumber >= 2 GROUP BY l_orderkey) b ON a.k = b.k"""


@sql("origin_join")
def origin_join(d) -> str:
    return "SELECT p_partkey AS instance, o.origin FROM part p JOIN (SELECT lower(p_name) AS k, min(p_partkey) AS origin FROM part GROUP BY lower(p_name)) o ON lower(p.p_name) = o.k"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, calls(Spark())).select(F.col("src").cast("long"), F.col("dst").cast("long"))


REACHED = f"WITH RECURSIVE calls AS ({calls(Duck())}), reached(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT c.dst FROM calls c JOIN reached r ON c.src = r.node)"


@register("reachable_nodes", f"{REACHED} SELECT node FROM reached")
def reachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(_calls(spark, sf_dir), spark.range(1, 2).toDF("root")).select("node")


@register("dead_nodes", f"{REACHED} SELECT p_partkey AS node, CAST(p_size AS BIGINT) AS bytes FROM part WHERE NOT EXISTS (SELECT 1 FROM reached r WHERE r.node = p_partkey)")
def dead_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = graph.reach(_calls(spark, sf_dir), spark.range(1, 2).toDF("root")).select(F.col("node").alias("p_partkey"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").join(reached, "p_partkey", "left_anti").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("bytes"))


@register(
    "shared_bytes",
    f"""WITH RECURSIVE calls AS ({calls(Duck())}), reached(root, node) AS (SELECT r, r FROM (SELECT CAST(2 AS BIGINT) AS r UNION ALL SELECT 3 UNION ALL SELECT 4) x UNION SELECT r.root, c.dst FROM calls c JOIN reached r ON c.src = r.node)
SELECT n_roots, count(*) AS nodes, CAST(sum(p_size) AS BIGINT) AS bytes FROM (SELECT node, count(DISTINCT root) AS n_roots FROM reached GROUP BY node) g JOIN part ON node = p_partkey WHERE n_roots > 1 GROUP BY n_roots""",
)
def shared_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = graph.reach(_calls(spark, sf_dir), spark.range(2, 5).toDF("root"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    per = pairs.groupBy("node").agg(F.countDistinct("root").alias("n_roots")).where("n_roots > 1")
    return per.join(part, per.node == part.p_partkey).groupBy("n_roots").agg(F.count("*").alias("nodes"), F.sum("p_size").cast("long").alias("bytes"))


UNDIRECTED = "SELECT DISTINCT src AS a, dst AS b FROM calls WHERE src <> dst"


@register(
    "connected_components",
    f"""WITH RECURSIVE calls AS ({calls(Duck())}), e AS ({UNDIRECTED}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.other = u.a)
SELECT node, min(other) AS component FROM r GROUP BY node""",
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_calls(spark, sf_dir).where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())


def _colour_oracle(rounds: int) -> str:
    text = f"WITH calls AS ({calls(Duck())}), c0 AS (SELECT p_partkey AS node, md5(p_type) AS colour FROM part)"
    for k in range(1, rounds + 1):
        text += f""", c{k} AS (SELECT n.node, md5(n.colour || '|' || coalesce(a.around, '')) AS colour FROM c{k - 1} n LEFT JOIN (
  SELECT e.src AS node, array_to_string(list_sort(list(c.colour)), ',') AS around FROM calls e JOIN c{k - 1} c ON e.dst = c.node GROUP BY e.src) a ON n.node = a.node)"""
    return f"{text} SELECT colour, count(*) AS nodes, min(node) AS first_node FROM c{rounds} GROUP BY colour"


@register("wl_colours", _colour_oracle(3))
def wl_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node"), F.md5("p_type").alias("colour"))
    return graph.colours(_calls(spark, sf_dir), nodes, 3).groupBy("colour").agg(F.count("*").alias("nodes"), F.min("node").alias("first_node"))


#: Dominators by removal: a node dominates what can't be reached from 1 without it; ``depth`` is how many dominate a node.
DOMINATED = f"""WITH RECURSIVE calls AS ({calls(Duck())}), reached(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT c.dst FROM reached r JOIN calls c ON c.src = r.node),
away(gone, node) AS (SELECT node, CAST(1 AS BIGINT) FROM reached WHERE node <> 1 UNION SELECT a.gone, c.dst FROM away a JOIN calls c ON c.src = a.node AND c.dst <> a.gone),
dom AS (SELECT d.node AS d, n.node AS n FROM reached d CROSS JOIN reached n ANTI JOIN away ON away.gone = d.node AND away.node = n.node), depth AS (SELECT n AS d, count(*) AS depth FROM dom GROUP BY n)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dominators(_calls(spark, sf_dir).withColumn("graph", F.lit(1).cast("long")), 1).select("node", "dominator")


@register("immediate_dominators", f"{DOMINATED} SELECT n AS node, arg_max(dom.d, depth) AS dominator FROM dom JOIN depth ON dom.d = depth.d WHERE n <> dom.d GROUP BY n")
def immediate_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir)


@register("retained_sizes", f"{DOMINATED} SELECT d AS node, CAST(sum(p_size) AS BIGINT) AS retained FROM dom JOIN part ON n = p_partkey GROUP BY d")
def retained_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = graph.cut(_tree(spark, sf_dir))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("bytes"))
    inside = tree.select("node").unionAll(tree.select("dominator")).distinct()
    return graph.retained(tree, part.join(inside, "node", "left_semi"))


@register(
    "toolchain_holders",
    f"""{DOMINATED} SELECT holder, count(*) AS nodes, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT n, max(t.p_size) AS bytes, arg_max(dom.d, depth) AS holder
  FROM dom JOIN depth ON dom.d = depth.d JOIN part t ON n = t.p_partkey AND t.p_brand = 'Brand#2' JOIN part h ON dom.d = h.p_partkey WHERE n <> dom.d AND (h.p_brand <> 'Brand#2' OR dom.d = 1) GROUP BY n) x GROUP BY holder""",
)
def toolchain_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest dominator outside the toolchain (one brand) of each of its nodes, by rounds down the dominator tree."""
    tree = graph.cut(_tree(spark, sf_dir))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node"), (F.col("p_brand") == "Brand#2").alias("tool"), F.col("p_size").cast("long").alias("bytes"))
    mine = part.where("tool").select("node", "bytes").join(tree, "node")
    held, front = None, mine.select("node", "bytes", F.col("dominator").alias("holder"))
    while True:
        front = graph.cut(front.join(part.select(F.col("node").alias("holder"), "tool"), "holder"))
        done = front.where("NOT tool OR holder = 1").select("holder", "node", "bytes")
        held = done if held is None else held.unionAll(done)
        rest = front.where("tool AND holder <> 1")
        if rest.isEmpty():
            return held.groupBy("holder").agg(F.count("*").alias("nodes"), F.sum("bytes").alias("bytes"))
        front = rest.select("node", "bytes", "holder").join(tree.select(F.col("node").alias("holder"), "dominator"), "holder").select("node", "bytes", F.col("dominator").alias("holder"))
