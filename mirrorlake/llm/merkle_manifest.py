"""Merkle trees over the rows of a table: leaf digests, roots, and a proof for every row.

A leaf is the digest of a row's columns, each with its length before it.  The leaves of a group (a language) ascend by id; while
several nodes remain, every ``fanout`` consecutive ones become the digest of their digests.  The groups' roots, in their order, make
the last tree the same way.

Rows are dealt out in ranges of (group, id), so that no group is one task's, and numbered by what the ranges before
hold of their group.  A group is cut into aligned blocks of fanout^depth leaves: a block is a contiguous matrix of 64-byte digests,
reshaped level by level so that a row of it is a run, and the node at place i of level l stands in run i // fanout, its siblings beside
it.  What a block leaves is one node; nodes are numbered by their block, so the next pass is the same over far fewer
rows.  From the top down every block gets the siblings of its own node, and each leaf is folded with those of its block and these.

Null columns count as ``-``; null ids and null groups come first.  Rows with equal ids are ordered by their leaves, equal rows have
equal leaves and proofs.  Empty texts are a length of 0, texts of any length count whole.  Groups of one row have the leaf as their root.
An empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, settle, shared_dir

#: Bytes of a digest in hex; leaves of a block at most.
WIDE, BLOCK = 64, 8192
#: Ranges and the groups in them that may be broadcast (tens of bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Bits of Spark's increasing row number that count within a partition.
LOCAL = (1 << 33) - 1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(column: Column) -> Column:
    """A column in a leaf: its length in bytes, a colon, its text; a dash for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def hashed(rows: np.ndarray) -> np.ndarray:
    """Digests (n, 64) of the rows of a byte matrix."""
    flat, width = rows.tobytes(), rows.shape[1]
    made = b"".join(hashlib.sha256(flat[i : i + width]).hexdigest().encode() for i in range(0, len(flat), width))
    return np.frombuffer(made, np.uint8).reshape(-1, WIDE)


def above(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The level above (n, 64) nodes: runs of ``fanout`` digests, the last perhaps shorter."""
    whole = len(nodes) // fanout * fanout
    up = hashed(nodes[:whole].reshape(-1, fanout * WIDE)) if whole else np.empty((0, WIDE), np.uint8)
    return np.concatenate([up, hashed(nodes[whole:].reshape(1, -1))]) if whole < len(nodes) else up


def heights(n: int, fanout: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def tree(nodes: np.ndarray, levels: int, fanout: int) -> list[np.ndarray]:
    """All levels of a block; one that is part of a taller tree goes up to its height even from a single node."""
    out = [np.ascontiguousarray(nodes)]
    for _ in range(levels):
        out.append(above(out[-1], fanout))
    return out


def siblings(level: np.ndarray, at: np.ndarray, fanout: int) -> tuple[list[bytes], list[bytes]]:
    """For the nodes at these places of a level: the digests before and after each within its run."""
    flat, first = level.tobytes(), at // fanout * fanout
    last = np.minimum(first + fanout, len(level))
    before = [flat[a * WIDE : b * WIDE] for a, b in zip(first.tolist(), at.tolist(), strict=True)]
    after = [flat[a * WIDE : b * WIDE] for a, b in zip((at + 1).tolist(), last.tolist(), strict=True)]
    return before, after


def numbered(rows: DataFrame, group: str, order: list[str], root: str) -> DataFrame:
    """Adds ``pos`` (place in the group, from 0) and ``n`` (rows of the group).  ``rows`` is dealt out in ranges, and written."""
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("row", F.monotonically_increasing_id())
    ranged = settle(spark, ranged, f"{root}/ranged").withColumn("range", F.shiftright("row", 33))
    # a row for every range and group in it; a group has at most as many as there are ranges
    held = ranged.groupBy("range", group).agg(F.count("*").alias("held"), F.min("row").alias("first"))
    ahead = f"sum(held) OVER (PARTITION BY `{group}` ORDER BY range) - held"
    starts = settle(spark, held.selectExpr("range AS of_range", f"`{group}` AS of_group", f"first - ({ahead}) AS shift", f"sum(held) OVER (PARTITION BY `{group}`) AS n"), f"{root}/starts")
    if starts.count() <= MOST_BROADCAST:
        starts = F.broadcast(starts)
    return ranged.join(starts, (F.col("range") == F.col("of_range")) & F.col(group).eqNullSafe(F.col("of_group"))).withColumn("pos", F.col("row") - F.col("shift")).drop("row", "range", "shift", "of_range", "of_group")


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    return np.frombuffer("".join(table[column].to_pylist()).encode(), np.uint8).reshape(-1, WIDE)


class Forest:
    """Trees over the groups of a table: nodes are grp, pos, n, digest; ``grp`` may be null."""

    def __init__(self, fanout: int, block: int):
        self.fanout, self.depth = fanout, max(1, heights(block + 1, fanout) - 1)
        self.size = fanout**self.depth

    def blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.expr(f"pos div {self.size}L"))

    def levels(self, table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
        table = table.sort_by("pos")
        return table, tree(_matrix(table, "digest"), min(self.depth, heights(table["n"][0].as_py(), self.fanout)), self.fanout)

    def climb(self, nodes: DataFrame) -> DataFrame:
        """The nodes that the blocks of ``nodes`` leave."""
        size = self.size

        def work(table: pa.Table) -> pa.Table:
            table, levels = self.levels(table)
            return pa.table({"grp": table["grp"][:1], "pos": table["block"][:1], "n": pa.array([-(-table["n"][0].as_py() // size)], pa.int64()), "digest": [levels[-1].tobytes().decode()]})

        return self.blocks(nodes.select("grp", "pos", "n", "digest")).groupBy("grp", "block").applyInArrow(work, "grp string, pos long, n long, digest string")

    def steps(self, nodes: DataFrame, paths: DataFrame) -> DataFrame:
        """grp, pos and the siblings (before, after) on the way from every node to the top.  ``paths``: the same of the nodes' blocks."""
        fanout = self.fanout

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            table, levels = self.levels(left)
            rest = right["steps"][0].as_py()
            at, own = np.arange(len(table)), [[] for _ in range(len(table))]
            for level in levels[:-1]:
                for held, before, after in zip(own, *siblings(level, at, fanout), strict=True):
                    held.append({"before": before.decode(), "after": after.decode()})
                at = at // fanout
            kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
            return pa.table({"grp": table["grp"], "pos": table["pos"], "steps": pa.array([s + rest for s in own], kind)})

        return self.blocks(nodes.select("grp", "pos", "n", "digest")).groupBy("grp", "block").cogroup(paths.withColumnRenamed("pos", "block").groupBy("grp", "block")).applyInArrow(work, "grp string, pos long, steps array<struct<before:string,after:string>>")

    def levels_up(self, nodes: DataFrame, root: str) -> list[DataFrame]:
        """Nodes of every pass, from these up to one a group."""
        found, top = [nodes], nodes.agg(F.max("n")).first()[0] or 1
        while top > 1 or len(found) == 1:
            found.append(settle(nodes.sparkSession, self.climb(found[-1]), f"{root}/pass-{len(found)}"))
            top = -(-top // self.size)
        return found

    def proofs(self, leaves: DataFrame, paths: DataFrame, keep: list[str]) -> DataFrame:
        """The columns ``keep`` with proof_sha256 and the root folded from the column ``start``.  ``paths``: steps of the leaves' blocks."""
        fanout = self.fanout
        kinds = {f.name: f.dataType for f in leaves.schema.fields}

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            table, levels = self.levels(left)
            rest = [(s["before"].encode(), s["after"].encode()) for s in right["steps"][0].as_py()]
            n = len(table)
            at, own, node = np.arange(n), [[] for _ in range(n)], [s.encode() for s in table["start"].to_pylist()]
            sha = hashlib.sha256
            for level in levels[:-1]:
                before, after = siblings(level, at, fanout)
                node = [sha(b + x + a).hexdigest().encode() for b, x, a in zip(before, node, after, strict=True)]
                for held, b, a in zip(own, before, after, strict=True):
                    held += (b, a)
                at = at // fanout
            for b, a in rest:
                node = [sha(b + x + a).hexdigest().encode() for x in node]
            shared = b"".join(b + a for b, a in rest)
            proof = [sha(b"".join(held) + shared).hexdigest() for held in own]
            return pa.table({**{c: table[c] for c in keep}, "proof_sha256": proof, "folded_root": [x.decode() for x in node]})

        schema = ", ".join(f"{c} {kinds[c].simpleString()}" for c in keep) + ", proof_sha256 string, folded_root string"
        return self.blocks(leaves).groupBy("grp", "block").cogroup(paths.withColumnRenamed("pos", "block").groupBy("grp", "block")).applyInArrow(work, schema)


def manifest(docs: DataFrame, fanout: int = 2, block: int = BLOCK, tampered: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot of its language, root, proof_sha256 (of its siblings, from its level up), folded_root, verified.

    ``tampered`` (doc_id to a condition) marks rows that are folded from a changed leaf, whose n_chars is one more.
    ``block`` bounds the leaves that a task holds at once.
    """
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    spark = docs.sparkSession
    batches(spark)
    root, forest = shared_dir(spark, "merkle"), Forest(fanout, block)
    columns = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    plain = docs.select(*(F.col(c).cast(k).alias(c) for c, k in columns.items()))
    own = [F.col(c) for c in COLUMNS]
    changed = leaf(*(F.try_add(c, F.lit(1).cast("long")) if name == "n_chars" else c for name, c in zip(COLUMNS, own, strict=True)))
    leaves = plain.select("doc_id", F.col("lang").alias("grp"), leaf(*own).alias("digest"), (F.when(tampered(F.col("doc_id")), changed) if tampered else F.lit(None).cast("string")).alias("changed"))
    leaves = numbered(settle(spark, leaves, f"{root}/leaves"), "grp", ["doc_id", "digest"], f"{root}/leaves-numbered")
    leaves = leaves.select("doc_id", "grp", "pos", "n", "digest", F.coalesce("changed", "digest").alias("start"))
    passes = forest.levels_up(leaves, f"{root}/groups")
    # the groups' roots make one more tree, a group of its own
    roots = numbered(passes[-1].select(F.lit("").alias("all"), F.col("grp").alias("name"), "digest"), "all", ["name"], f"{root}/roots-numbered")
    roots = settle(spark, roots.select(F.lit("").alias("grp"), "name", "pos", "n", "digest"), f"{root}/roots")
    top = forest.levels_up(roots, f"{root}/top")
    paths = top[-1].select("grp", "pos", F.expr("CAST(array() AS array<struct<before:string,after:string>>)").alias("steps"))
    for k in range(len(top) - 2, -1, -1):
        paths = settle(spark, forest.steps(top[k], paths), f"{root}/top-paths-{k}")
    paths = roots.join(paths, ["grp", "pos"]).select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "steps")
    for k in range(len(passes) - 2, 0, -1):
        paths = settle(spark, forest.steps(passes[k], paths), f"{root}/paths-{k}")
    found = forest.proofs(leaves, paths, ["doc_id", "grp", "digest"])
    subroots = roots.select(F.col("name").alias("of"), F.col("digest").alias("subroot"))
    if subroots.count() <= MOST_BROADCAST:
        subroots = F.broadcast(subroots)
    whole = top[-1].first()  # the one root, or nothing
    joined = found.join(subroots, F.col("grp").eqNullSafe(F.col("of"))).withColumn("root", F.lit(whole.digest if whole else None).cast("string"))
    return joined.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def every_seventh(doc_id: Column) -> Column:
    """Rows of the query whose proof is tried with a changed leaf."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0


#: CRC-32 of an id's digits in SQL, bit by bit (reflected polynomial, all ones before and after).
_CRC = (
    "xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)), "
    "lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
)


def oracle() -> str:
    """The query's rows in SQL: levels by recursion over pairs of neighbours, proofs as ordered aggregates, folding by recursion."""
    part = lambda x, text: f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')" if x else ""
    digest = lambda n: "sha256(" + " || ".join(part(1, t) for t in ("CAST(doc_id AS VARCHAR)", "source", "lang", n, "text")) + ")"
    climb = "SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(h || coalesce(beside, '')) FROM (SELECT *, lead(h) OVER (PARTITION BY tree ORDER BY pos) AS beside FROM {0}) WHERE n > 1 AND pos % 2 = 0"
    return f"""WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, lang, coalesce('=' || lang, '-') AS tree, {digest("CAST(n_chars AS VARCHAR)")} AS leaf, {digest("CAST(n_chars + 1 AS VARCHAR)")} AS changed FROM documents),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
low(tree, level, pos, n, h) AS (SELECT tree, 0, pos, n, leaf FROM numbered UNION ALL {climb.format("low")}),
subroots AS MATERIALIZED (SELECT s.lang, s.tree, low.h, row_number() OVER (ORDER BY s.lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low JOIN (SELECT DISTINCT lang, tree FROM leaves) s USING (tree) WHERE low.n = 1),
high(tree, level, pos, n, h) AS (SELECT '*', 0, pos, n, h FROM subroots UNION ALL {climb.format("high")}),
nodes AS MATERIALIZED (SELECT 0 AS stage, * FROM low UNION ALL SELECT 1, * FROM high),
ways AS (SELECT id, 0 AS stage, tree, pos FROM numbered UNION ALL SELECT a.id, 1, '*', b.pos FROM numbered a JOIN subroots b USING (tree)),
steps AS MATERIALIZED (
  SELECT w.id, row_number() OVER (PARTITION BY w.id ORDER BY w.stage, own.level) AS k, own.pos % 2 AS right_side, beside.h AS sibling
  FROM ways w JOIN nodes own ON own.stage = w.stage AND own.tree = w.tree AND own.n > 1 AND own.pos = w.pos >> own.level
  LEFT JOIN nodes beside ON beside.stage = own.stage AND beside.tree = own.tree AND beside.level = own.level AND beside.pos = xor(own.pos, 1)),
proofs AS (SELECT l.id, sha256(coalesce(string_agg(s.sibling, '' ORDER BY s.k), '')) AS proof_sha256, count(s.k) AS k FROM leaves l LEFT JOIN steps s USING (id) GROUP BY l.id),
folded(id, k, h) AS (
  SELECT id, CAST(0 AS BIGINT), CASE WHEN crc32_ % 7 = 0 THEN changed ELSE leaf END FROM (SELECT *, {_CRC} AS crc32_ FROM leaves)
  UNION ALL SELECT f.id, s.k, sha256(CASE WHEN right_side = 1 THEN sibling || h ELSE h || coalesce(sibling, '') END) FROM folded f JOIN steps s ON s.id = f.id AND s.k = f.k + 1)
SELECT n.doc_id, n.leaf, s.h AS subroot, r.h AS root, p.proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM numbered n JOIN subroots s USING (tree) JOIN proofs p USING (id) JOIN folded f ON f.id = n.id AND f.k = p.k CROSS JOIN (SELECT h FROM high WHERE n = 1) r"""
