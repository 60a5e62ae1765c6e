"""The engine's surface: scan, report, explain, baseline, history, seams, guard and artifacts over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, structural
from .sources.run_store import RunStore
from .sources.scan import matches_any

#: Files of a group that may be joined by one hash.
HOT = 50_000
#: What ranks groups, from instances, size and directories.
WORTH = "instances / (instances + 2) * 0.5 + size / (size + 120) * 0.35 + (directories - 1) / directories * 0.15"


@dataclass
class Scan:
    files: DataFrame
    groups: DataFrame
    members: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"files": self.files.drop("content"), "groups": self.groups, "members": self.members}


class Engine:
    """Operations of the command surface; ``files`` has file_id, path, directory, language, content."""

    def __init__(self, spark: SparkSession, store: str | None = None):
        self.spark = spark
        self.store = RunStore(spark, store) if store else None

    def scan(self, files: DataFrame, run_id: int | None = None) -> Scan:
        """Exact groups of the files, ranked; recorded as a run if there is a store and an id."""
        hashed = files.withColumn("content_hash", F.sha2("content", 256)).withColumn("size", F.length("content"))
        # counts are summed before they are shuffled, so that a hash which most files share is no hot spot
        held = hashed.where("content IS NOT NULL").groupBy("language", "content_hash").agg(F.count("*").alias("instances"), F.min("file_id").alias("canonical"), F.max("size").alias("size"), F.count_distinct("directory").alias("directories")).where("instances > 1")
        groups = graph.cut(held.withColumn("priority", F.round(F.expr(WORTH), 9)).withColumn("group_id", F.sha2(F.concat_ws("|", "language", "content_hash"), 256)))
        # groups of very many files are few (at most all files by HOT): they are broadcast to their members, the others joined by hash
        key = ["language", "content_hash"]
        large, small = (groups.where(rule).select(*key, "group_id", "canonical") for rule in (F.col("instances") > HOT, F.col("instances") <= HOT))
        rest = hashed.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key)
        members = hashed.join(F.broadcast(large), key).unionByName(rest).select("group_id", "file_id", "path", (F.col("file_id") == F.col("canonical")).alias("is_canonical"))
        found = Scan(hashed, groups, members)
        if self.store and run_id is not None:
            self.store.write(run_id, found.tables())
        return found

    def scan_structural(self, files: DataFrame, run_id: int | None = None, similar: float = 0.7, suppress: tuple[str, ...] = ()) -> structural.Found:
        """Groups of exact, renamed and edited copies of functions in the files of a known language; recorded as a run if there is a store and an id.

        A recorded group has its size (tokens of the canonical function), directories, priority, and whether it is suppressed: all of its members
        lie in paths that match a glob of ``suppress``.
        """
        found = structural.find(files, similar)
        if self.store and run_id is not None:
            at = files.select("file_id", "path", "directory")
            members = graph.cut(found.members.join(at, "file_id").withColumn("hidden", matches_any(F.col("path"), list(suppress))))
            facts = members.groupBy("group_id").agg(F.count_distinct("directory").alias("directories"), F.bool_and("hidden").alias("suppressed"))
            size = found.functions.select(F.col("unit_id").alias("canonical"), F.col("tokens").alias("size"))
            groups = found.groups.withColumnRenamed("members", "instances").join(facts, "group_id").join(size, "canonical")
            members = members.join(groups.select("group_id", "canonical"), "group_id").select("group_id", "unit_id", "file_id", "path", "name", (F.col("unit_id") == F.col("canonical")).alias("is_canonical"))
            self.store.write(run_id, {"files": files.drop("content"), "groups": groups.withColumn("priority", F.round(F.expr(WORTH), 9)), "members": members, "pairs": found.split})
        return found

    def report(self, run_id: int, limit: int = 10) -> DataFrame:
        """Groups of a recorded run in order of priority, without suppressed ones; 0 lifts the limit."""
        groups = self.store.read("groups").where(F.col("run_id") == run_id)
        if "suppressed" in groups.columns:
            groups = groups.where(~F.coalesce("suppressed", F.lit(False)))
        groups = groups.orderBy(F.desc("priority"), "group_id")
        return groups.limit(limit) if limit else groups

    def explain(self, run_id: int, prefix: str) -> DataFrame:
        """Members of the one group whose id begins with ``prefix`` (8 hex digits at least)."""
        if len(prefix) < 8:
            raise ValueError("a prefix has 8 digits at least")
        groups = self.store.read("groups").where((F.col("run_id") == run_id) & F.col("group_id").startswith(prefix)).select("group_id")
        if groups.limit(2).count() > 1:
            raise ValueError(f"{prefix} names several groups")
        return self.store.read("members").where(F.col("run_id") == run_id).join(groups, "group_id", "left_semi")

    def baseline_delta(self, before: int, after: int) -> DataFrame:
        """Groups gone, appeared, expanded or continuing between two recorded runs."""
        groups = self.store.read("groups")
        b = groups.where(F.col("run_id") == before).select("group_id", F.col("instances").alias("was"))
        a = groups.where(F.col("run_id") == after).select("group_id", F.col("instances").alias("now"))
        state = F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "appeared").when(F.col("now") > F.col("was"), "expanded").otherwise("continuing")
        return b.join(a, "group_id", "full_outer").select("group_id", state.alias("state"))

    @staticmethod
    def history(commits: DataFrame, paths: DataFrame) -> DataFrame:
        """Commits by kind with the sizes at the middle and at nine tenths, by nearest rank."""
        sized = commits.join(paths.groupBy("id").agg(F.count_distinct("path").alias("n_paths")), "id")
        ranked = sized.selectExpr("kind", "n_paths", "row_number() OVER (PARTITION BY kind ORDER BY n_paths, id) AS r", "count(*) OVER (PARTITION BY kind) AS n")
        at = lambda p: F.max(F.when(F.col("r") == F.ceil(F.col("n") * p), F.col("n_paths")))
        return ranked.groupBy("kind").agg(F.count("*").alias("n"), at(0.5).alias("median_size"), at(0.9).alias("p90_size"))

    @staticmethod
    def suggest_seams(paths: DataFrame, most_paths: int = 30, support: int = 3, coupling: float = 0.6) -> DataFrame:
        """Pairs of paths that change together; commits over ``most_paths`` count for none, so pairs a commit are bounded."""
        size = paths.groupBy("id").agg(F.count_distinct("path").alias("k")).where(F.col("k") <= most_paths).select("id")
        kept = paths.select("id", "path").distinct().join(size, "id")
        touched = kept.groupBy("path").agg(F.count("*").alias("n"))
        pairs = kept.select("id", F.col("path").alias("a")).join(kept.select("id", F.col("path").alias("b")), "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= support)
        both = pairs.join(touched.select(F.col("path").alias("a"), F.col("n").alias("na")), "a").join(touched.select(F.col("path").alias("b"), F.col("n").alias("nb")), "b")
        return both.withColumn("coupling", F.col("support") / F.greatest("na", "nb")).where(F.col("coupling") >= coupling)

    @staticmethod
    def guard(changed: DataFrame, ledger: DataFrame) -> DataFrame:
        """Seams of which a change touches some members but not all.  ``changed``: path; ``ledger``: seam, member, path."""
        members = ledger.groupBy("seam").agg(F.count_distinct("member").alias("members"))
        touched = ledger.join(changed.select("path").distinct(), "path", "left_semi").groupBy("seam").agg(F.count_distinct("member").alias("touched"))
        return touched.join(members, "seam").where("touched < members")

    @staticmethod
    def retained(calls: DataFrame, sizes: DataFrame, root: int) -> DataFrame:
        """Bytes that each symbol keeps: its own and all that it dominates."""
        tree = graph.cut(graph.dominators(calls.withColumn("graph", F.lit(0).cast("long")), root)).select("node", "dominator")
        return graph.retained(tree, sizes)
