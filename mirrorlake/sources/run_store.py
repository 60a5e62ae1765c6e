"""Recorded runs as partitioned Parquet: written in full, then marked as complete by their last row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RunStore:
    """Tables below a folder, partitioned by run_id; readers see only runs whose mark is there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, run_id: int, tables: dict[str, DataFrame], variant: str = "default") -> None:
        """Write a run's tables, then its mark; writing it again takes the mark away first, so no reader sees a mix."""
        self._delete(f"{self.root}/_runs/run_id={run_id}")
        for name, frame in tables.items():
            frame.write.mode("overwrite").parquet(f"{self.root}/{name}/run_id={run_id}")
        mark = self.spark.range(1).select(F.lit(variant).alias("variant"), F.current_timestamp().alias("started_at"))
        mark.write.mode("overwrite").parquet(f"{self.root}/_runs/run_id={run_id}")

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def runs(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/_runs").parquet(f"{self.root}/_runs")

    def read(self, name: str) -> DataFrame:
        # runs of different kinds have columns of their own, which are null in the others
        frame = self.spark.read.option("basePath", f"{self.root}/{name}").option("mergeSchema", "true").parquet(f"{self.root}/{name}")
        return frame.join(self.runs().select("run_id"), "run_id", "left_semi")

    def preceding(self, run_id: int) -> int | None:
        """The newest complete run before ``run_id`` of the same variant."""
        runs = self.runs()
        mine = runs.where(F.col("run_id") == run_id).select("variant")
        row = runs.where(F.col("run_id") < run_id).join(mine, "variant").agg(F.max("run_id").alias("r")).first()
        return row.r

    def prune(self, keep: int) -> list[int]:
        """Run ids beyond the newest ``keep``; their marks go first, so that no reader sees half a run."""
        gone = [r.run_id for r in self.runs().orderBy(F.desc("run_id")).offset(keep).collect()]
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        root = fs_path(self.root)
        system = root.getFileSystem(conf)
        tables = sorted((s.getPath().getName() for s in system.listStatus(root)), key=lambda t: t != "_runs")
        for run in gone:
            for table in tables:
                system.delete(fs_path(f"{self.root}/{table}/run_id={run}"), True)
        return gone
