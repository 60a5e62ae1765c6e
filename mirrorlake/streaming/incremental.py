"""Streaming forms of incremental work (an extension): rescans without repeats, windows, look-ahead over commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(files: DataFrame, horizon: str = "7 days") -> DataFrame:
    """Files of a stream (path, content_hash, seen_at) whose content hasn't come within the horizon."""
    return files.withWatermark("seen_at", horizon).dropDuplicatesWithinWatermark(["path", "content_hash"])


def activity(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of runs (started_at, variant) by tumbling window."""
    return events.withWatermark("started_at", late).groupBy(F.window("started_at", width), "variant").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "variant", "n")


def guarded(changes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Changes of a stream (id, path) beside the static ledger (path, seam, member)."""
    return changes.join(ledger, "path").select("id", "path", "seam", "member")
