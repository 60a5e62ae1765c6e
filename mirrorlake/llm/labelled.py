"""Labels beside documents, without shuffling texts where the labels are few, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels that may be broadcast (an id and a small number each, some tens of MB); more are joined by a shuffle.
MOST_BROADCAST = 2_000_000


def labelled(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) that have a label, with it as the int column label; of several labels the greatest counts."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(name).cast("int")).alias("label"))
    if one.count() <= MOST_BROADCAST:
        one = F.broadcast(one)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(one, "doc_id")


def sample(rows: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """The ``most`` distinct rows (doc_id, text, label) of least hash, whole texts; one that would take the sum past ``most_bytes`` is left out.

    Hashes, ids and sizes are chosen first, from rows below a bound on the hash that holds about twice as many as
    are wanted (raised until it holds enough), so what one task orders doesn't grow with the table.  The texts of
    the chosen rows come in a second pass.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    share = min(1.0, 2 * most / max(1, rows.count()))
    while True:
        below = keyed.where(F.col("h") <= F.lit(min(int(-(2.0**63) + share * 2.0**64), 2**63 - 1)).cast("long"))
        found = below.groupBy("h", "doc_id").agg(F.max("size").alias("size")).orderBy("h", "doc_id").limit(most).collect()
        if len(found) == most or share >= 1:
            break
        share = min(1.0, 4 * share)
    chosen, held = [], 0
    for r in found:
        if held + r.size <= most_bytes:
            chosen.append((r.h, r.doc_id))
            held += r.size
    chosen = F.broadcast(spark.createDataFrame(chosen, "h long, doc_id long"))  # at most ``most`` rows
    return keyed.join(chosen, ["h", "doc_id"]).groupBy("h", "doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label")).select("doc_id", "text", "label")
