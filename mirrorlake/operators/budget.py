"""Admission of sized rows, in order, to a budget: a row that doesn't fit is skipped, later ones may still fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that the driver looks at at once.
AT_ONCE = 10_000


def admitted(rows: DataFrame, budget: int) -> DataFrame:
    """(place) of the rows taken.  ``rows``: place (distinct, gives the order), size (1 at least).

    The first rows in order come to the driver a bounded number at a time.  What is left never grows, so a row larger than it is
    out for good and isn't fetched; at most ``budget`` rows are taken, whatever the table.
    """
    left, taken, after = budget, [], None
    while left > 0:
        waiting = rows.where(F.col("size") <= left)
        if after is not None:
            waiting = waiting.where(F.col("place") > after)
        batch = waiting.orderBy("place").limit(AT_ONCE).collect()
        for r in batch:
            if r["size"] <= left:
                taken.append((r["place"],))
                left -= r["size"]
        if len(batch) < AT_ONCE:
            break
        after = batch[-1]["place"]
    return rows.sparkSession.createDataFrame(taken, "place long")
