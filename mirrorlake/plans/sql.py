"""Queries written once and rendered for Spark and for the oracle engine."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import Duck, Spark
from ..operators.graph import cut
from ..registry import register

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Dialect = Spark | Duck
Relation = Callable[[Dialect], str]


def plain_counts(text: str) -> str:
    """count_if as a count of cases, which is a BIGINT in both engines."""
    while (at := text.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}count(CASE WHEN {text[at + 9 : end - 1]} THEN 1 END){text[end:]}"
    return text


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A text over the tables of a folder, which stand before it as CTEs: the session's views aren't touched."""
    tables = ",\n".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES if re.search(rf"\b{t}\b", text))
    if not tables:
        return spark.sql(text)
    return spark.sql(f"WITH {tables},\n{text[5:]}" if text.startswith("WITH ") else f"WITH {tables}\n{text}")


def composed(bodies: dict[str, str], text: str) -> str:
    """A text with relations before it as CTEs."""
    ctes = ",\n".join(f"{name} AS (\n{body}\n)" for name, body in bodies.items())
    if ctes and text.startswith("WITH "):
        return plain_counts(f"WITH {ctes},\n{text[5:]}")
    return plain_counts((f"WITH {ctes}\n" if ctes else "") + text)


def frame(spark: SparkSession, sf_dir: str, relations: Sequence[Relation], text: str, written: Sequence[Relation] = (), given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A text over relations.  Those of ``written``, which it names more than once, are computed once and read back from the shared folder; ``given`` are frames by the names that it has for them."""
    bodies, views = {}, []
    for name, rows in (given or {}).items():
        views.append(f"mirrorlake_{name}_{uuid.uuid4().hex[:8]}")
        rows.createOrReplaceTempView(views[-1])
        bodies[name] = f"SELECT * FROM {views[-1]}"
    for relation in relations:
        name, body = relation.__name__, relation(Spark())
        if relation in written:
            views.append(f"mirrorlake_{name}_{uuid.uuid4().hex[:8]}")
            cut(run(spark, sf_dir, composed(bodies, body))).createOrReplaceTempView(views[-1])
            body = f"SELECT * FROM {views[-1]}"
        bodies[name] = body
    found = run(spark, sf_dir, composed(bodies, text))
    for view in views:
        spark.catalog.dropTempView(view)
    return found


def told(text: Relation, *relations: Relation) -> str:
    """A text over relations for the oracle engine."""
    return composed({r.__name__: r(Duck()) for r in relations}, text(Duck()))


def sql(name: str, *relations: Relation, written: Sequence[Relation] = ()) -> Callable[[Relation], Relation]:
    """Register a query whose text is given by a function of the dialect; ``relations`` are put before it as CTEs."""

    def put(text: Relation) -> Relation:
        register(name, told(text, *relations))(lambda spark, sf_dir: frame(spark, sf_dir, relations, text(Spark()), written))
        return text

    return put
