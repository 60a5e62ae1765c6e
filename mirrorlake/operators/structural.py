"""Copies of functions in source files: exact, renamed and edited ones, in cohesive groups.

Functions are cut out by the lexers of ``sources.lexers`` and taken as token streams in three forms: as they stand,
with names numbered by first occurrence, and as shapes (names and literals by kind alone).  Functions whose
streams are equal go on as one row.  Those whose numbered streams are equal are one class, and copies of each other; a class of more than
``MOST_TEXTS`` texts goes on as one row itself, so very many renamed copies make no pairs.  Rows that share a band of MinHash values of
their shapes are candidates; a band held by more than ``list_cap`` rows gives none, and ``Found.dropped`` counts these.  Pairs are
verified in the dimensions of ``features.verified`` over the functions' syntax trees: statements aligned and their texts, shapes and subtrees,
control flow, called names.  Functions of one control-flow skeleton are candidates too, whatever their tokens.  What is similar enough is
grouped by ``cluster``, so a chain of drifting copies is no group.

Files that aren't source, have no functions or only short ones give nothing; null contents count as empty.  Repeated
files are files of their own if their file_id differs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lexers import lex, tokens_of, units
from . import features, syntax
from .cluster import grouped, placed, severed
from .graph import cut

FUNCTIONS = "file_id long, language string, name string, last long, first_line int, last_line int, raw array<string>, numbered array<string>, shape array<string>"
#: Tokens of a function at least; tokens of a gram; MinHash values, two of which make a band.
LEAST_TOKENS, GRAM, VALUES = 24, 8, 64
#: Texts of a class that are rows of their own, at most.
MOST_TEXTS = 64


@dataclass
class Found:
    functions: DataFrame  # unit_id, file_id, language, name, first_line, last_line, tokens, class_id, raw_hash
    groups: DataFrame  # group_id, class ("type-1" to "type-3"), members, canonical
    members: DataFrame  # class_id, group_id, unit_id, file_id, name
    dropped: DataFrame  # language, band, held: lists over the cap
    severed: DataFrame  # a, b (canonical units), similarity: similar pairs between pieces of a component that was cut
    split: DataFrame  # the same of all similar pairs that no group holds together, those severed among them


def forms(tokens: list[tuple[str, str, int, int]]) -> tuple[list[str], list[str], list[str]]:
    """The token texts, the same with names numbered by first occurrence, and the shapes."""
    numbers: dict[str, str] = {}
    raw, numbered, shape = [], [], []
    for kind, text, _, _ in tokens:
        raw.append(text)
        name = kind in ("ident", "lifetime")
        numbered.append(numbers.setdefault(text, f"v{len(numbers)}") if name else text)
        shape.append("v" if name else "l" if kind in ("literal", "number") else text)
    return raw, numbered, shape


def functions_of(files: DataFrame, least: int = LEAST_TOKENS) -> DataFrame:
    """``files``: file_id, language, content.  A row for every function of ``least`` tokens or more, nested ones too."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FUNCTIONS.split(", ")]
        for batch in batches:
            rows = []
            for file_id, content, language in zip(batch["file_id"], batch["content"], batch["language"], strict=True):
                if language not in ("rust", "c", "cpp"):
                    continue
                tokens = lex(content or "", language)
                rows += [(file_id, language, name, end - 1, a, b, *forms(tokens[first:end])) for kind, name, first, end, a, b in units(tokens, language) if kind == "function" and end - first >= least]
            yield pd.DataFrame(rows, columns=columns)

    found = files.select("file_id", "language", "content").mapInPandas(work, FUNCTIONS)
    hashed = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    return found.select(F.xxhash64("file_id", "first_line", "name", hashed("raw")).alias("unit_id"), "*", hashed("raw").alias("raw_hash"), F.sha2(F.concat_ws("\n", "language", hashed("numbered")), 256).alias("class_id"))


def grams(shape: Column) -> Column:
    """Distinct hashes of all runs of GRAM tokens."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(shape) - GRAM + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(shape, i, GRAM), " "))))


def bands_of(classes: DataFrame) -> DataFrame:
    """(node, language, band): hashes of two MinHash values each, all values from one aggregate over the grams."""
    least = [F.min(F.xxhash64("gram", F.lit(s))).alias(f"m{s}") for s in range(VALUES)]
    signed = classes.select("node", "language", F.explode("grams").alias("gram")).groupBy("node", "language").agg(*least)
    return signed.select("node", "language", F.explode(F.array(*[F.xxhash64(F.lit(k), f"m{2 * k}", f"m{2 * k + 1}") for k in range(VALUES // 2)])).alias("band"))


def profiled(files: DataFrame) -> DataFrame:
    """What functions are verified by, by file and last token; a nested function has a row of its own."""
    toks = cut(tokens_of(files).selectExpr("file_id", "language", "posexplode(tokens) AS (pos, t)").selectExpr("file_id", "language", "CAST(pos AS BIGINT) AS pos", "t.text AS tok", "t.kind AS kind"))
    return features.profiles(cut(syntax.nodes(toks)), toks)


def find(files: DataFrame, similar: float = 0.7, list_cap: int = 256, ratio: float = 3.0) -> Found:
    """``similar`` is the least composite of an edited copy; sizes in tokens of two functions lie within ``ratio``."""
    functions = cut(functions_of(files))
    texts = functions.groupBy("class_id").agg(F.count_distinct("raw_hash").alias("raws"))
    functions = cut(functions.join(texts, "class_id").withColumn("row_id", F.when(F.col("raws") <= MOST_TEXTS, F.sha2(F.concat_ws("\n", "language", "raw_hash"), 256)).otherwise(F.col("class_id"))))
    # of equal functions the least unit stands for all; counts and firsts are taken before anything is shuffled
    classes = cut(
        functions.groupBy("row_id")
        .agg(F.min_by(F.struct("unit_id", "class_id", "file_id", "last", "language", "shape"), "unit_id").alias("c"), F.count("*").alias("held"), F.count_distinct("raw_hash").alias("raws"))
        .select("row_id", "c.*", "held", "raws")
        .withColumn("node", F.monotonically_increasing_id())
        .withColumn("grams", grams(F.col("shape")))
    )
    bands = cut(bands_of(classes))
    lists = bands.groupBy("language", "band").agg(F.count("*").alias("held")).where("held > 1")
    kept = bands.join(lists.where(F.col("held") <= list_cap).select("language", "band"), ["language", "band"])
    pairs = kept.select("language", "band", F.col("node").alias("a")).join(kept.select("language", "band", F.col("node").alias("b")), ["language", "band"]).where("a < b").select("a", "b")
    sized = classes.select("node", "file_id", "last", F.size("shape").alias("tokens"))
    made = cut(profiled(files).join(sized, ["file_id", "last"]).withColumnRenamed("node", "unit_id").drop("file_id", "unit"))
    shaped = features.skeleton_candidates(made.selectExpr("unit_id", "concat(language, ' ', skeleton) AS skeleton", "skeleton_ops", "nodes AS size"), list_cap=list_cap)
    alike = classes.select("class_id", F.col("node").alias("a")).join(classes.select("class_id", F.col("node").alias("b")), "class_id").where("a < b").select("a", "b")
    pairs = cut(pairs.union(shaped).distinct().join(alike, ["a", "b"], "left_anti"))
    size = lambda c: sized.select(F.col("node").alias(c), F.col("tokens").alias(f"n{c}"))
    near_sizes = pairs.join(size("a"), "a").join(size("b"), "b").where(f"greatest(na, nb) <= {ratio} * least(na, nb)")
    edges = features.verified(near_sizes, made, similar).where("class <> 'none'").select("a", "b", F.col("composite").alias("similarity"))
    edges = cut(edges.unionByName(alike.withColumn("similarity", F.lit(1.0))))
    ends = cut(placed(edges, keys=classes.select("node", F.col("class_id").alias("key"))))
    near = cut(grouped(ends, similar, similar))
    unit = lambda c: classes.select(F.col("node").alias(c), F.col("unit_id").alias(f"unit_{c}"))
    apart = severed(ends).join(unit("a"), "a").join(unit("b"), "b").select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b"), "similarity")
    alone = classes.join(near, classes.node == near.member, "left_anti").where("held > 1").select(F.col("node").alias("medoid"), F.col("node").alias("member"))
    seats = near.unionAll(alone).join(classes.select(F.col("node").alias("member"), "row_id", "class_id", "held", "raws"), "member")
    held = lambda c: near.select(F.col("member").alias(c), F.col("medoid").alias(f"m{c}"))
    split = edges.join(held("a"), "a", "left").join(held("b"), "b", "left").where("ma IS NULL OR mb IS NULL OR ma <> mb").join(unit("a"), "a").join(unit("b"), "b").select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b"), "similarity")
    canonical = classes.select(F.col("node").alias("medoid"), F.col("unit_id").alias("canonical"))
    groups = seats.groupBy("medoid").agg(F.sum("held").alias("members"), F.count_distinct("class_id").alias("classes"), F.sum("raws").alias("raws")).join(canonical, "medoid")
    kind = F.when(F.col("classes") > 1, "type-3").when(F.col("raws") > 1, "type-2").otherwise("type-1")
    group_id = F.sha2(F.col("canonical").cast("string"), 256)
    members = seats.join(canonical, "medoid").select(group_id.alias("group_id"), "row_id").join(functions.select("row_id", "class_id", "unit_id", "file_id", "name"), "row_id").drop("row_id")
    return Found(functions.withColumn("tokens", F.size("shape")).drop("raw", "numbered", "shape", "last", "raws", "row_id"), groups.select(group_id.alias("group_id"), kind.alias("class"), "members", "canonical"), members, lists.where(F.col("held") > list_cap), apart, split)
