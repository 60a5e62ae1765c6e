"""Semantic rules over sequences of operations, and groups of what they match.

Rules are data.  ``spans`` compiles those of a fixed length to one automaton whose states are bits of a BIGINT: an operation
shifts the states on and keeps those whose place it fits (shift-and), so all rules run in one fold over a unit's operations, whatever their
number; rules over runs are islands of permitted kinds.  A span may match several rules.

``groups`` never makes pairs of units.  Units of one rule, language and build variant whose spans have the same kinds and tags are one
class; a tag that isn't known fits any, so classes are compared place by place, and complete linkage runs over classes with their sizes as
weights, which gives the groups that it would give over units.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import refine


@dataclass(frozen=True)
class Rule:
    """``steps`` are conditions over an operation's columns (and ``last_kind``, ``last_resource`` of the one before), one an operation;
    ``run`` is a condition for maximal runs of at least ``least`` operations, not all of kind ``not_only``."""

    name: str
    confidence: float
    steps: tuple[str, ...] = ()
    run: str = ""
    least: int = 1
    not_only: str = ""


def _api(*names: str) -> tuple[str, ...]:
    return tuple(f"kind = 'map' AND api = '{n}'" for n in names)


# The registered rules within one language and build variant, with their confidences.
RULES = (
    Rule("rust-serialization-round-trip-v1", 0.8, _api("rust::ToString::to_string", "rust::str::parse")),
    Rule("cpp-serialization-round-trip-v1", 0.8, _api("std::to_string", "std::stoull")),
    Rule("sequence-pipeline-v1", 0.7, run="kind IN ('source', 'filter', 'map', 'reduce', 'collect')", least=2, not_only="map"),
    Rule("result-direct-propagation-v1", 0.95, ("kind = 'propagate_error' AND fallible = 'result' AND direct = 'result_adapter'",)),
    Rule("option-direct-propagation-v1", 0.95, ("kind = 'propagate_error' AND fallible = 'option' AND direct = 'option_adapter'",)),
    Rule("optional-validation-v1", 0.85, ("kind = 'validate' AND fallible = 'option'",)),
    Rule("result-validation-v1", 0.85, ("kind = 'validate' AND fallible = 'result'",)),
    Rule("resource-lifecycle-v1", 0.9, ("kind = 'acquire_resource'", "kind = 'release_resource' AND last_kind = 'acquire_resource' AND resource = last_resource")),
)


def spans(ops: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(unit, rule, first, last): where a unit's operations match a rule.  ``ops``: unit, k (order, distinct in a unit), kind, type_tag, fallible, direct, resource, api.

    first and last are places in the order, from 0.  Fixed sequences match wherever they stand, overlapping ones too; runs are maximal.
    """
    fixed = [r for r in rules if r.steps]
    if sum(len(r.steps) for r in fixed) > 62:
        raise ValueError("the fixed rules of one automaton have 62 steps at most")
    w = "PARTITION BY unit ORDER BY k"
    t = ops.selectExpr("*", f"CAST(row_number() OVER ({w}) - 1 AS BIGINT) AS place", f"lag(kind) OVER ({w}) AS last_kind", f"lag(resource) OVER ({w}) AS last_resource")
    starts, accept, fits, bit = 0, [], [], 0
    for r in fixed:
        starts |= 1 << bit
        for step in r.steps:
            fits.append(f"CASE WHEN {step} THEN {1 << bit}L ELSE 0L END")
            bit += 1
        accept.append((r.name, 1 << (bit - 1), len(r.steps)))
    ends = t.selectExpr("unit", "place", f"{' + '.join(fits) or '0L'} AS fits").groupBy("unit").agg(F.expr("transform(array_sort(collect_list(struct(place, fits))), x -> x.fits)").alias("fits"))
    # states[i + 1] follows from states[i] by one shift; the fold keeps them all, as the accepted ones tell spans
    states = f"aggregate(fits, array(0L), (d, x) -> concat(d, array((shiftleft(element_at(d, -1), 1) | {starts}L) & x)))"
    named = ", ".join(f"struct('{n}' AS rule, {b}L AS bit, {k}L AS steps)" for n, b, k in accept)
    found = ends.selectExpr("unit", f"posexplode({states}) AS (at, d)").selectExpr("unit", "at", "d", f"explode(array({named})) AS r").where("d & r.bit <> 0")
    out = found.selectExpr("unit", "r.rule AS rule", "CAST(at AS BIGINT) - r.steps AS first", "CAST(at AS BIGINT) - 1 AS last")
    for r in rules:
        if r.run:
            islands = t.where(r.run).selectExpr("unit", "place", "kind", f"place - row_number() OVER ({w}) AS island").groupBy("unit", "island")
            runs = islands.agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"), F.count(F.when(F.col("kind") != r.not_only, 1)).alias("others"))
            out = out.unionAll(runs.where(f"n >= {r.least} AND others > 0").select("unit", F.lit(r.name).alias("rule"), "first", "last"))
    return out


def classes(ops: DataFrame, found: DataFrame) -> DataFrame:
    """Spans with their unit's language and variant, the kinds and apis of their operations as ``form``, and their tags ("type/fallible", * for unknown).  ``ops`` has language and variant besides."""
    t = ops.selectExpr("unit", "language", "variant", "CAST(row_number() OVER (PARTITION BY unit ORDER BY k) - 1 AS BIGINT) AS place", "kind", "concat(coalesce(type_tag, '*'), '/', coalesce(fallible, '*')) AS tag")
    whole = t.groupBy("unit").agg(F.first("language").alias("language"), F.first("variant").alias("variant"), F.expr("transform(array_sort(collect_list(struct(place, kind, tag))), x -> struct(x.kind AS kind, x.tag AS tag))").alias("o"))
    own = "slice(o, CAST(first + 1 AS INT), CAST(last - first + 1 AS INT))"
    return found.join(whole, "unit").selectExpr("unit", "rule", "first", "last", "language", "variant", f"array_join(transform({own}, x -> x.kind), ' ') AS form", f"array_join(transform({own}, x -> x.tag), ' ') AS tags")


def fit(a: str, b: str) -> bool:
    """Whether two tags lists agree wherever both are known."""
    return all(x in ("*", y) or y == "*" for s, t in zip(a.split(" "), b.split(" "), strict=True) for x, y in zip(s.split("/"), t.split("/"), strict=True))


KEYS = ["rule", "language", "variant", "form"]
LABELS = "rule string, language string, variant string, form string, tags string, medoid string, size long, loose long"


def groups(spanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of what ``classes`` gives.

    groups: group_id, rule, language, variant, form, canonical (least unit and place of the medoid's class), members, confidence, loose (compatible pairs with spans
    that no group of two or more holds together).  members: group_id, unit, first, last.  A group has two spans at least, all compatible with each other.
    """
    sized = spanned.groupBy(*KEYS, "tags").agg(F.count("*").alias("size"), F.min(F.struct("unit", "first")).alias("least"))

    def solve(table: pd.DataFrame) -> pd.DataFrame:
        # classes by their least span, so that ties fall as they would among units; a class is compatible with itself
        table = table.sort_values(["unit", "first"])
        tags, sizes = table["tags"].tolist(), table["size"].tolist()
        sim = {(i, j): 1.0 for i in range(len(tags)) for j in range(i + 1, len(tags)) if fit(tags[i], tags[j])}
        placed = {m: medoid for medoid, members in refine(list(range(len(tags))), sim, 1.0, 1.0, sizes) for m in members}
        rows = []
        for i, tag in enumerate(tags):
            medoid = placed.get(i, i)
            loose = sum(sizes[i] * sizes[j] for j in range(len(tags)) if (min(i, j), max(i, j)) in sim and placed.get(j, j) != medoid)
            rows.append((tag, tags[medoid], sizes[i], loose))
        out = pd.DataFrame(rows, columns=["tags", "medoid", "size", "loose"])
        return pd.concat([pd.DataFrame({k: [table[k].iloc[0]] * len(out) for k in KEYS}), out], axis=1)

    flat = sized.selectExpr(*KEYS, "tags", "size", "least.unit AS unit", "least.first AS first")
    labelled = flat.groupBy(*KEYS).applyInPandas(solve, LABELS)
    rated = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN {r.confidence}e0" for r in rules) + " END"
    group_id = "sha2(concat_ws('|', rule, language, variant, form, medoid), 256)"
    made = labelled.groupBy(*KEYS, "medoid").agg(F.sum("size").alias("members"), F.sum("loose").alias("loose")).where("members > 1")
    firsts = sized.selectExpr(*KEYS, "tags AS medoid", "least.unit AS canonical_unit", "least.first AS canonical_first")
    made = made.join(firsts, [*KEYS, "medoid"]).selectExpr(f"{group_id} AS group_id", *KEYS, "medoid", "canonical_unit", "canonical_first", "members", f"{rated} AS confidence", "loose")
    held = labelled.selectExpr(*KEYS, "tags", f"{group_id} AS group_id").join(made.select("group_id"), "group_id")
    return made, spanned.join(held, [*KEYS, "tags"]).select("group_id", "unit", "first", "last")
