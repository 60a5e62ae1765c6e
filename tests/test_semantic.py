"""Rules against matching at every place, groups against complete linkage over all pairs of units."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mirrorlake.operators import semantic
from mirrorlake.operators.cluster import refine

RNG = random.Random(9)
APIS = ["rust::ToString::to_string", "rust::str::parse", "std::to_string", "std::stoull", None]
RUN = {"source", "filter", "map", "reduce", "collect"}
COLUMNS = "unit long, k long, language string, variant string, kind string, type_tag string, fallible string, direct string, resource string, api string"


@pytest.fixture(scope="module")
def ops():
    out = []
    for unit in range(400):
        for k in range(RNG.randint(1, 9)):
            kind = RNG.choice(["map", "map", "map", "source", "collect", "propagate_error", "validate", "acquire_resource", "release_resource", "io"])
            direct = RNG.choice(["result_adapter", "option_adapter", None])
            out.append((unit, 3 * k, RNG.choice(["rust", "cpp"]) if k < 0 else ("rust", "cpp")[unit % 2], "v", kind, RNG.choice(["a", "b", None, None]), RNG.choice(["result", "option", None]), direct, RNG.choice(["file", "lock", None]), RNG.choice(APIS) if kind == "map" else None))
    return out


def by_places(ops):
    units = defaultdict(list)
    for r in sorted(ops):
        units[r[0]].append(dict(zip(("kind", "type", "fallible", "direct", "resource", "api"), r[4:], strict=True)))
    for unit, seq in units.items():
        for i, x in enumerate(seq):
            y = seq[i + 1] if i + 1 < len(seq) else None
            for rule, (p, q) in {"rust-serialization-round-trip-v1": APIS[:2], "cpp-serialization-round-trip-v1": APIS[2:4]}.items():
                if y and x["kind"] == y["kind"] == "map" and (x["api"], y["api"]) == (p, q):
                    yield unit, rule, i, i + 1
            for word in ("result", "option"):
                if x["kind"] == "propagate_error" and x["fallible"] == word and x["direct"] == f"{word}_adapter":
                    yield unit, f"{word}-direct-propagation-v1", i, i
                if x["kind"] == "validate" and x["fallible"] == word:
                    yield unit, ("optional" if word == "option" else word) + "-validation-v1", i, i
            if y and (x["kind"], y["kind"]) == ("acquire_resource", "release_resource") and x["resource"] and x["resource"] == y["resource"]:
                yield unit, "resource-lifecycle-v1", i, i + 1
            if x["kind"] in RUN and (i == 0 or seq[i - 1]["kind"] not in RUN):
                end = i
                while end + 1 < len(seq) and seq[end + 1]["kind"] in RUN:
                    end += 1
                if end > i and any(o["kind"] != "map" for o in seq[i : end + 1]):
                    yield unit, "sequence-pipeline-v1", i, end


@pytest.fixture(scope="module")
def found(spark, ops):
    frame = spark.createDataFrame(ops, COLUMNS).repartition(3)
    return frame, semantic.spans(frame)


def test_spans_equal_a_match_at_every_place(found, ops):
    got = sorted(tuple(r) for r in found[1].collect())
    assert got == sorted(by_places(ops)) and len({r[1] for r in got}) == len(semantic.RULES)


def test_groups_equal_linkage_over_units(found):
    spanned = semantic.classes(*found)
    rows = sorted(spanned.collect(), key=lambda r: (r.unit, r.first))
    made, members = semantic.groups(spanned)
    got = {}
    for r in members.collect():
        got.setdefault(r.group_id, set()).add((r.unit, r.first, r.last))
    keys, parts, want = {}, defaultdict(list), set()
    for r in rows:
        parts[r.rule, r.language, r.variant, r.form].append(r)
    for key, part in parts.items():
        sim = {(i, j): 1.0 for i in range(len(part)) for j in range(i + 1, len(part)) if semantic.fit(part[i].tags, part[j].tags)}
        for medoid, group in refine(list(range(len(part))), sim, 1.0, 1.0):
            ends = frozenset((part[m].unit, part[m].first, part[m]["last"]) for m in group)
            want.add((key, ends))
            keys[ends] = (part[medoid].unit, part[medoid].first, len(group))
    told = {r.group_id: r for r in made.collect()}
    assert {((told[g].rule, told[g].language, told[g].variant, told[g].form), frozenset(m)) for g, m in got.items()} == want and len(want) > 20
    for g, m in got.items():
        assert (told[g].canonical_unit, told[g].canonical_first, told[g].members) == keys[frozenset(m)]
    assert any(r.loose for r in told.values()) and {r.confidence for r in told.values()} <= {0.7, 0.8, 0.85, 0.9, 0.95}


def test_no_operations(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert semantic.spans(none).collect() == [] and semantic.groups(semantic.classes(none, semantic.spans(none)))[0].collect() == []


def test_automaton_bound(spark):
    with pytest.raises(ValueError):
        semantic.spans(spark.createDataFrame([], COLUMNS), tuple(semantic.Rule(f"r{k}", 1.0, ("true",) * 8) for k in range(8)))
    one = spark.createDataFrame([(1, k, "rust", "v", "x", None, None, None, None, None) for k in range(5)], COLUMNS)
    rows = semantic.spans(one, (semantic.Rule("three", 1.0, ("kind = 'x'",) * 3),)).orderBy(F.col("first")).collect()
    assert [(r.first, r["last"]) for r in rows] == [(0, 2), (1, 3), (2, 4)]
    two = (semantic.Rule("pair", 1.0, ("kind = 'x'", "kind = 'x'")), semantic.Rule("same", 1.0, ("true", "kind = 'x'")), semantic.Rule("run", 1.0, run="kind = 'x'", least=2, not_only="y"))
    spans = sorted((r.first, r["last"], r.rule) for r in semantic.spans(one.where("k < 2"), two).collect())
    assert spans == [(0, 1, "pair"), (0, 1, "run"), (0, 1, "same")]
