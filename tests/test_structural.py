"""Copies of functions among generated sources."""

import random
import re

import pytest

from mirrorlake.engine import Engine
from mirrorlake.operators import structural

RNG = random.Random(12)
OPERATORS = ["+", "-", "*", "/", "%", "&", "|", "^"]


def body(names, steps):
    out = []
    for _ in range(steps):
        a, b, c = (RNG.choice(names) for _ in range(3))
        out.append(
            RNG.choice(
                [
                    f"let mut {a} = {b} {RNG.choice(OPERATORS)} {RNG.randint(1, 99)};",
                    f"if {a} > {b} {{ {c} = call_{RNG.randint(0, 9)}({a}, {b}); }}",
                    f"while {a} < {RNG.randint(2, 50)} {{ {a} += {RNG.randint(1, 5)}; {b}[{c}] = {a}; }}",
                    f"for {a} in 0..{b}.len() {{ {c}.push({a} {RNG.choice(OPERATORS)} 1); }}",
                    f"match {a} {{ {RNG.randint(0, 9)} => return {b}, _ => {{ {c} = {a}; }} }}",
                    f"return Err({a}.with({b}, \"{RNG.randint(0, 999)}\"));",
                ]
            )
        )
    return out


def function(name, lines):
    return f"fn {name}(alpha: u32, beta: u32) -> u32 {{\n    " + "\n    ".join(lines) + "\n}\n"


def renamed(text):
    names = {}
    return re.sub(r"\b(alpha|beta|gamma|delta|omega)\b", lambda m: names.setdefault(m[0], f"n{len(names)}"), text)


@pytest.fixture(scope="module")
def found(spark):
    names = ["alpha", "beta", "gamma", "delta", "omega"]
    rows, want = [], {}
    for k in range(8):
        lines = body(names, 14)
        edited = lines[:5] + [f"trace({k});"] + lines[5:11] + lines[12:]
        copies = {"type-1": function(f"f{k}", lines), "type-2": renamed(function(f"g{k}", lines)), "type-3": function(f"h{k}", edited)}
        kinds = ["type-1"] if k % 3 == 0 else ["type-2"] if k % 3 == 1 else ["type-3"]
        want[k] = kinds[0]
        rows += [function(f"f{k}", lines), "// another file\n" + copies[kinds[0]]]
    rows += [function(f"lone{k}", body(names, 14)) for k in range(6)]
    files = [(i, "rust", t) for i, t in enumerate(rows)] + [(900, "rust", None), (901, "text", rows[0]), (902, "rust", "fn short() {}"), (903, "rust", "fn broken( {{{ \"")]
    frame = spark.createDataFrame(files, "file_id long, language string, content string").repartition(3)
    return Engine(spark).scan_structural(frame), want


def test_planted_copies_are_found_and_nothing_else(found):
    result, want = found
    kinds = {r.group_id: r["class"] for r in result.groups.collect()}
    groups = {}
    for r in result.members.collect():
        groups.setdefault(r.group_id, set()).add(r.file_id)
    got = {frozenset(files): kinds[g] for g, files in groups.items()}
    assert got == {frozenset((2 * k, 2 * k + 1)): kind for k, kind in want.items()}
    assert result.dropped.count() == 0


def test_no_files(spark):
    none = spark.createDataFrame([], "file_id long, language string, content string")
    result = structural.find(none)
    assert result.groups.count() == 0 and result.members.count() == 0


def test_forms():
    raw, numbered, shape = structural.forms([("ident", "a", 0, 1), ("punct", "=", 0, 1), ("ident", "b", 0, 1), ("punct", "+", 0, 1), ("ident", "a", 0, 1), ("number", "1", 0, 1)])
    assert (raw, numbered, shape) == (["a", "=", "b", "+", "a", "1"], ["v0", "=", "v1", "+", "v0", "1"], ["v", "=", "v", "+", "v", "l"])


SHAPES = {
    "rust": ["fn sum(values: &[i32]) -> i32 {\n    let mut total = 0;\n    for value in values {\n        if value % 2 == 0 {\n            total += value;\n        }\n    }\n    total\n}\n",
             "fn sum(values: &[i32]) -> i32 {\n    let mut total = 0;\n    let mut seen = 0;\n    for value in values {\n        seen += 1;\n        if value % 2 == 0 {\n            total += value;\n        }\n    }\n    let _ = seen;\n    total\n}\n"],
    "c": ["int sum(const int *values, int n) {\n    int total = 0;\n    for (int i = 0; i < n; i += 1) {\n        if (values[i] > 2) {\n            total += values[i];\n        }\n    }\n    return total;\n}\n",
          "int sum(const int *values, int n) {\n    int total = 0;\n    int seen = 0;\n    for (int i = 0; i < n; i += 1) {\n        seen += 1;\n        if (values[i] > 2) {\n            total += values[i];\n        }\n    }\n    total += seen - seen;\n    return total;\n}\n"],
}


def test_kinds_of_copies_are_recorded_as_a_run(spark, tmp_path):
    """Of each language the seed, the same in another place, a renamed and an edited one: a group, and the edited one beside the seed as a pair, as it is too far from the renamed one; a run of them is ranked, suppressed, explained and compared."""
    rows = []
    for language, (seed, edited) in SHAPES.items():
        other = re.sub(r"\b(values|total|sum)\b", lambda m: {"values": "items", "total": "all", "sum": "add"}[m[0]], seed)
        rows += [(len(rows) + k, f"{language}/d{k}/f.x", f"{language}/d{k}", language, t) for k, t in enumerate([seed, "// copied\n\n" + seed, other, edited])]
    lone = "fn lone(a: &str) -> bool { match a { \"x\" => true, \"y\" => { return check(a, 3); } _ => a.len() > 4 } }\n"
    rows.append((90, "rust/d9/f.x", "rust/d9", "rust", lone))
    files = spark.createDataFrame(rows, "file_id long, path string, directory string, language string, content string").repartition(2)
    engine = Engine(spark, str(tmp_path / "store"))
    found = engine.scan_structural(files, run_id=1, suppress=("c/**",))
    file_of = {r.unit_id: r.file_id - (r.file_id in (1, 5)) for r in found.functions.collect()}  # a copy stands for its seed
    assert {frozenset((file_of[r.a], file_of[r.b])) for r in engine.store.read("pairs").collect()} == {frozenset((0, 3))} and found.severed.count() == 0
    shown = engine.report(1).collect()
    assert [(r.instances, r["class"], r.directories) for r in shown] == [(3, "type-2", 3)] and 0 < shown[0].priority < 1
    assert {r.file_id for r in engine.explain(1, shown[0].group_id[:12]).collect()} == {0, 1, 2}
    engine.scan_structural(files.where("file_id <> 3"), run_id=2)
    assert [(r.instances, r["class"]) for r in engine.report(2).collect()] == [(3, "type-2"), (3, "type-2")]
    assert {r.state for r in engine.baseline_delta(1, 2).collect()} == {"continuing"}
