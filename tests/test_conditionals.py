"""Arms against a stack, predicates against recursion."""

import random
import re

import pytest

from mirrorlake.operators import conditionals

RNG = random.Random(6)


def stack_paths(rows):
    """(pos, path) by walking one file's rows."""
    believed, open_at, faults = {}, [], 0
    for pos, directive, _, fault in rows:
        faults += bool(fault)
        if directive == "if":
            open_at.append((pos, faults - bool(fault)))
            believed[pos] = False
        elif directive == "endif" and open_at:
            at, before = open_at.pop()
            believed[at] = faults == before
    stack, out = [], {}
    for pos, directive, condition, _ in rows:
        if directive == "if":
            stack.append([pos, 0, believed[pos], condition != "false", condition == "true"])
        elif directive in ("elif", "else") and stack:
            if stack[-1][2]:
                stack[-1][1] += 1
                stack[-1][3] = not stack[-1][4] and condition != "false"
                stack[-1][4] |= condition == "true"
        elif directive == "endif" and stack:
            stack.pop()
        elif directive is None:
            out[pos] = [tuple(s[:4]) for s in stack]
    return out


@pytest.fixture(scope="module")
def files():
    out = {}
    for f in range(60):
        kinds = ["if", "if", "elif", "else", "endif", "endif", None, None, None] if f % 2 else ["if", "if", "if", "elif", "endif", None, None]
        rows = []
        for pos in range(RNG.randint(1, 60)):
            kind = RNG.choice(kinds)
            rows.append((pos * 3, kind, RNG.choice(["true", "false", "unknown", None]) if kind in ("if", "elif") else None, kind is None and RNG.random() < 0.04))
        out[f] = rows
    return out


def test_paths_equal_a_stack(spark, files):
    rows = spark.createDataFrame([(f, *r) for f, rs in files.items() for r in rs], "file_id long, pos long, directive string, condition string, fault boolean").repartition(3)
    found = conditionals.arm_paths(rows)
    got = {(r.file_id, r.pos): [tuple(a) for a in r.path] for r in found.collect()}
    want = {(f, pos): path for f, rs in files.items() for pos, path in stack_paths(rs).items()}
    assert got == want and max(map(len, got.values())) > 5
    pairs = found.alias("a").join(found.alias("b"), "file_id").selectExpr("a.path AS x", "b.path AS y", f"{conditionals.excludes('a.path', 'b.path')} AS e", f"{conditionals.coexist('a.path', 'b.path')} AS c").collect()
    seen = set()
    for r in pairs:
        differ = next(((p, q) for p, q in zip(r.x, r.y) if p != q), None)  # noqa: B905  up to the shorter one
        apart = bool(differ) and differ[0].believed and differ[1].believed and differ[0].conditional == differ[1].conditional
        gone = any(not p.reachable for p in [*r.x, *r.y])
        assert (r.e, r.c) == (apart, not gone and not apart)
        seen.add((r.e, r.c))
    assert len(seen) == 3


def recursive(text, enabled):
    tokens = re.findall(conditionals.PREDICATE_TOKEN, text)

    def closing(at):
        depth = 0
        for k in range(at, len(tokens)):
            depth += (tokens[k] == "(") - (tokens[k] == ")")
            if depth == 0:
                return k

    def value(lo, hi):
        part = tokens[lo:hi]
        at = part.index("(") if "(" in part else None
        words = [t for t in (part if at is None else part[:at]) if re.match("[A-Za-z_]", t)]
        if at is None:
            return 3 if not words else (2 if enabled else 1) if words[-1] == "test" else 3
        lo, hi = lo + at + 1, closing(lo + at)
        args, depth, start = [], 0, lo
        for k in range(lo, hi):
            depth += (tokens[k] == "(") - (tokens[k] == ")")
            if tokens[k] == "," and not depth:
                args.append((start, k))
                start = k + 1
        values = [value(*a) for a in [*args, (start, hi)]]
        op = words[-1] if words else ""
        if op == "not":
            return (values[-1] & 1) << 1 | (values[-1] & 2) >> 1
        if op == "all":
            return 2 * all(v & 2 for v in values) | any(v & 1 for v in values)
        if op == "any":
            return 2 * any(v & 2 for v in values) | all(v & 1 for v in values)
        return 3

    return value(0, len(tokens))


def predicate(depth):
    if not depth or RNG.random() < 0.3:
        return RNG.choice(["test", "unix", 'feature = "a(b"', "a::test", "", "windows"])
    return f"{RNG.choice(['all', 'any', 'not', 'all', 'any', 'other'])}({RNG.choice([',', ' , ']).join(predicate(depth - 1) for _ in range(RNG.randint(1, 4)))})"


def test_predicates_equal_a_recursion(spark):
    texts = [predicate(k % 7) for k in range(400)] + ["all()", "not(test)", "not(all(test,unix))", "any(test,not(test))"]
    frame = spark.createDataFrame([(t,) for t in texts], "p string").selectExpr("p", f"{conditionals.predicate_values('p', False)} AS off", f"{conditionals.predicate_values('p', True)} AS on")
    got = frame.collect()
    for r in got:
        assert (r.off, r.on) == (recursive(r.p, False), recursive(r.p, True)), r.p
    assert {r.off for r in got} == {1, 2, 3}


def test_odd_predicates(spark):
    rows = spark.createDataFrame([(None,), ("all(test",), (") test",), ("test",)], "p string").selectExpr(f"{conditionals.predicate_values('p', True)} AS v").collect()
    assert [r.v for r in rows] == [None, 3, 2, 2]
