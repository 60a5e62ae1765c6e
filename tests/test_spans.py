"""Pairs of spans and spans within others against all pairs, and how they are made."""

import random

import pytest

from mirrorlake import registry


@pytest.fixture(scope="module")
def part(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(rng.randrange(-50, 400), rng.choice(["f", "g", "h", None]), rng.choice(["a", "B", "é", "z", None]), rng.choice([None, 0, *range(1, 60)])) for _ in range(700)]
    rows += [(7, "f", "a", 30), (7, "f", "z", 30), (None, "f", "a", 9), (401, "alone", "a", 5)]
    path = str(tmp_path_factory.mktemp("spans"))
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{path}/part.parquet")
    rem = lambda k: None if k is None else (k % 100 if k >= 0 else -(-k % 100))
    return path, [(k, f, c, rem(k), None if k is None or n is None else rem(k) + n) for k, f, c, n in rows]


def test_covered_labels(spark, part):
    path, rows = part
    fit = [(k, f, s, e) for k, f, _, s, e in rows if f is not None and e is not None]
    want = sorted((k, o) for k, f, s, e in fit if k % 2 == 0 for o, g, t, u in fit if o > 0 and o % 2 == 1 and f == g and s < u and t < e and 2 * (min(e, u) - max(s, t) + 1) >= max(e, u) - min(s, t) + 1)
    found = registry.queries()["label_cover"](spark, path)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 1000
    assert found.rdd.getNumPartitions() > 100  # three files' pairs are more than three tasks'


def test_labels_within(spark, part):
    path, rows = part
    fit = [r for r in rows if None not in r]
    want = {}
    for k, f, c, s, e in fit:
        inside = [o for o, g, d, t, u in fit if f == g and d.encode() <= c.encode() and t <= s and e <= u and o != k]
        if inside:
            want[k] = min(inside + [want.get(k, 10**9)])
    found = registry.queries()["label_shown_within"](spark, path)
    got = found.collect()
    assert {r.l: r.shown_in for r in got} == want and len(got) == len(want) > 100
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and not [x for x in joins if "<=" in x]  # no pairs of spans are made


def test_pairs_of_few_files_are_many_tasks(spark, part):
    path, rows = part
    fit = [r for r in rows if r[0] is not None and r[1] is not None]
    found = registry.queries()["no_self_overlap"](spark, path)
    assert found.count() == sum(a[1] == b[1] and a[0] < b[0] for a in fit for b in fit)
    assert found.rdd.getNumPartitions() > 100
