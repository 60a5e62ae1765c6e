"""Classes by counts that are joined back, on a table where one line stands in half of the files."""

import pytest

from mirrorlake.functions.dialect import Spark
from mirrorlake.plans.fingerprinting import occurrence_ranks
from mirrorlake.plans.sql import composed
from mirrorlake.sources.relations import exact_members, unit_groups, units


@pytest.fixture(scope="module")
def files():
    hot = "a line that stands in half of the files"
    rows = [(k, f"own text of the file {k}\n{hot}" if k % 2 else hot) for k in range(0, 3000, 3)]
    return rows + [(9001, None), (9002, ""), (9003, hot), (9004, "twice in one\ntwice in one file, here")]


def run(spark, files, text, *relations):
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in files], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).createOrReplaceTempView("documents")
    try:
        return spark.sql(composed({r.__name__: r(Spark()) for r in relations}, text)).collect()
    finally:
        spark.catalog.dropTempView("documents")


def test_members_of_classes(spark, files):
    held = {}
    for k, t in files:
        if t is not None:
            held.setdefault(t, []).append(k)
    want = {k: (len(ks), 1 if k == min(ks) else 2) for ks in held.values() if len(ks) > 1 for k in ks}
    got = run(spark, files, "SELECT * FROM exact_members", exact_members)
    assert {r.doc_id: (r.sz, r.rn) for r in got} == want and len(got) == len(want) > 400


def test_ranks_of_a_hot_line(spark, files):
    held = {}
    for k, t in files:
        for n, line in enumerate((t or "").split("\n")):
            if len(line) >= 20:
                held.setdefault(line, []).append((k, n))
    want = {u: i for us in held.values() if len(us) > 1 for i, u in enumerate(sorted(us))}
    got = run(spark, files, occurrence_ranks(Spark()), units, unit_groups)
    assert {(r.unit_id >> 24, r.unit_id & 0xFFFFFF): r.occurrence for r in got} == want and max(want.values()) >= 1000
