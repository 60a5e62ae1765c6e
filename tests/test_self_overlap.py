"""Every pair of one file's spans, overlapping or apart."""

import itertools

from mirrorlake import registry


def test_all_pairs_of_a_file(spark, tmp_path):
    part = [(k, f"file{k % 2}", k % 50 + 1) for k in range(1, 300)]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    want = {}
    for (a, f, n), (b, g, m) in itertools.combinations(part, 2):
        if f == g:
            want[a, b] = not set(range(a % 100, a % 100 + n)) & set(range(b % 100, b % 100 + m))
    got = registry.queries()["no_self_overlap"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b): r.apart for r in got} == want and len(got) == len(want)
    assert set(want.values()) == {True, False}
