"""Operators without an oracle, against plain versions on small inputs."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from mirrorlake import registry
from mirrorlake.engine import Engine
from mirrorlake.operators import align, budget, cluster, graph
from mirrorlake.sources import lexers, scan
from mirrorlake.streaming import incremental


def test_lcs_equals_the_table():
    rng = random.Random(2)
    for _ in range(60):
        a, b = rng.choices("abcd", k=rng.randint(0, 12)), rng.choices("abcd", k=rng.randint(0, 12))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert align.lcs(a, b) == t[-1][-1]


def test_sequence_columns(spark):
    rows = [(["a", "b", "c"], ["a", "x", "c"]), ([], []), (["a"], None)]
    frame = spark.createDataFrame(rows, "x array<string>, y array<string>")
    got = frame.select(align.sequence_similarity("x", "y").alias("s"), align.substitution_witness("x", "y").alias("w")).collect()
    assert [round(r.s, 6) for r in got] == [0.666667, 1.0, 0.0]
    assert (got[0].w.edits, got[0].w.changes) == (1, 1)


def test_dominators_by_removal(spark):
    rng = random.Random(4)
    edges = {(rng.randint(1, n - 1), n) for n in range(2, 25) for _ in range(2)} | {(20, 5), (9, 3)}

    def reached(without):
        seen, stack = set(), [1] if without != 1 else []
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                stack += [t for s, t in edges if s == n and t != without]
        return seen

    every = reached(None)
    dominates = {d: every - reached(d) for d in every}
    tree = graph.dominators(spark.createDataFrame([(7, *e) for e in edges], "graph long, src long, dst long"), 1)
    got = {r.node: r.dominator for r in tree.collect()}
    assert set(got) == every - {1}
    for node, d in got.items():
        strict = [x for x in every if node in dominates[x] and x != node]
        assert d in strict and all(d in dominates[x] for x in strict if x != d)
        assert d == max(strict, key=lambda x: sum(x in dominates[o] for o in strict))
    sizes = spark.createDataFrame([(n, n) for n in every], "node long, bytes long")
    kept = {r.node: r.retained for r in graph.retained(tree.select("node", "dominator"), sizes).collect()}
    assert kept == {n: sum(dominates[n]) for n in every}


def test_reach_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    assert {r.node for r in graph.reach(edges, spark.range(1, 2).toDF("root")).collect()} == {1, 2, 3}
    parts = graph.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    assert {r.node: r.component for r in parts.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_a_drifting_chain_is_no_group(spark):
    edges = spark.createDataFrame([(i, i + 1, 0.9) for i in range(6)], "a long, b long, similarity double")
    got = cluster.cohesive_groups(edges).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.medoid, set()).add(r.member)
    assert all(len(g) <= 2 for g in groups.values())
    every = [m for g in groups.values() for m in g]
    assert len(every) == len(set(every))


def test_lexers(spark):
    rust = 'fn add<\'a>(x: &\'a u32) -> u32 { /* no */ let s = r#"a "b" c"#; x + 1_0 } // end\nimpl Foo { fn b() { } }'
    kinds = [(k, t) for k, t, _, _ in lexers.lex(rust, "rust")]
    assert ("lifetime", "'a") in kinds and ("literal", 'r#"a "b" c"#') in kinds and ("keyword", "fn") in kinds and not any("no" == t for _, t in kinds)
    assert [(u[0], u[1]) for u in lexers.units(lexers.lex(rust, "rust"), "rust")] == [("function", "add"), ("impl", "Foo"), ("function", "b")]
    cpp = '#define A \\\n 1\nint f(int a) { if (a) { g(a); } return u8R"x(")x"[0]; }\nstruct P { int q; };'
    tokens = lexers.lex(cpp, "cpp")
    assert tokens[0][0] == "directive" and ("literal", 'u8R"x(")x"') in [(t[0], t[1]) for t in tokens]
    assert [(u[0], u[1]) for u in lexers.units(tokens, "cpp")] == [("function", "f"), ("record", "P")]
    assert lexers.lex('"open', "c") == [("literal", '"open', 0, 1)] and lexers.lex("", "c") == []
    frame = spark.createDataFrame([(1, "rust", rust), (2, "c", None), (3, "go", "x")], "file_id long, language string, content string")
    assert {r.file_id: len(r.tokens) for r in lexers.tokens_of(frame).collect()} == {1: len(kinds), 2: 0, 3: 0}
    assert lexers.units_of(frame).count() == 3


def test_scan_record_and_compare(spark, tmp_path):
    src = tmp_path / "src"
    (src / "gen").mkdir(parents=True)
    (src / "a.rs").write_text("fn a() {}\n")
    (src / "b.rs").write_text("fn a() {}\n")
    (src / "gen" / "c.rs").write_text("// @generated\nfn c() {}\n")
    (src / "x.h").write_text("int x;\n")
    (src / "note.txt").write_text("no")
    files = scan.settle_headers(scan.tree(spark, str(src)))
    got = {r.path.rsplit("/", 1)[1]: (r.language, r.dropped) for r in files.collect()}
    assert got == {"a.rs": ("rust", None), "b.rs": ("rust", None), "c.rs": ("rust", "generated"), "x.h": ("c", None), "note.txt": (None, "language")}
    engine = Engine(spark, str(tmp_path / "store"))
    kept = files.where("dropped IS NULL").drop("content_hash")
    engine.scan(kept, run_id=1)
    engine.scan(kept.where(~F.col("path").endswith("b.rs")), run_id=2)
    [group] = engine.report(1).collect()
    assert group.instances == 2 and engine.report(2).count() == 0
    assert engine.explain(1, group.group_id[:8]).count() == 2
    with pytest.raises(ValueError):
        engine.explain(1, "abc")
    assert [r.state for r in engine.baseline_delta(1, 2).collect()] == ["gone"]
    assert engine.store.preceding(2) == 1 and engine.store.preceding(1) is None
    assert engine.store.prune(1) == [1] and [r.run_id for r in engine.store.runs().collect()] == [2]


def test_seams(spark):
    paths = spark.createDataFrame([(c, p) for c in range(5) for p in ("a", "b")] + [(9, "c")], "id long, path string")
    assert [(r.a, r.b, r.support) for r in Engine.suggest_seams(paths).collect()] == [("a", "b", 5)]
    ledger = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], "seam string, member int, path string")
    assert Engine.guard(spark.createDataFrame([("a",)], "path string"), ledger).count() == 1
    assert Engine.guard(spark.createDataFrame([("a",), ("b",)], "path string"), ledger).count() == 0
    kinds = spark.createDataFrame([(c, "fix") for c in (*range(5), 9)], "id long, kind string")
    [row] = Engine.history(kinds, paths).collect()
    assert (row.n, row.median_size, row.p90_size) == (6, 2, 2)


def test_streaming_forms(spark, tmp_path):
    rows = [("a", "h1", "2024-01-01 00:00:00"), ("a", "h1", "2024-01-01 01:00:00"), ("a", "h2", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "path string, content_hash string, t string").selectExpr("path", "content_hash", "timestamp(t) AS seen_at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, content_hash string, seen_at timestamp").parquet(str(tmp_path / "in"))
    query = incremental.changed_files(stream).writeStream.format("memory").queryName("changed").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("changed").count() == 2


def test_interval_join_finds_every_range(spark, tmp_path):
    orders, part = list(range(0, 60_000, 7)), [(k, k % 50 + 1) for k in range(1, 1600)]
    spark.createDataFrame([(k,) for k in orders], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(part, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    want = sorted((o, 37 * k, 37 * k + n) for k, n in part for o in range(-(-37 * k // 7) * 7, 37 * k + n, 7) if o < 60_000)
    got = registry.queries()["interval_join"](spark, str(tmp_path))
    assert sorted((r.address, r.lo, r.hi) for r in got.collect()) == want


def test_relocations_cross_bins(spark, tmp_path):
    orders, part = list(range(0, 20_000, 3)), [(k, k % 50 + 1) for k in range(1, 500)]
    spark.createDataFrame([(k,) for k in orders], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(part, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    want = {k: [o for o in range(37 * k, 37 * k + n) if o % 3 == 0 and o < 20_000] for k, n in part}
    got = registry.queries()["relocations_in_symbol"](spark, str(tmp_path)).collect()
    assert {r.symbol: list(map(int, r.offsets.split(","))) for r in got} == {k: v for k, v in want.items() if v}


def test_no_row_is_left_out(spark, tmp_path):
    part = [(k, "b", "t", 6, f"n{k}") for k in range(1, 260)]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_type string, p_size int, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    texts = [*["big"] * 70, *["six"] * 6, "a b\na c\n" + "w " * 60 + "\n" + "w " * 59 + "v"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.node, r.component) for r in run("connected_components")} == {(k, 1) for k in range(1, 260)}
    assert {(r.a, r.b) for r in run("no_self_overlap")} == {(a, b) for a in range(1, 260) for b in range(a + 1, 260) if b < a + 6}  # spans of 6 that overlap
    assert sorted((r.n, r.taken) for r in run("component_budget")) == [(6, True), (70, False)]
    assert len(run("substitution_edits")) == 3
    full = "/root/testdata/sf0.001"
    if os.path.isdir(full):
        assert registry.queries()["guard_asymmetric"](spark, full).count() == spark.read.parquet(f"{full}/orders.parquet").count()


def test_minhash_pairs_by_brute_force(spark, tmp_path):
    rng = random.Random(9)
    texts = ["one and the same text of some words"] * 80
    for _ in range(12):
        words = [f"w{rng.randint(0, 300)}" for _ in range(60)]
        texts += [" ".join(words), " ".join([*words[:40], *(f"v{rng.randint(0, 300)}" for _ in range(20))])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    values = {}
    for r in registry.queries()["minhash_signatures"](spark, str(tmp_path)).collect():
        values.setdefault(r.doc_id, {})[r.seed] = r.v
    assert {len(v) for v in values.values()} == {128}
    want = {}
    for a, b in itertools.combinations(sorted(values), 2):
        equal = [values[a][s] == values[b][s] for s in range(1, 129)]
        if any(equal[i] and equal[i + 1] for i in range(0, 128, 2)) and sum(equal) / 128 >= 0.3:
            want[a, b] = sum(equal)
    assert len(want) >= 80 * 79 // 2 + 10
    assert {(r.a, r.b): round(128 * float(r.estimate)) for r in registry.queries()["minhash_lsh_pairs"](spark, str(tmp_path)).collect()} == want


def test_globs():
    import re

    for glob, path, hit in itertools.chain([("src/**/*.rs", "src/a/b/c.rs", True), ("src/**/*.rs", "src/c.rs", True), ("*.rs", "a/b.rs", False), ("a?.c", "ab.c", True)]):
        assert bool(re.match(scan.glob_pattern(glob), path)) == hit


def test_budget_skips_what_does_not_fit(spark, monkeypatch):
    rng = random.Random(9)
    sizes = [rng.randint(1, 30) for _ in range(300)]
    monkeypatch.setattr(budget, "AT_ONCE", 7)
    left, want = 200, set()
    for place, size in enumerate(sizes):
        if size <= left:
            want.add(place)
            left -= size
    rows = spark.createDataFrame(list(enumerate(sizes)), "place long, size long").repartition(3)
    assert {r.place for r in budget.admitted(rows, 200).collect()} == want
    assert budget.admitted(rows.limit(0), 10).collect() == []


def test_components_of_random_graphs(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)] + [(300, i) for i in range(301, 310)] + [(500, 500)]
    group = {n: n for e in edges for n in e}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        group[max(x, y)] = min(x, y)
    parts = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in parts.collect()} == {n: find(n) for n in group}


def test_a_tree_with_bytes_that_are_not_text(spark, tmp_path):
    (tmp_path / "a.rs").write_bytes(b"fn a() {}\n// \xff\xfe not UTF-8\n")
    (tmp_path / "b.rs").write_bytes(b"fn b() {}\0\n")
    (tmp_path / "c.rs").write_text("// one\n" * 9 + "// @generated\n")
    (tmp_path / "d.rs").write_text("// one\n" * 10 + "// @generated\n")
    (tmp_path / "e.txt").write_bytes(b"\xff")
    got = {r.path.rsplit("/", 1)[1]: r for r in scan.tree(spark, str(tmp_path)).collect()}
    assert {n: r.dropped for n, r in got.items()} == {"a.rs": None, "b.rs": "binary", "c.rs": "generated", "d.rs": None, "e.txt": "language"}
    assert "\ufffd" in got["a.rs"].content


def test_large_components_are_cut_and_what_that_cost_is_told(spark):
    edges = [(a, b, 0.9) for a, b in itertools.combinations(range(30), 2)]
    frame = spark.createDataFrame(edges, "a long, b long, similarity double")
    groups = {}
    for r in cluster.cohesive_groups(frame, largest=8).collect():
        groups.setdefault(r.medoid, set()).add(r.member)
    severed = {(r.a, r.b) for r in cluster.severed_pairs(frame, largest=8).collect()}
    assert len(groups) > 1
    assert all(((a, b) in severed) != any({a, b} <= g for g in groups.values()) for a, b, _ in edges)
    assert cluster.severed_pairs(frame).count() == 0 and len({r.medoid for r in cluster.cohesive_groups(frame).collect()}) == 1
