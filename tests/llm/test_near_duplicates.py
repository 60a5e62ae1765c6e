"""Near duplicates against brute force over all pairs, and the cases of the docstring."""

import itertools
import random

import numpy as np

from mirrorlake.llm import near_duplicates as nd
from mirrorlake.llm.components import components


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            group[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = rng.choices(vocab, k=rng.randint(3, 120))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    chain = rng.choices(vocab, k=200)
    for k in range(8):  # neighbours are alike, the ends are not
        texts.append(" ".join(chain[6 * k : 6 * k + 100]))
    texts += ["", None, "one", "ONE", "one two", "one  two\n", "ÄB cd", "äb cd", texts[0], texts[0]]
    return list(enumerate(texts, 100))


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, key int").repartition(3)
    for words in (2, 5):
        got = {r.doc_id: r for r in nd.groups(docs, words, 80).collect()}
        want = brute(rows, words, 80)
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_empty_table_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert nd.groups(none, 2, 80).collect() == []
    rows = nd.groups(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string"), 2, 80).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (1, 1, True), (2, 1, False)]


def test_rows_that_repeat_a_doc_id_keep_their_links(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (3, b + " z"), (4, a + " q"), (7, c), (8, a.upper()), (9, None), (9, c), (9, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in nd.groups(docs, 2, 80).collect()}
    assert got == {(i, n): 7 if i in (7, 9) and n else 9 if i == 9 else 1 for i, n in got}
    assert len(nd.groups(docs, 2, 80).collect()) == len(rows)


def test_very_long_texts(spark):
    rng = random.Random(1)
    long = [f"v{rng.randrange(50_000)}" for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-200])), (3, "x" * 3_000_000), (4, " ".join(long[::-1]))]
    got = {r.doc_id: r.component_id for r in nd.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(1)
    most = nd.CHUNKS * (nd.ERRORS + 1) - 1
    a = rng.integers(0, 2**16, (200, nd.VALUES), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(nd.VALUES, most, replace=False)] ^= np.uint16(1)
    x, y = nd.index_keys(a), nd.index_keys(b)
    assert all((p == q).any() for p, q in zip(x, y, strict=True))


def test_components_of_a_long_chain(spark, tmp_path):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 70)], "a long, b long")
    got = {r.node: r.component for r in components(links, str(tmp_path)).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 70: 50, 100: 50}


def test_large_buckets_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 3)
    monkeypatch.setattr(nd, "ROUNDS", 0)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.groups(docs, 2, 80).collect()}
    assert got == brute(rows, 2, 80)
