"""Chat formatting, vector codes and the Merkle manifest against plain versions."""

import hashlib
import math
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from mirrorlake.llm import chat_format, merkle_manifest, vector_codes
from mirrorlake.llm.chat_format import CHATML, PROBE, Template

RNG = random.Random(4)
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


# --- chat formatting ------------------------------------------------------------------------------


def test_escapes_come_back():
    pieces = ["<", "|", "\\", "<|", "<\\|", "im_end|>", "<|im_end|>", "<|im_start|>assistant\n", "\n", "a", "é", "<<|", ""]
    for _ in range(3000):
        text = "".join(RNG.choices(pieces, k=RNG.randint(0, 8)))
        out = CHATML.escape(text)
        assert "<|" not in out and CHATML.unescape(out) == text


def test_reader_takes_pieces_as_they_come():
    turns = [("user", PROBE), ("we\\ird\n<|role", "x\n\ny <\\\\| <"), ("", ""), ("assistant", "<|im_end|>\n")]
    whole = "".join(s for t in turns for s, _ in CHATML.segments(*t))
    for size in (1, 2, 7, len(whole)):
        reader, got = chat_format.Reader(CHATML), []
        for at in range(0, len(whole), size):
            got += reader.feed(whole[at : at + size])
        reader.close()
        assert got == turns
    reader = chat_format.Reader(CHATML)
    assert list(reader.feed(whole[:20])) == []
    with pytest.raises(ValueError):
        reader.close()
    with pytest.raises(ValueError):
        list(chat_format.Reader(CHATML).feed("hello <|im_end|>\n"))


def test_templates_are_checked():
    good = dict(lead="[[", mark="~", opening="[[turn]]", closing="[[done]]", learned=frozenset({"bot"}), order={"": {"bot": "said"}, "said": {}}, final=frozenset({"said"}))
    other = Template(**good)
    assert other.unescape(other.escape("[[turn]] [~[ [[[")) == "[[turn]] [~[ [[[" and "[[" not in other.escape("[[turn]] [~[ [[[")
    for change in (dict(lead="["), dict(mark="["), dict(closing="done"), dict(closing="[[turn]]x"), dict(order={"": {"bot": "gone"}}), dict(final=frozenset({"never"}))):
        with pytest.raises(ValueError):
            Template(**(good | change))


@pytest.fixture(scope="module")
def talks(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", PROBE), (1, 3, "user", None),
        (2, 5, "assistant", "first"), (2, 4, "assistant", "zero"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, None, None, "no role\n<|"), (4, 1, "user", "x"),
        (None, 0, "user", "nobody"), (None, 1, "assistant", "é" * 300_000 + "<|im_end|>"), (5, 0, "system", ""), (6, 0, "us\ner<|", "odd \\ role"),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, state string, problem long").repartition(3)


def plain_talks(rows):
    held = {}
    for r in rows:
        held.setdefault(r.conv_id, []).append(r)
    for conv, turns in held.items():
        turns.sort(key=lambda r: (r.turn is not None, r.turn or 0, r.role is not None, r.role or "", r.text is not None, r.text or ""))
        yield conv, [(r.role or "", r.text or "") for r in turns]


def test_digests_equal_a_plain_version(talks):
    got = {r.conv_id: r for r in chat_format.digests(talks).collect()}
    for conv, turns in plain_talks(talks.collect()):
        said = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(s for t in turns for s, _ in CHATML.segments(*t))
        r = got.pop(conv)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(turns), SHA("".join(f"{a}\n{b}\n" for a, b in turns)), len(said), SHA(said), len(whole))
        roles = "".join({"system": "s", "user": "u", "assistant": "a"}.get(a, "x") for a, _ in turns)
        at, state = None, ""
        for k, c in enumerate(roles):
            if c not in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                at = k
                break
            state = c
        if at is None and state == "s":
            at = len(roles)
        assert (r.valid, r.problem) == (at is None, at), roles
    assert not got


def test_query_equals_its_sql(talks):
    con = duckdb.connect()
    con.register("held", talks.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE VIEW conversations AS FROM held")
    found = chat_format.digests(chat_format.with_probe(talks))
    want = con.sql(chat_format.oracle())
    assert sorted(map(repr, (tuple(r) for r in found.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_whole_texts_and_segments(talks):
    whole = {r.conv_id: r for r in chat_format.formatted(talks).collect()}
    parts = {}
    for r in sorted(chat_format.segments(talks).collect(), key=lambda r: (r.conv_id or 0, r.place, r.part)):
        parts.setdefault(r.conv_id, []).append(r)
    for conv, turns in plain_talks(talks.collect()):
        assert whole[conv].text == "".join(r.text for r in parts[conv])
        reader = chat_format.Reader(CHATML)
        assert list(reader.feed(whole[conv].text)) == turns
        learned = [CHATML.unescape(whole[conv].text[s.start : s.end]) for s in whole[conv].loss_spans]
        assert learned == [t for r, t in turns if r == "assistant"] == [CHATML.unescape(r.text) for r in parts[conv] if r.loss]
    assert [r.state for r in parts[1] if r.part == 0] == ["told", "asked", "answered", "asked"]


def test_no_turns_no_rows(talks):
    for f in (chat_format.digests, chat_format.formatted, chat_format.segments):
        assert f(talks.limit(0)).collect() == []


# --- vector codes ---------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    """Everything in Python's integers.  ``rows``: (vec_id, label, vector)."""
    kept = [(i, g, v) for i, g, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = sorted(((i, g, [math.floor(4096 * x) for x in v]) for i, g, v in kept), key=lambda r: (r[0] is None, r[0] or 0))
    w = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v, p: min(range(len(books[p])), key=lambda k: (apart(cut(v, p), books[p][k]), k))
    for _ in range(rounds):
        for p in range(parts):
            at = [pick(v, p) for _, _, v in kept]
            books[p] = [[sum(c) // len(c) for c in zip(*own, strict=True)] if (own := [cut(v, p) for (_, _, v), a in zip(kept, at, strict=True) if a == k]) else old for k, old in enumerate(books[p])]
    out = []
    for i, g, v in kept:
        codes = [pick(v, p) for p in range(parts)]
        out.append((i, g, bytes(codes).hex(), sum(apart(cut(v, p), books[p][c]) for p, c in enumerate(codes))))
    total = {}
    for _, g, _, e in out:
        total[g] = total.get(g, 0) + e
    digest = SHA(",".join(str(x) for book in books for entry in book for x in entry))
    return sorted(repr((i, c, e, total[g], digest)) for i, g, c, e in out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, code string").repartition(3)


def test_codes_equal_a_plain_version(spark):
    import numpy as np

    vector = lambda: [float(np.float32(RNG.gauss(0, 1))) for _ in range(16)]
    rows = [(RNG.randrange(10**9), RNG.choice([None, 1, 2, 2, 2]), vector()) for _ in range(150)]
    rows += [(k, 2, rows[0][2]) for k in range(40)]  # ties: equal vectors, so equal entries of which the first counts
    rows += [(-1, 1, None), (-2, 1, [None] + vector()[1:]), (-3, 1, [float("nan")] + vector()[1:]), (-4, None, [float("inf")] + vector()[1:]), (None, None, vector()), (-5, 3, [-1e-30] * 16)]
    got = vector_codes.compress(frame(spark, rows), parts=4, entries=8, rounds=3).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_codes(rows, 4, 8, 3)
    few = rows[:5]
    assert sorted(repr(tuple(r)) for r in vector_codes.compress(frame(spark, few)).collect()) == plain_codes(few, 8, 16, 6)


def test_vectors_that_have_no_code_keep_their_row(spark):
    good = [(k, k % 2, [float(k)] * 8) for k in range(20)]
    odd = [(100, 5, [1.0] * 7), (101, 5, []), (102, 1, [3e38] + [0.0] * 7), (-1, 1, [2.0] * 3)]
    got = {r.vec_id: r for r in vector_codes.compress(frame(spark, good + odd)).collect()}
    want = {r.vec_id: r for r in vector_codes.compress(frame(spark, good)).collect()}
    assert {k: got[k] for k in want} == want
    assert all((got[k].code, got[k].error) == (None, None) for k in (100, 101, 102, -1)) and got[100].label_error is None and got[102].label_error == want[1].label_error
    assert vector_codes.compress(frame(spark, good).limit(0)).collect() == []
    assert [r.code for r in vector_codes.compress(frame(spark, odd[:2])).collect()] == [None, None]
    again = vector_codes.compress(frame(spark, good + good)).collect()
    assert len(again) == 40 and len({(r.vec_id, r.code) for r in again}) == 20


def test_hot_labels_are_joined_apart(spark, monkeypatch):
    rows = spark.createDataFrame([(k, None if k % 3 else 7, k) for k in range(30)] + [(50, 8, None)], "vec_id long, label long, error long")
    want = sorted(map(repr, vector_codes.with_label_error(rows).collect()))
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 0)
    monkeypatch.setattr(vector_codes, "HOT_LABEL", 15)
    assert sorted(map(repr, vector_codes.with_label_error(rows).collect())) == want


# --- Merkle manifest ------------------------------------------------------------------------------


def plain_manifest(rows, fanout):
    """By lists and indexes, a leaf at a time.  ``rows``: (doc_id, source, lang, n_chars, text)."""
    mark = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: SHA("".join(mark(v) for v in (r[0], r[1], r[2], r[3] if r[3] is None else r[3] + more, r[4])))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([SHA("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
        return levels

    def way(levels, at):
        for level in levels[:-1]:
            run = level[at // fanout * fanout : at // fanout * fanout + fanout]
            yield "".join(run[: at % fanout]), "".join(run[at % fanout + 1 :])
            at //= fanout

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]])
    top = climb([trees[g][-1][0] for g in names])
    for place, g in enumerate(names):
        for k, r in enumerate(groups[g]):
            steps = [*way(trees[g], k), *way(top, place)]
            node = leaf(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for before, after in steps:
                node = SHA(before + node + after)
            yield r[0], leaf(r), trees[g][-1][0], top[-1][0], SHA("".join(a + b for a, b in steps)), node, node == top[-1][0]


@pytest.mark.parametrize("fanout, block", [(2, 4), (3, 9), (2, 8192), (5, 2)])
def test_manifest_equals_a_plain_version(spark, fanout, block):
    rows = [(k, "s", "en", 5, f"text {k}") for k in range(150)] + [(k, None, "de", None, "é" * k) for k in range(200, 217)] + [(7, "s", None, 0, None), (None, "s", "en", 5, ""), (None, None, None, None, None), (3, "s", "en", 5, "text 3"), (3, "t", "en", 5, "other"), (900, "s", "", 1, "lone"), (901, "s", "ü", 2**63 - 1, "x" * 500_000)]
    rows += [(k, "s", f"l{k}", 1, "one each") for k in range(1000, 1040)]
    docs = spark.createDataFrame([(*r, "clash") for r in RNG.sample(rows, len(rows))], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(5)
    got = sorted(repr(tuple(r)) for r in merkle_manifest.manifest(docs, fanout, block, merkle_manifest.every_seventh).collect())
    rows = [r for r in rows if r[0] != 901] + [next(r for r in rows if r[0] == 901)]
    assert zlib.crc32(b"901") % 7, "its n_chars can't be one more"
    assert got == sorted(map(repr, plain_manifest(rows, fanout)))


def test_manifest_of_nothing_and_without_tampering(spark):
    docs = spark.createDataFrame([(1, "a", "en", 3, "abc"), (2, "a", "en", 3, "abd")], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle_manifest.manifest(docs.limit(0)).collect() == []
    assert [r.verified for r in merkle_manifest.manifest(docs).collect()] == [True, True]
    only = merkle_manifest.manifest(docs.limit(1)).collect()[0]
    assert only.root == only.subroot == only.leaf and only.proof_sha256 == SHA("")
    with pytest.raises(ValueError):
        merkle_manifest.manifest(docs, fanout=1)


def test_ranges_without_broadcast(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 3 > 0, "en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.col("id").cast("string").alias("text"))
    want = sorted(map(repr, merkle_manifest.manifest(docs, block=16).collect()))
    monkeypatch.setattr(merkle_manifest, "MOST_BROADCAST", 0)
    assert sorted(map(repr, merkle_manifest.manifest(docs, block=16).collect())) == want
