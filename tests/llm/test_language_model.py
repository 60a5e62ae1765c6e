"""The language model against a plain dictionary version of the same formulas."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from mirrorlake.llm import kneser_ney, lm_score
from mirrorlake.llm.common import fold

END = b" end"  # no word
random.seed(3)
WORDS = [f"w{i}" for i in range(40)]
TEXTS = [" ".join(random.choices(WORDS, weights=[1 / (i + 1) for i in range(40)], k=random.randint(0, 60))) for _ in range(60)]
TEXTS += ["", None, "Über Straße\tnew\x0bline", TEXTS[0], TEXTS[0], "a" * 5000 + " b"]


def tokens(text):
    return [w.lower() if w.isascii() else w.encode().lower() for w in (text or "").split()]


def plain(train, tests, order=3):
    """Interpolated modified Kneser-Ney by dictionaries; a text has order - 1 begin marks (None)."""
    words = [kneser_ney.words_of(t) + [END] for t in train]
    unigrams = Counter(w for t in words for w in t)
    total, size = sum(unigrams.values()), len(unigrams)
    grams = lambda t: zip(*([None] * (order - 1 - k) + t for k in range(order)))
    top = Counter(g for t in words for g in grams(t))
    levels = [top]
    while len(next(iter(levels[0]))) > 1:
        levels.insert(0, Counter(g[1:] for g in levels[0]))

    def disc(values):
        c = Counter(values)
        return kneser_ney.discounts([c[k] for k in (1, 2, 3, 4)])

    cut = lambda d, c: ([0, *d])[min(c, 3)]
    ds, contexts = [disc(level.values()) for level in levels], [defaultdict(list) for _ in levels]
    for level, held in zip(levels, contexts):
        for g, c in level.items():
            held[g[:-1]].append(c)

    def p(gram):
        k = len(gram) - 1
        below = p(gram[1:]) if k else 1 / (size + 1)
        held = contexts[k].get(gram[:-1])
        if not held:
            return below
        c = levels[k][gram]
        return (max(c - cut(ds[k], c), 0) + sum(cut(ds[k], x) for x in held) * below) / sum(held)

    out = []
    for t in tests:
        ws = kneser_ney.words_of(t) + [END]
        base = sum(math.log10((unigrams[w] + 0.1) / (total + 0.1 * (size + 1))) for w in ws)
        out.append((len(ws), sum(w in unigrams for w in ws), total, base, sum(math.log10(p(g)) for g in grams(ws))))
    return out


@pytest.mark.parametrize("fan", [4096, 2])
def test_scores_equal_the_plain_version(spark, monkeypatch, fan):
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 2000)  # several shards
    monkeypatch.setattr(kneser_ney, "FAN", fan)  # with and without the middle level of merging
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    got = {r.doc_id: r for r in lm_score.score_held_out(docs).collect()}
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(TEXTS))]
    want = plain([t for t, h in zip(TEXTS, held) if not h], TEXTS)
    assert len(got) == len(TEXTS)
    for i, (n, known, total, base, score) in enumerate(want):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9), i


def test_pairs_equal_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 3000)
    monkeypatch.setattr(kneser_ney, "RUN", 40)  # blocks are sent on early
    layout = lm_score.fit(spark.createDataFrame([(t,) for t in TEXTS], "text string"), "pairs-test", 2)
    model = kneser_ney.Reader(layout)
    hashes, ends = kneser_ney.token_hashes([(t or "").encode().lower() for t in TEXTS])
    slots = model.slots(hashes)
    logs = model.log_probabilities(slots, ends)[:, 0]
    for t, a, b in zip(plain(TEXTS, TEXTS, 2), [0, *(ends[:-1] + 1)], ends, strict=True):
        assert logs[a : b + 1].sum() == pytest.approx(t[4], rel=1e-9)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "c"), (1, "c"), (2, None)]
    got = lm_score.score_held_out(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 2), (1, 2), (1, 3), (2, 1)]


def test_word_hashes():
    rng = random.Random(4)
    blanks = " \t\n\x0b\x0c\r"
    texts = ["".join(rng.choice("abé\x00ÿ" + blanks) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", " ", "ab" * 100, "one", "x" * 31, "x" * 32 + " y", "x" * 33]
    every = []
    for piece in (1 << 20, 16):
        kneser_ney.PIECE, kept = piece, kneser_ney.PIECE
        hashes, ends = kneser_ney.token_hashes([t.encode() for t in texts])
        kneser_ney.PIECE = kept
        words = [w for t in texts for w in [*t.encode().split(), None]]
        assert len(hashes) == len(words) and [k for k, w in enumerate(words) if w is None] == ends.tolist()
        number = dict(zip(words, hashes.tolist()))
        assert [number[w] for w in words] == hashes.tolist() and len(set(number.values())) == len(number)
        every.append(hashes.tolist())
    assert every[0] == every[1]


def test_counts_beyond_a_byte():
    rows = kneser_ney.np.array([[1, 300], [255, 0], [254, 1 << 40]])
    held = kneser_ney.Counts(kneser_ney.np.frombuffer(kneser_ney.counts_bytes(rows), kneser_ney.np.uint8))
    assert held.rows(kneser_ney.np.array([2, 0, 1, 1])).tolist() == rows[[2, 0, 1, 1]].tolist()


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    layout = lm_score.fit(docs, "sum-test")
    model = kneser_ney.Reader(layout)
    vocab = sorted({w for t in TEXTS for w in kneser_ney.words_of(t)} | {b"never-seen"})
    for left in ([vocab[0]], [vocab[5], vocab[7]], [b"w0", b"w1"]):
        hashes, ends = kneser_ney.token_hashes([b" ".join([*left, w]) for w in vocab] + [b" ".join(left)])
        logs = model.log_probabilities(model.slots(hashes), ends)[:, 0]
        each = len(left) + 2
        assert sum(10 ** logs[each * i + len(left)] for i in range(len(vocab) + 1)) == pytest.approx(1, abs=1e-9)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score_held_out(none).collect() == []
    one = spark.createDataFrame([(10, "a b")], "doc_id long, text string")
    assert fold(10) is not None
    [row] = lm_score.score(one.selectExpr("text", "doc_id", "true AS held_out"), lm_score.fit(none.select("text"))).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)
