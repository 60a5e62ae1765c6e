"""Packing, forced-boundary BPE and transducer counts against the tokenizers library."""

import array
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from mirrorlake.llm import bpe_codec, packing, token_counts  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(11)
ALPHABET = "abcdefstrvelm''''  \n\t 019!?éßñ%*中　\x1c\x85İΣς́A🙂"
TEXTS = ["".join(RNG.choice(ALPHABET) for _ in range(RNG.randint(0, 60))) for _ in range(400)]
TEXTS += ["", None, " ", "x  ", "\n\n a", "'lls 've", " 'tis don't  won't\n's", "'s" * 300, "a" * 5000, "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", " <|startoftext|>x", "the same text", "the same text", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, length int").repartition(3)


def library(path):
    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch([x or "" for x in TEXTS], add_special_tokens=False)]


def test_counts(docs):
    want = library(BYTE)
    got = {r.doc_id: r for r in token_counts.token_counts(docs, limit=100).collect()}
    assert len(got) == len(TEXTS)
    for i, ids in enumerate(want):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(ids), len((TEXTS[i] or "").encode()), len(ids) > 100), repr(TEXTS[i])


def test_chunks_of_any_length_give_the_same_pieces(monkeypatch):
    texts = [t or "" for t in TEXTS]
    want = token_counts.Counter(BYTE).count(texts)
    for chunk, cells in ((3, 50), (7, 10_000), (4096, 1 << 20)):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        monkeypatch.setattr(token_counts, "CELLS", cells)
        assert (token_counts.Counter(BYTE).count(texts) == want).all()


def test_state_maps_compose():
    rng = np.random.default_rng(3)
    maps = rng.integers(0, 8, (37, 8)).astype(np.uint8)
    scanned, state = token_counts.compose_scan(maps), np.arange(8)
    for i, m in enumerate(maps):
        state = m[state]
        assert (scanned[i] == state).all()


def test_codec(docs):
    want, t = library(WORD), Tokenizer.from_file(WORD)
    digests = {r.doc_id: r for r in bpe_codec.encode_digests(docs).collect()}
    full = {r.doc_id: r for r in bpe_codec.encode(docs).collect()}
    for i, ids in enumerate(want):
        text = t.decode(ids, skip_special_tokens=False)
        assert (full[i].ids, full[i].decoded) == (ids, text), repr(TEXTS[i])
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(array.array("I", ids).tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_forced_boundaries_are_certain():
    codec = bpe_codec.word_bpe(WORD)
    for token in codec.machine.spelled.values():
        assert len(list(codec.cut(token))) == 1


def test_packing(docs):
    want = library(BYTE)
    rows = packing.pack(docs).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, ids in enumerate(want):
        ids = [*ids, 0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            data = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(data), data)
            at += r.length
        assert at == len(ids)
    padded = total = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.sequence_length == sum(x.length for x in s)
            at += r.length
        assert at <= 1024
        total += at
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    assert padded < 0.02 * total


def test_cuts_and_classes():
    for n in range(1, 3000):
        sizes = list(packing.cuts(n, 1024, 64))
        assert sum(sizes) == n and all(s == 1024 or s & (s - 1) == 0 for s in sizes[:-1])


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none).collect() == token_counts.token_counts(none).collect() == bpe_codec.encode_digests(none).collect() == []


def test_null_and_repeated_ids(spark):
    rows = [(None, "one two"), (1, "one two"), (1, "three"), (1, "three"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    size = {t: len(Tokenizer.from_file(BYTE).encode(t or "", add_special_tokens=False).ids) for _, t in rows}
    counts = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(docs).collect())
    assert counts == sorted((i or 0, size[t]) for i, t in rows)
    coded = bpe_codec.encode_digests(docs).collect()
    assert sorted(r.doc_id or 0 for r in coded) == [0, 1, 1, 1, 2] and len({r.ids_sha256 for r in coded}) == 3
    packed = packing.pack(docs).collect()
    assert sum(r.length for r in packed) == sum(size[t] + 1 for _, t in rows) and sum(r.start == 0 for r in packed) == len(rows)
