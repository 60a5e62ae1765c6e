"""Megabytes in one text, also as a single word, through the operators that take whole texts."""

import array
import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from mirrorlake.llm import bpe_codec, merkle_manifest, ogg_audio, packing, quality_model, token_counts, toxicity  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(5)
LETTERS = "".join(RNG.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(3_000_00))
TEXTS = {1: LETTERS * 7, 2: "ab" * 400_000, 3: ("some words, and 12 more.\n" * 90_000), 4: " " * 700_000, 5: None, 6: "short"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "a", "en", len(t or "")) for i, t in TEXTS.items()], "doc_id long, text string, source string, lang string, n_chars long").repartition(3)


def test_tokens_equal_the_library(docs):
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    counts = {r.doc_id: r for r in token_counts.token_counts(docs, limit=1024).collect()}
    codes = {r.doc_id: r for r in bpe_codec.encode_digests(docs).collect()}
    sizes = {}
    for r in packing.pack(docs, with_ids=False).collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    for i, text in TEXTS.items():
        n = len(byte.encode(text or "", add_special_tokens=False).ids)
        assert (counts[i].n_tokens, counts[i].over_limit, sizes[i]) == (n, n > 1024, n + 1)
        ids = word.encode(text or "", add_special_tokens=False).ids
        back = word.decode(ids, skip_special_tokens=False)
        assert (codes[i].n_tokens, codes[i].ids_sha256, codes[i].decoded_sha256) == (len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_bytes_and_leaves(docs):
    stored = {r.doc_id: r for r in ogg_audio.store(docs, with_media=False).collect()}
    leaves = {r.doc_id: r for r in merkle_manifest.manifest(docs).collect()}
    for i, text in TEXTS.items():
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (stored[i].n_bytes, stored[i].payload_sha256) == (len(data), hashlib.sha256(payload).hexdigest())
        whole = f"1:{i}1:a2:en{len(str(len(text or '')))}:{len(text or '')}" + ("-" if text is None else f"{len(data)}:{text}")
        assert leaves[i].leaf == hashlib.sha256(whole.encode()).hexdigest() and leaves[i].verified


def test_scores_of_long_and_equal_texts(spark, docs):
    """Long texts get a score like any other, equal texts equal ones."""
    more = docs.union(docs.selectExpr("doc_id + 100", "text", "source", "lang", "n_chars"))
    marks = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in (1, 2, 3, 4, 6)], "doc_id long, quality int, toxic int")
    for found in (quality_model.classify(more, marks), toxicity.classify(more, marks)):
        got = {r.doc_id: r.score for r in found.collect()}
        assert len(got) == 12 and all(0 <= s <= 1 for s in got.values())
        assert all(abs(got[i] - got[i + 100]) < 1e-9 for i in TEXTS)
