"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring symbols that occurs inside no vocabulary token can never come to lie inside one
token, so a text may be cut there for certain: the parts are encoded independently and their ids are
concatenated.  White space is such a cut for this vocabulary (its splitting drops it), and so are the
pairs of bytes found when all tokens are spelled out.  The last byte of a word carries the word end and
is a symbol of its own.

Each distinct chunk between white space is normalised as the vocabulary's file says (NFC, then lower case
character by character) and split by its pattern, its words are cut at the forced boundaries, each distinct fragment runs through
the transducer of ``bpe_machine``, and the chunk's ids and decoded text are remembered (bounded).

Null and empty texts have no ids and decode to the empty text; texts of any length are encoded whole.  Repeated
rows, and rows that repeat a doc_id, are encoded each; a null doc_id stays null; an empty table gives no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import array
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_machine import word_end_machine
from .common import batches, worker_cache
from .tokenizer_files import easy_collection, read_vocabulary, vocabulary_path

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: The splitting pattern that belongs to the vocabulary file, and the one letter that str.lower() treats by its neighbours.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
CONTEXTUAL = "\u03a3"


class WordBpe:
    def __init__(self, path: str, keep: int = 400_000):
        file = read_vocabulary(path)
        easy_collection()
        self.machine = word_end_machine(path)
        self.special_ids = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.specials = list(self.special_ids)
        self.shown = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.inside = {pair for s in self.machine.spelled.values() for pair in zip(s, s[1:], strict=False)}
        self.fragments: dict[tuple[int, ...], list[int]] = {}
        self.chunks: dict[str, bytes] = {}
        self.keep = keep

    def cut(self, symbols: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """Fragments between forced boundaries."""
        at = 0
        for i, pair in enumerate(zip(symbols, symbols[1:], strict=False), 1):
            if pair not in self.inside:
                yield symbols[at:i]
                at = i
        yield symbols[at:]

    def word(self, spelled: bytes) -> list[int]:
        """Ids of one word, given in bytes."""
        symbols = list(spelled)
        symbols[-1] += 256
        out: list[int] = []
        for part in self.cut(tuple(symbols)):
            ids = self.fragments.get(part)
            if ids is None:
                ids = self.machine.encode(part)
                if len(part) < 32:
                    if len(self.fragments) > self.keep:
                        self.fragments.clear()
                    self.fragments[part] = ids
            out += ids
        return out

    def chunk(self, text: str) -> bytes:
        """Ids (packed) of a chunk that holds no cut of white space."""
        ids: list[int] = []
        if any(s in text for s in self.specials):
            pattern = "(" + "|".join(map(re.escape, self.specials)) + ")"
            for part in re.split(pattern, text):
                if part in self.special_ids:
                    ids.append(self.special_ids[part])
                elif part:
                    ids += self._plain(part)
        else:
            ids = self._plain(text)
        return array.array("I", ids).tobytes()

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if CONTEXTUAL not in text else "".join(c.lower() for c in text)
        for word in SPLIT.findall(text):
            out += self.word(word.encode())
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        get = self.chunks.get
        pieces = text.replace("\n", " ").split(" ")
        found = list(map(get, pieces))
        if None in found:
            if len(self.chunks) > self.keep:
                self.chunks.clear()
            for i, got in enumerate(found):
                if got is None:
                    piece = pieces[i]
                    got = get(piece)
                    if got is None:
                        got = self.chunk(piece)
                        if len(piece) < 64:
                            self.chunks[piece] = got
                    found[i] = got
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.shown.__getitem__, array.array("I", ids)))


@worker_cache("word-bpe")
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _texts(docs: DataFrame) -> DataFrame:
    batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per document: ids and the text that they decode to, in full."""
    path = tokenizer or vocabulary_path("word_bpe_49k.json")

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_bpe(path)
        for batch in stream:
            ids, texts = [], []
            for text in batch.column(1):
                packed = codec.encode(text.as_py() or "")
                ids.append(list(array.array("I", packed)))
                texts.append(codec.decode(packed))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return _texts(docs).mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per document: the number of ids, and digests of the ids and of the decoded text."""
    path = tokenizer or vocabulary_path("word_bpe_49k.json")

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = word_bpe(path), hashlib.sha256
        for batch in stream:
            n, first, second = [], [], []
            for text in batch.column(1):
                packed = codec.encode(text.as_py() or "")
                n.append(len(packed) // 4)
                first.append(sha(packed).hexdigest())
                second.append(sha(codec.decode(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(work, SCHEMA)
