"""Exact token counts by finite-state transducers.

Two deterministic transducers, their transitions annotated with counts, run one behind the other.  The
first reads classes of characters (with the look-ahead of the splitting pattern folded into the class)
and marks where the pattern begins a new piece; it has 8 states.  The second reads the bytes of a piece
and emits changes of the token count (``bpe_machine``); it starts afresh with each piece.

All texts of a batch are laid end to end and cut into chunks of equal length, wherever the cuts fall.
Every chunk is run from all 8 states at once, giving its state map; maps compose associatively, and a
parallel prefix scan (doubling distances) gives the state in which each chunk is really entered.  A
second run from that state marks the pieces.  Each distinct piece is counted once and remembered.
Memory follows the batch, not the corpus: one text at most, or ``CELLS`` characters of several.

Null and empty texts count 0; texts of any length are counted whole.  Repeated rows, and rows that repeat a
doc_id, are counted each; a null doc_id stays null; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_machine import byte_level_machine
from .common import batches, worker_cache
from .tokenizer_files import easy_collection, read_vocabulary, vocabulary_path

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Characters laid end to end at once, unless one text alone is longer; characters of a chunk.
CELLS, CHUNK = 1 << 20, 512

# Symbols of the splitting transducer.
LETTER, NUMBER, OTHER, QUOTE, QUOTE1, QUOTE2, SPACE_LEAD, SPACE_RUN, BLANK_LAST, BLANK_RUN, SPECIAL, END = range(12)
# Its states: a new piece begins; after a leading space; in letters, digits, others, white space; 1 or 2 letters of a contraction to come.
START, LED, IN_L, IN_N, IN_O, IN_W, SHORT1, SHORT2 = range(8)
#: Code points that stand for a special token and for the end of a text.
SPECIAL_AT, END_AT = sys.maxunicode + 1, sys.maxunicode + 2
#: The characters with Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def splitting_machine() -> tuple[np.ndarray, np.ndarray]:
    """Tables (state, symbol) of the next state and of whether a piece begins before the symbol."""
    to, new = np.zeros((8, 12), np.uint8), np.zeros((8, 12), bool)
    run = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, QUOTE: IN_O, QUOTE1: IN_O, QUOTE2: IN_O}
    fresh = run | {QUOTE1: SHORT1, QUOTE2: SHORT2}
    for state in range(8):
        for symbol in range(12):
            if symbol in (SPECIAL, END):
                to[state, symbol], new[state, symbol] = START, True
            elif state == SHORT2:
                to[state, symbol] = SHORT1
            elif state == SHORT1:
                to[state, symbol] = START
            elif symbol == SPACE_LEAD:
                to[state, symbol], new[state, symbol] = LED, True
            elif symbol == BLANK_LAST:
                to[state, symbol], new[state, symbol] = START, True
            elif symbol in (SPACE_RUN, BLANK_RUN):
                to[state, symbol], new[state, symbol] = IN_W, state != IN_W
            elif state == LED or run[symbol] == state:
                to[state, symbol] = run[symbol]
            else:
                to[state, symbol], new[state, symbol] = fresh[symbol], True
    return to, new


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 3, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    table[WHITE] = BLANK_RUN
    table[0x20], table[0x27] = SPACE_RUN, QUOTE
    table[SPECIAL_AT], table[END_AT] = SPECIAL, END
    return table


def symbols_of(points: np.ndarray) -> np.ndarray:
    """Classes with the pattern's look-ahead folded in.  ``points`` ends with END_AT."""
    kinds = classes()[points]
    ahead = np.append(kinds[1:], np.uint8(END))
    solid = (ahead <= QUOTE)
    kinds[(kinds == SPACE_RUN) & solid] = SPACE_LEAD
    kinds[(kinds == BLANK_RUN) & solid] = BLANK_LAST
    at = np.flatnonzero(kinds == QUOTE)
    if len(at):
        one = points[np.minimum(at + 1, len(points) - 1)]
        two = points[np.minimum(at + 2, len(points) - 1)]
        kinds[at[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE1
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kinds[at[pair]] = QUOTE2
    return kinds


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan of state maps: row i becomes map 0, then 1, ... then i."""
    done, distance = maps.copy(), 1
    while distance < len(done):
        done[distance:] = np.take_along_axis(done[distance:], done[:-distance].astype(np.intp), axis=1)
        distance *= 2
    return done


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Positions where the splitting pattern begins a piece (ends of texts included)."""
    to, new = splitting_machine()
    n = len(points)
    count = -(-n // CHUNK)
    grid = np.full(count * CHUNK, END, np.uint8)
    grid[:n] = symbols_of(points)
    grid = np.ascontiguousarray(grid.reshape(count, CHUNK).T).astype(np.intp)
    flat = to.ravel()
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (count, 8))
    for row in grid:
        maps = flat[maps * np.intp(12) + row[:, None]]
    entry = np.empty(count, np.uint8)
    entry[0] = START
    entry[1:] = compose_scan(maps)[:-1, START]
    begins, state = np.empty((CHUNK, count), bool), entry
    for t, row in enumerate(grid):
        cell = state * np.intp(12) + row
        begins[t], state = new.ravel()[cell], flat[cell]
    return np.flatnonzero(begins.T.ravel()[:n])


class Counter:
    """Counts of whole texts; one a worker process, its memory of pieces bounded."""

    def __init__(self, path: str, keep: int = 500_000):
        easy_collection()
        self.machine, self.keep = byte_level_machine(path), keep
        self.specials = [t["content"] for t in read_vocabulary(path)["added_tokens"]]
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> np.ndarray:
        """Token counts of a list of texts."""
        out: list[np.ndarray] = []
        group: list[str] = []
        cells = 0
        for text in texts:
            if group and cells + len(text) > CELLS:
                out.append(self._count(group))
                group, cells = [], 0
            group.append(text)
            cells += len(text) + 1
        if group:
            out.append(self._count(group))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _count(self, texts: list[str]) -> np.ndarray:
        parts = []
        end = np.array([END_AT], np.uint32)
        for text in texts:
            pieces = [text]
            for special in self.specials:
                pieces = [y for x in pieces for y in self._around(x, special)]
            for piece in pieces:
                parts.append(np.array([SPECIAL_AT], np.uint32) if piece is None else np.frombuffer(piece.encode("utf-32-le"), np.uint32))
            parts.append(end)
        points = np.concatenate(parts)
        starts = piece_starts(points)
        kind = points[starts]
        ends = np.append(starts[1:], len(points))
        shown = np.where(points < SPECIAL_AT, points, 0x20)
        whole = shown.astype("<u4").tobytes().decode("utf-32-le")
        words = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        counts = self._counts(words)
        counts[kind == SPECIAL_AT] = 1
        counts[kind == END_AT] = 0
        total = np.concatenate(([0], np.cumsum(counts)))
        closing = np.flatnonzero(kind == END_AT)
        opening = np.concatenate(([0], closing[:-1] + 1))
        return total[closing] - total[opening]

    @staticmethod
    def _around(text: str | None, special: str) -> Iterator[str | None]:
        if text is None:
            yield None
            return
        for i, part in enumerate(text.split(special)):
            if i:
                yield None
            yield part

    def _counts(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known.clear()
        known, count = self.known, self.machine.count
        found = list(map(known.get, words))
        for i, n in enumerate(found):
            if n is None:
                word = words[i]
                n = known.get(word)
                if n is None:
                    n = count(word.encode())
                    if len(word) < 64:
                        known[word] = n
                found[i] = n
        return np.array(found, np.int64)


@worker_cache("token-counts")
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """Per document: bytes of UTF-8, tokens, and whether they are more than ``limit``."""
    path = tokenizer or vocabulary_path("byte_bpe_50k.json")
    batches(docs.sparkSession)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in stream:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = count(texts)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, SCHEMA)
