"""Interpolated modified Kneser-Ney models of order 2 or 3, counted in Spark and stored as sorted hash arrays.

Counting never puts single n-grams into a shuffle.  A task sorts and sums what it has read and sends each
shard's part as one packed block; a shard's blocks are merged by one task, which writes sorted arrays into
the shared folder.  A frequent word or context is thus one entry a task before anything is shuffled.  Steps:

1. words: 64-bit word hashes with counts, in shards that are ranges of the hash; a word's id is its shard
   and its place there;
2. order 3 only, triples (u, v, w) with counts, in shards by v.  A shard holds whole contexts (u, v), so it
   writes triples and context sums, and sends on the distinct u of each (v, w);
3. pairs (v, w) in shards by v: with counts (order 2), or with the number of distinct u (order 3).  A shard
   writes them and sends on sums by v as a context, and the number of distinct v of each w;
4. those sums, added up by the word's own shard.

A word v that makes up more than a share of all tokens is dealt over several shards by its neighbour, in
proportion to its count; what is sent on from them adds up, so nothing depends on how they were dealt.
Where there are more than ``FAN`` shards, blocks go through a middle level: tasks send blocks of ``FAN`` shards at a
time, which are merged in parts and cut again, so the number of blocks grows with the input, not its square.

A stored array is sorted by a 40-bit hash of the n-gram within its shard (a look-up of an n-gram that isn't there
finds another's entry with a chance of about 3e-6 in a full shard): a directory of the upper 16 bits, the lower 24, and counts
in a byte each, larger ones aside.  Discounts come from counts of counts.  Workers map the arrays into memory and look up the sorted keys of a batch.

Counts are kept by class (one column a class), so the same arrays serve a plain model (one class) and
class-conditional models that share their backoff.  Everything covers
all documents given; there are no cut-offs of rare entries.  Nothing of a model but a few global numbers
goes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, claim, give_back, local_path, put_bytes, shared_dir, worker_cache

#: The hash of the end of a text as a token.
END = np.uint64(0xE2D0F7E87AC1B35D)
#: Bytes of text for which one shard is laid out; entries of a task that are sorted at once; shards that a task sends blocks to.
SHARD_BYTES, RUN, FAN = 16 << 20, 1_000_000, 4096
#: A word with more than this share of a shard's tokens is dealt over several.
HOT = 0.25
BLOCKS = "shard int, payload binary, facts array<long>"
UNKNOWN = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Stored keys are the upper 40 bits of a hash; of these the upper 16 have a directory.
KEPT, BELOW, LOW24 = np.uint64(24), np.uint64(24), np.uint64((1 << 24) - 1)

# --- rows of counts: sorted by key, with columns of ids and of counts --------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def key_of(*ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an n-gram's ids."""
    h = ids[0]
    for x in ids[1:]:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x)
    return h


def sum_by_key(keys: list[np.ndarray], ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of parts laid end to end: sorted distinct keys, one row of ids for each, and summed counts.

    The lists are emptied column by column, so that no more than one column is held twice.
    """
    own = _joined(keys)
    if not len(own):
        return own, _joined(ids), _joined(counts)
    order = np.argsort(own)
    own = own[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    own = own[first]
    sums = narrow(np.add.reduceat(_joined(counts)[order], first, axis=0, dtype=np.int64))
    order = order[first]
    return own, _joined(ids)[order], sums


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as all of them need."""
    most = counts.max(initial=0)
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)


def pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Rows of ids (the first: the shard) and counts: differences of the second id, planes of the bytes in use, zstd."""
    import zstandard

    order = np.argsort(ids[:, 1])
    ids, counts = ids[order], narrow(counts[order])
    ids[:, 1] = np.diff(ids[:, 1], prepend=np.uint64(0))
    n, k = ids.shape
    used = np.bitwise_or.reduce(ids, axis=0).view(np.uint8) > 0
    head = np.array([n, k, counts.shape[1], counts.dtype.itemsize], np.uint32).tobytes() + used.tobytes()
    planes = np.ascontiguousarray(ids.view(np.uint8)[:, used].T).tobytes() + np.ascontiguousarray(np.ascontiguousarray(counts).view(np.uint8).T).tobytes()
    return head + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n, k, m, wide = np.frombuffer(data, np.uint32, 4).tolist()
    used = np.flatnonzero(np.frombuffer(data, np.bool_, 8 * k, 16))
    planes = zstandard.ZstdDecompressor().decompress(data[16 + 8 * k :])
    ids = np.zeros((n, 8 * k), np.uint8)
    ids[:, used] = np.frombuffer(planes, np.uint8, len(used) * n).reshape(len(used), n).T
    ids = ids.view(np.uint64)
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[wide]
    counts = np.frombuffer(planes, np.uint8, wide * m * n, len(used) * n).reshape(wide * m, n).T.copy("C").view(kind)
    ids[:, 1] = np.cumsum(ids[:, 1], dtype=np.uint64)
    return ids, counts


class Tally:
    """Counts of a task, sorted and summed whenever enough have come in; ``full`` once that many distinct ones are held."""

    def __init__(self) -> None:
        self.parts: tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]] = ([], [], [])  # keys, ids, counts
        self.size = 0

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self._hold(keys, ids, narrow(counts))
        self.size += len(keys)
        if self.size >= RUN and len(self.parts[0]) > 1:
            self._hold(*sum_by_key(*self.parts))
            self.size = len(self.parts[0][0])

    def _hold(self, *columns: np.ndarray) -> None:
        for part, column in zip(self.parts, columns, strict=True):
            part.append(column)

    @property
    def full(self) -> bool:
        """Half a run of distinct keys is left after summing: it is sent on, so that a task of any size holds a run at most."""
        return len(self.parts[0]) == 1 and self.size >= RUN // 2

    def blocks(self, fan: int) -> Iterator[tuple[int, bytes]]:
        """A packed block for each group of ``fan`` shards."""
        if not self.parts[0]:
            return
        ids, counts = sum_by_key(*self.parts)[1:]
        self.size = 0
        yield from cut(ids, counts, fan)


def cut(ids: np.ndarray, counts: np.ndarray, fan: int = 1) -> Iterator[tuple[int, bytes]]:
    if not len(ids):
        return
    group = (ids[:, 0] // np.uint64(fan)).astype(np.int64)
    order = np.argsort(group.astype(np.uint16) if group.max() < 1 << 16 else group, kind="stable")
    group = group[order]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))).tolist()
    for a, b in zip(first, [*first[1:], len(group)], strict=True):
        yield int(group[a]), pack(ids[order[a:b]], counts[order[a:b]])


def block_batches(blocks: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for block in blocks:
        held.append(block)
        size += len(block[1])
        if size > 4 << 20:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _rows(blocks: list[tuple[int, bytes]], facts: list[tuple[int, list[int]]] = ()) -> pa.RecordBatch:
    more = len(facts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([b[0] for b in blocks] + [f[0] for f in facts], pa.int32()),
            pa.array([b[1] for b in blocks] + [None] * more, pa.binary()),
            pa.array([None] * len(blocks) + [f[1] for f in facts], pa.list_(pa.int64())),
        ],
        names=["shard", "payload", "facts"],
    )


def merge(table: pa.Table, keys_of: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All blocks of a group summed, a few at a time: keys (sorted), ids, counts."""
    held, size = ([], [], []), 0
    column = table.column("payload")
    for i, cell in enumerate(column):
        ids, counts = unpack(cell.as_py())
        for part, x in zip(held, (keys_of(ids), ids, counts), strict=True):
            part.append(x)
        size += len(ids)
        if size >= RUN or i == len(column) - 1:
            for part, x in zip(held, sum_by_key(*held), strict=True):
                part.append(x)
            size = len(held[0][0]) // 2
    del ids, counts, x
    keys, ids, counts = (part.pop() for part in held)
    return keys, ids, counts.astype(np.int64)


def gathered(blocks: DataFrame, shards: int, keys_of: Callable[[np.ndarray], np.ndarray], store: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``store`` of the blocks of each shard, by way of a middle level where there are many shards.

    Blocks come by groups of ``fan_of(shards)`` shards; rows of facts have a shard below 0 and are groups of their own.  Partitions
    are given by the shard's number, so a task has one shard, where a hash would give some tasks several.
    """
    fan = fan_of(shards)
    if fan > 1:

        def again(table: pa.Table) -> pa.Table:
            if table.column("payload")[0].as_py() is None:
                return table.select(["shard", "payload", "facts"])
            _, ids, counts = merge(table, keys_of)
            return pa.Table.from_batches([_rows(list(cut(ids, counts)))])

        salt = F.when(F.col("shard") < 0, F.lit(0)).otherwise(F.pmod(F.spark_partition_id(), F.lit(fan)))
        blocks = blocks.withColumn("salt", salt).repartition(shards, "shard", "salt").groupBy("shard", "salt").applyInArrow(again, BLOCKS)
    return blocks.repartitionById(shards, "shard").groupBy("shard").applyInArrow(store, schema)


def fan_of(shards: int) -> int:
    """Shards a block: 1 up to ``FAN`` shards, then as many as keep both levels' blocks a task about equal."""
    return 1 if shards <= FAN else math.isqrt(shards - 1) + 1


# --- stored arrays ------------------------------------------------------------------------------------


def counts_bytes(columns: np.ndarray) -> bytes:
    """Rows x columns of counts: a byte each, larger ones aside."""
    flat = np.ascontiguousarray(columns.T).ravel()
    large = np.flatnonzero(flat >= 255)
    head = np.array([*columns.shape, len(large)], np.int64)
    return b"".join(x.tobytes() for x in (head, large, flat[large], np.minimum(flat, 255).astype(np.uint8)))


class Counts:
    """What ``counts_bytes`` made, mapped."""

    def __init__(self, raw: np.ndarray):
        self.n, self.m, k = raw[:24].view(np.int64).tolist()
        self.large, self.values = raw[24 : 24 + 8 * k].view(np.int64), raw[24 + 8 * k : 24 + 16 * k].view(np.int64)
        self.cells = raw[24 + 16 * k :]

    def rows(self, at: np.ndarray) -> np.ndarray:
        cells = (at[:, None] + self.n * np.arange(self.m)).ravel()
        found = self.cells[cells].astype(np.int64)
        big = np.flatnonzero(found == 255)
        if len(big):
            found[big] = self.values[np.searchsorted(self.large, cells[big])]
        return found.reshape(len(at), self.m)


def mapped(path: str) -> np.ndarray:
    return np.asarray(np.memmap(local_path(path), np.uint8, "r"))


def put_arrays(path: str, keys: np.ndarray, columns: np.ndarray) -> None:
    """Entries of sorted 64-bit keys, by the upper 40 bits of these, with their counts."""
    keys = keys >> KEPT
    n = len(keys)
    first = np.concatenate(([0], np.cumsum(np.bincount((keys >> BELOW).astype(np.int64), minlength=1 << 16))))
    parts = (np.int64(n), first.astype(np.uint32), np.uint32(0), (keys >> np.uint64(8)).astype(np.uint16), keys.astype(np.uint8), np.zeros(-3 * n % 8, np.uint8))
    put_bytes(path, b"".join(x.tobytes() for x in parts) + counts_bytes(columns))


class Arrays:
    """A mapped file of ``put_arrays``."""

    def __init__(self, path: str):
        raw = mapped(path)
        self.n = n = int(raw[:8].view(np.int64)[0])
        at = 8 + 4 * ((1 << 16) + 2)
        self.first = raw[8 : at - 4].view(np.uint32)
        self.upper, self.lower = raw[at : at + 2 * n].view(np.uint16), raw[at + 2 * n : at + 3 * n]
        self.counts = Counts(raw[at + 3 * n + -3 * n % 8 :])

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys (40 bits, sorted) are there, and their counts (rows x columns)."""
        bucket = (keys >> BELOW).astype(np.int64)
        upper, lower = (keys >> np.uint64(8)).astype(np.uint16), keys.astype(np.uint8)
        at, end = self.first[bucket].astype(np.int64), self.first[bucket + 1].astype(np.int64)
        stop = end.copy()
        last = max(self.n - 1, 0)
        for _ in range(int((end - at).max(initial=0)).bit_length()):  # the first entry with no lesser upper bits, by halving
            middle = (at + stop) >> 1
            less = (at < stop) & (self.upper[np.minimum(middle, last)] < upper)
            stop = np.where(less, stop, np.minimum(middle, stop))
            at = np.where(less, middle + 1, at)
        behind = np.flatnonzero(at < end)
        while len(behind):  # past entries with equal upper bits and lesser lower ones
            i = at[behind]
            behind = behind[(self.upper[i] == upper[behind]) & (self.lower[i] < lower[behind])]
            at[behind] += 1
            behind = behind[at[behind] < end[behind]]
        hit = np.flatnonzero(at < end)
        i = at[hit]
        same = (self.upper[i] == upper[hit]) & (self.lower[i] == lower[hit])
        return hit[same], self.counts.rows(i[same])


class Words:
    """A mapped shard of the vocabulary: sorted hashes with their counts."""

    def __init__(self, path: str):
        raw = mapped(path)
        n = int(raw[:8].view(np.int64)[0])
        self.keys, self.counts = raw[8 : 8 + 8 * n].view(np.uint64), Counts(raw[8 + 8 * n :])


# --- words ------------------------------------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of bytes other than space and \\t to \\r."""
    return text.encode().lower().split() if text else []


def lowered(text: bytes) -> bytes:
    """A-Z lowered: the words are those of ``words_of``."""
    return text.lower()


#: Bytes of ASCII other than letters become spaces.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def letters(text: bytes) -> bytes:
    """Lower-cased runs of letters (and of all beyond ASCII): punctuation and digits fall away."""
    return text.decode().lower().encode().translate(_LETTERS)


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def text_batches(stream: Iterator[pa.RecordBatch], split: Callable[[str | None], list[bytes]] = words_of, rows: int = 200_000) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Rows and the words of their texts, in groups of bounded size (one text at least)."""
    keep, words, n = [], [], 0
    for batch in stream:
        others = list(zip(*[batch.column(i).to_pylist() for i in range(1, batch.num_columns)], strict=True)) if batch.num_columns > 1 else [()] * batch.num_rows
        for text, other in zip(batch.column(0), others, strict=True):
            w = split(text.as_py())
            keep.append(other)
            words.append(w)
            n += len(w) + 1
            if n >= rows:
                yield keep, words
                keep, words, n = [], [], 0
    if keep:
        yield keep, words


#: White space becomes a space; the multiplier of word hashes (odd, so it has an inverse); bytes that are hashed at once, bytes of a group of texts.
_BLANKS = bytes(32 if b in b" \t\n\v\f\r" else b for b in range(256))
PRIME, PIECE, GROUP = 0x9E3779B97F4A7C15, 1 << 18, 1 << 20


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME**k and its inverse for k below ``n``, modulo 2**64."""
    step = lambda x: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64))))
    return step(PRIME), step(pow(PRIME, -1, 1 << 64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` (polynomials in their bytes, mixed), and where the words begin."""
    data = data.translate(_BLANKS)
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE:  # cut at a space
            end = data.rfind(b" ", at, at + PIECE) + 1 or data.find(b" ", at + PIECE) + 1 or len(data)
        x = np.frombuffer(data, np.uint8, end - at, at)
        power, inverse = _powers(PIECE)
        if len(x) > PIECE:  # one word, with a space behind it unless the data ends: summed piece by piece
            x = x[:-1] if x[-1] == 32 else x
            total = sum(int(np.sum((x[k : k + PIECE] + np.uint64(1)) * power[: len(x) - k])) * pow(PRIME, k, 1 << 64) for k in range(0, len(x), PIECE))
            hashes.append(mix(np.array([total % (1 << 64)], np.uint64)))
            starts.append(np.array([at]))
            at = end
            continue
        inside = x != 32
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, last = edge[::2], edge[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(inside, x + np.uint64(1), np.uint64(0)) * power[: len(x)], dtype=np.uint64)))
        hashes.append(mix((sums[last] - sums[first]) * inverse[first]))
        starts.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts (cleaned), each text's words and its end, and the positions of the ends."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    words, starts = word_hashes(b" ".join(texts))
    upto = np.searchsorted(starts, np.cumsum(size + 1))
    ends = upto + np.arange(len(texts))
    out = np.empty(len(words) + len(texts), np.uint64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[ends], out[inside] = END, words
    return out, ends


def hashed(stream: Iterator[pa.RecordBatch], clean: Callable[[bytes], bytes] = lowered) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Rows with the token hashes of their texts and the positions of the ends, in groups of bounded size (one text at least)."""
    keep, texts, size = [], [], 0
    for batch in stream:
        others = list(zip(*[batch.column(i).to_pylist() for i in range(1, batch.num_columns)], strict=True)) if batch.num_columns > 1 else [()] * batch.num_rows
        for text, other in zip(batch.column(0).cast(pa.binary()), others, strict=True):
            texts.append(clean(text.as_py() or b""))
            keep.append(other)
            size += len(texts[-1])
            if size >= GROUP:
                yield keep, *token_hashes(texts)
                keep, texts, size = [], [], 0
    if keep:
        yield keep, *token_hashes(texts)


# --- training ---------------------------------------------------------------------------------------


@dataclass
class Layout:
    """Where a model lies and its global numbers; of constant size, sent to the workers with the code."""

    root: str
    order: int
    classes: int
    shards: int
    rare_below: int = 0
    size: int = 0  # distinct tokens
    totals: list[int] = field(default_factory=list)  # tokens by class
    word_discounts: list[list[float]] = field(default_factory=list)  # by class
    word_taken: list[float] = field(default_factory=list)
    triple_discounts: list[float] = field(default_factory=list)
    pair_discounts: list[list[float]] = field(default_factory=list)
    lower_discounts: list[float] = field(default_factory=list)  # of all classes together
    lower_taken: float = 1.0
    lower_total: int = 0
    ready: bool = False

    @property
    def begin(self) -> int:
        """The id of what stands before a text."""
        return self.shards << 32


def discounts(counts: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, 3 and more, from the counts of counts of 1 to 4."""
    n1, n2, n3, n4 = (max(c, 1) for c in counts[:4])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), top) for d, top in zip(raw, (1.0, 1.95, 2.9), strict=True)]


def count_of_counts(columns: np.ndarray) -> list[int]:
    """Entries of each column with a count of 1, 2, 3, 4."""
    return [int(np.count_nonzero(c == k)) for c in columns.T for k in (1, 2, 3, 4)]


def context_sums(keys: np.ndarray, counts: np.ndarray, rare_below: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows at which runs of equal sorted keys begin and, by class: their total, entries with 1, 2, 3 or more, and counts of rare entries."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    firm = counts.sum(1) >= rare_below
    columns = list(counts.T)
    kinds = [columns, [firm & (c == 1) for c in columns], [firm & (c == 2) for c in columns], [firm & (c >= 3) for c in columns]]
    if rare_below:
        kinds.append([np.where(firm, 0, c) for c in columns])
    return first, np.stack([np.add.reduceat(c.astype(np.int64), first) for kind in kinds for c in kind], axis=1)


def hash_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of a uniform 64-bit hash."""
    return (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def dealt(word: np.ndarray, other: np.ndarray, splits: np.ndarray, shards: int) -> np.ndarray:
    """Shards of pairs by ``word``, which has ``splits`` parts by its neighbour ``other``."""
    several = np.flatnonzero(splits > 1)
    if len(several):
        part = mix(other[several]) % splits[several].astype(np.uint64)
        word = word.copy()
        word[several] += part * np.uint64(0x9E3779B97F4A7C15)
    return mix(word) % np.uint64(shards)


def train(texts: DataFrame, tag: str, order: int = 2, classes: int = 1, rare_below: int = 0, clean: Callable[[bytes], bytes] = lowered, once: bool = False) -> Layout:
    """Count a model over ``texts``: a column text and, if there are several classes, an int column class.

    Expressions seen fewer than ``rare_below`` times in all classes together give their whole count to
    the shared backoff.  With ``once`` a word counts once a text in its class's counts (pairs count as
    they stand), so that a text repeating a word isn't more evidence than one using it.  Order 3 has one class.
    Null texts have no words but the end.  An empty table gives an empty model, by which every token is unknown.
    """
    assert order == 2 or classes == 1
    spark = texts.sparkSession
    batches(spark)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    layout = Layout(shared_dir(spark, tag), order, classes, shards, rare_below)
    root, fan = layout.root, fan_of(shards)

    def classed(counts: np.ndarray, label: int) -> np.ndarray:
        out = np.zeros((len(counts), classes), np.int64)
        out[:, label] = counts
        return out

    def count_words(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("kneser-ney")
        tally = Tally()
        for others, hashes, ends in hashed(stream, clean):
            text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
            label = np.array([o[0] for o in others])[text] if classes > 1 else None
            if once:
                at = np.unique(mix(hashes + text.astype(np.uint64) * np.uint64(PRIME)), return_index=True)[1]
                hashes, label = hashes[at], label[at] if classes > 1 else None
            for c in range(classes):
                keys, n = np.unique(hashes[label == c] if classes > 1 else hashes, return_counts=True)
                tally.add(keys, np.stack([hash_shard(keys, shards), keys], axis=1), classed(n, c))
            if tally.full:
                yield from block_batches(tally.blocks(fan))
        yield from block_batches(tally.blocks(fan))
        give_back()

    def store_words(table: pa.Table) -> pa.Table:
        keys, ids, counts = merge(table, lambda ids: ids[:, 1])
        put_bytes(f"{root}/words-{int(ids[0, 0])}", np.int64(len(keys)).tobytes() + keys.tobytes() + counts_bytes(counts))
        rare = counts.sum(1) < rare_below
        kept = [int(np.count_nonzero(c)) for column in counts[~rare].T for c in (column == 1, column == 2, column >= 3)]
        facts = [len(keys), *counts.sum(0).tolist(), *count_of_counts(counts), *kept, *counts[rare].sum(0).tolist()]
        return pa.table({"shard": pa.array([int(ids[0, 0])], pa.int32()), "facts": pa.array([facts], pa.list_(pa.int64()))})

    stored = gathered(texts.mapInArrow(count_words, BLOCKS), shards, lambda ids: ids[:, 1], store_words, "shard int, facts array<long>")
    facts = summed(stored, 1 + 9 * classes)
    layout.size, layout.totals = facts[0], facts[1 : 1 + classes]
    coc, kept, rare = (facts[1 + a * classes : 1 + b * classes] for a, b in ((1, 5), (5, 8), (8, 9)))
    for c in range(classes):
        d = discounts(coc[4 * c : 4 * c + 4])
        layout.word_discounts.append(d)
        layout.word_taken.append((sum(x * n for x, n in zip(d, kept[3 * c : 3 * c + 3], strict=True)) + rare[c]) / max(1, layout.totals[c]))

    def count_ngrams(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, model = Tally(), reader(layout)
        for others, hashes, ends in hashed(stream, clean):
            slots = model.slots(hashes)
            before = previous(slots, ends)
            grams = [slots] if order == 2 else [before, slots]
            grams = [previous(before, ends) if order == 3 else before, *grams]
            ids = [model.ids[g] for g in grams]
            keys = key_of(*ids)
            mid = grams[-2]  # the word whose shard it is: v of (u, v, w) and of (v, w)
            label = np.zeros(len(keys), np.int64) if classes == 1 else np.repeat([o[0] for o in others], np.diff(ends, prepend=-1))
            for c in range(classes):
                at = np.flatnonzero(label == c) if classes > 1 else np.arange(len(keys))
                at = at[np.argsort(keys[at])]
                if len(at):
                    own = keys[at]
                    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    n, at = np.diff(np.append(first, len(own))), at[first]
                    shard = dealt(ids[-2][at], ids[0 if order == 3 else -1][at], model.splits[mid[at]], shards)
                    tally.add(own[first], np.stack([shard, ids[-2][at], *[x[at] for k, x in enumerate(ids) if k != order - 2]], axis=1), classed(n, c))
            if tally.full:
                yield from block_batches(tally.blocks(fan))
        yield from block_batches(tally.blocks(fan))
        give_back()

    def triple_key(ids: np.ndarray) -> np.ndarray:  # rows: shard, v, u, w
        return key_of(ids[:, 2], ids[:, 1], ids[:, 3])

    def pair_key(ids: np.ndarray) -> np.ndarray:  # rows: shard, v, w
        return key_of(ids[:, 1], ids[:, 2])

    def store_triples(table: pa.Table) -> pa.Table:
        keys, ids, counts = merge(table, triple_key)
        shard = int(ids[0, 0])
        put_arrays(f"{root}/triples-{shard}", keys, counts)
        facts = count_of_counts(counts) + [0] * (width - 4)
        context = key_of(ids[:, 2], ids[:, 1])
        order = np.argsort(context)
        first, sums = context_sums(context[order], counts[order])
        put_arrays(f"{root}/contexts-{shard}", context[order][first], sums)
        del keys, counts, context, sums
        pairs = key_of(ids[:, 1], ids[:, 3])
        order = np.argsort(pairs)
        first = np.flatnonzero(np.concatenate(([True], pairs[order][1:] != pairs[order][:-1])))
        n, ids = np.diff(np.append(first, len(order))), ids[order[first]]
        to = dealt(ids[:, 1], ids[:, 3], reader(layout).splits_of(ids[:, 1]), shards)
        blocks = list(cut(np.stack([to, ids[:, 1], ids[:, 3]], axis=1), n[:, None], fan))
        return pa.Table.from_batches([_rows(blocks, [(-1 - shard % 64, facts)])])

    def store_pairs(table: pa.Table) -> pa.Table:
        if table.column("payload")[0].as_py() is None:
            return pa.Table.from_batches([_rows([], [added(table)])])
        keys, ids, counts = merge(table, pair_key)
        shard = int(ids[0, 0])
        put_arrays(f"{root}/pairs-{shard}", keys, counts)
        facts = [0] * triples + count_of_counts(counts) + [0] * sums_width
        order = np.argsort(ids[:, 1])
        left = ids[order, 1]
        first, sums = context_sums(left, counts[order], rare_below)
        home = lambda x: x >> np.uint64(32)  # noqa: E731  the shard of the word itself
        rows = [(2 * s, p) for s, p in cut(np.stack([home(left[first]), left[first]], axis=1), sums)]
        order = np.argsort(ids[:, 2])
        right = ids[order, 2]
        first = np.flatnonzero(np.concatenate(([True], right[1:] != right[:-1])))
        rows += [(2 * s + 1, p) for s, p in cut(np.stack([home(right[first]), right[first]], axis=1), np.diff(np.append(first, len(right)))[:, None])]
        return pa.Table.from_batches([_rows(rows, [(-1 - shard % 64, facts)])])

    def store_sums(table: pa.Table) -> pa.Table:
        if table.column("payload")[0].as_py() is None:
            shard, facts = added(table)
        else:
            keys, ids, sums = merge(table, lambda ids: ids[:, 1])
            shard, after = int(ids[0, 0]), table.column("shard")[0].as_py() % 2
            dense = np.zeros((int(keys[-1] & np.uint64(0xFFFFFFFF)) + 1, sums.shape[1]), np.int64)
            dense[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)] = sums
            put_bytes(f"{root}/{'after' if after else 'context'}-{shard}", counts_bytes(dense))
            facts = [0] * (width - sums_width) + ([*count_of_counts(sums), int(np.count_nonzero(sums >= 3)), int(sums.sum())] if after else [0] * sums_width)
        return pa.table({"shard": pa.array([shard], pa.int32()), "facts": pa.array([facts], pa.list_(pa.int64()))})

    triples, sums_width = 4 if order == 3 else 0, 6
    width = triples + 4 * classes + sums_width  # of the facts: counts of counts of triples, of pairs by class, and what the lowest order needs
    counted = texts.mapInArrow(count_ngrams, BLOCKS)
    if order == 3:
        counted = gathered(counted, shards, triple_key, store_triples, BLOCKS)
    parts = gathered(counted, shards, pair_key, store_pairs, BLOCKS).repartitionById(2 * shards + 2, "shard")
    facts = summed(parts.groupBy("shard").applyInArrow(store_sums, "shard int, facts array<long>"), width)
    if order == 3:
        layout.triple_discounts = discounts(facts[:4])
    layout.pair_discounts = [discounts(facts[triples + 4 * c :][:4]) for c in range(classes)]
    *coc, more, total = facts[width - sums_width :]
    d = layout.lower_discounts = discounts(coc)
    if total:
        layout.lower_total, layout.lower_taken = total, (d[0] * coc[0] + d[1] * coc[1] + d[2] * more) / total
    layout.ready = True
    return layout


def added(table: pa.Table) -> tuple[int, list[int]]:
    """The rows of facts of one group as one."""
    return table.column("shard")[0].as_py(), np.sum(table.column("facts").to_pylist(), axis=0).tolist()


def summed(rows: DataFrame, width: int) -> list[int]:
    """Sums of the column facts, by place."""
    found = rows.agg(*[F.sum(F.col("facts")[k]).alias(f"f{k}") for k in range(width)]).first()
    return [int(x or 0) for x in found]


def previous(slots: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The slot before each, that of the begin (0) at the start of a text."""
    out = np.concatenate((np.zeros(1, slots.dtype), slots[:-1])) if len(slots) else slots
    out[ends[:-1] + 1] = 0
    return out


# --- reading ----------------------------------------------------------------------------------------


class Reader:
    """A model's arrays mapped into a worker's memory.

    The distinct words of a group of texts have slots: places in arrays of what the model knows of single
    words.  Slot 0 begins a text.
    """

    def __init__(self, layout: Layout, most_maps: int = 4096):
        self.layout, self.most_maps = layout, most_maps
        self.files: dict[tuple[str, int], object] = {}
        begin = np.array([layout.begin], np.uint64)
        self.context_width = (5 if layout.rare_below else 4) * layout.classes
        self.begin_context = self.of_words("context", begin, self.context_width) if layout.ready else None
        self.begin_splits = self._splits(self.of_words("words", self.find(np.array([END])), layout.classes))  # as many texts begin as end

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of tokens, given by their hashes; what the model knows of them is in this reader until the next call."""
        layout = self.layout
        distinct, slots = np.unique(hashes, return_inverse=True)
        ids = self.find(distinct)
        zero = np.zeros((1, layout.classes), np.int64)
        self.counts = np.concatenate([zero, self.of_words("words", ids, layout.classes)])
        self.splits = np.concatenate([self.begin_splits, self._splits(self.counts[1:])])
        if layout.ready:
            self.contexts = np.concatenate([self.begin_context, self.of_words("context", ids, self.context_width)])
            self.afters = np.concatenate([np.zeros((1, 1), np.int64), self.of_words("after", ids, 1)])
        self.ids = np.concatenate([np.array([layout.begin], np.uint64), ids])
        return slots.ravel() + 1

    def open(self, kind: str, shard: int):
        """A file of the model, or None where the shard has none; few are kept open."""
        found = self.files.get((kind, shard), False)
        if found is False:
            if len(self.files) >= self.most_maps:
                self.files.pop(next(iter(self.files)))
            path = f"{self.layout.root}/{kind}-{shard}"
            try:
                found = Words(path) if kind == "words" else Counts(mapped(path)) if kind in ("context", "after") else Arrays(path)
            except FileNotFoundError:
                found = None
            self.files[kind, shard] = found
        return found

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted word hashes."""
        out = np.full(len(hashes), UNKNOWN)
        for s, a, b in runs(hash_shard(hashes, self.layout.shards).astype(np.int64)):
            words = self.open("words", s)
            if words is not None:
                at = np.minimum(np.searchsorted(words.keys, hashes[a:b]), len(words.keys) - 1)
                out[a:b] = np.where(words.keys[at] == hashes[a:b], np.uint64(s << 32) | at.astype(np.uint64), UNKNOWN)
        return out

    def of_words(self, kind: str, ids: np.ndarray, width: int) -> np.ndarray:
        """Rows of an array by id (words: their counts; context, after: sums); zeros where there is none."""
        out = np.zeros((len(ids), width), np.int64)
        known = np.flatnonzero(ids != UNKNOWN)
        if (ids[known][1:] < ids[known][:-1]).any():
            known = known[np.argsort(ids[known])]
        home, place = (ids[known] >> np.uint64(32)).astype(np.int64), (ids[known] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for s, a, b in runs(home):
            counts = self.open(kind, s)
            if counts is not None:
                counts = counts.counts if kind == "words" else counts
                here = np.flatnonzero(place[a:b] < counts.n)
                out[known[a:b][here]] = counts.rows(place[a:b][here])
        return out

    def splits_of(self, ids: np.ndarray) -> np.ndarray:
        """Into how many parts pairs of each word are dealt."""
        found = self._splits(self.of_words("words", ids, self.layout.classes))
        found[ids == np.uint64(self.layout.begin)] = self.begin_splits[0]
        return found

    def _splits(self, counts: np.ndarray) -> np.ndarray:
        share = HOT * sum(self.layout.totals) / self.layout.shards
        return np.clip(np.ceil(counts.sum(1) / max(share, 1)).astype(np.int64), 1, self.layout.shards)

    def look_up(self, kind: str, shards: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
        """Counts (rows x width) of n-grams, zeros where they aren't stored."""
        out = np.zeros((len(keys), width), np.int64)
        order = np.argsort(shards << np.uint64(40) | keys >> KEPT)
        where, sought = shards[order].astype(np.int64), keys[order] >> KEPT
        for s, a, b in runs(where):
            arrays = self.open(kind, s)
            if arrays is not None:
                hit, rows = arrays.get(sought[a:b])
                out[order[a + hit]] = rows
        return out

    def lower(self) -> np.ndarray:
        """Continuation probability of every slot, interpolated with an even share for every token and the unknown one."""
        layout = self.layout
        even, total = 1.0 / (layout.size + 1), layout.lower_total
        n = self.afters[:, 0]
        if not total:
            return np.full(len(n), even)
        return np.maximum(n - np.array([0, *layout.lower_discounts])[np.minimum(n, 3)], 0) / total + layout.lower_taken * even

    def class_words(self, lower: np.ndarray) -> np.ndarray:
        """Class-conditional word probabilities (slots x classes) over the shared backoff."""
        layout = self.layout
        counts = np.where(self.counts.sum(1, keepdims=True) < layout.rare_below, 0, self.counts)
        out = np.repeat(lower[:, None], layout.classes, axis=1)
        for c in range(layout.classes):
            if layout.totals[c]:
                d = np.array([0, *layout.word_discounts[c]])
                out[:, c] = np.maximum(counts[:, c] - d[np.minimum(counts[:, c], 3)], 0) / layout.totals[c] + layout.word_taken[c] * lower
        return out

    def pair_probabilities(self, slots: np.ndarray, ends: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """p(token | token before) at each position, a column for each class; ``lower``: of every slot, a column for each class."""
        layout = self.layout
        before = previous(slots, ends)
        v, w = self.ids[before], self.ids[slots]
        keys = key_of(v, w)
        at = np.flatnonzero((v != UNKNOWN) & (w != UNKNOWN))  # an unknown word stands in no pair
        counts = np.zeros((len(slots), layout.classes), np.int64)
        counts[at] = self.look_up("pairs", dealt(v[at], w[at], self.splits[before[at]], layout.shards), keys[at], layout.classes)
        counts = np.where(counts.sum(1, keepdims=True) >= layout.rare_below, counts, 0)
        stats = self.contexts[before].reshape(len(slots), -1, layout.classes)
        out = lower[slots]
        for c in range(layout.classes):
            d, n, total = layout.pair_discounts[c], counts[:, c], stats[:, 0, c]
            taken = d[0] * stats[:, 1, c] + d[1] * stats[:, 2, c] + d[2] * stats[:, 3, c] + (stats[:, 4, c] if layout.rare_below else 0)
            p = (np.maximum(n - np.array([0, *d])[np.minimum(n, 3)], 0) + taken * out[:, c]) / np.maximum(total, 1)
            out[:, c] = np.where(total > 0, p, out[:, c])
        return out

    def log_probabilities(self, slots: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 p(token | tokens before) at each position, a column for each class; the lowest order is shared by the classes."""
        layout = self.layout
        if not len(slots):
            return np.zeros((0, layout.classes))
        if not layout.size:
            return np.zeros((len(slots), layout.classes))
        out = self.pair_probabilities(slots, ends, np.repeat(self.lower()[:, None], layout.classes, axis=1))
        if layout.order == 3:
            v = previous(slots, ends)
            u = previous(v, ends)
            context = key_of(self.ids[u], self.ids[v])
            known = np.flatnonzero((self.ids[u] != UNKNOWN) & (self.ids[v] != UNKNOWN))
            shard = np.zeros(len(slots), np.uint64)
            shard[known] = dealt(self.ids[v[known]], self.ids[u[known]], self.splits[v[known]], layout.shards)
            stats = np.zeros((len(slots), 4), np.int64)
            stats[known] = self.look_up("contexts", shard[known], context[known], 4)
            known = known[(self.ids[slots[known]] != UNKNOWN) & (stats[known, 0] > 0)]
            keys = key_of(self.ids[u[known]], self.ids[v[known]], self.ids[slots[known]])
            n = np.zeros(len(slots), np.int64)
            n[known] = self.look_up("triples", shard[known], keys, 1)[:, 0]
            d, total = layout.triple_discounts, stats[:, 0]
            taken = stats[:, 1:] @ np.array(d)
            p = (np.maximum(n - np.array([0, *d])[np.minimum(n, 3)], 0) + taken * out[:, 0]) / np.maximum(total, 1)
            out[:, 0] = np.where(total > 0, p, out[:, 0])
        return np.log10(out)


def runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Sorted values with the ranges in which each stands."""
    if len(values):
        edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))).tolist()
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield int(values[a]), a, b


@worker_cache("kneser-ney")
def _reader(root: str, text: str) -> Reader:
    import pickle

    return Reader(pickle.loads(bytes.fromhex(text)))


def reader(layout: Layout) -> Reader:
    """The worker's reader of a model, kept between its tasks."""
    import pickle

    return _reader(layout.root, pickle.dumps(layout).hex())
