"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece whose length lies in (C/(k+1), C/k] belongs to class k, and a bin of class k closes when it
holds exactly k pieces.  No bin ever has to be searched for, so every worker fills its own bins alone:
the operator is one map over the partitions, without a shuffle.

Documents may be cut, so the pieces are chosen to suit the classes: whole capacities first, then
powers of two down to ``least`` (each a class that k pieces fill exactly), then one short tail, whose
class wastes less than 1/(k+1) of a bin.  What is left in open bins when a partition ends (fewer than
k pieces a class) is laid end to end and cut at the capacity; the remainder is cut into powers of two,
which need no padding.

Null and empty texts give the single end id; texts of any length are packed whole.  Repeated rows, and rows that
repeat a doc_id, are packed each on its own; a null doc_id is kept as null.  Extra columns are ignored, whatever
their names.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, give_back
from .tokenizer_files import byte_bpe, vocabulary_path

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, ids binary"
)
#: Bits of a sequence's id that count within a worker's partition.
LOCAL_BITS = 36


def cuts(n: int, capacity: int, least: int) -> Iterator[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    for _ in range(n // capacity):
        yield capacity
    rest, size = n % capacity, capacity // 2
    while rest and size >= least:
        if rest >= size:
            yield size
            rest -= size
        size //= 2
    if rest:
        yield rest


class Bins:
    """The open bins of one worker, one for each class."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset, total = 0, sum(p[2] for p in pieces)
        for doc, start, length, ids, of in pieces:
            self.rows.append((doc, start, length, zlib.crc32(ids), of, self.next_id, offset, total, ids))
            offset += length
        self.next_id += 1

    def put(self, doc, start: int, ids: bytes, of: int) -> None:
        length = len(ids) // 4
        k = self.capacity // length
        if k == 1:
            self.close([(doc, start, length, ids, of)])
            return
        held = self.open.setdefault(k, [])
        held.append((doc, start, length, ids, of))
        if len(held) == k:
            self.close(self.open.pop(k))

    def finish(self) -> None:
        """Lay the pieces of the open bins end to end; cut at the capacity, and the remainder at powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        total = sum(p[2] for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        at = 0
        for size in sizes:
            pieces, room = [], size
            while room:
                doc, start, length, ids, of = left[at]
                take = min(room, length)
                pieces.append((doc, start, take, ids[: 4 * take], of))
                room -= take
                if take == length:
                    at += 1
                else:
                    left[at] = (doc, start + take, length - take, ids[4 * take :], of)
            self.close(pieces)

    def drain(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 0, least: int = 64, with_ids: bool = True) -> DataFrame:
    """One row a piece: the document's id and range of ids, the sequence it lies in and where.

    ``capacity`` and ``least`` are powers of two.  ``with_ids`` adds the ids of the piece themselves
    (little-endian unsigned 32-bit).  Sequence ids are unique over all workers; within a sequence the
    offsets run from 0 without a gap.
    """
    path = tokenizer or vocabulary_path("byte_bpe_50k.json")
    batches(docs.sparkSession)
    end = np.uint32(end_id).tobytes()
    kind = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (c.split()[0] for c in SCHEMA.split(", "))])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = byte_bpe(path).encode_all
        bins = Bins(capacity, TaskContext.get().partitionId() << LOCAL_BITS)

        def out() -> Iterator[pa.RecordBatch]:
            rows = bins.drain()
            for i in range(0, len(rows), 4000):
                columns = list(zip(*rows[i : i + 4000], strict=True))
                if not with_ids:
                    columns[-1] = [None] * len(columns[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

        for batch in stream:
            texts = encode([t or "" for t in batch.column(1).to_pylist()])
            for doc, ids in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids += end
                n, at = len(ids) // 4, 0
                for size in cuts(n, capacity, least):
                    bins.put(doc, at, ids[4 * at : 4 * (at + size)], n)
                    at += size
            yield from out()
        bins.finish()
        yield from out()
        give_back()

    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, SCHEMA)
    return packed if with_ids else packed.drop("ids")
