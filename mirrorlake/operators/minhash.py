"""Signatures of texts and candidate pairs by shared bands, with little moved between tasks.

A signature is made where its text is read; a band is two values side by side in one integer, dealt out once; a list that isn't over the
cap gives its pairs where it lies.  Pairs are first held against four bits of every value (64 bytes a file), which never counts too few
equal values, and only those that can reach the wanted estimate meet the whole signatures.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
PRIME = 2147483647
#: Shingles that are hashed at once.
AT_ONCE = 1 << 16


def shingles(text: str) -> np.ndarray:
    """Distinct pairs of neighbouring words as integers below the prime."""
    words = WORD.findall(text)
    found = {f"{a} {b}" for a, b in zip(words, words[1:])}
    heads = b"".join([md5(g.encode()).digest()[:8] for g in found])
    return (np.frombuffer(heads, ">u8").astype(np.uint64) >> np.uint64(4)) % np.uint64(PRIME)


def least(values: list[np.ndarray], seeds: int) -> np.ndarray:
    """The least value of each permutation, a row for each of ``values``, which aren't empty."""
    x, starts = np.concatenate(values), np.cumsum([0] + [len(v) for v in values[:-1]])
    low, out, prime = x & np.uint64(65535), np.empty((len(values), seeds), np.int32), np.uint64(PRIME)
    for s in range(1, seeds + 1):
        v = low * np.uint64((s * 1103515245 + 12345) % PRIME) + x + np.uint64((s * 69069 + 1) % PRIME)
        out[:, s - 1] = np.minimum.reduceat(v - v // prime * prime, starts)
    return out


def packed(sigs: np.ndarray) -> np.ndarray:
    """The last four bits of every value, sixteen of them in an integer."""
    n, seeds = sigs.shape
    nibbles = (sigs & 15).astype(np.uint64).reshape(n, seeds // 16, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(nibbles, axis=2).astype(np.int64)


def signatures(documents: DataFrame, seeds: int) -> DataFrame:
    """(doc_id, sig): texts without a pair of words have none.  ``documents``: doc_id, text.  Rows of one doc_id are one file."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32(), -1)

        def made(ids: list, values: list[np.ndarray]) -> pa.RecordBatch:
            sigs = least(values, seeds)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sigs.size + 1, seeds, dtype=np.int32)), pa.array(sigs.reshape(-1)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists.cast(kind)], ["doc_id", "sig"])

        for batch in batches:
            ids, values, held = [], [], 0
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                if text is None or not len(x := shingles(text)):
                    continue
                ids.append(batch.column(0)[k].as_py())
                values.append(x)
                held += len(x)
                if held >= AT_ONCE:
                    yield made(ids, values)
                    ids, values, held = [], [], 0
            if ids:
                yield made(ids, values)

    signed = cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, sig array<int>"))
    again = cut(signed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return signed
    same = F.expr("doc_id <=> again_id")
    ids = again.select(F.col("doc_id").alias("again_id"))
    merged = signed.join(ids, same, "left_semi").groupBy("doc_id").agg(F.array(*(F.min(F.col("sig")[s]) for s in range(seeds))).alias("sig"))
    return cut(signed.join(ids, same, "left_anti").unionAll(merged))


def _equal_nibbles(x: str, y: str) -> str:
    """How many of sixteen are equal: a nibble of the difference is 0."""
    d = f"({x} ^ {y})"
    half = f"({d} | shiftrightunsigned({d}, 1))"
    return f"(16 - bit_count(({half} | shiftrightunsigned({half}, 2)) & 1229782938247303441L))"


def candidates(signed: DataFrame, bands: int, cap: int, seeds: int, floor: float, every: bool = False) -> DataFrame:
    """Distinct pairs (a, b, key) that share a band which two to ``cap`` files have, written; ``key`` stands for one of these bands.

    Pairs that surely don't reach ``floor`` are left out, or with ``every`` have a null key.
    """
    words = seeds // 16

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sigs = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, seeds)
                # two values of 31 bits are one integer, so that equal integers are equal pairs
                pairs = (sigs[:, 0 : 2 * bands : 2].astype(np.int64) << 31) + sigs[:, 1 : 2 * bands : 2]
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, pairs.size + 1, bands, dtype=np.int32)), pa.array(pairs.reshape(-1)))
                bits = packed(sigs)
                yield pa.RecordBatch.from_arrays([batch.column(0), values, *(pa.array(bits[:, k]) for k in range(words))], ["doc_id", "vs", *(f"p{k}" for k in range(words))])

    bits = [f"p{k}" for k in range(words)]
    dealt = signed.select("doc_id", "sig").mapInArrow(pack, ", ".join(["doc_id long, vs array<long>", *(f"{p} long" for p in bits)])).selectExpr("doc_id", *bits, "posexplode(vs) AS (band, v)")
    held = dealt.selectExpr("*", "count(*) OVER (PARTITION BY band, v) AS held").where(f"held BETWEEN 2 AND {cap}")
    lists = held.groupBy("band", "v").agg(F.collect_list(F.struct("doc_id", *bits)).alias("files")).selectExpr("xxhash64(band, v) AS key", "files")
    both = lists.selectExpr("key", "files", "explode(files) AS x").selectExpr("key", "x", "explode(files) AS y").where("x.doc_id < y.doc_id")
    equal = " + ".join(_equal_nibbles(f"x.{p}", f"y.{p}") for p in bits)
    near = f"{equal} >= {floor} * {seeds}"
    if not every:
        both = both.where(near)
    return cut(both.selectExpr("x.doc_id AS a", "y.doc_id AS b", f"CASE WHEN {near} THEN key END AS key").groupBy("a", "b").agg(F.min("key").alias("key")))


def estimates(pairs: DataFrame, signed: DataFrame, seeds: int, floor: float) -> DataFrame:
    """(a, b, estimate) of what ``candidates`` gave: the share of equal values, where it is ``floor`` at least.

    Pairs meet the signatures by their keys: a file's signature is moved once for each key that its pairs have, not for each pair.
    """

    def compared(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        files, asked = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        ids, keys = np.unique(files.column("a").to_numpy()), np.unique(files.column("key").to_numpy())
        place = lambda k, d: np.searchsorted(keys, k) * len(ids) + np.searchsorted(ids, d)
        known = place(files.column("key").to_numpy(), files.column("a").to_numpy())
        order = np.argsort(known)
        sigs = files.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, seeds)
        at = lambda c: order[np.searchsorted(known[order], place(asked.column("key").to_numpy(), asked.column(c).to_numpy()))]
        x, y = at("a"), at("b")
        share = np.concatenate([np.zeros(0), *((sigs[x[i : i + 8192]] == sigs[y[i : i + 8192]]).sum(axis=1) / seeds for i in range(0, len(x), 8192))])
        found = pa.table({"a": asked.column("a"), "b": asked.column("b"), "estimate": pa.array(share)})
        return found.filter(pa.array(share >= floor))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not held.num_rows:
                continue
            keys = held.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if whole:
                yield from compared(held.slice(0, whole)).to_batches()
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from compared(held).to_batches()

    asked = pairs.where("key IS NOT NULL")
    files = asked.selectExpr("key", "explode(array(a, b)) AS doc_id").distinct().join(signed, "doc_id")
    rows = asked.selectExpr("key", "1 AS side", "a", "b", "CAST(NULL AS array<int>) AS sig").unionAll(files.selectExpr("key", "0 AS side", "doc_id AS a", "NULL AS b", "sig"))
    return rows.repartition("key").sortWithinPartitions("key", "side").mapInArrow(verify, "a long, b long, estimate double")
