"""Winnowed fingerprints made where a text is read, and pairs of files by the keys that they share: only the keys are moved, once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# blanks as the engines' \s has them: none beyond ASCII
TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^ \t\n\x0b\f\rA-Za-z0-9_]")


def winnowed(text: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places): the least hash of every window of ``w`` k-grams, the rightmost of equal ones; fewer k-grams give their least."""
    toks = TOKEN.findall(text)
    n = len(toks) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = b"".join([md5(" ".join(toks[i : i + k]).encode()).digest()[:8] for i in range(n)])
    h = (np.frombuffer(heads, ">u8").astype(np.uint64) >> np.uint64(4)).astype(np.int64)
    frames = np.lib.stride_tricks.sliding_window_view(h, min(w, n))
    at = np.unique(np.arange(len(frames)) + frames.shape[1] - 1 - np.argmin(frames[:, ::-1], axis=1))
    return h[at], at


def fingerprints(documents: DataFrame, k: int, w: int) -> DataFrame:
    """(doc_id, h, pos) of texts.  ``documents``: doc_id, text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                ids, hashes, places = [], [], []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    h, at = winnowed(text, k, w) if text is not None else ((), ())
                    ids += [doc] * len(h)
                    hashes.append(h)
                    places.append(at)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64)) for v in (hashes, places))], ["doc_id", "h", "pos"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, h long, pos long")


def sharing(rows: DataFrame, cap: int) -> DataFrame:
    """Pairs (a, b) of files that share a key which two to ``cap`` rows hold, not yet distinct.  ``rows``: id, h."""
    held = rows.selectExpr("*", "count(*) OVER (PARTITION BY h) AS held").where(f"held BETWEEN 2 AND {cap}")
    lists = held.groupBy("h").agg(F.collect_set("id").alias("ids")).where("size(ids) > 1")
    return lists.selectExpr("ids", "explode(ids) AS a").selectExpr("a", "explode(ids) AS b").where("a < b")
