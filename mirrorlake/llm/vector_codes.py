"""Compression of vectors into codes: product quantisation with integer codebooks, the same on every machine.

Components become integers, so that distances, sums and means are exact and no order of additions can change a code.
A vector is cut into equal parts, every part position has a codebook.  A round broadcasts the codebooks (parts x
entries x width integers, whatever the table); a worker takes an Arrow batch at a time, gets all squared distances of a part from
the norms and one int64 matrix product, takes the first least entry, and adds up counts and sums by entry for its whole partition.
These come together in a shuffle grouped by part, entry and place, and only the sums reach the driver, which makes the
next codebooks.  Vectors that are equal, or a label that most have, cost no more than others: sums are made before the shuffle.

Rows whose vector is null or holds null or non-finite components are dropped.  The width is that of the vector of least vec_id whose
length is a positive multiple of ``parts``; vectors of another length, or with components so large that a
sum of squares could pass 62 bits, keep their row with a null code and error and influence nothing.
A codebook starts with the vectors of the least ``entries`` rows by vec_id (nulls last), then by packed components; with fewer rows it has
fewer entries.  Rows that repeat a vec_id are coded each.  Labels may be null (one label of their own); label_error is null
where it would pass 63 bits or where no vector of the label has a code.  An empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, settle, shared_dir

SCALE = 4096
#: Labels that may be broadcast with their sums (some tens of bytes each); more are joined by a shuffle, hot ones apart.
MOST_LABELS, HOT_LABEL = 1_000_000, 1_000_000
_PACKED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("width", pa.int32()), ("x", pa.binary())])
_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])
_CODES = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])


def most_of(width: int) -> int:
    """How large components of vectors of this width may be, so that no squared distance passes 62 bits."""
    return math.isqrt((1 << 60) // width) if width else 0


def integers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Places of the vectors that are kept, and their integer components; None for those out of bounds."""
    starts, values = vectors.offsets.to_pylist(), vectors.values
    plain = np.asarray(values.fill_null(math.nan).to_numpy(zero_copy_only=False))
    good, present = np.isfinite(plain), np.asarray(vectors.is_valid())
    with np.errstate(over="ignore", invalid="ignore"):
        floors = np.floor(plain * scale)
    at, out = [], []
    for i in np.flatnonzero(present).tolist():
        a, b = starts[i], starts[i + 1]
        if good[a:b].all():
            at.append(i)
            fits = b > a and np.abs(floors[a:b]).max() <= most_of(b - a)
            out.append(floors[a:b].astype("<i8") if fits else None)
    return np.array(at, np.int64), out


def pack(vectors: DataFrame, column: str, scale: int) -> DataFrame:
    """The kept rows: vec_id, label, width, components as little-endian 64-bit integers (both null out of bounds)."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at, found = integers(batch.column(2), scale)
            if len(at):
                rows = batch.take(pa.array(at))
                width, x = (pa.array([None if v is None else f(v) for v in found], t) for f, t in ((len, pa.int32()), (bytes, pa.binary())))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), width, x], schema=_PACKED)

    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col(column).cast("array<double>")).mapInArrow(work, "vec_id long, label long, width int, x binary")


def matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a packed batch are of this width, and their components as an integer matrix."""
    fit = np.asarray(batch.column(2).fill_null(-1)) == width
    x = b"".join(v for v, f in zip(batch.column(3).to_pylist(), fit.tolist(), strict=True) if f)
    return fit, np.frombuffer(x, "<i8").reshape(-1, width).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row the first of the nearest entries, and the squared distance to it: |x|^2 - 2 x.c + |c|^2 in exact integers."""
    apart = (book * book).sum(axis=1)[None, :] - 2 * (x @ book.T)
    least = apart.argmin(axis=1)
    return least, apart[np.arange(len(x)), least] + (x * x).sum(axis=1)


def sums(packed: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, place, n, total) of one round, summed over all workers."""
    parts, entries, part_width = books.shape
    shared = packed.sparkSession.sparkContext.broadcast(books)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        n, total = np.zeros((parts, entries), np.int64), np.zeros(held.shape, np.int64)
        for batch in stream:
            _, x = matrix(batch, parts * part_width)
            for p in range(parts):
                own = x[:, p * part_width : (p + 1) * part_width]
                chosen = nearest(own, held[p])[0]
                member = (chosen[:, None] == np.arange(entries)).astype(np.int64)
                n[p] += member.sum(axis=0)
                total[p] += member.T @ own
        part, entry, place = (a.ravel().astype(np.int32) for a in np.indices(held.shape))
        used = np.repeat(n.ravel(), part_width)
        take = used > 0
        if take.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[take]) for a in (part, entry, place, used, total.ravel())], schema=_SUMS)

    return packed.mapInArrow(work, "part int, entry int, place int, n long, total long").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(packed: DataFrame, width: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, width / parts) after the rounds."""
    first = packed.where(F.col("width") == width).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    books = np.array([np.frombuffer(r.x, "<i8") for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        for r in sums(packed, books).collect():  # as many rows as the codebooks have numbers
            books[r.part, r.entry, r.place] = r.total // r.n
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(packed: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """vec_id, label, code, error of every packed row."""
    parts, entries, part_width = books.shape
    shared = packed.sparkSession.sparkContext.broadcast(books)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in stream:
            fit, x = matrix(batch, width)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts if entries else 0):
                chosen, apart = nearest(x[:, p * part_width : (p + 1) * part_width], held[p])
                codes[:, p] = chosen
                error += apart
            at = np.flatnonzero(fit).tolist()
            code, errors = [None] * len(fit), [None] * len(fit)
            for i, row, e in zip(at, codes, error.tolist(), strict=True):
                code[i], errors[i] = row.tobytes().hex(), e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(errors, pa.int64())], schema=_CODES)

    return packed.mapInArrow(work, "vec_id long, label long, code string, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds the error summed over equal labels.  Sums are made before the shuffle; labels are broadcast where they are few, and hot ones always."""
    totals = rows.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("held")).withColumnRenamed("label", "of")
    same = lambda other: F.col("label").eqNullSafe(other["of"])
    if totals.count() <= MOST_LABELS:
        few = F.broadcast(totals.drop("held"))
        return rows.join(few, same(few), "left").drop("of")
    hot, cold = F.broadcast(totals.where(F.col("held") > HOT_LABEL).drop("held")), totals.where(F.col("held") <= HOT_LABEL).drop("held")
    rest = rows.join(hot, same(hot), "left_anti")
    return rows.join(hot, same(hot)).drop("of").unionByName(rest.join(cold, same(cold)).drop("of"))


def compress(vectors: DataFrame, column: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE) -> DataFrame:
    """Per kept vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256.  ``vectors``: vec_id, label and the vectors."""
    if not 0 < entries <= 256:
        raise ValueError("an entry is a byte: 1 to 256 entries")
    spark = vectors.sparkSession
    batches(spark)
    root = shared_dir(spark, "vector-codes")
    packed = settle(spark, pack(vectors, column, scale), f"{root}/packed")
    first = packed.where(f"width > 0 AND width % {parts} = 0").orderBy(F.col("vec_id").asc_nulls_last(), "x").select("width").first()
    width = first.width if first else parts
    books = train(packed, width, parts, entries, rounds)
    rows = settle(spark, coded(packed, books, width), f"{root}/codes")
    return with_label_error(rows).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE) -> str:
    """The query's rows in SQL: a row for every component, a CTE for every round.  For vectors of one length and distinct vec_ids."""
    ctes = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        f"cells AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(x) // {parts}) AS part, (i - 1) % (len(x) // {parts}) AS place, x[i] AS v FROM (SELECT vec_id, x, unnest(range(1, len(x) + 1)) AS i FROM kept))",
        f"book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, place, v AS c FROM cells JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM kept) USING (vec_id) WHERE r <= {entries})",
    ]
    for k in range(rounds + 1):
        ctes.append(f"near{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT vec_id, part, entry, CAST(sum((v - c) * (v - c)) AS BIGINT) AS d FROM cells JOIN book{k} USING (part, place) GROUP BY vec_id, part, entry) GROUP BY vec_id, part)")
        if k < rounds:
            mean = f"SELECT part, entry, place, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM cells JOIN near{k} USING (vec_id, part) GROUP BY part, entry, place"
            ctes.append(f"book{k + 1} AS MATERIALIZED (SELECT part, entry, place, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM book{k} LEFT JOIN ({mean}) USING (part, entry, place))")
    return f"""WITH {", ".join(ctes)},
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book{rounds}) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)"""
