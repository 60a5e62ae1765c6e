"""Language-model scores by an interpolated modified Kneser-Ney trigram model counted in Spark.

The model (``kneser_ney``) is counted over the training texts, stored as sorted hash arrays in the shared
folder and memory-mapped by the workers, which score whole texts.

Null and empty texts hold one token, the end; texts of any length are scored whole.  Repeated rows, and rows that
repeat a doc_id, are scored each; a null doc_id stays null and counts as the empty text in the fold; an empty
training set leaves every token unknown; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, fold
from .kneser_ney import Layout, hashed, reader, train

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: The added count of the base score.
ADDED = 0.1


def fit(texts: DataFrame, tag: str = "lm", order: int = 3) -> Layout:
    return train(texts.select(F.col("text").cast("string").alias("text")), tag, order)


def score(docs: DataFrame, model: Layout) -> DataFrame:
    """``docs``: text, doc_id, held_out.  Per document: tokens, known tokens, an add-0.1 unigram score and the model's log10 probability."""
    batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = reader(model)
        total, size = model.totals[0], model.size
        for others, hashes, ends in hashed(stream):
            slots = m.slots(hashes)
            counts = m.counts[:, 0]
            base = np.log10((counts + ADDED) / (total + ADDED * (size + 1)))[slots]
            first = np.concatenate(([0], ends[:-1] + 1))
            sums = lambda x: np.add.reduceat(x, first)
            doc, held = zip(*others, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()),
                    pa.array(held, pa.bool_()),
                    pa.array(ends - first + 1),
                    pa.array(sums((counts > 0)[slots].astype(np.int64))),
                    pa.array(np.full(len(doc), total, np.int64)),
                    pa.array(sums(base)),
                    pa.array(sums(m.log_probabilities(slots, ends)[:, 0])),
                ],
                schema=schema,
            )

    return docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"), "held_out").mapInArrow(work, SCHEMA)


def score_held_out(docs: DataFrame, mod: int = 10, held: int = 0) -> DataFrame:
    """Train on all documents but the held-out fold, score all of them."""
    split = docs.select("text", "doc_id", (fold(mod) == held).alias("held_out"))
    return score(split, fit(split.where(~F.col("held_out"))))
