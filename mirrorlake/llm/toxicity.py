"""Toxicity by class-conditional Kneser-Ney models.

Labelled training documents are counted by class into one set of arrays (``kneser_ney``).  Each class has
its own discounted pair counts over its own discounted word counts (a word counts once a document), and both
classes' words share one continuation distribution, counted from the pairs of both, that takes what the discounts
free.  An expression seen fewer than ``RARE`` times in both together gives all its counts to the shared
backoff, so it argues for neither class.  A token's evidence is the difference of the two classes' log
probabilities, once by words and once by pairs; a document's features are these differences normalised by length, over the whole text and over
its strongest spans (toxic words stand in few places of a long text).  A logistic curve over the features,
fitted to training documents that the models were not counted on, gives the score.

Learned from: labels and texts of the training fold only.  Null and empty texts hold the end token alone
and get a score like any other; texts of any length are scored whole.  Without labels of both classes every score is 0; of several labels
of a document the greatest counts.  Repeated rows are scored each; a null doc_id stays null and isn't learned from; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, filter_texts, fold, groups
from .kneser_ney import Layout, hashed, letters, reader, token_hashes, train
from .labelled import labelled, sample

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Expressions seen less often are left to the shared backoff; lengths of spans; the threshold.  The first two have the least
#: log loss, of settings with pairs, in a cross-validation within the training folds of sf0.1 (README).
RARE, SPANS, THRESHOLD = 4, (1,), 0.7
#: One in so many training documents is for the curve; of these at most so many, and so many bytes of text, are used.
PART, SAMPLE, SAMPLE_BYTES = 4, 20_000, 256 << 20
#: Bytes of text that the filter scores at once, one text at least: scoring takes some forty times its texts for a moment.
SCORED_BYTES = 1 << 18


@dataclass
class Model:
    layout: Layout
    curve: tuple[np.ndarray, np.ndarray, np.ndarray] | None  # centre, scale, weights (the constant last)

    def scores(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(ends))
        centre, scale, w = self.curve
        return 1 / (1 + np.exp(-np.clip((_features_of(self.layout, hashes, ends) - centre) / scale @ w[:-1] + w[-1], -30, 30)))


def features(evidence: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of: mean evidence of the text, then of its strongest span of each length (the whole text if it is shorter)."""
    first = np.concatenate(([0], ends[:-1] + 1))
    size = ends - first + 1
    run = np.concatenate(([0.0], np.cumsum(evidence)))
    out = np.empty((len(ends), 1 + len(SPANS)))
    out[:, 0] = (run[ends + 1] - run[first]) / size
    for j, span in enumerate(SPANS, 1):
        at = np.arange(len(evidence))
        text = np.repeat(np.arange(len(ends)), size)
        start = np.maximum(at - span + 1, first[text])
        sums = (run[at + 1] - run[start]) / span
        out[:, j] = np.maximum.reduceat(sums, first)
    return out


def _features_of(layout: Layout, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    m = reader(layout)
    slots = m.slots(hashes)
    single = m.class_words(m.lower())
    logs, pairs = np.log10(single)[slots], np.log10(m.pair_probabilities(slots, ends, single))
    return np.concatenate([features(x[:, 1] - x[:, 0], ends) for x in (logs, pairs)], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method on standardised features."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return centre, scale, w


def fit(training: DataFrame) -> Model:
    """``training``: doc_id, text, label (0 or 1)."""
    part = (F.floor(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) / 7) % PART) == 0
    layout = train(training.where(~part).select("text", F.col("label").alias("class")), "toxicity-model", classes=2, rare_below=RARE, clean=letters, once=True)
    if not all(layout.totals):
        return Model(layout, None)
    schema = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for others, hashes, ends in hashed(stream, letters):
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in others], pa.int32()), pa.array(_features_of(layout, hashes, ends).tolist(), schema.field("x").type)], schema=schema)

    rows = sample(training.where(part), SAMPLE, SAMPLE_BYTES).select("text", "label").mapInArrow(work, "label int, x array<double>").collect()
    y = np.array([r.label for r in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(layout, None)
    return Model(layout, fit_curve(np.array([r.x for r in rows]), y))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``: text, doc_id, held_out."""
    batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for others, hashes, ends in hashed(stream, letters):
            doc, held = zip(*others, strict=True)
            s = model.scores(hashes, ends)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=schema)

    return docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"), "held_out").mapInArrow(work, SCHEMA)


def below(texts: list[str], model: Model, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the texts score less than ``threshold``."""
    found = [np.zeros(0, bool)]
    for some in groups([t.encode() for t in texts], SCORED_BYTES):
        found.append(model.scores(*token_hashes([letters(t) for t in some])) < threshold)
    return np.concatenate(found)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Whole rows of ``docs`` whose texts score less than ``threshold``."""
    return filter_texts(docs, lambda texts: below(texts, model, threshold))


def classify(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """Learn from the labelled documents outside the held-out fold, score all."""
    model = fit(labelled(docs.where(fold(mod) != held), labels, "toxic"))
    return score(docs.select("text", "doc_id", (fold(mod) == held).alias("held_out")), model)
