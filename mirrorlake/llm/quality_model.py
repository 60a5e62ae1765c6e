"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of about ``PASSAGE`` bytes.  Each passage is encoded: hashed byte
trigrams (square roots of shares), shares of classes of bytes, the entropy of the trigrams, its length.
A gated attention layer, learned from document labels alone, weighs the passages; the weighted sum of
their hidden representations is the document's, and a logistic unit scores it:

    h = tanh(W x),  a = softmax(w . (tanh(V h) * sigmoid(U h))),  score = sigmoid(c . sum(a h) + b)

Training uses a bounded sample: the ``SAMPLE`` distinct labelled training documents with the least hash of id
and text, as far as their texts have ``SAMPLE_BYTES`` in all; each is taken whole.  Scoring takes every passage of
every document, however long.

Null and empty texts are one empty passage.  Without labels of both classes every score is the share of
label 1 (0.5 if there is none); of several labels of a document the greatest counts.  Repeated rows are scored
each; a null doc_id stays null and isn't learned from; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, claim, filter_texts, fold, groups
from .labelled import labelled, sample

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
PASSAGE, BUCKETS, HIDDEN, GATE = 600, 256, 24, 12
SAMPLE, SAMPLE_BYTES, EPOCHS, RATE, DECAY, THRESHOLD = 4000, 24 << 20, 30, 0.01, 1e-4, 0.3
#: Bytes of text that are encoded at once, one text at least: an encoding takes some forty times its texts for a moment.
ENCODED_BYTES = 1 << 19


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for i in range(256):
        c = chr(i)
        if i >= 128:
            table[i] = 7
        elif c == "\n":
            table[i] = 6
        elif c.isspace():
            table[i] = 5
        elif c in "#*$%&|<>":
            table[i] = 4
        elif c.isdigit():
            table[i] = 3
        elif c.isupper():
            table[i] = 2
        elif c.islower():
            table[i] = 1
    return table


CLASSES = _byte_classes()
WIDTH = BUCKETS + 8 + 3


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows for all passages of all texts, and the number of passages of each text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    count = np.maximum(1, (size + PASSAGE // 2) // PASSAGE)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    n = int(count.sum())
    data = np.frombuffer(b"".join(texts), np.uint8)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    within = np.arange(len(data), dtype=np.int64) - np.repeat(start, size)
    passage = np.repeat(first, size) + np.minimum(within // PASSAGE, np.repeat(count, size) - 1)
    x = data.astype(np.uint32)
    if len(x) >= 3:
        key = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)
        inside = (np.repeat(size, size) - within)[:-2] > 2  # a trigram doesn't reach over into the next text
        cell = passage[:-2] * BUCKETS + (key >> np.uint32(24)).astype(np.int64)
        grams = np.bincount(cell[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    else:
        grams = np.zeros((n, BUCKETS), np.int64)
    kinds = np.bincount(passage * 8 + CLASSES[data], minlength=n * 8).reshape(n, 8)
    total = np.maximum(kinds.sum(1, keepdims=True), 1)
    share = grams / np.maximum(grams.sum(1, keepdims=True), 1)
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(1, keepdims=True)
    length = np.log1p(kinds.sum(1, keepdims=True))
    out = np.concatenate([np.sqrt(share), kinds / total, entropy, length, np.repeat(np.log1p(size), count)[:, None]], axis=1)
    return out.astype(np.float32), count


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]
    even: float | None = None  # a constant score, where nothing could be learned

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        """All layers for bags whose passages are laid end to end."""
        p, first = self.parts, np.concatenate(([0], np.cumsum(count)[:-1]))
        bag = np.repeat(np.arange(len(count)), count)
        h = np.tanh(x @ p["W"] + p["w0"])
        t, g = np.tanh(h @ p["V"] + p["v0"]), 1 / (1 + np.exp(-(h @ p["U"] + p["u0"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "s": s, "bag": bag, "first": first}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.even is not None:
            return np.full(len(texts), self.even)
        claim("quality-model")
        out = [np.zeros(0)]
        for some in groups(texts, ENCODED_BYTES):
            x, count = encode(some)
            out.append(self.forward((x - self.centre) / self.scale, count)["s"].astype(np.float64))
        return np.concatenate(out)

    def gradients(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.parts, self.forward(x, count)
        h, t, g, a, bag, first = f["h"], f["t"], f["g"], f["a"], f["bag"], f["first"]
        d = (f["s"] - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {
            "W": x.T @ dh, "w0": dh.sum(0), "V": h.T @ dt, "v0": dt.sum(0), "U": h.T @ dg, "u0": dg.sum(0),
            "w": (t * g).T @ de, "c": f["z"].T @ d, "b": d.sum(keepdims=True),
        }


def learn(bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the cross entropy of bags in shuffled groups of 32."""
    if len(set(y.tolist())) < 2:
        return Network(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), {}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    centre, scale = every.mean(0), every.std(0) + 1e-3
    bags = [(b - centre) / scale for b in bags]
    init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    zero = lambda n: np.zeros(n, np.float32)
    net = Network(centre, scale, {"W": init(WIDTH, HIDDEN), "w0": zero(HIDDEN), "V": init(HIDDEN, GATE), "v0": zero(GATE), "U": init(HIDDEN, GATE), "u0": zero(GATE), "w": init(GATE), "c": init(HIDDEN), "b": zero(1)})
    m = {k: np.zeros_like(v) for k, v in net.parts.items()}
    v = {k: np.zeros_like(x) for k, x in net.parts.items()}
    step, epochs = 0, max(EPOCHS, min(200, 60_000 // len(bags)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 32):
            chosen = order[at : at + 32]
            x = np.concatenate([bags[i] for i in chosen])
            grads = net.gradients(x, np.array([len(bags[i]) for i in chosen]), y[chosen])
            step += 1
            for k, grad in grads.items():
                grad = grad + DECAY * net.parts[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                net.parts[k] = (net.parts[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(training: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Network:
    """``training``: doc_id, text, label (0 or 1).  The sample is encoded by the workers, all passages of its documents."""
    batches(training.sparkSession)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality-model")
        for batch in stream:
            if not batch.num_rows:
                continue
            out = []
            for some in groups([(t or "").encode() for t in batch.column(0).to_pylist()], ENCODED_BYTES):
                x, count = encode(some)
                out += [x[e - n : e].tobytes() for e, n in zip(np.cumsum(count).tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], names=["label", "x"])

    rows = sample(training, most, most_bytes).orderBy("doc_id", F.xxhash64("text")).select("text", "label").mapInArrow(work, "label int, x binary").collect()
    return learn([np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in rows], np.array([r.label for r in rows], np.float32))


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``: text, doc_id, held_out."""
    batches(docs.sparkSession)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            s = net.scores([(t or "").encode() for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"), "held_out").mapInArrow(work, SCHEMA)


def accepted(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """Whole rows of ``docs`` whose texts score ``threshold`` or more."""
    return filter_texts(docs, lambda texts: net.scores([t.encode() for t in texts]) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> DataFrame:
    """Learn from the labelled documents outside the held-out fold, score all."""
    net = fit(labelled(docs.where(fold(mod) != held), labels, "quality"))
    return score(docs.select("text", "doc_id", (fold(mod) == held).alias("held_out")), net)
