"""Quality rules with n-gram perplexity bands.

Base counts come first (words, symbols, repeated lines, words in repeated windows).  Then modified
Kneser-Ney word models (``kneser_ney``), counted over all documents, give every text a perplexity; texts
whose log perplexity lies outside their language's band are rejected.  A model would know the word order
of the texts it was counted on, so texts are dealt into two parts by the least hash of their long words,
all copies of a text and most near copies to one, and each is scored by the other part's model.  One model is counted, used
and removed before the other, so that one at a time is on disk.  A band is set by the language's distinct texts of the
part that pass the base rules, so that copies count once: their median, and ``low`` and ``high`` times the
distance to the lower and the upper quartile of the deviations from it, which is ``FLOOR`` at least,
however alike most texts are.  The mean of n words' log probabilities varies as 1/sqrt(n), so deviations
are taken times the root of the words: a short text has a wider band than a long one.

Null and empty texts have no words and fail the base rules; texts of any length are judged whole.  A null language is
the same language as an empty one.  Repeated rows are judged each; a null doc_id stays null; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kneser_ney
from .common import batches, drop, settle, shared_dir

#: The symbols that are counted; the white space between words.
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Factors of the band; HIGH and the root of the bytes were chosen among 21 settings on the labelled documents of sf0.1.
LOW, HIGH = 6.0, 4.5
#: Least distance of a quartile: what it is where the log10 probabilities of a text's words are independent with a standard deviation of 1.5.
FLOOR = 1.5 * 0.6745
#: Texts are dealt into two parts by their words of so many letters.
PARTS, LONG_WORD = 2, r"\p{L}{7,}"
#: Bands (a row for each language and part) that may be broadcast.
MOST_BANDS = 100_000
MEASURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ppl double, n_tokens long, text_hash long, part long"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of 3 words that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    key = np.sort(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9))
    if not (key[1:] == key[:-1]).any():
        return 0  # equal windows have equal hashes
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1].ravel()
    key = pair[:-1] * len(seen) + ids[2:]  # equal for equal windows only
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(np.count_nonzero(covered))


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def dealt(text: Column) -> Column:
    """The part of a text: by the least hash of its long words, which most near copies share, or of the text if it has none."""
    words = F.transform(F.regexp_extract_all(text, F.lit(LONG_WORD), F.lit(0)), lambda w: F.xxhash64(w))
    return F.pmod(F.xxhash64(F.coalesce(F.array_min(words), F.xxhash64(text))), F.lit(PARTS)).cast("long")


def measure(docs: DataFrame, model: kneser_ney.Layout) -> DataFrame:
    """``docs``: doc_id, lang, text, text_hash, part.  Per document: the base counts and the log perplexity a word, the end included."""
    batches(docs.sparkSession)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kneser_ney.reader(model)
        for batch in stream:
            if not batch.num_rows:
                continue
            texts = [t or "" for t in batch.column(2).to_pylist()]
            counts = [base_counts(t, t.encode()) for t in texts]
            failed = [n < LEAST_WORDS or 100 * r > MOST_REPEATED * n for n, _, _, _, r in counts]
            hashes, ends = kneser_ney.token_hashes([kneser_ney.lowered(t.encode()) for t in texts])
            slots = m.slots(hashes)
            first = np.concatenate(([0], ends[:-1] + 1))
            size = ends - first + 1
            logs = np.add.reduceat(m.log_probabilities(slots, ends)[:, 0], first) / size
            columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(failed, pa.bool_()), pa.array(-logs), pa.array(size, pa.int64()), batch.column(3), batch.column(4)], names=[c.split()[0] for c in MEASURES.split(", ")])

    return docs.select("doc_id", "lang", "text", "text_hash", "part").mapInArrow(work, MEASURES)


def bands(measured: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Per language and part: the median log perplexity of the distinct texts, and how far below and above it texts may lie, times the root of their tokens."""
    sound = measured.where(~F.col("base_failed")).withColumn("language", F.coalesce("lang", F.lit("")))
    sound = sound.groupBy("language", "part", "text_hash").agg(F.min("log_ppl").alias("log_ppl"), F.min("n_tokens").alias("n_tokens"))
    middle = sound.groupBy("language", "part").agg(F.percentile_approx("log_ppl", 0.5, 10000).alias("middle"))
    off = (F.col("log_ppl") - F.col("middle")) * F.sqrt("n_tokens")
    spread = sound.join(checked(middle), ["language", "part"]).groupBy("language", "part", "middle").agg(F.percentile_approx(off, [0.25, 0.75], 10000).alias("q"))
    return spread.select("language", "part", "middle", (low * F.least(F.col("q")[0], F.lit(-FLOOR))).alias("below"), (high * F.greatest(F.col("q")[1], F.lit(FLOOR))).alias("above"))


def checked(bands: DataFrame) -> DataFrame:
    """Rows of languages, written and then broadcast if they are few."""
    spark = bands.sparkSession
    bands = settle(spark, bands, shared_dir(spark, "quality-bands"))
    return F.broadcast(bands) if bands.count() <= MOST_BANDS else bands


def judge(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Per document: the base counts, the perplexity, its band, and whether the document is kept."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text.alias("text"), F.xxhash64(text).alias("text_hash"), dealt(text).alias("part"))
    measured = []
    for k in range(PARTS):
        model = kneser_ney.train(split.where(F.col("part") != k).select("text"), f"quality-model-{k}")
        own = split.where(F.col("part") == k).withColumn("part", F.lit(k).cast("long"))
        measured.append(settle(spark, measure(own, model), shared_dir(spark, f"quality-measures-{k}")))
        drop(spark, model.root)
    measured = reduce(DataFrame.unionAll, measured)
    root = F.sqrt(F.greatest("n_tokens", F.lit(1)))
    least, most = F.col("middle") + F.col("below") / root, F.col("middle") + F.col("above") / root
    within = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(least, most), F.lit(False))
    ten = F.lit(10.0)
    return (
        measured.withColumn("language", F.coalesce("lang", F.lit("")))
        .join(checked(bands(measured, low, high)), ["language", "part"], "left")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", within.alias("kept"), F.pow(ten, "log_ppl").alias("perplexity"), F.pow(ten, least).alias("least_perplexity"), F.pow(ten, most).alias("most_perplexity"))
    )
