"""Pairwise alignment kernels over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def lcs(a, b, band: int = 64, most_cells: int = 4_000_000) -> int | None:
    """Length of the longest common subsequence within a band of ``band`` plus the gap in length; None if it would take too many cells."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0
    reach = band + abs(n - m)
    if n * min(m, 2 * reach + 1) > most_cells:
        return None
    codes: dict = {}
    x = [codes.setdefault(t, len(codes)) for t in a]
    y = np.array([codes.setdefault(t, len(codes)) for t in b])
    row = np.zeros(m + 1, np.int64)
    for i in range(n):
        lo, hi = max(0, i - reach), min(m, i + reach + 1)
        same = np.flatnonzero(y[lo:hi] == x[i]) + lo
        new = row.copy()
        new[same + 1] = np.maximum(new[same + 1], row[same] + 1)
        row = np.maximum.accumulate(new)
    return int(row[-1])


#: Cells of a full alignment (4 bytes each) that a task holds; larger pairs aren't measured.
MOST_CELLS = 1 << 24


@F.pandas_udf(DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 LCS / (n + m); 1 for two empty sequences; null if it isn't measured."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = ([] if x is None else list(x)), ([] if y is None else list(y))
        common = lcs(x, y)
        out.append(None if common is None else 1.0 if not x and not y else 2 * common / (len(x) + len(y)))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(StructType([StructField("edits", LongType()), StructField("changes", LongType())]))
def substitution_witness(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Best alignment with 3 for equal and 2 for replaced elements: how many edits, and how many distinct replacements; null if it isn't measured."""
    rows = []
    for x, y in zip(a, b, strict=True):
        x, y = ([] if x is None else list(x)), ([] if y is None else list(y))
        if len(x) * len(y) > MOST_CELLS:
            rows.append((None, None))
            continue
        codes: dict = {}
        a_, b_ = (np.array([codes.setdefault(t, len(codes)) for t in s], np.int64) for s in (x, y))
        score = np.zeros((len(x) + 1, len(y) + 1), np.int32)
        for i in range(1, len(x) + 1):  # a row at a time: the best from above or across, then what its left neighbours reach
            score[i, 1:] = np.maximum.accumulate(np.maximum(score[i - 1, 1:], score[i - 1, :-1] + np.where(b_ == a_[i - 1], 3, 2)))
        i, j, edits, pairs = len(x), len(y), 0, set()
        while i and j:
            step = 3 if x[i - 1] == y[j - 1] else 2
            if score[i, j] == score[i - 1, j - 1] + step:
                if step == 2:
                    edits += 1
                    pairs.add((x[i - 1], y[j - 1]))
                i, j = i - 1, j - 1
            elif score[i - 1, j] >= score[i, j - 1]:
                i, edits = i - 1, edits + 1
            else:
                j, edits = j - 1, edits + 1
        rows.append((edits + i + j, len(pairs)))
    return pd.DataFrame(rows, columns=["edits", "changes"])


def alignment(x: list, y: list, band: int = 64, most_cells: int = 4_000_000) -> list[tuple[int, int]] | None:
    """Places of a longest common subsequence within a band, latest matches first taken from the ends; None if it isn't measured."""
    n, m = len(x), len(y)
    reach = band + abs(n - m)
    if n * m > most_cells:
        return None
    codes: dict = {}
    a = [codes.setdefault(t, len(codes)) for t in x]
    b = np.array([codes.setdefault(t, len(codes)) for t in y], np.int64)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n):
        lo, hi = max(0, i - reach), min(m, i + reach + 1)
        row = best[i].copy()
        same = np.flatnonzero(b[lo:hi] == a[i]) + lo
        row[same + 1] = np.maximum(row[same + 1], best[i, same] + 1)
        best[i + 1] = np.maximum.accumulate(row)
    pairs, i, j = [], n, m
    while i and j:
        if a[i - 1] == b[j - 1] and abs(i - j) <= reach and best[i, j] == best[i - 1, j - 1] + 1:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i - 1, j] >= best[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def agreement(x: str, y: str) -> float:
    """Of two texts of tokens the share of places with the same one, over the longer."""
    p, q = x.split(), y.split()
    return sum(a == b for a, b in zip(p, q)) / max(len(p), len(q), 1) if p or q else 1.0  # noqa: B905  the shorter ends first


@F.pandas_udf(StructType([StructField("sequence", DoubleType()), StructField("lexical", DoubleType())]))
def aligned_statements(kinds_a: pd.Series, texts_a: pd.Series, kinds_b: pd.Series, texts_b: pd.Series) -> pd.DataFrame:
    """Statements aligned by kind: 2 LCS / (n + m), and the mean agreement of the texts of aligned ones (0 if there are none); null if it isn't measured."""
    rows = []
    for ka, ta, kb, tb in zip(*([list(v) for v in c] for c in (kinds_a, texts_a, kinds_b, texts_b)), strict=True):
        pairs = alignment(ka, kb)
        if pairs is None:
            rows.append((None, None))
            continue
        sequence = 2 * len(pairs) / (len(ka) + len(kb)) if ka or kb else 1.0
        rows.append((sequence, sum(agreement(ta[i], tb[j]) for i, j in pairs) / len(pairs) if pairs else 0.0))
    return pd.DataFrame(rows, columns=["sequence", "lexical"], dtype="float64")
