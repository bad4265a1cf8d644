"""Scalar formulas of retrieval."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# BM25 saturation, length normalisation, least inverse frequency, weight of adjacent pairs, RRF constant.
K1, B, LEAST_IDF, PAIR_WEIGHT, RRF = 1.2, 0.75, 1e-6, 0.2, 60


def idf(df: Column, total: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5)), at least LEAST_IDF, with df at most N."""
    d = F.least(df, total).cast("double")
    return F.greatest(F.log((total - d + F.lit(0.5)) / (d + F.lit(0.5))), F.lit(LEAST_IDF))


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    """The tf part of BM25."""
    t = tf.cast("double")
    return t * (K1 + 1) / (t + K1 * (1 - B + B * dl / avgdl))


def auto_nlist(n: int) -> int:
    """Lists for n vectors: a power of two near n / 8192, between 16 and 1024."""
    return int(min(max(2 ** round(math.log2(max(n, 1) / 8192)), 16), 1024))


def rescore_depth(n: int, total: int, bits: int = 4) -> int:
    """How many quantised hits are ranked again exactly for n results."""
    floor = 50 if bits == 4 else 200
    return max(1, min(max(floor, 2 * n), 2000, total))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)
