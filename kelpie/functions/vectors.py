"""Vector arithmetic on arrays, JVM-side for single rows and in matrices for batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def usable(vec: Column, dim: int) -> Column:
    """``dim`` finite numbers, not all zero; false for null."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def l2norm(vec: Column) -> Column:
    """The unit vector in double precision; a zero vector raises, null stays null."""
    size = norm(vec)
    return F.when(vec.isNull(), F.lit(None)).otherwise(
        F.when(size > 0, F.transform(vec, lambda x: x.cast("double") / size)).otherwise(F.raise_error(F.lit("a zero vector has no direction")))
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


@pandas_udf(ArrayType(FloatType()))
def fp16(vec: pd.Series) -> pd.Series:
    """Each number rounded to half precision, then the vector brought to unit length (length at least 1e-12)."""

    return pd.Series(_halves(vec.tolist()), dtype=object)


def _halves(rows: list) -> list:
    """Matrix arithmetic over all rows of one length at once; null stays null."""
    out: list = [None] * len(rows)
    by_length: dict[int, list[int]] = {}
    for k, v in enumerate(rows):
        if v is not None:
            by_length.setdefault(len(v), []).append(k)
    for at in by_length.values():
        x = np.array([rows[k] for k in at], np.float32).astype(np.float16).astype(np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-12))
        for k, v in zip(at, x):
            out[k] = v
    return out


def quantised(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, low, step) of unit vectors: ``bits`` a coordinate between the vector's own least and greatest coordinate."""
    low = x.min(1, keepdims=True)
    step = np.maximum((x.max(1, keepdims=True) - low) / ((1 << bits) - 1), 1e-12)
    return np.rint((x - low) / step).astype(np.uint8), low, step


def quantize(bits: int):
    """A UDF vec -> binary: two float32 (low, step), then the codes packed ``8 // bits`` to a byte. Null stays null."""

    @pandas_udf(BinaryType())
    def run(vec: pd.Series) -> pd.Series:
        def one(v):
            codes, low, step = quantised(np.asarray(v, np.float32)[None], bits)
            per = 8 // bits
            padded = np.pad(codes[0], (0, -len(codes[0]) % per)).reshape(-1, per)
            return np.array([low[0, 0], step[0, 0]], np.float32).tobytes() + (padded << (np.arange(per) * bits)).sum(1).astype(np.uint8).tobytes()

        return vec.map(one, na_action="ignore")

    return run


def dequantised(code: bytes, bits: int, dim: int) -> np.ndarray:
    low, step = np.frombuffer(code[:8], np.float32)
    packed = np.frombuffer(code[8:], np.uint8)
    per = 8 // bits
    return low + step * ((packed[:, None] >> (np.arange(per) * bits)) & ((1 << bits) - 1)).ravel()[:dim]
