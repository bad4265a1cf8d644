"""Folding, tokens and trigrams of texts."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

_TOKEN = re.compile(r"[^\W_]+")
#: Most distinct trigrams a task holds before it passes its counts on; only memory depends on it.
HELD = 200_000


def folded(text: str) -> str:
    """Lower case, compatibility-decomposed, without combining marks: ``café`` and ``CAFE`` fold alike."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def fold_tokens(text: str | None) -> list[str]:
    """Runs of letters and digits of the folded text; the underscore separates. Null and empty give none."""
    return _TOKEN.findall(folded(text)) if text else []


@pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """The folded text; null stays null."""
    return text.map(folded, na_action="ignore")


@pandas_udf(ArrayType(StringType()))
def tokens(text: pd.Series) -> pd.Series:
    """The folded tokens in order, with repetitions; an empty list for null."""
    return pd.Series([fold_tokens(x) for x in text], dtype=object)


@pandas_udf(ArrayType(StringType()))
def raw_words(text: pd.Series) -> pd.Series:
    """The runs of letters, digits and underscores as they stand, with repetitions; an empty list for null."""
    return pd.Series([re.findall(r"\w+", x) if x else [] for x in text], dtype=object)


def ascii_lower(c: Column) -> Column:
    """Lower case of the letters A to Z only, as the metadata filters compare."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trigrams(c: Column) -> Column:
    """All windows of three characters of the lower-cased text; none for null and shorter texts."""
    low = F.lower(F.coalesce(c, F.lit("")))
    n = F.length(low)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def trigram_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): how often each trigram stands in all texts; counted within each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])
            held.clear()
            return out

        for batch in batches:
            for low in batch.column(0).to_pylist():
                held.update([low[i : i + 3] for i in range(len(low) - 2)])
                if len(held) > HELD:
                    yield flush()
        yield flush()

    low = rows.select(F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    return low.mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def substring_count(c: Column, token: Column) -> Column:
    """Overlapping occurrences of the token in the lower-cased text; tokens under three characters never match."""
    low, t = F.lower(F.coalesce(c, F.lit(""))), F.lower(token)
    n, m = F.length(low), F.length(t)
    at = F.when((n >= m) & (m >= 3), F.sequence(F.lit(1), n - m + 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.contains(low, t), F.size(F.filter(at, lambda i: F.substr(low, i, m) == t))).otherwise(0)


def bm25_text(text: Column, suffix: Column) -> Column:
    """The text that is ranked: the record's text and the suffix of its metadata keys."""
    return F.concat(F.coalesce(text, F.lit("")), F.coalesce(suffix, F.lit("")))
