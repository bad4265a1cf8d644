"""Hybrid ranking: two ranked legs (qid, id, score, rank) become one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.scalars import RRF

#: Depth to which legs are searched for k results.
LEG_DEPTH = 100


def depth(k: int) -> int:
    return max(LEG_DEPTH, k)


def _both(vector: DataFrame, text: DataFrame) -> DataFrame:
    v = vector.select("qid", "id", F.col("rank").alias("vrank"), F.col("score").alias("vscore"))
    t = text.select("qid", "id", F.col("rank").alias("trank"), F.col("score").alias("tscore"))
    return v.join(t, ["qid", "id"], "full_outer")


def _first_seen(fused: DataFrame, k: int) -> DataFrame:
    """Best first; equal scores in the order of the vector leg, then of the text leg."""
    w = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), F.col("vrank").asc_nulls_last(), F.col("trank").asc_nulls_last())
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "id", "score", "rank")


def reciprocal_rank(vector: DataFrame, text: DataFrame, k: int = 10) -> DataFrame:
    """Sum of 1 / (60 + rank) over the legs that found the record. An empty leg adds nothing."""
    one = F.lit(1.0)
    score = F.coalesce(one / (F.lit(RRF) + F.col("vrank")), F.lit(0.0)) + F.coalesce(one / (F.lit(RRF) + F.col("trank")), F.lit(0.0))
    return _first_seen(_both(vector, text).withColumn("score", score), k)


def normalised(leg: DataFrame) -> DataFrame:
    """Scores brought to 0..1 between the leg's least and greatest; equal scores are 1."""
    w = Window.partitionBy("qid")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return leg.withColumn("lo", lo).withColumn("hi", hi).withColumn("score", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)).drop("lo", "hi")


def relative(vector: DataFrame, text: DataFrame, alpha: float = 0.5, k: int = 10) -> DataFrame:
    """alpha times the normalised vector score plus the rest times that of the text; a leg of weight 0 is left out."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    v, t = normalised(vector), normalised(text)
    if alpha == 0:
        v = v.limit(0)
    if alpha == 1:
        t = t.limit(0)
    score = F.lit(float(alpha)) * F.coalesce("vscore", F.lit(0.0)) + F.lit(1.0 - alpha) * F.coalesce("tscore", F.lit(0.0))
    return _first_seen(_both(v, t).withColumn("score", score), k)
