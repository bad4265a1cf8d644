"""Vector retrieval: exact cosine top-k of a batch of queries, by matrix products over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.runs import best_of_rows, improve
from kelpie.functions.scalars import rescore_depth
from kelpie.functions.vectors import usable

#: Bytes of query vectors that go to every task at once; more queries are taken in blocks of this size.
QUERY_BYTES = 32 << 20
#: Queries and vectors multiplied at once in a task: 512 x 4096 x 8 bytes, a few copies of it at most.
TILE_QUERIES, TILE_ROWS = 512, 4096
#: Ids of allowed records that are sent to every task, 8 bytes each; more are joined.
MOST_IDS_SENT = 1 << 20


def ranked(scored: DataFrame, k: int, *ties: Column, partition: str = "qid", score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank: by score rounded to 9 decimals, then the tie columns.

    The rank filter becomes a partial group limit before the shuffle, so a query never gathers more than k rows a task.
    """
    w = Window.partitionBy(partition).orderBy(F.round(score, 9).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unit_rows(vectors: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """(id, vec) of usable vectors, each id once (of several vectors the first in array order)."""
    return vectors.where(usable(F.col(vec), dim) & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(vec).cast("array<double>").alias("vec"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, dim: int = 64, but_itself: bool = False, only: np.ndarray | None = None) -> DataFrame:
    """(qid, id, score, rank): the k vectors of greatest cosine to each query; ties by smaller id.

    ``queries`` (qid, vec) and ``vectors`` (id, vec). Every task multiplies its vectors with a block of queries and
    passes on its own k best, then a window merges them. The block's bytes are bounded; further queries make further
    blocks, each a scan of its own. Unusable vectors (null, wrong length, non-finite, zero) take part on neither side.
    ``but_itself`` leaves out hits with id = qid, ``only`` (sorted ids) allows no others. No queries or no vectors: no rows.
    """
    rows = queries.where(usable(F.col("vec"), dim)).select("qid", F.col("vec").cast("array<double>").alias("vec")).dropDuplicates(["qid"])
    per_block = max(1, QUERY_BYTES // (8 * dim + 8 + 16 * k))  # a query, and its k best in every task
    got = rows.limit(per_block + 1).toArrow()
    blocks = 1 if got.num_rows <= per_block else -(-rows.count() // per_block)
    out = None
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).toArrow() if blocks > 1 else got
        scored = _block_scores(part, vectors, k, dim, but_itself, only)
        out = scored if out is None else out.unionByName(scored)
    return ranked(out, k, F.col("id").asc())


def _block_scores(queries: pa.Table, vectors: DataFrame, k: int, dim: int, but_itself: bool, only: np.ndarray | None) -> DataFrame:
    got = queries.sort_by("qid")
    qids = got.column("qid").to_numpy().astype(np.int64)
    q = np.array(got.column("vec").to_pylist(), np.float64).reshape(-1, dim)
    q = q / np.linalg.norm(q, axis=1, keepdims=True) if len(q) else q
    shared = vectors.sparkSession.sparkContext.broadcast((qids, q, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, only = shared.value
        best_s, best_i = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            if only is not None:
                ids = batch.column(0).to_numpy()
                at = np.minimum(np.searchsorted(only, ids), max(0, len(only) - 1))
                batch = batch.filter(pa.array(only[at] == ids if len(only) else np.zeros(len(ids), bool)))
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            for at, to in product(range(0, len(q), TILE_QUERIES), range(0, len(x), TILE_ROWS)):
                own_s, own_i, own = best_s[at : at + TILE_QUERIES], best_i[at : at + TILE_QUERIES], ids[to : to + TILE_ROWS]
                s = q[at : at + TILE_QUERIES] @ x[to : to + TILE_ROWS].T
                if but_itself:
                    s[qids[at : at + TILE_QUERIES, None] == own[None, :]] = -np.inf
                row, column = np.nonzero(s >= own_s[:, -1:] - 2e-9)  # what may enter the k best
                if len(row) < s.size // 8:
                    improve(own_s, own_i, row, s[row, column], own[column])
                else:
                    s, i = best_of_rows(s, own, k)
                    own_s[:], own_i[:] = best_of_rows(np.concatenate([own_s, s], 1), np.concatenate([own_i, i], 1), k)
        row, place = np.nonzero(np.isfinite(best_s))
        yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(best_i[row, place]), pa.array(best_s[row, place])], names=["qid", "id", "score"])

    usable_rows = vectors.where(usable(F.col("vec"), dim)).select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    return usable_rows.mapInArrow(run, "qid bigint, id bigint, score double").repartition("qid").distinct()  # the one shuffle serves the ranking too


def search(queries: DataFrame, records: DataFrame, vecs: DataFrame, k: int = 10, scope: Column | None = None, dim: int = 64) -> DataFrame:
    """Vector search among the records that a condition allows; records without a usable vector are never hits.

    MOST_IDS_SENT allowed ids at most are sent to every task, so vectors stay where they lie; more meet the vectors in a
    join by id. Repeated records count once.
    """
    if scope is None:
        return top_k(queries, vecs, k, dim)
    allowed = records.where(scope).select(F.col("id").cast("bigint").alias("id"))
    few = allowed.limit(MOST_IDS_SENT + 1).toArrow()
    if few.num_rows <= MOST_IDS_SENT:
        return top_k(queries, vecs, k, dim, only=np.unique(few.column("id").drop_null().to_numpy()))
    return top_k(queries, vecs.join(allowed, "id", "left_semi"), k, dim)


def quantised_search(queries: DataFrame, vecs: DataFrame, k: int = 10, dim: int = 64, bits: int = 4, depth: int | None = None) -> DataFrame:
    """Search over scalar-quantised codes: ``depth`` hits by the codes, ranked again by the stored vectors.

    Without a depth it is that of the formula for k and the bits.
    """
    from kelpie.functions.vectors import quantised

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            codes, low, step = quantised(x / np.linalg.norm(x, axis=1, keepdims=True), bits)
            y = (low + step * codes).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["id", "vec"])

    rows = vecs.where(usable(F.col("vec"), dim)).select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec")).dropDuplicates(["id"])
    depth = rescore_depth(k, 2**31, bits) if depth is None else depth
    rough = top_k(queries, rows.mapInArrow(coded, "id bigint, vec array<double>"), depth, dim).select("qid", "id")
    from kelpie.functions.vectors import cosine

    exact = rough.join(rows, "id").join(queries.select("qid", F.col("vec").alias("qvec")), "qid")
    return ranked(exact.select("qid", "id", cosine(F.col("qvec"), F.col("vec")).alias("score")), k, F.col("id").asc())
