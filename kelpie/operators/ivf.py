"""Vector lists around centroids: training, assignment, probing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.runs import best_of_rows
from kelpie.functions.scalars import auto_nlist
from kelpie.functions.vectors import cosine, usable
from kelpie.operators.vector import MOST_IDS_SENT, QUERY_BYTES, ranked, top_k

#: Vectors the centroids are trained on (a bound on the driver's work), rounds, default lists probed by a query.
TRAIN_SAMPLE, ROUNDS, NPROBE = 65_536, 8, 16
LEAST_VECTORS, LEAST_PER_LIST = 1024, 8


class NotEnoughVectors(ValueError):
    pass


def sample(vectors: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n vectors at random, all where there are fewer; the same ones for a seed, wherever the rows lie."""
    return vectors.orderBy(F.md5(F.concat_ws("/", F.lit(seed), F.col("id"))), "id").limit(n)


def train(vectors: DataFrame, nlist: int | None = None, dim: int = 64, seed: int = 0, least: int = LEAST_VECTORS) -> np.ndarray:
    """Unit centroids by ROUNDS of Lloyd's algorithm on a sample; NotEnoughVectors below the least numbers."""
    n = vectors.count()
    nlist = nlist or auto_nlist(n)
    if n < max(least, 1) or n < LEAST_PER_LIST * nlist:
        raise NotEnoughVectors(f"{n} vectors are too few for {nlist} lists")
    x = np.array(sample(vectors, TRAIN_SAMPLE, seed).select("vec").toArrow().column("vec").to_pylist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x[np.random.default_rng(seed).choice(len(x), nlist, replace=False)].copy()
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), c)  # an empty list keeps its centroid
    return c


def centroid_table(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    spark = vectors.sparkSession
    return spark.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(centroids)], "list_id int, centroid array<double>")


def assign(vectors: DataFrame, centroids: np.ndarray, dim: int = 64) -> DataFrame:
    """(id, list_id, vec): each vector in the list of its nearest centroid (at most 4096 of them go to each task)."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.argmax(x @ shared.value.T, 1).astype(np.int32)), b.column(1)], names=["id", "list_id", "vec"])

    rows = vectors.where(usable(F.col("vec"), dim)).select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, "id bigint, list_id int, vec array<double>")


def probed(queries: DataFrame, centroids: DataFrame, nprobe: int = NPROBE) -> DataFrame:
    """(qid, list_id): the nprobe nearest centroids of each query, all where there are fewer."""
    scored = queries.select("qid", "vec").crossJoin(F.broadcast(centroids)).select("qid", "list_id", cosine(F.col("vec"), F.col("centroid")).alias("score"))
    return ranked(scored, nprobe, F.col("list_id").asc()).select("qid", "list_id")


def search(queries: DataFrame, lists: DataFrame, centroids: DataFrame, k: int = 10, nprobe: int = NPROBE, allowed: DataFrame | None = None, dim: int = 64) -> DataFrame:
    """(qid, id, score, rank) within the probed lists.

    Queries and their lists go to every task in blocks of bounded size; vectors are never shuffled, and of a table that
    is written by list only the probed partitions are read. With nprobe at the number of lists it is the exact search.
    """
    asks = queries.where(usable(F.col("vec"), dim)).select("qid", F.col("vec").cast("array<double>").alias("vec")).dropDuplicates(["qid"])
    wanted = probed(asks, centroids, nprobe)
    rows = lists if allowed is None else lists.join(allowed.select("id").distinct(), "id", "left_semi")
    blocks = max(1, -(-asks.count() * (8 * dim + 8 * nprobe) // QUERY_BYTES))
    out = None
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block
        found = _probe_block(asks.where(mine), wanted.where(mine), rows, k, dim)
        out = found if out is None else out.unionByName(found)
    return ranked(out, k, F.col("id").asc())


def _probe_block(queries: DataFrame, wanted: DataFrame, lists: DataFrame, k: int, dim: int) -> DataFrame:
    """(qid, id, score): the k best of each task, by one product for each list in a batch and the queries that probe it."""
    got = queries.orderBy("qid").toArrow()
    qids = got.column("qid").to_numpy().astype(np.int64)
    q = np.array(got.column("vec").to_pylist(), np.float64).reshape(-1, dim)
    q = q / np.linalg.norm(q, axis=1, keepdims=True) if len(q) else q
    probes = wanted.toArrow()
    by_list: dict[int, list[int]] = {}
    for place, one in zip(np.searchsorted(qids, probes.column("qid").to_numpy()), probes.column("list_id").to_pylist()):
        by_list.setdefault(one, []).append(int(place))
    shared = queries.sparkSession.sparkContext.broadcast((qids, q, {one: np.array(sorted(p)) for one, p in by_list.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, by_list = shared.value
        best_s, best_i = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        for batch in batches:
            ids, of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            for one in np.unique(of):
                asking, rows = by_list.get(int(one)), np.flatnonzero(of == one)
                if asking is None:
                    continue
                s, i = best_of_rows(q[asking] @ x[rows].T, ids[rows], k)
                best_s[asking], best_i[asking] = best_of_rows(np.concatenate([best_s[asking], s], 1), np.concatenate([best_i[asking], i], 1), k)
        row, place = np.nonzero(np.isfinite(best_s))
        yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(best_i[row, place]), pa.array(best_s[row, place])], names=["qid", "id", "score"])

    some = lists.where(F.col("list_id").isin(sorted(by_list))) if len(by_list) <= 4096 else lists
    return some.select(F.col("id").cast("bigint"), "list_id", F.col("vec").cast("array<double>")).mapInArrow(run, "qid bigint, id bigint, score double").distinct()


def search_few(queries: DataFrame, lists: DataFrame, allowed: DataFrame, k: int = 10, dim: int = 64) -> DataFrame:
    """Search among few allowed ids: exactly, in the lists that own them; all ids are too many beyond MOST_IDS_SENT."""
    few = allowed.select(F.col("id").cast("bigint").alias("id")).limit(MOST_IDS_SENT + 1).toArrow()
    if few.num_rows > MOST_IDS_SENT:
        raise ValueError(f"more than {MOST_IDS_SENT} ids")
    return top_k(queries, lists.select("id", "vec"), k, dim, only=np.unique(few.column("id").drop_null().to_numpy()))


def missing(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Records without a vector."""
    return records.join(vectors.select("id"), "id", "left_anti")


def ghosts(lists: DataFrame, records: DataFrame) -> DataFrame:
    """Indexed ids that no record has any more."""
    return lists.select("id").distinct().join(records.select("id"), "id", "left_anti")
