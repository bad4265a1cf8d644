"""The most similar vectors of every vector, by learned partitions.

1. A bounded sample (SAMPLE vectors, chosen by hash) gets its neighbour graph; the graph is cut into balanced parts by
   recursive bisection: a median split along the principal direction, refined by exchanging the vertices which gain
   most edges (Kernighan-Lin style), so both sides stay equal.
2. A small classifier (a softmax layer on the unit vectors) learns the parts. It routes every vector of the collection
   to its most probable parts, ``PROBES`` of them at most, fewer where the first ones are certain.
   A collection too large for one level is partitioned again: each part gets a graph, parts and a classifier of its
   own, learned by a task from a sample of that part, so parts stay small and a classifier has few classes.
3. Within each part all its vectors are compared by their exact cosines, block against block, and each vector's
   nearest of all its parts are merged.

Only the partition is learned from samples; every vector is indexed and queried. Equal vectors are one vector with
several keys: the nearest of each are among the first few keys, so a vector that a third of all rows share costs no more
than another one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.session import written

#: Vectors of which one partition and its classifier are learned: a bound on the driver's and on a task's work and memory.
SAMPLE = 16_384
#: Vectors of the collection for each part, the most parts of one level, and the least sample vectors for each.
PART_SIZE, MOST_PARTS, LEAST_A_PART = 1280, 256, 16
#: Vectors that a task routes at once where a part is partitioned again.
ROUTED = 50_000
#: Most parts of a vector, and the probability at which it needs no further part.
PROBES, CERTAIN = 2, 0.97
#: Vectors in a block; a part with more is compared block against block, each couple of blocks in a task of its own.
BLOCK = 6000
#: Neighbours in the sample's graph, and rounds of refinement of a bisection.
GRAPH_K, ROUNDS = 10, 8


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row of unit vectors."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int64)
    for at in range(0, n, 2048):
        s = x[at : at + 2048] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out[at : at + len(s)] = np.argpartition(s, -k, axis=1)[:, -k:] if k else 0
    return out


def bisect(x: np.ndarray, graph: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of the vertices ``rows``, which half they are in: equal halves with few edges between them."""
    own = x[rows] - x[rows].mean(0)
    v = np.linalg.svd(own.T @ own)[0][:, 0]
    side = np.zeros(len(rows), bool)
    side[np.argsort(own @ v, kind="stable")[len(rows) // 2 :]] = True
    place = np.full(len(x), -1)
    place[rows] = np.arange(len(rows))
    a, b = np.repeat(np.arange(len(rows)), graph.shape[1]), place[graph[rows].ravel()]
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.r_[a, b], np.r_[b, a]
    for _ in range(ROUNDS):
        gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), len(rows))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        better = int(np.searchsorted(-(gain[left[:n]] + gain[right[:n]]), -1e-9))
        better = (better + 1) // 2  # neighbours that change sides together gain less than each alone
        if not better:
            break
        side[left[:better]], side[right[:better]] = True, False
    return side


def balanced_parts(x: np.ndarray, parts: int) -> np.ndarray:
    """The part of each row; ``parts`` is a power of two."""
    graph = neighbour_graph(x.astype(np.float32), GRAPH_K)
    part = np.zeros(len(x), np.int64)
    for _ in range(int(math.log2(parts))):
        halves = np.zeros(len(x), np.int64)
        for rows in np.split(np.argsort(part, kind="stable"), np.flatnonzero(np.diff(np.sort(part))) + 1):
            if len(rows) > 1:
                halves[rows] = bisect(x, graph, rows)
        part = 2 * part + halves
    return part


def fit_router(x: np.ndarray, part: np.ndarray, parts: int, epochs: int = 12, rate: float = 4.0, sharpness: float = 20.0) -> np.ndarray:
    """Weights of a softmax layer that gives the part of a unit vector; it starts from the parts' mean directions."""
    sums = np.zeros((parts, x.shape[1]))
    np.add.at(sums, part, x)
    weights = (sharpness * sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    x = x.astype(np.float32)
    order = np.random.default_rng(0)
    for epoch in range(epochs):
        shuffled = order.permutation(len(x))
        for at in range(0, len(x), 1024):
            rows = shuffled[at : at + 1024]
            p = _softmax(x[rows] @ weights.T)
            p[np.arange(len(rows)), part[rows]] -= 1
            weights -= np.float32(rate / (1 + epoch) / len(rows) * parts / 16) * (p.T @ x[rows])
    return weights


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def route(x: np.ndarray, weights: np.ndarray, probes: int = PROBES, certain: float = CERTAIN) -> tuple[np.ndarray, np.ndarray]:
    """(row, part) couples: of each row the most probable parts until they are certain enough."""
    p = _softmax(x.astype(np.float32) @ weights.T)
    k = min(probes, p.shape[1])
    best = np.argpartition(p, -k, axis=1)[:, -k:]
    q = np.take_along_axis(p, best, 1)
    order = np.argsort(-q, axis=1, kind="stable")
    best, q = np.take_along_axis(best, order, 1), np.take_along_axis(q, order, 1)
    before = np.cumsum(q, axis=1) - q
    row, place = np.nonzero(before < certain)
    return row, best[row, place]


def usable(vec: Column, dim: int) -> Column:
    """A vector counts if it has ``dim`` finite numbers, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def packed(x: np.ndarray) -> list[bytes]:
    """Each row of float32 in half precision where that loses nothing, else as it is."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    exact = (half.astype(np.float32) == x).all(1)
    return [(half[k] if exact[k] else x[k]).tobytes() for k in range(len(x))]


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim), np.float32)
    for k, b in enumerate(rows):
        out[k] = np.frombuffer(b, np.float16 if len(b) == 2 * dim else np.float32)
    return out


def identities(rows: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each coded vector."""
    return np.array([int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True) for b in rows], np.int64)


def _entries(near: bytes) -> Iterator[str]:
    """Seven digits of the distance from similarity 1, then the key: sorted as text, the nearest come first."""
    at = 0
    while at < len(near):
        end = at + 6 + int.from_bytes(near[at + 3 : at + 6], "big")
        yield f"{int.from_bytes(near[at : at + 3], 'big'):07d}{near[at + 6 : end].decode()}"
        at = end


def levels_for(n: int, part_size: int, most: int) -> list[int]:
    """How many times each level halves: together about n / part_size parts, at most ``most`` by one level."""
    bits = max(0, round(math.log2(max(1, n / part_size))))
    several = max(1, math.ceil(bits / int(math.log2(most))))
    return [bits // several + (k < bits % several) for k in range(several)]


def partition(x: np.ndarray, bits: int, n: float) -> tuple[np.ndarray, np.ndarray]:
    """(router weights, blocks by part) of a collection of n vectors, from unit vectors of it."""
    parts = 1 << bits
    while parts > 1 and len(x) < LEAST_A_PART * parts:
        parts //= 2
    weights = fit_router(x, balanced_parts(x, parts), parts)
    _, part = route(x, weights)
    expected = np.bincount(part, minlength=parts) * (n / len(x))
    return weights, np.ceil(np.maximum(expected, 1) / BLOCK).astype(np.int64)


def learned(vectors: DataFrame, n: int, bits: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(router weights, blocks by part) of the first level, from a sample of the ``n`` distinct vectors of (key, vec, h)."""
    if not n:
        return np.zeros((1, 1), np.float32), np.ones(1, np.int64)
    share = min(1.0, 1.25 * sample / n)
    low = min(2**63 - 1, -(2**63) + int(share * 2**64))
    rows = vectors.select("h", "vec").where(F.col("h") <= low).dropDuplicates(["h"]).orderBy("h").limit(sample).toArrow()
    if not rows.num_rows:
        rows = vectors.select("h", "vec").orderBy("h").limit(1).toArrow()
    return partition(unit(np.stack([np.asarray(v, np.float32) for v in rows.column("vec").to_pylist()])), bits, n)


def _placed(b: pa.RecordBatch | pa.Table, row: np.ndarray, part: np.ndarray, blocks: np.ndarray, h: np.ndarray, path: np.ndarray | int = 0) -> pa.RecordBatch:
    """Rows (part, q, i, role, enc, keys): to a part of several blocks a vector goes once for each couple of blocks it is in."""
    n = blocks[part]
    own = (h[row].astype(np.uint64) % n.astype(np.uint64)).astype(np.int64)
    one = n == 1
    at, qs, is_, roles = [np.flatnonzero(one)], [own[one]], [own[one]], [np.zeros(one.sum(), np.int64)]
    many = np.flatnonzero(~one)
    if len(many):
        rep = np.repeat(many, n[many])
        other = np.arange(len(rep)) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
        for role, q, i in ((1, own[rep], other), (2, other, own[rep])):
            at.append(rep), qs.append(q), is_.append(i), roles.append(np.full(len(rep), role))
    at = np.concatenate(at)
    out = b.take(pa.array(row[at]))
    ints = [pa.array(np.concatenate(x).astype(np.int32)) for x in (qs, is_, roles)]
    columns = [out.column(x).combine_chunks() if isinstance(out, pa.Table) else out.column(x) for x in ("enc", "keys")]
    return pa.RecordBatch.from_arrays([pa.array((path + part)[at].astype(np.int64)), *ints, *columns], names=["part", "q", "i", "role", "enc", "keys"])


_PLACED = "part bigint, q int, i int, role int, enc binary, keys array<string>"


def partitioned_again(rows: DataFrame, counts: DataFrame, bits: int, last: bool, dim: int, part_size: int, sample: int, probes: int, certain: float) -> DataFrame:
    """Each path of (path, choice, enc, keys) gets a partition of its own: rows of the next level, or placed ones at the last.

    ``counts`` (path, n) are the first choices by path. A path's partition is learned in a task from at most ``sample``
    of them, chosen by hash; at the last level it has as many parts as its size needs. Rows meet their path's classifier
    in salted groups of about ROUTED, so a large path is routed by many tasks. A second choice of the level above is
    followed to its most probable part only.
    """
    hashed = rows.where("choice = 0").join(F.broadcast(counts), "path").withColumn("u", F.xxhash64("enc"))
    low = (F.least(F.lit(1.0), F.lit(1.5) * sample / F.col("n")) * F.lit(2.0**64) - F.lit(2.0**63)).cast("double")
    nth = F.row_number().over(Window.partitionBy("path").orderBy("u", "enc"))
    chosen = hashed.where(F.col("u").cast("double") <= low).withColumn("r", nth).where(F.col("r") <= sample).select("path", "n", "enc")

    def learn(t: pa.Table) -> pa.Table:
        n = t.column("n")[0].as_py()
        own = min(max(0, round(math.log2(max(1, n / part_size)))), int(math.log2(MOST_PARTS))) if last else bits
        weights, blocks = partition(unit(unpacked(t.column("enc").to_pylist(), dim)), own, n)
        return pa.table({"path": t.column("path").slice(0, 1), "weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary()), "blocks": pa.array([blocks.tobytes()], pa.binary())})

    routers = chosen.groupBy("path").applyInArrow(learn, "path bigint, weights binary, blocks binary").join(F.broadcast(counts), "path")
    salts = F.ceil(2 * F.col("n") / ROUTED).cast("int")
    salted = rows.join(F.broadcast(counts), "path").withColumn("salt", F.pmod(F.xxhash64("enc"), salts).cast("int")).select("path", "salt", "choice", "enc", "keys")
    each = routers.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("path", "salt", "weights", "blocks")

    def follow(t: pa.Table, routers: pa.Table) -> pa.Table:
        if not t.num_rows or not routers.num_rows:
            return pa.table({c: pa.array([], k) for c, k in zip(names, kinds)})
        t = t.combine_chunks()
        path, enc = t.column("path")[0].as_py() * MOST_PARTS, t.column("enc").to_pylist()
        weights = np.frombuffer(routers.column("weights")[0].as_py(), np.float32).reshape(-1, dim)
        blocks = np.frombuffer(routers.column("blocks")[0].as_py(), np.int64)
        choice, x = t.column("choice").to_numpy(), unit(unpacked(enc, dim))
        row, part = route(x, weights, probes, certain)
        fresh = np.r_[True, row[1:] != row[:-1]]
        keep = fresh | (choice[row] == 0)
        row, part, fresh = row[keep], part[keep], fresh[keep]
        if last:
            out = _placed(t, row, part, blocks, identities(enc), path)
            return pa.Table.from_batches([out])
        to = t.take(pa.array(row))
        return pa.table({"path": pa.array(path + part), "choice": pa.array(np.where(fresh, choice[row], 1).astype(np.int32)), "enc": to.column("enc"), "keys": to.column("keys")})

    schema = _PLACED if last else "path bigint, choice int, enc binary, keys array<string>"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}[c.split()[1]] for c in schema.split(", ")]
    return salted.groupBy("path", "salt").cogroup(each.groupBy("path", "salt")).applyInArrow(follow, schema)


def nearest(vectors: DataFrame, k: int = 5, dim: int = 64, part_size: int = PART_SIZE, sample: int = SAMPLE, probes: int = PROBES, certain: float = CERTAIN) -> DataFrame:
    """(key, neighbour, similarity) of the k nearest others of every key of ``vectors`` (key string, vec array<float>).

    similarity is the cosine rounded to 6 decimals; of equal ones the smaller key in byte order is nearer. Vectors that
    don't count (null, of another length, with a null, NaN or infinite number, all zero) and null keys take no part, as
    queries or neighbours. Repeated rows count once. A key with two vectors is a neighbour through both and never its
    own. Fewer than k others in all give fewer rows; an empty table gives none. Exact within the parts a vector is
    routed to; ties are resolved by key there.
    """
    rows = vectors.select("key", "vec").where(F.col("key").isNotNull() & usable(F.col("vec"), dim)).withColumn("vec", F.col("vec").cast("array<float>")).withColumn("h", F.xxhash64("vec"))
    n, most = rows.groupBy("h").count().agg(F.count("*"), F.max("count")).first()
    levels = levels_for(n, part_size, MOST_PARTS)
    weights, blocks = learned(rows, n, levels[0], sample)
    shared = rows.sparkSession.sparkContext.broadcast((weights, blocks))
    keep = k + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed(x), pa.binary())], names=["key", "enc"])

    coded = rows.select("key", "vec").mapInArrow(pack, "key string, enc binary")
    ranked = coded.withColumn("r", F.dense_rank().over(Window.partitionBy("enc").orderBy("key")))
    distinct = ranked.where(F.col("r") <= keep).groupBy("enc").agg(F.sort_array(F.collect_set("key")).alias("keys"))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, blocks = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                b = batch.slice(at, 4000)
                enc = b.column("enc").to_pylist()
                row, part = route(unit(unpacked(enc, dim)), weights, probes, certain)
                if single:
                    yield _placed(b, row, part, blocks, identities(enc))
                else:
                    out, choice = b.take(pa.array(row)), np.r_[0, (row[1:] == row[:-1]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(choice.astype(np.int32)), out.column("enc"), out.column("keys")], names=["path", "choice", "enc", "keys"])

    single = len(levels) == 1
    placed = distinct.mapInArrow(routed, _PLACED if single else "path bigint, choice int, enc binary, keys array<string>")
    for level, bits in enumerate(levels[1:], 2):
        placed = written(placed, "routed")
        counts = placed.where("choice = 0").groupBy("path").agg(F.count("*").alias("n"))
        placed = partitioned_again(placed, counts, bits, level == len(levels), dim, part_size, sample, probes, certain)

    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        role = t.column("role").to_numpy()
        enc = t.column("enc").to_pylist()
        x, h = unit(unpacked(enc, dim)), identities(enc)
        keys = [[key.encode() for key in own] for own in t.column("keys").to_pylist()]
        queries, index = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
        small = x[index].astype(np.float32).T.copy()
        found: list[bytes] = []
        kth = min(k, len(index) - 1)
        for at in range(0, len(queries), 512):
            q = queries[at : at + 512]
            s = x[q].astype(np.float32) @ small
            s[h[q][:, None] == h[index][None, :]] = -9
            if kth > 0:
                bar = np.partition(s, -kth, axis=1)[:, -kth]
                a, b = np.nonzero((s >= bar[:, None] - 2e-6) & (s > -2))
            else:
                a, b = np.nonzero(s > -2)
            sim = 1_000_000 - np.rint(np.einsum("ij,ij->i", x[q[a]], x[index[b]]) * 1e6).astype(np.int64)
            start = np.searchsorted(a, np.arange(len(q) + 1))
            b, sim = index[b].tolist(), sim.tolist()
            for j in range(len(q)):
                near = sorted((sim[m], key) for m in range(start[j], start[j + 1]) for key in keys[b[m]])
                found.append(b"".join([max(far, 0).to_bytes(3, "big") + len(key).to_bytes(3, "big") + key for far, key in near[:k]]))
        return pa.table({"h": pa.array(h[queries]), "keys": t.column("keys").take(pa.array(queries)), "near": pa.array(found, pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [sorted({entry for part in parts for entry in _entries(part)})[:k] for parts in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.list_(pa.string()))], names=["h", "keys", "near"])

    parts = placed.groupBy("part", "q", "i").applyInArrow(search, "h bigint, keys array<string>, near binary")
    lists = parts.groupBy("h").agg(F.first("keys").alias("keys"), F.collect_list("near").alias("near"))
    merged = lists.mapInArrow(merge, "h bigint, keys array<string>, near array<string>")

    def best(key: Column, keys: Column, near: Column) -> Column:
        own = F.transform(F.filter(keys, lambda x: x != key), lambda x: F.concat(F.lit("0000000"), x))
        others = F.filter(near, lambda x: F.substring(x, 8, 2**31 - 1) != key)
        return F.slice(F.array_sort(F.array_distinct(F.concat(own, others))), 1, k)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(identities(b.column(1).to_pylist())), b.column(0)], names=["h", "key"])

    crowded = bool(n) and most > keep
    if crowded:  # some vector has more keys than were carried along: they get its neighbours too
        merged = written(merged, "neighbours")
    each = merged.select(F.explode("keys").alias("key"), "keys", "near")
    if crowded:
        beyond = merged.where(F.size("keys") > k).join(coded.mapInArrow(identify, "h bigint, key string").distinct(), "h").where(F.col("key") > F.element_at("keys", -1))
        each = each.unionByName(beyond.select("key", "keys", "near"))
    all_keys = each.select("key", F.explode(best(F.col("key"), F.col("keys"), F.col("near"))).alias("n"))
    far = F.substring("n", 1, 7).cast("int")
    return all_keys.select("key", F.substring("n", 8, 2**31 - 1).alias("neighbour"), ((1_000_000 - far) / F.lit(1e6)).alias("similarity"))


def stored_and_arriving(vecs: DataFrame, ingest: DataFrame) -> DataFrame:
    """(key, vec): stored vectors under their id in digits, arriving ones under the record's key."""
    documents = ingest.select(F.explode("documents").alias("d"))
    summaries = documents.select(F.col("d.doc_id").alias("key"), F.col("d.summary.vector").alias("vec"))
    chunks = documents.select(F.explode("d.chunks").alias("c")).select(F.col("c.id").alias("key"), F.col("c.vector").alias("vec"))
    return vecs.select(F.col("id").cast("string").alias("key"), "vec").unionByName(summaries).unionByName(chunks)


def neighbour_pairs(vecs: DataFrame, ingest: DataFrame, k: int = 5) -> DataFrame:
    """(key_a, key_b): pairs of keys, smaller first, one of which is among the k nearest of the other."""
    near = nearest(stored_and_arriving(vecs, ingest), k)
    return near.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()
