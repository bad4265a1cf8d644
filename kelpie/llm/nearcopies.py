"""Near copies: pairs of texts that share enough of their word triples, found without comparing all pairs.

1. *Blocking without loss.* Two sets of triples A, B with a Jaccard similarity of at least s share at least
   s / (1 + s) (|A| + |B|) triples. So, under any total order, the first |A| - ceil(s |A|) + 1 triples of A and the
   corresponding ones of B have one in common. The order puts triples of rare words first; rarity is read from a
   tables of word and triple counts with a fixed number of buckets, filled from all texts.
2. *Pivot distance tables.* The fingerprint of a set is the bit string of its triples' hashes (64 bit positions a
   triple, none shared in practice). The hash space is cut into CLASSES classes; each class, as a bit string, is a
   reference fingerprint, and the table holds each candidate text's Hamming distances to all of them (less the size of
   the class, the same for every text). By the triangle inequality two texts' distances to a reference never differ by
   more than their own Hamming distance |A xor B|, which is at most (1 - s) / (1 + s) (|A| + |B|) for a pair that is
   alike enough: a pair whose maximum coordinate difference is above that is discarded, and no true one is. The empty
   fingerprint is a reference too (its distances are the sizes), and so is every union of classes: the distances to the
   unions follow from those in the table, and the maximum difference over all 2^CLASSES of them has a closed form.
3. *Verification.* Survivors are compared by the triples themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.runs import whole_runs
from kelpie.llm.words import hashed_words, mixed, runs_of, sliced
from kelpie.session import written

#: Buckets of the count table of words, for any corpus.
WORD_BUCKETS = 1 << 18
#: Least and most buckets of the count table of triples, of a byte each; in between there are some 32 for each text.
LEAST_BUCKETS, MOST_BUCKETS = 1 << 20, 1 << 26
#: A piece of a count table that travels as one row.
PIECE = 1 << 16
#: Classes of the hash space whose unions are the references.
CLASSES = 64
#: What a text must hold to have a triple at all.
THREE_WORDS = r"(?s)[\p{L}\p{N}\p{M}](?:.*?[^\p{L}\p{N}\p{M}]+[\p{L}\p{N}\p{M}]){2}"
#: Triples that a pair must share among its first ones (l above).
SHARED = 4
#: A triple that more texts share is compared in blocks through the pivot table instead of pair by pair.
HOT = 64
#: Texts in a block of a hot triple.
BLOCK = 8192


class Triples:
    """The distinct word triples of a batch of texts: arrays by (text's place in the batch, hash), sorted by both."""

    def __init__(self, texts: list[str]):
        self.words, lengths = hashed_words([x.lower() for x in texts])
        doc = np.repeat(np.arange(len(texts)), lengths)
        t = runs_of(self.words, 3)
        inside = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.empty(0, np.int64)
        doc, t = doc[inside], t[inside]
        order = np.argsort(_keyed(doc, t, len(texts)), kind="stable")
        doc, t, at = doc[order], t[order], inside[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (doc[1:] != doc[:-1])
        self.doc, self.hash, self.at = doc[new], t[new], at[new]
        self.size = np.bincount(self.doc, minlength=len(texts))
        self.start = np.r_[0, np.cumsum(self.size)]

    def of(self, k: int) -> np.ndarray:
        return self.hash[self.start[k] : self.start[k + 1]]


def _keyed(doc: np.ndarray, x: np.ndarray, docs: int) -> np.ndarray:
    """One number that orders by the place of the text, then by as much of x as there is room for."""
    bits = np.uint64(docs.bit_length())
    return doc.astype(np.uint64) << (np.uint64(64) - bits) | x >> bits


def _word_bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def _triple_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def _add(total: np.ndarray, at: np.ndarray) -> None:
    """Counts occurrences of places, saturating."""
    at, n = np.unique(at, return_counts=True)
    total[at] = np.minimum(total[at].astype(np.int64) + n, np.iinfo(total.dtype).max).astype(total.dtype)


def count_tables(texts: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of words and of triples in all texts, by bucket of their hash; those of triples saturate at 255.

    Each task adds up its own tables and sends them in compressed pieces; pieces are added up per place, so the driver
    gets tables of bounded size, whatever the corpus.
    """
    word_pieces = WORD_BUCKETS * 8 // PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, of_triples = np.zeros(WORD_BUCKETS, np.int64), np.zeros(buckets, np.uint8)
        for part in (x for batch in batches for x in sliced(batch, 0)):
            t = Triples(part.column(0).to_pylist())
            np.add.at(of_words, _word_bucket(t.words), 1)
            _add(of_triples, _triple_bucket(t.hash, buckets))
        raw = np.concatenate([of_words.view(np.uint8), of_triples])
        pieces = [(k, zlib.compress(part.tobytes(), 1)) for k, part in enumerate(raw.reshape(-1, PIECE)) if part.any()]
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int32()), pa.array([p[1] for p in pieces], pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(counts), np.int64 if k < word_pieces else np.uint8).astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            raw = [x.tobytes() if k < word_pieces else np.minimum(x, 255).astype(np.uint8).tobytes() for k, x in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x, 1) for x in raw], pa.binary())], names=["piece", "counts"])

    schema = "piece int, counts binary"
    raw = np.zeros(WORD_BUCKETS * 8 + buckets, np.uint8)
    for row in texts.select("text").mapInArrow(run, schema).repartition("piece").mapInArrow(add, schema).toLocalIterator():
        raw[row.piece * PIECE : (row.piece + 1) * PIECE] = np.frombuffer(zlib.decompress(row.counts), np.uint8)
    return raw[: WORD_BUCKETS * 8].view(np.int64), raw[WORD_BUCKETS * 8 :]


def distances(t: np.ndarray) -> np.ndarray:
    """The table's row: Hamming distances of a set of triples to the reference fingerprints, less the references' size."""
    return len(t) - 2 * np.bincount((t & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)


def may_be_alike(a: np.ndarray, b: np.ndarray, na, nb, s: float) -> np.ndarray:
    """Row by row: the maximum coordinate difference over references and their unions is within what ``s`` allows."""
    bound = (1 - s) / (1 + s) * (na + nb) + 1e-9
    return (np.abs(a - b).max(-1) <= bound) & (unions_differ(a, b, na, nb) <= bound)


def unions_differ(a: np.ndarray, b: np.ndarray, na, nb) -> np.ndarray:
    """The maximum difference of the distances to all unions of references, which are |x| + |R| - 2 |x and R|."""
    return np.abs(np.expand_dims(na - nb, -1) - (a - b)).sum(-1) // 2


def _prefixes(texts: DataFrame, n: int, s: float, hot: int) -> DataFrame:
    """(c, g, p, h): the first triples of each text: its key, the triple, and the text's size and the triple's place in it.

    The order: triples whose bucket isn't fuller than usual come first, by the rarity of their words; then the common
    ones by their bucket's count. Where one Arrow batch holds a triple more than ``hot`` times, it sends only hot + 1
    rows to the triple's group, enough to show that it is hot; for the others g is spread and h has the triple. So no
    group is ever large.
    """
    buckets = int(np.clip(1 << (32 * n).bit_length(), LEAST_BUCKETS, MOST_BUCKETS))
    word_count, triple_count = count_tables(texts, buckets)
    usual = min(1 + round(2 * float(triple_count.mean())), np.iinfo(triple_count.dtype).max)  # where all are full, words alone order
    shared = texts.sparkSession.sparkContext.broadcast((np.log1p(word_count).astype(np.float32), np.maximum(triple_count, usual)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, common = shared.value
        for part in (x for batch in batches for x in sliced(batch, 1, 4 << 20)):
            keys, t = part.column(0).to_numpy(), Triples(part.column(1).to_pylist())
            if not len(t.hash):
                continue
            by_word = rarity[_word_bucket(t.words)]
            weight = by_word[t.at] + by_word[t.at + 1] + by_word[t.at + 2]
            # one number for both counts; equal ones stay in the order of their hashes
            rare = common[_triple_bucket(t.hash, buckets)].astype(np.uint64) << np.uint64(55) | weight.view(np.uint32).astype(np.uint64) << np.uint64(23)
            order = np.argsort(_keyed(t.doc, rare, part.num_rows), kind="stable")
            first = t.size - np.ceil(s * t.size - 1e-9).astype(np.int64) + SHARED
            rank = np.arange(len(order)) - t.start[t.doc]
            chosen = rank < first[t.doc]
            kept, rank = order[chosen], rank[chosen]
            g, c, p = (t.hash[kept] >> np.uint64(16)).view(np.int64), keys[t.doc[kept]], t.size[t.doc[kept]] << 32 | rank
            order = np.argsort(g, kind="stable")
            start = np.flatnonzero(np.r_[True, g[order][1:] != g[order][:-1]])
            spread = np.zeros(len(g), bool)
            spread[order] = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)])) > hot
            with np.errstate(over="ignore"):
                to = np.where(spread, mixed((g + c).view(np.uint64)).view(np.int64), g)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(to), pa.array(p), pa.array(g, mask=~spread)], names=["c", "g", "p", "h"])

    return texts.mapInArrow(run, "c bigint, g bigint, p bigint, h bigint")


def _grouped(prefixes: DataFrame, s: float, hot: int) -> DataFrame:
    """(a, b, n, need): pairs a < b of texts and how many of their first triples they share, of how many they need.

    A pair comes out only where what follows the triple in both texts can still hold the overlap the pair needs. That
    is so at the first SHARED triples two texts share, if they are alike enough. Of a hot triple h come rows (h, c)
    instead, with need -1 - p.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def small():
            for batch in batches:
                big = pc.or_(pc.is_valid(batch.column("h")), pc.greater(batch.column("n"), hot))
                if pc.any(big).as_py():
                    out = batch.filter(big)
                    kept.append(rows(pc.coalesce(out.column("h"), out.column("g")), out.column("c"), -1 - out.column("p").to_numpy()))
                yield batch.filter(pc.invert(big))

        for t in whole_runs(small(), ["g"]):
            g, c, p = t["g"].to_numpy(), t["c"].to_numpy(), t["p"].to_numpy()
            order = np.lexsort((c, g))
            g, c, p = g[order], c[order], p[order]
            new = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])]
            g, c, size, left = g[new], c[new], p[new] >> 32, (p[new] >> 32) - (p[new] & 0xFFFFFFFF)
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            length = np.diff(np.r_[start, len(g)])
            for n in np.unique(length[length > 1]):
                at = start[length == n]
                i, j = np.triu_indices(n, 1)
                i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                overlap = np.ceil(s / (1 + s) * (size[i] + size[j]) - 1e-9).astype(np.int64)
                need = np.minimum(overlap, SHARED)
                fits = np.minimum(left[i], left[j]) >= overlap - need + 1
                yield rows(pa.array(c[i[fits]]), pa.array(c[j[fits]]), need[fits])
            yield from kept
            kept.clear()
        yield from kept

    def rows(a, b, need):
        return pa.RecordBatch.from_arrays([a, b, pa.array(need.astype(np.int64))], names=["a", "b", "need"])

    counted = prefixes.withColumn("n", F.count("*").over(Window.partitionBy("g"))).where("n > 1 or h is not null")
    shared = counted.mapInArrow(run, "a bigint, b bigint, need bigint").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need"))
    return shared.where("n >= need")


def _rows_of_pivots(b: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(b.to_pylist()), np.int32).reshape(-1, CLASSES)


#: Pairs of a hot triple whose rows of the pivot table are compared at once.
PAIRS_AT_ONCE = 100_000


def _hot_pairs(members: DataFrame, features: DataFrame, s: float, block: int) -> DataFrame:
    """Pairs within hot triples that pass the pivot table; block against block, each couple of blocks a group of its own.

    ``members`` (h, c, p). First the distance to the empty reference and what follows the triple in both texts must
    allow the pair, then the other references.
    """
    sizes = members.groupBy("h").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = members.join(sizes, "h").join(features.select("c", "pivots"), "c").withColumn("k", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    columns = ("c", "p", "pivots")
    left = own.withColumn("other", F.explode(F.sequence(F.col("k"), F.col("blocks") - 1))).select("h", F.col("k").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), *columns)
    right = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k")))).select("h", F.col("other").alias("i"), F.col("k").alias("j"), F.lit(1).alias("side"), *columns)

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side, c, n = t["side"].to_numpy(), t["c"].to_numpy(), t["p"].to_numpy() >> 32
        rest = n - (t["p"].to_numpy() & 0xFFFFFFFF)  # triples from the hot one on
        d = _rows_of_pivots(t["pivots"])
        lo, hi = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        lo, hi = lo[np.argsort(n[lo], kind="stable")], hi[np.argsort(n[hi], kind="stable")]
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        step = max(1, PAIRS_AT_ONCE // max(1, len(hi)))
        for at in range(0, len(lo), step):
            x = lo[at : at + step]
            y = hi[np.searchsorted(n[hi], s * n[x[0]] - 1e-9) : np.searchsorted(n[hi], n[x[-1]] / s + 1e-9, "right")]
            both = n[x][:, None] + n[y][None, :]
            overlap = np.ceil(s / (1 + s) * both - 1e-9)
            fits = np.minimum(rest[x][:, None], rest[y][None, :]) >= overlap - np.minimum(overlap, SHARED) + 1
            i, j = np.nonzero(fits & (np.minimum(n[x][:, None], n[y][None, :]) >= overlap) & (c[x][:, None] != c[y][None, :]))
            x, y = x[i], y[j]
            keep = may_be_alike(d[x], d[y], n[x], n[y], s)
            out_a.append(np.minimum(c[x], c[y])[keep])
            out_b.append(np.maximum(c[x], c[y])[keep])
        return pa.table({"a": pa.array(np.concatenate(out_a)), "b": pa.array(np.concatenate(out_b))})

    return left.unionByName(right).groupBy("h", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def _features(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, n, pivots, t): of each wanted text the number of triples, the table's row and the triples themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in sliced(batch, 1)):
            t = Triples(part.column(1).to_pylist())
            sets = [t.of(k) for k in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(t.size.astype(np.int64)),
                    pa.array([distances(x).astype(np.int32).tobytes() for x in sets], pa.binary()),
                    pa.array([x.tobytes() for x in sets], pa.binary()),
                ],
                names=["c", "n", "pivots", "t"],
            )

    return texts.join(wanted, "c", "left_semi").dropDuplicates(["c"]).mapInArrow(run, "c bigint, n bigint, pivots binary, t binary")


def alike_texts(texts: DataFrame, n: int, similarity: float, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs a < b of keys c of the n different texts (c, text), whose distinct word triples have at least this Jaccard similarity."""
    grouped = written(_grouped(_prefixes(texts, n, similarity, hot), similarity, hot), "candidates")
    near = grouped.where("need > 0").select("a", "b")
    members = grouped.where("need < 0").select(F.col("a").alias("h"), F.col("b").alias("c"), (-1 - F.col("need")).alias("p"))
    wanted = near.select(F.explode(F.array("a", "b")).alias("c")).unionByName(members.select("c")).distinct()
    features = written(_features(texts, wanted), "features")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = may_be_alike(_rows_of_pivots(b.column(3)), _rows_of_pivots(b.column(5)), b.column(2).to_numpy(), b.column(4).to_numpy(), similarity)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def with_both(pairs: DataFrame, *columns: str) -> DataFrame:
        for side in ("a", "b"):
            mine = features.select(F.col("c").alias(side), *(F.col(x).alias(f"{x}_{side}") for x in columns))
            pairs = pairs.join(mine, side)
        return pairs.select("a", "b", *(f"{x}_{side}" for side in ("a", "b") for x in columns))

    survivors = with_both(near, "n", "pivots").mapInArrow(filtered, "a bigint, b bigint")
    if not members.isEmpty():
        survivors = survivors.unionByName(_hot_pairs(members, features, similarity, block)).distinct()
    return with_both(survivors, "t").mapInArrow(verified, "a bigint, b bigint")


def eligible(records: DataFrame, least_chars: int, key: str = "id", text: str = "text") -> DataFrame:
    """(id, c, text) of the rows that take part; c is the text's 64-bit hash, by which equal texts are one."""
    rows = records.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(F.col(text)).alias("c"), F.col(text).alias("text"))
    return rows.where(F.col("id").isNotNull() & (F.length("text") >= least_chars) & F.col("text").rlike(THREE_WORDS))


def near_copy_links(records: DataFrame, similarity: float = 0.5, least_chars: int = 200, key: str = "id", text: str = "text", hot: int = HOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((id, c), (a, b)): each row's class of equal texts, and the pairs a < b of classes whose texts are alike enough."""
    rows = eligible(records, least_chars, key, text)
    ids = written(rows.select("id", "c").distinct(), "memberships")
    return ids, alike_texts(rows.select("c", "text"), ids.count(), similarity, hot, block)


def near_copy_pairs(records: DataFrame, similarity: float = 0.5, least_chars: int = 200, key: str = "id", text: str = "text", hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b): pairs of different keys, smaller first, of texts that are alike enough; equal texts are alike.

    Only texts of at least ``least_chars`` code points with at least one triple of words take part; null texts and null
    keys never do. Equal texts are one class in every comparison and are expanded at the end. Repeated rows count once.
    An empty table gives no pairs. Nothing is sampled or capped.
    """
    ids, different = near_copy_links(records, similarity, least_chars, key, text, hot, block)
    equal = ids.join(ids.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c"), "c", "left_semi")
    a, b = equal.alias("a"), equal.alias("b")
    copies = a.join(b, F.col("a.c") == F.col("b.c")).where("a.id < b.id").select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    crossed = different.join(ids.select(F.col("id").alias("x"), F.col("c").alias("a")), "a").join(ids.select(F.col("id").alias("y"), F.col("c").alias("b")), "b").where("x <> y")
    return copies.unionByName(crossed.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the least node of its connected component.

    Large stars and small stars in turn: each node hands its greater neighbours, then its lesser ones, to the least one
    it knows, until nothing changes; the rounds grow with the logarithm of a component's size. Each round is a minimum
    by node and a join, written to the shared folder, so lineage stays short.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = written(small, "stars")
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if found == state:
            break
        state = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_copy_groups(records: DataFrame, similarity: float = 0.5, least_chars: int = 200, key: str = "id", text: str = "text", hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(id, group, links): one row for each row with a near copy: the least id of its group, and the number of its links.

    Two rows are linked if their texts are alike enough, or equal; a group is what links connect. Links are counted by
    classes of equal texts, so copies are never expanded. Which rows take part is as in ``near_copy_pairs``; rows
    without a link aren't listed, repeated rows count once, and an id with two texts has a row for each.
    """
    ids, different = near_copy_links(records, similarity, least_chars, key, text, hot, block)
    different = written(different, "links")
    sizes = ids.groupBy("c").agg(F.count("*").alias("n"))
    both = different.unionByName(different.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = both.join(sizes.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "c")
    roots = components(different).withColumnRenamed("node", "c")
    of = sizes.join(beyond, "c", "left").join(roots, "c", "left").select("c", F.coalesce("root", "c").alias("root"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    linked = ids.join(of.where("links > 0"), "c").select("id", "root", "links")
    least = linked.groupBy("root").agg(F.min("id").alias("group"))
    return linked.join(least, "root").select("id", "group", "links")
