"""Evaluation passages that stand, whole or in part, in training texts.

1. *Seeds.* Every run of consecutive words that counts as a leak holds several word n-grams of the item. Each document
   sends its n-grams that any item has (found through a table of bits of fixed size); their document frequencies decide
   which n-gram of every possible leak run is its seed: the rarest. A document is a candidate for an item if it has one
   of the item's seeds. No leak run is without a seed, so none is lost, and stock phrases seed nothing.
2. *Alignment.* Around each seed the document is aligned with the item by Smith-Waterman over words, many windows at a
   time. A window reaches as far as an alignment through the seed can, so a long document costs no more than its
   windows. The score tells edited and paraphrased copies; the same recurrence, without mismatches or gaps, gives the
   longest exact run.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm.words import WordHashes, mixed, runs_of
from kelpie.session import written

#: Words in a run that counts as a leak, and in a seed; letters or digits for texts in Chinese.
RUN, SEED = 12, 4
RUN_ZH, SEED_ZH = 24, 8
#: Bits of the table of the items' n-grams: 1 MB for any number of items.
BITS = 1 << 23
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
#: Cells of a row of the alignment matrices worked on at once.
CELLS = 100_000
#: The share of the whole item's score from which a document counts as holding an edited copy.
EDITED = 0.6

_INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠㅤﾠ︀-️]")
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_SIGN = regex.compile(r"[\p{L}\p{N}]")
_HAN = regex.compile(r"\p{Han}")
_BY_SIGN = np.uint64(0x5851F42D4C957F2D)


def plain(text: str) -> str:
    """Without invisible characters, composed and case-folded."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text))
        return unicodedata.normalize("NFC", text.casefold())
    return text.lower()


def words_of(text: str, known: WordHashes) -> np.ndarray:
    """Hashes of the words of a plain text: runs of letters and digits (with their combining marks)."""
    return known.of(_WORD.findall(text))


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """Of every code point, whether it is a letter or digit."""
    out = np.zeros(0x110000, bool)
    whole = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out[[ord(c) for c in _SIGN.findall(whole)]] = True
    return out


def signs_of(text: str) -> np.ndarray:
    """Hashes of the single letters and digits of a plain text, apart from those of words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points[_signs()[points]].astype(np.uint64)
    with np.errstate(over="ignore"):
        return mixed(points * _BY_SIGN + np.uint64(1))


def is_by_sign(lang: str | None) -> bool:
    return lang is not None and lang.strip().lower() == "zh"


def _items(items: DataFrame) -> DataFrame:
    """(item_id, v, text, lang): the items that take part; v tells the texts of one item_id apart."""
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text", "lang")
    return rows.withColumn("v", F.xxhash64("text", "lang")).distinct()


def item_ngrams(items: DataFrame, short: bool = False) -> DataFrame:
    """(item_id, v, run, h, m, bare): the n-grams of each possible leak run of each item; run is its place, m the item's length.

    bare says that the run is by letters and has no Chinese character. With ``short``, an item shorter than a leak run
    is itself a run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for i, v, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                zh, text = is_by_sign(lang), plain(text)
                t, n, m = (signs_of(text), SEED_ZH, RUN_ZH) if zh else (words_of(text, known), SEED, RUN)
                m = min(m, len(t)) if short else m
                han = np.array([bool(_HAN.match(c)) for c in _SIGN.findall(text)]) if zh else None
                grams = runs_of(t, n)
                for at in range(len(t) - m + 1):
                    own = grams[at : at + m - n + 1]
                    bare = zh and not han[at : at + m].any()
                    for column, x in zip(out, (i, v, at, None, len(t), bare)):
                        column.append(own.view(np.int64) if x is None else np.full(len(own), x))
            if out[0]:
                kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k)) for x, k in zip(out, kinds)], names=["item_id", "v", "run", "h", "m", "bare"])

    return _items(items).select("item_id", "v", "text", "lang").mapInArrow(run, "item_id bigint, v bigint, run bigint, h bigint, m int, bare boolean")


def _bit_table(ngrams: DataFrame) -> np.ndarray:
    """One bit for each of BITS places, set where an item has an n-gram; the driver gets places, BITS at most."""
    places = ngrams.select(F.pmod("h", F.lit(BITS)).cast("int").alias("p")).distinct().toArrow().column("p").to_numpy()
    table = np.zeros(BITS // 8, np.uint8)
    np.bitwise_or.at(table, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return table


def document_hits(documents: DataFrame, ngrams: DataFrame) -> DataFrame:
    """(doc_id, h): the distinct n-grams of each document that some item may have.

    Documents without any Chinese character send n-grams of letters only where some item has a run without any.
    """
    bare = ngrams.agg(F.max("bare")).first()[0]
    table = documents.sparkSession.sparkContext.broadcast(_bit_table(ngrams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = WordHashes(), table.value

        def hit(h: np.ndarray) -> np.ndarray:
            p = h.view(np.int64) % BITS
            return h[(bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]

        for batch in batches:
            ids, hs = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = plain(text)
                found = hit(runs_of(words_of(text, known), SEED))
                if bare or not text.isascii() and _HAN.search(text):
                    found = np.concatenate([found, hit(runs_of(signs_of(text), SEED_ZH))])
                if len(found):
                    found = np.unique(found)
                    ids.append(np.full(len(found), i))
                    hs.append(found.view(np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids).astype(np.int64)), pa.array(np.concatenate(hs))], names=["doc_id", "h"])

    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(run, "doc_id bigint, h bigint")


def candidates(documents: DataFrame, items: DataFrame, edited: bool = False) -> DataFrame:
    """(doc_id, item_id, v, h, m): the seeds of items that documents hold.

    A run that has an n-gram which no document has is in none: it needs no seed. An edited copy may have lost the rarest
    n-gram of every run, so with ``edited`` each n-gram of the item is a seed.
    """
    ngrams = written(item_ngrams(items, edited), "item-ngrams")
    hits = written(document_hits(documents, ngrams), "ngram-hits")
    seeds = ngrams
    if not edited:
        df = hits.groupBy("h").agg(F.count("*").alias("df"))
        rarest = Window.partitionBy("item_id", "v", "run").orderBy("df", "h")
        seeds = ngrams.join(df, "h", "left").na.fill(0, ["df"]).withColumn("r", F.row_number().over(rarest)).where("r = 1 and df > 0")
    return hits.join(seeds.select("item_id", "v", "h", "m").distinct(), "h").select("doc_id", "item_id", "v", "h", "m").distinct()


def windows(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, item_id, v, tokens): the parts of candidate documents that an alignment through a seed can reach.

    Each candidate document is read and cut into words once, whatever the number of its items; only its windows, as word
    hashes, go on. Before and after a seed an alignment with a positive score spans at most three times the item.
    """
    seeds = found.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "v", "h", "m")).alias("seeds"))
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for k in range(batch.num_rows):
                text = plain(batch.column(1)[k].as_py())
                places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                wanted = batch.column(2)[k].as_py()
                hs = np.unique(np.array([s["h"] for s in wanted], np.int64).view(np.uint64))
                for cut, n in ((lambda x: words_of(x, known), SEED), (signs_of, SEED_ZH)):
                    if len(places) == len(hs):
                        break
                    tokens = cut(text)
                    grams = runs_of(tokens, n)
                    at = np.flatnonzero(np.isin(grams, hs))
                    for h in np.unique(grams[at]):
                        places[int(h.view(np.int64))] = (tokens, at[grams[at] == h])
                spans: dict[tuple[int, int], list] = {}
                for s in wanted:
                    tokens, at = places[s["h"]]
                    reach = 3 * s["m"]
                    spans.setdefault((s["item_id"], s["v"]), [tokens]).extend((max(0, p - reach), min(len(tokens), p + reach + SEED_ZH)) for p in at.tolist())
                ids, vs, out = [], [], []
                for (item, v), (tokens, *own) in spans.items():
                    own.sort()
                    a, b = own[0]
                    for x, y in (*own[1:], (len(tokens) + 1, 0)):
                        if x <= b:
                            b = max(b, y)
                        else:
                            ids.append(item), vs.append(v), out.append(tokens[a:b].tobytes())
                            a, b = x, y
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(vs, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "item_id", "v", "tokens"])

    return docs.join(seeds, "doc_id").mapInArrow(run, "doc_id bigint, item_id bigint, v bigint, tokens binary")


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, longest exact run) of pairs (item, document), all padded to the longest of the list.

    One row of the matrices a step, over all pairs; a gap's chain within a row is a running maximum.
    """
    m, w = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    a, b = np.zeros((len(pairs), m), np.uint64), np.zeros((len(pairs), w), np.uint64)
    real_a, real_b = np.zeros((len(pairs), m), bool), np.zeros((len(pairs), w), bool)
    for k, (x, y) in enumerate(pairs):
        a[k, : len(x)], b[k, : len(y)] = x, y
        real_a[k, : len(x)], real_b[k, : len(y)] = True, True
    h = np.zeros((len(pairs), w + 1), np.float32)
    run = np.zeros((len(pairs), w + 1), np.int32)
    best, longest = np.zeros(len(pairs), np.float32), np.zeros(len(pairs), np.int32)
    slope = np.arange(w + 1, dtype=np.float32) * GAP
    for i in range(m):
        equal = (b == a[:, i : i + 1]) & real_b & real_a[:, i : i + 1]
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(h[:, :-1] + np.where(equal, np.float32(MATCH), np.float32(MISMATCH)), h[:, 1:] + np.float32(GAP))
        np.maximum(new, 0, out=new)
        h = np.maximum(np.maximum.accumulate(new - slope, axis=1) + slope, 0)
        run[:, 1:] = np.where(equal, run[:, :-1] + 1, 0)
        run[:, 0] = 0
        np.maximum(best, h.max(1), out=best)
        np.maximum(longest, run.max(1), out=longest)
    return best, longest


def aligned(documents: DataFrame, items: DataFrame, edited: bool = False) -> DataFrame:
    """(doc_id, item_id, score, share, longest_run, needed): how much of an item each candidate document holds.

    score is the best Smith-Waterman score over words (letters and digits for Chinese items) through a seed, share the
    score as part of that of the whole item, longest_run the most consecutive words in common, needed how many count as
    a leak. Null texts and ids take no part, empty ones have no runs. Repeated rows count once (an item given with two
    texts is aligned with each). Items shorter than a leak run have candidates only with ``edited``, and none below the
    length of a seed.
    """
    parts = windows(documents, candidates(documents, items, edited))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            langs = batch.column(3).to_pylist()
            own = [signs_of(plain(x)) if is_by_sign(lang) else words_of(plain(x), known) for x, lang in zip(batch.column(2).to_pylist(), langs)]
            needed = [RUN_ZH if is_by_sign(x) else RUN for x in langs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(needed, pa.int32())], names=["item_id", "v", "item", "needed"])

    own = _items(items).select("item_id", "v", "text", "lang").mapInArrow(cut, "item_id bigint, v bigint, item binary, needed int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())]
            order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
            score, longest = np.zeros(len(pairs), np.float32), np.zeros(len(pairs), np.int32)
            at = 0
            while at < len(order):
                n = 1
                while at + n < len(order) and (n + 1) * len(pairs[order[at + n]][1]) < CELLS:
                    n += 1
                part = order[at : at + n]
                score[part], longest[part] = align([pairs[k] for k in part])
                at += n
            whole = np.array([max(1.0, MATCH * len(a)) for a, _ in pairs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score.astype(np.float64)), pa.array(score / whole), pa.array(longest), batch.column(4)],
                names=["doc_id", "item_id", "score", "share", "longest_run", "needed"],
            )

    joined = parts.join(own, ["item_id", "v"]).select("doc_id", "item_id", "tokens", "item", "needed")
    scored = joined.mapInArrow(run, "doc_id bigint, item_id bigint, score double, share double, longest_run int, needed int")
    return scored.groupBy("doc_id", "item_id", "needed").agg(F.max("score").alias("score"), F.max("share").alias("share"), F.max("longest_run").alias("longest_run"))


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document holds as many consecutive words of the item as count as a leak."""
    return aligned(documents, items).where("longest_run >= needed").select("doc_id", "item_id").distinct()


def edited_copies(documents: DataFrame, items: DataFrame, share: float = EDITED) -> DataFrame:
    """(doc_id, item_id, score, share, longest_run): documents whose alignment with an item reaches a share of its whole score.

    Exact, edited and partly reworded copies alike, also of items shorter than a leak run; a copy without SEED words in
    a row that the item has isn't found.
    """
    found = aligned(documents, items, edited=True).where(F.col("share") >= share)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("share"), F.desc("longest_run"))
    return found.withColumn("r", F.row_number().over(best)).where("r = 1").select("doc_id", "item_id", "score", "share", "longest_run")
