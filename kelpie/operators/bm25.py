"""Text retrieval: BM25 over an inverted index of folded tokens, for a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.runs import best_of_rows, improve
from kelpie.functions.scalars import K1, PAIR_WEIGHT, B, idf, saturation
from kelpie.functions.text import bm25_text, raw_words, tokens
from kelpie.operators.vector import ranked
from kelpie.session import written

#: Tokens of a query that count, and the pruning budget: records that kept tokens may touch, as a share and at least.
MOST_TOKENS, BUDGET_SHARE, BUDGET_LEAST = 100, 0.02, 1000
#: Queries whose weights go to the tasks at once, a triple for each term of each query: 16,384 x 100 x 20 bytes at most.
QUERIES_AT_ONCE = 16_384
#: Blocks of queries up to which each is a scan of its own; more queries meet the postings by term.
MOST_BLOCKS = 64
#: Queries of a block where given records are scored: terms x queries doubles, 100 x 192 x 192 x 8 bytes at most.
QUERIES_A_MATRIX = 192
#: Records that a task indexes at once, at first (to learn what scores the k best have) and at most.
FIRST_INDEXED, MOST_INDEXED = 1024, 32_768
#: Cells (query, record) and postings that a task holds at once.
CELLS = 2 << 20
#: Most frequent terms of which a task holds what each record has, 256 x 32,768 x 8 bytes at most.
MOST_DENSE = 256
#: Terms left to the second step: those that together can bring so much of the k-th best score.
LEFT_SHARE = 0.25
#: Distinct terms of the queries that are sent to every task, to drop other terms before the shuffle.
MOST_TERMS_SENT = 200_000
#: Records scored at once.
ROWS_AT_ONCE = 2000
#: Candidates of the first stage: ranked ones, and unranked ones that hold all tokens.
RANKED_CANDIDATES, ALL_CANDIDATES = 500, 1000


def tokenised(records: DataFrame, text: Column | None = None) -> DataFrame:
    """(id, tokens, dl): the folded tokens of each record, once; persist it where several operators read it."""
    own = records.select("id", tokens(F.col("text") if text is None else text).alias("tokens"))
    return own.withColumn("dl", F.size("tokens"))


def with_metadata(records: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens of the text and of chosen metadata keys."""
    from kelpie.functions.metadata import fts_suffix

    return tokenised(records, bm25_text(F.col("text"), fts_suffix(keys)(F.col("metadata"))))


def postings(tokenised: DataFrame) -> DataFrame:
    """(term, id, tf, dl)."""
    return tokenised.select("id", "dl", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def document_frequencies(tokenised: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(term, df), each record counted once: distinct within the row, so only one shuffle, pre-aggregated.

    ``only`` (term) restricts the terms, before the shuffle where they are few enough to be sent to every task.
    """
    rows = tokenised.select(F.explode(F.array_distinct("tokens")).alias("term"))
    if only is not None:
        few = only.select("term").distinct()
        rows = rows.join(F.broadcast(few) if few.limit(MOST_TERMS_SENT + 1).count() <= MOST_TERMS_SENT else few, "term", "left_semi")
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(tokenised: DataFrame) -> DataFrame:
    """One row (total, avgdl) over all records, those without any token included."""
    return tokenised.agg(F.count("*").alias("total"), F.avg("dl").alias("avgdl"))


def filled_stats(tokenised: DataFrame) -> DataFrame:
    """One row (total, avgdl): all records counted, but the mean length of those with tokens only."""
    return tokenised.agg(F.count("*").alias("total"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf, pos): the terms of each query (qid, qtext), how often and where first; MOST_TOKENS count."""
    own = queries.select("qid", F.posexplode(F.slice(tokens(F.col("qtext")), 1, MOST_TOKENS)).alias("pos", "term"))
    return own.groupBy("qid", "term").agg(F.count("*").alias("qtf"), F.min("pos").alias("pos"))


def single_weights(queries: DataFrame, tokenised: DataFrame) -> DataFrame:
    """(qid, term, w, avgdl): what each term of each query weighs, written once for all blocks of queries."""
    terms = written(query_terms(queries), "terms")
    stats = corpus_stats(tokenised)  # a single row
    weights = terms.join(document_frequencies(tokenised, terms), "term").join(F.broadcast(stats))
    return written(weights.select("qid", "term", (F.col("qtf") * idf(F.col("df"), F.col("total"))).alias("w"), "avgdl"), "weights")


def single_stage(queries: DataFrame, tokenised: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank) by BM25 over all records; a token the query repeats counts as often.

    N and the mean length count every record; ``allowed`` (id) restricts the hits, not the statistics. Records without
    a query token are no hits; blank and null queries have none. Ties by id.

    The weights of a block of QUERIES_AT_ONCE queries, at most MOST_TOKENS terms each, go to every task, which indexes
    its records part by part and passes on its k best (``_best_block``). Postings are never shuffled. Beyond MOST_BLOCKS
    blocks the queries' terms meet the postings in a join by term instead.
    """
    weights = single_weights(queries, tokenised)
    rows = tokenised if allowed is None else tokenised.join(allowed.select("id").distinct(), "id", "left_semi")
    blocks = _blocks_of(weights)
    if blocks > MOST_BLOCKS:
        parts = postings(rows).join(weights, "term").select("qid", "id", (F.col("w") * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("part"))
        return ranked(parts.groupBy("qid", "id").agg(F.sum("part").alias("score")).where("score > 0"), k, F.col("id").asc())
    out = None
    for got in _blocks(weights, blocks):
        found = _best_block(got, rows, k)
        out = found if out is None else out.unionByName(found)
    return ranked(out, k, F.col("id").asc())


def _best_block(weights: pa.Table, tokenised: DataFrame, k: int) -> DataFrame:
    """(qid, id, score): of each query of a block the k best of each task, scores above 0.

    ``weights`` (qid, term, w, avgdl), ``tokenised`` (id, tokens, dl). A task makes an inverted index of some records at
    a time. The terms of a query that weigh least there, and together can't bring LEFT_SHARE of the k-th best score so
    far, are left to a second step: the other terms' postings are summed up, and only records whose sum can still reach
    the k-th best get the rest looked up. No record is dropped that could be among the k best.
    """
    qids = np.unique(weights.column("qid").to_numpy().astype(np.int64)) if weights.num_rows else np.empty(0, np.int64)
    named = pc.unique(weights.column("term"))
    q_of = np.searchsorted(qids, weights.column("qid").to_numpy())
    t_of = pc.index_in(weights.column("term"), value_set=named).to_numpy().astype(np.int64)
    avgdl = (weights.column("avgdl")[0].as_py() if weights.num_rows else None) or 1.0
    shared = tokenised.sparkSession.sparkContext.broadcast((qids, named, q_of, t_of, weights.column("w").to_numpy(), avgdl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, named, q_of, t_of, w, avgdl = shared.value
        best_s, best_i = np.full((len(qids), k), -np.inf), np.zeros((len(qids), k), np.int64)

        def take(part: pa.Table) -> None:
            part = part.combine_chunks()
            n, ids, lists = part.num_rows, part.column(0).to_numpy(), part.column(1).combine_chunks()
            dl = part.column(2).to_numpy().astype(np.float64)
            term = pc.fill_null(pc.index_in(lists.flatten(), value_set=named), -1).to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            keys, tf = np.unique((term * n + doc)[term >= 0], return_counts=True)  # the postings: by term, then by record
            if not len(keys):
                return
            doc, term = keys % n, keys // n
            sat = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
            df = np.bincount(term, minlength=len(named))
            first = np.cumsum(df) - df
            dense = np.argsort(-df, kind="stable")[:MOST_DENSE]
            slot = np.full(len(named), -1)
            slot[dense] = np.arange(len(dense))
            table = np.zeros(len(dense) * n)
            frequent = slot[term] >= 0
            table[slot[term[frequent]] * n + doc[frequent]] = sat[frequent]
            most = np.zeros(len(named))
            held = np.flatnonzero(df)
            most[held] = np.maximum.reduceat(sat, first[held])
            # a query's terms, those first that can bring least
            own = np.flatnonzero(df[t_of])
            bound = w[own] * most[t_of[own]]
            order = np.lexsort((bound, q_of[own]))
            q, t, x, bound = q_of[own][order], t_of[own][order], w[own][order], bound[order]
            begin = np.searchsorted(q, np.arange(len(qids) + 1))
            total = np.r_[0.0, np.cumsum(bound)]
            least = best_s[:, -1].copy()
            left = total[1:] - total[begin[q]] < LEFT_SHARE * np.maximum(least, 0)[q] - 1e-6
            number = np.bincount(q[left], minlength=len(qids))
            rest = total[begin[:-1] + number] - total[begin[:-1]]
            summed = np.flatnonzero(~left)
            work = n + np.bincount(q[summed], df[t[summed]], len(qids)).astype(np.int64)
            tile = np.cumsum(work) // CELLS
            for a, b in zip(np.searchsorted(tile, np.unique(tile)), np.searchsorted(tile, np.unique(tile), "right")):
                mine = summed[np.searchsorted(q[summed], a) : np.searchsorted(q[summed], b)]
                many = df[t[mine]]
                at = np.repeat(first[t[mine]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                cell = np.repeat((q[mine] - a) * n, many) + doc[at]
                s = np.bincount(cell, np.repeat(x[mine], many) * sat[at], (b - a) * n).reshape(b - a, n)
                need = np.maximum(least[a:b] - rest[a:b] - 1e-6, 0)
                if n > k and not number[a:b].any():
                    need = np.maximum(need, np.partition(s, n - k, axis=1)[:, n - k] - 4e-9)
                row, column = np.nonzero(s > need[:, None])
                s, row = s[row, column], row + a
                pairs = np.cumsum(number[row]) // CELLS
                for lot in np.unique(pairs) if number[row].any() else ():
                    one = np.flatnonzero(pairs == lot)
                    many = number[row[one]]
                    entry = np.repeat(begin[row[one]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    of, to = t[entry], np.repeat(column[one], many)
                    quick = slot[of] >= 0
                    value = np.zeros(len(of))
                    value[quick] = table[slot[of[quick]] * n + to[quick]]
                    wanted = of[~quick] * n + to[~quick]
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    value[~quick] = np.where(keys[at] == wanted, sat[at], 0.0)
                    s[one] += np.bincount(np.repeat(np.arange(len(one)), many), x[entry] * value, len(one))
                may = s >= least[row] - 2e-9
                improve(best_s, best_i, row[may], s[may], ids[column[may]])

        held, rows, most = [], 0, FIRST_INDEXED
        for batch in batches if len(qids) else ():
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, most - rows))
                at, rows = at + held[-1].num_rows, rows + held[-1].num_rows
                if rows == most:
                    take(pa.Table.from_batches(held))
                    held, rows, most = [], 0, min(4 * most, MOST_INDEXED)
        if held:
            take(pa.Table.from_batches(held))
        row, column = np.nonzero(best_s > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(best_i[row, column]), pa.array(best_s[row, column])], names=["qid", "id", "score"])

    return tokenised.select(F.col("id").cast("bigint"), "tokens", "dl").mapInArrow(run, "qid bigint, id bigint, score double")


def _blocks_of(weights: DataFrame, most: int | None = None) -> int:
    return max(1, -(-weights.select("qid").distinct().count() // (most or QUERIES_AT_ONCE)))


def _block(block: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block


def _blocks(weights: DataFrame, blocks: int) -> Iterator[pa.Table]:
    for block in range(blocks):
        yield (weights.where(_block(block, blocks)) if blocks > 1 else weights).toArrow()


def _matrix(table: pa.Table, qids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    w = np.zeros((n, len(qids)))
    if table.num_rows:
        w[rows, np.searchsorted(qids, table.column("qid").to_numpy())] = table.column("w").to_numpy()
    return w


def _score_block(weights: pa.Table, tokenised: DataFrame, k: int | None, rows: int = ROWS_AT_ONCE, pairs: pa.Table | None = None, least_dl: int = 0, least: float | None = None) -> DataFrame:
    """(qid, id, score): of a block of queries and all rows the k best of each task; all scores above ``least`` for k None.

    ``weights`` (qid, term, w, avgdl). With ``pairs`` (qid, a, b, w) adjacent tokens add to the score too. If the rows
    have a column asks (queries), a row is scored for those only.
    """
    qids = np.unique(weights.column("qid").to_numpy().astype(np.int64)) if weights.num_rows else np.empty(0, np.int64)
    terms = weights.column("term").to_pylist()
    place = {t: i for i, t in enumerate(sorted(set(terms)))}
    w = _matrix(weights, qids, np.array([place[t] for t in terms], np.int64), len(place))
    avgdl = (weights.column("avgdl")[0].as_py() if weights.num_rows else None) or 1.0
    keys, w2 = np.empty(0, np.int64), np.zeros((0, len(qids)))
    if pairs is not None and pairs.num_rows:
        own = np.array([place[a] * len(place) + place[b] for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())], np.int64)
        keys, at = np.unique(own, return_inverse=True)
        w2 = _matrix(pairs, qids, at, len(keys))
    asked = "asks" in tokenised.columns
    least = (-np.inf if asked else 0.0) if least is None else least
    shared = tokenised.sparkSession.sparkContext.broadcast((qids, place, w, keys, w2, avgdl))

    def part_of(cells: np.ndarray, dl: np.ndarray, w: np.ndarray, avgdl: float, n: int) -> np.ndarray:
        """What (row, column) cells, one for each occurrence, add to the scores: rows x queries."""
        out = np.zeros((n, w.shape[1]))
        cell, tf = np.unique(cells, return_counts=True)
        if len(cell):
            doc, column = cell // len(w), cell % len(w)
            sat = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
            start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            out[doc[start]] = np.add.reduceat(w[column] * sat[:, None], start, axis=0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, place, w, keys, w2, avgdl = shared.value
        best_s, best_i = np.empty((len(qids), 0)), np.empty((len(qids), 0), np.int64)

        def out(s, i):
            row, column = np.nonzero(s > -np.inf)
            return pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(i[row, column]), pa.array(s[row, column])], names=["qid", "id", "score"])

        for whole in batches:
            for at in range(0, whole.num_rows if len(qids) else 0, rows):
                batch = whole.slice(at, rows)
                ids, lists, dl = batch.column(0).to_numpy(), batch.column(1), np.maximum(batch.column(2).to_numpy().astype(np.float64), least_dl)
                term = np.array([place.get(t, -1) for t in lists.flatten().to_pylist()], np.int64)
                doc = np.repeat(np.arange(len(ids)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                known = term >= 0
                s = part_of(doc[known] * max(1, len(w)) + term[known], dl, w, avgdl, len(ids))
                if len(keys):
                    both = known[1:] & known[:-1] & (doc[1:] == doc[:-1])
                    found = term[:-1][both] * len(w) + term[1:][both]
                    column = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    hit = keys[column] == found
                    s += part_of(doc[:-1][both][hit] * len(keys) + column[hit], dl, w2, avgdl, len(ids))
                s = np.where(s > least, s, -np.inf).T
                if asked:
                    asks = batch.column(3)
                    mine = np.full(s.shape, -np.inf)
                    row = np.searchsorted(qids, asks.flatten().to_numpy())
                    column = np.repeat(np.arange(len(ids)), asks.value_lengths().to_numpy(zero_copy_only=False))
                    mine[row, column] = s[row, column]
                    s = mine
                if k is None:
                    yield out(s, np.broadcast_to(ids, s.shape))
                else:
                    s, i = best_of_rows(s, ids, k)
                    best_s, best_i = best_of_rows(np.concatenate([best_s, s], 1), np.concatenate([best_i, i], 1), k)
        if k is not None:
            yield out(best_s, best_i)

    columns = [F.col("id").cast("bigint"), "tokens", "dl"] + (["asks"] if asked else [])
    return tokenised.select(*columns).mapInArrow(run, "qid bigint, id bigint, score double")


def _asked_of(members: DataFrame, tokenised: DataFrame, block: int, blocks: int) -> DataFrame:
    """Rows with the queries of a block (QUERIES_A_MATRIX at most) that ask for them, each row once."""
    own = members.where(_block(block, blocks)) if blocks > 1 else members
    return tokenised.join(own.groupBy("id").agg(F.collect_set(F.col("qid").cast("bigint")).alias("asks")), "id").select("id", "tokens", "dl", "asks")


def member_scores(queries: DataFrame, members: DataFrame, tokenised: DataFrame) -> DataFrame:
    """(qid, id, score): the single-stage scores of given pairs (qid, id) only; pairs without a query token are left out."""
    weights = single_weights(queries, tokenised)
    members = members.join(weights.select("qid").distinct(), "qid", "left_semi").select("qid", "id").distinct()
    blocks, out = _blocks_of(weights, QUERIES_A_MATRIX), None
    for block, got in enumerate(_blocks(weights, blocks)):
        found = _score_block(got, _asked_of(members, tokenised, block, blocks), None, least=0.0)
        out = found if out is None else out.unionByName(found)
    return out


def pruned_terms(queries: DataFrame, tokenised: DataFrame) -> DataFrame:
    """(qid, term, pos, df, kept): rarest terms first, while their records together fit the budget.

    Terms no record has cost nothing and are kept; the rarest matching term is always kept; the first term beyond the
    budget ends it. Equally rare terms come in query order.
    """
    terms = written(query_terms(queries), "terms")
    terms = terms.join(document_frequencies(tokenised, terms), "term", "left").na.fill(0, ["df"])
    w = Window.partitionBy("qid").orderBy("df", "pos")
    so_far = F.sum("df").over(w.rowsBetween(Window.unboundedPreceding, 0))
    nth = F.sum((F.col("df") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    budget = F.greatest(F.lit(BUDGET_LEAST), F.floor(F.lit(BUDGET_SHARE) * F.col("total")))
    total = tokenised.agg(F.count("*").alias("total"))
    out = terms.withColumn("so_far", so_far).withColumn("nth", nth).join(F.broadcast(total))
    return out.withColumn("kept", (F.col("df") == 0) | (F.col("nth") == 1) | (F.col("so_far") <= budget)).select("qid", "term", "pos", "df", "kept")


def _pairs_of(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def full_score(queries: DataFrame, candidates: DataFrame, tokenised: DataFrame, k: int = 10, positive_only: bool = False) -> DataFrame:
    """(qid, id, score, rank) of candidates (qid, id) by the whole query, with a bonus for adjacent query tokens.

    Distinct query tokens by BM25, with idf over all records and the mean length of records with tokens (a record's own
    length is at least 1); plus PAIR_WEIGHT times the same for each distinct pair of different tokens that follow each
    other in the query, with the mean of their idf. Candidates without any token score 0 (left out if
    ``positive_only``).
    """
    terms = written(query_terms(queries).select("qid", "term"), "terms")
    stats = filled_stats(tokenised)
    known = terms.join(document_frequencies(tokenised, terms), "term", "left").na.fill(0, ["df"]).join(F.broadcast(stats))
    weights = written(known.select("qid", "term", idf(F.col("df"), F.col("total")).alias("w"), "avgdl"), "weights")
    follows = queries.select("qid", F.explode(F.array_distinct(F.filter(_pairs_of(F.slice(tokens(F.col("qtext")), 1, MOST_TOKENS)), lambda p: p["a"] != p["b"]))).alias("p")).select("qid", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    first, second = (weights.select("qid", F.col("term").alias(x), F.col("w").alias(f"w_{x}")) for x in ("a", "b"))
    pairs = follows.join(first, ["qid", "a"]).join(second, ["qid", "b"]).select("qid", "a", "b", (F.lit(PAIR_WEIGHT) * (F.col("w_a") + F.col("w_b")) / 2).alias("w"))
    members = candidates.select("qid", "id").distinct()
    blocks, out = _blocks_of(weights, QUERIES_A_MATRIX), None
    pairs = written(pairs, "pairs")
    for block, got in enumerate(_blocks(weights, blocks)):
        own = _asked_of(members.join(weights.select("qid").distinct(), "qid", "left_semi"), tokenised, block, blocks)
        found = _score_block(got, own, k, pairs=(pairs.where(_block(block, blocks)) if blocks > 1 else pairs).toArrow(), least_dl=1, least=0.0 if positive_only else None)
        out = found if out is None else out.unionByName(found)
    if not positive_only:  # queries without any token score 0 everywhere
        mute = members.join(weights.select("qid").distinct(), "qid", "left_anti").join(tokenised.select("id"), "id", "left_semi")
        out = out.unionByName(mute.select(F.col("qid").cast("bigint"), F.col("id").cast("bigint"), F.lit(0.0).alias("score")))
    return ranked(out, k, F.col("id").asc())


def candidates(queries: DataFrame, tokenised: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, id): the best records by the kept tokens, and the first ones by id that hold all tokens of the query."""
    prune = pruned_terms(queries, tokenised)
    kept = prune.where("kept").select("qid", "term")
    text = kept.groupBy("qid").agg(F.array_join(F.collect_list("term"), " ").alias("qtext"))
    any_of = single_stage(text, tokenised, RANKED_CANDIDATES, allowed).select("qid", "id")
    # a record that holds all tokens holds the rarest: only its records are looked at
    whole = prune.groupBy("qid").agg(F.collect_list("term").alias("terms"), F.min_by("term", F.struct("df", "pos")).alias("term"), F.min("df").alias("df")).where("df > 0")
    having = tokenised.select("id", F.explode(F.array_distinct("tokens")).alias("term")).join(whole, "term").select("qid", "id", "terms")
    hits = having.join(tokenised.select("id", "tokens"), "id").where(F.size(F.array_except("terms", "tokens")) == 0).select("qid", "id")
    if allowed is not None:
        hits = hits.join(allowed.select("id").distinct(), "id", "left_semi")
    w = Window.partitionBy("qid").orderBy("id")
    all_of = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= ALL_CANDIDATES).select("qid", "id")
    return any_of.unionByName(all_of).distinct()


def two_stage(queries: DataFrame, tokenised: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """Candidates by the kept tokens, then the full score over them."""
    return full_score(queries, written(candidates(queries, tokenised, allowed), "candidates"), tokenised, k)


def direct(queries: DataFrame, tokenised: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """The full score over all ``members`` (qid, id), without a first stage; only positive scores."""
    return full_score(queries, members, tokenised, k, positive_only=True)


def trigram_tokens(queries: DataFrame) -> DataFrame:
    """(qid, token): all words of each query (qid, qtext) for a substring search, unfolded."""
    return queries.select("qid", F.explode(raw_words(F.col("qtext"))).alias("token"))


def trigram(queries: DataFrame, records: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank) of substring search for the tokens of each query (qid, token), by BM25 over trigrams.

    A query's score is the sum over all its tokens; one it repeats counts as often. tf counts overlapping occurrences
    of the lower-cased token, a record's length is its number of trigrams, N and the mean length count every record.
    Tokens under three characters find nothing. Diacritics matter.

    The tokens of a block of QUERIES_AT_ONCE queries go to every task, which finds them in its records, once; df and
    scores are then those of a search by tokens.
    """
    own = records.select(F.col("id").cast("bigint").alias("id"), F.lower(F.coalesce("text", F.lit(""))).alias("low"), F.greatest(F.length(F.coalesce("text", F.lit(""))) - 2, F.lit(0)).alias("dl"))
    stats = own.agg(F.count("*").alias("total"), F.avg("dl").alias("avgdl"))
    wanted = written(queries.where(F.length("token") >= 3).groupBy("qid", F.lower("token").alias("term")).agg(F.count("*").alias("qtf")), "terms")
    blocks, out = _blocks_of(wanted), None
    for block in range(blocks):
        asks = wanted.where(_block(block, blocks))
        terms = asks.select("term").distinct().toArrow().column("term")
        codes = own.sparkSession.createDataFrame(pa.table({"term": terms, "code": pa.array(range(len(terms)), pa.int32())}), "term string, code int")
        found = written(_occurrences(own, terms.to_pylist()), "occurrences")
        coded = asks.join(codes, "term").select("qid", F.col("code").alias("term"), "qtf")
        weights = coded.join(document_frequencies(found), "term").join(F.broadcast(stats)).select("qid", "term", (F.col("qtf") * idf(F.col("df"), F.col("total"))).alias("w"), "avgdl")
        hits = found if allowed is None else found.join(allowed.select("id").distinct(), "id", "left_semi")
        best = _best_block(weights.toArrow(), hits, k)
        out = best if out is None else out.unionByName(best)
    return ranked(out, k, F.col("id").asc())


def _occurrences(own: DataFrame, terms: list[str]) -> DataFrame:
    """(id, tokens, dl): for every place of a record where one of the terms stands, overlapping ones too, the term's number."""
    shared = own.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for code, t in enumerate(shared.value):
            automaton.add_word(t, code)
        automaton.make_automaton()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                found = [[code for _, code in automaton.iter(low)] if len(automaton) else [] for low in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2)], names=["id", "tokens", "dl"])

    return own.mapInArrow(run, "id bigint, tokens array<int>, dl int")
