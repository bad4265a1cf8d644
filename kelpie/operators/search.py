"""One front for all searches: a batch of queries under a request, as ranked hits with their records and expansion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.operators import bm25, expand, filters, fusion, ivf, vector
from kelpie.session import written

MODES, FUSIONS = ("vector", "text", "hybrid"), ("rrf", "relative")
#: Records of a document filter up to which a text query scores them directly, without a first stage.
DIRECT = 1000


@dataclass
class Expand:
    siblings_topk: int | None = None
    siblings_all: bool = False
    summary: bool = False


@dataclass
class Request:
    """What holds for all queries of a batch. ValueError for values outside their range."""

    mode: str = "vector"
    k: int = 10
    scope: str = "chunks"
    filter: dict | None = None
    expand: Expand = field(default_factory=Expand)
    nprobe: int | None = None
    fusion: str = "rrf"
    alpha: float = 0.5

    def __post_init__(self):
        for name, known in (("mode", MODES), ("scope", tuple(filters.SCOPES)), ("fusion", FUSIONS)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} is one of {', '.join(known)}")
        for name, low, high in (("k", 1, 1000), ("nprobe", 1, 4096), ("alpha", 0, 1)):
            v = getattr(self, name)
            if v is not None and not low <= v <= high:
                raise ValueError(f"{name} lies between {low} and {high}")
        if self.expand.siblings_topk is not None and self.expand.siblings_topk < 1:
            raise ValueError("siblings_topk is at least 1")
        filters.compile_filter(self.filter)


def checked(queries: DataFrame, mode: str, dim: int) -> DataFrame:
    """The queries (qid, qtext, vec) themselves; ValueError names the first bad one. An action.

    Vector mode needs either a text or a vector, the others need a text; text mode takes no vector; a text isn't blank, a
    vector has ``dim`` numbers.
    """
    text, vec = F.col("qtext").isNotNull(), F.col("vec").isNotNull()
    wrong = (
        F.when(text & ~F.col("qtext").rlike(r"[^\s\p{Z}]"), "blank text")
        .when(F.lit(mode == "vector") & (text == vec), "vector mode needs either a text or a vector")
        .when(F.lit(mode != "vector") & ~text, f"{mode} mode needs a text")
        .when(F.lit(mode == "text") & vec, "text mode takes no vector")
        .when(vec & (F.size("vec") != dim), "vector of another length")
    )
    bad = queries.select("qid", wrong.alias("wrong")).where("wrong is not null").orderBy("qid").first()
    if bad:
        raise ValueError(f"query {bad.qid}: {bad.wrong}")
    return queries


def text_leg(queries: DataFrame, tokenised: DataFrame, k: int, allowed: DataFrame | None = None, by_document: bool = False) -> DataFrame:
    """(qid, id, score, rank) of queries (qid, qtext), each by the way it needs.

    Few records of given documents are scored directly. Queries that lose a token to the budget go through two stages,
    the others through one.
    """
    if by_document and allowed is not None and allowed.limit(DIRECT + 1).count() <= DIRECT:
        return bm25.direct(queries, tokenised, queries.select("qid").crossJoin(F.broadcast(allowed.select("id"))), k)
    prune = bm25.pruned_terms(queries, tokenised)
    whole = written(prune.groupBy("qid").agg(F.min(F.col("kept").cast("int")).alias("whole")), "whole")
    one = bm25.single_stage(queries.join(whole.where("whole = 1"), "qid", "left_semi"), tokenised, k, allowed)
    return one.unionByName(bm25.two_stage(queries.join(whole.where("whole = 0"), "qid", "left_semi"), tokenised, k, allowed))


def search(
    queries: DataFrame, records: DataFrame, vecs: DataFrame, request: Request, tokenised: DataFrame | None = None, dim: int = 64, embed: Callable | None = None, lists: tuple[DataFrame, DataFrame] | None = None, tokenizer: str = "unicode61"
) -> DataFrame:
    """(qid, id, score, rank): the hits of queries (qid, qtext, vec) under a request.

    Texts of queries without a vector are embedded by ``embed`` where a vector is needed. ``lists`` (lists, centroids)
    are probed instead of searching all vectors. ``tokenised`` are the records' tokens, made anew if not given; with the
    tokenizer trigram texts are searched by substrings.
    """
    queries = checked(queries, request.mode, dim)
    depth = fusion.depth(request.k) if request.mode == "hybrid" else request.k
    scope = filters.in_scope(request.scope, request.filter)
    alpha = request.alpha if request.fusion == "relative" else 0.5
    v = t = None
    if request.mode == "vector" or request.mode == "hybrid" and alpha > 0:
        asks = queries.select("qid", "vec")
        if embed is not None:
            from kelpie.sources.embed import embedded

            made = embedded(queries.where("vec is null"), embed, key="qid", text="qtext")
            asks = asks.where("vec is not null").unionByName(made.select("qid", F.col("vec").cast(asks.schema["vec"].dataType).alias("vec")))
        if lists is None:
            v = vector.search(asks, records, vecs, depth, scope, dim)
        else:
            v = ivf.search(asks, *lists, depth, request.nprobe or ivf.NPROBE, records.where(scope).select("id"), dim)
    if request.mode == "text" or request.mode == "hybrid" and alpha < 1:
        asks, allowed = queries.select("qid", "qtext"), records.where(scope).select("id")
        if tokenizer == "trigram":
            t = bm25.trigram(bm25.trigram_tokens(asks), records, depth, allowed)
        else:
            tokenised = written(bm25.tokenised(records), "tokens") if tokenised is None else tokenised
            t = text_leg(asks, tokenised, depth, allowed, bool(request.filter and "doc_id" in request.filter))
    if request.mode != "hybrid":
        return (v if t is None else t).select("qid", "id", "score", "rank")
    if request.fusion == "rrf":
        return fusion.reciprocal_rank(v, t, request.k)
    return fusion.relative(t.limit(0) if v is None else v, v.limit(0) if t is None else t, alpha, request.k)


def searched(queries: DataFrame, records: DataFrame, vecs: DataFrame, request: Request, tokenised: DataFrame | None = None, dim: int = 64, **options) -> DataFrame:
    """The hits with their records' fields, and with siblings and summary as nested columns where the request asks for them.

    Siblings of a number come by vector in vector and hybrid mode, by text in text mode; only otherwise all of them.
    """
    hits = written(search(queries, records, vecs, request, tokenised, dim, **options), "hits")
    e = request.expand
    out = expand.expanded(hits, records, e.siblings_all and not e.siblings_topk, e.summary)
    if e.siblings_topk:
        chunks = records.where("indexed = 1")
        if request.mode == "text":
            tokenised = written(bm25.tokenised(records), "tokens") if tokenised is None else tokenised
            kept = bm25.pruned_terms(queries.select("qid", "qtext"), tokenised).where("kept").groupBy("qid").agg(F.array_join(F.collect_list("term"), " ").alias("qtext"))
            own = expand.siblings(hits, chunks).select("qid", F.col("sid").alias("id"))
            near = expand.matching_siblings(hits, bm25.member_scores(kept, own, tokenised), chunks, e.siblings_topk)
        else:
            near = expand.nearest_siblings(hits, queries.where("vec is not null").select("qid", "vec"), chunks, vecs, e.siblings_topk)
        nested = near.groupBy("qid", "id").agg(F.sort_array(F.collect_list(F.struct("place", F.col("sid").alias("id"), "score"))).alias("siblings"))
        out = out.join(nested, ["qid", "id"], "left").withColumn("siblings", F.coalesce("siblings", F.array().cast(nested.schema["siblings"].dataType)))
    return out
