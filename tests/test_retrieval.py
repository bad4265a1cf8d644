import sqlite3
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.functions.text import fold_tokens
from kelpie.operators import bm25, corpus, expand, fusion, ivf, vector
from kelpie.plans.queries import queries

TEXTS = [(1, "alpha beta beta"), (2, None), (3, ""), (4, "beta gamma alpha"), (5, "delta"), (6, "alpha alpha alpha beta"), (7, "epsilon beta"), (8, "zeta eta theta"), (9, "Béta")]


def test_single_stage_equals_a_full_text_database(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize = 'unicode61')")
    con.executemany("INSERT INTO f (rowid, t) VALUES (?, ?)", TEXTS)
    records = spark.createDataFrame(TEXTS, "id long, text string")
    for q in ("alpha beta", "delta", "beta beta alpha", "nothing"):
        theirs = con.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH ? ORDER BY rank, rowid", (" OR ".join(f'"{t}"' for t in q.split()),)).fetchall()
        mine = bm25.single_stage(spark.createDataFrame([(1, q)], "qid long, qtext string"), bm25.tokenised(records), 20).orderBy("rank").collect()
        assert [r.id for r in mine] == [t[0] for t in theirs]
        assert [r.score for r in mine] == pytest.approx([t[1] for t in theirs], rel=1e-9)


def test_trigram_equals_a_full_text_database(spark):
    rows = [(1, "PostgreSQL configuration"), (2, "postgres gresql gresql"), (3, None), (4, "ab"), (5, "aaaa aaa")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize = 'trigram')")
    con.executemany("INSERT INTO f (rowid, t) VALUES (?, ?)", rows)
    records = spark.createDataFrame(rows, "id long, text string")
    for token in ("gresql", "aaa", "ab", "CONF"):
        theirs = con.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH ? ORDER BY rank, rowid", (f'"{token}"',)).fetchall()
        mine = bm25.trigram(spark.createDataFrame([(1, token)], "qid long, token string"), records).orderBy("rank").collect()
        assert [(r.id, round(r.score, 9)) for r in mine] == [(i, round(s, 9)) for i, s in theirs]


def test_trigram_of_several_tokens_equals_a_full_text_database(spark):
    rows = [(1, "PostgreSQL configuration"), (2, "postgres gresql gresql"), (3, None), (4, "ab"), (5, "aaaa aaa"), (6, "привет postgres"), (7, "a config"), (8, "nothing here"), (9, "other words"), (10, "more of them")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize = 'trigram')")
    con.executemany("INSERT INTO f (rowid, t) VALUES (?, ?)", rows)
    records = spark.createDataFrame(rows, "id long, text string")
    asks = [(1, "gresql CONF"), (2, "aaa aaaa ab aaa"), (3, "config configuration Привет"), (4, "ab"), (5, None)]
    got = bm25.trigram(bm25.trigram_tokens(spark.createDataFrame(asks, "qid long, qtext string")), records).collect()
    for qid, q in asks[:3]:
        theirs = con.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH ?", (" OR ".join(f'"{t}"' for t in q.split()),)).fetchall()
        assert {r.id: round(r.score, 9) for r in got if r.qid == qid} == {i: round(s, 9) for i, s in theirs}
    assert {r.qid for r in got} == {1, 2, 3}


def test_trigram_takes_all_words_of_a_long_text(spark):
    records = spark.createDataFrame([(1, "word0 here"), (2, "an ending"), (3, "nothing"), (4, "at all")], "id long, text string")
    asks = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(150)) + " ending")], "qid long, qtext string")
    assert {r.id for r in bm25.trigram(bm25.trigram_tokens(asks), records).collect()} == {1, 2}


def test_trigrams_of_all_texts(spark, tmp_path):
    texts = ["Привет, мир", "Ünïque – naïve", "一二三四", "Αθήνα Αθήνα", "مرحبا بكم", "plain ASCII plain", "a\u00a0b", "😀😀😀😀", "e\u0301te\u0301", "ab", "", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[0]], "id long, text string").write.parquet(f"{tmp_path}/records.parquet")
    brute = Counter(t.lower()[k : k + 3] for t in texts if t for k in range(len(t.lower()) - 2))
    assert {r.gram: r.n for r in queries()["fn_trigram_all"](spark, str(tmp_path)).collect()} == brute


def brute_full(query, texts, weights, avgdl):
    q = fold_tokens(query)[:100]
    out = {}
    for i, t in texts:
        own = fold_tokens(t)
        norm = 1.2 * (0.25 + 0.75 * max(1, len(own)) / avgdl)
        s = sum(weights[x] * own.count(x) * 2.2 / (own.count(x) + norm) for x in set(q))
        for a, b in {(a, b) for a, b in zip(q, q[1:]) if a != b}:
            n = sum(p == (a, b) for p in zip(own, own[1:]))
            s += 0.2 * (weights[a] + weights[b]) / 2 * n * 2.2 / (n + norm)
        out[i] = s
    return out


def test_full_score(spark):
    records = spark.createDataFrame(TEXTS, "id long, text string")
    t = bm25.tokenised(records)
    q = "alpha beta unseen alpha"
    toks = {i: fold_tokens(x) for i, x in TEXTS}
    n, filled = len(TEXTS), [len(x) for x in toks.values() if x]
    weights = {w: max(np.log((n - d + 0.5) / (d + 0.5)), 1e-6) for w in set(fold_tokens(q)) for d in [sum(w in x for x in toks.values())]}
    want = brute_full(q, TEXTS, weights, sum(filled) / len(filled))
    queries = spark.createDataFrame([(1, q)], "qid long, qtext string")
    got = {r.id: r.score for r in bm25.full_score(queries, records.select(F.lit(1).cast("long").alias("qid"), "id"), t, 100).collect()}
    assert got == pytest.approx(want)
    assert all(r.score > 0 for r in bm25.direct(queries, t, records.select(F.lit(1).cast("long").alias("qid"), "id"), 100).collect())


def test_pruning_keeps_the_rarest(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BUDGET_LEAST", 4)
    records = spark.createDataFrame(TEXTS, "id long, text string")
    got = bm25.pruned_terms(spark.createDataFrame([(1, "beta alpha unseen delta")], "qid long, qtext string"), bm25.tokenised(records)).collect()
    assert {r.term: r.kept for r in got} == {"unseen": True, "delta": True, "alpha": True, "beta": False}


def test_two_stage_finds_what_pruning_lost(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BUDGET_LEAST", 0)
    rows = [(1, "rare common common"), (2, "rare")] + [(i, "common") for i in range(3, 6)] + [(i, "noise") for i in range(6, 13)]
    t = bm25.tokenised(spark.createDataFrame(rows, "id long, text string"))
    got = bm25.two_stage(spark.createDataFrame([(1, "rare common")], "qid long, qtext string"), t).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2]


def test_no_queries_no_records(spark):
    empty = spark.createDataFrame([], "id long, text string")
    q = spark.createDataFrame([(1, "x")], "qid long, qtext string")
    assert bm25.single_stage(q, bm25.tokenised(empty)).count() == 0
    assert bm25.two_stage(q, bm25.tokenised(empty)).count() == 0
    none = spark.createDataFrame([], "qid long, vec array<float>")
    assert vector.top_k(none, spark.createDataFrame([], "id long, vec array<float>"), 3, 2).count() == 0


def test_fusion_order(spark):
    leg = "qid long, id long, score double, rank int"
    v = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.5, 2), (1, 3, 0.1, 3)], leg)
    t = spark.createDataFrame([(1, 3, 10.0, 1), (1, 4, 2.0, 2)], leg)
    got = fusion.relative(v, t, 0.25).orderBy("rank").collect()
    assert [r.id for r in got] == [3, 1, 2, 4] and [r.score for r in got] == pytest.approx([0.75, 0.25, 0.125, 0.0])
    assert [r.id for r in fusion.relative(v, t, 1.0).orderBy("rank").collect()] == [1, 2, 3]
    assert [r.id for r in fusion.reciprocal_rank(v, t).orderBy("rank").collect()] == [3, 1, 2, 4]
    with pytest.raises(ValueError):
        fusion.relative(v, t, 2)


def vectors(n=1500, dim=16, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    x[5] = x[6] = x[7]
    return x


def test_top_k_is_exact_with_ties_and_blocks(spark, monkeypatch):
    x = vectors(200)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [1.0])], "id long, vec array<double>").repartition(5)
    asks = df.where("id % 20 = 0 or id = 5").select(F.col("id").alias("qid"), "vec")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for size in (1 << 20, 600):
        monkeypatch.setattr(vector, "QUERY_BYTES", size)
        got = {}
        for r in vector.top_k(asks, df, 4, 16).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        for q in (*range(0, 200, 20), 5):
            s = np.round(u @ u[q], 9)
            assert got[q] == sorted(range(200), key=lambda i: (-s[i], i))[:4]


def test_top_k_multiplies_tile_by_tile(spark, monkeypatch):
    x = vectors(300)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>").coalesce(2)
    asks = df.where("id % 10 = 5").select(F.col("id").alias("qid"), "vec")
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    monkeypatch.setattr(vector, "TILE_QUERIES", 7)
    monkeypatch.setattr(vector, "TILE_ROWS", 32)
    for own in (False, True):
        got = {(r.qid, r.rank): r.id for r in vector.top_k(asks, df, 4, 16, but_itself=own).collect()}
        for q in range(5, 300, 10):
            s = np.round(u @ u[q], 9)
            assert [got[q, n] for n in range(1, 5)] == sorted((i for i in range(300) if i != q or not own), key=lambda i: (-s[i], i))[:4]


def test_all_lists_probed_is_exact_search(spark):
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    centroids = ivf.train(df, 8, 16)
    lists, table = ivf.assign(df, centroids, 16), ivf.centroid_table(df, centroids)
    asks = df.where("id % 100 = 0").select(F.col("id").alias("qid"), "vec")
    exact = {(r.qid, r.id) for r in vector.top_k(asks, df, 5, 16).collect()}
    assert {(r.qid, r.id) for r in ivf.search(asks, lists, table, 5, 8, dim=16).collect()} == exact
    some = ivf.search(asks, lists, table, 5, 4, dim=16)
    assert corpus.recall(some, vector.top_k(asks, df, 5, 16)).first().recall > 0.5
    few = df.where("id < 40").select("id")
    assert {(r.qid, r.id) for r in ivf.search_few(asks, lists, few, 5, 16).collect()} == {(r.qid, r.id) for r in vector.top_k(asks, df.where("id < 40"), 5, 16).collect()}
    with pytest.raises(ivf.NotEnoughVectors):
        ivf.train(df.limit(100), 8, 16)


def test_quantised_search_finds_nearly_all(spark):
    x = vectors(1000, 64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    asks = df.where("id % 100 = 0").select(F.col("id").alias("qid"), "vec")
    assert corpus.recall(vector.quantised_search(asks, df, 10, 64), vector.top_k(asks, df, 10, 64)).first().recall >= 0.99


def test_expansion(spark):
    rows = [(1, "d", "d", "summary", None), (2, "c0", "d", "chunk", 0), (3, "c1", "d", "chunk", 1), (4, "c2", "d", "chunk", None), (5, "e0", "e", "chunk", 0)]
    r = spark.createDataFrame([(*x, "t", "{}") for x in rows], "id long, external_id string, doc_id string, type string, position int, text string, metadata string")
    hits = spark.createDataFrame([(9, 1), (9, 3), (9, 5), (9, 77)], "qid long, id long")
    assert [(x.id, x.sid) for x in expand.all_siblings(hits, r).orderBy("id", "place").collect()] == [(1, 4), (1, 2), (1, 3), (3, 4), (3, 2)]
    assert {(x.id, x.sid) for x in expand.summaries(hits, r).collect()} == {(3, 1), (5, None)}
    full = {x.id: x for x in expand.expanded(hits, r, siblings_all=True, summary=True).collect()}
    assert [s.id for s in full[3].siblings] == [4, 2] and full[3].summary.id == 1 and full[5].summary is None and 77 not in full


def test_chunks_keep_long_documents_whole(spark, tmp_path):
    text = "lead.\n" + "\n\n".join(f"Part {n}\n" + " ".join(["word"] * 29 + ["end."]) for n in range(100))
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["dp_chunks"](spark, str(tmp_path)).orderBy("n").collect()
    assert [(r.doc_id, r.n, r.words) for r in got] == [(1, n, 64) for n in range(50)]


def test_lines_and_headings(spark):
    rows = ["Operational history", "See also", "HMAS Sydney, named after the Australian city of Sydney.", "", "one two three four five six seven eight nine ten eleven", "A quote”"]
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    assert [r[0] for r in df.select(corpus.is_heading(F.col("x"))).collect()] == [True, True, False, False, False, False]
    text = "Lead one.\n\nLead two.\n\nHistory\nFirst para.\n\nDesign\n\u00a0\nSecond para.\nThird para.\nBare"
    lead, body = corpus.lead_and_body(F.col("text"))
    df = spark.createDataFrame([(1, text), (2, None), (3, "No end"), (4, "Only lead.")], "id int, text string").select("id", lead.alias("lead"), body.alias("body"))
    got = {r.id: (r.lead, r.body) for r in df.collect()}
    assert got[1] == (["Lead one.", "Lead two."], ["History\nFirst para.", "Design\nSecond para.", "Third para."])
    assert got[2] == ([], []) and got[3] == ([], []) and got[4] == (["Only lead."], [])


def test_articles_and_their_queries(spark):
    def article(lead=120, sections=14, words=220):
        body = [f"Section {n}\n" + " ".join(["This test sentence has exactly nine words in it."] * (words // 9)) for n in range(sections)]
        return " ".join(["Alpha is a test article about things."] * (lead // 7)) + "\n\n" + "\n\n".join(body)

    rows = [(7, "Alpha", article()), (1, "Alpha", article(lead=20)), (2, "Alpha", article(sections=4)), (3, "List of alphas", article()), (4, None, None)]
    records = corpus.shaped(spark.createDataFrame(rows, "doc_id long, title string, text string"))
    got = records.orderBy("id").collect()
    assert [r.id for r in got] == ["w7", "w7#0", "w7#1", "w7#2", "w7#3"] and [r.kind for r in got] == ["summary"] + ["chunk"] * 4
    assert len(got[0].text.split()) <= 300 and got[1].text.startswith("Section 0\nThis test")
    asked = {r.kind: r for r in corpus.made_queries(records).collect()}
    assert asked["summary"].qtext == "Alpha" and asked["summary"].target == "w7"
    assert asked["indoc"].qtext.strip() == "This test sentence has exactly nine words in it." and asked["indoc"].target.startswith("w7#")


def test_batches_close_at_a_document(spark):
    df = spark.createDataFrame([("a", k, n) for k, n in enumerate((240, 240, 40, 240))] + [("b", 0, 900), ("b", 1, 1), ("c", 5, 250), ("c", 6, 3)], "g string, k int, n int")
    got = {(r.g, r.k): r.batch for r in corpus.batches(df, "g", "k").collect()}
    assert [got["a", k] for k in range(4)] == [0, 0, 1, 1] and [got["b", 0], got["b", 1], got["c", 5], got["c", 6]] == [0, 1, 0, 1]


def test_search_front(spark):
    from kelpie.operators.search import Expand, Request, checked, search, searched

    for bad in ({"mode": "fuzzy"}, {"k": 0}, {"k": 1001}, {"scope": "all"}, {"alpha": 1.5}, {"fusion": "sum"}, {"nprobe": 0}, {"expand": Expand(0)}, {"filter": {"a": {"like": 1}}}):
        with pytest.raises(ValueError):
            Request(**bad)
    ask = lambda *rows: spark.createDataFrame(list(rows), "qid long, qtext string, vec array<double>")
    v = [1.0] + [0.0] * 7
    for mode, row in (("vector", (1, "a", v)), ("vector", (1, None, None)), ("text", (1, None, None)), ("text", (1, "a", v)), ("hybrid", (1, None, v)), ("hybrid", (1, " \u00a0", v)), ("vector", (1, None, [1.0]))):
        with pytest.raises(ValueError, match="query 1"):
            checked(ask(row), mode, 8)
    records = spark.createDataFrame([(i, f"e{i}", f"d{i // 4}", "summary" if i % 4 == 0 else "chunk", i % 4, f"word{i} shared" + (" tiger" if i in (5, 9) else ""), f'{{"n": {i}}}', 1) for i in range(1, 17)], "id long, external_id string, doc_id string, type string, position int, text string, metadata string, indexed int")
    vecs = spark.createDataFrame([(i, [float(i == 2), *[float(i % 7 == k) for k in range(1, 8)]]) for i in range(1, 17) if i % 7], "id long, vec array<double>")
    got = search(ask((1, "tiger", v)), records, vecs, Request("hybrid", 5, filter={"n": {"lt": 9}}), dim=8).orderBy("rank").collect()
    assert {r.id for r in got} >= {2, 5} and max(r.id for r in got) < 9
    text = search(ask((1, "tiger", None), (2, "nothing", None)), records, vecs, Request("text", scope="both", filter={"doc_id": "d2"}), dim=8).collect()
    assert [(r.qid, r.id) for r in text] == [(1, 9)]
    found = searched(ask((1, "tiger", None)), records, vecs, Request("text", 1, expand=Expand(siblings_topk=2, summary=True)), dim=8).first()
    assert found.id in (5, 9) and found.siblings == [] and found.summary.id == found.id // 4 * 4
    near = searched(ask((1, None, v)), records, vecs, Request("vector", 1, expand=Expand(siblings_topk=1)), dim=8).first()
    assert near.id == 2 and len(near.siblings) == 1
    assert search(ask((1, "ige", None)), records, vecs, Request("text"), dim=8, tokenizer="trigram").count() == 2
    assert {r.id for r in search(ask((1, "tiger", None)), records, vecs, Request("hybrid", 3, fusion="relative", alpha=0.0), dim=8).collect()} == {5, 9}


def test_many_queries_meet_the_postings_by_term(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 9)))) for i in range(80)]
    t = bm25.tokenised(spark.createDataFrame(rows, "id long, text string"))
    asks = spark.createDataFrame([(q, " ".join(rng.choice(list("abcxyz"), 3))) for q in range(9)], "qid long, qtext string")
    want = {(r.qid, r.rank): (r.id, round(r.score, 9)) for r in bm25.single_stage(asks, t, 5).collect()}
    monkeypatch.setattr(bm25, "QUERIES_AT_ONCE", 2)
    for most in (8, 1):
        monkeypatch.setattr(bm25, "MOST_BLOCKS", most)
        assert {(r.qid, r.rank): (r.id, round(r.score, 9)) for r in bm25.single_stage(asks, t, 5).collect()} == want


def test_thousands_of_queries_are_scored_without_a_join(spark, monkeypatch):
    for name, value in (("FIRST_INDEXED", 16), ("MOST_INDEXED", 64), ("MOST_DENSE", 4), ("CELLS", 2000)):
        monkeypatch.setattr(bm25, name, value)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    texts = [[words[int(x)] for x in rng.zipf(1.3, rng.integers(0, 30)) if x < 300] for _ in range(400)]
    asks = [texts[int(i)] for i in rng.integers(0, 400, 1600)]
    t = bm25.tokenised(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "id long, text string").repartition(2))
    t = bm25.written(t, "tokens")
    found = bm25.single_stage(spark.createDataFrame([(q, " ".join(x)) for q, x in enumerate(asks)], "qid long, qtext string"), t, 5)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    tf = np.array([[x.count(w) for w in words] for x in texts], float)
    df, dl = (tf > 0).sum(0), tf.sum(1)
    sat = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl[:, None] / dl.mean()))
    weight = np.maximum(np.log((400 - df + 0.5) / (df + 0.5)), 1e-6)
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, round(r.score, 6)))
    for q, x in enumerate(asks):
        s = sat @ (weight * [x.count(w) for w in words])
        best = sorted(np.flatnonzero(s > 0), key=lambda i: (-round(s[i], 9), i))[:5]
        assert got.get(q, []) == [(i, round(s[i], 6)) for i in best]


def test_windows_and_percentiles(spark):
    df = spark.createDataFrame([(["w " * 500, "w " * 400, "w " * 900, "w " * 100],), (["w " * 800] * 30,), (["short"],), ([],)], "b array<string>")
    got = [[len(x.split()) for x in r.w] for r in df.select(corpus.windows(F.col("b")).alias("w")).collect()]
    assert got == [[900, 1000], [800] * 10, [1], []]
    import statistics

    values = [float(v) for v in np.random.default_rng(1).standard_normal(57)]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 2.0), ("b", None)], "g string, v double")
    got = {r.g: r.value for r in corpus.exclusive_percentile(rows, "v", 95, "g").collect()}
    assert got["a"] == pytest.approx(statistics.quantiles(values, n=100)[94]) and got["b"] == 2.0
