import json

import numpy as np
import pytest

from kelpie.operators.store import Exists, Missing, Options, Store
from kelpie.sources.embed import TryAgain, embedded, hashed
from kelpie.sources.ingest import DOCUMENTS, BadPayload, flatten, validated
from kelpie.streaming import ingest as stream

SCHEMA = f"ingest_id bigint, documents {DOCUMENTS}"


def doc(doc_id, *chunks, summary=None):
    return {"doc_id": doc_id, "summary": summary, "chunks": list(chunks)}


def chunk(key, text="t", vector=None, metadata=None, position=None):
    return {"id": key, "position": position, "text": text, "vector": vector, "metadata": metadata}


def frame(spark, *payloads):
    return spark.createDataFrame(list(payloads), SCHEMA)


def test_flatten_last_wins_at_the_first_place(spark):
    df = frame(spark, (1, [doc("d", chunk("a", "1"), chunk("b", "2", position=7), chunk("a", "3"), None, chunk(None)), None]), (2, None), (3, [doc("e", summary={"text": "s", "vector": None, "metadata": None})]))
    rows = flatten(df).orderBy("ingest_id", "place").collect()
    assert [(r.external_id, r.text, r.position, r.type) for r in rows] == [("a", "3", 2, "chunk"), ("b", "2", 7, "chunk"), ("e", "s", None, "summary")]
    assert rows[0].metadata == "{}"
    with pytest.raises(BadPayload, match="a: zero vector"):
        validated(flatten(frame(spark, (1, [doc("d", chunk("a", None, [0.0, 0.0]))]))), 2)
    with pytest.raises(BadPayload, match="text or a vector"):
        validated(flatten(frame(spark, (1, [doc("d", chunk("a", None))]))), 2)


def test_collections(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    c = store.create("notes", Options(dim=8, fts_keys=["title"]))
    with pytest.raises(Exists):
        store.create("notes", Options(dim=8))
    assert store.names() == ["notes"]
    c.ingest(frame(spark, (1, [doc("d", chunk("a", metadata='{"title": "T", "n": 1}'), chunk("b"), summary={"text": "s", "vector": [1.0] * 8, "metadata": None})])), embed=hashed(8))
    assert [(r.id, r.external_id) for r in c.records.orderBy("id").collect()] == [(1, "d"), (2, "a"), (3, "b")]
    assert c.vecs.count() == 3 and c.records.where("external_id = 'a'").first().fts_metadata == "\nT"
    c.ingest(frame(spark, (2, [doc("d", chunk("a", "new"))])), embed=hashed(8))
    assert [(r.id, r.external_id, r.text) for r in c.records.orderBy("id").collect()] == [(1, "d", "s"), (3, "b", "t"), (4, "a", "new")]
    assert sorted(r.id for r in c.vecs.collect()) == [1, 3, 4]
    assert c.patch_metadata("d", {"title": "U", "n": None}) == 3
    assert {r.fts_metadata for r in c.records.collect()} == {"\nU"}
    with pytest.raises(Missing):
        c.patch_metadata("nope", {})
    with pytest.raises(Missing):
        c.detach_index()
    page, total = c.list(scope="chunks", sort="-title", limit=1)
    assert page.count() == 1 and total.first().total == 2
    assert c.stats().first().asDict() == {"docs": 1, "chunks": 2, "summaries": 1}
    assert c.delete_document("d") == 3 and c.delete_document("d") == 0 and c.vecs.count() == 0
    store.drop("notes")
    assert store.names() == [] and store.create("notes", Options(dim=8)).records.count() == 0
    for bad in ({"dim": 7}, {"dim": 8, "bit_width": 3}, {"dim": 8, "tokenizer": "x"}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_index_follows_the_collection(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    c = store.create("v", Options(dim=8))
    x = np.random.default_rng(0).standard_normal((1100, 8))
    c.ingest(frame(spark, (1, [doc("d", *[chunk(f"k{i}", None, v.tolist()) for i, v in enumerate(x)])])))
    c.attach_index(8, 8)
    asks = c.vecs.where("id % 100 = 0").selectExpr("id as qid", "vec")
    from kelpie.operators.vector import top_k

    exact = {(r.qid, r.id) for r in top_k(asks, c.vecs, 3, 8).collect()}
    assert {(r.qid, r.id) for r in c.indexed_search(asks, 3).collect()} == exact
    c.ingest(frame(spark, (2, [doc("e", chunk("late", None, x[99].tolist()))])))
    late = c.records.where("external_id = 'late'").first().id
    asks = c.vecs.where("id = 100").selectExpr("id as qid", "vec")
    assert late in {r.id for r in c.indexed_search(asks, 3).collect()}
    c.detach_index()
    with pytest.raises(Missing):
        c.indexed_search(asks)


def test_stream_applies_each_batch_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    c = store.create("s", Options(dim=8))
    landing = tmp_path / "in"
    landing.mkdir()
    for i in range(10):
        bad = i == 4
        (landing / f"{i:02}.json").write_text(json.dumps({"ingest_id": i, "documents": [doc(f"d{i}", chunk(f"c{i}", None if bad else "text"))]}))
    (landing / "10.json").write_text(json.dumps({"ingest_id": 10, "documents": []}))
    run = lambda: stream.start(c, str(landing), str(tmp_path / "ck"), str(tmp_path / "jobs"), embed=hashed(8), once=True).awaitTermination()
    run()
    status = {r.ingest_id: (r.status, r.error) for r in stream.jobs(c, str(tmp_path / "jobs")).collect()}
    assert status[4] == ("error", "c4: needs a text or a vector") and status[10] == ("error", "no document") and sum(s == "done" for s, _ in status.values()) == 9
    assert c.records.count() == 9 and c.current["batch"] == 1
    run()
    assert c.records.count() == 9
    stream.apply_batch(c, frame(spark, (99, [doc("x", chunk("x"))])), 1, str(tmp_path / "jobs"))  # a replay of an applied batch
    assert c.records.count() == 9


def test_embedding_retries(spark, tmp_path):
    flag = tmp_path / "failed"

    def flaky(texts):
        if not flag.exists():
            flag.write_text("x")
            raise TryAgain("later")
        return hashed(8)(texts)

    df = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(70)], "id long, text string").coalesce(1)
    got = {r.id: r.vec for r in embedded(df, flaky, wait=0.01).collect()}
    assert len(got) == 69 and got[5] == pytest.approx(hashed(8)(["t5"])[0], abs=1e-6)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_upsert_of_wide_rows_loses_none(spark, adaptive):
    from pyspark.sql import functions as F

    from kelpie.operators import writes

    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        wide = F.repeat(F.sha2(F.col("id").cast("string"), 512), 8)
        old = spark.range(1, 20_001).select("id", F.concat(F.lit("k"), "id").alias("external_id"), wide.alias("text"))
        new = spark.range(0, 30_000).repartition(13).select(F.col("id").alias("ingest_id"), (F.col("id") * 7919 % 30_000).alias("place"), F.concat(F.lit("k"), F.col("id") + 10_001).alias("external_id"), wide.alias("text"), F.array(F.lit(0.5)).alias("vector"))
        rows = writes.upsert(old, new, ["place", "ingest_id"]).collect()
        assert len(rows) == 40_000 and len({r.id for r in rows}) == len({r.external_id for r in rows}) == 40_000
        came = sorted((r for r in rows if r.id > 20_000), key=lambda r: r.id)
        assert [r.id for r in came] == list(range(20_001, 50_001))
        places = [(int(r.external_id[1:]) - 10_001) * 7919 % 30_000 for r in came]
        assert places == sorted(places) and all(r.text for r in rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_segments_merge_and_lists_follow(spark, tmp_path, monkeypatch):
    from kelpie.operators import store as st

    monkeypatch.setattr(st, "MOST_SEGMENTS", 4)
    store = Store(spark, f"file://{tmp_path}")
    c = store.create("m", Options(dim=8))
    x = np.random.default_rng(3).standard_normal((1100, 8))
    c.ingest(frame(spark, (1, [doc(f"d{i % 50}", *[chunk(f"k{j}", "t", x[j].tolist()) for j in range(i, 1100, 50)]) for i in range(50)])))
    c.attach_index(8, 8)
    assert c.delete_document("d7") == 22
    c.patch_metadata("d8", {"a": 1})
    c.ingest(frame(spark, (2, [doc("d9", chunk("k9", "again", x[0].tolist()), chunk("new", None, x[1].tolist()), chunk("mute", "text only"))])))
    assert c.backfill(hashed(8)) == 1 and c.backfill(hashed(8)) == 0
    assert len(c.current["segments"]) <= 4 and c.records.count() == c.vecs.count() == 1100 - 22 + 2
    c.sync_index()
    assert {r.id for r in c.lists(c.current["index"]).collect()} == {r.id for r in c.vecs.collect()}
    assert [r.text for r in c.records.where("external_id = 'k9'").collect()] == ["again"]
    assert c.vacuum(3600) == 0 and c.vacuum(0) > 0 and c.records.count() == 1080
    c.ingest(frame(spark, (3, [doc("v", chunk("only", None, x[2].tolist()))])))
    c.commit(gone=c.records.where("external_id = 'only'").selectExpr("id", "true as vec"), records=c.records.where("external_id = 'only'"))
    with pytest.raises(ValueError, match="1 records have neither"):
        c.backfill(hashed(8))


def test_jobs_run_in_batches_with_barriers(spark, tmp_path):
    from kelpie.streaming.jobs import Jobs, turns

    store = Store(spark, f"file://{tmp_path}")
    c = store.create("q", Options(dim=8))
    waits = []
    jobs = Jobs(c, waits.append)
    for i in range(3):
        jobs.enqueue(frame(spark, (0, [doc(f"d{i}", chunk(f"c{i}", None if i == 1 else "t"))])))
    jobs.enqueue(op="attach_index", nlist=4)
    jobs.enqueue(frame(spark, (0, [doc("d0", chunk("c0", "newer"))])))
    with pytest.raises(ValueError):
        jobs.enqueue(op="reindex")
    once = c.ingest

    def failing(*a, **k):
        if len(waits) < 2:
            raise OSError("disk")
        return once(*a, **k)

    c.ingest = failing
    assert jobs.run(hashed(8)) == 5 and waits == [1.0, 2.0]
    assert [(jobs.job(i).status, jobs.job(i).error) for i in range(1, 6)] == [("done", None), ("error", "c1: needs a text or a vector"), ("done", None), ("error", "2 vectors are too few for 4 lists"), ("done", None)]
    assert {r.text for r in c.records.collect()} == {"t", "newer"}
    rows = [(i, "a", "Pending" if i % 2 else "processing", "x" if i in (3, 5) else None) for i in range(1, 13)] + [(13, "a", "done", None), (1, "a", "Pending", None)]
    df = spark.createDataFrame(rows, "id long, coll_name string, status string, payload string")
    got = {r.id: (r.turn, r.place) for r in turns(df, df.payload == "x", 4).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (2, 1), 4: (3, 1), 5: (4, 1), 6: (5, 1), 7: (5, 2), 8: (5, 3), 9: (5, 4), 10: (6, 1), 11: (6, 2), 12: (6, 3)}


def test_embedding_service(monkeypatch):
    import io
    import urllib.error
    import urllib.request

    from kelpie.sources.embed import endpoint

    def answer(request, timeout):
        if "bad" in request.full_url:
            raise urllib.error.HTTPError(request.full_url, 503 if "503" in request.full_url else 400, "no", {}, None)
        n = len(json.loads(request.data)["input"])
        return io.BytesIO(json.dumps({"data": [{"index": i, "embedding": [i]} for i in reversed(range(n))]}).encode())

    monkeypatch.setattr(urllib.request, "urlopen", answer)
    assert endpoint("http://h/v1")(["a", "b"]) == [[0], [1]]
    with pytest.raises(TryAgain):
        endpoint("http://bad503")(["a"])
    with pytest.raises(urllib.error.HTTPError):
        endpoint("http://bad400")(["a"])
