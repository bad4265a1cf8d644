"""Collections on a shared file system: segments of Parquet behind an atomic pointer.

A change appends a segment: new records, new vectors, and the ids it takes away. A row lives unless a later segment
takes its id away. So an upsert writes what it brings, not the whole collection; segments are merged once they are
many. The pointer file names the segments of the current state, and a reader keeps those it opened.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.metadata import fts_suffix
from kelpie.functions.vectors import fp16, l2norm
from kelpie.operators import ivf, listing, vector, writes
from kelpie.sources import ingest
from kelpie.sources.embed import embedded

RECORDS = "id bigint, external_id string, doc_id string, type string, position int, text string, metadata string, fts_metadata string, indexed int"
VECS = "id bigint, vec array<float>"
#: Ids a segment takes away; with vec, their vectors too.
GONE = "id bigint, vec boolean"
#: Segments of a collection, and parts of its lists, before they are merged.
MOST_SEGMENTS = 16


class Exists(ValueError):
    pass


class Missing(KeyError):
    pass


@dataclass
class Options:
    """What is fixed when a collection is made; dim is a positive multiple of 8, bit_width 2 or 4."""

    dim: int
    bit_width: int = 4
    tokenizer: str = "unicode61"
    fts_keys: list[str] = field(default_factory=list)
    model: str | None = None
    key_hash: str | None = None

    def __post_init__(self):
        if self.dim <= 0 or self.dim % 8:
            raise ValueError("dim is a positive multiple of 8")
        if self.bit_width not in (2, 4):
            raise ValueError("bit_width is 2 or 4")
        if self.tokenizer not in ("unicode61", "trigram"):
            raise ValueError("tokenizer is unicode61 or trigram")


class Store:
    """All collections under one root. One writer at a time; readers keep the version they opened."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def read_text(self, *parts: str) -> str | None:
        path = self._path(*parts)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, text: str, *parts: str) -> None:
        """Written beside, then renamed over: a reader sees the old or the new text."""
        beside = self._path(*parts[:-1], f".{parts[-1]}-{uuid.uuid4().hex}")
        stream = self.fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(beside, self._path(*parts), options)

    def names(self) -> list[str]:
        path = self._path()
        if not self.fs.exists(path):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(path) if x.isDirectory() and self.fs.exists(self._path(x.getPath().getName(), "options.json")))

    def create(self, name: str, options: Options) -> Collection:
        if self.read_text(name, "options.json") is not None:
            raise Exists(name)
        self.fs.delete(self._path(name), True)  # leftovers of a dropped collection never come back
        out = Collection(self, name, options)
        out.point({"seq": 0, "next_id": 1, "segments": [], "batch": -1, "index": None})
        self.write_text(json.dumps(asdict(options)), name, "options.json")
        return out

    def open(self, name: str) -> Collection:
        text = self.read_text(name, "options.json")
        if text is None:
            raise Missing(name)
        return Collection(self, name, Options(**json.loads(text)))

    def drop(self, name: str) -> None:
        self.open(name)
        self.fs.delete(self._path(name, "options.json"), False)
        self.fs.delete(self._path(name), True)


class Collection:
    def __init__(self, store: Store, name: str, options: Options):
        self.store, self.name, self.options = store, name, options

    # --- state

    @property
    def current(self) -> dict:
        return json.loads(self.store.read_text(self.name, "CURRENT"))

    def point(self, state: dict) -> None:
        self.store.write_text(json.dumps(state), self.name, "CURRENT")

    def _at(self, *parts: str) -> str:
        return "/".join((self.store.root, self.name, *parts))

    def _rows(self, kind: str, schema: str, state: dict) -> DataFrame:
        """All rows of a kind with the number of their segment."""
        spark, schema = self.store.spark, f"{schema}, _seq bigint"
        paths = [self._at(s["name"], kind) for s in state["segments"] if kind in s["has"]]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _live(self, kind: str, schema: str) -> DataFrame:
        state = self.current
        rows = self._rows(kind, schema, state)
        if any("gone" in s["has"] for s in state["segments"]):
            gone = self._rows("gone", GONE, state).where("vec" if kind == "vecs" else "true").select(F.col("id").alias("_id"), F.col("_seq").alias("_later"))
            rows = rows.join(gone, (F.col("id") == F.col("_id")) & (F.col("_seq") < F.col("_later")), "left_anti")
        return rows.drop("_seq")

    @property
    def records(self) -> DataFrame:
        return self._live("records", RECORDS)

    @property
    def vecs(self) -> DataFrame:
        return self._live("vecs", VECS)

    def commit(self, records: DataFrame | None = None, vecs: DataFrame | None = None, gone: DataFrame | None = None, **state) -> None:
        """Writes a segment, then moves the pointer; a failure in between changes nothing for readers."""
        now, name = self.current, uuid.uuid4().hex
        seq, has = now["seq"] + 1, []
        for kind, schema, rows in (("records", RECORDS, records), ("vecs", VECS, vecs), ("gone", GONE, gone)):
            if rows is not None:
                rows.select(*[c.split()[0] for c in schema.split(", ")], F.lit(seq).cast("bigint").alias("_seq")).write.parquet(self._at(name, kind))
                has.append(kind)
        self.point(now | {"seq": seq, "segments": [*now["segments"], {"name": name, "has": has}]} | state)
        if len(now["segments"]) >= MOST_SEGMENTS:
            self.compact()

    def compact(self) -> None:
        """Merges all segments into one. The lists take up what came and went first."""
        if self.current["index"]:
            self.sync_index()
        now, name = self.current, uuid.uuid4().hex
        for kind, rows in (("records", self.records), ("vecs", self.vecs)):
            rows.withColumn("_seq", F.lit(now["seq"]).cast("bigint")).write.parquet(self._at(name, kind))
        self.point(now | {"segments": [{"name": name, "has": ["records", "vecs"]}]})

    def vacuum(self, older_than: float = 3600.0) -> int:
        """Deletes folders that the current state doesn't name and that are older than so many seconds; their number."""
        now = self.current
        used = {s["name"] for s in now["segments"]}
        if now["index"]:
            used |= {p["at"] for p in now["index"]["parts"]} | {now["index"]["centroids"]}
        gone = 0
        for x in self.store.fs.listStatus(self.store._path(self.name)):
            if x.isDirectory() and x.getPath().getName() not in used and x.getModificationTime() / 1000 <= time.time() - older_than:
                self.store.fs.delete(x.getPath(), True)
                gone += 1
        return gone

    # --- writing

    def ingest(self, payloads: DataFrame, order: str = "ingest_id", embed=None, batch: int | None = None) -> None:
        """Upserts the records of payloads. Vectors are given or made by ``embed``; they are stored in half precision.

        New ids are never those of earlier records, also deleted ones. The incoming rows are numbered once, so records
        and vectors have the same ids.
        """
        flat = ingest.validated(ingest.flatten(payloads, order), self.options.dim)
        if embed is not None:
            lacking = flat.where(F.coalesce(F.size("vector") <= 0, F.lit(True)) & F.col("text").isNotNull())
            made = embedded(lacking.withColumn("_key", F.concat_ws("\x1f", order, "external_id")), embed, key="_key").withColumnRenamed("vec", "_vec")
            flat = flat.withColumn("_key", F.concat_ws("\x1f", order, "external_id")).join(made, "_key", "left").withColumn("vector", F.coalesce("_vec", "vector")).drop("_vec", "_key")
        keys, now = self.options.fts_keys, self.current
        flat = flat.withColumn("fts_metadata", fts_suffix(keys)(F.col("metadata")) if keys else F.lit(None).cast("string")).withColumn("indexed", F.lit(1))
        new = writes.fresh(flat, [order, "place", "external_id"], now["next_id"] - 1)
        vectors = new.where("size(vector) > 0").withColumn("vec", fp16(l2norm(F.col("vector")).cast("array<float>")))
        replaced = self.records.select("id", "external_id").join(new.select("external_id"), "external_id", "left_semi").select("id", F.lit(True).alias("vec"))
        top = new.agg(F.max("id")).first()[0] or now["next_id"] - 1
        self.commit(new, vectors, replaced, next_id=top + 1, batch=now["batch"] if batch is None else batch)

    def delete_document(self, doc_id: str) -> int:
        """The number of records deleted."""
        gone = self.records.where(F.col("doc_id") == doc_id).select("id", F.lit(True).alias("vec"))
        n = gone.count()
        if n:
            self.commit(gone=gone)
        return n

    def patch_metadata(self, doc_id: str, patch: dict, apply_to_chunks: bool = True) -> int:
        """The number of records patched; Missing if the document has none. Only these records are written."""
        own = self.records.where(writes.of_document(doc_id, apply_to_chunks))
        n = own.count()
        if not n:
            raise Missing(doc_id)
        self.commit(writes.patch(own, patch, F.lit(True), self.options.fts_keys), gone=own.select("id", F.lit(False).alias("vec")))
        return n

    def backfill(self, embed) -> int:
        """Makes the vectors that records lack; their number. ValueError with a count if some have no text either."""
        lacking = ivf.missing(self.records.where("indexed = 1"), self.vecs).select("id", "text")
        n, mute = lacking.agg(F.count("*"), F.sum((F.coalesce(F.col("text"), F.lit("")) == "").cast("int"))).first()
        if mute:
            raise ValueError(f"{mute} records have neither a vector nor a text")
        if n:
            made = embedded(lacking, embed).select("id", fp16(l2norm(F.col("vec")).cast("array<float>")).alias("vec"))
            self.commit(vecs=made)
            state = self.current
            if state["index"]:
                late = self._rows("vecs", VECS, state).where(F.col("_seq") == state["seq"]).where(F.col("id") <= state["index"]["top"])
                self._add_part(late.drop("_seq"), state["index"], [])
        return n

    # --- reading

    def list(self, **options) -> tuple[DataFrame, DataFrame]:
        return listing.listed(self.records, **options)

    def stats(self) -> DataFrame:
        return listing.stats(self.records)

    # --- lists

    def attach_index(self, nlist: int | None = None, nprobe: int = ivf.NPROBE) -> None:
        """Trains lists and writes vectors by list; an attached index of the same size is only retuned."""
        now = self.current
        if now["index"] and nlist in (None, now["index"]["nlist"]):
            self.point(now | {"index": now["index"] | {"nprobe": nprobe}})
            return
        vecs = self.vecs
        centroids = ivf.train(vecs, nlist, self.options.dim)
        place = uuid.uuid4().hex
        ivf.centroid_table(vecs, centroids).write.parquet(self._at(place))
        self._add_part(vecs, {"nlist": len(centroids), "nprobe": nprobe, "centroids": place, "parts": []}, [])

    def _add_part(self, vecs: DataFrame, index: dict, dirty: list[int], kept: DataFrame | None = None) -> None:
        """Appends vectors to the lists, and takes the lists ``dirty`` from ``kept`` instead of from the parts so far."""
        now, place = self.current, uuid.uuid4().hex
        rows = ivf.assign(vecs, self._centroids(index), self.options.dim)
        if kept is not None:
            rows = rows.unionByName(kept)
        # a list that is larger than others is written by several tasks
        rows.hint("rebalance", "list_id").write.partitionBy("list_id").parquet(self._at(place))
        parts = [p | {"without": sorted({*p["without"], *dirty})} for p in index["parts"]]
        self.point(now | {"index": index | {"parts": [*parts, {"at": place, "without": []}], "top": now["next_id"] - 1, "seq": now["seq"]}})

    def _centroids(self, index: dict) -> np.ndarray:
        rows = self.store.spark.read.parquet(self._at(index["centroids"])).orderBy("list_id").toArrow()
        return np.array(rows.column("centroid").to_pylist(), np.float64)

    def lists(self, index: dict) -> DataFrame:
        """(id, vec, list_id) of all parts; ids that went since are still in it."""
        schema = "id bigint, vec array<double>, list_id int"
        out = self.store.spark.createDataFrame([], schema)
        for p in index["parts"]:
            rows = self.store.spark.read.schema(schema).parquet(self._at(p["at"]))
            out = out.unionByName(rows.where(~F.col("list_id").isin(p["without"])) if p["without"] else rows)
        return out

    def _ghosts(self, state: dict) -> DataFrame:
        """(id) taken away since the lists were brought up to date."""
        return self._rows("gone", GONE, state).where("vec").where(F.col("_seq") > state["index"]["seq"]).select("id").distinct()

    def sync_index(self) -> None:
        """Brings the lists up to date: new vectors are appended, and only lists that hold ids of deleted records are rewritten."""
        now = self.current
        index = self._attached(now)
        lists, ghosts = self.lists(index), self._ghosts(now)
        dirty = [r.list_id for r in lists.join(ghosts, "id", "left_semi").select("list_id").distinct().collect()]  # nlist at most
        if len(index["parts"]) >= MOST_SEGMENTS:
            dirty = list(range(index["nlist"]))
        kept = lists.where(F.col("list_id").isin(dirty)).join(ghosts, "id", "left_anti").select("id", "list_id", "vec") if dirty else None
        self._add_part(self.vecs.where(F.col("id") > index["top"]), index, dirty, kept)

    def detach_index(self) -> None:
        now = self.current
        self._attached(now)
        self.point(now | {"index": None})

    def _attached(self, state: dict) -> dict:
        if not state["index"]:
            raise Missing("no index")
        return state["index"]

    def indexed_search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """Search in the lists; vectors that came after the index was made are searched exactly beside them."""
        now = self.current
        index = self._attached(now)
        centroids = self.store.spark.read.parquet(self._at(index["centroids"]))
        lists = self.lists(index)
        if any("gone" in s["has"] for s in now["segments"]):
            lists = lists.join(self._ghosts(now), "id", "left_anti")
        late = self.vecs.where(F.col("id") > index["top"])
        if allowed is not None:
            late = late.join(allowed.select("id").distinct(), "id", "left_semi")
        old = ivf.search(queries, lists, centroids, k, nprobe or index["nprobe"], allowed, self.options.dim)
        return vector.ranked(old.unionByName(vector.top_k(queries, late, k, self.options.dim)).drop("rank"), k, F.col("id").asc())
