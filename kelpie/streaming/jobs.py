"""A collection's job queue: ingest jobs in batches, index jobs as barriers between them.

Job numbers, kinds and statuses are small control data kept as texts in the store; payloads are Parquet files beside
them, written before a job is accepted.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.operators.store import Collection
from kelpie.session import release
from kelpie.streaming.ingest import FILES_AT_ONCE, statuses

OPEN, INDEX_JOBS = ("pending", "processing"), ("attach_index", "detach_index")
#: Seconds before a failed commit is tried again: the first wait, which doubles, and the longest.
FIRST_WAIT, LONGEST_WAIT = 1.0, 30.0


@dataclass
class Job:
    id: int
    op: str
    status: str = "pending"
    error: str | None = None
    options: dict | None = None


class Jobs:
    """One queue for each collection, worked off by one process at a time."""

    def __init__(self, collection: Collection, sleep: Callable[[float], None] = time.sleep):
        self.collection, self.sleep = collection, sleep

    def _read(self) -> list[Job]:
        text = self.collection.store.read_text(self.collection.name, "jobs.json")
        return [Job(**x) for x in json.loads(text or "[]")]

    def _save(self, *changed: Job) -> None:
        jobs = {j.id: j for j in self._read()} | {j.id: j for j in changed}
        self.collection.store.write_text(json.dumps([vars(j) for _, j in sorted(jobs.items())]), self.collection.name, "jobs.json")

    def _payload(self, job: Job) -> str:
        return f"{self.collection.store.root}/.payloads/{self.collection.name}/{job.id}"

    def enqueue(self, payload: DataFrame | None = None, op: str = "ingest", **options) -> int:
        """Accepts a payload (documents) or an index job; it is durable when the number comes back."""
        if op not in ("ingest", *INDEX_JOBS) or (op == "ingest") != (payload is not None):
            raise ValueError(f"not a job: {op!r}")
        job = Job(1 + max((j.id for j in self._read()), default=0), op, options=options)
        if payload is not None:
            payload.select("documents").write.mode("overwrite").parquet(self._payload(job))
        self._save(job)
        return job.id

    def job(self, number: int) -> Job | None:
        return next((j for j in self._read() if j.id == number), None)

    def _claim(self) -> list[Job]:
        """The lowest open job and those that may share its batch: an index job is alone, ingest jobs stop before one."""
        out: list[Job] = []
        for j in self._read():
            if j.status not in OPEN:
                continue
            if j.op in INDEX_JOBS:
                out = out or [j]
                break
            out.append(j)
            if len(out) == FILES_AT_ONCE:
                break
        for j in out:
            j.status = "processing"
        if out:
            self._save(*out)
        return out

    def run(self, embed=None) -> int:
        """Works off the queue in id order; the number of jobs finished. Jobs a crash left in processing come first.

        A bad payload ends as an error with its reason and leaves the others of its batch alone. Jobs are done only
        after the collection's new state is current; a commit that fails is tried again until it succeeds.
        """
        finished = 0
        while batch := self._claim():
            if batch[0].op in INDEX_JOBS:
                self._index_job(batch[0])
            else:
                self._ingest(batch, embed)
            self._save(*batch)
            finished += len(batch)
        return finished

    def _index_job(self, job: Job) -> None:
        try:
            if job.op == "attach_index":
                self.collection.attach_index(**(job.options or {}))
            else:
                self.collection.detach_index()
            job.status = "done"
        except (ValueError, KeyError) as e:
            job.status, job.error = "error", str(e)

    def _ingest(self, batch: list[Job], embed) -> None:
        spark = self.collection.store.spark
        rows = None
        for j in batch:
            own = spark.read.parquet(self._payload(j)).select(F.lit(j.id).cast("bigint").alias("ingest_id"), "documents")
            rows = own if rows is None else rows.unionByName(own)
        wrong = {r.ingest_id: r.error for r in statuses(rows, self.collection.options.dim).where("error is not null").collect()}  # a batch's jobs at most
        good = rows.where(~F.col("ingest_id").isin(list(wrong))) if wrong else rows
        wait = FIRST_WAIT
        while True:
            try:
                self.collection.ingest(good, "ingest_id", embed)
                break
            except OSError:
                self.sleep(wait)
                wait = min(2 * wait, LONGEST_WAIT)
        release(spark)
        for j in batch:
            j.status, j.error = ("error", wrong[j.id]) if j.id in wrong else ("done", None)


def turns(jobs: DataFrame, barrier: Column, at_once: int = FILES_AT_ONCE) -> DataFrame:
    """(id, coll_name, turn, place): the batch in which each open job of a collection is worked off, and its place in it.

    Jobs come by id; those for which ``barrier`` holds are alone in their batch, the others come ``at_once`` at a time.
    A status counts in any case; repeated rows count once.
    """
    own = jobs.where(F.lower("status").isin(*OPEN)).withColumn("_b", F.coalesce(barrier, F.lit(False)).cast("int")).dropDuplicates(["id"])
    before = Window.partitionBy("coll_name").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_run", 2 * F.sum("_b").over(before) - F.col("_b"))  # even between barriers, odd at one
    nth = F.row_number().over(Window.partitionBy("coll_name", "_run").orderBy("id")) - 1
    own = own.withColumn("_part", F.floor(nth / at_once)).withColumn("place", (nth % at_once + 1).cast("int"))
    turn = F.dense_rank().over(Window.partitionBy("coll_name").orderBy("_run", "_part"))
    return own.select("id", "coll_name", turn.alias("turn"), "place")
