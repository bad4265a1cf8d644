"""Durable ingest: a file stream of payloads, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kelpie.operators.store import Collection
from kelpie.session import release
from kelpie.sources.ingest import DOCUMENTS, flatten, problem

#: Files of a batch, and the pause between batches.
FILES_AT_ONCE, PAUSE = 8, "1 second"
SCHEMA = f"ingest_id bigint, documents {DOCUMENTS}"
JOBS = "ingest_id bigint, status string, error string, batch bigint, updated_at timestamp"


def statuses(payloads: DataFrame, dim: int) -> DataFrame:
    """(ingest_id, error): each payload of a batch and what is wrong with it, or null."""
    bad = flatten(payloads).withColumn("problem", problem(dim)).where("problem is not null").groupBy("ingest_id").agg(F.min(F.concat_ws(": ", "external_id", "problem")).alias("error"))
    empty = F.coalesce(F.size("documents") <= 0, F.lit(True))
    return payloads.select("ingest_id", empty.alias("empty")).groupBy("ingest_id").agg(F.min("empty").alias("empty")).join(bad, "ingest_id", "left").select("ingest_id", F.coalesce("error", F.when(F.col("empty"), "no document")).alias("error"))


def apply_batch(collection: Collection, batch: DataFrame, batch_id: int, jobs_path: str, embed=None) -> None:
    """Upserts the good payloads of a batch and writes every payload's status; a batch already applied is skipped.

    A bad payload is marked and leaves the others alone. Statuses are written after the collection's new version is
    current, under the batch's own folder, so that a replay overwrites them.
    """
    found = statuses(batch, collection.options.dim)
    good = batch.join(found.where("error is null").select("ingest_id"), "ingest_id", "left_semi")
    if collection.current["batch"] < batch_id:
        collection.ingest(good, "ingest_id", embed, batch_id)
    done = found.select("ingest_id", F.when(F.col("error").isNull(), "done").otherwise("error").alias("status"), "error", F.lit(batch_id).cast("bigint").alias("batch"), F.current_timestamp().alias("updated_at"))
    done.write.mode("overwrite").parquet(f"{jobs_path}/batch={batch_id}")


def start(collection: Collection, landing: str, checkpoint: str, jobs_path: str, embed=None, once: bool = False, format: str = "json") -> StreamingQuery:
    """Follows a folder of payload files. With ``once`` it takes what is there and ends."""
    spark = collection.store.spark
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", FILES_AT_ONCE).format(format).load(landing)

    def take(df: DataFrame, n: int) -> None:
        held = df.persist()
        try:
            apply_batch(collection, held, n, jobs_path, embed)
        finally:
            held.unpersist()
            release(spark)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=PAUSE)).start()


def jobs(collection: Collection, jobs_path: str) -> DataFrame:
    return collection.store.spark.read.schema(JOBS).parquet(jobs_path)


def open_jobs(jobs: DataFrame) -> DataFrame:
    """(coll_name, n): jobs that wait or are being worked on, a status counting in any case."""
    return jobs.where(F.lower("status").isin("pending", "processing")).groupBy("coll_name").agg(F.countDistinct("id").alias("n"))
