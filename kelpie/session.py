"""Sessions and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Intermediate tables of this process that still exist.
_TABLES: list[str] = []


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, as the cluster names it.

    A session on one machine (a local master) that names none gets a temporary folder; on a cluster that is an error,
    because no folder of one machine is seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            named = known.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            named = tempfile.mkdtemp(prefix="kelpie-")
            spark.sparkContext.setCheckpointDir(named)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read back: its lineage is cut there.

    Used where several stages read one intermediate result; a lost executor costs nothing that was written. The table
    is deleted by ``release`` or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the intermediate tables written so far, once no result that reads them is needed; their number."""
    n = len(_TABLES)
    while _TABLES:
        place = spark._jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return n
