"""What the text operators share: reading tables, the shared folder, cutting lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and there is no cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_STORED: list[str] = []  # folders that are there


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as Parquet (zstd) and read again: cuts the lineage, and later scans prune columns.

    The files go by settled(), or when the driver's JVM ends, as results may be read from them until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    fs, at = _folder(spark, path)
    fs.deleteOnExit(at)
    df.write.option("compression", "zstd").parquet(path)
    _STORED.append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def settled(spark: SparkSession, make: Callable[[], DataFrame], *used: DataFrame) -> DataFrame:
    """What make gives, stored; then the tables that were stored on the way, and those of used, are deleted."""
    old = [path for df in used if (path := getattr(df, "_stored_at", None)) in _STORED]
    before = len(_STORED)
    found = stored(make())
    for path in old + _STORED[before:-1]:
        fs, at = _folder(spark, path)
        fs.delete(at, True)
        _STORED.remove(path)
    return found


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now: its cleaner waits for the JVM's garbage collection.

    Only for the disk's sake; spark.brindle.release = false leaves the files until the collector comes.
    """
    if spark.conf.get("spark.brindle.release", "true") != "true":
        return
    spark.range(1).collect()  # the session holds on to its latest plan
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """rows in n partitions by the number in their column bucket, as evenly as the buckets themselves: hashing would put several in one."""
    return rows.repartitionById(n, F.pmod(F.col("bucket"), F.lit(n)).cast("int"))
