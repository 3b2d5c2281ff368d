"""Sessions, and cutting lineage in storage that executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[*]", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a folder of our own in local mode; on a cluster an
    error, as executors would each write to their own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="stemma-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Each value in its own bytes. Before a query runs the planner goes by the bytes of files, and of sorted ids packed files have one or two a row:
#: it would send millions of rows through the driver.
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}


def cut(df: DataFrame, tag: str = "cut", path: str | None = None) -> DataFrame:
    """Writes df into the shared folder and reads it again: the lineage ends there. Without a path the files are as large as their rows."""
    spark, options = df.sparkSession, {} if path else PLAIN
    path = path or f"{shared_dir(spark)}/stemma/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stemma_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame | None) -> None:
    """Deletes what cut() wrote, once nothing reads it any more."""
    for df in frames:
        if path := getattr(df, "stemma_path", None):
            remove(df.sparkSession, path)


def some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_stemma_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="stemma-code-"), "stemma.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    context.addPyFile(path)
    context._stemma_shipped = True
