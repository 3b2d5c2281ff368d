"""What the operators share: reading tables, shared storage, Arrow batch bounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stemma.session import cut, discard, remove, shared_dir, ship

__all__ = ["bound_arrow", "discard", "fresh", "materialize", "remove", "shared_path", "table"]

#: Rows and bytes of one Arrow batch between the JVM and Python, so that long texts don't add up to a large batch.
ARROW_ROWS = 512
ARROW_BYTES = 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_arrow(spark: SparkSession) -> None:
    """Bounds what Python workers receive at once, and sends them this package. These settings change no result."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/stemma/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: a cut in the lineage that outlives executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, tag)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # once it is written, the files of its exchanges can go
    try:
        out = cut(df, path=path)
    finally:
        spark.conf.set(CLEANUP, before)
    out.stemma_path = path
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have; names differ by case at least as much as Spark asks."""
    taken, out = {c.lower() for c in df.columns}, f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out
