"""Append-only revisions, receipts and reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.session import cut


def latest(revisions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last revision of each key. The order's columns are compared by a partial aggregate, not by sorting each key's rows."""
    at = F.struct(*order)
    rest = F.struct(*revisions.columns)
    return revisions.groupBy(key).agg(F.max_by(rest, at).alias("r")).select("r.*")


def local_delta(needed: DataFrame, reused: DataFrame) -> DataFrame:
    return needed.select("id").distinct().exceptAll(reused.select("id").distinct())


def next_frontier(open_: DataFrame, resolved: DataFrame, new: DataFrame) -> DataFrame:
    """(open without resolved) and new."""
    return open_.select("id").join(resolved.select("id"), "id", "left_anti").unionByName(new.select("id")).distinct()


def reusable(**conditions: Column) -> Column:
    """All conditions known and true."""
    out = F.lit(True)
    for c in conditions.values():
        out = out & F.coalesce(c, F.lit(False))
    return out


def same_major(a: Column, b: Column) -> Column:
    """Versions that don't break one another: equal first numbers, and the second not older."""
    x, y = F.split(a, r"\.").cast("array<int>"), F.split(b, r"\.").cast("array<int>")
    return (F.get(x, F.lit(0)) == F.get(y, F.lit(0))) & (F.get(x, F.lit(1)) >= F.get(y, F.lit(1)))


def review_queue(items: DataFrame, *criteria: str) -> DataFrame:
    """Highest criteria first, in their order; ties by id."""
    return items.orderBy(*[F.col(c).desc() for c in criteria], "id")


def ranked(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the rank of a key that all differ in, from 1. Ranges of keys are numbered side by side; only their sizes meet in one task."""
    parts = cut(rows.repartitionByRange(F.col(key)).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return parts.withColumn(name, own).join(F.broadcast(before), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")
