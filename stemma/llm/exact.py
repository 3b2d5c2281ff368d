"""Exact dedup: a persistent digest index, bucketed and sorted by hash, and a sort-merge anti-join.

Two texts are equal when they are identical after every character of SPACES is deleted. Only DataFrame functions
are used. Texts never leave the first map: 64 hex digits, an id and a length per row are all that is shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import discard, fresh, materialize, remove, shared_path

#: Deleted before hashing: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"

#: A digest with more than 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE of them, whatever the data.
HOT_SHARE = 1000


def digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        F.sha2(F.translate(text, SPACES, ""), 256).alias("text_sha256"),
        F.char_length(text).cast("long").alias("n_points"),
    )


class DigestIndex:
    """Digests seen so far, as a Parquet table at a path, in hash buckets sorted by digest.

    The bucket count belongs to the path: it is written beside the data, and another one is an error. Appending is
    idempotent per batch name: a repeated batch finds its own digests there and adds none.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self._settle()
        self.name = "stemma_digests_" + hashlib.md5(f"{path}|{buckets}".encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (text_sha256 STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def _settle(self) -> None:
        """Records the bucket count in a file beside the data, or compares it with the one there."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.path.rstrip("/") + "/_buckets")
        fs = at.getFileSystem(conf)
        if fs.exists(at):
            there = fs.open(at)
            try:
                held = int(there.readUTF())
            finally:
                there.close()
            if held != self.buckets:
                raise ValueError(f"the index at {self.path} has {held} buckets, not {self.buckets}")
        else:
            out = fs.create(at)
            out.writeUTF(str(self.buckets))
            out.close()

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds the digests of groups (text_sha256, keep_id) that the index lacks: a sort-merge anti-join by bucket."""
        fresh = groups.join(self.read().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        fresh = fresh.select("text_sha256", "keep_id", F.lit(batch).alias("batch"))
        fresh.repartition(self.buckets, "text_sha256").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str = "0") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256; new digests go into the index.

    Of equal texts the one with the most code points, then the smallest doc_id stays. A text that an earlier batch
    of the index has is dropped; its keep_id is the earlier row's. group_size counts rows of this batch. Null texts
    are empty texts, which equal one another. A null doc_id loses every tie; it is kept, with a null keep_id, only if all
    equal rows lack ids. Rows repeated with the same doc_id and the same text are all marked kept if one is (their ids
    can't tell them apart). An empty table gives an empty result. Other columns are ignored.

    A hot digest (over 1/HOT_SHARE of the rows, so fewer than HOT_SHARE of them) is looked up in a broadcast; all
    others by a sort-merge join. Counts are combined before the shuffle.
    """
    spark = docs.sparkSession
    if index is None:
        index = DigestIndex(spark, shared_path(spark, "digests"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(digests(docs), "exact-rows")
    best = F.min(F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("id")))
    groups = rows.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("text_sha256", F.col("best.id").cast("long").alias("keep_id"), "group_size")
    mine = materialize(groups, "exact-groups")
    index.append(mine, batch)

    known = index.read().select("text_sha256", F.col("keep_id").alias("index_id"), (F.col("batch") == batch).alias("fresh"))
    decided = mine.join(known.hint("merge"), "text_sha256").select("text_sha256", F.col("index_id").alias("keep_id"), "group_size", "fresh")
    n = rows.count()
    # fewer than HOT_SHARE rows by the pigeonhole principle
    hot = F.broadcast(decided.where(F.col("group_size") * HOT_SHARE > F.lit(n)))
    cold = rows.join(hot.select("text_sha256"), "text_sha256", "left_anti").join(decided.hint("merge"), "text_sha256")
    out = rows.join(hot, "text_sha256").unionByName(cold).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
    out.stemma_reads = (rows, mine)  # these can go once out has been written
    return out


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup() keeps, all columns; repeated rows of one id and text give one row."""
    spark = docs.sparkSession
    index = DigestIndex(spark, shared_path(spark, "digests"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    judged = exact_dedup(docs, index)
    verdict = materialize(judged, "exact-verdict")
    discard(*judged.stemma_reads)
    index.drop()
    i, sha, n, row = (fresh(docs, x) for x in ("id", "sha", "n", "row"))
    kept = verdict.where("kept").select(F.col("doc_id").alias(i), F.col("text_sha256").alias(sha))
    repeats = kept.groupBy(i, sha).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).limit(1).count()
    text = F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), SPACES, ""), 256)
    out = docs.join(kept.distinct(), F.col("doc_id").eqNullSafe(F.col(i)) & (text == F.col(sha)), "left_semi")
    # equal ids and equal texts; rows may still differ in the white space of their texts, and the longest stays
    if repeats:
        packed = out.select("doc_id", text.alias(sha), F.length(F.coalesce("text", F.lit(""))).alias(n), F.struct(*[f"`{c}`" for c in docs.columns]).alias(row))
        out = packed.groupBy("doc_id", sha).agg(F.max_by(row, n).alias(row)).select(f"{row}.*")
    return out


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, length(text) AS n, sha256(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256 FROM t),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
      count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
