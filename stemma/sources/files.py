"""Readers and sinks: JSON, JSON lines with line-numbered errors, file hashes, audit logs, guarded writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.text import audited_axioms, bare_hash
from stemma.session import ship

# The keys whose strings are paths.
PATH_KEYS = (
    "canonical_artifact", "artifacts", "source_hashes", "anchors", "statements", "symbols", "chains", "records", "formalization_contract",
    "verification_partition", "assumption_match", "exports", "unresolved",
)


def read_json(spark: SparkSession, path, schema: str) -> DataFrame:
    """One object for each file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path, schema: str) -> DataFrame:
    """One object for each line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_checked(spark: SparkSession, path, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows with file and line, and errors (file, line, raw) of lines that aren't objects of the schema."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line", "raw"))
    rows = text.where(F.trim("raw") != "").withColumn("line", F.col("line") + 1)
    parsed = rows.withColumn("r", F.from_json("raw", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where("r._bad is null").select("file", "line", "r.*").drop("_bad")
    return good, parsed.where("r is null or r._bad is not null").select("file", "line", "raw")


def last_of_duplicates(rows: DataFrame, key: str = "id") -> DataFrame:
    """Of rows (file, line, ...) with one key the last by file and line."""
    at = F.struct("file", "line")
    last = rows.groupBy(key).agg(F.max(at).alias("__at"))
    return rows.join(last, key).where(at == F.col("__at")).drop("__at")


def file_hashes(spark: SparkSession, path) -> DataFrame:
    """path, length, sha256 of each file below, however many globs name it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256")).dropDuplicates(["path"])


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """algorithm, path, sha256 from maps of hashes, tagged or bare."""
    return manifests.select("algorithm", F.explode("hashes").alias("path", "tagged")).select("algorithm", "path", bare_hash(F.col("tagged")).alias("sha256"))


def missing_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    return entries.select("path").join(files, "path", "left_anti")


def stale_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """path, expected, actual where a file's hash isn't the manifest's."""
    both = entries.select("path", F.col("sha256").alias("expected")).join(files.select("path", F.col("sha256").alias("actual")), "path")
    return both.where("expected <> actual")


def audit_entries(lines: DataFrame) -> DataFrame:
    """declaration, axiom from captured lines (value) of the form 'name' depends on axioms: [a, b]."""
    hit = lines.where(F.col("value").rlike(r"^'[^']+' depends on axioms:"))
    return hit.select(F.regexp_extract("value", r"^'([^']+)' depends on axioms:", 1).alias("declaration"), F.explode_outer(audited_axioms(F.col("value"))).alias("axiom"))


def leaf_paths(documents: DataFrame, keys: tuple[str, ...] = PATH_KEYS) -> DataFrame:
    """file, value: the strings of JSON documents (file, raw) that stand under one of the keys, directly or in lists.

    A string belongs to the closest key above it; what isn't JSON has none. Documents are walked without recursion.
    """

    def walk(raw: str | None):
        import json

        try:
            stack = [(None, json.loads(raw or "null"))]
        except ValueError:
            return
        while stack:
            key, value = stack.pop()
            if isinstance(value, dict):
                stack.extend(reversed(list(value.items())))
            elif isinstance(value, list):
                stack.extend((key, x) for x in reversed(value))
            elif isinstance(value, str) and key in keys:
                yield value

    def batches(rows):
        import pyarrow as pa

        for batch in rows:
            found = [list(walk(x)) for x in batch.column(1).to_pylist()]
            names = [f for f, them in zip(batch.column(0).to_pylist(), found, strict=True) for _ in them]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([v for them in found for v in them], pa.string())], names=["file", "value"])

    ship(documents.sparkSession)
    return documents.selectExpr("cast(file as string) file", "raw").mapInArrow(batches, "file string, value string")


def inside(root: str, path: str) -> str:
    """path, if it is below root and isn't root; else a ValueError."""
    import os

    top, full = os.path.realpath(root), os.path.realpath(path)
    if full == top or not full.startswith(top + os.sep):
        raise ValueError(f"{path} is not below {root}")
    return full


def write_json(df: DataFrame, path: str) -> None:
    """Overwrites path with JSON lines, keys in sorted order."""
    df.select(*[f"`{c}`" for c in sorted(df.columns)]).write.mode("overwrite").json(path)
