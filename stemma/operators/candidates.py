"""Claim candidates in texts, features of pairs of claims, and measures of predicted steps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.session import ship

#: Environments whose bodies are candidates, and phrases that make a line one.
ENVIRONMENTS = ("theorem", "lemma", "proposition", "corollary", "definition", "conjecture", "claim", "assumption")
PHRASES = ("we prove", "we show", "it follows that", "we assume", "suppose that", "we conclude")
HEADING = re.compile(r"\\((?:sub){0,2})section\*?\{([^}]*)\}|(#{1,3}) +(.*)")


def spans(text: str, environments: tuple[str, ...], phrases: tuple[str, ...]):
    """kind, line, start, end, section of each candidate, by the line it starts in; one pass over the lines.

    An environment goes from its \\begin to the first \\end of its name, or to the end of the text; inside it no phrase counts.
    """
    opens = re.compile(r"\\begin\{(" + "|".join(map(re.escape, environments)) + r")\*?\}")
    path, at, inside = [], 0, None
    for k, line in enumerate(text.split("\n")):
        if inside is None and (head := HEADING.match(line.strip())):
            depth = len(head[1]) // 3 if head[2] is not None else len(head[3]) - 1
            path = path[:depth] + [""] * (depth - len(path)) + [(head[2] if head[2] is not None else head[4]).strip()]
        elif inside is None and (hit := opens.search(line)):
            inside = (hit[1], k, at + hit.start(), "/".join(path))
        elif inside is None and any(p in line.lower() for p in phrases):
            yield "phrase", k, at, at + len(line), "/".join(path)
        if inside is not None and (close := re.search(r"\\end\{" + re.escape(inside[0]) + r"\*?\}", line)):
            yield inside[0], inside[1], inside[2], at + close.end(), inside[3]
            inside = None
        at += len(line) + 1
    if inside is not None:
        yield inside[0], inside[1], inside[2], len(text), inside[3]


def candidates(docs: DataFrame, environments: tuple[str, ...] = ENVIRONMENTS, phrases: tuple[str, ...] = PHRASES) -> DataFrame:
    """id, kind, line, start, end, section, content_hash of the candidates of docs (id, text). Places count code points from 0.

    A text's places need its lines in order, so each text is read where it is, in Arrow batches, without an exchange. Null has none.
    """
    lower = tuple(p.lower() for p in phrases)

    def read(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                whole = text.as_py() or ""
                found = list(spans(whole, environments, lower))
                if found:
                    kind, line, start, end, section = zip(*found, strict=True)
                    hashes = [hashlib.sha256(whole[a:b].encode("utf-8", "surrogatepass")).hexdigest() for a, b in zip(start, end, strict=True)]
                    ids = pa.array([i.as_py()] * len(found), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(kind), pa.array(line, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(section), pa.array(hashes)], names=["id", "kind", "line", "start", "end", "section", "content_hash"])

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["id"]
    return docs.select("id", "text").mapInArrow(read, f"id {kind}, kind string, line long, start long, end long, section string, content_hash string")


def overlap(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays as sets; 0 of two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def features(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """src, dst, shared, likeness, same_section, cites of pairs (src, dst) of claims (id, symbols, section, citations)."""
    a = claims.select(F.col("id").alias("src"), F.col("symbols").alias("s1"), F.col("section").alias("h1"))
    b = claims.select(F.col("id").alias("dst"), F.col("symbols").alias("s2"), F.col("section").alias("h2"), "citations")
    both = pairs.join(a, "src").join(b, "dst")
    return both.select(
        "src", "dst", F.size(F.array_intersect("s1", "s2")).alias("shared"), overlap(F.col("s1"), F.col("s2")).alias("likeness"),
        F.coalesce(F.col("h1") == F.col("h2"), F.lit(False)).alias("same_section"), F.coalesce(F.array_contains("citations", F.col("src")), F.lit(False)).alias("cites"),
    )


def step_measures(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """steps, found, exact, input_f1 over gold steps (output, inputs): the share whose inputs are predicted exactly, and the mean F1 of their
    inputs as sets. A step that isn't predicted counts 0; of several predictions for one output, the one with the best F1 counts."""
    p = predicted.select("output", F.array_distinct("inputs").alias("said"))
    steps = gold.groupBy("output", F.array_sort(F.array_distinct("inputs")).alias("inputs")).agg(F.count(F.lit(1)).alias("n"))
    total = F.size("inputs") + F.size("said")
    f1 = F.when(F.col("said").isNull(), 0.0).when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect("inputs", "said")) / total)
    best = steps.join(p, "output", "left").groupBy("output", "inputs").agg(F.first("n").alias("n"), F.max(f1).alias("f1"), F.max(F.col("said").isNotNull()).alias("found"))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = best.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("steps"), of(F.col("found")).alias("found"), of(F.col("f1") == 1.0).alias("hits"), F.sum(F.col("f1") * F.col("n")).alias("f"))
    return out.select("steps", "found", F.try_divide("hits", "steps").alias("exact"), F.try_divide("f", "steps").alias("input_f1"))
