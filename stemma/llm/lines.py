"""Line dedup: hashes of overlapping three-line windows, counted globally; later occurrences go.

Only DataFrame functions are used. A window is two 64-bit hashes with different seeds, so that chance collisions
stay out of reach at any corpus size. Windows are counted with partial aggregation, and only those that occur twice
are joined back to their places: hot ones from a broadcast of bounded size, others by their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import materialize

WINDOW = 3
#: A window with more than 1/HOT_SHARE of the places of all repeated windows is hot; there are fewer than HOT_SHARE of them, whatever the data.
HOT_SHARE = 1000


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def _places(docs: DataFrame, size: int) -> DataFrame:
    """id, t (the text's hash), i, a, b: the windows that start at line i."""
    lines = docs.select(F.col("doc_id").alias("id"), F.xxhash64(_text(docs)).alias("t"), F.split(_text(docs), "\n", -1).alias("l"))

    def window(i: Column) -> Column:
        own = [F.get("l", i + k) for k in range(size)]
        return F.struct(F.xxhash64(F.lit(1), *own).alias("a"), F.xxhash64(F.lit(2), *own).alias("b"))

    starts = F.transform(F.sequence(F.lit(0), F.size("l") - size), window)
    return lines.where(F.size("l") >= size).select("id", "t", F.posexplode(starts).alias("i", "w")).select("id", "t", "i", "w.a", "w.b")


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_removed, text (the lines that stay, joined by line feeds).

    Lines end at "\\n". A window is `size` consecutive lines of one text; the first of equal windows is the one with
    the smallest (doc_id, line), ids that are null last, and every line that any other occurrence covers goes, in the
    same text too, overlapping or not. Texts of fewer lines stay as they are. A null or empty text is one empty line.
    Rows that repeat an id and text count as one place; rows that share only the id are told apart by their text.
    Other columns are ignored; an empty table gives an empty result.
    """
    places = _places(docs, size)
    at = F.struct(F.col("id").isNull().alias("n"), "id", "t", "i")
    found = places.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(at).alias("first")).where("c > 1")
    found = materialize(found, "repeated-windows")
    n = found.agg(F.sum("c")).first()[0] or 0
    later = ~F.struct(F.col("id").isNull().alias("n"), "id", "t", "i").eqNullSafe(F.col("first"))
    # fewer than HOT_SHARE rows, by the pigeonhole principle
    hot = F.broadcast(found.where(F.col("c") * HOT_SHARE > F.lit(n)).select("a", "b", "first"))
    cold = places.join(hot.select("a", "b"), ["a", "b"], "left_anti").join(found.select("a", "b", "first"), ["a", "b"])
    gone = places.join(hot, ["a", "b"]).unionByName(cold).where(later)
    starts = gone.groupBy("id", "t").agg(F.collect_set("i").alias("starts"))

    lines = F.split(_text(docs), "\n", -1)
    rows = docs.select(F.col("doc_id"), F.xxhash64(_text(docs)).alias("text_hash"), lines.alias("lines"))
    both = rows.join(starts, rows["doc_id"].eqNullSafe(starts["id"]) & (rows["text_hash"] == starts["t"]), "left")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + size - 1))))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.when(F.col("starts").isNull(), F.col("lines")).otherwise(F.transform(F.array_except(every, covered), lambda i: F.get("lines", i)))
    out = both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("text"))


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS i, unnest(l) AS line FROM t),
w AS (SELECT *, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3 FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id NULLS LAST, i) AS k FROM w WHERE l3 IS NOT NULL),
g AS (SELECT DISTINCT doc_id, i + d AS i FROM f, (VALUES (0), (1), (2)) x(d) WHERE k > 1),
k AS (SELECT p.doc_id, p.i, p.line, g.i IS NOT NULL AS gone FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
