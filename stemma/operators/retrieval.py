"""Lexical and dense retrieval, fusion, splits and their measures."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.session import ship

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, id, score, rank: the best k documents (id, text) for each query (query, text). Only terms of queries are kept of the
    documents, so what is joined is a few rows each."""
    asked = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    sized = docs.select("id", tokens(F.col("text")).alias("t")).select("id", F.size("t").alias("len"), "t")
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).first()
    n, avg = stats["n"], float(stats["avg"] or 1.0)
    tf = sized.select("id", "len", F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg))
    scored = asked.join(tf, "term").join(df, "term").groupBy("query", "id").agg(F.round(F.sum(weight), 6).alias("score"))
    return top(scored, "query", k)


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k best by score, ties by id. Ranked groups are cut before the exchange by Catalyst's group limit."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _matrix(rows):
    """Ids, vectors as doubles and which of them can be compared, of an Arrow array of structs (id, v); the length is that of most."""
    import numpy as np

    ids, vs = rows.field(0).to_numpy(zero_copy_only=False), rows.field(1)
    sizes = np.array([-1 if n is None else n for n in vs.value_lengths().to_pylist()], np.int64)
    d = int(np.bincount(sizes[sizes >= 0]).argmax()) if (sizes >= 0).any() else 0
    if (sizes == d).all() and not vs.flatten().null_count:
        return ids, vs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d), np.ones(len(ids), bool)
    lists = vs.to_pylist()
    ok = np.array([v is not None and len(v) == d and None not in v for v in lists])
    return ids, np.array([v if good else [0.0] * d for v, good in zip(lists, ok, strict=True)], np.float64).reshape(-1, d), ok


def _nearest(batches, k: int):
    """Rows (qs, vs) are a block of queries and one of vectors: the pairs that can be among a query's best k, with their cosine."""
    import numpy as np
    import pyarrow as pa

    def dot(x, y):  # term by term, as cosine() adds
        return np.add.accumulate(x * y, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))

    for batch in batches:
        for n in range(batch.num_rows):
            (qi, q, q_ok), (vi, v, v_ok) = (_matrix(batch.column(c)[n].values) for c in (0, 1))
            if q.shape[1] != v.shape[1]:
                q, v, q_ok, v_ok = q[:, :0], v[:, :0], q_ok & False, v_ok & False
            with np.errstate(all="ignore"):
                near = (q @ v.T) / np.sqrt(np.einsum("ij,ij->i", q, q)[:, None] * np.einsum("ij,ij->i", v, v))
            other, sure = qi[:, None] != vi[None, :], q_ok[:, None] & v_ok[None, :]
            known = np.where(other & sure & np.isfinite(near), near, -np.inf)
            # equal when rounded to six digits, they are told apart by id: so all that are as near as the k-th, and a little beyond
            least = np.partition(known, -k, axis=1)[:, -k] if known.shape[1] > k else np.full(len(qi), -np.inf)
            i, j = np.nonzero(other & ((known >= least[:, None] - 4e-6) & (known > -np.inf) | ~(sure & np.isfinite(near))))
            with np.errstate(all="ignore"):
                base = dot(q, q)[i] * dot(v, v)[j]
                score = np.concatenate([dot(q[i[x : x + 65536]], v[j[x : x + 65536]]) for x in range(0, max(1, len(i)), 65536)]) / np.sqrt(base)
            none = ~(q_ok[i] & v_ok[j]) | (base == 0)
            yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(vi[j]), pa.array(score, mask=none)], names=["query", "id", "score"])


def dense(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """query, id, score, rank: the k nearest of vectors (id, v) for each of the stated queries (query, v), others than itself.

    Blocks of queries meet blocks of vectors, each pair of blocks in one task, which multiplies them as matrices and keeps what can be among
    the best k, with exact cosines. Rows that can't be compared (missing or of another length) have no score."""
    ship(vectors.sparkSession)
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))

    def packed(rows: DataFrame, key: str, v: str, name: str, least: int) -> tuple[DataFrame, int]:
        rows = rows.where(F.col(key).isNotNull())
        n = max(least, -(-rows.count() // block))
        return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("part")).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(v).alias("v"))).alias(name)).select(name), n

    asked, n = packed(queries, "query", "v", "qs", 1)
    held, _ = packed(vectors, "id", "v", "vs", 1)
    both = asked.repartition(min(n, 8)).hint("shuffle_replicate_nl").crossJoin(held)
    kinds = dict(queries.dtypes)["query"], dict(vectors.dtypes)["id"]
    got = both.mapInArrow(partial(_nearest, k=k), f"query {kinds[0]}, id {kinds[1]}, score double")
    return top(got.withColumn("score", F.round("score", 6)), "query", k)


def fuse(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query, id, rank)."""
    every = rankings[0].select("query", "id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query", "id", "rank"))
    return every.groupBy("query", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))


def recall_mrr(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """recall (of relevant rows within k) and mrr over the queries that have a relevant row (query, id)."""
    hits = relevant.join(ranked.where(F.col("rank") <= k), ["query", "id"], "left")
    each = hits.groupBy("query").agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("r"), F.coalesce(F.max(1.0 / F.col("rank")), F.lit(0.0)).alias("m"))
    return each.agg(F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg("m"), 6).alias("mrr"), F.count(F.lit(1)).alias("queries"))


def recall_mrr_by_label(ranked: DataFrame, labels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """recall_mrr() where all others (id, label) of the label of a query (query, label) are relevant: they are counted by label, not paired."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    own = labels.groupBy(F.col("id").alias("query"), "label").agg(F.count(F.lit(1)).alias("own"))
    asked = queries.join(sizes, "label").join(own, ["query", "label"], "left").select("query", "label", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")
    hits = ranked.where(F.col("rank") <= k).select("query", "id", "rank").join(labels.select("id", "label"), "id")
    hits = hits.groupBy("query", "label").agg(F.count(F.lit(1)).alias("hits"), F.max(1.0 / F.col("rank")).alias("m"))
    each = asked.join(hits, ["query", "label"], "left").select((F.coalesce("hits", F.lit(0)) / F.col("n")).alias("r"), F.coalesce("m", F.lit(0.0)).alias("m"))
    return each.agg(F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg("m"), 6).alias("mrr"), F.count(F.lit(1)).alias("queries"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, confidence, accuracy of rows (p, y): reliability by equal bins."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg(F.col("y").cast("double")).alias("accuracy"))


def ece_brier(rows: DataFrame, bins: int = 10) -> DataFrame:
    per = calibration(rows, bins).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))
    brier = rows.agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("brier"))
    return per.join(brier, F.lit(True)).select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


def temperature(rows: DataFrame, grid: list[float]) -> DataFrame:
    """t, loss for each temperature over rows (logit, y): one pass, a column each."""
    def loss(t: float) -> Column:
        p = F.least(F.greatest(1 / (1 + F.exp(-F.col("logit") / t)), F.lit(1e-9)), F.lit(1 - 1e-9))
        return F.round(F.avg(F.when(F.col("y") == 1, -F.log(p)).otherwise(-F.log(1 - p))), 6)

    one = rows.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(grid)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.col(f"l{i}").alias("loss")) for i, t in enumerate(grid)])).alias("x")).select("x.*")


def macro_f1(rows: DataFrame) -> DataFrame:
    """Over labels, of rows (y, predicted)."""
    t = rows.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(1).alias("is_y"), (F.col("y") == F.col("predicted")).cast("int").alias("hit")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("is_y"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    each = t.groupBy("label").agg(F.sum("hit").alias("tp"), F.sum("is_y").alias("n"), F.sum(1 - F.col("is_y")).alias("p"))
    return each.agg(F.round(F.avg(2 * F.col("tp") / (F.col("n") + F.col("p"))), 6).alias("macro_f1"))


def decision(score: Column, low: float, high: float) -> Column:
    return F.when(score >= high, "ACCEPT").when(score < low, "REJECT").otherwise("ABSTAIN")


def split(family: Column, parts: int = 10) -> Column:
    """A split that keeps families whole: by the hash of the family."""
    n = F.pmod(F.conv(F.substring(F.sha2(family.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(parts))
    return F.when(n == 0, "test").when(n == 1, "dev").otherwise("train")


def hard_negatives(ranked: DataFrame, positive: DataFrame, unknown: DataFrame, k: int) -> DataFrame:
    """The best-ranked rows (query, id, rank) that are neither positive nor of unknown status; k a query."""
    left = ranked.join(positive, ["query", "id"], "left_anti").join(unknown, "id", "left_anti")
    w = Window.partitionBy("query").orderBy("rank")
    return left.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("query", "id", F.col("k").cast("long").alias("place"))
