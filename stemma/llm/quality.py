"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network, calibrated.

Random indexing: each token has a fixed sparse random vector of +1 and -1; a token's word vector is the sum of those
of its neighbours over the whole corpus. Tokens are hashed into VOCABULARY rows, so that the table has a fixed size.
Sums are integers, so neither the order of tasks nor a retried task changes them. A document's vector is the mean and
the spread of its tokens' normalised vectors, and how alike neighbouring ones are.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import bound_arrow

#: Rows of the word table and their length: 4 MB of 32-bit sums in all, which one row a block brings to the driver.
VOCABULARY, WIDTH = 1 << 14, 64
#: Entries of a random vector that aren't 0; neighbours on each side.
ENTRIES, REACH = 4, 2
#: Labelled documents that the network is fitted on at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: The share of them, by another hash, that only sets the temperature.
CALIBRATION = 5
#: Rows of the word table in one block of the exchange.
BLOCK = 1024
#: Characters of a text that are handled at a time.
CHUNK = 1 << 20
THRESHOLD = 0.3
#: Numbers that a document is pooled into.
POOLED = 2 * WIDTH + 2

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Rows(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        row = self[token] = zlib.crc32(token.encode()) & (VOCABULARY - 1)
        return row


_ROWS = _Rows()


def chunks(text: str):
    """text in parts of about CHUNK characters that end where a token ends, if one does near by."""
    lo = 0
    while len(text) - lo > CHUNK:
        hi = lo + CHUNK
        while hi < min(len(text), lo + 2 * CHUNK) and not text[hi].isspace():
            hi += 1
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def token_rows(text: str) -> np.ndarray:
    found = _TOKEN.findall(text)
    return np.fromiter(map(_ROWS.__getitem__, found), np.int64, len(found))


@cache
def random_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each row's random vector."""
    rng = np.random.default_rng(20_011)
    places = np.argsort(rng.random((VOCABULARY, WIDTH)), axis=1)[:, :ENTRIES]
    return places, rng.choice(np.array([-1.0, 1.0]), (VOCABULARY, ENTRIES))


def add_contexts(total: np.ndarray, rows: np.ndarray) -> None:
    """Adds to the flat table what each token's neighbours within REACH bring; rows under 0 are borders."""
    places, signs = random_vectors()
    for step in range(1, REACH + 1):
        for word, other in ((rows[:-step], rows[step:]), (rows[step:], rows[:-step])):
            inside = (word >= 0) & (other >= 0)
            word, other = word[inside], other[inside]
            at = (word[:, None] * WIDTH + places[other]).ravel()
            total += np.bincount(at, signs[other].ravel(), VOCABULARY * WIDTH).astype(np.int64)


def context_batches(batches):
    total = np.zeros(VOCABULARY * WIDTH, np.int64)
    border, held, n = np.full(REACH, -1), [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for part in chunks(text or ""):
                held += [token_rows(part), border]
                n += len(held[-2])
            if n > 1 << 20:
                add_contexts(total, np.concatenate(held))
                held, n = [], 0
    if held:
        add_contexts(total, np.concatenate(held))
    table = total.reshape(-1, BLOCK, WIDTH)
    some = [k for k in range(len(table)) if table[k].any()]
    for k in some:  # small numbers compress well
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(table[k].tobytes(), 1)], pa.binary())], names=["block", "sums"])


def add_batches(batches):
    """Adds the blocks up as they come: a task holds a sum for each of its blocks."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got = np.frombuffer(zlib.decompress(part), np.int64)
            sums[k] = sums[k] + got if k in sums else got
    for k, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(v.tobytes(), 1)], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The normalised table, from every token of every document."""
    bound_arrow(docs.sparkSession)
    parts = docs.selectExpr("cast(text as string) text").mapInArrow(context_batches, "block int, sums binary")
    blocks = VOCABULARY // BLOCK
    # two steps: what one task reads of a block doesn't grow with the corpus alone
    salted = parts.withColumn("salt", F.spark_partition_id() % 64).repartition("block", "salt").drop("salt")
    summed = salted.mapInArrow(add_batches, "block int, sums binary").repartition(blocks, "block").mapInArrow(add_batches, "block int, sums binary")
    table = np.zeros((blocks, BLOCK * WIDTH), np.int64)
    for r in summed.collect():  # VOCABULARY * WIDTH numbers, whatever the corpus
        table[r.block] = np.frombuffer(zlib.decompress(r.sums), np.int64)
    table = table.reshape(VOCABULARY, WIDTH).astype(np.float32)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of each text's tokens, mean likeness of neighbours, and the share of neighbours that
    are the same; zeros for a text without a token."""
    out = np.zeros((len(texts), POOLED))
    for k, text in enumerate(texts):
        n, first, second, alike, same = 0, np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0
        for part in chunks(text):
            rows = token_rows(part)
            x = table[rows]
            n += len(x)
            alike += float((x[1:] * x[:-1]).sum(dtype=np.float64))
            same += int((rows[1:] == rows[:-1]).sum())
            first += x.sum(0, dtype=np.float64)
            second += (x * x).sum(0, dtype=np.float64)
        if n:
            out[k, :WIDTH] = first / n
            out[k, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(second / n - (first / n) ** 2, 0))
            out[k, 2 * WIDTH :] = alike / n, same / n
    return out


@dataclass
class Network:
    """Two layers and a temperature; score() is the probability of label 1."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hold: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on cross-entropy with weight decay, over the rows where hold is false; then the temperature of least loss on the others."""
    rng = np.random.default_rng(seed)
    train = ~hold if (~hold).any() else np.ones(len(y), bool)
    rate = float(np.clip(y[train].mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    net = Network(x[train].mean(0), x[train].std(0) + 1e-6, rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.log(rate / (1 - rate))) if len(y) else None
    if net is None or len(set(y[train].tolist())) < 2:  # nothing to tell apart: the rate of label 1
        zero = np.zeros(POOLED)
        return Network(zero, zero + 1, np.zeros((POOLED, hidden)), np.zeros(hidden), np.zeros(hidden), np.log(rate / (1 - rate)))
    xs, ys = (x[train] - net.shift) / net.scale, y[train]
    p = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(ys))
        for lo in range(0, len(ys), 256):
            a = xs[order[lo : lo + 256]]
            h = np.maximum(a @ p[0] + p[1], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - ys[order[lo : lo + 256]]) / len(a)
            back = np.outer(g, p[2]) * (h > 0)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
            t += 1
            step = 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k, gr in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                p[k] = p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    if hold.any():
        z, yh = net.logits(x[hold]), y[hold]

        def loss(temp: float) -> float:
            q = np.clip(1 / (1 + np.exp(-np.clip(z / temp, -40, 40))), 1e-7, 1 - 1e-7)
            return float(-(yh * np.log(q) + (1 - yh) * np.log(1 - q)).mean())

        net.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return net


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from; rows without an id are in the other."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def pool_batches(batches, table: np.ndarray):
    for batch in batches:
        x = pooled([t or "" for t in batch.column(0).to_pylist()], table)
        rest = [batch.column(k) for k in range(1, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(x.tolist(), pa.list_(pa.float64()))], names=["hold", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, table: np.ndarray, sample: int = SAMPLE) -> Network:
    """Fits on at most `sample` labelled documents outside the held-out fold. Contradicting labels of one id are averaged;
    rows without an id or a label are left out."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.avg(F.col("quality").cast("double")).alias("__y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)  # the bound of the broadcast
    hold = (F.pmod(F.xxhash64(F.lit(3), "__id"), F.lit(CALIBRATION)) == 0).alias("hold")
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("__id")).select(F.col("text").cast("string").alias("text"), hold, F.col("__y").alias("y"), F.col("__id").alias("id"))
    # one row an id, in an order that doesn't depend on the tasks
    got = rows.groupBy("id").agg(F.min(F.struct("text", "hold", "y")).alias("r")).select("r.text", "r.hold", "r.y")
    found = sorted((r.hold, r.y, tuple(r.x)) for r in got.mapInArrow(partial(pool_batches, table=table), "hold boolean, y double, x array<double>").collect())
    x = np.array([r[2] for r in found]).reshape(-1, POOLED)
    return fit(x, np.array([r[1] for r in found]), np.array([r[0] for r in found], bool))


def score_batches(batches, net: Network, table: np.ndarray):
    for batch in batches:
        score = net.score(pooled([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()], table))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1; higher: label 1 likelier), predicted (1 from `threshold` on).

    A null text is an empty one; texts without a token have zero vectors and get what the network says of those. Rows
    without an id are scored; repeated rows get a row each. Without labels all scores are 0.5. Other columns
    are never read; an empty table gives an empty result.
    """
    table = word_vectors(docs)
    net = train(docs, labels, table)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(partial(score_batches, net=net, table=table), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score from the threshold on, all columns; texts stay where they are (a map without a shuffle)."""
    table = word_vectors(docs)
    net = train(docs, labels, table)
    names = docs.columns

    def keep(batches):
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            yield batch.filter(pa.array(net.score(pooled([t or "" for t in texts], table)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
