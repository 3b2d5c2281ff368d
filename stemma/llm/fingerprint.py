"""Document fingerprints by improbable features.

Each window of WIDTH bytes is a feature, ranked by how improbable its entropy is. Of any SPAN consecutive features the
one of the least probable rank, the leftmost of equals, gets a vote; features with enough votes are selected. Their
hashes are inserted into Bloom filters of a fixed size, a new one being chained when a filter has its share. Two
fingerprints are compared filter by filter, by the bits they share beyond what chance gives.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import bound_arrow

WIDTH = 32
SPAN = 32
VOTES = 8
#: Below so many features, those with fewer votes count as well.
FEW = 24
#: Bits of a filter, features in one, bits for each feature.
BITS, SHARE, HASHES = 2048, 160, 5
#: Entropy of a window of prose in bits, and its spread: the further from it, the less probable. Windows of less than FLAT bits
#: are filler (runs, rules, tables of blanks) and come last.
TYPICAL, SPREAD, FLAT = 3.85, 0.22, 1.2
#: Bytes handled at a time.
CHUNK = 1 << 20

_TERM = np.array([0.0, *(c * np.log2(c) for c in range(1, WIDTH + 2))])


def entropies(b: np.ndarray) -> np.ndarray:
    """Bits of entropy of each window of WIDTH bytes, from the changes that the byte that goes and the one that comes make."""
    n = len(b) - WIDTH + 1
    order = np.argsort(b, kind="stable")
    keys = b[order].astype(np.int64) * (len(b) + WIDTH) + order
    own = np.empty(len(b), np.int64)
    own[order] = np.arange(len(b))
    # how often the byte at i occurs in i..i+WIDTH-1, and in i-WIDTH+1..i
    ahead = np.empty(len(b), np.int64)
    ahead[order] = np.searchsorted(keys, keys + WIDTH - 1, "right") - np.arange(len(b))
    behind = np.empty(len(b), np.int64)
    behind[order] = np.arange(len(b)) + 1 - np.searchsorted(keys, np.maximum(keys - WIDTH + 1, keys - order), "left")
    total = np.empty(n)
    total[0] = _TERM[np.bincount(b[:WIDTH], minlength=256)].sum()
    if n > 1:
        goes, comes = ahead[: n - 1], behind[WIDTH:]
        total[1:] = total[0] + np.cumsum(_TERM[goes - 1] - _TERM[goes] + _TERM[comes] - _TERM[comes - 1])
    return np.log2(WIDTH) - total / WIDTH


def ranks(h: np.ndarray) -> np.ndarray:
    """0 for the least probable entropies, 1000 for the typical ones, 1001 for filler."""
    far = np.abs(h - TYPICAL) / SPREAD
    out = np.rint(1000 * np.exp(-far * far / 8)).astype(np.int64)
    return np.where(h < FLAT, 1001, out)


def votes(data: bytes) -> np.ndarray:
    """For each feature the number of spans in which it has the least probable rank; chunk by chunk."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - WIDTH + 1
    out = np.zeros(n, np.int32)
    span = min(SPAN, n)
    for lo in range(0, n - span + 1, CHUNK):
        hi = min(lo + CHUNK, n - span + 1)  # spans that start in lo..hi-1
        key = ranks(np.round(entropies(b[lo : hi + span - 1 + WIDTH - 1]), 6))
        key = (key << 32) + np.arange(len(key))
        width, least = 1, key
        while 2 * width <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if width < span:
            rest = span - width
            least = np.minimum(least[: len(least) - rest], least[rest:])
        out[lo : lo + len(key)] += np.bincount(least & 0xFFFFFFFF, minlength=len(key)).astype(np.int32)
    return out


def features(data: bytes) -> list[bytes]:
    """The selected features in order; a shorter text is one feature; an empty one has none."""
    if len(data) < WIDTH:
        return [data] if data else []
    v, need = votes(data), VOTES
    at = np.flatnonzero(v >= need)
    while len(at) < FEW and need > 1:
        need //= 2
        at = np.flatnonzero(v >= need)
    return [data[i : i + WIDTH] for i in at.tolist()]


def filters(text: str) -> np.ndarray:
    """The chain of filters: a row of packed bits for each, after its number of features in two bytes."""
    found = list(dict.fromkeys(features(text.encode())))
    chain = max(1, -(-len(found) // SHARE))
    bits = np.zeros((chain, BITS), np.uint8)
    if found:
        digests = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=2 * HASHES).digest() for x in found), ">u2").reshape(-1, HASHES) % BITS
        bits[np.repeat(np.arange(len(found)) // SHARE, HASHES), digests.ravel()] = 1
    return np.packbits(bits, axis=1)


def to_string(chain: np.ndarray) -> str:
    return f"{WIDTH}.{BITS}.{SHARE}.{len(chain)}:" + base64.b64encode(chain.tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1. Each filter of the shorter chain counts by its best partner in the other, weighted by its set bits."""
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    if not na.any() or not nb.any():
        return float(not na.any() and not nb.any())
    best = np.zeros(len(a))
    for i in range(len(a)):
        both = np.bitwise_count(a[i] & b).sum(1, dtype=np.int64)
        chance, most = na[i] * nb / BITS, np.minimum(na[i], nb)
        best[i] = np.max(np.where(most > 0, (both - chance) / np.maximum(most - chance, 1e-9), 0))
    return float(np.clip((np.clip(best, 0, 1) * na).sum() / na.sum(), 0, 1))


def edited(text: str, after: str) -> str:
    """text with its last third, in code points, replaced by as many first ones of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def fingerprint_batches(batches):
    """Rows come in the order of parts and keys; a ghost row ends each part, the first of the next one."""
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    held, grow = None, zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out = []
        for part, ghost, _, _, _, doc_id, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = grow(data).decode()
            now = (part, doc_id, text, filters(text))
            if held is not None and held[0] == part:
                _, other_id, own, chain = held
                changed = edited(own, text)
                there = filters(changed)
                sha = hashlib.sha256(changed.encode()).hexdigest()
                out.append((other_id, len(own), sha, to_string(chain), to_string(there), likeness(chain, there), likeness(chain, now[3])))
            held = None if ghost else now
        cols = zip(*out, strict=True) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=list(names))


#: Bytes of text that a part is meant to have, and the most parts: beyond, parts grow. A part streams through its task.
PART_BYTES, PARTS = 16 << 20, 20_000
#: Keys that the driver samples for each part.
SAMPLED = 30


def _key() -> list[Column]:
    """The order of rows: ids descending, missing ones last, equal ones by the hash of their texts."""
    return [F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).cast("long").alias("down"), F.xxhash64("text").alias("h")]


def bounds_of(rows: DataFrame, parts: int | None) -> tuple[tuple | None, list[tuple]]:
    """The first key, and the keys with which the second part and all further ones begin, from a sample by the keys' hash.

    Without `parts` their number follows from the bytes. The driver holds about SAMPLED keys for each part.
    """
    spark = rows.sparkSession
    size = F.octet_length("text") + 1
    n, total, first = rows.agg(F.count(F.lit(1)), F.sum(size), F.min(F.struct(*_key()))).first()
    if not n:
        return None, []
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(PARTS, -(-total // PART_BYTES)))
    every = max(1, n // (SAMPLED * parts))
    some = rows.select(*_key(), size.alias("size")).where(F.pmod(F.xxhash64("none", "down", "h", F.lit(7)), F.lit(every)) == 0)
    some = sorted(tuple(r) for r in some.groupBy("none", "down", "h").agg(F.sum("size").alias("size")).collect())
    out, seen, share = [], 0, sum(r[-1] for r in some) / parts
    for r in some:
        if seen >= share * (len(out) + 1) and r[:-1] > tuple(first):
            out.append(r[:-1])
        seen += r[-1]
    return tuple(first), out


def in_parts(docs: DataFrame, parts: int | None) -> DataFrame:
    """part, ghost, none, down, h, doc_id, data (the compressed text): ranges of the order, each followed by the first row of the
    next (after the last: the first). A part begins with a key of the data, so that row is the one with this key.

    Texts are shuffled once. Many rows without an id, or with one id, are split by their texts; only rows that repeat both stay in one part.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first, bounds = bounds_of(rows, parts)
    ends = [(*key, k) for k, key in enumerate([*bounds, first])] if first else []
    ends = F.broadcast(docs.sparkSession.createDataFrame(ends, "none boolean, down long, h long, part int"))
    keyed = rows.select("doc_id", "text", *_key())
    ghosts = keyed.join(ends, ["none", "down", "h"]).groupBy("part").agg(F.min(F.struct("none", "down", "h", "doc_id", "text")).alias("x")).select("part", "x.*")
    every = keyed.withColumn("part", F.lit(None).cast("int")).unionByName(ghosts)
    # texts go through the exchange compressed, each by itself
    packed = every.select("part", "none", "down", "h", "doc_id", "text")
    packed = packed.mapInArrow(partial(compress_batches, bounds=bounds), "part int, ghost boolean, none boolean, down long, h long, doc_id long, data binary")
    return packed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "ghost", "none", "down", "h")


def compress_batches(batches, bounds: list[tuple]):
    """Rows with a part are ghosts, which end it; others go to the part that holds their key."""
    shrink = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        part, none, down, h, doc_id, text = batch.columns
        ghost = part.is_valid()
        keys = zip(part.to_pylist(), none.to_pylist(), down.to_pylist(), h.to_pylist(), strict=True)
        part = pa.array([bisect_right(bounds, tuple(key)) if p is None else p for p, *key in keys], pa.int32())
        data = pa.array([shrink(t.encode()) for t in text.to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([part, ghost, none, down, h, doc_id, data], names=["part", "ghost", "none", "down", "h", "doc_id", "data"])


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller id (after the last, the first); a lone document is its own next.
    A null text is an empty one; its fingerprint has no bits and is like another such one only (likeness 1, else 0). Texts
    under WIDTH bytes are one feature. Rows with the same id come in the order of their texts' hashes, rows without
    an id last. Other columns are ignored; an empty table gives an empty result. A text is handled in chunks.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_parts(docs, parts).mapInArrow(partial(fingerprint_batches), schema)
