"""Bounded-space online best-fit packing of token sequences.

Open bins are kept by free space: a bit set has a bit for each free space that some open bin has, and a stack of bins
for each bit. The smallest free space that is large enough is the lowest bit left after a shift, so each placement
takes constant time. The number of open bins is fixed; when a new one is needed beyond it, the fullest closes first.

Placement is online: a piece is placed when it comes, and never moved. The order in which pieces come is chosen, though: each
task sorts its share into runs of what about half of its open bins hold, long pieces first within a run. A share of one run
(a small table) is thus packed as by best-fit decreasing; a large one is a sequence of such runs over the bins that stay open.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import partial
from itertools import pairwise
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import bound_arrow, materialize
from stemma.llm.segments import SegmentEncoder

#: How a byte-level vocabulary writes a blank.
BLANK = "\u0120"
CAPACITY = 1024
END = 2
#: Bins that a task keeps open. Most are nearly full when they close.
OPEN_BINS = 4096
#: Tokens that one packing task is meant to take: a few MB of pieces, over which at most OPEN_BINS bins stay partly filled.
TASK_TOKENS = 1 << 25


class BestFit:
    """Places items online. place() gives the bin's number and the offset there."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit, self.opened, self.n_open = capacity, open_bins, 0, 0
        self.bits, self.at = 0, [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self.take(free)
        else:
            if self.n_open >= self.limit:
                self.take((self.bits & -self.bits).bit_length() - 1)  # the fullest
            free, number = self.capacity, self.opened
            self.opened += 1
        if free > length:  # a full bin closes by itself
            self.put(free - length, number)
        return number, self.capacity - free

    def take(self, free: int) -> int:
        number = self.at[free].pop()
        if not self.at[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return number

    def put(self, free: int, number: int) -> None:
        self.at[free].append(number)
        self.bits |= 1 << free
        self.n_open += 1


_MADE: dict[str, SegmentEncoder] = {}


def same_by_rank(tok) -> dict[bytes, int] | None:
    """The vocabulary as ranks, if merging by rank is proven to give the ids of this tokenizer; else None.

    Both merge alike as long as no two adjacent parts make up a token other than by its own merge. If each token's
    bytes alone merge to the token, its last merge is its own, and any other two parts of it never stand side by side.
    """
    import json

    from tokenizers import Tokenizer, models

    model = json.loads(tok.to_str())["model"]
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab["".join(m)] for m in merges]
    plain = [chr(c) for c in (*range(33, 127), *range(161, 173), *range(174, 256))]
    alphabet = {c: ord(c) for c in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in plain)}
    if any(a >= b for a, b in pairwise(made)) or not alphabet.keys() <= vocab.keys() or len(made) + 256 > len(vocab):
        return None
    tokens = [*alphabet, *("".join(m) for m in merges)]
    if {vocab[c] for c in alphabet} & set(made) or max(vocab[c] for c in alphabet) > made[0]:
        return None
    bare = Tokenizer(models.BPE(vocab, [tuple(m) for m in merges]))
    if any(len(x.ids) != 1 for x in bare.encode_batch_fast(tokens)):
        return None
    return {bytes(alphabet[c] for c in t): vocab[t] for t in tokens}


def load(path: str) -> SegmentEncoder:
    if path not in _MADE:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        ranks = same_by_rank(tok)
        fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        # tokens that begin with a blank: among words joined by blanks, those that begin a word
        led = np.zeros(tok.get_vocab_size(), bool)
        led[[i for t, i in tok.get_vocab().items() if t.startswith(BLANK)]] = True

        def ids_of(text: str) -> list[int]:
            # characters that are new to Unicode can be of another class in another library
            if fast is None or not text.isascii() and any(category(c) == "Cn" for c in set(text)):
                return tok.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        def encode(text: str) -> bytes:
            return array("I", ids_of(text)).tobytes()

        def words(them: list[str]) -> list[bytes]:
            full = [w for w in them if w]
            ids = np.array(ids_of(f" {' '.join(full)}") if full else [], np.uint32)
            at = [*np.flatnonzero(led[ids]).tolist(), len(ids)]
            packed = ids.tobytes()
            out = [packed[4 * a : 4 * b] for a, b in pairwise(at)]
            if len(out) != len(full):
                raise ValueError("a word began without a blank's token")
            found = iter(out)
            return [next(found) if w else encode(" ") for w in them]

        _MADE[path] = SegmentEncoder(encode, words)
    return _MADE[path]


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole, or else full pieces after a first one of what is left over."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


def piece_batches(batches, path: str, capacity: int, end: int, with_ids: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encode, stop = load(path), end.to_bytes(4, "little")
    for batch in batches:
        rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text or "") + stop
            for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                part = ids[4 * start : 4 * (start + length)]
                for name, v in zip(rows, (doc_id, k, start, length, zlib.crc32(part), memoryview(part).cast("I").tolist() if with_ids else None), strict=True):
                    rows[name].append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        cols = {k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True) if with_ids or k != "ids"}
        yield pa.RecordBatch.from_pydict(cols)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Token pieces of each document: doc_id, piece, start, length, ids_crc32 (and ids). A map without a shuffle."""
    bound_arrow(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    run = partial(piece_batches, path=path, capacity=capacity, end=end, with_ids=with_ids)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def place_batches(batches, capacity: int, open_bins: int):
    bins, base = None, 0
    for batch in batches:
        if bins is None and batch.num_rows:
            bins, base = BestFit(capacity, open_bins), batch.column("task")[0].as_py() << 40
        placed = [bins.place(n) for n in batch.column("length").to_pylist()] if batch.num_rows else []
        out = batch.drop_columns(["task"]) if hasattr(batch, "drop_columns") else batch
        out = out.append_column("sequence_id", pa.array([base + k for k, _ in placed], pa.int64()))
        yield out.append_column("offset", pa.array([o for _, o in placed], pa.int64()))


def place(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """cut (doc_id, piece, length, ...) with sequence_id and offset.

    Only these short rows are shuffled, by a hash, into as many tasks as the total length asks for; each packs its
    own share in an order that a retried task repeats. Each task leaves at most open_bins bins partly filled.
    """
    spark: SparkSession = cut.sparkSession
    bound_arrow(spark)
    total = cut.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // task_tokens))
    mixed = F.xxhash64(F.lit(9), "doc_id", "piece", "start", "ids_crc32")
    # long pieces first, by runs that open no more than half of the bins: short ones then fill what those leave
    runs = max(1, -(-total // (tasks * capacity * max(1, open_bins // 2))))
    run = F.pmod(F.xxhash64(F.lit(8), mixed), F.lit(runs))
    dealt = cut.repartition(tasks, mixed).sortWithinPartitions(run, F.col("length").desc(), mixed, "doc_id", "piece", "ids_crc32").withColumn("task", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return dealt.mapInArrow(partial(place_batches, capacity=capacity, open_bins=open_bins), schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then the end id. Only one longer than the capacity is cut; its first piece has what full
    pieces leave over. A null or empty text is the end id alone. Repeated rows and null ids are packed like any others.
    Other columns are ignored; an empty table gives an empty result. sequence_id is the packing task's number and the bin's number there.
    """
    return place(materialize(pieces(docs, path, capacity, end), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pieces with ids and places (pieces(with_ids=True), then place())."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
