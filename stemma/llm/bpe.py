"""Byte-level BPE encoding and decoding as a monoid tree reduction.

The elements are encoded strings. To encode, a string is halved in its middle until its parts are short; parts are encoded
directly, and neighbours are joined on the way up by encoding a window around their border anew. The window grows until
the tokens outside are proven to stay. There are two such trees, one inside the other.

Of a text, the parts are code points. Where white space follows another character a match of the pattern always ends, and
nothing before or behind it changes how the other side is matched (see segments.py). So a window that reaches from
such a place to the next one leaves all tokens outside as they are.

Of a match, the parts are bytes. A sequence of tokens is the encoding of its bytes exactly if each
two neighbours alone encode to themselves: until the first merge across a border, merges on either side happen as if
the neighbour weren't there, so that merge would happen in the two tokens alone as well. Hence a window doubles until
the tokens at its edges are stable next to those outside.

Decoding concatenates bytes up the tree. Leaves are looked up by words in bounded caches.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from functools import cache, partial
from itertools import pairwise
from unicodedata import category

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stemma.llm.common import bound_arrow
from stemma.llm.segments import BORDER, SegmentEncoder

#: Bytes of a leaf of a match's tree, and code points of a leaf of a text's.
LEAF_BYTES = 16
LEAF_CHARS = 1 << 10
#: Code points that a window first looks back.
LOOK = 16
#: Stable pairs that are remembered at most.
PAIRS = 500_000
_NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def stand_in(c: str) -> str:
    """An old character of the class that tiktoken gives a character too new for this Python's tables; such classes
    differ between Unicode versions, and so between libraries."""
    import tiktoken

    one = {bytes([i]): i for i in range(256)}
    for pattern, out in ((r"\p{L}", "b"), (r"\p{N}", "0")):
        if tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=one, special_tokens={}).encode_ordinary(c):
            return out
    return "#"


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.packed = SegmentEncoder(self.segment, lambda words: [self.piece(f" {w}") if w.isascii() and w.isalpha() else self.segment(f" {w}") for w in words])
        self.pieces: dict[str, bytes] = {}

    # the monoid
    def merge(self, part: bytes) -> list[int]:
        """Encodes bytes by merging, lowest rank first, then leftmost. Short ones are searched, long ones use a heap over a linked list."""
        ranks, n = self.ranks, len(part)
        if n <= LEAF_BYTES:
            at = list(range(n + 1))  # where the parts begin; costs are of the part and the next
            costs = [ranks.get(part[i : i + 2], _NEVER) for i in range(n - 1)]
            while costs and (least := min(costs)) != _NEVER:
                k = costs.index(least)
                del at[k + 1], costs[k]
                if k < len(costs):
                    costs[k] = ranks.get(part[at[k] : at[k + 2]], _NEVER)
                if k:
                    costs[k - 1] = ranks.get(part[at[k - 1] : at[k + 1]], _NEVER)
            return [ranks[part[a:b]] for a, b in pairwise(at)]
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(part[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if end[i] != mid or j >= n or end[j] != stop:
                continue  # one of the two has been merged meanwhile
            end[i], end[j], after[i] = stop, 0, after[j]
            if (k := after[i]) < n:
                before[k] = i
                if (r := ranks.get(part[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h:stop])) is not None:
                heapq.heappush(heap, (r, h, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i : end[i]]])
            i = after[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens side by side encode to themselves."""
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b])))
            if (a == 0 or self.stable(left[a - 1], window[0])) and (b == len(right) or self.stable(window[-1], right[b])):
                return left[:a] + window + right[b:]
            width *= 2

    def tree(self, part: bytes) -> list[int]:
        if len(part) <= LEAF_BYTES:
            return self.merge(part)
        mid = len(part) // 2
        return self.join(self.tree(part[:mid]), self.tree(part[mid:]))

    # texts
    def piece(self, match: str) -> bytes:
        """Packed ids of one match of the pattern; one that is a token as a whole stays whole."""
        part = match.encode()
        whole = self.ranks.get(part)
        return array("I", [whole] if whole is not None else self.tree(part)).tobytes()

    def matches(self, text: str) -> list[str]:
        if text.isascii() or all(category(c) != "Cn" for c in text):
            return self.pattern.findall(text)
        known = "".join(stand_in(c) if category(c) == "Cn" else c for c in text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(known)]

    def segment(self, text: str) -> bytes:
        known, out = self.pieces, []
        for m in self.matches(text):
            if (ids := known.get(m)) is None:
                ids = self.piece(m)
                if len(m) <= 64:
                    if len(known) >= 200_000:
                        known.clear()
                    known[m] = ids
            out.append(ids)
        return b"".join(out)

    def join_texts(self, text: str, mid: int, left: bytes, right: bytes) -> bytes:
        """The ids of text from those of its two parts, which meet at mid."""
        lo, width = mid, LOOK
        while lo == mid:  # back to the last border that is not behind mid, or to the start
            lo = max(0, mid - width)
            found = [m.start() + 1 for m in BORDER.finditer(text, lo, mid + 1)]
            lo, width = found[-1] if found else mid if lo else 0, 2 * width
            if found and lo == mid:
                return left + right
        ahead = BORDER.search(text, mid)
        hi = ahead.start() + 1 if ahead else len(text)
        tail, head = self.segment(text[lo:mid]), self.segment(text[mid:hi])
        return left[: len(left) - len(tail)] + self.segment(text[lo:hi]) + right[len(head) :]

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        if len(text) <= LEAF_CHARS:
            return self.packed(text)
        if BORDER.search(text) is None:  # any window would be all of it
            return self.segment(text)
        mid = len(text) // 2
        return self.join_texts(text, mid, self.encode(text[:mid]), self.encode(text[mid:]))

    def decode(self, ids: bytes) -> bytes:
        if len(ids) <= 4 * LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))
        mid = len(ids) // 8 * 4
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_MADE: dict[tuple[str, str], Bpe] = {}


def load(path: str, pattern: str) -> Bpe:
    """One encoder for each Python worker."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = Bpe(read_ranks(path), pattern)
    return _MADE[path, pattern]


def encode_batches(batches, path: str, pattern: str, with_ids: bool):
    bpe = load(path, pattern)
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        n, ids_sha, decoded_sha, all_ids = [], [], [], []
        for text in texts:
            ids = bpe.encode(text)
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            if with_ids:
                all_ids.append(memoryview(ids).cast("I").tolist())
        cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols.append(pa.array(all_ids, pa.list_(pa.int64())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(cols, names=names)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of each row's whole text.

    path names the ranks file, which each executor must have. A null text is an empty one: no tokens, and the hashes of no bytes.
    Repeated rows and null ids give a row each; other columns are ignored; an empty table gives an empty result. There
    is no shuffle: a task holds one Arrow batch and a bounded cache.
    """
    bound_arrow(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids
    run = partial(encode_batches, path=path, pattern=pattern, with_ids=with_ids)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def decode_batches(batches, path: str, pattern: str):
    bpe = load(path, pattern)
    for batch in batches:
        out = [bpe.decode(array("I", x or []).tobytes()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text from doc_id and ids (null ids: the empty text)."""
    bound_arrow(encoded.sparkSession)
    run = partial(decode_batches, path=path, pattern=pattern)
    return encoded.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<long>) ids").mapInArrow(run, "doc_id long, text string")
