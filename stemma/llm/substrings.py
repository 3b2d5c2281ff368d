"""Substring dedup by recompression: long repeats are revealed by the symbols they share.

A text is a string of words. In each round, runs of one symbol and then pairs of neighbours get names: a pair (x, y)
where a bit of x's name is 0 and that of y's is 1. A name is a hash of what it stands for, so that all tasks of
a round give the same name to the same thing without asking one another, and the rounds of one text follow each other in
one task. Whether symbols join depends on them and their neighbours alone, hence equal substrings have the same
symbols but for some at their ends. Each symbol carries the span of words that its name and its borders depend on.

If a window of words occurs twice, every symbol whose span lies inside occurs twice as well. So the symbols of the last
round are counted over the corpus, and a window that holds a symbol which occurs once is unique. The
remaining windows are verified: their own hashes are counted. Texts with equal words are first made one, with their number.
Rows are told apart by their id and a hash of their text, so that rows without an id, or with one id, spread like any others.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import bound_arrow, discard, materialize
from stemma.llm.shingles import mix, pair, span_hashes, word_spans

#: Words of a window, and rounds of naming.
WINDOW, ROUNDS = 35, 6
#: A window or symbol with more than 1/HOT_SHARE of all occurrences is hot; there are fewer than HOT_SHARE.
HOT_SHARE = 1000


def recompress(h: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols of a string of word hashes, and the span [low, high) of words that each depends on.

    A symbol at an end of the text depends on what is beyond, too: its span reaches past the end, and is in no window.
    """
    name, n = h, len(h)
    begin, low, high = np.arange(n), np.arange(n), np.arange(1, n + 1)

    def borders(left, right, before, after):
        """Spans that reach to before and to after, where the flags say so."""
        return np.where(left, np.minimum(low, before), low), np.where(right, np.maximum(high, after), high)

    for step in range(rounds):
        if len(name) < 2:
            break
        # runs: a neighbour is another symbol if the words next to the border differ, else all that the neighbour depends on tells
        end = np.append(begin[1:], n)
        first, last = h[begin], h[end - 1]
        other_after, other_before = first[1:] != first[:-1], last[1:] != last[:-1]
        after = np.append(np.where(other_after, end[:-1] + 1, high[1:]), n + 1)
        before = np.concatenate([[-1], np.where(other_before, begin[1:] - 1, low[:-1])])
        start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        size = np.diff(np.append(start, len(name)))
        low, high = np.minimum.reduceat(np.minimum(low, before), start), np.maximum.reduceat(np.maximum(high, after), start)
        name, begin = np.where(size > 1, pair(name[start], size.astype(np.uint64)), name[start]), begin[start]
        # pairs: the bit is a new one each round
        bit = (mix(name + np.uint64(step + 1)) & np.uint64(1)).astype(bool)
        joins = np.append(~bit[:-1] & bit[1:], False)
        joined = np.concatenate([[False], joins[:-1]])
        # one that stays alone depends on the neighbour that it could have joined
        alone = ~joins & ~joined
        low, high = borders(alone & bit, alone & ~bit, np.concatenate([[-1], low[:-1]]), np.append(high[1:], n + 1))
        keep = np.flatnonzero(~joined)
        right = np.minimum(keep + 1, len(name) - 1)
        both = joins[keep]
        low, high = np.where(both, np.minimum(low[keep], low[right]), low[keep]), np.where(both, np.maximum(high[keep], high[right]), high[keep])
        name, begin = np.where(both, pair(name[keep], name[right]), name[keep]), begin[keep]
    return name, low, high


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _lists(cols: list[list[np.ndarray]], kind: pa.DataType) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *map(len, cols)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*cols, np.zeros(0, np.int64)]), kind))


#: Bytes of text that are handled at a time, unless one text has more.
GROUP_BYTES = 1 << 21


def groups(texts: list[str | None]):
    """Hashes of the words of several texts in one string, with a border of its own around each: first, number of texts, hashes, starts, ends.

    A border is a name that no word has, so nothing that depends on texts' insides alone reaches across it.
    """
    held, first, total = [], 0, 0
    for k, text in enumerate(texts):
        held.append((text or "").encode())
        total += len(held[-1])
        if total >= GROUP_BYTES or k == len(texts) - 1:
            data = b" ".join(held)
            starts, ends = word_spans(data)
            at = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in held)]))
            sizes = np.diff(at)
            texts_starts = at[:-1] + np.arange(len(held)) + 1
            names = np.empty(len(starts) + len(held) + 1, np.uint64)
            names[np.arange(len(starts)) + np.repeat(np.arange(len(held)), sizes) + 1] = span_hashes(data, starts, ends)
            names[np.append(texts_starts - 1, len(names) - 1)] = mix(np.arange(len(held) + 1, dtype=np.uint64) + np.uint64(0x5BF03635AF3D2B1C))
            yield first, len(held), names, texts_starts, texts_starts + sizes
            held, first, total = [], k + 1, 0


def inner_symbols(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, rounds: int):
    """Names, spans and texts of the symbols that some window of a text holds the span of, in order."""
    name, low, high = recompress(h, rounds)
    owner = np.maximum(np.searchsorted(starts, low, "right") - 1, 0)
    held = (low >= starts[owner]) & (high <= ends[owner]) & (high - low <= window)
    return name[held], low[held], high[held], owner[held]


def free_windows(low: np.ndarray, high: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: int, window: int) -> np.ndarray:
    """Where the windows start that lie in one text and hold none of these spans."""
    n = max(0, total - window + 1)
    change = np.zeros(n + 1, np.int64)
    # a window that starts in high - window .. low holds the span; one across a border is none
    np.add.at(change, np.minimum(np.maximum(high - window, 0), n), 1)
    np.add.at(change, np.minimum(low + 1, n), -1)
    own = np.zeros(n, bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        own[a : max(a, b - window + 1)] = True
    return np.flatnonzero(own & (np.cumsum(change[:n]) == 0))


def symbol_batches(batches, window: int, rounds: int):
    """uid of the text's words, their number, whether a window holds no inner symbol, and the names of the inner symbols."""
    for batch in batches:
        uid, n, bare, names = [], [], [], []
        for _, k, h, starts, ends in groups(batch.column(2).to_pylist()):
            uid += [xxhash.xxh3_64_intdigest(h[a:b].tobytes()) - (1 << 63) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n += (ends - starts).tolist()
            name, low, high, owner = inner_symbols(h, starts, ends, window, rounds)
            free = np.zeros(k, bool)
            free[np.searchsorted(starts, free_windows(low, high, starts, ends, len(h), window), "right") - 1] = True
            bare += free.tolist()
            names += np.split(name.view(np.int64), np.searchsorted(owner, np.arange(1, k)))
        cols = [*batch.columns[:2], pa.array(uid, pa.int64()), pa.array(n, pa.int64()), pa.array(bare, pa.bool_()), _lists(names, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "uid", "n", "bare", "names"])


def window_hashes(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each window, by doubling."""
    out = []
    for seed in (np.uint64(1), np.uint64(2)):
        blocks, width, got, at = mix(h + seed), 1, None, 0
        n = len(h) - window + 1
        rest = window
        while rest:
            if rest & 1:
                part = blocks[at : at + n]
                got = part if got is None else pair(got, part)
                at += width
            rest >>= 1
            if rest:
                blocks = pair(blocks[:-width], blocks[width:])
                width *= 2
        out.append(got.view(np.int64))
    return out[0], out[1]


def window_batches(batches, window: int, rounds: int):
    """uid, copies, start and hashes of the windows that hold no symbol that occurs once; of rows with one uid in a batch, of the first.

    again has the places, among a text's inner symbols, of those that occur twice or more.
    """
    for batch in batches:
        _, own = np.unique(batch.column(0).to_numpy(), return_index=True)  # repeated rows
        batch = batch.take(pa.array(np.sort(own)))
        uid, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        again = batch.column(3)
        places, at_text = again.flatten().to_numpy(), np.cumsum([0, *again.value_lengths().fill_null(0).to_numpy()])
        for first, k, h, starts, ends in groups(batch.column(2).to_pylist()):
            if len(h) < window:
                continue
            _, low, high, owner = inner_symbols(h, starts, ends, window, rounds)
            once = np.ones(len(low), bool)
            begins = np.searchsorted(owner, np.arange(k))
            counts = np.diff(at_text[first : first + k + 1])
            once[np.repeat(begins, counts) + places[at_text[first] : at_text[first + k]]] = False
            at = free_windows(low[once], high[once], starts, ends, len(h), window)
            if len(at):
                a, b = window_hashes(h, window)
                text = np.searchsorted(starts, at, "right") - 1
                cols = [uid[first + text], copies[first + text], at - starts[text], a[at], b[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["uid", "copies", "start", "a", "b"])


def kept_words(words: list[bytes], starts: np.ndarray, window: int) -> list[bytes]:
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, len(words)), -1)
    gone = np.cumsum(change[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def cut_batches(batches, window: int):
    """doc_id, text, copies and starts of repeated windows to doc_id, n_words, n_removed and the words that stay."""
    for batch in batches:
        n, removed, texts = [], [], []
        for text, copies, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            words = left = words_of(text)
            if len(words) >= window and copies and copies > 1:
                left = []  # every window of a text that has a copy occurs there as well
            elif starts.is_valid:
                left = kept_words(words, starts.values.to_numpy(), window)
            n.append(len(words))
            removed.append(len(words) - len(left))
            texts.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])


def cut_and_hash(batches, window: int):
    for batch in cut_batches(batches, window):
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_keys(rows: DataFrame, keys: list[str], copies: str | None) -> DataFrame:
    """The rows whose key occurs twice or more; counts are combined before the shuffle, hot keys looked up in a broadcast."""
    amount = F.sum(copies) if copies else F.count(F.lit(1))
    often = materialize(rows.groupBy(*keys).agg(amount.alias("c"), F.count(F.lit(1)).alias("places")).where("c > 1"), "repeated")
    total = often.agg(F.sum("places")).first()[0] or 0
    hot = F.broadcast(often.where(F.col("places") * HOT_SHARE > F.lit(total)).select(*keys))  # fewer than HOT_SHARE
    cold = rows.join(hot, keys, "left_anti").join(often.select(*keys), keys, "left_semi")
    out = rows.join(hot, keys, "left_semi").unionByName(cold)
    out.stemma_path = often.stemma_path
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, hashed: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, and text (the words that stay, joined by blanks) or kept_sha256.

    Words are runs of anything but [\\x20\\x09-\\x0D]. Each word goes that is covered by a window whose words also start
    anywhere else, in the same text too; all windows are judged on the input. Null and empty texts have no word; those of
    fewer words than a window stay. Repeated rows count as copies of each other. Rows without an id get a row each. Other
    columns are ignored; an empty table gives an empty result.
    """
    bound_arrow(docs.sparkSession)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) text_hash", "cast(text as string) text")
    schema = "doc_id long, text_hash long, uid long, n long, bare boolean, names array<long>"
    rows = materialize(texts.mapInArrow(partial(symbol_batches, window=window, rounds=rounds), schema).where(F.col("n") >= window), "symbols")
    # texts of equal words are one text with a number of copies
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    one = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("copies"), least, F.first("bare").alias("bare"), F.first("names").alias("names"))
    one = materialize(one, "distinct-texts")
    ids = materialize(rows.select("doc_id", "text_hash", "uid").distinct(), "text-ids")
    copied = materialize(one.select("uid", "copies"), "copies")
    discard(rows)

    places = one.select("uid", "copies", F.posexplode("names").alias("at", "name"))
    repeated = repeated_keys(places, ["name"], "copies")
    again = repeated.groupBy("uid").agg(F.collect_list("at").alias("again"))
    # texts in which some window could be repeated: those with a repeated symbol, or with a window that no symbol rules out
    open_ = one.select("uid", "copies", "least", "bare").join(again, "uid", "left").where("bare or again is not null").drop("bare")
    open_ = materialize(open_, "open-texts")
    discard(one, repeated)
    # a text that has copies is repeated as a whole; it counts for others all the same
    wanted = open_.select("uid", "copies", "again", "least.doc_id", "least.text_hash")
    found = texts.join(wanted, _same(texts, wanted)).select("uid", "copies", "text", "again")
    windows = found.mapInArrow(partial(window_batches, window=window, rounds=rounds), "uid long, copies long, start long, a long, b long")
    windows = materialize(windows, "windows")
    repeated = repeated_keys(windows, ["a", "b"], "copies")
    starts = repeated.groupBy("uid").agg(F.collect_list("start").alias("starts"))

    touched = copied.join(starts, "uid", "left").where("copies > 1 or starts is not null")
    # a text that has copies goes as a whole: its places aren't needed
    touched = materialize(touched.select("uid", "copies", F.when(F.col("copies") == 1, F.col("starts")).alias("starts")), "touched")
    discard(windows, repeated, open_, copied)
    named = materialize(ids.join(touched, "uid").select("doc_id", "text_hash", "copies", "starts"), "verdicts")
    discard(ids, touched)
    both = texts.join(named, _same(texts, named), "left").select(texts["doc_id"], "text", "copies", "starts")
    schema = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if hashed else "text string")
    return both.mapInArrow(partial(cut_and_hash if hashed else cut_batches, window=window), schema)


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
