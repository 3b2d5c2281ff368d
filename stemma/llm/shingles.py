"""Word hashes and sets of word shingles, by bytes: white space is [\\x20\\x09-\\x0D], and only A-Z have a lower case."""

from __future__ import annotations

import numpy as np
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The low bytes of a number, 0 to 8 of them.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for an ordered pair of numbers."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(0x632BE59BD9B4E019)))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words at these places, eight bytes at a time for all words at once."""
    eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    h = pair(eight[starts] & _LOW[np.minimum(size, 8)], size.astype(np.uint64))
    more, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        h[more] = pair(h[more], eight[starts[more] + done] & _LOW[np.minimum(size[more] - done, 8)])
        done += 8
        more = more[size[more] > done]
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return h


def word_hashes(data: bytes) -> np.ndarray:
    return span_hashes(data, *word_spans(data))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word shingles of a text; one of fewer words is one shingle; no word, none."""
    words = word_hashes((text or "").encode().lower())
    if not len(words):
        return np.zeros(0, np.int64)
    n = max(1, len(words) - width + 1)
    h = mix(words[:n])
    for k in range(1, min(width, len(words))):
        h = pair(h, words[k : k + n])
    return np.unique((h >> np.uint64(1)).astype(np.int64))
