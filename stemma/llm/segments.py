"""Cutting a text where byte-level BPE with a white-space-led pattern always starts a new match.

In public_tokenizers.PATTERN no match holds a non-space character followed by a white-space character, and no
alternative looks back. So a cut between the two changes no match on either side: the ids of a text are the
concatenated ids of its segments. Most are a blank and a word, and repeat, hence the bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# Unicode's white space, which is what \s means in such patterns; Python's own \s has four separators more.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The two characters around a place where a match always ends.
BORDER = re.compile(f"[^{SPACE}][{SPACE}]")
#: White space before a blank: there a blank may belong to a longer run of white space, so blanks alone don't say where to cut.
_RUN = re.compile(f"[{SPACE}] ")
_SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

#: Words that a cache holds at most; then it starts anew. About 100 MB.
CACHE = 400_000

#: Longer words aren't kept.
LONGEST = 64


class SegmentEncoder:
    """Packed ids (little-endian unsigned 32 bits) of texts, by way of a bounded cache of words.

    encode gives the ids of any text. encode_words gives, for each of a list of words without blanks, the ids of the word after a blank.
    """

    def __init__(self, encode: Callable[[str], bytes], encode_words: Callable[[list[str]], list[bytes]], size: int = CACHE):
        self.encode, self.encode_words, self.size, self.known = encode, encode_words, size, {}

    def __call__(self, text: str) -> bytes:
        if _RUN.search(text) is not None:
            return b"".join(map(self.encode, _SEGMENT.findall(text)))
        head, *words = text.split(" ")
        known = self.known
        missing = list(set(words).difference(known))
        if missing:
            if len(known) + len(missing) > self.size:
                known.clear()
                missing = list(set(words))
            known.update(zip(missing, self.encode_words(missing), strict=True))
        out = (self.encode(head) if head else b"") + b"".join(map(known.__getitem__, words))
        if len(known) > self.size:
            known.clear()
        for s in missing:
            if len(s) > LONGEST:
                known.pop(s, None)
        return out
