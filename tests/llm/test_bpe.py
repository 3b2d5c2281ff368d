import hashlib
import random
import struct
from array import array

import public_tokenizers as P
import pytest
import tiktoken

from stemma.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(PATH)
    return bpe.load(PATH, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_every_code_point_between_letters_and_blanks(both):
    ours, theirs = both
    for lo in range(0, 0x20000, 64):
        text = "".join(f"a{c} {c}b 1{c}{c} {c} .{c}" for c in map(chr, range(lo, lo + 64)) if not "\ud800" <= c <= "\udfff")
        assert ids(ours.encode(text)) == theirs.encode_ordinary(text), hex(lo)


def test_random_strings_and_long_runs(both):
    ours, theirs = both
    rng = random.Random(3)
    alphabets = ["ab", "a ", " \n\t", "the anderinsto", "aé漢🎉", "'stdmrelv ", "0123456789.,", "éèçàß"]
    for k in range(300):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.choice([1, 5, 40, 400])))
        assert ids(ours.encode(text)) == theirs.encode_ordinary(text), text
    for text in ("a" * 70_000, "ab" * 20_000, " " * 90_000, "x " * 90_000, "漢字" * 10_000, ("word " * 9 + "\n  ") * 9000):
        assert ids(ours.encode(text)) == theirs.encode_ordinary(text)


def test_the_tree_equals_merging_at_once(both):
    ours, _ = both
    rng = random.Random(5)
    for k in range(300):
        part = "".join(rng.choices(rng.choice(["abc", "thein", "é漢ab"]), k=rng.choice([17, 60, 300]))).encode()
        assert ours.tree(part) == ours.merge(part)


def test_documents_match_and_round_trip(spark, small_docs, both):
    _, theirs = both
    want = {}
    for r in small_docs.select("doc_id", "text").collect():
        x = theirs.encode_ordinary(r.text)
        want[r.doc_id] = (len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in bpe.encode_documents(small_docs, PATH, P.PATTERN).collect()}
    assert got == want


def test_odd_rows(spark, odd, none):
    encoded = bpe.encode_documents(odd, PATH, P.PATTERN, with_ids=True)
    back = sorted((r.doc_id or 0, r.text) for r in bpe.decode_documents(encoded, PATH, P.PATTERN).collect())
    assert back == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    assert bpe.encode_documents(none, PATH, P.PATTERN).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(encoded.where("doc_id = 2").first())[1:4] == (0, empty, empty)


def test_halves_of_texts_join_wherever_they_are_cut(both):
    ours, theirs = both
    rng = random.Random(8)
    alphabets = ["ab ", "a  \n", "'stl e", "aé漢🎉 \u3000\x1c\x85", "12 a.,!", "the and er in to ", "x"]
    for k in range(400):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.choice([2, 9, 60, 300])))
        for mid in {1, len(text) // 2, len(text) - 1, rng.randrange(1, len(text))}:
            left, right = (array("I", theirs.encode_ordinary(x)).tobytes() for x in (text[:mid], text[mid:]))
            assert ids(ours.join_texts(text, mid, left, right)) == theirs.encode_ordinary(text), (text, mid)


def test_the_tree_of_texts_has_small_leaves(both, monkeypatch):
    ours, theirs = both
    monkeypatch.setattr(bpe, "LEAF_CHARS", 3)
    rng = random.Random(9)
    for k in range(60):
        text = "".join(rng.choices(["word ", "a", "  ", "\n", "été", "'ll", "99", "!", "\x1d"], k=rng.choice([5, 80, 400])))
        assert ids(ours.encode(text)) == theirs.encode_ordinary(text)
