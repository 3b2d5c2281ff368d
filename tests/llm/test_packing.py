import zlib
from collections import defaultdict

import public_tokenizers as P
from tokenizers import Tokenizer

from stemma.llm import packing

PATH = P.path("byte_bpe_50k.json")


def reference():
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    return lambda text: [*tok.encode(text or "", add_special_tokens=False).ids, 2]


def verify(rows, docs, capacity=1024):
    encode, by_doc = reference(), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for d in docs:
        want, left = encode(d.text), sorted(by_doc[d.doc_id], key=lambda r: (r.piece, r.start))
        assert sum(r.length for r in left) == len(want)
        for k, r in enumerate(left):
            assert r.piece == k and r.start == sum(x.length for x in left[:k]) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in want[r.start : r.start + r.length]))
        assert len(left) == 1 or len(want) > capacity
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for o, n in sorted(placed):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_documents(spark, small_docs):
    rows = packing.pack_documents(small_docs, PATH).collect()
    used = verify(rows, small_docs.collect())
    least = -(-sum(r.length for r in rows) // 1024)
    assert used <= least * 1.01 + 2


def test_odd_rows(spark, odd, none):
    one_each = odd.dropDuplicates(["doc_id"]).cache()
    verify(packing.pack_documents(one_each, PATH).collect(), one_each.collect())
    rows = packing.pack_documents(odd, PATH).collect()
    assert sum(r.length for r in rows) == sum(len(reference()(r.text)) for r in odd.collect())
    assert packing.pack_documents(none, PATH).count() == 0


def test_best_fit_by_hand():
    bins = packing.BestFit(10, 9)
    assert [bins.place(n) for n in (6, 7, 3, 4, 5, 9, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (3, 9)]
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # bin 1, the fullest, closes for bin 2
    assert bins.place(3) == (0, 6) and bins.place(2) == (2, 8)


def test_sequences(spark, small_docs):
    cut = packing.pieces(small_docs.limit(50), PATH, capacity=100, with_ids=True)
    placed = packing.place(cut, 100, open_bins=3, task_tokens=4000)
    out = packing.sequences(placed)
    assert out.where("size(ids) > 100").count() == 0
    encode = reference()
    assert out.selectExpr("sum(size(ids))").first()[0] == sum(len(encode(r.text)) for r in small_docs.limit(50).collect())
