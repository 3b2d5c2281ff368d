import hashlib

import numpy as np

from stemma.llm import fingerprint as fp


def brute(rows):
    """doc_id, n_chars and the hash of the edited text, by the order of descending ids."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (d, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 3
        out.append((d, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()))
    return sorted(out)


def test_documents(spark, small_docs):
    got = fp.fingerprints(small_docs, 7).collect()
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == brute(rows)
    edited, following = np.array([r.near_edited for r in got]), np.array([r.near_next for r in got])
    assert ((0 <= edited) & (edited <= 1) & (0 <= following) & (following <= 1)).all()
    long = np.array([r.n_chars > 300 for r in got])
    assert np.median(edited[long]) > 0.5 and np.median(following[long]) < 0.1 and (edited[long] > following[long]).mean() > 0.95
    by_text = {}
    texts = dict(rows)
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert fp.to_string(fp.filters(texts[r.doc_id])) == r.fingerprint


def test_entropies_and_votes_by_brute_force():
    rng = np.random.default_rng(2)
    for data in (b"abc" * 40, bytes(rng.integers(0, 256, 300, np.uint8)), b"the cat sat on the mat, the cat sat." * 5, b"x" * 100):
        b = np.frombuffer(data, np.uint8)
        got = fp.entropies(b)
        for i in range(len(b) - fp.WIDTH + 1):
            _, c = np.unique(b[i : i + fp.WIDTH], return_counts=True)
            assert abs(got[i] + (c / fp.WIDTH * np.log2(c / fp.WIDTH)).sum()) < 1e-9
        rank = fp.ranks(np.round(got, 6))
        span = min(fp.SPAN, len(rank))
        want = np.zeros(len(rank), int)
        for i in range(len(rank) - span + 1):
            want[i + int(np.argmin(rank[i : i + span]))] += 1
        assert (fp.votes(data) == want).all()


def test_chunks_change_nothing(monkeypatch):
    data = ("Some words of prose, 12 of them; and then others follow. " * 30).encode() + bytes(range(256)) * 3
    whole = fp.votes(data)
    monkeypatch.setattr(fp, "CHUNK", 100)
    assert (fp.votes(data) == whole).all()


def test_odd_rows(spark, odd, none):
    got = fp.fingerprints(odd, 4).collect()
    assert len(got) == odd.count() and {r.doc_id for r in got} == {r.doc_id for r in odd.collect()}
    assert fp.fingerprints(none, 4).count() == 0
    lone = fp.fingerprints(odd.where("doc_id = 5"), 4).first()
    assert lone.near_next == 1 and lone.edited_sha256 == hashlib.sha256(b"onetwothree foonetwot").hexdigest()
    empty = fp.filters("")
    assert fp.likeness(empty, empty) == 1 and fp.likeness(empty, fp.filters("some text")) == 0


def test_missing_and_shared_ids_are_spread_and_follow_the_order(spark):
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, f"text {k * 7919 % 1000} " + "some words " * (k % 9)) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = docs.select("doc_id", "text", *fp._key()).orderBy("none", "down", "h").collect()
    want = []
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        want.append((str(r.doc_id), len(r.text), hashlib.sha256(fp.edited(r.text, after.text).encode()).hexdigest()))
    for parts in (1, 12):
        got = [(str(r.doc_id), r.n_chars, r.edited_sha256) for r in fp.fingerprints(docs, parts).collect()]
        assert sorted(got) == sorted(want)
    sizes = [r["count"] for r in fp.in_parts(docs, 12).where("not ghost").groupBy("part").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 200
