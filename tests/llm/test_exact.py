import hashlib

import pytest

from stemma.llm import exact


def brute(rows):
    out, groups = [], {}
    for d, text in rows:
        t = text or ""
        sha = hashlib.sha256("".join(c for c in t if c not in " \t\n\x0b\x0c\r").encode()).hexdigest()
        groups.setdefault(sha, []).append((-len(t), d is None, d or 0, d))
        out.append((d, sha))
    best = {k: min(v, key=lambda x: x[:3])[3] for k, v in groups.items()}
    return sorted(((d, best[s], len(groups[s]), d == best[s], s) for d, s in out), key=repr)


def test_against_brute_force(spark, odd, none, small_docs):
    for docs in (odd, small_docs):
        got = sorted(map(tuple, exact.exact_dedup(docs).collect()), key=repr)
        assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert exact.exact_dedup(none).count() == 0


def test_hot_digest(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot  text', concat('t', id div 2)) as text")
    got = sorted(map(tuple, exact.exact_dedup(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_the_index_persists_between_batches(spark, tmp_path):
    path = str(tmp_path / "index")
    a = spark.createDataFrame([(1, "x y"), (2, "xy"), (3, "z")], "doc_id long, text string")
    b = spark.createDataFrame([(4, "x  y"), (5, "new"), (6, "new ")], "doc_id long, text string")
    first = exact.exact_dedup(a, exact.DigestIndex(spark, path, 4), "a").where("kept").select("doc_id").collect()
    assert sorted(r[0] for r in first) == [1, 3]
    for _ in range(2):  # a batch that runs again gives the same
        index = exact.DigestIndex(spark, path, 4)
        got = {r.doc_id: (r.keep_id, r.kept) for r in exact.exact_dedup(b, index, "b").collect()}
        assert got == {4: (1, False), 5: (6, False), 6: (6, True)}
        assert index.read().count() == 3


def test_keep_first(spark, odd):
    kept = exact.keep_first(odd)
    assert kept.columns == odd.columns
    want = {(d, s) for d, _, _, ok, s in brute([(r.doc_id, r.text) for r in odd.collect()]) if ok}
    got = [(d, s) for d, _, _, _, s in brute([(r.doc_id, r.text) for r in kept.collect()])]
    assert len(got) == len(set(got)) and set(got) == want


def test_another_bucket_count_is_refused(spark, tmp_path):
    path = str(tmp_path / "index")
    exact.DigestIndex(spark, path, 4)
    with pytest.raises(ValueError, match="4 buckets"):
        exact.DigestIndex(spark, path, 8)


def test_keep_first_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a  b", "x", "z"), (2, "ab", None, None), (3, "c", "", "")], "doc_id long, text string, __id string, `__sha` string")
    out = exact.keep_first(docs)
    assert out.columns == docs.columns and sorted(r.text for r in out.collect()) == ["a  b", "c"]
