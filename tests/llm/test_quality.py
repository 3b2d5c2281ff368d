import zlib

import numpy as np

from stemma.llm import quality

from .conftest import SMALL


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out(spark, small_docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = {r.doc_id: r for r in quality.score_documents(small_docs, labels).collect()}
    assert len(got) == small_docs.count()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.quality, got[r.doc_id].score) for r in labels.collect() if got[r.doc_id].held_out]
    y, s = np.array([x for x, _ in held]), np.array([x for _, x in held])
    assert auc(y, s) > 0.95 and (s[y == 1] >= 0.3).mean() > 0.97
    # held-out labels and other columns change nothing
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    again = {r.doc_id: r.score for r in quality.score_documents(small_docs.selectExpr("doc_id", "text", "'zz' as lang"), other).collect()}
    assert again == {d: r.score for d, r in got.items()}
    kept = quality.keep_good(small_docs, labels)
    assert kept.columns == small_docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.predicted}


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1), (6, None), (7, 1), (8, 0)], "doc_id long, quality int")
    got = quality.score_documents(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert {r.score for r in quality.score_documents(odd, labels.where("false")).collect()} == {0.5}
    assert quality.score_documents(none, labels).count() == 0


def test_word_vectors_by_brute_force(spark):
    texts = ["a b c a", "b b", "", "c"]
    places, signs = quality.random_vectors()
    want = np.zeros((quality.VOCABULARY, quality.WIDTH))
    for t in texts:
        rows = quality.token_rows(t)
        for i in range(len(rows)):
            for j in range(max(0, i - quality.REACH), min(len(rows), i + quality.REACH + 1)):
                if i != j:
                    np.add.at(want[rows[i]], places[rows[j]], signs[rows[j]])
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert np.allclose(quality.word_vectors(docs), want, atol=1e-6)
