import math
import random

from stemma.operators import retrieval


def test_blocks_give_the_nearest(spark):
    # blocks of seven, copies that tie, a missing vector and one of another length
    rng = random.Random(4)
    rows = {k: [float(rng.randrange(-3, 4)) + 0.5 for _ in range(5)] for k in range(60)} | {k + 60: None for k in range(2)}
    rows |= {70 + k: rows[k] for k in range(20)} | {99: [1.0, 2.0]}
    v = spark.createDataFrame(list(rows.items()), "id long, v array<float>")

    def cos(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return round(dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)), 6)

    df = retrieval.dense(v, v.where("id % 9 = 0").selectExpr("id as query", "v"), 4, block=7)
    assert "Cartesian" in df._jdf.queryExecution().sparkPlan().toString()  # blocks, not a row for each pair
    got = {(r.query, r["rank"]): (r.id, r.score) for r in df.collect()}
    for q in (0, 9, 18, 45, 72, 81):
        best = sorted((-cos(rows[q], x), k) for k, x in rows.items() if k != q and x and len(x) == 5)[:4]
        assert [(got[q, r][0], -got[q, r][1]) for r in (1, 2, 3, 4)] == [(k, s) for s, k in best]
    assert len(got) == 4 * sum(k % 9 == 0 for k in rows)


def test_relevant_rows_are_counted_by_label(spark):
    rng = random.Random(6)
    labels = spark.createDataFrame([(k, rng.choice([0, 1, 2, None])) for k in range(40)] + [(40, 9)], "id long, label int")
    q = labels.where("id % 5 = 0").selectExpr("id as query", "label")
    ranked = spark.createDataFrame([(k, j, r) for k in range(0, 41, 5) for r, j in enumerate(rng.sample([x for x in range(41) if x != k], 12), 1)], "query long, id long, rank int")
    pairs = q.join(labels, "label").where("id <> query").select("query", "id")
    assert retrieval.recall_mrr_by_label(ranked, labels, q, 10).collect() == retrieval.recall_mrr(ranked, pairs, 10).collect()
