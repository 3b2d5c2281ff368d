import random

import numpy as np

from stemma.llm import minhash
from stemma.llm.components import components
from stemma.llm.shingles import shingle_set


def brute(rows, width=4, percent=80):
    sets = [set(shingle_set(t, width).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def got(docs, **kw):
    out = minhash.near_dedup(docs, **kw).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr)


def test_shingles_by_hand():
    assert len(shingle_set("A b c d e", 4)) == 2 and len(shingle_set("x", 4)) == 1 and len(shingle_set(None, 4)) == len(shingle_set(" \n", 4)) == 0
    assert (shingle_set("The CAT sat on", 4) == shingle_set("the cat\tsat\x0bon", 4)).all()
    assert (shingle_set("É a b c", 4) != shingle_set("é a b c", 4)).all() and len(shingle_set("a b c d e", 4)) == 1


def test_small_table(spark, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert got(small_docs) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = [x if x[1] else (x[0], 0, x[0]) for x in brute(rows)]
    assert got(odd) == sorted(want, key=repr)
    assert minhash.near_dedup(none).count() == 0 and minhash.keep_one(none).count() == 0


def test_chains_stars_and_a_passage_that_many_share(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(4000)]
    base, passage, rows = rng.choices(words, k=150), rng.choices(words, k=90), []
    for k in range(160):  # near copies, some of which are only near to others
        t = list(base)
        for _ in range(rng.choice([1, 3, 6, 8, 12])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((1000 + k, " ".join(t)))
    rows += [(3000 + k, " ".join(passage + rng.choices(words, k=rng.choice([10, 20, 40, 60])))) for k in range(80)]
    chain = rng.choices(words, k=200)
    for k in range(12):  # each near to the next alone
        rows.append((5000 - k, " ".join(chain)))
        chain = chain[8:] + rng.choices(words, k=8)
    rows += [(7000 + k, " ".join(words[k % 3 : k % 3 + 5])) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == brute(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, k) for k in range(300, 360)]
    df = spark.createDataFrame(edges, "a long, b long")
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    lone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {tuple(r) for r in components(df).collect()} == {(x, find(x)) for x in parent if x not in lone}


def test_keep_one(spark):
    rows = [(2, "a b c d e", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "y"), (3, "", None), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=repr) == [(1, "a b c d e", "y"), (3, "", None), (4, None, None)]


def _chain(rng, words, steps):
    t, out = rng.choices(words, k=200), []
    for _ in range(steps):  # each near to the next alone
        out.append(" ".join(t))
        t = t[12:] + rng.choices(words, k=12)
    return out


def test_chain_through_missing_and_repeated_ids(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(4000)]
    a, b, c, d = (_chain(rng, words, 3) for _ in range(4))
    rows = [(10, a[0]), (None, a[1]), (12, a[2])]  # a link without an id
    rows += [(None, t) for t in b]  # no id at all
    rows += [(20, c[0]), (20, c[1]), (20, c[2]), (20, d[0]), (21, d[1]), (22, d[2])]  # one id, two groups
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert {x[2] for x in want if x[0] in (10, 12)} == {10} and {x[2] for x in want if x[0] in (21, 22)} == {20}
    assert got(docs) == want


def test_keep_one_by_the_text_where_ids_do_not_tell(spark):
    rng = random.Random(13)
    words = [f"w{k}" for k in range(4000)]
    a, b, c, d = (_chain(rng, words, 2) for _ in range(4))
    lone = [" ".join(rng.choices(words, k=50)) for _ in range(3)]
    rows = [(1, a[0]), (None, a[1]), (None, b[0]), (None, b[1]), (None, lone[0]), (None, lone[1]), (5, c[0]), (5, c[1]), (5, lone[2]), (2, d[0]), (6, d[1]), (6, lone[2]), (None, "")]
    out = [tuple(r) for r in minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    groups = [{(1, a[0])}, {(None, b[0]), (None, b[1])}, {(None, lone[0])}, {(None, lone[1])}, {(5, c[0]), (5, c[1])}, {(5, lone[2])}, {(2, d[0])}, {(None, "")}]
    assert len(out) == len(groups) and all(len(g & set(out)) == 1 for g in groups)


def test_estimates_are_those_of_the_union_sketch():
    rng = np.random.default_rng(4)
    pool = np.sort(rng.choice(10**9, 900, replace=False))
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in rng.integers(5, 800, 60).tolist()]
    size = 64
    for a in sets[:20]:
        got_ = minhash.estimates(a[:size], [b[:size] for b in sets], 80, size, 0.19).tolist()
        for b, ok in zip(sets, got_, strict=True):
            union = sorted(set(a[:size].tolist()) | set(b[:size].tolist()))[:size]
            both = len(set(union) & set(a[:size].tolist()) & set(b[:size].tolist()))
            assert ok == (100 * both >= 61 * len(union))


def test_ids_shared_and_missing_on_a_whole_table(spark, small_docs):
    """Equal to brute force where a third of all rows share an id and a tenth have none, long texts among them."""
    rows = [(None if k % 10 == 3 else 7 if k % 3 == 0 else r.doc_id, r.text) for k, r in enumerate(small_docs.orderBy("doc_id").collect())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [x if x[1] else (x[0], 0, x[0]) for x in brute(rows)]
    assert got(docs) == sorted(want, key=repr)
    assert got(docs, certain=True) == sorted(want, key=repr)
