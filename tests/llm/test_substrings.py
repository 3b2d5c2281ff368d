import hashlib
import random
from collections import Counter

import numpy as np

from stemma.llm import substrings as S


def brute(rows, window=35):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = []
    for d, w in texts:
        gone = {j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def got(docs, **kw):
    return sorted(map(tuple, S.remove_repeats(docs, hashed=True, **kw).collect()), key=repr)


def test_small_table(spark, small_docs):
    assert got(small_docs) == brute([(r.doc_id, r.text) for r in small_docs.collect()])


def test_odd_rows(spark, odd, none):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert S.remove_repeats(none).count() == 0


def test_repeats_runs_and_borders(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    some = lambda n: rng.choices(words, k=n)
    p = some(60)
    rows = [(k, " ".join(some(rng.randrange(50)) + p[: rng.randrange(30, 61)] + some(rng.randrange(50)))) for k in range(60)]
    rows += [(100, "a " * 40), (101, "b " * 34), (102, "c " * 35), (103, "x y " * 30), (104, "x y " * 17), (105, " ".join(p[5:45] + p[5:45])), (106, " ".join(p)), (106, " ".join(p)), (107, " ".join(some(35)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == brute(rows)
    assert got(docs, window=7) == brute(rows, 7)


def test_equal_substrings_have_equal_inner_symbols():
    rng = np.random.default_rng(5)
    common = rng.integers(0, 40, 400).astype(np.uint64)
    sides = []
    for n in (3, 77):
        h = np.concatenate([rng.integers(0, 40, n).astype(np.uint64), common, rng.integers(0, 40, n + 9).astype(np.uint64)])
        name, low, high = S.recompress(h, 5)
        inside = (low >= n) & (high <= n + 400)
        sides.append([(a, b - n, c - n) for a, b, c in zip(name[inside].tolist(), low[inside].tolist(), high[inside].tolist(), strict=True)])
    assert sides[0] == sides[1] and len(sides[0]) > 20


def test_long_runs_inside_unique_prose(spark):
    unique = iter(range(10**6))
    fresh = lambda n: [f"u{next(unique)}" for _ in range(n)]
    rows = [(1, " ".join(fresh(200) + ["na"] * 60 + fresh(200)))]
    rows += [(k, " ".join(fresh(150) + ["la"] * n + fresh(150))) for k, n in ((2, 35), (3, 35), (4, 36))]
    rows += [(5, " ".join(fresh(300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == brute(rows)
    assert {r.doc_id: r.n_removed for r in S.remove_repeats(docs).collect()} == {1: 60, 2: 35, 3: 35, 4: 36, 5: 0}


def test_passages_that_end_in_runs_of_other_lengths(spark):
    rng = random.Random(3)
    unique = iter(range(10**6))
    fresh = lambda n: [f"u{next(unique)}" for _ in range(n)]
    rows = []
    for k in range(150):  # a run goes on behind the passage, or comes before it, in one of two texts
        p, more = fresh(33), ["k"] * rng.randrange(20, 40)
        a, b = (p + ["k", "k"], p + ["k", "k"] + more) if k % 2 else (["k", "k"] + p, more + ["k", "k"] + p)
        rows += [(2 * k, " ".join(fresh(50) + a + fresh(50))), (2 * k + 1, " ".join(fresh(50) + b + fresh(50)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == brute(rows)


def test_spans_do_not_depend_on_what_lies_beyond():
    rng = np.random.default_rng(8)
    for _ in range(300):
        common = np.concatenate([np.full(2, 7), rng.integers(10, 400, 60), np.full(2, 7)]).astype(np.uint64)
        sides = []
        for n in (0, rng.integers(1, 60)):
            run = np.full(n, 7, np.uint64)
            h = np.concatenate([np.array([1, 2], np.uint64), run, common, run, np.array([3, 4], np.uint64)])
            name, low, high = S.recompress(h, 6)
            inside = (low >= n + 2) & (high <= n + 2 + len(common))
            sides.append(list(zip(name[inside].tolist(), (low[inside] - n).tolist(), (high[inside] - n).tolist(), strict=True)))
        assert sides[0] == sides[1]


def test_a_million_words_of_period_two_and_many_rows_without_an_id(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(5000)]
    shared = rng.choices(words, k=50)
    rows = [(1, "x y " * 500_000 + " ".join(rng.choices(words, k=60)))]
    rows += [(None, " ".join(rng.choices(words, k=40) + (shared if k % 100 == 0 else []))) for k in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert got(docs) == brute(rows)


def test_runs_are_named_in_each_round():
    # a run of a pair that only the first round makes is named in the second: (1 2) * 300 gets few symbols
    rng = np.random.default_rng(2)
    for _ in range(20):
        h = np.concatenate([rng.integers(10, 10**6, 50), np.tile(rng.integers(10**6, 2 * 10**6, 2), 300), rng.integers(10, 10**6, 50)]).astype(np.uint64)
        name, _, _ = S.recompress(h, 8)
        assert len(name) < 60
