import re

import corpus_pipeline
from stemma.llm.common import materialize

from .conftest import TINY
from .test_exact import brute as exact_brute
from .test_minhash import brute as near_brute
from .test_packing import verify


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    names = docs.columns
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = docs
        docs = stage(spark, docs, TINY)
        if name != "best-fit packing":
            assert docs.columns == names and docs.dtypes == before[name].dtypes
            docs = materialize(docs, "test-stage")
    rows = {k: {r.doc_id: r for r in d.collect()} for k, d in before.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{TINY}/labels.parquet").collect()}
    kept, good = rows["exact dedup"], [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    pairs = [(d, r.text) for d, r in kept.items()]
    assert set(rows["near dedup"]) == {d for d, _, _, ok, _ in exact_brute(pairs) if ok}
    pairs = [(d, r.text) for d, r in rows["near dedup"].items()]
    assert set(rows["personal data"]) == {d for d, _, c in near_brute(pairs, 5) if d == c}
    assert set(rows["best-fit packing"]) == set(rows["personal data"])
    secrets = re.compile(r"[\w.]+@[\w.]+\w|\+\d \(\d+\) \d+-\d+|(?<!\w)[0-9a-fA-F]{40}(?!\w)|(?<!\d)\d{16}(?!\d)")
    for d, r in rows["personal data"].items():
        after = rows["best-fit packing"][d]
        assert after.n_chars == len(after.text) and not any(x in after.text for x in secrets.findall(r.text))
        if not secrets.search(r.text) and not re.search(r"\d+\.\d+\.\d+\.\d+", r.text):
            assert after.text == r.text
    verify(docs.collect(), before["best-fit packing"].collect())
