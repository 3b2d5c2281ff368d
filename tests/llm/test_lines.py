import hashlib

from stemma.llm import lines


def brute(rows, size=3):
    """The operator's result by loops; rows that repeat an id and text are one place."""
    first, out = {}, []
    for d, text in sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        ls = text.split("\n")
        for i in range(len(ls) - size + 1):
            first.setdefault(tuple(ls[i : i + size]), (d, text, i))
    for d, text in rows:
        ls = (text or "").split("\n")
        gone = set()
        for i in range(len(ls) - size + 1):
            if first[tuple(ls[i : i + size])] != (d, text or "", i):
                gone |= set(range(i, i + size))
        kept = [x for k, x in enumerate(ls) if k not in gone]
        out.append((d, len(ls), len(gone), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_small_tables(spark, small_docs, odd, none):
    for docs in (small_docs, odd):
        got = sorted(map(tuple, lines.digest(lines.dedup_lines(docs)).collect()), key=repr)
        assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert lines.dedup_lines(none).count() == 0


def test_overlaps_and_a_hot_window(spark):
    rows = [(k, f"u{k}\na\nb\nc\nv{k}") for k in range(300)] + [(900, "a\na\na\na\na"), (901, "b\nc\nd\ne\nb\nc\nd\ne"), (902, "x\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, lines.digest(lines.dedup_lines(docs)).collect()), key=repr)
    assert got == brute(rows)
