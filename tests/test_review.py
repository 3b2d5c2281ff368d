import hashlib
from itertools import combinations

import numpy as np
import pytest

from stemma.operators import candidates, lp, pauli, review
from stemma.plans import audits, claims
from stemma.sources.adapters import Tables

SMALL = "/root/testdata/sf0.001"


def rules(df):
    return sorted((r.rule, r.object_id, r.detail) for r in df.collect())


def test_equality(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "pos int, value string")
    b = spark.createDataFrame([("x", 1), (None, 2)], "value string, pos int")
    assert rules(review.same_rows(a, b)) == [("missing row", "1>x", None)]
    assert review.same_sets(a, b).count() == 0
    one, two = a.where("pos = 2"), spark.createDataFrame([(2, "y"), (3, None)], "pos int, value string")
    assert rules(review.same_lists(one, two)) == [("list", "2", "other"), ("list", "3", "extra")]
    assert rules(review.same_lists(two, one)) == [("list", "2", "other"), ("list", "3", "missing")]
    nodes = spark.createDataFrame([(1, None), (2, "NON_MATHEMATICAL"), (3, "x")], "id int, interface_class string")
    assert sorted(r.id for r in review.mathematical(nodes).collect()) == [1, 3]


def test_receipts(spark):
    rows = [("all", [("a", "satisfied")]), ("some", [("a", "satisfied"), ("b", "conditional")]), ("open", [("a", "conditional"), ("b", "pending")]), ("null", [("a", None)]), ("none", []), ("gone", None)]
    got = review.import_receipts(spark.createDataFrame(rows, "id string, assumptions array<struct<name:string,status:string>>"))
    assert {r.id: r.verdict for r in got.collect()} == {"all": "SATISFIED", "some": "CONDITIONAL", "open": "BLOCKED", "null": "BLOCKED", "none": "SATISFIED", "gone": "BLOCKED"}


def test_reuse_needs_every_condition(spark):
    schema = "id int, statement_ok boolean, assumptions_ok boolean, version_ok boolean, environment_ok boolean, verified boolean, blocked boolean, source string"
    rows = [(1, True, True, True, True, True, False, "c"), (2, None, True, True, False, True, None, ""), (3, True, True, True, True, True, False, "c")]
    edges = spark.createDataFrame([(9, 3)], "src int, dst int")
    got = rules(review.reuse_gates(spark.createDataFrame(rows, schema), spark.createDataFrame([(9,)], "id int"), edges))
    assert [(r, i) for r, i, _ in got] == [("blocked", "2"), ("environment", "2"), ("invalidated", "3"), ("receipt", "2"), ("statement", "2")]


def test_changes_can_be_undone(spark):
    log = spark.createDataFrame([(1, 2, 1, "ACCEPTED"), (1, 2, 2, "REJECTED"), (1, 3, 2, None), (1, 2, 3, "CONDITIONAL")], "src int, dst int, revision int, state string")
    at = lambda n: sorted((r.src, r.dst) for r in review.at_revision(log, n).collect())
    assert [at(n) for n in range(4)] == [[], [(1, 2)], [(1, 3)], [(1, 2), (1, 3)]]


def test_change_gates(spark):
    schema = "id string, kind string, before int, after int, evidence string, meaning_before string, meaning_after string, assumptions_before array<string>, assumptions_after array<string>, blockers_before array<string>, blockers_after array<string>, provenance_before array<string>, provenance_after array<string>"
    rows = [
        ("good", "split_node", 1, 2, "e", "m", "m", ["a"], ["a", "b"], ["k"], [], ["p"], ["p"]),
        ("bad", "prune", 1, 9, None, "m", "n", ["a"], None, ["l"], [], ["p"], ["q"]),
        ("empty", None, None, None, "e", None, None, None, None, None, None, None, None),
    ]
    got = rules(review.change_gates(spark.createDataFrame(rows, schema), spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([("e",)], "id string"), spark.createDataFrame([("k",)], "blocker string")))
    assert {(r, i) for r, i, _ in got} == {
        ("change kind", "bad"), ("change kind", "empty"), ("unknown revision after", "bad"), ("unknown revision before", "empty"), ("unknown revision after", "empty"), ("unknown evidence", "bad"),
        ("meaning", "bad"), ("assumption lost", "bad"), ("blocker lost", "bad"), ("provenance lost", "bad"),
    }


def test_roots(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 3)], "src int, dst int")
    got = {r.id: r.role for r in review.roles(edges, spark.createDataFrame([(3,)], "id int")).collect()}
    assert got == {1: "root", 2: "intermediate", 3: "target", 4: "root"}
    roots = spark.createDataFrame([("a", "SOURCE_UNAVAILABLE", ["t"]), ("b", None, []), ("c", "BORED", None)], "id string, stop_reason string, expected_exports array<string>")
    assert [(r, i) for r, i, _ in rules(review.root_gates(roots))] == [("expected exports", "b"), ("expected exports", "c"), ("stop reason", "b"), ("stop reason", "c")]


def test_audit_of_a_proof(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "declaration string")
    entries = spark.createDataFrame([("a", "propext"), ("b", "sorryAx"), ("c", None)], "declaration string, axiom string")
    sources = spark.createDataFrame([("x", "  admit"), ("y", "import Bad"), ("z", None)], "path string, text string")
    manifest, files = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "3")], "path string, sha256 string"), spark.createDataFrame([("x", "1"), ("y", "0")], "path string, sha256 string")
    pins = spark.createDataFrame([("build", "0", None)], "key string, expected string, actual string")
    got = rules(review.proof_audit(entries, names("a", "b", "d"), names("a", "c"), sources, manifest, files, pins, ("Bad",), exact=True))
    assert [(r, i) for r, i, _ in got] == sorted([
        ("missing declaration", "d"), ("required declaration", "c"), ("not required", "b"), ("not required", "d"), ("unexpected axiom", "sorryAx"), ("placeholder", "x"),
        ("forbidden import", "y"), ("missing artifact", "w"), ("stale artifact", "y"), ("pin", "build"),
    ])


def test_proposal(spark):
    row = lambda a, b: (a, b, "data_dependency", "r", "CANDIDATE", "ORACLE_PROPOSED", "x", "y")
    edges = spark.createDataFrame([row("a", "b"), row("b", "c"), row("c", "b"), row("c", "z")], "src string, dst string, type string, reason string, disposition string, oracle_status string, source_alignment string, lean_support string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "id string")
    got = {(r, i) for r, i, _ in rules(review.proposal_gates(nodes, edges))}
    assert {("missing id", None), ("duplicate id", "c"), ("unknown target", "a>b")} & got == {("missing id", None), ("duplicate id", "c")}
    assert {("unknown target", "c>z"), ("cycle", "b"), ("cycle", "c")} <= got and ("cycle", "a") not in got


def test_numbers(spark):
    rows = spark.createDataFrame([(0.0, 1), (-1e-15, 1), (0.5, 1)], "v double, k int")
    assert sorted(str(r.v) for r in review.rounded(rows, 12, "v").collect()) == ["0.0", "0.5"]
    kernel = spark.createDataFrame([("a", "u", 0.5), ("a", "v", 0.5), ("b", "u", 1.5), ("b", "v", -0.5), ("c", "u", 0.9)], "x string, y string, prob double")
    assert [(r, i) for r, i, _ in rules(review.stochastic(kernel))] == [("negative", "b"), ("row sum", "c")]
    p = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0)], "graph string, x string, p double")
    assert {r.y: r.p for r in review.push_forward(p, kernel).collect()} == {"u": 3.5, "v": -0.5}


def anti(a, b):
    return sum(p != "I" and q != "I" and p != q for p, q in zip(a, b, strict=True)) % 2 == 1


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_families(n):
    jw = pauli.family("jw", n)
    assert len(set(jw)) == 2 * n + 1 and all(anti(a, b) for a, b in combinations(jw, 2))
    tree, d, r = pauli.family("tree", n), 3 * n // 2, (n + 1) // 2 - 1
    assert len(set(tree)) == d + r and "I" * n not in tree
    # two products of strings anticommute where they share one string
    pairs = [{0, a} for a in range(1, d + 1)] + [{a, d + a} for a in range(1, r + 1)]
    assert all(anti(tree[i], tree[j]) == (len(pairs[i] & pairs[j]) == 1) for i, j in combinations(range(d + r), 2))


def test_family_ceilings(spark):
    got = {r.graph: r for r in claims.QUERIES["family_ceilings"](spark, SMALL).collect()}
    for n in (2, 3, 4):
        assert (got[f"local{n}"].omega, got[f"ising{n}"].omega, got[f"tree{n}"].omega, got[f"jw{n}"].omega) == (3, 2, 3 * n // 2, 2 * n + 1)
    assert all(r.omega <= r.largest and abs(r.capacity**2 - r.omega) < 1e-9 for r in got.values())


def test_fractional_clique_cover(spark):
    five = np.array([[1, 1, 0, 0, 0], [0, 1, 1, 0, 0], [0, 0, 1, 1, 0], [0, 0, 0, 1, 1], [1, 0, 0, 0, 1]], dtype=float)
    assert lp.clique_cover(five, np.ones(5)) == (pytest.approx(2.5), True)
    with pytest.raises(ValueError):
        lp.clique_cover(five[:1], np.ones(5))
    got = {r.graph: r for r in claims.QUERIES["fractional_clique_cover"](spark, SMALL).collect()}
    alpha = {r.graph: r.alpha for r in claims.QUERIES["mwis"](spark, SMALL).collect()}
    v = Tables(spark, SMALL).pauli()
    edges = pauli.pairs(v).where("anti").join(v.groupBy("graph").count().withColumnRenamed("count", "n"), "graph").select("graph", "n", "i", "j")
    perfect = {r.graph for r in lp.perfect_by_graph(edges).collect() if r.perfect}
    assert set(got) == set(alpha) and all(r.certified for r in got.values())
    assert perfect and all(got[g].value == pytest.approx(alpha[g], abs=1e-4) for g in perfect)
    assert all(got[g].value >= alpha[g] - 1e-4 for g in got)


def test_candidates(spark):
    text = "# One\nWe prove it.\n\\section{Two}\nlead \\begin{lemma}[x]\nwe show é\n\\end{lemma} tail\n\\subsection{Three}\n\\begin{theorem}a\\end{theorem}\n### Deep\n\\begin{claim}\nopen"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (None, "we show")], "id int, text string")
    got = sorted(candidates.candidates(docs).collect(), key=lambda r: (r.id is None, r.id, r.start))
    assert [(r.id, r.kind, r.line, r.section) for r in got] == [(1, "phrase", 1, "One"), (1, "lemma", 3, "Two"), (1, "theorem", 7, "Two/Three"), (1, "claim", 9, "Two/Three/Deep"), (None, "phrase", 0, "")]
    assert [text[r.start : r.end] for r in got[1:4]] == ["\\begin{lemma}[x]\nwe show é\n\\end{lemma}", "\\begin{theorem}a\\end{theorem}", "\\begin{claim}\nopen"]
    assert all(r.content_hash == hashlib.sha256((text if r.id else "we show")[r.start : r.end].encode()).hexdigest() for r in got)


def test_step_measures(spark):
    schema = "output int, inputs array<int>"
    gold = spark.createDataFrame([(1, [1, 2]), (1, [1, 2]), (2, []), (3, [5])], schema)
    said = spark.createDataFrame([(1, [2, 1, 1]), (1, [7]), (2, []), (9, [1])], schema)
    r = candidates.step_measures(gold, said).first()
    assert (r.steps, r.found, r.exact, r.input_f1) == (4, 3, 0.75, 0.75)
    none = candidates.step_measures(gold.limit(0), said).first()
    assert (none.steps, none.found, none.exact, none.input_f1) == (0, 0, None, None)


def test_features(spark):
    c = spark.createDataFrame([(1, ["a", "b"], "s", []), (2, ["b", "c"], "s", [1]), (3, [], None, None)], "id int, symbols array<string>, section string, citations array<int>")
    got = {r.dst: (r.shared, round(r.likeness, 6), r.same_section, r.cites) for r in candidates.features(spark.createDataFrame([(1, 2), (1, 3)], "src int, dst int"), c).collect()}
    assert got == {2: (1, 0.333333, True, True), 3: (0, 0.0, False, False)}


def test_registered():
    assert audits.query is claims.query and {"proof_report", "change_report", "machine_violations"} <= set(claims.SQL)
