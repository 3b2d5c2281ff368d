import pytest

from stemma import schema
from stemma.operators.query import Bundle


@pytest.fixture(scope="module")
def bundle(spark):
    make = lambda rows, ddl: spark.createDataFrame([tuple(r) for r in rows], ddl)
    statements = make(
        [("s:a", "lemma", "given", "SOURCE_EXPLICIT", ["x:1"], None), ("s:b", "lemma", "middle", "AGENT_INFERRED", [], (["h:9"],)), ("s:c", "theorem", "", "AGENT_INFERRED", ["x:1", "x:2"], (["h:1", "a:2"],)), ("s:d", "note", "apart", "COMPUTATIONALLY_REPRODUCED", [], (None,))],
        "id string, kind string, text string, origin string, source_anchors array<string>, logical_form struct<hypotheses:array<string>>",
    )
    foundations = make([("s:f", "foundation", "stands", "CHECKED"), ("s:g", "foundation", "open", "UNCHECKED"), ("s:c", "theorem", "from below", "CHECKED")], "statement_id string, kind string, statement string, source_fidelity string")
    steps = make(
        [("t:1", ["s:a", "s:f"], ["s:b"], "BLOCKED", ["a:2", "a:1"], ["v:1", "v:9"]), ("t:2", ["s:b"], ["s:c"], "PARTIALLY_VERIFIED", ["a:2"], ["v:2", "v:1"])],
        "id string, inputs array<string>, outputs array<string>, status string, active_assumptions array<string>, verification_records array<string>",
    )
    contracts = make([("c:1", "s:c", True, ["a:3"], [("c:2", "BLOCKED")], ["b:9", "b:3"]), ("c:2", "s:d", False, [], [], None)], "id string, statement string, accepted boolean, assumptions array<string>, imports array<struct<contract:string,status:string>>, blockers array<string>")
    blockers = make([("b:1", "RESOLVED", ["s:c"]), ("b:2", "OPEN", ["s:d"]), ("b:3", "OPEN", ["s:a"])], "id string, status string, affects array<string>")
    anchors = spark.createDataFrame([("x:1", "p", (1, 2)), ("x:2", "p", (3, None))], "id string, artifact string, location struct<line_start:int,line_end:int>")
    texts = make([("p", "one\ntwo\nthree")], "path string, text string")
    return Bundle(statements, foundations, steps, contracts, blockers, anchors, make([("v:1",), ("v:2",)], "id string"), texts)


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_bases(bundle):
    plain = dict(pairs(bundle.basis(), "id", "basis"))
    assert plain == {"s:a": "DIRECT_SOURCE", "s:b": "BLOCKED", "s:c": "DERIVED_FROM_ACCEPTED_CHAIN", "s:d": "BLOCKED", "s:f": "IMPORTED_CONTRACT", "s:g": "BLOCKED"}
    assert dict(pairs(bundle.basis(recursive=True), "id", "basis")) == plain | {"s:c": "BLOCKED"}


def test_verbs(bundle, spark):
    assert pairs(bundle.run("claims"), "id", "text")[2] == ("s:c", "from below")
    r = bundle.run("why", "s:c").first()
    assert (r.basis, r.n_claims, r.n_steps, r.n_assumptions, r.n_blockers) == ("BLOCKED", 4, 2, 3, 4)
    assert pairs(bundle.run("blockers", "s:c"), "blocker") == [("b:1",), ("b:2",), ("b:3",), ("b:9",)]  # b:9 is listed by the contract and nowhere else
    assert pairs(bundle.blocker_hits(spark.createDataFrame([("s:c",)], "id string"), "OPEN"), "blocker") == [("b:2",), ("b:3",)]
    # of the target its own hypotheses count, not its contract's assumptions
    assert pairs(bundle.run("assumptions", "s:c"), "assumption") == [("a:1",), ("a:2",), ("h:1",)]
    assert pairs(bundle.run("dependencies", "s:c"), "level", "id") == [(0, "s:a"), (0, "s:f"), (1, "s:b"), (2, "s:c")]
    assert pairs(bundle.run("verification", "s:c"), "record") == [("v:1",), ("v:2",)]
    assert pairs(bundle.run("source", "s:a"), "anchor", "excerpt") == [("x:1", "one\ntwo\n")]
    assert bundle.run("source", "s:a").first().basis == "DIRECT_SOURCE"
    assert bundle.run("source", "s:c").collect()[1].excerpt is None
    assert pairs(bundle.run("exports"), "id", "basis") == [("c:1", "IMPORTED_CONTRACT"), ("c:2", "BLOCKED")]
    assert pairs(bundle.run("imports", "s:c"), "imported", "status") == [("c:2", "BLOCKED")]
    assert pairs(bundle.run("blockers"), "id") == [("b:2",), ("b:3",)] and bundle.open_blockers()[1] == "BLOCKED"


def test_unknown_and_missing_claims(bundle):
    assert bundle.run("why", "s:zz").first().basis == "BLOCKED"
    with pytest.raises(ValueError):
        bundle.run("why")


def test_schemas_parse(spark):
    for ddl in (schema.STATEMENT, schema.ANCHOR, schema.STEP, schema.VERIFICATION, schema.CONTRACT, schema.BLOCKER, schema.FOUNDATION, schema.PARTITION, schema.HASHES):
        assert spark.createDataFrame([], ddl).columns


def test_states_of_a_query(spark):
    """Pending reviews are edges that are neither accepted nor conditional; bindings and blockers keep it from being verified."""
    from stemma.operators.state import query_state

    nodes = spark.createDataFrame(
        [("a", "NOT_APPLICABLE", "EXISTING_PROJECT_DECLARATIONS", []), ("b", "SOURCE_FOUND_AND_VERIFIED", "NOT_APPLICABLE", None), ("c", "NOT_APPLICABLE", "GAP", []), ("d", "BLOCKING_UNRESOLVED_CLAIM", "NOT_APPLICABLE", ["x", "x"]), ("e", "NOT_APPLICABLE", "NOT_APPLICABLE", [])],
        "id string, external string, binding string, blocker_ids array<string>",
    )
    for said, want in (("ACCEPTED", "TRUE"), ("CONDITIONAL", "TRUE"), ("CANDIDATE", "NOT EVALUABLE"), ("DISPUTED", "NOT EVALUABLE"), ("REJECTED", "NOT EVALUABLE"), ("BLOCKED", "NOT EVALUABLE"), (None, "NOT EVALUABLE")):
        edges = spark.createDataFrame([("a", "b", said), ("c", "e", "ACCEPTED"), ("d", "e", "ACCEPTED")], "src string, dst string, disposition string")
        got = {r.target: r for r in query_state(spark.createDataFrame([("b",), ("c",), ("e",)], "id string"), nodes, edges).collect()}
        assert (got["b"].dag_complete, got["b"].verification_closed, got["b"].pending_reviews) == (want, "NOT ESTABLISHED", int(want != "TRUE"))
        assert (got["c"].dag_complete, got["c"].verification_closed) == ("TRUE", "FALSE") and (got["e"].dag_complete, got["e"].blockers, got["e"].blocker_refs) == ("FALSE", 1, 2)
