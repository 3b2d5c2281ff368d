import json

import pytest

from stemma import schema
from stemma.functions import text
from stemma.operators import registry, validate
from stemma.sources import files
from stemma.streaming import revisions
from pyspark.sql import functions as F


def rules(df):
    return sorted((r.rule, r.object_id) for r in df.collect())


def test_edges(spark):
    e = spark.createDataFrame(
        [
            ("a", "b", "scope_dependency", "r", "ACCEPTED", "ORACLE_PROPOSED", "x", "y"),
            ("a", "b", "definition_dependency", "r", "ACCEPTED", "ORACLE_PROPOSED", "x", "y"),  # the same ends, another type
            ("a", "a", "data_dependency", "r", "CANDIDATE", None, "x", "y"),
            ("a", "z", "odd", "", "MAYBE", "ORACLE_PROPOSED", "", None),
        ],
        "src string, dst string, type string, reason string, disposition string, oracle_status string, source_alignment string, lean_support string",
    )
    got = rules(validate.edge_gates(e, spark.createDataFrame([("a",), ("b",)], "id string")))
    assert got == sorted([("duplicate edge", "a>b"), ("self loop", "a>a"), ("unknown target", "a>z"), ("edge type", "a>z"), ("disposition", "a>z"), ("reason", "a>z"), ("oracle status", "a>a"), ("source alignment", "a>z"), ("lean support", "a>z")])
    assert validate.verdict(validate.edge_gates(e, spark.createDataFrame([("a",)], "id string"))).first().verdict == "FAILED"


def test_coverage_and_releases(spark):
    def duty(route, status="PASSED", evidence=("e",), declarations=("d",)):
        return (route, status, list(evidence), list(declarations))

    full = [duty(r) for r in schema.ROUTES[:4]]
    rows = [
        ("ok", "k", False, full, [("EMPIRICAL", "none")]),
        ("twice", "k", False, [*full, duty("EMPIRICAL")], [("EMPIRICAL", "none")]),
        ("short", "k", True, full[:3], [("EMPIRICAL", "")]),
        ("kernel", "k", False, [duty("LEAN_KERNEL", "KERNEL_CHECKED", ["e"], []), duty("SOURCE_ALIGNMENT", "OPEN"), *full[2:]], [("EMPIRICAL", "none")]),
    ]
    objects = spark.createDataFrame(rows, schema.PARTITION)
    assert rules(validate.coverage(objects)) == sorted([("route coverage", "twice"), ("route coverage", "short"), ("reason", "short"), ("approximation", "short"), ("declarations", "kernel")])
    contracts = spark.createDataFrame([("c1", "ok", True, "VERIFIED"), ("c2", "kernel", True, "DRAFT"), ("c3", "kernel", False, "DRAFT")], "id string, statement string, accepted boolean, lifecycle_status string")
    assert rules(validate.lifecycle(contracts)) == [("lifecycle", "c2")]
    # one accepted export makes every open obligation of its root an error, also those of other objects and without a status
    exports = spark.createDataFrame([("r1", True), ("r1", False), ("r2", False), ("r3", None)], "root string, accepted boolean")
    held = "root string, object_id string, verification_obligations array<struct<route:string,status:string>>"
    obligations = [("r1", "p", [("LEAN_KERNEL", "OPEN"), ("EMPIRICAL", "PASSED")]), ("r1", "q", [("EMPIRICAL", None)]), ("r2", "s", [("EMPIRICAL", "OPEN")]), ("r3", "t", [("EMPIRICAL", "OPEN")])]
    assert rules(validate.unclosed_exports(exports, spark.createDataFrame(obligations, held))) == [("release", "p"), ("release", "q")]


def test_missing_keys_are_not_nulls(spark):
    rows = spark.createDataFrame([("a", {"kind": None, "status": "x"}), ("b", {"status": "y"})], "id string, record map<string,string>")
    assert rules(validate.present(rows, ["kind", "status"])) == [("missing field", "b")]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "status": "OPEN"}\n\n{"id": \n{"id": "y"}\n')
    good, bad = files.read_checked(spark, str(tmp_path / "a.jsonl"), "id string, status string")
    assert sorted((r.line, r.id) for r in good.collect()) == [(1, "x"), (4, "y")] and [r.line for r in bad.collect()] == [3]
    (tmp_path / "m.json").write_text(json.dumps({"algorithm": "sha256", "hashes": {"p": "sha256:ab", "q": "cd"}}))
    entries = files.manifest_entries(files.read_json(spark, str(tmp_path / "m.json"), schema.HASHES))
    assert sorted((r.path, r.sha256) for r in entries.collect()) == [("p", "ab"), ("q", "cd")]
    have = spark.createDataFrame([("q", "xx")], "path string, sha256 string")
    assert [r.path for r in files.missing_files(entries, have).collect()] == ["p"] and [r.path for r in files.stale_files(entries, have).collect()] == ["q"]
    assert files.file_hashes(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError):
        files.inside(str(tmp_path), str(tmp_path / ".."))
    docs = spark.createDataFrame([("f", '{"anchors": "a/b", "path": "no", "x": {"artifacts": ["c", ["d"], {"other": "e", "exports": "g\\"h"}], "other": "i"}}'), ("bad", "{"), ("none", None)], "file string, raw string")
    assert [tuple(r) for r in files.leaf_paths(docs).collect()] == [("f", "a/b"), ("f", "c"), ("f", "d"), ("f", 'g"h')]


def test_lines(spark):
    rows = spark.createDataFrame([("one\x0ctwo\nthree\r\nfour",)], "t string")
    r = rows.select(text.excerpt(F.col("t"), F.lit(2), F.lit(3)).alias("a"), text.line_hash(F.col("t"), F.lit(1), F.lit(1)).alias("b"), F.sha2(F.lit("one\x0ctwo\n"), 256).alias("c"), text.excerpt(F.col("t"), F.lit(2), F.lit(None).cast("int")).alias("d")).first()
    assert (r.a, r.b, r.d) == ("two\nthree\r\n", r.c, None)
    r = spark.range(1).select(text.percent(F.lit(1), F.lit(8)).alias("p"), text.percent(F.lit(0), F.lit(0)).alias("z"), text.code(F.lit(7)).alias("c"), text.code(F.lit(123)).alias("d"), text.html_escape(F.lit('a<"&')).alias("h")).first()
    assert tuple(r) == (13, 0, "A07", "A123", "a&lt;&quot;&amp;")
    r = spark.createDataFrame([("by\n  sorry\n", "x := by sorry", "no axioms")], "a string, b string, c string").select(text.placeholders(F.col("a")).alias("a"), text.placeholders(F.col("b")).alias("b"), text.placeholders(F.col("c")).alias("c")).first()
    assert tuple(r) == (True, True, False)


def test_revisions_and_versions(spark, tmp_path):
    r = spark.range(1).select(registry.same_major(F.lit("1.4.0"), F.lit("1.2.9")).alias("a"), registry.same_major(F.lit("2.0.0"), F.lit("1.9.0")).alias("b")).first()
    assert tuple(r) == (True, False)
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], "k long, at long, v string")
    assert sorted(r.v for r in registry.latest(rows, "k", ["at"]).collect()) == ["b", "c"]
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    revisions.log(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_reports_and_exit_states(spark):
    make = lambda ddl, rows=(): spark.createDataFrame(list(rows), ddl)
    statements = lambda rows: make("id string, source_anchors array<string>, logical_form struct<hypotheses:array<string>>", rows)
    steps = make("id string, inputs array<string>, outputs array<string>, source_anchors array<string>, verification_records array<string>, active_assumptions array<string>", [("t", ["a"], ["b"], ["x"], ["v"], ["a"])])
    contract = "id string, statement string, accepted boolean, lifecycle_status string, assumptions array<string>, imports array<struct<contract:string,status:string>>, blockers array<string>"
    foundations, blocker, ids = make("statement_id string", [("f",)]), "id string, status string", lambda *x: make("id string", [(i,) for i in x])

    def run(s, contracts, blockers, nodes, edges):
        return validate.report(validate.integrity(statements(s), foundations, steps, make(contract, contracts), make(blocker, blockers), ids("x"), ids("v"), ids(*nodes), make("src string, dst string, step string", edges)))

    good = [("a", ["x"], (["b"],)), ("b", [], None)]
    fine = run(good, [("c", "b", True, "VERIFIED", ["free text", "assumption:1"][:1], [("f", "ACCEPTED")], [])], [("k", "RESOLVED")], ["a", "b"], [("a", "b", "t")])
    assert sorted(map(tuple, fine.collect())) == [("release gate", "PASSED", 0), ("verdict", "PASSED", 0)] and validate.exit_state(fine, strict=True) == 0
    warned = run(good, [("c", "b", False, "DRAFT", [], [], [])], [("k", "OPEN")], ["a", "b"], [("a", "b", "t")])
    assert {(r.rule, r.severity, r.n) for r in warned.collect()} >= {("verdict", "PASSED", 0), ("release gate", "BLOCKED", 2)} and (validate.exit_state(warned), validate.exit_state(warned, strict=True)) == (0, 1)
    bad = run([("a", ["y"], (["z"],)), ("b", [], None)], [("c", "q", True, "DRAFT", ["assumption:1"], [("g", "ACCEPTED")], ["m"])], [], ["a", "b", "w"], [("b", "a", "t"), ("a", "b", "u"), ("a", "n", "t")])
    got = {r.rule: r.n for r in bad.collect()}
    names = "unknown source anchor,unknown hypothesis,unknown exported statement,unknown assumption,unknown import,unknown blocker,lifecycle,unknown node,undeclared endpoint,unknown step".split(",")
    assert all(got[x] == 1 for x in names) and got["edge and step disagree"] == 2 and got["cycle"] == 3 and validate.exit_state(bad) == 1
