"""Queries of reviews and audits, each with its SQL; they join those of claims.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.operators import candidates, lp, pauli, review, state, validate
from stemma.plans.claims import query, summed
from stemma.schema import CHANGES, EDGE_MACHINE, FORMAL_MACHINE, NODE_MACHINE, STOP_REASONS
from stemma.sources.adapters import Tables
from stemma.sources.files import audit_entries


def key() -> Column:
    return F.col("p_partkey")


def size() -> Column:
    return F.col("p_size")


def no_text() -> Column:
    return F.lit(None).cast("string")


def pick(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def names(*values: str):
    return F.array(*map(F.lit, values)).cast("array<string>")


# equality
@query("SELECT p_partkey AS id, CASE WHEN p_size % 6 <> 1 THEN 'MATHEMATICAL' END AS interface_class FROM part WHERE p_size % 6 <> 0")
def interface_claims(t: Tables) -> DataFrame:
    kind = F.when(size() % 6 == 0, "NON_MATHEMATICAL").when(size() % 6 == 1, no_text()).otherwise("MATHEMATICAL")
    return review.mathematical(t.part.select(key().alias("id"), kind.alias("interface_class")))


def drawn_edges(t: Tables) -> DataFrame:
    return t.edges().where("dst % 50 <> 0").unionByName(t.edges().where("dst % 70 = 0"))


@query("""dr AS (SELECT src, dst FROM e WHERE dst % 50 <> 0 UNION ALL SELECT src, dst FROM e WHERE dst % 70 = 0)
 SELECT 'missing row' AS rule, src || '>' || dst AS object_id, NULL::VARCHAR AS detail, 'error' AS severity FROM (SELECT src, dst FROM e EXCEPT ALL SELECT src, dst FROM dr)
 UNION ALL SELECT 'extra row', src || '>' || dst, NULL, 'error' FROM (SELECT src, dst FROM dr EXCEPT ALL SELECT src, dst FROM e)""")
def graph_equality(t: Tables) -> DataFrame:
    return review.same_rows(t.edges(), drawn_edges(t))


@query("SELECT 'missing row' AS rule, src || '>' || dst AS object_id, NULL::VARCHAR AS detail, 'error' AS severity FROM e WHERE dst % 50 = 0 AND dst % 70 <> 0")
def set_equality(t: Tables) -> DataFrame:
    return review.same_sets(t.edges(), drawn_edges(t))


@query("""SELECT 'list' AS rule, p_partkey::VARCHAR AS object_id, CASE WHEN p_size % 10 = 3 THEN 'missing' ELSE 'other' END AS detail, 'error' AS severity FROM part WHERE p_size % 10 IN (3, 4)
 UNION ALL SELECT 'list', (-p_partkey - 1)::VARCHAR, 'extra', 'error' FROM part WHERE p_size % 10 = 5""")
def list_equality(t: Tables) -> DataFrame:
    value = F.when(size() % 10 == 4, no_text()).otherwise(F.col("p_name")).alias("value")
    seen = t.part.where(size() % 10 != 3).select(key().alias("pos"), value).unionByName(t.part.where(size() % 10 == 5).select((-key() - 1).alias("pos"), F.col("p_name").alias("value")))
    return review.same_lists(t.part.select(key().alias("pos"), F.col("p_name").alias("value")), seen)


# receipts and reuse
@query("""SELECT p_partkey AS id, CASE WHEN p_size % 9 = 8 THEN 0 WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS satisfied, CASE WHEN p_size % 9 <> 8 AND p_size % 3 = 1 THEN 1 ELSE 0 END AS conditional,
 CASE WHEN p_size % 9 <> 8 AND p_size % 3 = 2 THEN 1 ELSE 0 END AS open, CASE WHEN p_size % 3 = 2 THEN 'BLOCKED' WHEN p_size % 3 = 1 THEN 'CONDITIONAL' ELSE 'SATISFIED' END AS verdict FROM part""")
def import_receipts(t: Tables) -> DataFrame:
    one = lambda name, status: F.struct(F.lit(name).alias("name"), status.alias("status"))
    second = F.when(size() % 3 == 0, "satisfied").when(size() % 3 == 1, "conditional").when(size() % 2 == 0, "pending")
    both = F.array(one("finite", F.lit("satisfied")), one("aligned", second))
    return review.import_receipts(t.part.select(key().alias("id"), F.when(size() % 9 != 8, both).alias("assumptions")))


@query(summed("""dn AS (SELECT id FROM n WHERE id IN (5, 17, 33) UNION SELECT e.dst FROM dn JOIN e ON e.src = dn.id), p AS (SELECT p_partkey AS k, p_size AS s FROM part),
 r AS (SELECT 'statement' AS rule, 'error' AS severity, count(*) AS n FROM p WHERE s % 5 = 0 UNION ALL SELECT 'assumptions', 'error', count(*) FROM p WHERE s % 7 = 0
  UNION ALL SELECT 'version', 'error', count(*) FROM p WHERE s % 3 = 1 UNION ALL SELECT 'environment', 'error', count(*) FROM p WHERE s = 11
  UNION ALL SELECT 'verification', 'error', count(*) FROM p WHERE s % 8 = 0 UNION ALL SELECT 'blocked', 'error', count(*) FROM p WHERE s % 6 = 0 OR s = 13
  UNION ALL SELECT 'receipt', 'error', count(*) FROM p WHERE s = 17 UNION ALL SELECT 'invalidated', 'error', count(*) FROM dn)"""))
def reuse_report(t: Tables) -> DataFrame:
    from stemma.operators.registry import same_major

    version = same_major(F.when(size() % 3 == 1, "2.0").otherwise("1.4"), F.lit("1.2"))
    receipts = t.part.select(
        key().alias("id"), (size() % 5 != 0).alias("statement_ok"), F.when(size() % 7 != 0, True).alias("assumptions_ok"), version.alias("version_ok"), (size() != 11).alias("environment_ok"), (size() % 8 != 0).alias("verified"),
        F.when(size() != 13, size() % 6 == 0).alias("blocked"), F.when(size() == 17, " ").otherwise("cache").alias("source"),
    )
    return validate.report(review.reuse_gates(receipts, t.nodes().where("id in (5, 17, 33)").select("id"), t.edges()))


# machines and changes
def _walks(t: Tables, table: dict) -> DataFrame:
    """Each part goes from state p_size % n to the next, or from two states ahead back."""
    states = list(dict.fromkeys([*table, *(x for after in table.values() for x in after)]))
    n = len(states)
    at = lambda place: F.get(names(*states), (place % n).cast("int"))
    first = t.part.select(key().alias("key"), F.lit(1).alias("seq"), at(size()).alias("state"))
    return first.unionByName(t.part.select(key().alias("key"), F.lit(2).alias("seq"), at(size() + F.when(key() % 3 == 0, 2).otherwise(1)).alias("state")))


def _machine_sql(label: str, table: dict) -> str:
    states = list(dict.fromkeys([*table, *(x for after in table.values() for x in after)]))
    allowed = ", ".join(f"('{a}', '{b}')" for a, after in table.items() for b in after)
    n, at = len(states), lambda place: f"{pick(states)}[({place}) % {len(states)} + 1]"
    return f"SELECT '{label}' AS machine, key, 2 AS seq, before, state FROM (SELECT p_partkey AS key, {at('p_size')} AS before, {at('p_size + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END')} AS state FROM part) WHERE (before, state) NOT IN ({allowed})"


MACHINES = {"node": NODE_MACHINE, "edge": EDGE_MACHINE, "formal": FORMAL_MACHINE}


@query(" UNION ALL ".join(_machine_sql(k, m) for k, m in MACHINES.items()))
def machine_violations(t: Tables) -> DataFrame:
    one = lambda k, m: state.bad_transitions(_walks(t, m), review.machine(t.spark, m)).select(F.lit(k).alias("machine"), "key", "seq", "before", "state")
    return validate.together(*[one(k, m) for k, m in MACHINES.items()])


@query(summed("""p AS (SELECT p_partkey AS k, p_size AS s FROM part), nat AS (SELECT n_nationkey AS id FROM nation), sup AS (SELECT s_suppkey AS id FROM supplier),
 r AS (SELECT 'change kind' AS rule, 'error' AS severity, count(*) AS n FROM p WHERE s % 9 = 8
  UNION ALL SELECT 'unknown revision before', 'error', count(*) FROM p WHERE k % 26 NOT IN (SELECT id FROM nat) UNION ALL SELECT 'unknown revision after', 'error', count(*) FROM p WHERE (k + 1) % 26 NOT IN (SELECT id FROM nat)
  UNION ALL SELECT 'unknown evidence', 'error', count(*) FROM p WHERE s = 19 OR k % 40 NOT IN (SELECT id FROM sup)
  UNION ALL SELECT 'meaning', 'error', count(*) FROM p WHERE s % 11 = 0 UNION ALL SELECT 'assumption lost', 'error', count(*) FROM p WHERE s % 7 = 0
  UNION ALL SELECT 'provenance lost', 'error', count(*) FROM p WHERE s = 23 UNION ALL SELECT 'blocker lost', 'error', count(*) FROM p WHERE s % 4 = 1 AND k % 5 <> 0)"""))
def change_report(t: Tables) -> DataFrame:
    kind = F.get(names(*CHANGES), (size() % 9).cast("int"))
    two = names("a1", "a2")
    blocker = F.array(F.concat(F.lit("b"), (key() % 5).cast("string")))
    changes = t.part.select(
        key().alias("id"), kind.alias("kind"), (key() % 26).alias("before"), ((key() + 1) % 26).alias("after"), F.when(size() != 19, key() % 40).alias("evidence"),
        F.col("p_name").alias("meaning_before"), F.when(size() % 11 == 0, no_text()).otherwise(F.col("p_name")).alias("meaning_after"), two.alias("assumptions_before"), F.when(size() % 7 == 0, names("a2", "a3")).otherwise(two).alias("assumptions_after"),
        blocker.alias("blockers_before"), F.when(size() % 4 == 1, F.lit(None).cast("array<string>")).otherwise(blocker).alias("blockers_after"), names("p").alias("provenance_before"), F.when(size() == 23, names()).otherwise(names("p", "q")).alias("provenance_after"),
    )
    ids = lambda rows, c: rows.select(F.col(c).cast("long").alias("id"))
    resolved = t.spark.createDataFrame([("b0",)], "blocker string")
    return validate.report(review.change_gates(changes, ids(t.nation, "n_nationkey"), ids(t.supplier, "s_suppkey"), resolved))


@query("""lg AS (SELECT src, dst, 1 AS revision, 'ACCEPTED' AS state FROM e UNION ALL SELECT src, dst, 2, 'REDUNDANT_IN_QUERY_VIEW' FROM e WHERE dst % 3 = 0 UNION ALL SELECT src, dst, 3, 'REJECTED' FROM e WHERE dst % 4 = 0 UNION ALL SELECT src, dst, 4, 'ACCEPTED' FROM e WHERE dst % 6 = 0)
 SELECT r AS at, src, dst FROM (SELECT r, src, dst, arg_max(state, revision) AS state FROM lg, (SELECT unnest([1, 2, 3, 4]) AS r) WHERE revision <= r GROUP BY ALL) WHERE state NOT IN ('REJECTED', 'REDUNDANT_IN_QUERY_VIEW')""")
def edges_at_revision(t: Tables) -> DataFrame:
    e = t.edges()
    said = lambda r, what, where: e.where(where).select("src", "dst", F.lit(r).alias("revision"), F.lit(what).alias("state"))
    log = validate.together(said(1, "ACCEPTED", "true"), said(2, "REDUNDANT_IN_QUERY_VIEW", "dst % 3 = 0"), said(3, "REJECTED", "dst % 4 = 0"), said(4, "ACCEPTED", "dst % 6 = 0"))
    return validate.together(*[review.at_revision(log, r).select(F.lit(r).alias("at"), "src", "dst") for r in range(1, 5)])


# roots and coverage
@query("SELECT target, id, CASE WHEN id = target THEN 'target' WHEN id IN (SELECT dst FROM e) THEN 'intermediate' ELSE 'root' END AS role FROM cl")
def root_selection(t: Tables) -> DataFrame:
    return review.roles(t.edges(), t.targets())


@query(summed(f"""p AS (SELECT p_partkey AS k, p_size AS s FROM part WHERE p_partkey NOT IN (SELECT dst FROM e)),
 r AS (SELECT 'stop reason' AS rule, 'error' AS severity, count(*) AS n FROM p WHERE s % 8 = {len(STOP_REASONS)} UNION ALL SELECT 'expected exports', 'error', count(*) FROM p WHERE s % 5 = 0)"""))
def root_report(t: Tables) -> DataFrame:
    top = t.part.join(t.edges().select(F.col("dst").alias("p_partkey")).distinct(), "p_partkey", "left_anti")
    reason = F.get(names(*STOP_REASONS), (size() % 8).cast("int"))
    return validate.report(review.root_gates(top.select(key().alias("id"), reason.alias("stop_reason"), F.when(size() % 5 != 0, names("t")).alias("expected_exports"))))


@query("""SELECT 'claims' AS section, unnest(['total', 'blocked', 'derived', 'source']) AS metric, unnest([count(*), count(*) FILTER (basis = 'BLOCKED'), count(*) FILTER (basis = 'DERIVED_FROM_ACCEPTED_CHAIN'), count(*) FILTER (basis = 'DIRECT_SOURCE')]) AS n FROM ba
 UNION ALL SELECT 'exports', unnest(['total', 'accepted', 'verified']), unnest([count(*), count(*) FILTER (accepted), count(*) FILTER (lifecycle_status = 'VERIFIED')]) FROM co
 UNION ALL SELECT 'blockers', unnest(['total', 'open']), unnest([count(*), count(*) FILTER (status = 'OPEN')]) FROM (SELECT DISTINCT id, status FROM bl)
 UNION ALL SELECT 'labels', unnest(['total', 'good', 'toxic']), unnest([count(*), count(*) FILTER (quality = 1), count(*) FILTER (toxic = 1)]) FROM labels""")
def coverage_report(t: Tables) -> DataFrame:
    b = t.bundle()
    basis = F.col("basis")
    return validate.together(
        review.counts(b.basis(), "claims", blocked=basis == "BLOCKED", derived=basis == "DERIVED_FROM_ACCEPTED_CHAIN", source=basis == "DIRECT_SOURCE"),
        review.counts(b.contracts, "exports", accepted=F.col("accepted"), verified=F.col("lifecycle_status") == "VERIFIED"),
        review.counts(b.blockers, "blockers", open=F.col("status") == "OPEN"),
        review.counts(t.labels, "labels", good=F.col("quality") == 1, toxic=F.col("toxic") == 1),
    )


# audits
PROOF = """p AS (SELECT p_partkey AS k, p_size AS s, p_brand AS b FROM part), ent AS (SELECT 'd' || k AS d, unnest(['propext', CASE WHEN s = 9 THEN b ELSE 'Quot.sound' END]) AS axiom FROM p WHERE s <> 37),
 ex AS (SELECT 'd' || k AS d FROM p WHERE s <> 41), rq AS (SELECT 'd' || k AS d FROM p WHERE s % 2 = 0 OR s = 41)"""


def _proof(t: Tables, exact: bool) -> DataFrame:
    d = F.concat(F.lit("d"), key().cast("string"))
    axiom = F.when(size() == 9, F.col("p_brand")).otherwise("Quot.sound")
    log = t.part.where(size() != 37).select(F.concat(F.lit("'"), d, F.lit("' depends on axioms: [propext, "), axiom, F.lit("]")).alias("value"))
    named = lambda where: t.part.where(where).select(d.alias("declaration"))
    code = F.when(size() == 10, "theorem a : b := by sorry").when(size() == 20, "import Some.Hidden.Module").when(size() == 30, no_text()).otherwise("-- no sorry here")
    sources = t.part.select(d.alias("path"), code.alias("text"))
    manifest = t.part.select(d.alias("path"), F.sha2(F.col("p_name"), 256).alias("sha256"))
    files = t.part.where(size() != 12).select(d.alias("path"), F.sha2(F.when(size() == 14, "other").otherwise(F.col("p_name")), 256).alias("sha256"))
    pins = t.spark.createDataFrame([("build", "0", "0"), ("commit", "abc", "abd"), ("status", "COMPLETE", None)], "key string, expected string, actual string")
    return review.proof_audit(audit_entries(log), named(size() != 41), named((size() % 2 == 0) | (size() == 41)), sources, manifest, files, pins, ("Some.Hidden",), exact)


def _proof_sql(exact: bool) -> str:
    more = "UNION ALL SELECT 'not required', 'error', count(*) FROM ex WHERE d NOT IN (SELECT d FROM rq)" if exact else ""
    return f"""{PROOF}, r AS (SELECT 'missing declaration' AS rule, 'error' AS severity, count(*) AS n FROM ex WHERE d NOT IN (SELECT d FROM ent)
  UNION ALL SELECT 'required declaration', 'error', count(*) FROM rq WHERE d NOT IN (SELECT d FROM ex) {more}
  UNION ALL SELECT 'unexpected axiom', 'error', count(DISTINCT axiom) FROM ent WHERE axiom NOT IN ('propext', 'Classical.choice', 'Quot.sound')
  UNION ALL SELECT 'placeholder', 'error', count(*) FROM p WHERE s = 10 UNION ALL SELECT 'forbidden import', 'error', count(*) FROM p WHERE s = 20
  UNION ALL SELECT 'missing artifact', 'error', count(*) FROM p WHERE s = 12 UNION ALL SELECT 'stale artifact', 'error', count(*) FROM p WHERE s = 14 UNION ALL SELECT 'pin', 'error', 2)"""


@query(summed(_proof_sql(False)))
def proof_report(t: Tables) -> DataFrame:
    return validate.report(_proof(t, False))


@query(summed(_proof_sql(True)))
def proof_report_exact(t: Tables) -> DataFrame:
    return validate.report(_proof(t, True))


@query(summed("""p AS (SELECT p_partkey AS k, p_size AS s FROM part), de AS (SELECT k, s FROM p WHERE s <> 3),
 r AS (SELECT 'unknown declaration' AS rule, 'error' AS severity, count(*) AS n FROM p WHERE s = 3 UNION ALL SELECT 'type hash', 'error', count(*) FROM de WHERE s = 5
  UNION ALL SELECT 'alignment', 'error', count(*) FROM p WHERE s % 10 IN (7, 8) UNION ALL SELECT 'unknown support', 'error', count(*) FROM p WHERE k // 2 NOT IN (SELECT k FROM de))"""))
def binding_report(t: Tables) -> DataFrame:
    bindings = t.part.select(key().alias("id"), key().cast("string").alias("declaration"), F.sha2("p_name", 256).alias("type_hash"), F.when(size() % 10 == 7, False).when(size() % 10 != 8, True).alias("aligned"), F.array(F.floor(key() / 2).cast("string")).alias("support"))
    declared = t.part.where(size() != 3).select(key().cast("string").alias("declaration"), F.when(size() == 5, no_text()).otherwise(F.sha2("p_name", 256)).alias("type_hash"))
    return validate.report(review.binding_gates(bindings, declared))


@query(summed("""p AS (SELECT p_partkey AS k, p_size AS s, CASE WHEN p_size = 49 THEN p_partkey // 100 WHEN p_size <> 50 THEN p_partkey + 1000000 END AS i FROM part), mk AS (SELECT i FROM p WHERE s % 4 = 1 AND k % 2 = 1),
 r AS (SELECT 'missing id' AS rule, 'error' AS severity, count(*) AS n FROM p WHERE s = 50 UNION ALL SELECT 'duplicate id', 'error', count(*) FROM (SELECT i FROM p WHERE i IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'origin', 'error', count(*) FROM p WHERE s % 4 = 3 UNION ALL SELECT 'source anchors', 'error', count(*) FROM p WHERE s % 4 = 0 AND s % 3 = 0
  UNION ALL SELECT 'quantifiers', 'error', count(*) FROM p WHERE s % 13 = 0 UNION ALL SELECT 'domain', 'error', count(*) FROM p WHERE s % 17 = 0
  UNION ALL SELECT 'symbol', 'error', count(*) FROM p WHERE s % 5 = 0 UNION ALL SELECT 'assumption class', 'error', count(*) FROM p WHERE s % 7 = 0
  UNION ALL SELECT 'reconstruction', 'error', count(*) FROM p WHERE s % 4 = 1 AND i NOT IN (SELECT i FROM mk) UNION ALL SELECT 'unclassified', 'error', count(*) FROM p WHERE s % 11 = 0
  UNION ALL SELECT 'profile', 'error', count(*) FROM p WHERE s % 6 = 0)"""))
def decomposition_report(t: Tables) -> DataFrame:
    ids = F.when(size() == 49, F.floor(key() / 100)).when(size() != 50, key() + 1_000_000)
    origin = F.when(size() % 4 == 0, "SOURCE_EXPLICIT").when(size() % 4 == 1, "AGENT_INFERRED").when(size() % 4 == 2, "COMPUTATIONALLY_REPRODUCED")
    symbol = F.array(F.struct(F.lit("x").alias("name"), F.when(size() % 5 != 0, "a number").alias("meaning")))
    assumption = F.array(F.struct(F.lit("a").alias("id"), F.when(size() % 7 == 0, "").otherwise("domain").alias("class")))
    statements = t.part.select(
        ids.alias("id"), origin.alias("origin"), F.when(size() % 3 != 0, names("a")).alias("source_anchors"), F.when(size() % 13 == 0, " ").otherwise("all").alias("quantifiers"), F.when(size() % 17 != 0, "reals").alias("domain"),
        symbol.alias("symbols"), assumption.alias("assumptions"), F.when(size() % 11 == 0, "").otherwise("claim").alias("classification"),
        F.when(size() % 2 == 0, "MATHEMATICAL").otherwise("NON_MATHEMATICAL").alias("interface_class"), F.when(size() % 3 == 0, "EMPIRICAL").otherwise("MATHEMATICAL").alias("profile"),
    )
    made = t.part.where("p_size % 4 = 1 and p_partkey % 2 = 1").select(ids.alias("id"))
    return validate.report(review.decomposition_gates(statements, made))


@query("""s AS (SELECT source AS id, CASE min(doc_id) % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'cc-by-4.0' WHEN 2 THEN 'unknown' END AS licence, min(doc_id) AS k FROM documents GROUP BY 1)
 SELECT 'licence' AS rule, id AS object_id, licence AS detail, 'error' AS severity FROM s WHERE coalesce(licence, 'unknown') = 'unknown' UNION ALL SELECT 'hash', id, NULL, 'error' FROM s WHERE k % 5 = 0 UNION ALL SELECT 'origin', id, NULL, 'error' FROM s WHERE k % 7 = 0""")
def licence_gaps(t: Tables) -> DataFrame:
    k = F.col("k")
    s = t.documents.groupBy(F.col("source").alias("id")).agg(F.min("doc_id").alias("k"))
    licence = F.when(k % 4 == 0, "MIT").when(k % 4 == 1, "cc-by-4.0").when(k % 4 == 2, "unknown")
    return review.licence_gates(s.select("id", licence.alias("licence"), F.when(k % 5 == 0, "sha256:0").otherwise(F.sha2("id", 256)).alias("sha256"), F.when(k % 7 != 0, F.lit("http://x")).alias("url")), ["MIT", "CC-BY-4.0"])


# numbers
@query("""SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'NOT_REPRODUCED' WHEN p_size % 10 = 1 THEN 'REPRODUCED' WHEN p_size % 10 < 6 THEN 'REPRODUCED_WITH_TOLERANCE' ELSE 'MISMATCH' END AS verdict FROM part""")
def numeric_comparison(t: Tables) -> DataFrame:
    again = F.when(size() % 10 == 0, F.lit(None).cast("double")).when(size() % 10 == 1, F.col("p_retailprice")).otherwise(F.col("p_retailprice") + (size() % 10) * 0.25)
    return t.part.select(key().alias("id"), review.compared(F.col("p_retailprice"), again, F.lit(1.25)).alias("verdict"))


@query("""ih AS (SELECT id AS source, id FROM n WHERE id IN (5, 17, 33) UNION SELECT ih.source, e.dst FROM ih JOIN e ON e.src = ih.id WHERE e.dst NOT IN (SELECT p_partkey FROM part WHERE p_size % 7 = 0)) SELECT source, id FROM ih""")
def approximation_inherited(t: Tables) -> DataFrame:
    return review.inherited(t.edges(), t.nodes().where("id in (5, 17, 33)").select("id"), t.part.where(size() % 7 == 0).select(key().alias("id")))


@query("SELECT DISTINCT p_brand AS brand, ((p_size % 9) - 4) * 0.25::DOUBLE AS value FROM part")
def rounded_points(t: Tables) -> DataFrame:
    noise = (key() % 3 - 1) * F.lit(1e-15)
    return review.rounded(t.part.select(F.col("p_brand").alias("brand"), ((size() % 9 - 4) * F.lit(0.25) + noise).alias("value")), 12, "value")


@query("""SELECT p_brand AS graph, y, round(sum(p_retailprice * pr), 6) AS p FROM part, (SELECT unnest([0, 1, 2]) AS y, unnest([0.5, 0.25, 0.25]) AS pr) k WHERE (p_size % 2 = 0 OR y < 2) GROUP BY 1, 2""")
def push_forward(t: Tables) -> DataFrame:
    x = (size() % 2).alias("x")
    kernel = t.spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.25), (0, 2, 0.25), (1, 0, 0.5), (1, 1, 0.25)], "x int, y int, prob double")
    out = review.push_forward(t.part.select(F.col("p_brand").alias("graph"), x, F.col("p_retailprice").alias("p")), kernel)
    return out.select("graph", "y", F.round("p", 6).alias("p"))


@query(None)
def fractional_clique_cover(t: Tables) -> DataFrame:
    v = t.pauli()
    sets = pauli.cliques(v).groupBy("graph").agg(F.collect_list("m").alias("cliques"))
    weights = v.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("v", "b"))).alias("w")).select("graph", F.col("w.b").alias("weights"))
    return lp.clique_cover_by_graph(sets.join(weights, "graph")).withColumn("value", F.round("value", 6))


@query(None)
def family_ceilings(t: Tables) -> DataFrame:
    """The families over two to four qubits."""
    rows = [(f"{name}{n}", v, label, 1.0) for name in ("local", "ising", "jw", "tree") for n in (2, 3, 4) for v, label in enumerate(pauli.family(name, n))]
    qubits = t.spark.createDataFrame([(f"{name}{n}", n) for name in ("local", "ising", "jw", "tree") for n in (2, 3, 4)], "graph string, n int")
    return pauli.ceilings(pauli.labelled(t.spark.createDataFrame(rows, "graph string, v int, label string, b double")), qubits)


# candidates
@query("""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
 o AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(s) - 1 AS start FROM l)
 SELECT doc_id AS id, 'phrase' AS kind, k - 1 AS line, start::BIGINT AS start, (start + length(s))::BIGINT AS end, '' AS section, sha256(s) AS content_hash FROM o WHERE contains(lower(s), 'of the') OR contains(lower(s), 'de la')""")
def claim_candidates(t: Tables) -> DataFrame:
    return candidates.candidates(t.words(), phrases=("of the", "de la"))


@query("""c AS (SELECT p_partkey AS id, string_split(p_name || ' ' || p_brand, ' ') AS s, p_type AS h FROM part)
 SELECT src, dst, len(list_intersect(a.s, b.s)) AS shared, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 9) AS likeness, a.h = b.h AS same_section, src = dst // 2 AS cites FROM e JOIN c a ON a.id = src JOIN c b ON b.id = dst""")
def pair_features(t: Tables) -> DataFrame:
    c = t.part.select(key().alias("id"), F.split(F.concat_ws(" ", "p_name", "p_brand"), " ").alias("symbols"), F.col("p_type").alias("section"), F.array(F.floor(key() / 2)).alias("citations"))
    return candidates.features(t.edges(), c).withColumn("likeness", F.round("likeness", 9))


@query("""g AS (SELECT output, list(src) AS i FROM sp JOIN e ON e.dst = sp.output GROUP BY 1), f AS (SELECT output, len(i) AS n, output % 3 = 0 OR output % 5 = 0 AS gone, output % 4 = 0 AS extra FROM g)
 SELECT count(*) AS steps, count(*) FILTER (NOT gone) AS found, round(count(*) FILTER (NOT gone AND NOT extra) / count(*), 9) AS exact, round(avg(CASE WHEN gone THEN 0 WHEN extra THEN 2.0 * n / (2 * n + 1) ELSE 1 END), 9) AS input_f1 FROM f""")
def step_measures(t: Tables) -> DataFrame:
    gold = t.bundle().steps.select(F.get("outputs", F.lit(0)).alias("output"), "inputs")
    said = gold.where("output % 3 <> 0 and output % 5 <> 0").withColumn("inputs", F.when(F.col("output") % 4 == 0, F.array_append("inputs", F.lit(-1).cast("long"))).otherwise(F.col("inputs")))
    return candidates.step_measures(gold, said).select("steps", "found", F.round("exact", 9).alias("exact"), F.round("input_f1", 9).alias("input_f1"))
