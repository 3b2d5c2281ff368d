"""Gates: each gives violation rows (rule, object_id, detail, severity); a verdict is an aggregate over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.operators.graph import peel
from stemma.schema import APPROXIMATION, CLOSED, DISPOSITIONS, EDGE_TYPES, PASSING, ROUTES
from stemma.session import cut


def violation(rows: DataFrame, rule: str, object_id, detail: Column | None = None, severity: str = "error") -> DataFrame:
    what = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return rows.select(F.lit(rule).alias("rule"), F.col(object_id).cast("string").alias("object_id") if isinstance(object_id, str) else object_id.cast("string").alias("object_id"), what.alias("detail"), F.lit(severity).alias("severity"))


def together(*gates: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def verdict(violations: DataFrame) -> DataFrame:
    """One row: errors, warnings, verdict."""
    out = violations.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return out.withColumn("verdict", F.when(F.col("errors") == 0, "PASSED").otherwise("FAILED"))


def duplicate_ids(rows: DataFrame, rule: str = "duplicate id") -> DataFrame:
    return violation(rows.groupBy("id").count().where("count > 1"), rule, "id", F.col("count"))


def missing_ids(rows: DataFrame, rule: str = "missing id") -> DataFrame:
    return violation(rows.where("id is null or cast(id as string) = ''"), rule, "id")


def dangling(rows: DataFrame, refs: str, known: DataFrame, rule: str) -> DataFrame:
    """Elements of an array column that aren't ids of known."""
    each = rows.select(F.col("id").alias("object_id"), F.explode(refs).alias("ref"))
    return violation(each.join(known.select(F.col("id").alias("ref")), "ref", "left_anti"), rule, "object_id", F.col("ref"))


def edge_step_mismatch(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Edges (src, dst, step) whose step is unknown or lacks an end."""
    both = edges.join(steps.select(F.col("id").alias("step"), "inputs", "outputs"), "step", "left")
    bad = ~(F.array_contains("inputs", F.col("src")) & F.array_contains("outputs", F.col("dst")))
    return violation(both.where(F.col("inputs").isNull() | bad), "edge and step disagree", F.concat_ws(">", "src", "dst"), F.col("step"))


def import_direction(edges: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges (src, dst, type) that the importing side doesn't list as (type, src, dst)."""
    return violation(edges.join(imports, ["type", "src", "dst"], "left_anti"), "import direction", F.concat_ws(">", "src", "dst"), F.col("type"))


def edge_gates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Self loops, unknown ends and types, empty reasons, evidence and duplicates of edges (src, dst, type, reason, oracle_status, disposition,
    source_alignment, lean_support). Two edges between the same ends are duplicates, whatever their types."""
    name = F.concat_ws(">", "src", "dst")
    ids = nodes.select("id").distinct()
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return together(
        violation(edges.where("src = dst"), "self loop", name),
        violation(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti"), "unknown source", name),
        violation(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"), "unknown target", name),
        violation(edges.where(~F.coalesce(F.col("type").isin(*EDGE_TYPES), F.lit(False))), "edge type", name, F.col("type")),
        violation(edges.where(~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False))), "disposition", name, F.col("disposition")),
        violation(edges.where("not oracle_status <=> 'ORACLE_PROPOSED'"), "oracle status", name, F.col("oracle_status")),
        violation(edges.where(empty("source_alignment")), "source alignment", name),
        violation(edges.where(empty("lean_support")), "lean support", name),
        violation(edges.where("coalesce(trim(reason), '') = ''"), "reason", name),
        violation(edges.groupBy("src", "dst").count().where("count > 1"), "duplicate edge", name),
    )


def acyclic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return violation(peel(nodes, edges)[1], "cycle", "id")


def present(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Missing keys of records kept as maps (id, record): a key that is there with a null passes."""
    gone = F.array_except(F.array(*map(F.lit, fields)), F.map_keys("record"))
    return violation(rows.select("id", F.explode(gone).alias("field")), "missing field", "id", F.col("field"))


def coverage(objects: DataFrame) -> DataFrame:
    """Each object covers every route once, as an obligation or as not applicable, with what either must have."""
    duty, not_ = F.col("verification_obligations"), F.col("not_applicable")
    covered = F.concat(F.transform(duty, lambda o: o["route"]), F.transform(not_, lambda n: n["route"]))
    routes = F.array(*map(F.lit, ROUTES))
    exact = (F.size(covered) == len(ROUTES)) & (F.size(F.array_except(routes, covered)) == 0) & (F.size(F.array_except(covered, routes)) == 0)
    each = objects.select("object_id", F.explode(duty).alias("o"))
    kernel = each.where("o.route = 'LEAN_KERNEL' and o.status = 'KERNEL_CHECKED' and coalesce(size(o.declarations), 0) <= 0")
    approximate = objects.where(F.col("approximation_introduced") & ~F.exists(duty, lambda o: o["route"] == "PHYSICAL_APPROXIMATION"))
    return together(
        violation(objects.where(~F.coalesce(exact, F.lit(False))), "route coverage", "object_id"),
        violation(each.where("coalesce(o.status, '') = '' or coalesce(size(o.evidence), 0) <= 0"), "obligation", "object_id", F.col("o.route")),
        violation(objects.select("object_id", F.explode(not_).alias("n")).where("coalesce(n.reason, '') = ''"), "reason", "object_id", F.col("n.route")),
        violation(kernel, "declarations", "object_id"),
        violation(approximate, "approximation", "object_id"),
    )


def partition_gates(objects: DataFrame, records: DataFrame, verified: DataFrame, formal: DataFrame) -> DataFrame:
    """All rules of the objects of a partition, those of coverage() among them.

    objects: object_id, approximation_introduced, verification_obligations (route, status, evidence, declarations, formalization_contracts,
    scope_relation, fields: the names of the keys it has), not_applicable (route, reason); records: id, origin, source_anchors, scope_relation;
    verified: name of each declaration that was checked; formal: id, status, declarations.
    """
    duty = F.coalesce("verification_obligations", F.array().cast(objects.schema["verification_obligations"].dataType))
    first = lambda route: F.get(F.filter(duty, lambda o: o["route"] == route), F.lit(0))
    none = F.exists("not_applicable", lambda n: n["route"] == "PHYSICAL_APPROXIMATION")
    rows = objects.withColumn("near", first("PHYSICAL_APPROXIMATION")).withColumn("source", first("SOURCE_ALIGNMENT")).withColumn("lean", first("LEAN_KERNEL"))
    exact = rows.where(~F.col("approximation_introduced") & (F.col("near").isNotNull() | ~F.coalesce(none, F.lit(False))))
    absent = F.array_except(F.array(*map(F.lit, APPROXIMATION)), F.coalesce("near.fields", F.array().cast("array<string>")))
    lacking = rows.where(F.col("approximation_introduced") & F.col("near").isNotNull()).select("object_id", F.explode(absent).alias("field"))
    both = F.arrays_overlap(F.transform(duty, lambda o: o["route"]), F.transform("not_applicable", lambda n: n["route"]))

    told = rows.join(records.select(F.col("id").alias("object_id"), "origin", "source_anchors", F.col("scope_relation").alias("relation")), "object_id")
    made = F.col("origin").isin("AGENT_NORMALIZED", "AGENT_INFERRED")
    relation = F.coalesce(F.nullif("relation", F.lit("")), F.nullif("source.scope_relation", F.lit("")))

    kernel = rows.where("lean.status = 'KERNEL_CHECKED'").select("object_id", F.coalesce("lean.declarations", F.array().cast("array<string>")).alias("names"), F.coalesce("lean.formalization_contracts", F.array().cast("array<string>")).alias("contracts"))
    named = kernel.select("object_id", F.explode("names").alias("name"))
    bound = kernel.select("object_id", "names", F.explode("contracts").alias("contract")).join(formal.select(F.col("id").alias("contract"), "status", F.col("declarations").alias("covers"), F.lit(True).alias("known")), "contract", "left")
    checked = F.col("known") & (F.col("status") == "KERNEL_CHECKED")
    return together(
        coverage(objects),
        violation(rows.where(both), "required and not applicable", "object_id"),
        violation(exact, "exact object", "object_id"),
        violation(lacking, "approximation field", "object_id", F.col("field")),
        violation(rows.where("approximation_introduced is null"), "approximation is no boolean", "object_id"),
        violation(told.where((made | (F.col("origin") == "SOURCE_EXPLICIT")) & F.col("source").isNull()), "alignment obligation", "object_id", F.col("origin")),
        violation(told.where("origin = 'SOURCE_EXPLICIT' and coalesce(size(source_anchors), 0) <= 0"), "source anchors", "object_id"),
        violation(told.where(made & relation.isNull()), "scope relation", "object_id", F.col("origin")),
        violation(kernel.where("size(contracts) = 0"), "formalization contract", "object_id"),
        violation(named.join(verified.select("name").distinct(), "name", "left_anti"), "not verified", "object_id", F.col("name")),
        violation(bound.where("known is null"), "unknown formalization contract", "object_id", F.col("contract")),
        violation(bound.where(F.col("known") & ~F.coalesce(F.col("status") == "KERNEL_CHECKED", F.lit(False))), "contract is not checked", "object_id", F.col("contract")),
        violation(bound.where(checked & (F.size(F.array_except("names", F.coalesce("covers", F.array().cast("array<string>")))) > 0)), "declaration not covered", "object_id", F.col("contract")),
        violation(rows.where("contains(lean.status, 'STALE_EVIDENCE')"), "stale evidence", "object_id", severity="warning"),
    )


def unclosed_exports(exports: DataFrame, objects: DataFrame) -> DataFrame:
    """Obligations (of objects: root, object_id, verification_obligations) that haven't passed, in roots that have an accepted export
    (root, accepted). A missing status hasn't passed."""
    open_ = objects.join(exports.where("accepted").select("root").distinct(), "root", "left_semi").select("object_id", F.explode("verification_obligations").alias("o"))
    return violation(open_.where(~F.coalesce(F.col("o.status").isin(*PASSING), F.lit(False))), "release", "object_id", F.concat_ws(":", "o.route", "o.status"))


def integrity(statements: DataFrame, foundations: DataFrame, steps: DataFrame, contracts: DataFrame, blockers: DataFrame, anchors: DataFrame, verifications: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """References between all collections, the graph (nodes: id; edges: src, dst, step) against the steps, and the lifecycle of exports.

    Open blockers and exports that aren't accepted are warnings.
    """
    ids = lambda rows, c="id": rows.select(F.col(c).cast("string").alias("id"))

    def lost(rows: DataFrame, refs, known: DataFrame, rule: str, only=None) -> DataFrame:
        refs = F.col(refs) if isinstance(refs, str) else refs
        each = rows.select(F.col("id").alias("object_id"), F.explode(refs.cast("array<string>")).alias("id"))
        each = each if only is None else each.where(only)
        return violation(each.join(known, "id", "left_anti"), rule, "object_id", F.col("id"))

    founded = ids(foundations, "statement_id")
    claims = cut(ids(statements).unionByName(founded).distinct(), "claim-ids")
    imported = F.transform("imports", lambda i: i["contract"])
    steps_of = steps.select(F.col("id").alias("step"), "inputs", "outputs")
    told = edges.join(steps_of.withColumn("known", F.lit(True)), "step", "left")
    name = F.concat_ws(">", "src", "dst")
    ends = edges.join(ids(nodes).select(F.col("id").alias("a")), F.col("src").cast("string") == F.col("a"), "left").join(ids(nodes).select(F.col("id").alias("b")), F.col("dst").cast("string") == F.col("b"), "left")
    accepted = F.coalesce("accepted", F.lit(False))
    return together(
        lost(statements, "source_anchors", ids(anchors), "unknown source anchor"),
        lost(statements, "logical_form.hypotheses", claims, "unknown hypothesis"),
        lost(steps, F.concat("inputs", "outputs"), claims, "unknown claim"),
        lost(steps, "source_anchors", ids(anchors), "unknown step anchor"),
        lost(steps, "verification_records", ids(verifications), "unknown verification"),
        lost(steps, "active_assumptions", claims, "unknown active assumption"),
        lost(contracts, F.array("statement"), claims, "unknown exported statement"),
        lost(contracts, "assumptions", claims, "unknown assumption", F.col("id").startswith("assumption:")),
        lost(contracts, imported, ids(contracts).unionByName(founded), "unknown import"),
        lost(contracts, "blockers", ids(blockers), "unknown blocker"),
        lifecycle(contracts),
        violation(ids(nodes).join(claims, "id", "left_anti"), "unknown node", "id"),
        violation(ends.where("a is null or b is null"), "undeclared endpoint", name),
        violation(told.where("known is null"), "unknown step", name, F.col("step")),
        violation(told.where(F.col("known") & ~(F.array_contains("inputs", F.col("src")) & F.array_contains("outputs", F.col("dst")))), "edge and step disagree", name, F.col("step")),
        acyclic(nodes.select("id"), edges.select("src", "dst")),
        violation(contracts.where(~accepted), "unaccepted export", "id", severity="warning"),
        violation(blockers.where("status = 'OPEN'"), "open blocker", "id", severity="warning"),
    )


def report(violations: DataFrame) -> DataFrame:
    """rule, severity, n: the violations of each rule, and two rows that sum up. 'verdict' counts errors and is PASSED or FAILED; 'release
    gate' counts warnings and is PASSED or BLOCKED. Strict readers ask for both."""
    counts = cut(violations.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n")), "rule-counts")
    total = lambda severity: F.coalesce(F.sum(F.when(F.col("severity") == severity, F.col("n"))), F.lit(0))
    errors, warnings = counts.agg(total("error").alias("n")), counts.agg(total("warning").alias("n"))
    return together(
        counts,
        errors.select(F.lit("verdict").alias("rule"), F.when(F.col("n") == 0, "PASSED").otherwise("FAILED").alias("severity"), "n"),
        warnings.select(F.lit("release gate").alias("rule"), F.when(F.col("n") == 0, "PASSED").otherwise("BLOCKED").alias("severity"), "n"),
    )


def exit_state(summary: DataFrame, strict: bool = False) -> int:
    """0 if a report passed, with strict also its release gate; else 1."""
    said = {r.rule: r.severity for r in summary.where("rule in ('verdict', 'release gate')").collect()}
    return int(said["verdict"] != "PASSED" or (strict and said["release gate"] != "PASSED"))


def lifecycle(contracts: DataFrame) -> DataFrame:
    return violation(contracts.where(F.col("accepted") & ~F.coalesce(F.col("lifecycle_status").isin(*CLOSED), F.lit(False))), "lifecycle", "id", F.col("lifecycle_status"))


def subset(claimed: DataFrame, verified: DataFrame, rule: str = "not verified") -> DataFrame:
    """Claimed (id, name) names that verified (name) lacks."""
    return violation(claimed.join(verified.select("name").distinct(), "name", "left_anti"), rule, "id", F.col("name"))


def cover_records(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """Ids missing from one side, and extra on it."""
    both = expected.select("id", F.lit(True).alias("e")).join(seen.select("id", F.lit(True).alias("s")), "id", "full_outer")
    return violation(both.where("e is null or s is null"), "partition", "id", F.when(F.col("s").isNull(), "missing").otherwise("extra"))


def tokens_missing(files: DataFrame, required: list[str], forbidden: list[str]) -> DataFrame:
    """Required literals that a file (path, text) lacks, and forbidden ones that it has; the lists are arrays, so there is no join."""
    need = files.select("path", F.explode(F.filter(F.array(*map(F.lit, required or [""])), lambda t: ~F.contains("text", t))).alias("t"))
    have = files.select("path", F.explode(F.filter(F.array(*map(F.lit, forbidden or ["\x00"])), lambda t: F.contains("text", t))).alias("t"))
    return together(violation(need, "required token", "path", F.col("t")), violation(have, "forbidden token", "path", F.col("t")))


def file_gates(files: DataFrame, largest: int = 100 << 20, parts: tuple[str, ...] = (".git", "node_modules", ".lake")) -> DataFrame:
    """Files (path, length) of the limit or more, or below a forbidden folder."""
    inside = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, parts)))
    return together(violation(files.where(F.col("length") >= largest), "file size", "path", F.col("length")), violation(files.where(inside), "folder", "path"))


def pipeline_states(contracts: DataFrame) -> DataFrame:
    """Contracts (id, status, evidence, effect, owner): a known status, evidence there, an effect; and what is unresolved blocks and has no owner."""
    states = ("NOT_APPLICABLE", "SOURCE_FOUND_AND_VERIFIED", "INDEPENDENT_LEAN_PROOF_COMPLETED", "BLOCKING_UNRESOLVED_CLAIM")
    return together(
        violation(contracts.where(~F.coalesce(F.col("status").isin(*states), F.lit(False))), "status", "id", F.col("status")),
        violation(contracts.where("evidence is null"), "evidence", "id"),
        violation(contracts.where("coalesce(effect, '') = ''"), "effect", "id"),
        violation(contracts.where("status = 'BLOCKING_UNRESOLVED_CLAIM' and (not owner <=> 'UNMAPPED' or not effect <=> 'BLOCKS_DAG_COMPLETION_WHEN_REQUIRED')"), "unresolved but owned", "id", F.col("owner")),
    )
