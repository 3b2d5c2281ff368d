"""Review of records: equality of relations, import receipts, changes of a graph, roots, coverage, and audits of captured proofs.

Gates give violation rows like those of validate.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.text import close, placeholders
from stemma.operators.graph import closure, descendants
from stemma.operators.registry import latest
from stemma.operators.validate import acyclic, edge_gates, duplicate_ids, missing_ids, subset, together, violation
from stemma.schema import AXIOMS, CHANGES, STOP_REASONS
from stemma.sources.files import missing_files, stale_files

STRINGS = "array<string>"


def _empty(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def _list(c: str | Column, kind: str = STRINGS) -> Column:
    """An array without null in its place."""
    return F.coalesce(c, F.array().cast(kind))


def _within(c: str | Column, domain) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).isin(*domain), F.lit(False))


# equality
def same_rows(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, once for each time; empty if both are equal as bags."""
    name = F.concat_ws(">", *expected.columns)
    seen = seen.select(expected.columns)
    return together(violation(expected.exceptAll(seen), "missing row", name), violation(seen.exceptAll(expected), "extra row", name))


def same_sets(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """The same for sets: how often a row comes doesn't matter."""
    return same_rows(expected.distinct(), seen.distinct())


def same_lists(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """Places (pos, value) at which two lists differ; a null value differs from a missing place."""
    both = expected.select("pos", F.struct("value").alias("a")).join(seen.select("pos", F.struct("value").alias("b")), "pos", "full_outer")
    what = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("other")
    return violation(both.where("not a <=> b"), "list", "pos", what)


def mathematical(nodes: DataFrame) -> DataFrame:
    """Nodes whose interface_class isn't NON_MATHEMATICAL; those without one stay."""
    return nodes.where("not interface_class <=> 'NON_MATHEMATICAL'")


# receipts
def import_receipts(receipts: DataFrame) -> DataFrame:
    """id, satisfied, conditional, open, verdict of receipts (id, assumptions: array of (name, status)).

    What is neither satisfied nor conditional is open and blocks, a missing status or a missing list too.
    """
    a = F.col("assumptions")
    n = lambda s: F.size(F.filter(a, lambda x: F.coalesce(x["status"] == s, F.lit(False))))
    out = receipts.select("id", a.isNull().alias("unknown"), F.greatest(n("satisfied"), F.lit(0)).alias("satisfied"), F.greatest(n("conditional"), F.lit(0)).alias("conditional"), F.greatest(F.size(a), F.lit(0)).alias("n"))
    out = out.withColumn("open", F.col("n") - F.col("satisfied") - F.col("conditional"))
    verdict = F.when(F.col("unknown") | (F.col("open") > 0), "BLOCKED").when(F.col("conditional") > 0, "CONDITIONAL").otherwise("SATISFIED")
    return out.select("id", "satisfied", "conditional", "open", verdict.alias("verdict"))


def reuse_gates(receipts: DataFrame, changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Reasons against the reuse of contracts, receipts: id, statement_ok, assumptions_ok, version_ok, environment_ok, verified, blocked, source.

    A condition that isn't known to hold is a reason; so is a missing source of the receipt, and standing below something changed (id).
    """
    wrong = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    conditions = {"statement": "statement_ok", "assumptions": "assumptions_ok", "version": "version_ok", "environment": "environment_ok", "verification": "verified"}
    stale = receipts.join(descendants(edges, changed).select("id").distinct().hint("merge"), "id", "left_semi")
    return together(
        *[violation(receipts.where(wrong(c)), rule, "id") for rule, c in conditions.items()],
        violation(receipts.where(F.coalesce("blocked", F.lit(True))), "blocked", "id"),
        violation(receipts.where(_empty("source")), "receipt", "id"),
        violation(stale, "invalidated", "id"),
    )


# state machines and changes
def machine(spark: SparkSession, table: dict[str, tuple[str, ...]]) -> DataFrame:
    """before, state of each allowed change, for state.bad_transitions()."""
    return spark.createDataFrame([(a, b) for a, after in table.items() for b in after], "before string, state string")


def change_gates(changes: DataFrame, revisions: DataFrame, evidence: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Rules for changes of a graph: id, kind, before, after (revisions), evidence, and what held before and after them: meaning_before,
    meaning_after, and the arrays assumptions_, blockers_ and provenance_before and _after. revisions, evidence: id; resolutions: blocker.

    Assumptions and provenance only grow; a blocker goes with a resolution alone; every change can be undone, as both revisions are there.
    """

    def unknown(c: str, known: DataFrame, rule: str) -> DataFrame:
        gone = changes.join(known.select(F.col("id").alias(c)).distinct(), c, "left_anti")
        return violation(gone, rule, "id", F.col(c))

    def lost(what: str) -> DataFrame:
        return changes.select("id", F.explode(F.array_except(_list(f"{what}_before"), _list(f"{what}_after"))).alias("gone"))

    return together(
        violation(changes.where(~_within("kind", CHANGES)), "change kind", "id", F.col("kind")),
        unknown("before", revisions, "unknown revision before"),
        unknown("after", revisions, "unknown revision after"),
        unknown("evidence", evidence, "unknown evidence"),
        violation(changes.where("not meaning_before <=> meaning_after"), "meaning", "id"),
        violation(lost("assumptions"), "assumption lost", "id", F.col("gone")),
        violation(lost("provenance"), "provenance lost", "id", F.col("gone")),
        violation(lost("blockers").join(resolutions.select(F.col("blocker").alias("gone")).distinct(), "gone", "left_anti"), "blocker lost", "id", F.col("gone")),
    )


def at_revision(log: DataFrame, revision: int) -> DataFrame:
    """The edges in force at a revision of an append-only log (src, dst, revision, state): the last word on each, without those that it
    rejects or calls redundant. An older revision undoes whatever came after it."""
    last = latest(log.where(F.col("revision") <= revision), ["src", "dst"], ["revision"])
    return last.where("not coalesce(state in ('REJECTED', 'REDUNDANT_IN_QUERY_VIEW'), false)")


# roots and coverage
def roles(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, id, role of each member of the targets' closures: target, root (nothing above it) or intermediate."""
    inside = closure(edges, targets.select(F.col("id").alias("target"), "id"), ("target",)).select("target", "id")
    below = edges.select(F.col("dst").alias("id")).distinct().withColumn("fed", F.lit(True))
    role = F.when(F.col("id") == F.col("target"), "target").when(F.col("fed").isNull(), "root").otherwise("intermediate")
    return inside.join(below, "id", "left").select("target", "id", role.alias("role"))


def root_gates(roots: DataFrame) -> DataFrame:
    """Roots (id, stop_reason, expected_exports): a reason to stop from the list, and something that is expected of them."""
    return together(
        violation(roots.where(~_within("stop_reason", STOP_REASONS)), "stop reason", "id", F.col("stop_reason")),
        violation(roots.where("coalesce(size(expected_exports), 0) <= 0"), "expected exports", "id"),
    )


def counts(rows: DataFrame, section: str, **conditions: Column) -> DataFrame:
    """section, metric, n: how many rows meet each condition, and their total, in one pass."""
    got = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("n")) for k in ("total", *conditions)])
    return got.select(F.lit(section).alias("section"), F.inline(pairs))


# numbers
def compared(reported: Column, again: Column, tolerance: Column) -> Column:
    """What a second computation says of a reported value."""
    return (
        F.when(reported.isNull() | again.isNull(), "NOT_REPRODUCED")
        .when(reported == again, "REPRODUCED")
        .when(F.abs(reported - again) <= F.coalesce(tolerance, F.lit(0.0)), "REPRODUCED_WITH_TOLERANCE")
        .otherwise("MISMATCH")
    )


def inherited(edges: DataFrame, approximate: DataFrame, removed: DataFrame) -> DataFrame:
    """source, id: claims that inherit the approximation of a source (id), itself included; those of removed (id) end it."""
    on = edges.join(removed.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_anti")
    return descendants(on, approximate.select(F.col("id").alias("source"), "id"), ("source",)).select("source", "id")


def rounded(rows: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Distinct rows after rounding; minus zero is zero."""
    return rows.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in rows.columns]).distinct()


def push_forward(weights: DataFrame, kernel: DataFrame) -> DataFrame:
    """graph, y, p: weights (graph, x, p) sent through a kernel (x, y, prob). Partial sums come before the exchange by (graph, y)."""
    return weights.join(kernel, "x").groupBy("graph", "y").agg(F.sum(F.col("p") * F.col("prob")).alias("p"))


def stochastic(kernel: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Violations of kernels (x, y, prob): weights below zero, and rows that don't sum to one."""
    sums = kernel.groupBy("x").agg(F.sum("prob").alias("s"))
    return together(violation(kernel.where("prob < 0 or prob is null"), "negative", "x", F.col("y")), violation(sums.where(~F.coalesce(close(F.col("s"), F.lit(1.0), tolerance), F.lit(False))), "row sum", "x"))


# audits
def proof_audit(entries: DataFrame, expected: DataFrame, required: DataFrame, sources: DataFrame, manifest: DataFrame, files: DataFrame, pins: DataFrame, forbidden: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """The audit of a captured proof build.

    entries: declaration, axiom (files.audit_entries); expected, required: declaration; sources: path, text; manifest, files: path, sha256;
    pins: key, expected, actual (environment, exit codes, statuses). exact: what is expected must be what is required, not only hold it.
    """
    d = lambda rows: rows.select(F.col("declaration").alias("id"), F.col("declaration").alias("name")).distinct()
    text = F.coalesce("text", F.lit(""))
    imports = F.filter(F.array(*map(F.lit, forbidden)).cast(STRINGS), lambda m: F.contains(text, m))
    more = [subset(d(expected), d(required), "not required")] if exact else []
    return together(
        subset(d(expected), d(entries), "missing declaration"),
        subset(d(required), d(expected), "required declaration"),
        *more,
        violation(entries.where(F.col("axiom").isNotNull() & ~_within("axiom", AXIOMS)).select("axiom").distinct(), "unexpected axiom", "axiom"),
        violation(sources.where(placeholders(text)), "placeholder", "path"),
        violation(sources.select("path", F.explode(imports).alias("m")), "forbidden import", "path", F.col("m")),
        violation(missing_files(manifest, files), "missing artifact", "path"),
        violation(stale_files(manifest, files), "stale artifact", "path"),
        violation(pins.where("not expected <=> actual"), "pin", "key", F.col("actual")),
    )


def binding_gates(bindings: DataFrame, declarations: DataFrame) -> DataFrame:
    """Bindings of contracts to declarations: id, declaration, type_hash, aligned, support (array of declarations); declarations: declaration,
    type_hash."""
    known = declarations.select("declaration", F.col("type_hash").alias("actual")).dropDuplicates(["declaration"])
    both = bindings.join(known.withColumn("there", F.lit(True)), "declaration", "left")
    support = bindings.select("id", F.explode(_list("support")).alias("declaration")).join(known, "declaration", "left_anti")
    return together(
        violation(both.where("there is null"), "unknown declaration", "id", F.col("declaration")),
        violation(both.where("there and not type_hash <=> actual"), "type hash", "id", F.col("declaration")),
        violation(bindings.where(~F.coalesce("aligned", F.lit(False))), "alignment", "id"),
        violation(support, "unknown support", "id", F.col("declaration")),
    )


def decomposition_gates(statements: DataFrame, reconstructions: DataFrame) -> DataFrame:
    """Statements: id, origin, source_anchors, quantifiers, domain, symbols (name, meaning), assumptions (id, class), classification,
    interface_class, profile; reconstructions: id of what an agent rebuilt."""
    made = statements.where(F.col("origin").isin("AGENT_NORMALIZED", "AGENT_INFERRED"))
    return together(
        missing_ids(statements),
        duplicate_ids(statements.where("id is not null")),
        violation(statements.where(_empty("origin")), "origin", "id"),
        violation(statements.where("startswith(origin, 'SOURCE_') and coalesce(size(source_anchors), 0) <= 0"), "source anchors", "id"),
        violation(statements.where(_empty("quantifiers")), "quantifiers", "id"),
        violation(statements.where(_empty("domain")), "domain", "id"),
        violation(statements.select("id", F.explode("symbols").alias("s")).where("coalesce(trim(s.meaning), '') = ''"), "symbol", "id", F.col("s.name")),
        violation(statements.select("id", F.explode("assumptions").alias("a")).where("coalesce(trim(a.class), '') = ''"), "assumption class", "id", F.col("a.id")),
        violation(made.join(reconstructions.select("id").distinct(), "id", "left_anti"), "reconstruction", "id"),
        violation(statements.where(_empty("classification")), "unclassified", "id"),
        violation(statements.where("interface_class = 'MATHEMATICAL' and not profile <=> 'MATHEMATICAL'"), "profile", "id", F.col("profile")),
    )


def proposal_gates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A proposed graph: the gates of its edges, ids, and no cycle."""
    return together(missing_ids(nodes), duplicate_ids(nodes), edge_gates(edges, nodes), acyclic(nodes.select("id"), edges.select("src", "dst").distinct()))


def licence_gates(sources: DataFrame, permitted: list[str]) -> DataFrame:
    """Sources (id, licence, sha256, url): a licence of the list by its SPDX name, whatever its case, a whole hash and where it came from."""
    return together(
        violation(sources.where(~_within(F.lower(F.trim("licence")), [p.lower() for p in permitted])), "licence", "id", F.col("licence")),
        violation(sources.where(~F.coalesce(F.col("sha256").rlike("^(sha256:)?[0-9a-f]{64}$"), F.lit(False))), "hash", "id"),
        violation(sources.where(_empty("url")), "origin", "id"),
    )
