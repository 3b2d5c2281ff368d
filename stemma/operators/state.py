"""What a claim rests on, and how complete a query is. Nothing here ever promotes a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.operators.graph import closure, reachable_blocked
from stemma.session import cut

BASES = ("BLOCKED", "DERIVED_FROM_ACCEPTED_CHAIN", "IMPORTED_CONTRACT", "DIRECT_SOURCE", "UNVERIFIED_INFERENCE")
# States of a node's binding; the last three of the first four keep a query from being verified.
BINDINGS = ("EXISTING_PROJECT_DECLARATIONS", "PLANNED_DELTA", "GAP", "EXTERNAL_OR_UNMAPPED", "NOT_APPLICABLE")
EXTERNAL = ("NOT_APPLICABLE", "SOURCE_FOUND_AND_VERIFIED", "INDEPENDENT_LEAN_PROOF_COMPLETED", "BLOCKING_UNRESOLVED_CLAIM")


def claims(statements: DataFrame, foundations: DataFrame) -> DataFrame:
    """Both overlaid by id, foundations first: id, kind, text, origin, source_fidelity (null: no foundation), is_foundation."""
    s = statements.select("id", F.col("kind").alias("s_kind"), F.col("text").alias("s_text"), "origin")
    f = foundations.select(F.col("statement_id").alias("id"), F.col("kind").alias("f_kind"), F.col("statement").alias("f_text"), "source_fidelity", F.lit(True).alias("is_foundation"))
    both = s.join(f, "id", "full_outer").withColumn("is_foundation", F.coalesce("is_foundation", F.lit(False)))
    text = F.coalesce(F.nullif(F.when(F.col("is_foundation"), F.lit(None)).otherwise(F.col("s_text")), F.lit("")), "f_text", "s_text")
    origin = F.when(~F.col("is_foundation"), F.col("origin"))
    return both.select("id", F.coalesce("f_kind", "s_kind").alias("kind"), text.alias("text"), origin.alias("origin"), "source_fidelity", "is_foundation")


def last_contract(contracts: DataFrame) -> DataFrame:
    """One contract for each statement: the last by id."""
    w = Window.partitionBy("statement").orderBy(F.col("id").desc())
    return contracts.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def _ladder(producers: Column, blocked: Column) -> Column:
    return (
        F.when(F.col("accepted").isNotNull() & ~F.col("accepted"), "BLOCKED")
        .when(blocked, "BLOCKED")
        .when(producers, "DERIVED_FROM_ACCEPTED_CHAIN")
        .when(F.col("is_foundation"), F.when(F.coalesce("source_fidelity", F.lit("")) != "UNCHECKED", "IMPORTED_CONTRACT").otherwise("BLOCKED"))
        .when(F.col("origin").startswith("SOURCE_"), "DIRECT_SOURCE")
        .when(F.col("origin") == "COMPUTATIONALLY_REPRODUCED", "DERIVED_FROM_ACCEPTED_CHAIN")
        .otherwise("UNVERIFIED_INFERENCE")
    )


def basis(all_claims: DataFrame, steps: DataFrame, contracts: DataFrame, recursive: bool = False) -> DataFrame:
    """id, basis of each claim. Plain, a claim derived by an open step counts as derived even if a premise is blocked;
    with recursive, whatever has something blocked above it is blocked."""
    made = steps.select(F.explode("outputs").alias("id"), (F.col("status") == "BLOCKED").alias("b")).groupBy("id").agg(F.bool_or("b").alias("step_blocked"), F.lit(True).alias("made"))
    own = last_contract(contracts).select(F.col("statement").alias("id"), F.coalesce("accepted", F.lit(False)).alias("accepted"))
    # all are dealt out by id already, so merging them is no exchange more; estimates would have them sent through the driver
    rows = all_claims.join(own.hint("merge"), "id", "left").join(made.hint("merge"), "id", "left")
    out = rows.select("id", _ladder(F.coalesce("made", F.lit(False)), F.coalesce("step_blocked", F.lit(False))).alias("basis"))
    if not recursive:
        return out
    below = reachable_blocked(step_edges(steps), out.where("basis = 'BLOCKED'").select("id")).withColumn("below", F.lit(True))
    return out.join(below.hint("merge"), "id", "left").select("id", F.when(F.col("below"), "BLOCKED").otherwise(F.col("basis")).alias("basis"))


def step_edges(steps: DataFrame) -> DataFrame:
    """src, dst, step: one row for each premise and conclusion of a step."""
    return steps.select(F.col("id").alias("step"), "inputs", F.explode("outputs").alias("dst")).select(F.explode("inputs").alias("src"), "dst", "step")


def query_state(targets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each target over its closure.

    nodes: id, external (resolution status), binding, blocker_ids; edges: src, dst, disposition. dag_complete is FALSE while a source is
    unresolved, NOT EVALUABLE while the review of an edge is pending (it is neither accepted nor conditional; a missing disposition is pending),
    else TRUE. verification_closed is FALSE with a blocker, or a binding that is a gap, planned or external; it is never TRUE.
    """
    inside = cut(closure(edges, targets.select(F.col("id").alias("target"), "id"), ("target",)), "query-closure")
    ids = F.coalesce("blocker_ids", F.array().cast(nodes.schema["blocker_ids"].dataType))
    counts = inside.join(nodes.withColumn("blocker_ids", ids), "id").groupBy("target").agg(
        F.count(F.lit(1)).alias("closure_nodes"),
        *[F.count_if(F.col("external") == s).alias("n_" + s.lower()) for s in EXTERNAL],
        *[F.count_if(F.col("binding") == s).alias("b_" + s.lower()) for s in BINDINGS],
        F.sum(F.size("blocker_ids")).alias("blocker_refs"),
        F.size(F.array_distinct(F.flatten(F.collect_set("blocker_ids")))).cast("long").alias("blockers"),
    )
    a, b = inside.select("target", F.col("id").alias("src")), inside.select("target", F.col("id").alias("dst"))
    held = edges.join(a, "src").join(b, ["target", "dst"]).groupBy("target").agg(
        F.count(F.lit(1)).alias("closure_edges"),
        F.count_if(F.col("disposition") == "CANDIDATE").alias("candidate_edges"),
        F.count_if(~F.coalesce(F.col("disposition").isin("ACCEPTED", "CONDITIONAL"), F.lit(False))).alias("pending_reviews"),
    )
    out = counts.join(held, "target", "left").fillna(0, ["closure_edges", "candidate_edges", "pending_reviews"])
    complete = F.when(F.col("n_blocking_unresolved_claim") > 0, "FALSE").when(F.col("pending_reviews") > 0, "NOT EVALUABLE").otherwise("TRUE")
    blocked = (F.col("blockers") > 0) | (F.col("b_gap") > 0) | (F.col("b_planned_delta") > 0) | (F.col("b_external_or_unmapped") > 0)
    return out.withColumn("dag_complete", complete).withColumn("verification_closed", F.when(blocked, "FALSE").otherwise("NOT ESTABLISHED"))


def frontier(targets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """target, id: what is unresolved in each closure."""
    inside = closure(edges, targets.select(F.col("id").alias("target"), "id"), ("target",))
    return inside.join(nodes.where("external = 'BLOCKING_UNRESOLVED_CLAIM'").select("id"), "id", "left_semi").select("target", "id")


def bad_transitions(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """key, seq, before, state of each change (key, seq, state) that the table of allowed ones (before, state) lacks."""
    steps = events.withColumn("before", F.lag("state").over(Window.partitionBy("key").orderBy("seq"))).where("before is not null")
    return steps.join(allowed, ["before", "state"], "left_anti").select("key", "seq", "before", "state")


def plan_outcome(found: Column, unresolved: Column, candidates: Column, budget_left: Column) -> Column:
    """How a query ended."""
    return (
        F.when(~found, "NO_MATCHING_CONTRACT")
        .when(unresolved > 0, F.when(budget_left > 0, "FRONTIER_OPEN").otherwise("BUDGET_EXHAUSTED"))
        .when(candidates > 0, "NOT_EVALUABLE")
        .otherwise("CLOSED")
    )
