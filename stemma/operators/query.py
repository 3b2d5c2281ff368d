"""The query verbs over a bundle of claim tables: claims, why, source, assumptions, dependencies, verification, blockers, exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.text import excerpt
from stemma.operators.graph import closure, peel
from stemma.operators.state import basis, claims, last_contract, step_edges
from stemma.session import cut, some


@dataclass
class Bundle:
    """Typed tables as in stemma.schema; ids are unique in each."""

    statements: DataFrame
    foundations: DataFrame
    steps: DataFrame
    contracts: DataFrame
    blockers: DataFrame
    anchors: DataFrame | None = None
    verifications: DataFrame | None = None
    texts: DataFrame | None = None

    def all_claims(self) -> DataFrame:
        return claims(self.statements, self.foundations)

    def basis(self, recursive: bool = False) -> DataFrame:
        return basis(self.all_claims(), self.steps, self.contracts, recursive)

    def claims(self) -> DataFrame:
        return self.all_claims().join(self.basis(), "id").select("id", "kind", "basis", "text").orderBy("id")

    def closure_claims(self, targets: DataFrame) -> DataFrame:
        """target, id, depth over all steps that produce a claim; premises that no table has are kept."""
        return closure(step_edges(self.steps).select("src", "dst").distinct(), targets.select(F.col("id").alias("target"), "id"), ("target",))

    def closure_steps(self, targets: DataFrame, inside: DataFrame | None = None) -> DataFrame:
        """target, step. The verbs below take the closure (inside) of whoever has it already."""
        made = self.steps.select(F.explode("outputs").alias("id"), F.col("id").alias("step"))
        return (self.closure_claims(targets) if inside is None else inside).join(made, "id").select("target", "step").distinct()

    def dependencies(self, targets: DataFrame) -> DataFrame:
        """target, id, level: the closure in a topological order, (level, id), which takes the place of a traversal's."""
        edges = step_edges(self.steps).select("src", "dst")
        inside = cut(self.closure_claims(targets), "closure")
        levels, _ = peel(inside.select("id").distinct(), edges.join(inside.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi"))
        return inside.join(levels, "id", "left").select("target", "id", "level")

    def assumptions(self, targets: DataFrame, inside: DataFrame | None = None) -> DataFrame:
        """Those active in a step of the closure, and the hypotheses of the target itself."""
        active = self.closure_steps(targets, inside).join(self.steps.select(F.col("id").alias("step"), F.explode("active_assumptions").alias("assumption")), "step").select("target", "assumption")
        own = self.statements.select(F.col("id").alias("target"), F.explode("logical_form.hypotheses").alias("assumption"))
        return active.unionByName(own.join(targets.select(F.col("id").alias("target")), "target", "left_semi")).distinct().orderBy("target", "assumption")

    def blocker_hits(self, targets: DataFrame, status: str | None = None, inside: DataFrame | None = None) -> DataFrame:
        """target, blocker: those that affect the target or a contract of its closure, those that such a contract lists, and those behind a
        blocked import of one, by the import's id or its contract's statement. A listed one that no table has counts unless a status is asked for."""
        which = self.blockers if status is None else self.blockers.where(F.col("status") == status)
        affected = which.select(F.col("id").alias("blocker"), F.explode("affects").alias("ref"))
        held = last_contract(self.contracts).select(F.col("id").alias("contract"), F.col("statement").alias("id"), "imports", "blockers")
        inside = (self.closure_claims(targets) if inside is None else inside).join(held, "id").select("target", "contract", "imports", "blockers")
        direct = targets.select(F.col("id").alias("target"), F.col("id").alias("ref")).unionByName(inside.select("target", F.col("contract").alias("ref")))
        bad = inside.select("target", F.explode("imports").alias("i")).where("i.status = 'BLOCKED'").select("target", F.col("i.contract").alias("contract"))
        by_statement = bad.join(self.contracts.select(F.col("id").alias("contract"), F.col("statement").alias("ref")), "contract").select("target", "ref")
        refs = direct.unionByName(bad.withColumnRenamed("contract", "ref")).unionByName(by_statement)
        listed = inside.select("target", F.explode("blockers").alias("blocker"))
        if status is not None:
            listed = listed.join(which.select(F.col("id").alias("blocker")), "blocker", "left_semi").select("target", "blocker")
        return refs.join(affected, "ref").select("target", "blocker").unionByName(listed).distinct()

    def why(self, targets: DataFrame, status: str | None = None) -> DataFrame:
        """target, basis, n_claims, n_steps, n_assumptions, n_blockers. A blocker of any status, resolved or not, makes BLOCKED, unless one
        status is asked for; so does a blocked step in the closure; else the claim's own basis holds. The closure is found once."""
        inside = cut(self.closure_claims(targets), "closure")
        steps = self.closure_steps(targets, inside).join(self.steps.select(F.col("id").alias("step"), (F.col("status") == "BLOCKED").alias("b")), "step")
        steps = steps.groupBy("target").agg(F.count(F.lit(1)).alias("n_steps"), F.bool_or("b").alias("step_blocked"))
        counts = [
            inside.groupBy("target").agg(F.count(F.lit(1)).alias("n_claims")),
            steps,
            self.assumptions(targets, inside).groupBy("target").agg(F.count(F.lit(1)).alias("n_assumptions")),
            self.blocker_hits(targets, status, inside).groupBy("target").agg(F.count(F.lit(1)).alias("n_blockers")),
        ]
        out = targets.select(F.col("id").alias("target")).join(self.basis().withColumnRenamed("id", "target"), "target", "left")
        for c in counts:
            out = out.join(c, "target", "left")
        out = out.fillna(0, ["n_claims", "n_steps", "n_assumptions", "n_blockers"])
        verdict = F.when((F.col("n_blockers") > 0) | F.coalesce("step_blocked", F.lit(False)) | F.col("basis").isNull(), "BLOCKED").otherwise(F.col("basis"))
        return out.select("target", verdict.alias("basis"), "n_claims", "n_steps", "n_assumptions", "n_blockers")

    def source(self, targets: DataFrame) -> DataFrame:
        """target, basis, pos, anchor, excerpt (with line ends), in the order of the claim's anchors. A dangling anchor is an error, as nothing stands behind it."""
        refs = self.statements.join(targets, "id", "left_semi").select(F.col("id").alias("target"), F.posexplode("source_anchors").alias("pos", "anchor"))
        anchors = self.anchors.select(F.col("id").alias("anchor"), "artifact", "location")
        lost = refs.join(anchors, "anchor", "left_anti")
        if some(lost):
            raise KeyError(lost.first()["anchor"])
        rows = refs.join(anchors, "anchor")
        if self.texts is not None:
            rows = rows.join(self.texts.select(F.col("path").alias("artifact"), "text"), "artifact", "left")
        else:
            rows = rows.withColumn("text", F.lit(None).cast("string"))
        part = excerpt(F.col("text"), F.col("location.line_start"), F.col("location.line_end"))
        rows = rows.join(self.basis().withColumnRenamed("id", "target"), "target", "left")
        return rows.select("target", "basis", "pos", "anchor", part.alias("excerpt")).orderBy("target", "pos")

    def verification(self, targets: DataFrame) -> DataFrame:
        """target, record, first place; records that no table has are skipped."""
        refs = self.closure_steps(targets).join(self.steps.select(F.col("id").alias("step"), F.posexplode("verification_records").alias("pos", "record")), "step")
        known = refs.join(self.verifications.select(F.col("id").alias("record")), "record", "left_semi")
        return known.groupBy("target", "record").agg(F.min(F.struct("step", "pos")).alias("first")).select("target", "record", "first.step", "first.pos")

    def open_blockers(self) -> tuple[DataFrame, str]:
        """The open ones; and BLOCKED if there is any blocker at all, whatever its status."""
        return self.blockers.where("status = 'OPEN'"), "BLOCKED" if some(self.blockers) else "DIRECT_SOURCE"

    def exports(self) -> DataFrame:
        return self.contracts.withColumn("basis", F.when(F.col("accepted"), "IMPORTED_CONTRACT").otherwise("BLOCKED"))

    def imports(self, targets: DataFrame) -> DataFrame:
        own = last_contract(self.contracts).select(F.col("statement").alias("target"), F.col("id").alias("contract"), F.explode("imports").alias("i"))
        return own.join(targets.select(F.col("id").alias("target")), "target", "left_semi").select("target", "contract", F.col("i.contract").alias("imported"), "i.status")

    def run(self, verb: str, claim=None) -> DataFrame:
        """One verb by name; an unknown claim gives one row with basis BLOCKED and an error, a missing one is a ValueError."""
        spark = self.statements.sparkSession
        if verb in ("claims", "exports"):
            return getattr(self, verb)()
        if verb == "blockers" and claim is None:
            return self.open_blockers()[0]
        if claim is None:
            raise ValueError(f"{verb} needs a claim")
        kind = dict(self.statements.dtypes)["id"]
        target = spark.createDataFrame([(claim,)], f"id {kind}")
        if not some(self.all_claims().join(target, "id", "left_semi")):
            return spark.createDataFrame([("BLOCKED", f"unknown claim: {claim}")], "basis string, error string")
        return (self.blocker_hits if verb == "blockers" else getattr(self, verb))(target)
