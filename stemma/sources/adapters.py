"""Claim-graph relations derived from the driver's tables, by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators.query import Bundle

#: Targets of the closure queries.
TARGETS = (1999, 1024, 777, 350, 12, 199)


_DUTY = "struct<route:string,status:string,evidence:array<string>,declarations:array<string>,formalization_contracts:array<string>,scope_relation:string,fields:array<string>>"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # the part graph: k depends on k div 2 and k div 3
    def nodes(self) -> DataFrame:
        p, s = self.part, F.col("p_size")
        external = F.when(s % 9 == 0, "BLOCKING_UNRESOLVED_CLAIM").when(s % 4 == 0, "SOURCE_FOUND_AND_VERIFIED").when(s % 4 == 1, "INDEPENDENT_LEAN_PROOF_COMPLETED").otherwise("NOT_APPLICABLE")
        blockers = F.when(s % 7 == 0, F.array(F.col("p_partkey") % 5, F.lit(5).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        binding = F.when(s == 7, "GAP").when(s == 13, "PLANNED_DELTA").when(s == 22, "EXTERNAL_OR_UNMAPPED").when(s % 3 == 0, "NOT_APPLICABLE").otherwise("EXISTING_PROJECT_DECLARATIONS")
        return p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("owner"), external.alias("external"), blockers.alias("blocker_ids"), binding.alias("binding"))

    def edges(self) -> DataFrame:
        k = F.col("p_partkey")
        up = F.explode(F.array_distinct(F.array(F.floor(k / 2), F.floor(k / 3))))
        e = self.part.select(up.alias("src"), k.alias("dst")).where("src < dst")
        # a column of keys takes so few bytes of a file that millions would be sent through the driver
        return e.join(self.part.select(k.alias("src")).hint("merge"), "src", "left_semi").select("src", "dst")

    def typed_edges(self) -> DataFrame:
        kind = F.when(F.col("dst") % 10 == 0, "definition_dependency").when(F.col("dst") % 10 == 1, "scope_dependency").otherwise("scientific_claim_dependency")
        return self.edges().withColumn("type", kind).withColumn("disposition", self._disposition())

    def _disposition(self):
        n = F.col("src") + F.col("dst")
        return F.when(n % 11 == 0, "CANDIDATE").when(n % 13 == 0, "DISPUTED").when(n % 17 == 0, "CONDITIONAL").when(n % 19 == 0, F.lit(None).cast("string")).otherwise("ACCEPTED")

    def evidence_edges(self) -> DataFrame:
        """Typed edges with reasons and evidence, some of them bad, and some twice with another type."""
        e, n = self.typed_edges(), F.col("src") + F.col("dst")
        e = e.unionByName(e.where("dst % 23 = 0").withColumn("type", F.lit("odd_dependency")))
        return e.select(
            "src", "dst", "type", "disposition", F.when(n % 29 == 0, " ").otherwise("because").alias("reason"), F.when(n % 31 == 0, "NONE").otherwise("ORACLE_PROPOSED").alias("oracle_status"),
            F.when(n % 37 == 0, "").otherwise("ALIGNED").alias("source_alignment"), F.when(n % 41 == 0, F.lit(None).cast("string")).otherwise("NONE").alias("lean_support"),
        )

    def partition(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Objects, records, verified declarations and formalization contracts, for partition_gates()."""
        k, s = F.col("p_partkey"), F.col("p_size")
        no, text = F.array().cast("array<string>"), F.lit(None).cast("string")

        def duty(route, status, declarations=no, contracts=no, fields=no, scope=text):
            return F.struct(F.lit(route).alias("route"), status.alias("status"), F.array(F.lit("e")).alias("evidence"), declarations.alias("declarations"), contracts.alias("formalization_contracts"), scope.alias("scope_relation"), fields.alias("fields"))

        passed = F.lit("PASSED")
        kernel = F.when(s % 3 == 0, "KERNEL_CHECKED").when(s % 3 == 1, "OPEN").otherwise("STALE_EVIDENCE_1")
        lean = duty("LEAN_KERNEL", kernel, F.when(s % 6 == 0, F.array(F.concat(F.lit("d"), (k % 5).cast("string")))).otherwise(no), F.when(s % 6 == 0, F.array((k % 4).cast("string"))).otherwise(no))
        six = ["exact_parent", "approximation_map", "control_parameters", "error_model", "validity_regime", "propagates_to"]
        near = duty("PHYSICAL_APPROXIMATION", passed, fields=F.when(s % 16 == 0, F.array(*map(F.lit, six))).otherwise(F.array(*map(F.lit, six[:4]))))
        source = duty("SOURCE_ALIGNMENT", passed, scope=F.when(s % 5 == 0, "same"))
        duties = F.concat(F.when(s % 7 == 0, F.array(lean)).otherwise(F.array(source, lean)), F.array(duty("EXACT_PHYSICAL_SEMANTICS", passed)), F.when(s % 4 == 0, F.array(near)).otherwise(F.array().cast(f"array<{_DUTY}>")))
        not_ = lambda route, reason: F.struct(F.lit(route).alias("route"), reason.alias("reason"))
        why = F.when(s % 11 == 0, "").otherwise("none")
        none = F.when(s % 4 == 0, F.array(not_("EMPIRICAL", why))).otherwise(F.array(not_("EMPIRICAL", why), not_("PHYSICAL_APPROXIMATION", F.lit("none"))))
        near_or_not = F.when(s % 8 == 0, True).when(s % 9 == 1, F.lit(None).cast("boolean")).otherwise(False)
        objects = self.part.select(k.cast("string").alias("object_id"), near_or_not.alias("approximation_introduced"), duties.alias("verification_obligations"), none.alias("not_applicable"))
        origin = F.when(s % 3 == 0, "SOURCE_EXPLICIT").when(s % 3 == 1, "COMPUTATIONALLY_REPRODUCED").otherwise("AGENT_INFERRED")
        records = self.part.select(k.cast("string").alias("id"), origin.alias("origin"), F.when(s % 13 == 0, no).otherwise(F.array(F.lit("a"))).alias("source_anchors"), F.when(s % 10 == 2, "same").alias("scope_relation"))
        verified = self.spark.createDataFrame([("d0",), ("d1",), ("d2",), ("d3",)], "name string")
        formal = self.spark.createDataFrame([("0", "KERNEL_CHECKED", ["d0", "d1", "d2", "d4"]), ("1", "DRAFT", ["d0"]), ("2", "KERNEL_CHECKED", ["d0", "d3"])], "id string, status string, declarations array<string>")
        return objects, records, verified, formal

    def graph_nodes(self) -> DataFrame:
        """The nodes that a graph file declares: all parts but some, and some that are no claim."""
        return self.part.where("p_size <> 31").select(F.col("p_partkey").alias("id")).unionByName(self.supplier.select((-F.col("s_suppkey") - 1).alias("id")))

    def graph_edges(self) -> DataFrame:
        """The edges of the steps, some turned around, some by a step that isn't known."""
        from stemma.operators.state import step_edges

        e = step_edges(self.bundle().steps)
        turned = e.where("step % 40 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "step")
        return e.unionByName(turned).withColumn("step", F.when(F.col("step") % 50 == 4, -F.col("step")).otherwise(F.col("step")))

    def cyclic_edges(self) -> DataFrame:
        back = self.part.where("p_size = 1 and p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))
        return self.edges().unionByName(back).distinct()

    def targets(self) -> DataFrame:
        return self.part.where(F.col("p_partkey").isin(*TARGETS)).select(F.col("p_partkey").alias("id"))

    def bundle(self) -> Bundle:
        k, s = F.col("p_partkey"), F.col("p_size")
        origin = F.when(s % 3 == 0, "SOURCE_EXPLICIT").when(s % 3 == 1, "COMPUTATIONALLY_REPRODUCED").otherwise("AGENT_INFERRED")
        statements = self.part.select(k.alias("id"), F.col("p_type").alias("kind"), F.when(s % 13 == 0, "").otherwise(F.col("p_name")).alias("text"), origin.alias("origin"), F.struct(F.array(F.concat(F.lit("assumption:h"), (k % 5).cast("string"))).alias("hypotheses")).alias("logical_form"), F.array(k % 30).alias("source_anchors"))
        foundations = self.part.where(s % 11 == 0).select(k.alias("statement_id"), F.lit("foundation").alias("kind"), F.col("p_brand").alias("statement"), F.when(s % 2 == 0, "UNCHECKED").otherwise("CHECKED").alias("source_fidelity"))
        some = self.part.where((s % 2 == 0) & (k % 3 != 0)).hint("merge").join(self.edges().withColumnRenamed("dst", "p_partkey").groupBy("p_partkey").agg(F.sort_array(F.collect_list("src")).alias("inputs")), "p_partkey")
        steps = some.select(
            (k + 1_000_000).alias("id"), "inputs", F.array(k).alias("outputs"), F.when(s % 10 == 0, "BLOCKED").otherwise("PARTIALLY_VERIFIED").alias("status"),
            F.array(F.concat(F.lit("assumption:"), (k % 17).cast("string"))).alias("active_assumptions"), F.array(k % 50, k % 7).alias("verification_records"), F.array(k % 27).alias("source_anchors"),
        )
        contracts = self.part.where(s % 5 == 0).select(
            (k + 2_000_000).alias("id"), k.alias("statement"), (s % 2 == 1).alias("accepted"), F.array(F.concat(F.lit("assumption:c"), (k % 5).cast("string"))).alias("assumptions"),
            F.array(F.struct((F.floor(k / 2) + 2_000_000).alias("contract"), F.when(s % 3 == 0, "BLOCKED").otherwise("ACCEPTED").alias("status"))).alias("imports"),
            F.when(s % 4 == 0, "VERIFIED").otherwise("DRAFT").alias("lifecycle_status"), F.when(s % 15 == 0, F.array(k % 7 + 1, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("blockers"),
        )
        key = F.col("s_suppkey")
        blockers = self.supplier.select(key.alias("id"), F.when(F.col("s_nationkey") % 2 == 0, "OPEN").otherwise("RESOLVED").alias("status"), F.array(key * 3, key * 2 + 2_000_000).alias("affects"))
        verifications = self.nation.select(F.col("n_nationkey").cast("long").alias("id"))
        anchors = self.nation.select(F.col("n_nationkey").cast("long").alias("id"))
        return Bundle(statements, foundations, steps, contracts, blockers, anchors, verifications)

    def pauli(self) -> DataFrame:
        """Small graphs of eight vertices, from all parts."""
        k = F.col("p_partkey")
        x, z = k + F.floor(k / 8), k * 5 + 3 + F.floor(k / 16)
        return self.part.select(F.floor(k / 8).alias("graph"), (k % 8).cast("int").alias("v"), x.bitwiseAND(F.lit(7)).alias("x"), z.bitwiseAND(F.lit(7)).alias("z"), F.col("p_retailprice").alias("b"))

    def words(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("id"), "text")


#: The same relations for DuckDB.
TARGET_SQL = "(" + ", ".join(map(str, TARGETS)) + ")"
PRELUDE = f"""
n AS (SELECT p_partkey AS id, p_type AS owner,
      CASE WHEN p_size % 9 = 0 THEN 'BLOCKING_UNRESOLVED_CLAIM' WHEN p_size % 4 = 0 THEN 'SOURCE_FOUND_AND_VERIFIED'
           WHEN p_size % 4 = 1 THEN 'INDEPENDENT_LEAN_PROOF_COMPLETED' ELSE 'NOT_APPLICABLE' END AS external,
      CASE WHEN p_size % 7 = 0 THEN [p_partkey % 5, 5] ELSE [] END AS blocker_ids,
      CASE WHEN p_size = 7 THEN 'GAP' WHEN p_size = 13 THEN 'PLANNED_DELTA' WHEN p_size = 22 THEN 'EXTERNAL_OR_UNMAPPED' WHEN p_size % 3 = 0 THEN 'NOT_APPLICABLE' ELSE 'EXISTING_PROJECT_DECLARATIONS' END AS binding FROM part),
e AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part UNION ALL SELECT p_partkey // 3, p_partkey FROM part)
      WHERE src < dst AND src IN (SELECT p_partkey FROM part)),
te AS (SELECT *, CASE dst % 10 WHEN 0 THEN 'definition_dependency' WHEN 1 THEN 'scope_dependency' ELSE 'scientific_claim_dependency' END AS type,
       CASE WHEN (src + dst) % 11 = 0 THEN 'CANDIDATE' WHEN (src + dst) % 13 = 0 THEN 'DISPUTED' WHEN (src + dst) % 17 = 0 THEN 'CONDITIONAL' WHEN (src + dst) % 19 = 0 THEN NULL ELSE 'ACCEPTED' END AS disposition FROM e),
ce AS (SELECT * FROM e UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_size = 1 AND p_partkey > 1),
st AS (SELECT p_partkey AS id, p_type AS kind, CASE WHEN p_size % 13 = 0 THEN '' ELSE p_name END AS text,
       CASE p_size % 3 WHEN 0 THEN 'SOURCE_EXPLICIT' WHEN 1 THEN 'COMPUTATIONALLY_REPRODUCED' ELSE 'AGENT_INFERRED' END AS origin FROM part),
fo AS (SELECT p_partkey AS id, 'foundation' AS kind, p_brand AS text, CASE WHEN p_size % 2 = 0 THEN 'UNCHECKED' ELSE 'CHECKED' END AS source_fidelity FROM part WHERE p_size % 11 = 0),
sp AS (SELECT p_partkey + 1000000 AS id, p_partkey AS output, CASE WHEN p_size % 10 = 0 THEN 'BLOCKED' ELSE 'PARTIALLY_VERIFIED' END AS status
       FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey IN (SELECT dst FROM e)),
se AS (SELECT e.src, e.dst, sp.id AS step FROM sp JOIN e ON e.dst = sp.output),
co AS (SELECT p_partkey + 2000000 AS id, p_partkey AS statement, p_size % 2 = 1 AS accepted, 'assumption:c' || (p_partkey % 5) AS assumption,
       p_partkey // 2 + 2000000 AS imported, CASE WHEN p_size % 3 = 0 THEN 'BLOCKED' ELSE 'ACCEPTED' END AS import_status,
       CASE WHEN p_size % 4 = 0 THEN 'VERIFIED' ELSE 'DRAFT' END AS lifecycle_status, CASE WHEN p_size % 15 = 0 THEN [p_partkey % 7 + 1, -1] ELSE [] END AS blockers FROM part WHERE p_size % 5 = 0),
bl AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'OPEN' ELSE 'RESOLVED' END AS status, unnest([s_suppkey * 3, s_suppkey * 2 + 2000000]) AS ref FROM supplier),
tg AS (SELECT p_partkey AS id FROM part WHERE p_partkey IN {TARGET_SQL}),
cl AS (SELECT id AS target, id FROM tg UNION SELECT cl.target, e.src FROM cl JOIN e ON e.dst = cl.id),
hc AS (SELECT id AS target, id FROM tg UNION SELECT hc.target, se.src FROM hc JOIN se ON se.dst = hc.id),
ba AS (SELECT st.id, CASE WHEN co.accepted = false THEN 'BLOCKED' WHEN sp.status = 'BLOCKED' THEN 'BLOCKED' WHEN sp.id IS NOT NULL THEN 'DERIVED_FROM_ACCEPTED_CHAIN'
       WHEN fo.id IS NOT NULL THEN CASE WHEN fo.source_fidelity <> 'UNCHECKED' THEN 'IMPORTED_CONTRACT' ELSE 'BLOCKED' END
       WHEN st.origin LIKE 'SOURCE_%' THEN 'DIRECT_SOURCE' WHEN st.origin = 'COMPUTATIONALLY_REPRODUCED' THEN 'DERIVED_FROM_ACCEPTED_CHAIN'
       ELSE 'UNVERIFIED_INFERENCE' END AS basis
       FROM st LEFT JOIN co ON co.statement = st.id LEFT JOIN sp ON sp.output = st.id LEFT JOIN fo ON fo.id = st.id),
bh AS (SELECT DISTINCT target, bl.id AS blocker FROM (
         SELECT id AS target, id AS ref FROM tg UNION SELECT target, co.id FROM hc JOIN co ON co.statement = hc.id
         UNION SELECT target, co.imported FROM hc JOIN co ON co.statement = hc.id WHERE import_status = 'BLOCKED'
         UNION SELECT target, c2.statement FROM hc JOIN co ON co.statement = hc.id JOIN co c2 ON c2.id = co.imported WHERE co.import_status = 'BLOCKED') r JOIN bl ON bl.ref = r.ref
       UNION SELECT target, unnest(blockers) FROM hc JOIN co ON co.statement = hc.id),
pv AS (SELECT p_partkey // 8 AS graph, (p_partkey % 8)::INT AS v, (p_partkey + p_partkey // 8) & 7 AS x, (p_partkey * 5 + 3 + p_partkey // 16) & 7 AS z, p_retailprice AS b FROM part),
pp AS (SELECT a.graph, a.v AS i, c.v AS j, bit_count(xor(a.x & c.z, a.z & c.x)) % 2 = 1 AS ac FROM pv a JOIN pv c ON a.graph = c.graph AND a.v < c.v),
ms AS (SELECT graph, unnest(generate_series(1, (1 << (max(v) + 1)) - 1)) AS m FROM pv GROUP BY graph),
cq AS (SELECT graph, m FROM ms WHERE NOT EXISTS (SELECT 1 FROM pp WHERE pp.graph = ms.graph AND NOT ac AND (m >> i) & 1 = 1 AND (m >> j) & 1 = 1)),
ind AS (SELECT graph, m FROM ms WHERE NOT EXISTS (SELECT 1 FROM pp WHERE pp.graph = ms.graph AND ac AND (m >> i) & 1 = 1 AND (m >> j) & 1 = 1))
"""


def sql(body: str) -> str:
    return f"WITH RECURSIVE {PRELUDE}, {body}" if not body.lstrip().upper().startswith("SELECT") else f"WITH RECURSIVE {PRELUDE} {body}"
