"""Types of the record collections. Files are always read with one of these, never by inference."""

from __future__ import annotations

# Names and types of the fields of each collection.
STATEMENT = "id string, kind string, text string, origin string, symbols array<string>, source_anchors array<string>, logical_form struct<quantifiers:string,hypotheses:array<string>,conclusion:string>, truth_status string, scope_relation string"
ANCHOR = "id string, paper_id string, artifact string, artifact_hash string, content_hash string, location struct<page:int,page_start:int,page_end:int,section:string,line_start:int,line_end:int,label:string>"
STEP = "id string, chain_id string, inputs array<string>, outputs array<string>, operation string, justification struct<description:string>, active_assumptions array<string>, source_anchors array<string>, verification_records array<string>, status string"
VERIFICATION = "id string, target string, method string, checker string, result string, scope struct<checked:array<string>,not_checked:array<string>>, evidence array<string>, environment map<string,string>, tolerance double"
CONTRACT = "id string, provider_agent string, statement string, version string, lifecycle_status string, accepted boolean, assumptions array<string>, imports array<struct<contract:string,status:string>>, blockers array<string>, verification map<string,string>"
BLOCKER = "id string, status string, reason string, next_action string, affects array<string>"
FOUNDATION = "id string, statement_id string, kind string, statement string, assumptions array<string>, source_fidelity string, acceptance_basis string"
PARTITION = "object_id string, object_kind string, approximation_introduced boolean, verification_obligations array<struct<route:string,status:string,evidence:array<string>,declarations:array<string>>>, not_applicable array<struct<route:string,reason:string>>"
HASHES = "algorithm string, hashes map<string,string>"

# The domains that gates check.
ROUTES = ("SOURCE_ALIGNMENT", "LEAN_KERNEL", "EXACT_PHYSICAL_SEMANTICS", "PHYSICAL_APPROXIMATION", "EMPIRICAL")
DISPOSITIONS = ("CANDIDATE", "ACCEPTED", "CONDITIONAL", "REJECTED", "REDUNDANT_IN_QUERY_VIEW", "BLOCKED", "DISPUTED")
EDGE_TYPES = ("scientific_claim_dependency", "definition_dependency", "scope_dependency", "data_dependency")
PASSING = ("PASSED", "KERNEL_CHECKED", "HUMAN_REVIEWED", "REPRODUCED")
CLOSED = ("VERIFIED", "VERIFICATION_CLOSED")
APPROXIMATION = ("exact_parent", "approximation_map", "control_parameters", "error_model", "validity_regime", "propagates_to")
AXIOMS = ("propext", "Classical.choice", "Quot.sound")
CHANGES = ("confirm_edge", "reject_edge", "mark_redundant", "replace_by_reuse", "introduce_bridge", "merge_interfaces", "split_node", "expand_premise")
STOP_REASONS = (
    "PRIMARY_SOURCE_REACHED",
    "FORMAL_CORE_SELF_CONTAINED",
    "STANDARD_BACKGROUND_ACCEPTED",
    "FURTHER_EXPANSION_OUT_OF_SCOPE",
    "SOURCE_UNAVAILABLE",
    "FORMALIZATION_COST_EXCEEDS_PILOT",
    "EMPIRICAL_INPUT_TREATED_AS_EXTERNAL",
)
# Each state and those that may follow it.
NODE_MACHINE = {
    "ORACLE_PROPOSED": ("NORMALIZED",),
    "NORMALIZED": ("SOURCE_ALIGNED", "SOURCE_UNAVAILABLE"),
    "SOURCE_ALIGNED": ("FORMALLY_STATED",),
    "SOURCE_UNAVAILABLE": ("FORMALLY_STATED", "KERNEL_CHECKED"),
    "FORMALLY_STATED": ("KERNEL_CHECKED",),
    "KERNEL_CHECKED": ("AUDITED",),
    "AUDITED": ("REUSABLE_CONTRACT",),
}
EDGE_SIDE = ("CONDITIONAL", "REJECTED", "REDUNDANT_IN_QUERY_VIEW", "BLOCKED", "DISPUTED")
EDGE_MACHINE = {
    "ORACLE_PROPOSED": ("SCHEMA_VALID", *EDGE_SIDE),
    "SCHEMA_VALID": ("RETRIEVAL_SUPPORTED", *EDGE_SIDE),
    "RETRIEVAL_SUPPORTED": ("SOURCE_ALIGNED", *EDGE_SIDE),
    "SOURCE_ALIGNED": ("LEAN_SUPPORTED", *EDGE_SIDE),
    "LEAN_SUPPORTED": ("ACCEPTED", *EDGE_SIDE),
    "ACCEPTED": EDGE_SIDE,
}
FORMAL_MACHINE = {
    "UNFORMALIZED": ("TYPE_STATED",),
    "TYPE_STATED": ("SEARCHED",),
    "SEARCHED": ("PROOF_CANDIDATE",),
    "PROOF_CANDIDATE": ("KERNEL_CHECKED",),
    "KERNEL_CHECKED": ("AXIOM_AUDITED",),
    "AXIOM_AUDITED": ("STATEMENT_ALIGNED",),
    "STATEMENT_ALIGNED": ("REUSABLE_CONTRACT",),
}
