"""Table schemas, as DDL, and the closed sets of values that documents may hold."""

from __future__ import annotations

NODES = "graph_id string, id string, type string, scored boolean, anchor_kind string, color_class string, resolved_out_calls bigint, unresolved_indirect_out_callsites bigint, address_taken_references bigint, resolved_in_callers bigint"
EDGES = "graph_id string, src string, dst string, count bigint"
ABSTENTIONS = "graph_id string, id string, status string, reason string"
TRUTH = "graph_id string, origin string, member string"
MEMBER_SYMBOLS = "graph_id string, member string, names array<string>"
ALIASES = "graph_id string, member string, origins array<string>"
CANDIDATES = "graph_id string, address bigint"
BOUNDS = "graph_id string, address bigint, size bigint"
FUNCTIONS = "graph_id string, address bigint, name string, size bigint, boundary_source string, discovered boolean"
TRANSFERS = "graph_id string, source bigint, callsite bigint, instruction string, kind string, operand_kind string, status string, target bigint, resolver string, confidence string, filter_reason string, indirect_status string, indirect_targets array<bigint>, indirect_names map<bigint,string>"
SYMBOLS = "address bigint, size bigint, kind string, name string"
CATALOG = "member string, origin string, owner string"
LABELS = "address bigint, name string, canonical_origin string, owner string, evidence string"
RESOLUTIONS = "graph_id string, source bigint, callsite bigint, targets array<bigint>, ambiguous_source boolean, target_metadata array<struct<address:bigint,category:string,name:string>>"

# Fixed values of the document formats.
MODES = ("full", "out", "in", "out-in")
PROFILES = ("plain", "min")
SCOPES = ("subject", "rust-nonstd")
POLICIES = ("address", "role")
ANCHOR_KINDS = ("root", "incoming", "outgoing", "both", "context")
KINDS = ("call", "tail-call")
STATUSES = ("resolved", "unresolved", "unmapped", "filtered")
OPERANDS = ("immediate", "memory", "register", "unknown")
RELOCATION, INFERRED = "elf-relocation", "angr-cfg"
EXACT_RESOLVERS = ("direct-immediate", "direct-tail", RELOCATION)
RESOLVERS = (*EXACT_RESOLVERS, INFERRED)
REJECTIONS = ("unresolvable_target", "multiple_targets", "unknown_target", "ambiguous_source", "no_angr_result")
INDIRECT = ("not_applicable", "not_run", "accepted", "resolved_internal", "resolved_import", *REJECTIONS)
ABSTAIN_REASON = "no_resolved_nonself_in_or_out_edge"
SCOPE_STD_OWNERS = ("core", "alloc", "std", "__rustc")
AUDIT_STD_OWNERS = ("core", "alloc", "std")
ID_BIAS = 0x100000
BOUNDARY_MODES = ("radare2", "symbol-extent")
STAGES = ("direct-flirt", "propagated-wrapper", "cleanup-heuristic")
TOP_KEYS = {
    4: ("case", "build", "profile", "schema_version", "provenance", "extraction", "nodes"),
    5: ("case", "build", "profile", "schema_version", "provenance", "extraction", "nodes", "analysis"),
    6: ("case", "build", "profile", "schema_version", "provenance", "extraction", "nodes", "analysis", "abstentions"),
}
#: Closed keys of the objects inside graph documents: (path from the root, how the member is held, {least version: keys}).
#: An object of a path without a key set for its version isn't looked at.
NESTED_KEYS = (
    ("provenance", "object", {4: ("build_id", "source_sha256", "non_stripped_sha256", "stripped_sha256")}),
    ("analysis", "object", {5: ("track", "candidate_scope", "backend", "extractor_version", "raw_graph_sha256", "candidate_selection_sha256", "projection_config_sha256", "anchor_policy", "edge_policy", "oracle_level")}),
    ("extraction", "object", {4: ("boundary_mode", "boundary_mismatches")}),
    ("extraction.boundary_mismatches", "list", {4: ("id", "address", "symbol_size", "radare2_size")}),
    ("nodes", "list", {4: ("id", "type", "scored", "calls"), 5: ("id", "type", "scored", "calls", "anchor_kind", "color_class", "observability")}),
    ("nodes.calls", "list", {4: ("target", "count")}),
    ("nodes.observability", "object", {5: ("resolved_out_calls", "unresolved_indirect_out_callsites", "address_taken_references", "resolved_in_callers")}),
    ("abstentions", "list", {6: ("id", "status", "reason")}),
)
