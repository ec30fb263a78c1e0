"""Constraints as queries. Each gives violations (graph_id, rule, key); ``assert_valid`` raises on the first ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.schemas import ABSTAIN_REASON, ANCHOR_KINDS, BOUNDARY_MODES, INDIRECT, INFERRED, KINDS, NESTED_KEYS, OPERANDS, RESOLVERS, STAGES, STATUSES, TOP_KEYS


def _broken(df: DataFrame, rule: str, test: Column, key: Column) -> DataFrame:
    """Rows that fail a test; null counts as failing."""
    return df.where(~F.coalesce(test, F.lit(False))).select("graph_id", F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def _repeated(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    many = df.groupBy("graph_id", *keys).agg(F.count("*").alias("n")).where("n > 1")
    return many.select("graph_id", F.lit(rule).alias("rule"), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]).alias("key"))


def _listed(df: DataFrame, rule: str, key: str) -> DataFrame:
    return df.select("graph_id", F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def violations_nodes(nodes: DataFrame, version: int = 6) -> DataFrame:
    """Ids unique and not blank; anchors never scored; scored are users; before version 6 something is scored."""
    node = F.col("id")
    parts = [
        _repeated(nodes, "node id repeats", "id"),
        _broken(nodes, "node id is blank", F.trim("id") != "", node),
        _broken(nodes, "type is user or anchor", F.col("type").isin("user", "anchor"), node),
        _broken(nodes, "anchor is scored", ~((F.col("type") == "anchor") & F.col("scored")), node),
    ]
    if version < 6:
        none = nodes.groupBy("graph_id").agg(F.max("scored").alias("any")).where("not any")
        parts.append(none.select("graph_id", F.lit("nothing is scored").alias("rule"), F.lit(None).cast("string").alias("key")))
    return _all(parts)


def violations_metadata(nodes: DataFrame) -> DataFrame:
    """Users have no anchor fields; anchors have a kind and a colour class; counters aren't negative."""
    user = F.col("type") == "user"
    fields = F.when(user, F.col("anchor_kind").isNull() & F.col("color_class").isNull()).otherwise(F.col("anchor_kind").isin(*ANCHOR_KINDS) & (F.trim("color_class") != ""))
    counters = (F.col("resolved_out_calls") >= 0) & (F.col("unresolved_indirect_out_callsites") >= 0) & (F.col("resolved_in_callers") >= 0) & (F.coalesce("address_taken_references", F.lit(0)) >= 0)
    return _all([_broken(nodes, "anchor fields", fields, F.col("id")), _broken(nodes, "counters", counters, F.col("id"))])


def violations_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Both ends exist; counts are positive; one row per pair."""
    pair = F.concat_ws(" ", "src", "dst")
    ends = [edges.join(nodes.select("graph_id", F.col("id").alias(side)).distinct(), ["graph_id", side], "left_anti").select("graph_id", F.lit(f"unknown {side}").alias("rule"), pair.alias("key")) for side in ("src", "dst")]
    return _all([*ends, _broken(edges, "count is positive", F.col("count") > 0, pair), _repeated(edges, "edge repeats", "src", "dst")])


def violations_abstentions(abstentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids unique and not blank, none of them a node; status and reason are the fixed ones."""
    node = F.col("id")
    return _all([
        _repeated(abstentions, "abstention repeats", "id"), _listed(abstentions.join(nodes, ["graph_id", "id"], "left_semi"), "abstained id is a node", "id"), _broken(abstentions, "abstained id is blank", F.trim("id") != "", node),
        _broken(abstentions, "abstention status", F.col("status") == "abstain", node), _broken(abstentions, "abstention reason", F.col("reason") == ABSTAIN_REASON, node),
    ])


def violations_functions(functions: DataFrame, roots: DataFrame) -> DataFrame:
    return _all([
        _repeated(functions, "function repeats", "address"),
        _broken(functions, "size is negative", F.col("size") >= 0, F.col("address")),
        _listed(roots.join(functions, ["graph_id", "address"], "left_anti"), "root is unknown", "address"),
    ])


def violations_transfers(transfers: DataFrame, functions: DataFrame) -> DataFrame:
    """Field sets, ends, extents and the status table. Extents bind only functions of the symbol oracle with a size."""
    site = F.concat_ws(" ", F.col("source").cast("string"), F.col("callsite").cast("string"))
    known = functions.select("graph_id", F.col("address").alias("source"), F.col("size").alias("size__"), F.col("boundary_source").alias("from__")).dropDuplicates(["graph_id", "source"])
    rows = transfers.join(known, ["graph_id", "source"], "left")
    bound = (F.col("from__") == "symbol-oracle") & (F.col("size__") > 0)
    inside = ~F.coalesce(bound, F.lit(False)) | F.col("callsite").between(F.col("source"), F.col("source") + F.col("size__") - 1)
    has, sure = F.col("target").isNotNull() & F.col("resolver").isin(*RESOLVERS), F.col("confidence") == F.when(F.col("resolver") == INFERRED, "inferred").otherwise("exact")
    unfiltered = F.col("filter_reason").isNull()
    table = (
        F.when(F.col("status") == "resolved", has & sure & unfiltered).when(F.col("status") == "filtered", has & sure & F.coalesce(F.col("filter_reason") == "import", F.lit(False)))
        .when(F.col("status") == "unmapped", has & (F.col("confidence") == "exact") & unfiltered).when(F.col("status") == "unresolved", F.col("target").isNull() & F.col("resolver").isNull() & unfiltered & (F.col("confidence") == "unknown"))
    )
    ends = functions.select("graph_id", F.col("address").alias("target")).distinct()
    return _all([
        _broken(rows, "source is unknown", F.col("from__").isNotNull() | F.col("size__").isNotNull(), site),
        _broken(rows, "callsite is outside the extent", inside, site),
        _repeated(transfers, "callsite repeats", "source", "callsite"),
        _broken(transfers, "closed values", F.col("kind").isin(*KINDS) & F.col("operand_kind").isin(*OPERANDS) & F.col("status").isin(*STATUSES), site),
        _broken(transfers, "status table", table, site),
        transfers.where("status = 'resolved'").join(ends, ["graph_id", "target"], "left_anti").select("graph_id", F.lit("target is unknown").alias("rule"), site.alias("key")),
    ])


def violations_inference(transfers: DataFrame) -> DataFrame:
    """How many targets each inference status allows, and that named targets are among them."""
    site = F.concat_ws(" ", F.col("source").cast("string"), F.col("callsite").cast("string"))
    n, status, s = F.size(F.coalesce("indirect_targets", F.array().cast("array<bigint>"))), F.col("status"), F.col("indirect_status")
    only = (n == 1) & F.array_contains("indirect_targets", F.col("target"))
    named = F.size(F.array_except(F.coalesce(F.map_keys("indirect_names"), F.array().cast("array<bigint>")), F.coalesce("indirect_targets", F.array().cast("array<bigint>")))) == 0
    table = (
        F.when(s.isin("accepted", "resolved_internal"), (status == "resolved") & (F.col("resolver") == INFERRED) & only).when(s == "resolved_import", (status == "filtered") & (F.col("resolver") == INFERRED) & only)
        .when(s == "multiple_targets", (status == "unresolved") & (n >= 2)).when(s.isin("unknown_target", "unresolvable_target"), (status == "unresolved") & (n == 1))
        .when(s.isin("ambiguous_source", "no_angr_result", "not_run"), (status == "unresolved") & (n == 0)).otherwise(n == 0)
    )
    return _all([_broken(transfers, "inference status", s.isin(*INDIRECT), site), _broken(transfers, "inference targets", table, site), _broken(transfers, "inference names", named, site)])


def violations_summary(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Graphs whose stored summary isn't the recomputed one."""
    differ = stored.exceptAll(recomputed).select("graph_id").union(recomputed.exceptAll(stored).select("graph_id")).distinct()
    return differ.select("graph_id", F.lit("stored summary differs").alias("rule"), F.lit(None).cast("string").alias("key"))


def violations_run_status(status: DataFrame, transfers: DataFrame) -> DataFrame:
    """A run that didn't happen decides nothing; a completed one leaves nothing open. status: (graph_id, analysis_status)."""
    from weftgraph.operators.evidence import indirect

    rows = indirect(transfers).join(status, "graph_id")
    ran, open_ = F.col("analysis_status"), F.col("indirect_status") == "not_run"
    wrong = F.when((ran == "not_run") & ~open_, "not run, yet decided").when((ran == "completed") & open_, "completed, yet open")
    return rows.withColumn("rule", wrong).where("rule is not null").select("graph_id", "rule").distinct().withColumn("key", F.lit(None).cast("string"))


def violations_selection(candidates: DataFrame, bounds: DataFrame) -> DataFrame:
    """Every target has one extent of positive size, and is listed once."""
    return _all([
        _repeated(candidates, "target repeats", "address"), _repeated(bounds, "extent repeats", "address"), _broken(bounds, "extent is empty", F.col("size") > 0, F.col("address")),
        _listed(candidates.join(bounds, ["graph_id", "address"], "left_anti"), "target without extent", "address"),
    ])


def violations_truth(truth: DataFrame, symbols: DataFrame) -> DataFrame:
    """Members belong to one origin; symbols name exactly the members."""
    return _all([
        _repeated(truth, "member repeats", "member"),
        _listed(truth.join(symbols, ["graph_id", "member"], "left_anti"), "member without symbols", "member"),
        _listed(symbols.join(truth, ["graph_id", "member"], "left_anti"), "symbols without member", "member"),
    ])


def universe_diff(nodes: DataFrame, abstentions: DataFrame, truth: DataFrame) -> DataFrame:
    """Scored and abstained ids against truth members: (graph_id, id, side) of what only one side has."""
    targets = nodes.where("scored").select("graph_id", "id").union(abstentions.select("graph_id", "id")).distinct().withColumn("a", F.lit(True))
    members = truth.select("graph_id", F.col("member").alias("id")).distinct().withColumn("b", F.lit(True))
    both = targets.join(members, ["graph_id", "id"], "full_outer").where("a is null or b is null")
    return both.select("graph_id", "id", F.when(F.col("a").isNull(), "only truth").otherwise("only graph").alias("side"))


def violations_universe(nodes: DataFrame, abstentions: DataFrame, truth: DataFrame) -> DataFrame:
    """``universe_diff`` as violations."""
    return universe_diff(nodes, abstentions, truth).select("graph_id", F.col("side").alias("rule"), F.col("id").alias("key"))


def violations_pairing(graphs: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """Documents to be joined have the same case, build and profile, and the same provenance.

    Both sides: (graph_id, provenance), a row per document. A graph without its other document has another identity.
    """
    left, right = graphs.select("graph_id", F.col("provenance").alias("here")).withColumn("a", F.lit(True)), others.select("graph_id", F.col("provenance").alias("there")).withColumn("b", F.lit(True))
    rows = left.join(right, "graph_id", "full_outer")
    rule = F.when(F.col("b").isNull(), f"no {name} of this identity").when(F.col("a").isNull(), f"{name} without a graph").when(~F.col("here").eqNullSafe(F.col("there")), f"{name} of another provenance")
    return rows.withColumn("rule", rule).where("rule is not null").select("graph_id", "rule", F.lit(None).cast("string").alias("key"))


def violations_provenance(rows: DataFrame, digests: list[str], texts: list[str] = ()) -> DataFrame:
    """Digests are 64 lower-case hex digits; texts aren't blank."""
    digest = [_broken(rows, f"{d} is a digest", F.col(d).rlike("^[0-9a-f]{64}$"), F.col(d)) for d in digests]
    return _all(digest + [_broken(rows, f"{t} is blank", F.trim(t) != "", F.col(t)) for t in texts])


def violations_build(docs: DataFrame) -> DataFrame:
    """Provenance of documents (graph_id, provenance): a build id and three digests."""
    parts = ("source_sha256", "non_stripped_sha256", "stripped_sha256")
    return violations_provenance(docs.select("graph_id", F.col("provenance.build_id").alias("build_id"), *[F.col(f"provenance.{d}").alias(d) for d in parts]), [*parts], ["build_id"])


def violations_raw(docs: DataFrame) -> DataFrame:
    """Raw graph documents: boundary input's digest, the binary's digest against the build's, boundary mode, texts, some function."""
    key = F.col("graph_id")
    return _all([
        _broken(docs, "boundary input is a digest", F.col("analysis.boundary_input_sha256").rlike("^[0-9a-f]{64}$"), key), _broken(docs, "binary is of another build", F.col("binary.stripped_sha256") == F.col("provenance.stripped_sha256"), key),
        _broken(docs, "boundary mode", F.col("extraction.boundary_mode").isin(*BOUNDARY_MODES), key), _broken(docs, "functions are empty", F.size("functions") > 0, key),
        *[_broken(docs, f"{t} is blank", F.trim(t) != "", key) for t in ("analysis.backend", "analysis.extractor_version", "analysis.oracle_level", "binary.path")],
    ])


def violations_boundaries(bounds: DataFrame) -> DataFrame:
    """Extents (graph_id, address, size): each address once, sizes positive."""
    return _all([_repeated(bounds, "extent repeats", "address"), _broken(bounds, "address is no number", F.col("address").isNotNull(), F.col("address")), _broken(bounds, "extent is empty", F.col("size") > 0, F.col("address"))])


def violations_catalog(catalog: DataFrame) -> DataFrame:
    """Catalog rows (graph_id, member, origin, owner): a member once, no blank origin or owner."""
    member = F.col("member")
    return _all([_repeated(catalog, "member repeats", "member"), _broken(catalog, "origin is blank", F.trim("origin") != "", member), _broken(catalog, "owner is blank", F.trim("owner") != "", member)])


def violations_labels(labels: DataFrame) -> DataFrame:
    """Label rows (graph_id, address, evidence, name): stages are closed, and a stage has an address once."""
    at = F.concat_ws(" ", F.col("evidence"), F.col("address").cast("string"))
    return _all([_repeated(labels, "label repeats", "address", "evidence"), _broken(labels, "stage", F.col("evidence").isin(*STAGES), at), _broken(labels, "label has an address", F.col("address").isNotNull(), at), _broken(labels, "label has a name", F.col("name") != "", at)])


def violations_probe(docs: DataFrame, labels: DataFrame, builds: DataFrame) -> DataFrame:
    """A probe's output is of the expected build and declares that it saw the stripped binary only; its labels are valid.

    docs: (graph_id, schema_version, stripped_sha256, input); labels: ``violations_labels``' with mapped_address; builds:
    (graph_id, stripped_sha256).
    """
    key, known = F.col("graph_id"), builds.select("graph_id", F.col("stripped_sha256").alias("expected__"))
    rows = docs.join(known, "graph_id", "left")
    return _all([
        _broken(rows, "probe of an unknown build", F.col("expected__").isNotNull(), key), _broken(rows, "probe of another binary", F.col("stripped_sha256") == F.coalesce("expected__", "stripped_sha256"), key),
        _broken(rows, "probe version", F.col("schema_version") == 1, key), _broken(rows, "probe saw more than the stripped binary", F.col("input") == "stripped-only", key),
        _broken(labels, "label has a mapped address", F.col("mapped_address").isNotNull(), F.col("address")), violations_labels(labels),
    ])


def violations_keys(documents: DataFrame, required: list[str], allowed: list[str], json: str = "json") -> DataFrame:
    """Missing and unexpected keys of JSON documents (graph_id, json)."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    lists = [("missing key", F.array_except(F.array(*map(F.lit, required)), keys)), ("unexpected key", F.array_except(keys, F.array(*map(F.lit, allowed))))]
    return _all([documents.select("graph_id", F.lit(rule).alias("rule"), F.explode(found).alias("key")) for rule, found in lists])


def violations_top_level(documents: DataFrame, json: str = "json") -> DataFrame:
    """Graph documents (graph_id, json) have their version's keys and ``note`` at most; other versions are violations."""
    version = F.get_json_object(json, "$.schema_version").try_cast("int")
    rows = documents.withColumn("version__", version)
    unknown = rows.where(F.col("version__").isNull() | ~F.col("version__").isin(*TOP_KEYS))
    parts = [violations_keys(rows.where(F.col("version__") == v), [*keys], [*keys, "note"], json) for v, keys in TOP_KEYS.items()]
    return _all([*parts, unknown.select("graph_id", F.lit("unsupported version").alias("rule"), F.get_json_object(json, "$.schema_version").alias("key"))])


_FAULTS = "array<struct<rule:string,key:string>>"


def _faults(rule: str, names: Column, place) -> Column:
    """A fault for each of the names, none where they are null."""
    return F.coalesce(F.transform(names, lambda n: F.struct(F.lit(rule).alias("rule"), place(n).alias("key"))), F.array().cast(_FAULTS))


def _at(rule: str, key: Column) -> Column:
    return F.array(F.struct(F.lit(rule).alias("rule"), key.alias("key")))


def _in_list(member: Column, version: Column, at: Column, path: str) -> Column:
    """Faults of a list's objects, or that it is none."""
    each = lambda x, i: _in_object(x, version, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), path)
    return _once(F.try_variant_get(member, "$", "array<variant>"), lambda items: F.when(items.isNull(), _at("not a list", at)).otherwise(F.flatten(F.transform(items, each))))


def _in_object(v: Column, version: Column, at: Column | None = None, path: str = "") -> Column:
    """Faults (_FAULTS) of an object ``v`` that lies at ``at``: of its own keys, NESTED_KEYS' of ``path``, and of what it holds."""
    none, known = F.array().cast(_FAULTS), next((keys for p, _, keys in NESTED_KEYS if p == path), {})
    place = lambda name: name if at is None else F.concat_ws(".", at, name)
    wanted = reduce(lambda so_far, n: F.when(version >= n, F.array(*map(F.lit, known[n]))).otherwise(so_far), sorted(known), F.lit(None).cast("array<string>"))

    def of(held: Column) -> Column:
        found, has = [none], F.map_keys(held)
        if known:
            differ = F.concat(_faults("missing key", F.array_except(wanted, has), place), _faults("unexpected key", F.array_except(has, wanted), place))
            found.append(F.when(has == F.sort_array(wanted), none).otherwise(differ))  # a variant's keys are sorted, so good objects end here
        for child, kind, _ in NESTED_KEYS:
            above, _, name = child.rpartition(".")
            if above == path:
                inside = (_in_list if kind == "list" else _in_object)(held[name], version, place(F.lit(name)), child)
                found.append(F.when(held[name].isNull(), none).otherwise(inside))
        return F.concat(*found)

    other = F.when(version >= min(known), _at("not an object", at)).otherwise(none) if known else none
    return _once(F.try_variant_get(v, "$", "map<string,variant>"), lambda held: F.when(held.isNull(), other).otherwise(of(held)))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def violations_nested_keys(documents: DataFrame, json: str = "json") -> DataFrame:
    """Objects inside graph documents (graph_id, json) have exactly their keys; ``key`` is the path, such as nodes[3].calls[0].count.

    A table with an explicit schema would drop a foreign key and read a misspelt one as null. So a document is parsed once
    as a variant and walked once, in the task that has it: an object is a map of variants there, whose keys are held against
    those of its path and version. A member that isn't there is a missing key of its parent, and not descended into; a
    member of the wrong kind is a violation itself. Documents of other versions are left to ``violations_top_level``.
    """
    version = F.get_json_object(json, "$.schema_version").try_cast("int")
    faults = _once(version, lambda n: F.when(n.isin(*TOP_KEYS), _in_object(F.try_parse_json(json), n)))
    rows = documents.select("graph_id", F.explode_outer(faults).alias("fault"))  # outer: else the walk is run once more, as a filter
    return rows.where("fault is not null").select("graph_id", "fault.rule", "fault.key")


def violations_edge_policy(docs: DataFrame) -> DataFrame:
    """Analysis of graph documents (graph_id, analysis): the edge policy is a list of texts, some, none empty, none twice."""
    policy = F.col("analysis.edge_policy")
    fine = (F.size(policy) > 0) & ~F.exists(policy, lambda x: x.isNull() | (x == "")) & (F.size(F.array_distinct(policy)) == F.size(policy))
    return _broken(docs, "edge policy", fine, F.col("graph_id"))


def assert_valid(violations: DataFrame, show: int = 5) -> None:
    found = violations.take(show)
    if found:
        raise ValueError("; ".join(f"{r['graph_id']}: {r['rule']}: {r['key']}" for r in found))
