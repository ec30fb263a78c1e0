"""Constraints over whole tables with faults put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import audit, checks
from weftgraph.plans.queries import query
from weftgraph.schemas import ABSTAIN_REASON, TOP_KEYS
from weftgraph.session import table
from weftgraph.sources.bridges import view, with_views


def _graph():
    return F.lit("g").alias("graph_id")


def _violations(df):
    return df.select("rule", "key")


@query(with_views("geo_truth") + f""", a AS (SELECT CASE WHEN member LIKE 'S%' THEN member ELSE concat('A', member) END AS id, CASE WHEN member LIKE '%1' THEN 'kept' ELSE 'abstain' END AS status, CASE WHEN member LIKE '%2' THEN NULL ELSE '{ABSTAIN_REASON}' END AS reason FROM geo_truth UNION ALL SELECT 'AC3', 'abstain', '{ABSTAIN_REASON}')
    SELECT 'abstention repeats' AS rule, id AS key FROM a GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'abstained id is a node', id FROM a WHERE id LIKE 'S%' UNION ALL SELECT 'abstention status', id FROM a WHERE status <> 'abstain' UNION ALL SELECT 'abstention reason', id FROM a WHERE reason IS NULL""")
def violations_abstentions(spark, sf_dir):
    member = F.col("member")
    rows = view(spark, sf_dir, "geo_truth").select("graph_id", F.when(member.startswith("S"), member).otherwise(F.concat(F.lit("A"), member)).alias("id"), F.when(member.endswith("1"), "kept").otherwise("abstain").alias("status"), F.when(~member.endswith("2"), ABSTAIN_REASON).alias("reason"))
    twice = spark.range(1).select(F.lit("geo").alias("graph_id"), F.lit("AC3").alias("id"), F.lit("abstain").alias("status"), F.lit(ABSTAIN_REASON).alias("reason"))
    return _violations(checks.violations_abstentions(rows.unionByName(twice), view(spark, sf_dir, "geo_nodes")))


@query("""SELECT 'anchor fields' AS rule, CAST(c_custkey AS STRING) AS key FROM customer WHERE CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 = 0 ELSE c_custkey % 3 <> 0 OR c_custkey % 5 = 0 END UNION ALL SELECT 'counters', CAST(c_custkey AS STRING) FROM customer WHERE c_nationkey < 2""")
def violations_metadata(spark, sf_dir):
    key = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(
        _graph(), key.cast("string").alias("id"), F.when(key % 2 == 0, "user").otherwise("anchor").alias("type"), F.when(key % 3 == 0, "both").alias("anchor_kind"), F.when(key % 3 == 0, F.when((key % 5 == 0) & (key % 2 == 1), " ").otherwise("ADDR:x")).alias("color_class"),
        (F.col("c_nationkey") - 2).cast("bigint").alias("resolved_out_calls"), F.lit(0).alias("unresolved_indirect_out_callsites"), F.lit(0).alias("resolved_in_callers"), F.lit(None).cast("bigint").alias("address_taken_references"),
    )
    return _violations(checks.violations_metadata(nodes))


@query("""SELECT 'function repeats' AS rule, CAST(o_custkey AS STRING) AS key FROM orders GROUP BY o_custkey HAVING count(*) > 1 UNION ALL SELECT 'size is negative', CAST(o_custkey AS STRING) FROM orders WHERE o_totalprice < 50000
    UNION ALL SELECT 'root is unknown', CAST(c_custkey AS STRING) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def violations_functions(spark, sf_dir):
    functions = table(spark, sf_dir, "orders").select(_graph(), F.col("o_custkey").alias("address"), F.when(F.col("o_totalprice") < 50000, -1).otherwise(1).alias("size"))
    return _violations(checks.violations_functions(functions, table(spark, sf_dir, "customer").select(_graph(), F.col("c_custkey").alias("address"))))


_STATUSES = ["resolved_internal", "multiple_targets", "unknown_target", "no_angr_result", "not_applicable", "bogus"]


@query(f"""WITH r AS (SELECT concat(CAST(l_orderkey AS STRING), ' ', CAST(l_linenumber AS STRING)) AS key, {_STATUSES}[l_partkey % 6 + 1] AS s, l_suppkey % 4 AS n, l_returnflag = 'A' AS res FROM lineitem)
    SELECT 'inference status' AS rule, key FROM r WHERE s = 'bogus' UNION ALL SELECT 'inference targets', key FROM r WHERE NOT CASE s WHEN 'resolved_internal' THEN res AND n = 1 WHEN 'multiple_targets' THEN NOT res AND n >= 2 WHEN 'unknown_target' THEN NOT res AND n = 1 WHEN 'no_angr_result' THEN NOT res AND n = 0 ELSE n = 0 END
    UNION ALL SELECT 'inference names', key FROM r WHERE n < 2""")
def violations_inference(spark, sf_dir):
    n, resolved = F.col("l_suppkey") % 4, F.col("l_returnflag") == "A"
    status = F.element_at(F.array(*map(F.lit, _STATUSES)), (F.col("l_partkey") % 6 + 1).cast("int"))
    none = F.array().cast("array<bigint>")
    rows = table(spark, sf_dir, "lineitem").select(
        _graph(), F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("callsite"), status.alias("indirect_status"), F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(none).alias("indirect_targets"), F.create_map(F.lit(2).cast("bigint"), F.lit("name")).alias("indirect_names"),
        F.when(resolved, "resolved").otherwise("unresolved").alias("status"), F.when(resolved, "angr-cfg").alias("resolver"), F.when(resolved, F.lit(1).cast("bigint")).alias("target"),
    )
    return _violations(checks.violations_inference(rows))


@query(with_views("flow_lines") + """, r AS (SELECT CAST(source % 7 AS STRING) AS graph_id, source % 7 % 2 = 0 AS completed, status = 'unresolved' AS open FROM flow_lines)
    SELECT DISTINCT graph_id, CASE WHEN completed AND open THEN 'completed, yet open' WHEN NOT completed AND NOT open THEN 'not run, yet decided' END AS rule FROM r WHERE completed = open""")
def violations_run_status(spark, sf_dir):
    lines = view(spark, sf_dir, "flow_lines")
    transfers = lines.select((F.col("source") % 7).cast("string").alias("graph_id"), F.lit("call").alias("kind"), F.col("operand").alias("operand_kind"), F.when(F.col("status") == "unresolved", "not_run").otherwise("resolved_internal").alias("indirect_status"))
    status = spark.range(7).select(F.col("id").cast("string").alias("graph_id"), F.when(F.col("id") % 2 == 0, "completed").otherwise("not_run").alias("analysis_status"))
    return checks.violations_run_status(status, transfers).select("graph_id", "rule")


@query("""SELECT CAST(c_nationkey AS STRING) AS graph_id FROM customer GROUP BY c_nationkey HAVING sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) <> count(*)""")
def violations_summary(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumn("graph_id", F.col("c_nationkey").cast("string"))
    stored, now = customer.groupBy("graph_id").agg(F.count("*").alias("n")), customer.where("c_acctbal > 0").groupBy("graph_id").agg(F.count("*").alias("n"))
    return checks.violations_summary(stored, now).select("graph_id")


@query("""WITH d AS (SELECT c_custkey % 4 + 4 AS v, CAST(c_custkey AS STRING) AS graph_id, c_custkey % 3 = 0 AS cut, c_custkey % 5 = 0 AS more FROM customer)
    SELECT graph_id, 'unsupported version' AS rule, '7' AS key FROM d WHERE v = 7 UNION ALL SELECT graph_id, 'missing key', 'nodes' FROM d WHERE v < 7 AND cut UNION ALL SELECT graph_id, 'unexpected key', 'zzz' FROM d WHERE v < 7 AND more""")
def violations_top_level(spark, sf_dir):
    key = F.col("c_custkey")
    version = (key % 4 + 4).cast("string")
    more = F.concat(*[F.when(F.lit(int(k == "nodes")).cast("boolean") & (key % 3 == 0), "").when(key % 4 + 4 >= v, f',"{k}":1').otherwise("") for k, v in [(k, min(v for v, ks in TOP_KEYS.items() if k in ks)) for k in TOP_KEYS[6] if k != "schema_version"]])
    json = F.concat(F.lit('{"schema_version":'), version, more, F.when(key % 5 == 0, ',"zzz":0').otherwise(""), F.lit(',"note":"x"}'))
    return checks.violations_top_level(table(spark, sf_dir, "customer").select(key.cast("string").alias("graph_id"), json.alias("json")))


@query("""WITH d AS (SELECT o_orderkey AS k, CAST(o_orderkey AS STRING) AS graph_id, CASE WHEN o_orderkey % 7 = 0 THEN 6 ELSE 5 END AS v FROM orders),
    l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, l_quantity AS q FROM lineitem),
    n AS (SELECT d.graph_id, concat('nodes[', CAST(i AS STRING), ']') AS spot, q, d.v FROM l JOIN d USING (k))
    SELECT graph_id, 'missing key' AS rule, concat(spot, '.scored') AS key FROM n WHERE q = 10 UNION ALL SELECT graph_id, 'unexpected key', concat(spot, '.calls[0].kind') FROM n WHERE q = 20
    UNION ALL SELECT graph_id, 'missing key', concat(spot, '.observability.resolved_in_callers') FROM n WHERE q = 30 UNION ALL SELECT graph_id, 'not an object', spot FROM n WHERE q = 40
    UNION ALL SELECT graph_id, 'not a list', concat(spot, '.calls') FROM n WHERE q = 50 UNION ALL SELECT graph_id, 'unexpected key', 'extraction.x' FROM d WHERE k % 11 = 0
    UNION ALL SELECT graph_id, 'missing key', 'extraction.boundary_mismatches[1].radare2_size' FROM d WHERE k % 5 = 0 UNION ALL SELECT graph_id, 'missing key', 'abstentions[0].reason' FROM d WHERE v = 6
    UNION ALL SELECT graph_id, 'missing key', 'provenance.build_id' FROM d WHERE k % 13 = 0 UNION ALL SELECT graph_id, 'not an object', 'analysis' FROM d WHERE k % 3 = 0""")
def violations_nested_keys(spark, sf_dir):
    """Orders as documents, their lines as nodes, with keys left out and added at every level."""
    q, k = F.col("l_quantity"), F.col("o_orderkey")
    when = lambda test, text: F.when(test, text).otherwise("")
    seen = F.concat(F.lit('{"resolved_out_calls":1,"unresolved_indirect_out_callsites":0,"address_taken_references":null'), when(q != 30, ',"resolved_in_callers":2'), F.lit("}"))
    calls = F.when(q == 50, '"none"').otherwise(F.concat(F.lit('[{"target":"a","count":1'), when(q == 20, ',"kind":"call"'), F.lit('},{"count":2,"target":"b"}]')))
    node = F.when(q == 40, "7").otherwise(F.concat(F.lit('{"id":"n"'), when(q != 10, ',"scored":true'), F.lit(',"type":"user","anchor_kind":null,"color_class":null,"calls":'), calls, F.lit(',"observability":'), seen, F.lit("}")))
    nodes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", node.alias("node")))).alias("nodes"))
    docs = table(spark, sf_dir, "orders").join(nodes, "o_orderkey", "left")
    good = ',"'.join(f'{x}":"x"' for x in ("track", "candidate_scope", "backend", "extractor_version", "raw_graph_sha256", "candidate_selection_sha256", "projection_config_sha256", "anchor_policy", "edge_policy", "oracle_level"))
    mismatch = lambda size: F.concat(F.lit('{"id":"a","address":"0x1","symbol_size":1'), size, F.lit("}"))
    json = F.concat(
        F.lit('{"schema_version":'), F.when(k % 7 == 0, '6,"abstentions":[{"id":"x","status":"abstain"}]').otherwise("5"), F.lit(',"provenance":{"source_sha256":"","non_stripped_sha256":"","stripped_sha256":""'), when(k % 13 != 0, ',"build_id":"b"'),
        F.lit('},"analysis":'), F.when(k % 3 == 0, "[]").otherwise('{"' + good + "}"), F.lit(',"extraction":{"boundary_mode":"radare2"'), when(k % 11 == 0, ',"x":[]'), F.lit(',"boundary_mismatches":['), mismatch(F.lit(',"radare2_size":2')), F.lit(","),
        mismatch(when(k % 5 != 0, ',"radare2_size":2')), F.lit(']},"nodes":['), F.coalesce(F.array_join(F.transform("nodes", lambda n: n["node"]), ","), F.lit("")), F.lit("]}"),
    )
    return checks.violations_nested_keys(docs.select(k.cast("string").alias("graph_id"), json.alias("json")))


@query("""SELECT CAST(s_suppkey AS STRING) AS graph_id, 'edge policy' AS rule FROM supplier WHERE s_suppkey % 5 < 4""")
def violations_edge_policy(spark, sf_dir):
    key = F.col("s_suppkey")
    policy = F.when(key % 5 == 0, F.array().cast("array<string>")).when(key % 5 == 1, F.array("s_name", "s_name")).when(key % 5 == 2, F.array("s_name", F.lit(""))).when(key % 5 == 4, F.array("s_name", F.lit("direct")))
    return checks.violations_edge_policy(table(spark, sf_dir, "supplier").select(key.cast("string").alias("graph_id"), F.struct(policy.alias("edge_policy")).alias("analysis"))).select("graph_id", "rule")


@query("""WITH a AS (SELECT c_custkey AS k, c_nationkey AS p FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS k, c_nationkey + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS p FROM customer WHERE c_custkey % 3 <> 0)
    SELECT CAST(coalesce(a.k, b.k) AS STRING) AS graph_id, CASE WHEN b.k IS NULL THEN 'no truth of this identity' WHEN a.k IS NULL THEN 'truth without a graph' ELSE 'truth of another provenance' END AS rule FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.p <> b.p""")
def violations_pairing(spark, sf_dir):
    key, build = F.col("c_custkey"), F.col("c_nationkey").cast("bigint")
    side = lambda rows, p: rows.select(key.cast("string").alias("graph_id"), F.struct(p.alias("build_id"), F.lit(None).cast("string").alias("source_sha256")).alias("provenance"))
    customer = table(spark, sf_dir, "customer")
    left, right = side(customer.where("c_custkey % 5 <> 0"), build), side(customer.where("c_custkey % 3 <> 0"), build + F.when(key % 7 == 0, 1).otherwise(0))
    return checks.violations_pairing(left, right, "truth").select("graph_id", "rule")


@query("""SELECT CAST(s_suppkey AS STRING) AS graph_id, 'boundary input is a digest' AS rule FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT CAST(s_suppkey AS STRING), 'binary is of another build' FROM supplier WHERE s_suppkey % 5 = 0
    UNION ALL SELECT CAST(s_suppkey AS STRING), 'boundary mode' FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT CAST(s_suppkey AS STRING), 'functions are empty' FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT CAST(s_suppkey AS STRING), 'analysis.backend is blank' FROM supplier WHERE s_suppkey % 9 = 0
    UNION ALL SELECT CAST(s_suppkey AS STRING), 'build_id is blank' FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT CAST(s_suppkey AS STRING), 'stripped_sha256 is a digest' FROM supplier WHERE s_suppkey % 8 = 0""")
def violations_raw(spark, sf_dir):
    key, x, digest = F.col("s_suppkey"), F.lit("x"), F.sha2(F.col("s_name"), 256)
    stripped = F.when(key % 8 == 0, F.upper(digest)).otherwise(digest)
    docs = table(spark, sf_dir, "supplier").select(
        key.cast("string").alias("graph_id"), F.struct(F.when(key % 10 == 0, " ").otherwise("b").alias("build_id"), digest.alias("source_sha256"), digest.alias("non_stripped_sha256"), stripped.alias("stripped_sha256")).alias("provenance"),
        F.struct(F.when(key % 9 != 0, x).alias("backend"), x.alias("extractor_version"), x.alias("oracle_level"), F.when(key % 4 != 0, digest).otherwise("no digest").alias("boundary_input_sha256")).alias("analysis"),
        F.struct(x.alias("path"), F.when(key % 5 == 0, "other").otherwise(stripped).alias("stripped_sha256")).alias("binary"), F.struct(F.when(key % 6 == 0, "guess").otherwise("radare2").alias("boundary_mode")).alias("extraction"),
        F.when(key % 7 != 0, F.array(x)).otherwise(F.array().cast("array<string>")).alias("functions"),
    )
    return checks.violations_raw(docs).unionByName(checks.violations_build(docs)).select("graph_id", "rule")


@query("""WITH l AS (SELECT l_partkey AS address, ['direct-flirt', 'propagated-wrapper', 'cleanup-heuristic', 'guess'][CAST(floor(l_tax * 100) AS BIGINT) % 4 + 1] AS evidence, l_suppkey AS name FROM lineitem)
    SELECT 'label repeats' AS rule, concat(CAST(address AS STRING), ' ', evidence) AS key FROM l GROUP BY address, evidence HAVING count(*) > 1 UNION ALL SELECT 'stage', concat(evidence, ' ', CAST(address AS STRING)) FROM l WHERE evidence = 'guess'
    UNION ALL SELECT 'label has a name', concat(evidence, ' ', CAST(address AS STRING)) FROM l WHERE name < 5 UNION ALL SELECT 'label has a mapped address', CAST(address AS STRING) FROM l WHERE name = 7
    UNION ALL SELECT 'probe of an unknown build', CAST(s_suppkey AS STRING) FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'probe of another binary', CAST(s_suppkey AS STRING) FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 3 = 0
    UNION ALL SELECT 'probe version', CAST(s_suppkey AS STRING) FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'probe saw more than the stripped binary', CAST(s_suppkey AS STRING) FROM supplier WHERE s_suppkey % 7 = 0""")
def violations_probe(spark, sf_dir):
    stages = F.array(*[F.lit(s) for s in (*audit.STAGES, "guess")])
    labels = table(spark, sf_dir, "lineitem").select(_graph(), F.col("l_partkey").alias("address"), F.element_at(stages, (F.floor(F.col("l_tax") * 100) % 4 + 1).cast("int")).alias("evidence"), F.when(F.col("l_suppkey") < 5, "").otherwise("x").alias("name"), F.when(F.col("l_suppkey") != 7, 1).alias("mapped_address"))
    key, supplier = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    docs = supplier.select(key.cast("string").alias("graph_id"), F.when(key % 5 == 0, 2).otherwise(1).alias("schema_version"), F.when(key % 3 == 0, "other").otherwise("same").alias("stripped_sha256"), F.when(key % 7 == 0, "all").otherwise("stripped-only").alias("input"))
    builds = supplier.where("s_suppkey % 4 <> 0").select(key.cast("string").alias("graph_id"), F.lit("same").alias("stripped_sha256"))
    return _violations(checks.violations_probe(docs, labels, builds))


@query("""SELECT 'extent repeats' AS rule, CAST(o_custkey AS STRING) AS key FROM orders GROUP BY o_custkey HAVING count(*) > 1 UNION ALL SELECT 'extent is empty', CAST(o_custkey AS STRING) FROM orders WHERE o_totalprice < 30000""")
def violations_boundaries(spark, sf_dir):
    return _violations(checks.violations_boundaries(table(spark, sf_dir, "orders").select(_graph(), F.col("o_custkey").alias("address"), F.when(F.col("o_totalprice") < 30000, 0).otherwise(5).alias("size"))))


@query(with_views("geo_truth") + """ SELECT 'member repeats' AS rule, member AS key FROM geo_truth WHERE member LIKE 'S%' UNION ALL SELECT 'owner is blank', member FROM geo_truth WHERE member LIKE 'C%' UNION ALL SELECT 'member without symbols', member FROM geo_truth WHERE member LIKE '%3'
    UNION ALL SELECT 'symbols without member', concat(member, 'x') FROM geo_truth WHERE member LIKE '%4'""")
def violations_catalog(spark, sf_dir):
    rows, member = view(spark, sf_dir, "geo_truth"), F.col("member")
    owned = rows.withColumn("owner", F.when(member.startswith("S"), "std"))
    named = rows.where(~member.endswith("3")).select("graph_id", "member").union(rows.where(member.endswith("4")).select("graph_id", F.concat(member, F.lit("x"))))
    return _violations(checks.violations_catalog(owned.unionByName(owned.where("owner = 'std'"))).where("not (rule = 'owner is blank' and key like 'S%')").unionByName(checks.violations_truth(rows, named)))
