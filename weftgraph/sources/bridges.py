"""Graphs, evidence, symbols and labels derived from the star-schema tables, as SQL that Spark and DuckDB both read.

Each view is one SELECT over ``{table}`` names or other views; ``view`` runs it, and the oracle uses the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from weftgraph.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

VIEWS = {
    # Geography: customers and suppliers point to nations, nations to regions.
    "geo_nodes": """SELECT 'geo' AS graph_id, concat('C', CAST(c_custkey AS STRING)) AS id, 'user' AS type, TRUE AS scored, CAST(NULL AS STRING) AS color_class FROM {customer}
        UNION ALL SELECT 'geo', concat('S', CAST(s_suppkey AS STRING)), 'user', TRUE, CAST(NULL AS STRING) FROM {supplier}
        UNION ALL SELECT 'geo', concat('N', CAST(n_nationkey AS STRING)), 'anchor', FALSE, 'ROLE:context' FROM {nation}
        UNION ALL SELECT 'geo', concat('R', CAST(r_regionkey AS STRING)), 'anchor', FALSE, 'ROLE:root' FROM {region}""",
    "geo_edges": """SELECT 'geo' AS graph_id, concat('C', CAST(c_custkey AS STRING)) AS src, concat('N', CAST(c_nationkey AS STRING)) AS dst, CAST(length(c_mktsegment) AS BIGINT) AS count FROM {customer}
        UNION ALL SELECT 'geo', concat('S', CAST(s_suppkey AS STRING)), concat('N', CAST(s_nationkey AS STRING)), CAST(1 AS BIGINT) FROM {supplier}
        UNION ALL SELECT 'geo', concat('N', CAST(n_nationkey AS STRING)), concat('R', CAST(n_regionkey AS STRING)), CAST(1 AS BIGINT) FROM {nation}""",
    "geo_truth": """SELECT 'geo' AS graph_id, concat('region:', CAST(n_regionkey AS STRING)) AS origin, concat('C', CAST(c_custkey AS STRING)) AS member FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        UNION ALL SELECT 'geo', concat('region:', CAST(n_regionkey AS STRING)), concat('S', CAST(s_suppkey AS STRING)) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    # Trade: customers call suppliers, weighted by lines.
    "trade_edges": """SELECT 'trade' AS graph_id, concat('C', CAST(o_custkey AS STRING)) AS src, concat('S', CAST(l_suppkey AS STRING)) AS dst, count(*) AS count
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey""",
    "trade_nodes": """SELECT 'trade' AS graph_id, concat('C', CAST(c_custkey AS STRING)) AS id, 'user' AS type, TRUE AS scored, CAST(NULL AS STRING) AS color_class FROM {customer}
        UNION ALL SELECT 'trade', concat('S', CAST(s_suppkey AS STRING)), 'anchor', FALSE, concat('ROLE:', CAST(s_nationkey AS STRING)) FROM {supplier}""",
    # Clicks: a user's event types, joined by consecutive events; a type twice in a row is a self edge.
    "click_steps": """SELECT concat(CAST(user_id AS STRING), ':', event_type) AS src, concat(CAST(user_id AS STRING), ':', lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS dst,
        lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM {events}""",
    "click_edges": "SELECT 'click' AS graph_id, src, dst, count(*) AS count FROM {click_steps} WHERE following IS NOT NULL GROUP BY src, dst",
    "click_nodes": "SELECT DISTINCT 'click' AS graph_id, concat(CAST(user_id AS STRING), ':', event_type) AS id, 'user' AS type, TRUE AS scored, CAST(NULL AS STRING) AS color_class FROM {events}",
    # Flow: lines as callsites of customers; suppliers call nations, nations call regions.
    "flow_functions": """SELECT 'flow' AS graph_id, c_custkey AS address, c_name AS name, CAST(1 AS BIGINT) AS size, 'symbol-oracle' AS boundary_source, c_acctbal > 0 AS discovered FROM {customer}
        UNION ALL SELECT 'flow', 1000000 + s_suppkey, s_name, CAST(1 AS BIGINT), 'radare2', s_acctbal > 2000 FROM {supplier}
        UNION ALL SELECT 'flow', CAST(2000000 + n_nationkey AS BIGINT), n_name, CAST(1 AS BIGINT), 'radare2', TRUE FROM {nation}
        UNION ALL SELECT 'flow', CAST(3000000 + r_regionkey AS BIGINT), r_name, CAST(1 AS BIGINT), 'radare2', r_regionkey > 1 FROM {region}""",
    "flow_candidates": "SELECT 'flow' AS graph_id, 1000000 + s_suppkey AS address FROM {supplier}",
    "flow_roots": "SELECT 'flow' AS graph_id, CAST(2000000 + n_nationkey AS BIGINT) AS address FROM {nation} WHERE n_nationkey = 0",
    "flow_lines": """SELECT o_custkey AS source, l_orderkey * 8 + l_linenumber AS callsite, 1000000 + l_suppkey AS supplier, 5000000 + l_partkey AS part, l_quantity, l_discount,
        CASE WHEN l_returnflag = 'A' THEN 'unresolved' WHEN l_tax >= 0.08 THEN 'unmapped' WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 'filtered' ELSE 'resolved' END AS status,
        CASE WHEN l_linestatus = 'O' THEN 'memory' ELSE 'register' END AS operand FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "flow_transfers": """SELECT 'flow' AS graph_id, source, callsite, 'call' AS kind, CASE WHEN status = 'resolved' AND operand = 'register' THEN 'immediate' ELSE operand END AS operand_kind, status,
        CASE status WHEN 'unresolved' THEN CAST(NULL AS BIGINT) WHEN 'unmapped' THEN part ELSE supplier END AS target,
        CASE WHEN status = 'unresolved' THEN CAST(NULL AS STRING) WHEN status = 'resolved' AND operand = 'register' THEN 'direct-immediate' ELSE 'elf-relocation' END AS resolver,
        CASE WHEN status = 'unresolved' THEN 'unknown' ELSE 'exact' END AS confidence, CASE WHEN status = 'filtered' THEN 'import' END AS filter_reason, CASE WHEN status = 'unresolved' THEN 'not_run' ELSE 'not_applicable' END AS indirect_status FROM {flow_lines}
        UNION ALL SELECT 'flow', 1000000 + s_suppkey, 9000000000 + s_suppkey, 'call', CASE WHEN s_acctbal >= 0 THEN 'immediate' ELSE 'register' END, CASE WHEN s_acctbal >= 0 THEN 'resolved' ELSE 'unresolved' END,
        CASE WHEN s_acctbal >= 0 THEN CAST(2000000 + s_nationkey AS BIGINT) END, CASE WHEN s_acctbal >= 0 THEN 'direct-immediate' END, CASE WHEN s_acctbal >= 0 THEN 'exact' ELSE 'unknown' END, CAST(NULL AS STRING), CASE WHEN s_acctbal >= 0 THEN 'not_applicable' ELSE 'not_run' END FROM {supplier}
        UNION ALL SELECT 'flow', CAST(2000000 + n_nationkey AS BIGINT), CAST(9100000000 + n_nationkey AS BIGINT), 'tail-call', 'immediate', 'resolved', CAST(3000000 + n_regionkey AS BIGINT), 'direct-tail', 'exact', CAST(NULL AS STRING), 'not_applicable' FROM {nation}""",
    "flow_found": """SELECT source, callsite, supplier AS target, l_discount >= 0.1 AS ambiguous FROM {flow_lines} WHERE status = 'unresolved' AND l_quantity > 5
        UNION ALL SELECT source, callsite, part, FALSE FROM {flow_lines} WHERE status = 'unresolved' AND l_quantity > 40""",
    # Sites: parts as callsites that several customers may share; lines as control-flow edges and as jump tables of up to two targets.
    "cfg_sites": """SELECT 'cfg' AS graph_id, o_custkey AS source, l_partkey * 8 + l_linenumber AS callsite, CASE WHEN min(l_linestatus) = 'O' THEN 'call' ELSE 'tail-call' END AS kind
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_tax < 0.02 GROUP BY o_custkey, l_partkey, l_linenumber""",
    "cfg_edges": """SELECT 'cfg' AS graph_id, l_partkey * 8 + l_linenumber AS callsite, CASE l_returnflag WHEN 'R' THEN 'Ijk_Call' WHEN 'N' THEN 'Ijk_Boring' ELSE 'Ijk_Ret' END AS jump_kind,
        CASE WHEN l_quantity < 48 THEN l_suppkey END AS target FROM {lineitem} WHERE l_discount > 0.08""",
    "cfg_jumps": """SELECT 'cfg' AS graph_id, l_partkey * 8 + l_linenumber AS callsite, CASE WHEN l_linestatus = 'O' THEN 'Ijk_Call' ELSE 'Ijk_Boring' END AS jump_kind,
        l_suppkey + 1 AS one, CASE WHEN l_quantity > 25 THEN l_suppkey + 100000 END AS two, l_quantity < 10 AS bare FROM {lineitem} WHERE l_discount < 0.02""",
    # Symbols: parts as compiled functions; a rounded price is the address, so some addresses are shared.
    "symbols": """SELECT CAST(floor(p_retailprice * 4) AS BIGINT) AS address, CAST(p_size AS BIGINT) AS size, 't' AS kind,
        concat(CASE WHEN p_size < 5 THEN 'core' WHEN p_size < 8 THEN 'std' ELSE replace(lower(p_brand), '#', '_') END, '::', replace(lower(p_type), ' ', '_'), '::make::<u', CAST(p_size AS STRING), '>') AS name, p_partkey FROM {part}""",
    # Code: orders as functions of 64 bytes, lines as instructions; parts as relocation slots.
    "code_functions": "SELECT 'code' AS graph_id, o_orderkey * 64 AS address, CAST(64 AS BIGINT) AS size, 'symbol-oracle' AS boundary_source, o_orderpriority = '5-LOW' AS is_import FROM {orders}",
    "code_ops": """SELECT 'code' AS graph_id, l_orderkey * 64 AS source, l_orderkey * 64 + l_linenumber * 8 AS callsite, CAST(CASE WHEN l_linenumber = 3 THEN 4 ELSE 8 END AS BIGINT) AS length,
        CASE WHEN l_quantity > 45 THEN 'nop' WHEN l_linestatus = 'O' THEN 'call' WHEN l_returnflag = 'A' THEN 'jmp' ELSE 'mov' END AS mnemonic, 'x' AS text,
        CASE WHEN l_partkey % 5 < 2 THEN 'memory' WHEN l_partkey % 5 < 4 THEN 'register' ELSE 'unknown' END AS operand, l_quantity <= 45 AND l_linestatus = 'O' AS is_call, l_quantity <= 45 AND l_linestatus <> 'O' AND l_returnflag = 'A' AS is_jump,
        CASE WHEN l_quantity <= 20 THEN CASE WHEN l_discount < 0.05 THEN l_suppkey * 64 ELSE l_partkey * 64 + 8 END END AS imm_target, CASE WHEN l_quantity > 20 AND l_quantity <= 35 THEN l_partkey END AS slot FROM {lineitem}""",
    "code_slots": "SELECT 'code' AS graph_id, p_partkey AS slot, p_partkey * 64 + CASE WHEN p_size < 10 THEN 8 ELSE 0 END AS slot_target FROM {part} WHERE p_size < 40",
    # Names with brackets in brackets.
    "bracket_names": """SELECT p_partkey, replace(lower(p_brand), '#', '_') AS brand, CASE p_partkey % 4 WHEN 0 THEN concat('<', replace(lower(p_brand), '#', '_'), '::T as core::fmt::Debug>::fmt') WHEN 1 THEN concat(replace(lower(p_brand), '#', '_'), '::f::<Vec<u8>, B<C>>::g::<D>')
        WHEN 2 THEN concat(replace(lower(p_brand), '#', '_'), '::_::<impl serde::De for ', replace(lower(p_brand), '#', '_'), '::X>::de') ELSE concat(replace(lower(p_brand), '#', '_'), '::<impl Foo>::g::h0123456789abcdef') END AS name FROM {part}""",
    # Labels: quality as the label, toxicity as the truth.
    "label_rows": "SELECT doc_id AS address, CASE WHEN quality = 1 THEN 'std' ELSE lower(source) END AS owner, lang AS canonical_origin FROM {labels} JOIN {documents} USING (doc_id)",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bridge view; the views and tables that it names are bound as DataFrames."""
    text = VIEWS[name]
    needs = {n: (view if n in VIEWS else table)(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **needs)


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause that defines the views for DuckDB, each after those that it uses."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in re.findall(r"\{(\w+)\}", VIEWS[n]):
            if m in VIEWS:
                add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in order)
