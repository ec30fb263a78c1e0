"""Queries of readers, writers and their operators: documents made of whole tables, read back by the library's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.functions.scalars import to_hex
from weftgraph.operators import audit, truth
from weftgraph.plans.queries import query
from weftgraph.schemas import STAGES
from weftgraph.session import table
from weftgraph.sources import binaries, documents, sinks
from weftgraph.sources.bridges import view, with_views


def _document(rows: DataFrame, schema: str) -> DataFrame:
    """Documents (graph_id, json) as the reader has them."""
    return rows.select("graph_id", F.from_json("json", schema).alias("d")).select("graph_id", "d.*")


#: Keys that a document spans at most: a nation with more has several, so none grows with the tables.
SPAN = 4096


def _part(key: str):
    return F.floor(F.col(key) / SPAN)


def _list(rows: DataFrame, key: str, item, order: str, span: str | None = None) -> DataFrame:
    """(k, part, o, j): items as JSON texts, the document of each, and their order in it; documents span keys of the order, or of another column."""
    return rows.select(F.col(key).cast("int").alias("k"), _part(span or order).alias("part"), F.col(order).cast("string").alias("o"), F.to_json(item, {"ignoreNullFields": "false"}).alias("j"))


def _nations(spark, sf_dir, **lists: DataFrame) -> DataFrame:
    """(graph_id, json): documents of a nation, each with a span of the lists' items; a nation without items has one with empty lists."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    rows = nation.select("k", F.lit(0).cast("bigint").alias("part"), F.lit(None).cast("string").alias("o"), F.lit(None).cast("string").alias("j"), F.lit(None).cast("string").alias("name"))
    for name, df in lists.items():
        rows = rows.unionByName(df.join(nation, "k", "left_semi").withColumn("name", F.lit(name)))
    docs = rows.groupBy("k", "part").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == n, F.struct("o", "j")))), lambda x: x["j"]), ",").alias(n) for n in lists])
    parts = [F.concat(F.lit(f'"{n}":['), n, F.lit("]")) for n in lists]
    return docs.select(F.col("k").cast("string").alias("graph_id"), F.concat(F.lit('{"schema_version":6,'), F.concat_ws(",", *parts), F.lit("}")).alias("json"))


def _graphs(spark, sf_dir) -> dict[str, DataFrame]:
    """A nation's customers as nodes, each calling the suppliers of its key's remainder class.

    Customers of one class and span are a document, for they have the same calls: these are joined to documents, and only
    rows of the tables are shuffled, no calls of customers. No side is for the driver to broadcast.
    """
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    calls = supplier.groupBy((F.col("s_suppkey") % 50).alias("class"), F.col("s_nationkey").alias("c_nationkey")).agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("target"), (F.col("s_suppkey") % 3 + 1).alias("count")))).alias("calls"))
    known = customer.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    rows = known.groupBy("c_nationkey", (F.col("c_custkey") % 50).alias("class"), F.floor(F.col("c_custkey") / (50 * SPAN))).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal"))).alias("customers"))
    none = F.array().cast("array<struct<target:string,count:bigint>>")
    rows = rows.join(calls.hint("merge"), ["c_nationkey", "class"], "left").withColumn("calls", F.coalesce("calls", none))

    def node(c):
        anchor = c["c_acctbal"] < 0
        return F.struct(
            F.concat(F.lit("C"), c["c_custkey"].cast("string")).alias("id"), F.when(anchor, "anchor").otherwise("user").alias("type"), (~anchor).alias("scored"), F.when(anchor, "context").alias("anchor_kind"), F.when(anchor, F.concat(F.lit("ADDR:"), c["c_name"])).alias("color_class"),
            F.struct(F.size("calls").alias("resolved_out_calls"), F.lit(0).alias("unresolved_indirect_out_callsites"), F.lit(None).cast("bigint").alias("address_taken_references"), F.lit(1).alias("resolved_in_callers")).alias("observability"),
            F.col("calls").alias("calls"),
        )

    nodes = F.to_json(F.transform("customers", node), {"ignoreNullFields": "false"})
    nodes = rows.select(F.col("c_nationkey").cast("string").alias("graph_id"), F.concat(F.lit('{"schema_version":6,"nodes":'), nodes, F.lit(',"abstentions":[]}')).alias("json"))
    gone = supplier.where("s_acctbal < 0").select("s_nationkey", "s_suppkey", F.struct(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("abstain").alias("status"), F.col("s_name").alias("reason")).alias("item"))
    docs = nodes.unionByName(_nations(spark, sf_dir, abstentions=_list(gone, "s_nationkey", F.col("item"), "s_suppkey")))
    return documents.graphs(_document(docs, documents.FIXTURE))


_CALLS = "WITH e AS (SELECT c_nationkey AS g, c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_custkey % 50 = s_suppkey % 50 AND c_nationkey = s_nationkey)"


@query(_CALLS + """ SELECT CAST(c_nationkey AS STRING) AS graph_id, concat('C', CAST(c_custkey AS STRING)) AS id, CASE WHEN c_acctbal < 0 THEN 'anchor' ELSE 'user' END AS type, c_acctbal >= 0 AS scored, CASE WHEN c_acctbal < 0 THEN concat('ADDR:', c_name) END AS color_class,
    (SELECT count(*) FROM e WHERE c = c_custkey) AS resolved_out_calls FROM customer""")
def document_nodes(spark, sf_dir):
    return _graphs(spark, sf_dir)["nodes"].select("graph_id", "id", "type", "scored", "color_class", "resolved_out_calls")


@query(_CALLS + " SELECT CAST(g AS STRING) AS graph_id, concat('C', CAST(c AS STRING)) AS src, concat('S', CAST(s AS STRING)) AS dst, s % 3 + 1 AS count FROM e")
def document_edges(spark, sf_dir):
    return _graphs(spark, sf_dir)["edges"]


@query("SELECT CAST(s_nationkey AS STRING) AS graph_id, concat('S', CAST(s_suppkey AS STRING)) AS id, s_name AS reason FROM supplier WHERE s_acctbal < 0")
def document_abstentions(spark, sf_dir):
    return _graphs(spark, sf_dir)["abstentions"].select("graph_id", "id", "reason")


@query("""SELECT CAST(c_nationkey AS STRING) AS graph_id, c_mktsegment AS origin, c_name AS member FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)""")
def document_truths(spark, sf_dir):
    """Segments as origins, once in each document that has customers of them; customers without a name are members, too."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("c_name"))), lambda x: x["c_name"])
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment", _part("c_custkey").alias("part")).agg(names.alias("members"), F.min("c_custkey").alias("c_custkey"))
    docs = _nations(spark, sf_dir, origins=_list(rows, "c_nationkey", F.struct(F.col("c_mktsegment").alias("origin"), "members"), "c_mktsegment", "c_custkey"))
    return documents.truths(_document(docs, documents.TRUTH))["truth"]


@query("""SELECT CAST(s_nationkey AS STRING) AS graph_id, s_suppkey + 4096 AS address, s_suppkey % 7 AS size FROM supplier""")
def document_selections(spark, sf_dir):
    """Extents whose addresses are candidates, too."""
    supplier = table(spark, sf_dir, "supplier").withColumn("hex", to_hex(F.col("s_suppkey") + 4096))
    docs = _nations(
        spark, sf_dir, addresses=_list(supplier.withColumn("hex", F.struct("hex")), "s_nationkey", F.col("hex"), "s_suppkey"),
        function_bounds=_list(supplier, "s_nationkey", F.struct(F.col("hex").alias("address"), (F.col("s_suppkey") % 7).alias("size")), "s_suppkey"),
    )
    docs = docs.withColumn("json", F.regexp_replace("json", r'\{"hex":("[^"]*")\}', "$1"))
    found = documents.selections(_document(docs, documents.SELECTION))
    return found["bounds"].join(found["candidates"], ["graph_id", "address"], "left_semi")


@query("""SELECT CAST(c_nationkey AS STRING) AS graph_id, o_custkey AS source, o_orderkey AS callsite, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_custkey + 1 END AS target, o_orderstatus AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 0 END AS candidates
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def document_transfers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    item = F.struct(
        to_hex(F.col("o_custkey")).alias("source"), to_hex(F.col("o_orderkey")).alias("callsite"), F.lit("call").alias("kind"), F.col("o_orderstatus").alias("status"), F.when(~urgent, to_hex(F.col("o_custkey") + 1)).alias("target"),
        F.when(urgent, F.array(to_hex(F.col("o_custkey")), to_hex(F.col("o_orderkey")))).otherwise(F.array().cast("array<string>")).alias("angr_targets"),
    )
    found = documents.evidence(_document(_nations(spark, sf_dir, transfers=_list(rows, "c_nationkey", item, "o_orderkey")), documents.RAW))["transfers"]
    return found.select("graph_id", "source", "callsite", "target", "status", F.size("indirect_targets").cast("bigint").alias("candidates"))


_LABELS = """WITH l AS (SELECT CAST(s_nationkey AS STRING) AS graph_id, ps AS address, s_name AS name, ['direct-flirt', 'propagated-wrapper', 'cleanup-heuristic'][s_suppkey % 3 + 1] AS evidence, s_suppkey % 4 <> 0 AS matched FROM (SELECT *, s_suppkey * 16 AS ps FROM supplier))"""


def _labels(spark, sf_dir) -> DataFrame:
    """Suppliers as labels: of three stages, and every fourth without a function."""
    key = F.col("s_suppkey")
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (key % 3 + 1).cast("int"))
    item = F.struct(to_hex(key * 16).alias("address"), to_hex(key * 16 + 4096).alias("mapped_address"), F.col("s_name").alias("name"), F.lit("o").alias("canonical_origin"), F.lit("std").alias("owner"), stage.alias("evidence"))
    rows, unmatched = table(spark, sf_dir, "supplier"), key % 4 == 0
    lists = {"matches": ~unmatched & (key % 3 == 0), "propagated_wrappers": ~unmatched & (key % 3 == 1), "cleanup_heuristics": ~unmatched & (key % 3 == 2), "unmatched_addresses": unmatched}
    docs = _nations(spark, sf_dir, **{name: _list(rows.where(test), "s_nationkey", item, "s_suppkey") for name, test in lists.items()})
    return documents.label_rows(_document(docs, documents.LABELS))


@query(_LABELS + " SELECT graph_id, address, name, evidence, matched FROM l")
def document_labels(spark, sf_dir):
    return _labels(spark, sf_dir).select("graph_id", "address", "name", "evidence", "matched")


@query(_LABELS + " SELECT evidence, count(*) AS n, min(address) AS first FROM l GROUP BY evidence")
def probe_stages(spark, sf_dir):
    """The probe's relations again, each stage by itself."""
    stages = audit.probe_stages(_labels(spark, sf_dir))
    parts = [df.agg(F.count("*").alias("n"), F.min("address").alias("first")).select(F.lit(name).alias("evidence"), "n", "first") for name, df in stages.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(with_views("bracket_names") + """ SELECT p_partkey, brand AS owner FROM bracket_names""")
def renormalised(spark, sf_dir):
    """Owners derived again from names, whatever the labels said."""
    rows = view(spark, sf_dir, "bracket_names").select("p_partkey", "name", F.lit("wrong").alias("owner"), F.lit("wrong").alias("canonical_origin"))
    return documents.renormalised(rows).where("canonical_origin <> 'wrong'").select("p_partkey", "owner")


@query(with_views("symbols") + """, b AS (SELECT address, min(size) AS size, max(size) AS largest FROM symbols GROUP BY address) SELECT address, CASE WHEN size = largest THEN 'extent' ELSE 'conflicting sizes' END AS rule, CASE WHEN size = largest THEN size END AS size FROM b""")
def every_extent(spark, sf_dir):
    """Extents of all owned symbols, and the addresses that have several sizes."""
    good, bad = truth.bounds(view(spark, sf_dir, "symbols"), every=True)
    return good.select("address", F.lit("extent").alias("rule"), "size").unionByName(bad.select("address", "rule", F.lit(None).cast("bigint").alias("size")))


@query(with_views("geo_truth") + " SELECT origin, member FROM geo_truth")
def origin_by_member(spark, sf_dir):
    rows = view(spark, sf_dir, "geo_truth").groupBy("origin").agg(F.array_sort(F.collect_list("member")).alias("members"))
    return truth.origin_by_member(rows).select("origin", "member")


@query("""WITH e AS (SELECT concat('f', CAST(l_suppkey % 5 AS STRING)) AS path, 1 + l_linenumber % 2 AS section, l_partkey AS symbol, [1, 6, 7, 8, 37][CAST(l_quantity AS BIGINT) % 5 + 1] AS kind, l_orderkey * 8 + l_linenumber AS slot, CAST(l_suppkey - 50 AS BIGINT) AS addend FROM lineitem)
    SELECT path, slot, addend AS target FROM e WHERE kind = 8 UNION ALL SELECT path, slot, p_partkey * 4096 + section + CAST(substr(path, 2) AS BIGINT) * 7 + addend FROM e JOIN part ON symbol = p_partkey WHERE kind IN (1, 6, 7) AND p_size < 40""")
def linked_targets(spark, sf_dir):
    """Lines as relocation entries, parts as the symbols that five files define in two tables each."""
    kinds = F.element_at(F.array(*map(F.lit, (1, 6, 7, 8, 37))), (F.col("l_quantity").cast("bigint") % 5 + 1).cast("int"))
    number = lambda c: c.cast("bigint")
    entries = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), (F.col("l_suppkey") % 5).cast("string")).alias("path"), F.lit(False).alias("is_symbol"), (1 + F.col("l_linenumber") % 2).cast("int").alias("section"), number(F.col("l_partkey")).alias("symbol"), number(kinds).alias("kind"),
        number(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("slot"), number(F.col("l_suppkey") - 50).alias("value"),
    )
    files = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(s).alias("s")) for f in range(5) for s in (1, 2)]))
    symbols = table(spark, sf_dir, "part").where("p_size < 40").select("p_partkey", files.alias("x")).select(
        F.concat(F.lit("f"), F.col("x.f").cast("string")).alias("path"), F.lit(True).alias("is_symbol"), F.col("x.s").alias("section"), number(F.col("p_partkey")).alias("symbol"), number(F.lit(0)).alias("kind"), number(F.lit(0)).alias("slot"),
        number(F.col("p_partkey") * 4096 + F.col("x.s") + F.col("x.f") * 7).alias("value"),
    )
    return binaries.linked_targets(entries.unionByName(symbols))


@query(r"""WITH f AS (SELECT c_nationkey AS k, string_agg(concat(chr(10), '    {', chr(10), '      "address": ', CAST(c_custkey AS STRING), ',', chr(10), '      "name": "', c_name, '"', chr(10), '    }'), ',' ORDER BY c_custkey) AS t FROM customer GROUP BY c_nationkey),
    t AS (SELECT s_nationkey AS k, string_agg(concat(chr(10), '    {', chr(10), '      "targets": [', chr(10), '        ', CAST(s_suppkey AS STRING), ',', chr(10), '        null', chr(10), '      ]', chr(10), '    }'), ',' ORDER BY s_suppkey DESC) AS t FROM supplier WHERE s_acctbal > 8000 GROUP BY s_nationkey),
    d AS (SELECT CAST(n_nationkey AS STRING) AS graph_id, concat('{', chr(10), '  "case": "', n_name, '",', chr(10), '  "functions": [', coalesce(f.t || chr(10) || '  ', ''), '],', chr(10), '  "transfers": [', coalesce(t.t || chr(10) || '  ', ''), ']', chr(10), '}', chr(10)) AS text
        FROM nation LEFT JOIN f ON f.k = n_nationkey LEFT JOIN t ON t.k = n_nationkey)
    SELECT graph_id, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS bytes FROM d""")
def stable_digests(spark, sf_dir):
    """Nations as documents: customers as functions, rich suppliers as transfers in falling order; some have none."""
    nation, customer, supplier = (table(spark, sf_dir, n) for n in ("nation", "customer", "supplier"))
    graph = lambda c: F.col(c).cast("string").alias("graph_id")
    none = nation.select(graph("n_nationkey"), F.lit(None).cast("bigint").alias("place"), F.lit(None).cast("string").alias("json"))
    functions = customer.select(graph("c_nationkey"), F.col("c_custkey").cast("bigint").alias("place"), F.to_json(F.struct(F.col("c_custkey").alias("address"), F.col("c_name").alias("name"))).alias("json"))
    transfers = supplier.where("s_acctbal > 8000").select(graph("s_nationkey"), (-F.col("s_suppkey")).cast("bigint").alias("place"), F.format_string('{"targets":[%d,null]}', F.col("s_suppkey").cast("bigint")).alias("json"))
    case = nation.select(graph("n_nationkey"), F.to_json(F.array("n_name")).alias("json")).withColumn("json", F.expr("substring(json, 2, length(json) - 2)"))
    return sinks.stable_digests({"case": case, "functions": functions.unionByName(none), "transfers": transfers.unionByName(none)})
