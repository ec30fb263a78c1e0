"""DuckDB SQL by other methods than the queries': unrolled rounds, recursive CTEs, quadratic pair joins."""

from __future__ import annotations

from weftgraph.sources.bridges import with_views

_SEED = """CASE WHEN n.type = 'anchor' THEN concat('ANCHOR:', coalesce(n.color_class, n.id)) ELSE concat('USER:self=', CAST(coalesce(l.c, 0) AS STRING), ':{0}=', CAST(coalesce(d.c, 0) AS STRING)) END"""


def _seeded(graph: str, mode: str, color: str = "color_class") -> str:
    side, far, word = ("dst", "src", "in") if mode == "in" else ("src", "dst", "out")
    return with_views(f"{graph}_nodes", f"{graph}_edges") + f""", nodes AS (SELECT id, type, scored, {color} AS color_class FROM {graph}_nodes),
    e AS (SELECT * FROM {graph}_edges WHERE src <> dst), deg AS (SELECT src, count(DISTINCT dst) AS c FROM e GROUP BY src),
    seeded AS (SELECT n.id, n.scored, {_SEED.format(word)} AS seed, coalesce(o.c, 0) = 0 AS no_callee FROM nodes n
        LEFT JOIN (SELECT src, CAST(sum(count) AS BIGINT) AS c FROM {graph}_edges WHERE src = dst GROUP BY src) l ON l.src = n.id
        LEFT JOIN (SELECT {side} AS k, count(DISTINCT {far}) AS c FROM e GROUP BY 1) d ON d.k = n.id LEFT JOIN deg o ON o.src = n.id)"""


def seed_classes(graph: str, mode: str) -> str:
    return _seeded(graph, mode) + " SELECT md5(seed) AS color, count(*) AS n, min(id) AS first FROM seeded GROUP BY seed"


def multiset(graph: str, here: str, there: str) -> str:
    return _seeded(graph, "full") + f" SELECT e.{here} AS id, md5(s.seed) AS color, CAST(sum(e.count) AS BIGINT) AS weight FROM e JOIN seeded s ON s.id = e.{there} GROUP BY 1, 2"


def refined(graph: str, mode: str, rounds: int, color: str = "color_class", prefix: str = "") -> str:
    """Unrolled rounds on whole multisets; a class is named by its smallest id. Ends in CTEs ``last`` and ``trace``."""
    out = _seeded(graph, mode, color) + ", r0 AS (SELECT id, scored, no_callee, min(id) OVER (PARTITION BY seed) AS c FROM seeded)"
    for r in range(1, rounds + 1):
        sets = []
        for name, here, there in (("o", "src", "dst"), ("i", "dst", "src")):
            out += f", {name}{r} AS (SELECT id, list((c, w) ORDER BY c) AS ms FROM (SELECT e.{here} AS id, p.c, sum(e.count) AS w FROM e JOIN r{r - 1} p ON p.id = e.{there} GROUP BY 1, 2) GROUP BY id)"
            sets.append(f"coalesce({name}{r}.ms, [])")
        part = {"full": sets, "out": sets[:1], "in": sets[1:], "out-in": [sets[0], f"CASE WHEN p.no_callee THEN {sets[1]} ELSE [] END"]}[mode]
        out += f", r{r} AS (SELECT p.id, p.scored, p.no_callee, min(p.id) OVER (PARTITION BY p.c, {', '.join(part)}) AS c FROM r{r - 1} p LEFT JOIN o{r} ON o{r}.id = p.id LEFT JOIN i{r} ON i{r}.id = p.id)"
    counts = " UNION ALL ".join(f"SELECT CAST({r} AS BIGINT) AS round, count(DISTINCT c) AS classes, count(DISTINCT c) FILTER (scored) AS scored_classes FROM r{r}" for r in range(rounds + 1))
    return out + f", last AS (SELECT * FROM r{rounds}), counted AS ({counts}), trace AS (SELECT *, CASE WHEN round = 0 THEN 'seed' WHEN classes = lag(classes) OVER (ORDER BY round) THEN 'fixpoint' ELSE 'changed' END AS state FROM counted)"


def rounds(graph: str, most: int) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({refined(graph, m, most)} SELECT '{m}' AS mode, min(round) AS rounds FROM trace WHERE state = 'fixpoint')" for m in ("full", "out", "in", "out-in"))


def _members(mode: str = "full") -> str:
    from weftgraph.sources.bridges import VIEWS

    return refined("geo", mode, 6) + f", truth AS ({VIEWS['geo_truth'].replace('{', '').replace('}', '')}), m AS (SELECT id, c, origin FROM last JOIN truth ON member = id WHERE scored)"


def pair_counts(mode: str = "full") -> str:
    """Every unordered pair, one by one."""
    return _members(mode) + """, pairs AS (SELECT count(*) FILTER (a.c = b.c AND a.origin = b.origin) AS tp, count(*) FILTER (a.c = b.c AND a.origin <> b.origin) AS fp,
        count(*) FILTER (a.c <> b.c AND a.origin = b.origin) AS fn, count(*) FILTER (a.c <> b.c AND a.origin <> b.origin) AS tn FROM m a JOIN m b ON a.id < b.id)"""


METRICS = """, x AS (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn FROM pairs), y AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r, (tp + fp) * (tp + fn) / (tp + fp + fn + tn) AS e FROM x)
    SELECT p AS precision, r AS recall, 2 * p * r / (p + r) AS f1, (tp - e) / (0.5 * ((tp + fp) + (tp + fn)) - e) AS ari FROM y"""

MEMBERS = _members()
_ORIGIN_ROWS = MEMBERS + """, z AS (SELECT a.origin, count(*) FILTER (a.c = b.c) AS recovered, count(*) AS pairs FROM m a JOIN m b ON a.id < b.id AND a.origin = b.origin GROUP BY a.origin),
    clash AS (SELECT a.origin, string_agg(DISTINCT b.origin, ',' ORDER BY b.origin) AS colliding FROM m a JOIN m b ON a.c = b.c AND a.origin <> b.origin GROUP BY a.origin),
    rows AS (SELECT s.origin, s.n AS instances, s.n AS scored, CAST(0 AS BIGINT) AS abstained, s.clusters, coalesce(z.recovered, 0) AS recovered_pairs, coalesce(z.pairs, 0) AS total_pairs, coalesce(z.pairs, 0) AS target_pairs,
        CASE WHEN z.pairs > 0 THEN CAST(1.0 AS DOUBLE) END AS scored_pair_coverage, CASE WHEN z.pairs > 0 THEN z.recovered / z.pairs END AS effective_recall, coalesce(clash.colliding, '') AS colliding
        FROM (SELECT origin, count(*) AS n, count(DISTINCT c) AS clusters FROM m GROUP BY origin) s LEFT JOIN z USING (origin) LEFT JOIN clash USING (origin))"""
ORIGINS = _ORIGIN_ROWS + " SELECT * FROM rows"
FAMILIES = _ORIGIN_ROWS + """ SELECT count(*) AS evidence_full, CAST(0 AS BIGINT) AS evidence_partial, CAST(0 AS BIGINT) AS evidence_insufficient, count(*) FILTER (recovered_pairs = total_pairs) AS recovery_complete,
    count(*) FILTER (recovered_pairs > 0 AND recovered_pairs < total_pairs) AS recovery_partial, count(*) FILTER (recovered_pairs = 0) AS recovery_missed, CAST(0 AS BIGINT) AS recovery_na, count(*) FILTER (colliding <> '') AS collision FROM rows WHERE target_pairs > 0"""

_ACCEPTED = "(status = 'resolved' AND resolver IN ('direct-immediate', 'direct-tail', 'elf-relocation'{0})) OR (status = 'unmapped' AND resolver = 'elf-relocation' AND confidence = 'exact')"


def _steps(callers: bool, anchors: str, source: str, more: str = "") -> str:
    """The projection's steps over transfers ``source``, as CTEs."""
    seeds = " UNION SELECT DISTINCT source FROM g WHERE target IN (SELECT address FROM cand) AND source NOT IN (SELECT address FROM root)" if callers else ""
    incoming = "SELECT DISTINCT source AS a FROM g WHERE target IN (SELECT a FROM act) AND source NOT IN (SELECT a FROM act) AND source NOT IN (SELECT address FROM root)" if callers else "SELECT source AS a FROM g WHERE FALSE"
    color = "concat('ADDR:', id)" if anchors == "address" else "concat('ROLE:', kind)"
    return f""", g AS (SELECT source, target, count(*) AS count FROM {source} WHERE {_ACCEPTED.format(more)} GROUP BY source, target), cand AS (SELECT address FROM flow_candidates), root AS (SELECT address FROM flow_roots),
    prov AS (SELECT address AS a FROM cand UNION SELECT address FROM root{seeds}), reach1 AS (SELECT a FROM prov UNION SELECT g.target FROM reach1 JOIN g ON g.source = reach1.a),
    act AS (SELECT DISTINCT address AS a FROM cand WHERE address IN (SELECT source FROM g WHERE source <> target AND target IN (SELECT a FROM reach1)) OR address IN (SELECT target FROM g WHERE source <> target AND source IN (SELECT a FROM reach1))),
    gone AS (SELECT address AS a FROM cand WHERE address NOT IN (SELECT a FROM act)), inc AS ({incoming}), outg AS (SELECT DISTINCT target AS a FROM g WHERE source IN (SELECT a FROM act) AND target NOT IN (SELECT a FROM act)),
    start AS (SELECT a FROM act UNION SELECT address FROM root UNION SELECT a FROM inc), reach2 AS (SELECT a FROM start UNION SELECT g.target FROM reach2 JOIN g ON g.source = reach2.a), sel AS (SELECT a FROM reach2 WHERE a NOT IN (SELECT a FROM gone)),
    named AS (SELECT a, printf('FUN_%08x', a + 1048576) AS id, a IN (SELECT a FROM act) AS scored, CASE WHEN a IN (SELECT address FROM root) THEN 'root' WHEN a IN (SELECT a FROM inc) AND a IN (SELECT a FROM outg) THEN 'both'
        WHEN a IN (SELECT a FROM inc) THEN 'incoming' WHEN a IN (SELECT a FROM outg) THEN 'outgoing' ELSE 'context' END AS kind FROM sel),
    pnodes AS (SELECT id, CASE WHEN scored THEN 'user' ELSE 'anchor' END AS type, scored, CASE WHEN NOT scored THEN kind END AS anchor_kind, CASE WHEN NOT scored THEN {color} END AS color_class,
        CAST(coalesce(x.c, 0) AS BIGINT) AS resolved_out_calls, coalesce(u.c, 0) AS unresolved_indirect_out_callsites, coalesce(y.c, 0) AS resolved_in_callers FROM named
        LEFT JOIN (SELECT source, sum(count) AS c FROM g GROUP BY source) x ON x.source = a LEFT JOIN (SELECT target, count(DISTINCT source) AS c FROM g WHERE source <> target GROUP BY target) y ON y.target = a
        LEFT JOIN (SELECT source, count(*) AS c FROM {source} WHERE status = 'unresolved' AND operand_kind IN ('memory', 'register') GROUP BY source) u ON u.source = a),
    pedges AS (SELECT printf('FUN_%08x', source + 1048576) AS src, printf('FUN_%08x', target + 1048576) AS dst, count FROM g WHERE source IN (SELECT a FROM sel) AND target IN (SELECT a FROM sel))"""


def projected(callers: bool, anchors: str) -> str:
    return with_views("flow_transfers", "flow_candidates", "flow_roots", recursive=True) + _steps(callers, anchors, "flow_transfers")


def inferred_projection() -> str:
    return _steps(True, "address", "merged", ", 'angr-cfg'") + PROJECTED_EDGES


PROJECTED_NODES = " SELECT id, type, scored, anchor_kind, color_class, resolved_out_calls, unresolved_indirect_out_callsites, resolved_in_callers FROM pnodes"
PROJECTED_EDGES = " SELECT src, dst, count FROM pedges"
ABSTAINED = " SELECT printf('FUN_%08x', a + 1048576) AS id FROM gone"
OBSERVED = """, hit AS (SELECT printf('FUN_%08x', address + 1048576) AS node FROM root UNION SELECT dst FROM hit JOIN pedges ON src = node),
    c AS (SELECT address, printf('FUN_%08x', address + 1048576) AS id FROM cand), f AS (SELECT id, address IN (SELECT a FROM gone) AS gone, id IN (SELECT node FROM hit) AS hit, address IN (SELECT a FROM gone) OR id NOT IN (SELECT src FROM pedges) AS no_out,
        address IN (SELECT a FROM gone) OR id NOT IN (SELECT dst FROM pedges) AS no_in, address IN (SELECT source FROM flow_transfers WHERE status = 'unresolved' AND operand_kind IN ('memory', 'register')) AS open FROM c)
    SELECT count(*) AS targets, count(*) FILTER (NOT gone) AS grouped, count(*) FILTER (gone) AS abstained, count(*) FILTER (hit) AS reachable, count(*) FILTER (NOT hit) AS unreachable, count(*) FILTER (no_out) AS zero_outgoing,
        count(*) FILTER (no_in) AS zero_incoming, count(*) FILTER (no_out AND no_in) AS isolated, count(*) FILTER (open) AS with_open_callsites FROM f"""
COVERAGE = """, t AS (SELECT 1000000 + s_suppkey AS a, s_nationkey AS o FROM supplier), q AS (SELECT (SELECT count(*) FROM act) AS grouped, (SELECT count(*) FROM gone) AS abstained,
    (SELECT count(*) FROM t x JOIN t y ON x.a < y.a AND x.o = y.o) AS family_pairs, (SELECT count(*) FROM t x JOIN t y ON x.a < y.a AND x.o = y.o WHERE x.a IN (SELECT a FROM act) AND y.a IN (SELECT a FROM act)) AS scored_family_pairs)
    SELECT grouped + abstained AS targets, grouped, abstained, (grouped + abstained) * (grouped + abstained - 1) // 2 AS target_pairs, family_pairs, scored_family_pairs, grouped / (grouped + abstained) AS target_coverage,
        (grouped * (grouped - 1) // 2) / ((grouped + abstained) * (grouped + abstained - 1) // 2) AS pair_decision_coverage FROM q"""
FROZEN = with_views("flow_transfers", "flow_functions", "flow_candidates", "flow_roots", recursive=True) + """, ok AS (SELECT address FROM flow_candidates UNION SELECT address FROM flow_functions WHERE discovered),
    g AS (SELECT source, target, count(*) AS count FROM flow_transfers WHERE status = 'resolved' AND resolver IN ('direct-immediate', 'direct-tail') AND target IN (SELECT address FROM ok) GROUP BY source, target),
    r AS (SELECT address AS a FROM flow_candidates UNION SELECT address FROM flow_roots UNION SELECT g.target FROM r JOIN g ON g.source = r.a)
    SELECT printf('FUN_%08x', source + 1048576) AS src, printf('FUN_%08x', target + 1048576) AS dst, count FROM g WHERE source IN (SELECT a FROM r) AND target IN (SELECT a FROM r)"""


def merged() -> str:
    """Transfers with inferred targets, as CTE ``merged``."""
    return with_views("flow_transfers", "flow_functions", "flow_found", "flow_candidates", "flow_roots", recursive=True) + """, base AS (SELECT DISTINCT source, callsite, kind, status, target, operand_kind, resolver, confidence, filter_reason, indirect_status FROM flow_transfers),
    site AS (SELECT source, callsite, count(DISTINCT target) AS n, min(target) AS sole, bool_or(ambiguous) AS ambiguous FROM flow_found GROUP BY source, callsite),
    fate AS (SELECT b.*, s.n, s.sole, CASE WHEN b.indirect_status <> 'not_run' THEN b.indirect_status WHEN s.ambiguous THEN 'ambiguous_source' WHEN s.n IS NULL THEN 'no_angr_result' WHEN s.n > 1 THEN 'multiple_targets'
        WHEN s.sole IN (SELECT address FROM flow_functions) THEN 'resolved_internal' ELSE 'unknown_target' END AS fate FROM base b LEFT JOIN site s USING (source, callsite)),
    merged AS (SELECT source, callsite, kind, operand_kind, CASE WHEN fate = 'resolved_internal' THEN 'resolved' ELSE status END AS status, CASE WHEN fate = 'resolved_internal' THEN sole ELSE target END AS target,
        CASE WHEN fate = 'resolved_internal' THEN 'angr-cfg' ELSE resolver END AS resolver, CASE WHEN fate = 'resolved_internal' THEN 'inferred' ELSE confidence END AS confidence, fate AS indirect_status,
        CASE WHEN indirect_status = 'not_run' AND fate <> 'ambiguous_source' THEN coalesce(n, 0) ELSE 0 END AS targets FROM fate)"""


_COUNTS = """count(*) AS total, count(*) FILTER (indirect_status = 'resolved_internal') AS resolved_internal, count(*) FILTER (indirect_status = 'resolved_import') AS resolved_import, count(*) FILTER (indirect_status NOT IN ('resolved_internal', 'resolved_import')) AS unresolved"""
_OPEN = "FROM merged WHERE operand_kind IN ('memory', 'register') AND indirect_status <> 'not_applicable'"
SUMMARY = f""", k AS (SELECT {_COUNTS}, {', '.join(f"count(*) FILTER (indirect_status = '{r}') AS {r}" for r in ('unresolvable_target', 'multiple_targets', 'unknown_target', 'ambiguous_source', 'no_angr_result'))} {_OPEN})
    SELECT *, (resolved_internal + resolved_import) / total AS target_rate, resolved_internal / (total - resolved_import) AS internal_rate FROM k"""
BY_OPERAND = f" SELECT operand_kind, {_COUNTS} {_OPEN} GROUP BY operand_kind"
IMPACT = """, t AS (SELECT source, target, source IN (SELECT address FROM flow_candidates) AS o, target IN (SELECT address FROM flow_candidates) AS i FROM merged WHERE indirect_status = 'resolved_internal' AND resolver = 'angr-cfg')
    SELECT count(*) AS callsites, count(DISTINCT (source, target)) AS edges, count(*) FILTER (o) AS outgoing_callsites, count(*) FILTER (i) AS incoming_callsites, count(DISTINCT (source, target)) FILTER (o) AS outgoing_edges,
    count(DISTINCT (source, target)) FILTER (i) AS incoming_edges, count(DISTINCT source) FILTER (o) AS with_outgoing, count(DISTINCT target) FILTER (i) AS with_incoming,
    (SELECT count(*) FROM flow_candidates WHERE address NOT IN (SELECT source FROM t WHERE o) AND address NOT IN (SELECT target FROM t WHERE i)) AS unchanged FROM t"""
