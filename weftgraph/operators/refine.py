"""Colour refinement of weighted directed graphs, for many graphs and all relation modes in one loop.

A round splits classes by the OUT and IN multisets of their nodes, where a multiset holds the edge counts summed by
neighbour colour. Work follows what changed: of a class that splits, the largest part keeps its colour, and the next round
compares nodes by what they see of the new colours alone. Nodes of a class saw as much of the class before it split, so
what they see of the part that kept the colour follows. The partitions are those of rounds over all nodes.

Nodes and colours are numbers in the rounds, and edges are laid out once by the node that is seen: a round shuffles the
new colours and one row of sums a node, combined on the map side, so hubs need no arrays. At the fixpoint the partition is
certified without hashes: every class's nodes must have the same sum, or none, by each direction and colour. Nodes that
differ from their class's first one leave the class, and rounds go on. Colours name classes by a member and a round, so
they are exact, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.schemas import MODES
from weftgraph.operators.numbering import numbered
from weftgraph.session import Beside, Scratch, cut, partitions

GRAPH = ["graph_id", "mode"]
#: Seeds of anchors: their class, or each its own.
ANCHORS = ("role", "address")


def relation_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node: summed self count, distinct other callees, distinct other callers."""
    loops = edges.where("src = dst").groupBy("graph_id", F.col("src").alias("id")).agg(F.sum("count").alias("self_count"))
    others = edges.where("src <> dst")
    out = others.groupBy("graph_id", F.col("src").alias("id")).agg(F.count_distinct("dst").alias("out_degree"))
    into = others.groupBy("graph_id", F.col("dst").alias("id")).agg(F.count_distinct("src").alias("in_degree"))
    joined = nodes
    for side in (loops, out, into):
        joined = joined.join(side, ["graph_id", "id"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("self_count", "out_degree", "in_degree")})


def anchor_color(color_class: Column, node: Column) -> Column:
    """Colour of an anchor: its class, or its own id where it has none."""
    return F.concat(F.lit("ANCHOR:"), F.coalesce(color_class, node))


def seed_text(mode: Column) -> Column:
    """Seed of a node from the relation view, as text."""
    degree = F.when(mode == "in", F.concat(F.lit("in="), F.col("in_degree"))).otherwise(F.concat(F.lit("out="), F.col("out_degree")))
    return F.when(F.col("type") == "anchor", anchor_color(F.col("color_class"), F.col("id"))).otherwise(F.concat(F.lit("USER:self="), F.col("self_count"), F.lit(":"), degree))


def check_modes(modes: tuple[str, ...]) -> None:
    for mode in modes:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; expected one of {', '.join(MODES)}")


def seeds(nodes: DataFrame, edges: DataFrame, modes: tuple[str, ...] = ("full",), exact: bool = False) -> DataFrame:
    """(graph_id, mode, id, scored, no_callee, color) of round 0; the color is the seed's text itself if ``exact``, else its digest."""
    check_modes(modes)
    view = relation_view(nodes, edges).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    return view.select(*GRAPH, "id", "scored", (F.col("out_degree") == 0).alias("no_callee"), (seed_text(F.col("mode")) if exact else F.md5(seed_text(F.col("mode")))).alias("color"))


def neighbour_multiset(colors: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """(graph_id, mode, id, color, weight): edge counts summed by the colour of the neighbour."""
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    others = edges.where("src <> dst").select("graph_id", F.col(here).alias("id"), F.col(there).alias("other"), "count")
    far = colors.select(*GRAPH, F.col("id").alias("other"), "color")
    return others.join(far, ["graph_id", "other"]).groupBy(*GRAPH, "id", "color").agg(F.sum("count").alias("weight"))


#: Rows of the layout in a bucket, about; a task's memory follows these, not the tables.
BUCKET = 1 << 19


class _Layout:
    """Nodes as numbers, and the edges laid out once by the node at either end: (here, there, out, count, stray).

    ``out`` tells the direction; a self edge is one row. Where the other end is no node, ``there`` is null and ``stray``
    its name: it counts in a degree and has no colour. ``carry`` names further columns of the nodes.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, scratch: Scratch, beside: Beside, carry: tuple[str, ...] = ()):
        self.scratch = scratch
        placed = scratch.table(nodes.select("graph_id", "id", "type", "scored", "color_class", *carry).withColumn("at", F.monotonically_increasing_id()))
        part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
        last_part, last_row = placed.agg(F.coalesce(F.max(part), F.lit(0)), F.coalesce(F.max(row), F.lit(0))).first()
        self.names = placed.withColumn("node", row * (last_part + 1) + part).drop("at")
        self.span = (last_row + 1) * (last_part + 1)
        ids = self.names.select("graph_id", "id", "node")
        drawn = edges.where("src is not null and dst is not null").select("graph_id", "src", "dst", "count")
        for end in ("src", "dst"):
            drawn = drawn.join(ids.withColumnsRenamed({"id": end, "node": f"{end}_node"}), ["graph_id", end], "left")
        stray = lambda end: F.when(F.col(f"{end}_node").isNull(), F.col(end)).alias(f"{end}_stray")
        drawn = scratch.table(drawn.where("src_node is not null or dst_node is not null").select("src_node", "dst_node", "count", stray("src"), stray("dst")))
        self.buckets = max(beside.buckets, -(-2 * drawn.count() // BUCKET))
        out = drawn.where("src_node is not null").select(F.col("src_node").alias("here"), F.col("dst_node").alias("there"), F.lit(True).alias("out"), "count", F.col("dst_stray").alias("stray"))
        into = drawn.where("dst_node is not null and not (src_node <=> dst_node)").select(F.col("dst_node").alias("here"), F.col("src_node").alias("there"), F.lit(False).alias("out"), "count", F.col("src_stray").alias("stray"))
        self.ends = beside.table(out.unionByName(into), "here", buckets=self.buckets)

    def seeds(self, modes: tuple[str, ...], anchors: tuple[str, ...]) -> DataFrame:
        """(graph_id, m, node, no_callee, color) of round 0, where ``m`` numbers the mode and the anchors, and a color is a member's number."""
        own = F.col("there").eqNullSafe(F.col("here"))
        others = self.ends.groupBy("here", "out", "there", "stray").agg(F.sum("count").alias("count"))
        degrees = others.groupBy(F.col("here").alias("node")).agg(F.sum(F.when(own, F.col("count"))).alias("self_count"), F.count_if(F.col("out") & ~own).alias("out_degree"), F.count_if(~F.col("out")).alias("in_degree"))
        view = self.names.join(degrees, "node", "left").fillna(0, ["self_count", "out_degree", "in_degree"]).withColumn("m", F.explode(F.array(*[F.lit(ANCHORS.index(a) * len(MODES) + MODES.index(m)) for a in anchors for m in modes])))
        view = view.withColumn("color_class", F.when(_name("anchors") == "role", F.col("color_class")))
        seeded = self.scratch.table(view.select("graph_id", "m", "node", (F.col("out_degree") == 0).alias("no_callee"), seed_text(_name("mode")).alias("seed")))
        named = self.scratch.table(seeded.groupBy("graph_id", "m", "seed").agg(F.min("node").alias("color")))
        return seeded.join(named, ["graph_id", "m", "seed"]).select("graph_id", "m", "node", "no_callee", "color")

    def seen(self, colors: DataFrame) -> DataFrame:
        """(m, node, out, color, count): the edges by which nodes see those of ``colors`` (m, node, color), as far as the mode may use them.

        The edges lie by the node that is seen, so only colours are shuffled.
        """
        far = colors.select("m", F.col("node").alias("here"), "color").join(self.ends, "here").where("there <> here")
        return far.select("m", F.col("there").alias("node"), (~F.col("out")).alias("out"), "color", "count").where(_MAY_USE)

    def named(self, colors: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """``colors`` with modes, anchors and ids by name, and the nodes' columns ``carry``."""
        more = [c for c in colors.columns if c not in ("graph_id", "m", "node", "no_callee", "color")]
        return colors.join(self.names.select("node", "id", "scored", *carry), "node").select("graph_id", _name("mode"), _name("anchors"), "id", "scored", "no_callee", F.col("color").cast("string").alias("color"), *more, *carry)


def _name(part: str) -> Column:
    """The mode or the anchors that ``m`` numbers."""
    place = F.col("m") % len(MODES) if part == "mode" else F.floor(F.col("m") / len(MODES)).cast("int")
    return F.element_at(F.array(*map(F.lit, MODES if part == "mode" else ANCHORS)), place + 1).alias(part)


#: Which multisets a mode may use; ``out-in`` uses callers only where there is no callee.
_MAY_USE = f"case when out then m % {len(MODES)} <> {MODES.index('in')} else m % {len(MODES)} <> {MODES.index('out')} end"
_USES = f"out or m % {len(MODES)} <> {MODES.index('out-in')} or no_callee"


def _signed(new: DataFrame, colors: DataFrame, layout: _Layout, bits: int) -> DataFrame:
    """``colors`` with ``now``, for nodes that see one of ``new`` (m, node, color): a digest of what they see of these colours.

    A digest sums counts times numbers drawn by colour, so it needs no sums by colour and combines on the map side. What
    it can't tell apart (or overflows) is left to the certificate. Sums meet the nodes once, where they are kept.
    """
    sums = [F.try_sum(F.when(F.col("out") == out, F.try_multiply(F.col("count").cast("bigint"), F.xxhash64(F.lit(k), "out", "color").bitwiseAND((1 << 31) - 1)))).alias(f"{'out' if out else 'in'}{k}") for out in (True, False) for k in (1, 2)]
    has = [F.max(F.col("out")).alias("has_out"), F.max(~F.col("out")).alias("has_in")]
    found = colors.join(layout.seen(new).groupBy("m", "node").agg(*sums, *has), ["m", "node"], "left")
    callers = F.col("has_in") & F.expr(_USES.removeprefix("out or "))
    digest = F.xxhash64("out1", "out2", "has_out", F.when(callers, F.col("in1")), F.when(callers, F.col("in2")), callers)
    return found.select(*colors.columns, F.when(F.col("has_out") | callers, digest if bits >= 128 else F.pmod(digest, F.lit(1 << bits))).alias("now"))


def _uneven(colors: DataFrame, layout: _Layout) -> tuple[DataFrame, DataFrame]:
    """The certificate: classes (m, own) whose nodes don't all have the same multisets, and all nodes' rows (m, node, own, first, out, color, weight).

    A class is even if for each direction and colour either every node has the same sum or none has one. No hashes are
    compared, no node with another.
    """
    classes = layout.scratch.table(colors.groupBy("m", F.col("color").alias("own")).agg(F.min("node").alias("first"), F.count("*").alias("members")).where("members > 1"))
    shared = colors.select("m", "node", "no_callee", F.col("color").alias("own")).join(classes, ["m", "own"])
    rows = layout.seen(colors).groupBy("m", "node", "out", "color").agg(F.sum("count").alias("weight")).join(shared, ["m", "node"]).where(_USES)
    cells = rows.groupBy("m", "own", "out", "color").agg(F.count("*").alias("n"), F.max("members").alias("members"), F.count("weight").alias("given"), F.min("weight").alias("least"), F.max("weight").alias("most"))
    return cells.where("n <> members or not (least <=> most) or given not in (0, n)").select("m", "own").distinct(), rows


def differing(colors: DataFrame, layout: _Layout) -> DataFrame | None:
    """Nodes (m, node, color) whose multisets are not those of their class's first node, or None. No hashes are compared.

    Only classes that are not even are looked into: a node agrees if each of its (direction, colour, sum) rows is one of
    the first node's, and there are as many.
    """
    uneven, rows = _uneven(colors, layout)
    uneven = layout.scratch.table(uneven)
    if uneven.isEmpty():
        return None
    rows = layout.scratch.table(rows.join(uneven, ["m", "own"], "left_semi").select("m", "node", "own", "first", "out", "color", F.col("weight")))
    shared = colors.withColumnRenamed("color", "own").join(uneven, ["m", "own"], "left_semi").select("m", "node", "own")
    firsts = shared.groupBy("m", "own").agg(F.min("node").alias("node"))
    model = rows.join(firsts, ["m", "own", "node"], "left_semi").select("m", "own", "out", "color", F.col("weight").alias("want"), F.lit(1).alias("hit"))
    met = (rows["m"] == model["m"]) & (rows["own"] == model["own"]) & (rows["out"] == model["out"]) & (rows["color"] == model["color"]) & rows["weight"].eqNullSafe(model["want"])
    held = rows.join(model, met, "left").groupBy(rows["m"], rows["node"]).agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    sizes = model.groupBy("m", "own").agg(F.count("*").alias("size"))
    all_ = shared.join(held, ["m", "node"], "left").join(sizes, ["m", "own"], "left").fillna(0, ["n", "hits", "size"])
    return layout.scratch.table(all_.where("n <> size or hits <> size").select("m", "node", F.col("own").alias("color")))


def refine(
    nodes: DataFrame, edges: DataFrame, modes: tuple[str, ...] = ("full",), trace: bool = False, rounds: int | None = None, bits: int = 128, digested: list[int] | None = None,
    anchors: tuple[str, ...] = ("role",), carry: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Refine to the fixpoint: (colours, rounds by graph and mode, colours of every round or None).

    A partition only ever gets finer, so it is stable when nothing splits. ``rounds`` counts the confirming round; given
    as an argument it is the most rounds, and a partition cut short isn't certified. The driver sees whether something
    split; everything else stays distributed, and each round's colours are a table of the shared folder (unlike a
    checkpoint it has statistics, so joins of small tables need no shuffle). ``bits`` under 128 is
    for tests of colliding digests: the partition is the same, rounds may differ. ``digested`` gets the nodes that each
    round digested. With several ``anchors`` (of ANCHORS) each is refined beside the others on the same edges, and the
    results have a column ``anchors``. ``carry`` names further columns of the nodes that the colours keep.
    """
    check_modes(modes)
    one = ["anchors"] * (len(anchors) == 1)
    with Scratch(nodes.sparkSession) as scratch, Beside(scratch) as beside, partitions(nodes.sparkSession, 1):
        layout = _Layout(nodes, edges, scratch, beside, carry)
        with partitions(nodes.sparkSession, layout.buckets):
            colors = scratch.table(layout.seeds(modes, anchors))
            moved, number = colors.select("m", "node", "color"), 0
            counted, history = [_classes(colors, 0)], [colors.withColumn("round", F.lit(0))]
            while rounds is None or number < rounds:
                number += 1
                signed = scratch.table(_signed(moved, colors, layout, bits))
                if digested is not None:
                    digested.append(signed.where("now is not null").count())
                parts = scratch.table(signed.groupBy("graph_id", "m", "color", "now").agg(F.count("*").alias("n"), F.min("node").alias("first")))
                counted.append(parts.groupBy("graph_id", "m").agg(F.count("*").alias("classes")).withColumn("round", F.lit(number)))
                keeps = parts.groupBy("m", "color").agg(F.count("*").alias("parts"), F.max(F.struct("n", "first")).alias("keeps")).where("parts > 1")
                leaving = parts.join(keeps, ["m", "color"]).where("first <> keeps.first").select("m", "color", F.col("now").alias("left"), (F.lit(number) * F.lit(layout.span) + F.col("first")).alias("new"))
                leaving = scratch.table(leaving)
                joined = None
                if not leaving.isEmpty():
                    same = (signed["m"] == leaving["m"]) & (signed["color"] == leaving["color"]) & signed["now"].eqNullSafe(leaving["left"])
                    joined = signed.join(leaving.select("m", "color", "left", "new"), same, "left").select(*[signed[c] for c in colors.columns], "new")
                elif rounds is None and (wrong := differing(colors, layout)) is not None:  # digests met; their nodes become a class
                    named = wrong.groupBy("m", "color").agg((F.lit(number) * F.lit(layout.span) + F.min("node")).alias("new"))
                    joined = colors.join(wrong.join(named, ["m", "color"]).select("m", "node", "new"), ["m", "node"], "left")
                if joined is not None:
                    joined = scratch.table(joined)
                    moved = joined.where("new is not null").select("m", "node", F.col("new").alias("color"))
                    colors = joined.select("graph_id", "m", "node", "no_callee", F.coalesce("new", "color").alias("color"))
                if trace:
                    history.append(colors.withColumn("round", F.lit(number)))
                if joined is None:
                    break
            every, colors = cut(reduce(DataFrame.unionByName, counted).select("graph_id", _name("mode"), _name("anchors"), "classes", "round")), cut(layout.named(colors, carry).drop(*one))
            history = cut(layout.named(reduce(DataFrame.unionByName, history)).drop(*one)) if trace else None
    keys = [c for c in (*GRAPH, "anchors") if c not in one]
    last = every.groupBy(*keys).agg(F.max("classes").alias("classes"))
    first = every.join(last, [*keys, "classes"]).groupBy(*keys).agg((F.min("round") + 1).cast("int").alias("rounds"))
    return colors, first, history


def _classes(colors: DataFrame, number: int) -> DataFrame:
    return colors.groupBy("graph_id", "m").agg(F.count_distinct("color").alias("classes")).withColumn("round", F.lit(number))


def with_class(colors: DataFrame, keys: tuple[str, ...] = tuple(GRAPH)) -> DataFrame:
    """Colours with ``class_id``, the smallest node id of each class: the canonical name of a partition's class."""
    named = colors.groupBy(*keys, "color").agg(F.min("id").alias("class_id"))
    return colors.join(named, [*keys, "color"])


def scored_clusters(colors: DataFrame, listed: bool = True) -> DataFrame:
    """One row per cluster of scored nodes: cluster (0-based by first member), color, first member, size.

    ``listed`` adds the sorted members as an array, the form that documents hold; a cluster has to fit in a row then.
    """
    parts = [F.min("id").alias("first"), F.count("*").alias("size")] + ([F.array_sort(F.collect_list("id")).alias("members")] if listed else [])
    return numbered(colors.where("scored").groupBy(*GRAPH, "color").agg(*parts), GRAPH, ["first"], "cluster")


def same_partition(first: DataFrame, second: DataFrame) -> bool:
    """Whether two colourings of (graph_id, id) are the same partition, whatever the colours' names."""
    a, b = (with_class(d, ("graph_id",)).select("graph_id", "id", "class_id") for d in (first, second))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def trace_states(history: DataFrame) -> DataFrame:
    """Per graph, mode and round: classes, scored classes, and the state seed, changed or fixpoint."""
    from pyspark.sql.window import Window

    counts = history.groupBy(*GRAPH, "round").agg(F.count_distinct("color").alias("classes"), F.count_distinct(F.when(F.col("scored"), F.col("color"))).alias("scored_classes"))
    before = F.lag("classes").over(Window.partitionBy(*GRAPH).orderBy("round"))
    return counts.withColumn("state", F.when(F.col("round") == 0, "seed").when(F.col("classes") == before, "fixpoint").otherwise("changed"))
