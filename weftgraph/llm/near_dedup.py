"""MinHash near-dedup with sequential Bayesian verification.

1. One pass over the whole texts gives each document's shingle count, a digest of its shingle set and a signature of
   128 16-bit MinHash values. Equal sets are one class.
2. Four values make a band: classes that agree on one of 32 bands are candidates of each other.
3. Candidates are not expanded to all pairs of a bucket. In a first round each bucket is a chain: only neighbours are
   compared, in one of ORDERS orders that the bands take in turn, so a class has few partners, however large its
   group, and copies that meet in many bands meet the same partners. Hot buckets are chained in salted parts, whose
   heads form a chain of their own. What the links join becomes a component.
4. In a second round, buckets that still hold several components compare every row outside their largest component
   with all rows of other components, in blocks of bounded size. Buckets with the same largest component are one
   group where that makes fewer comparisons than each of them alone, so a row is sent once to a group's block and not
   once for each band. Survivors are verified in the block: no pair leaves a task but links. Rows that are in one
   component already need no further comparison: no link between them could change a result.
5. A pair's signatures are compared in batches of 16. After each, the posterior probability of a similarity of at
   least 0.75, from a uniform prior, is held against a bound; below it the pair is pruned. The bounds share the miss
   probability: over all batches together a pair at the threshold is lost with probability MISS at most.
6. Survivors are verified exactly on the full sets. A shingle is held as its 64-bit hash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from weftgraph.llm.graph import components
from weftgraph.llm.labelled import documents
from weftgraph.llm.skew import HEAVY, look_up, text_tag, without
from weftgraph.llm.workers import strings, task
from weftgraph.session import Scratch, cut

#: Words in a shingle, and the similarity of a link in hundredths.
WORDS, PERCENT = 5, 75
#: Values of a signature, values of a band, values of a batch, and the probability of pruning a true link.
VALUES, BAND, BATCH, MISS = 128, 4, 16, 1e-4
#: Orders in which buckets are chained, and rows above which a bucket's chain is cut into parts (or 1/HEAVY of all classes).
ORDERS, CHAIN = 4, 2048
#: Rows of a bucket that one block of the second round holds on average, and the pairs that it compares at a time.
BLOCK, CHUNK = 1024, 100_000
#: What a row is in a block: one of its own rows, a row outside the largest component that is compared with them, or both.
HOME, BOTH, GUEST = 0, 1, 2

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Words whose hash a task remembers.
CACHE = 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def __call__(self, text: str) -> np.ndarray:
        known, size = self.known, self.words
        ws = _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
        if not ws:
            return np.zeros(0, dtype=np.uint64)
        if len(known) > CACHE:
            known.clear()
        try:
            hashes = [known[w] for w in ws]
        except KeyError:
            for w in set(ws):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            hashes = [known[w] for w in ws]
        h = np.array(hashes, dtype=np.uint64)
        n = max(1, len(h) - size + 1)
        total = np.full(n, len(h) if len(h) < size else size, dtype=np.uint64)
        for i in range(min(size, len(h))):
            total = _mixed(total * _MIX[0] + h[i : i + n])
        return np.unique(total)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(20240229)
    draw = lambda: rng.randint(0, 1 << 32, size=VALUES, dtype=np.uint64).astype(np.uint32)
    return (draw() | np.uint32(1))[:, None], draw()[:, None]


_A, _B = _permutations()


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 MinHash values of a set, 16 bits of each."""
    low = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 2048):
        part = h[None, i : i + 2048] * _A
        part += _B
        np.minimum(low, part.min(axis=1), out=low)
    low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (low >> np.uint32(16)).astype("<u2")


def batch_bounds(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """Fewest agreeing values, after 16, 32, ... 128, that a pair must show to go on.

    With m of n values agreeing and a uniform prior, P(similarity >= t) = P(Binomial(n + 1, t) <= m). A pair is pruned
    where that is under its batch's share of ``miss``, and so is the chance that a pair at t shows so few.
    """
    t, bounds, share = percent / 100, [], miss / (VALUES // BATCH)
    for n in range(BATCH, VALUES + 1, BATCH):
        after = before = 0.0
        for m in range(n + 1):
            after += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            before += math.comb(n, m) * t**m * (1 - t) ** (n - m)
            if max(after, before) >= share:
                bounds.append(m)
                break
    return bounds


def survive(left: np.ndarray, right: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Which rows of two signature matrices are not pruned; batches are compared only for rows that are left."""
    alive = np.arange(len(left))
    agree = np.zeros(len(left), dtype=np.int32)
    for k, bound in enumerate(bounds):
        span = slice(k * BATCH, (k + 1) * BATCH)
        agree[alive] += (left[alive, span] == right[alive, span]).sum(axis=1, dtype=np.int32)
        alive = alive[agree[alive] >= bound]
    out = np.zeros(len(left), dtype=bool)
    out[alive] = True
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(-1, VALUES)


SIGNED_DDL = "doc_id long, tag binary, n_shingles long, digest binary, sig binary"


def _signed(words: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            counts, digests, signatures = [], [], []
            for t in strings(batch.column("text")):
                s = shingler(t)
                counts.append(len(s))
                digests.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(signature(s).tobytes() if len(s) else None)
            made = [pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.record_batch([batch.column("doc_id"), batch.column("tag"), *made], names=["doc_id", "tag", "n_shingles", "digest", "sig"])

    return task(signed)


def _sets(words: int):
    """Shingle sets of classes, from the texts of their first rows; where such a row is repeated, once a task."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last = Shingler(words), None
        for batch in batches:
            cids, out = batch.column("cid").to_pylist(), []
            take = []
            for i, c in enumerate(cids):  # repeats are neighbours: they come out of a join on their key
                if c != last:
                    take.append(i)
                last = c
            for i in take:
                out.append(shingler(batch.column("text")[i].as_py()).tobytes())
            part = batch.take(pa.array(take, pa.int64()))
            yield pa.record_batch([part.column("cid"), part.column("sig"), pa.array(out, pa.binary())], names=["cid", "sig", "shingles"])

    return task(sets)


@task
def _prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bounds = batch_bounds()
    for frame in frames:
        if len(frame):
            yield frame.loc[survive(_matrix(frame["sig_a"]), _matrix(frame["sig_b"]), bounds), ["a", "b"]]


def _verify(percent: int):
    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = [linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(frame["set_a"], frame["set_b"], strict=True)]
            yield frame.loc[np.array(good, dtype=bool), ["a", "b"]]

    return task(verify)


def _across(percent: int):
    """Second round: within each (key, band, block), rows outside the key's largest component against all others.

    Rows come sorted by (key, band, block). Where the key is one bucket, a pair is compared in the first band that it
    shares; a group of buckets has band -1 and compares each pair once. Where both rows are minor it goes from the
    side of the smaller id. Survivors of the signatures are verified at once, likeliest first; one link to a component
    is enough. A task holds one block, and CHUNK pairs of it at a time.
    """
    bounds = batch_bounds()

    def found(held: dict[str, list]) -> list[tuple]:
        role = np.array(held["role"])
        guests, homes = np.flatnonzero(role != HOME), np.flatnonzero(role != GUEST)
        if not len(guests) or not len(homes):
            return []
        rep, comp, major, band = np.array(held["rep"]), np.array(held["comp"]), held["major"][0], held["band"][0]
        sig = np.frombuffer(b"".join(held["sig"]), dtype="<u2").reshape(-1, VALUES)
        bands = sig.view("<u8").reshape(len(sig), -1)
        out, step = [], max(1, CHUNK // len(homes))
        for start in range(0, len(guests), step):
            g, h = (x.ravel() for x in np.meshgrid(guests[start : start + step], homes, indexing="ij"))
            use = (comp[g] != comp[h]) & ((comp[h] == major) | (rep[g] < rep[h]))
            g, h = g[use], h[use]
            if band >= 0:
                use = (bands[g] == bands[h]).argmax(axis=1) == band
                g, h = g[use], h[use]
            use = survive(sig[g], sig[h], bounds)
            g, h = g[use], h[use]
            order = np.argsort(-(sig[g] == sig[h]).sum(axis=1), kind="stable")
            done: set[tuple] = set()
            for x, y in zip(g[order].tolist(), h[order].tolist(), strict=True):
                meeting = (rep[x], comp[y])
                if meeting not in done and linked(np.frombuffer(held["shingles"][x], dtype=np.uint64), np.frombuffer(held["shingles"][y], dtype=np.uint64), percent):
                    done.add(meeting)
                    out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
        return out

    def across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("role", "rep", "comp", "major", "band", "sig", "shingles")
        key, held, out = None, {n: [] for n in names}, []
        for frame in frames:
            columns = {n: frame[n].tolist() for n in names}
            keys = list(zip(frame["key"].tolist(), frame["band"].tolist(), frame["block"].tolist(), strict=True))
            start = 0
            for at in range(1, len(keys) + 1):
                if at == len(keys) or keys[at] != keys[start]:
                    if keys[start] != key:
                        if key is not None:
                            out += found(held)
                        key, held = keys[start], {n: [] for n in names}
                    for n in names:
                        held[n] += columns[n][start:at]
                    start = at
        if key is not None:
            out += found(held)
        if out:
            yield pd.DataFrame(out, columns=["a", "b"]).drop_duplicates()

    return task(across)


def _sides(pairs: DataFrame, info: DataFrame, column: str, name: str) -> DataFrame:
    """Pairs (a, b) with ``name``_a and ``name``_b, the two rows' ``column``."""
    first, second = (info.select(F.col("cid").alias(side), F.col(column).alias(f"{name}_{side}")) for side in "ab")
    return pairs.join(first, "a").join(second, "b")


def _chains(classes: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows of buckets that hold several classes, neighbours a < b of their chains)."""
    bands = VALUES // BAND
    banded = classes.select("cid", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.substring("sig", 2 * BAND * i + 1, 2 * BAND).alias("part")) for i in range(bands)])).alias("x"))
    banded = banded.select("cid", F.col("x.band").alias("band"), F.xxhash64("x.band", "x.part").alias("bucket"))
    bound = max(CHAIN, n // HEAVY)  # under bands * HEAVY buckets hold more
    hot = banded.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("bucket", F.ceil(F.col("n") / bound).cast("int").alias("parts"))
    salted = banded.join(F.broadcast(hot), "bucket", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(F.lit("salt"), "cid"), F.col("parts")).cast("int"), F.lit(0)))
    order = [F.xxhash64(F.col("band") % ORDERS, "cid"), F.col("cid")]
    chain = Window.partitionBy("bucket", "salt").orderBy(*order)
    shared = salted.withColumns({"next": F.lead("cid").over(chain), "before": F.lag("cid").over(chain)})
    shared = shared.where("next is not null or before is not null or parts is not null")
    shared = scratch.table(shared.select("cid", "band", "bucket", "next", (F.col("parts").isNotNull() & F.col("before").isNull()).alias("head")))
    heads = shared.where("head").withColumn("next", F.lead("cid").over(Window.partitionBy("bucket").orderBy(*order)))
    pairs = shared.select("cid", "next").unionByName(heads.select("cid", "next")).where("next is not null and next <> cid")
    return shared.select("cid", "band", "bucket"), pairs.select(F.least("cid", "next").alias("a"), F.greatest("cid", "next").alias("b")).distinct()


def _second_round(shared: DataFrame, comps: DataFrame, info: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between components that share a bucket."""
    bands = VALUES // BAND
    placed = shared.join(comps.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "band", "cid", F.coalesce("component", "cid").alias("comp"))
    placed = scratch.table(placed)
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    # Buckets of three rows or more that still hold several components; the only pair of a smaller one was a chain.
    opened = sizes.groupBy("bucket").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top")).where("comps > 1 and n > 2")
    opened = scratch.table(opened.select("bucket", "n", F.col("top.comp").alias("major"), (F.col("n") - F.col("top.n")).alias("guests")))
    rows = look_up(placed, opened.select("bucket", "n", "major"), "bucket", "n", n * bands).where("major is not null")
    rows = scratch.table(rows.select("bucket", "band", "cid", "comp", "major"))
    members = scratch.table(rows.select("major", "cid", "comp").distinct())
    whole = members.groupBy("major").agg(F.count("*").alias("n"), F.count_if(F.col("comp") != F.col("major")).alias("guests"))
    alone = opened.groupBy("major").agg(F.sum(F.col("n") * F.col("guests")).alias("alone"))
    groups = scratch.table(whole.join(alone, "major").select("major", F.col("n").alias("size"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), (F.col("n") * F.col("guests") <= F.col("alone")).alias("whole")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    together = look_up(members, groups, "major", "size", total).where("whole").select(F.col("major").alias("key"), F.lit(-1).alias("band"), "cid", "comp", "major", "blocks")
    apart = opened.join(groups.where("not whole").select("major"), "major").select("bucket", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    single = look_up(rows, apart, "bucket", "n", n * bands).where("blocks is not null").select(F.col("bucket").alias("key"), "band", "cid", "comp", "major", "blocks")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    minor = F.col("comp") != F.col("major")
    to = F.when(minor, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    role = F.when(~minor, HOME).when(F.col("block") == own, BOTH).otherwise(GUEST)
    spread = together.unionByName(single).withColumn("block", F.explode(to)).withColumn("role", role)
    blocks = spread.select("key", "band", "block", "role", "cid", "comp", "major").join(info, "cid").withColumnRenamed("cid", "rep")
    blocks = blocks.repartition("key", "band", "block").sortWithinPartitions("key", "band", "block")
    return blocks.mapInPandas(_across(percent), "a long, b long").distinct()


def _decided(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """One row per document: doc_id, tag, n_shingles, component_id, copied, stays (see ``without``)."""
    with Scratch(docs.sparkSession) as scratch:
        rows = documents(docs, doc_id, text).select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_tag(F.col("text")).alias("tag"))
        signed = scratch.table(rows.mapInArrow(_signed(words), SIGNED_DDL))
        classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "tag")).alias("top"), F.first("sig").alias("sig"), F.count("*").alias("rows"))
        classes = scratch.table(classes.select(F.monotonically_increasing_id().alias("cid"), "digest", "top.doc_id", "top.tag", "sig", "rows"))
        n, total = classes.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()

        shared, pairs = _chains(classes, n, scratch)
        pairs = scratch.table(_sides(pairs, classes, "sig", "sig").mapInPandas(_prune, "a long, b long"))
        wanted = classes.join(shared.select("cid").distinct(), "cid", "left_semi").select("doc_id", "tag", "cid", "sig")
        info = scratch.table(rows.join(wanted, ["doc_id", "tag"]).select("cid", "sig", "text").mapInArrow(_sets(words), "cid long, sig binary, shingles binary"))
        links = scratch.table(_sides(pairs, info, "shingles", "set").mapInPandas(_verify(percent), "a long, b long"))
        more = scratch.table(_second_round(shared, components(links, scratch), info, n, percent, scratch))
        comps = components(links.unionByName(more), scratch)

        comps = comps.unionByName(comps.select(F.col("component").alias("node"), "component").distinct())  # roots are nodes, too
        linked = scratch.table(classes.drop("sig").join(comps.withColumnRenamed("node", "cid"), "cid", "left").where("rows > 1 or component is not null").withColumn("component", F.coalesce("component", "cid")))
        heads = linked.groupBy("component").agg(F.min(F.struct("doc_id", "tag")).alias("head"), F.count("*").alias("n"))
        index = look_up(linked.select("component", "digest", "rows"), scratch.table(heads), "component", "n", linked.count()).select("digest", "rows", "head")
        node = F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")
        out = look_up(signed.select("doc_id", "tag", "n_shingles", node), scratch.table(index), "digest", "rows", total)
        copied, first = F.col("head").isNotNull(), F.struct("doc_id", "tag")
        return cut(out.select("doc_id", "tag", "n_shingles", F.coalesce("head.doc_id", "doc_id").alias("component_id"), copied.alias("copied"), F.when(copied, F.col("head") == first).otherwise(True).alias("stays")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null texts count as empty; texts without words have no shingles and link with nothing. Texts of fewer than ``words``
    words are one shingle. Repeated rows are in one component; so are rows of one doc_id only where their texts link.
    A row without a doc_id links with nothing and is its own component (null). An empty table gives no rows. Other
    columns are not read.
    """
    rows = _decided(docs, doc_id, text, words, percent)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one row of each component of near copies.

    It is the row of the smallest doc_id; of several with that id, the one whose text has the smallest digest.
    """
    return without(docs, _decided(docs, doc_id, text, WORDS, PERCENT), doc_id, text)
