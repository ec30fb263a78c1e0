"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A hash is the signed coordinate that dominates after three rounds of random signs and a fast Hadamard transform. A
table joins ``k`` hashes to a code; ``k`` grows with the logarithm of the rows, so that chance meetings stay few. In
each table a vector is at home in its code's bucket and a guest in the ``PROBES`` next likely ones. Two vectors are
compared where one of them is at home. The number of tables is what a fixed simulation of pairs at the threshold
needs for the wanted recall.

Buckets first hold sketches only: SKETCH sign bits of further rotations, 16 bytes a row. Two vectors at the threshold
differ in few of them, vectors that meet by chance in about half; only rows with a partner within FAR bits go on. Those
rows' vectors are then sent to their buckets, where pairs are verified in place, by blocks of cosines in double
precision, and never leave the task: a task returns link counts of rows and a spanning forest of its links. A pair that
several buckets see is counted only in the first of them, which both codes tell; codes are computed again for rows
with links. Buckets above a block's rows are cut into blocks, and each pair of blocks is a task's work of bounded
memory; a bucket of m rows is so sent m / block times. Equal vectors are one class with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from weftgraph.llm.graph import components
from weftgraph.llm.skew import look_up
from weftgraph.session import Scratch, cut

#: Cosine of a link, guest buckets in each table, wanted recall at the threshold, rows of a block of vectors and of sketches.
COSINE, PROBES, RECALL, BLOCK, SKETCH_BLOCK = 0.9, 3, 0.995, 1024, 4096
#: Sign bits of a sketch, and the standard deviations above the mean distance at the threshold that FAR allows: one pair
#: in 10^9 exceeds it.
SKETCH, DEVIATIONS = 128, 6.0
#: Rows that share a bucket by chance, about; and pairs whose codes are compared at a time.
CROWD, CHUNK = 8, 50_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform over the last axis (a power of two long), scaled to keep lengths."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x / math.sqrt(n)


@lru_cache(maxsize=64)
def _signs(tables: int, k: int, width: int) -> np.ndarray:
    return np.random.RandomState(1_000_003 + width).choice(np.array([-1.0, 1.0]), size=(tables, k, 3, width))


def codes(vectors: np.ndarray, tables: int, k: int, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, 1 + probes) codes: the home bucket, then the guest buckets, likeliest first."""
    rows, dim = vectors.shape
    width = 1 << max(1, (dim - 1).bit_length())
    base = np.zeros((rows, width))
    base[:, :dim] = vectors
    out = np.full((rows, tables, 1 + probes), -1, dtype=np.int64)  # -1: no such bucket
    moves = [((j, 1),) for j in range(k)] + [((j, 2),) for j in range(k) if width > 2] + [((i, 1), (j, 1)) for i in range(k) for j in range(i)]
    for t, signs in enumerate(_signs(tables, k, width)):
        best, gaps = [], []
        for s in signs:
            v = base
            for sign in s:
                v = hadamard(v * sign)
            size = np.abs(v)
            top = np.argpartition(-size, min(2, width - 1), axis=1)[:, :3]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
            height = np.take_along_axis(size, top, 1)
            best.append(2 * top + (np.take_along_axis(v, top, 1) < 0))
            gaps.append((height[:, :1] - height) ** 2)
        scale = [(2 * width) ** j for j in range(k)]
        home = sum(b[:, 0] * f for b, f in zip(best, scale, strict=True))
        cost = np.stack([sum(gaps[j][:, r] for j, r in m) for m in moves], axis=1)
        code = np.stack([home + sum((best[j][:, r] - best[j][:, 0]) * scale[j] for j, r in m) for m in moves], axis=1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out[:, t, 0], out[:, t, 1 : 1 + order.shape[1]] = home, np.take_along_axis(code, order, 1)
    return out


def meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(pairs, tables, 2) buckets in which two code rows meet: b's home if a is there, and a's home if b is; else -1."""
    first = np.where((a == b[..., :1]).any(axis=-1), b[..., 0], -1)
    second = np.where((b == a[..., :1]).any(axis=-1), a[..., 0], -1)
    return np.stack([first, second], axis=-1)


@lru_cache(maxsize=64)
def plan(rows: int, dim: int, cosine: float = COSINE, recall: float = RECALL, probes: int = PROBES, crowd: int = CROWD) -> tuple[int, int]:
    """(tables, k) for so many rows: k from the crowd by chance, tables from 2000 simulated pairs at the threshold."""
    width = 1 << max(1, (dim - 1).bit_length())
    k = max(1, math.ceil(math.log(max(1.0, rows / crowd)) / math.log(2 * width)))
    rng = np.random.RandomState(5)
    x, z = rng.randn(2000, dim), rng.randn(2000, dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = cosine * x + math.sqrt(1 - cosine * cosine) * z
    met = (meets(codes(x, 4, k, probes), codes(y, 4, k, probes)) >= 0).any(axis=-1).mean()
    return max(2, math.ceil(math.log(1 - recall) / math.log(max(1e-9, 1 - min(met, 1 - 1e-9))))), k


def _bucket(dim: int, table: int, code: np.ndarray) -> np.ndarray:
    x = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((table + 1) * 0xD1B54A32D192ED03 % (1 << 64)) + np.uint64(dim * 0xABC98388FB8FAC03 % (1 << 64))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def far(cosine: float) -> int:
    """Most differing sketch bits of a pair at the threshold: angle / pi of SKETCH bits on average, and DEVIATIONS more."""
    p = math.acos(cosine) / math.pi
    return math.ceil(SKETCH * p + DEVIATIONS * math.sqrt(SKETCH * p * (1 - p)))


def sketches(vectors: np.ndarray) -> np.ndarray:
    """(rows, SKETCH / 64) words of sign bits, from random rotations that the hash tables don't use."""
    rows, dim = vectors.shape
    width = 1 << max(1, (dim - 1).bit_length())
    base = np.zeros((rows, width))
    base[:, :dim] = vectors
    parts = []
    for signs in np.random.RandomState(77 + width).choice(np.array([-1.0, 1.0]), size=(-(-SKETCH // width), 3, width)):
        v = base
        for sign in signs:
            v = hadamard(v * sign)
        parts.append(v > 0)
    return np.packbits(np.hstack(parts)[:, :SKETCH], axis=1).view("<u8")


def _unit(flat: np.ndarray) -> np.ndarray:
    """Directions in double precision; components are scaled first, so that no square overflows."""
    v = flat.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _hashed(rows: int, kind: str, crowd: int):
    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["vec"].map(len)):
                tables, k = plan(rows, int(dim), crowd=crowd)
                double = _unit(np.stack(part["vec"].to_numpy()).astype(kind))
                found, held = codes(double, tables, k), [x.tobytes() for x in sketches(double)]
                for t in range(tables):
                    for p in range(1 + PROBES):
                        if found[0, t, p] < 0:
                            continue
                        yield pd.DataFrame({"bucket": _bucket(int(dim), t, found[:, t, p]), "tab": t, "home": p == 0, "rep": part["rep"].to_numpy(), "sketch": held})

    return hashed


HASHED_DDL = "bucket long, tab int, home boolean, rep long, sketch binary"


def _grouped(frames: Iterator[pd.DataFrame], names: tuple[str, ...], work) -> Iterator[list[tuple]]:
    """``work(columns, lo, hi)`` of each (bucket, tab, lo, hi) group; rows come sorted by it, and one group is held."""
    key, held = None, {n: [] for n in names}
    for frame in frames:
        columns = {n: frame[n].tolist() for n in names}
        keys = list(zip(frame["bucket"].tolist(), frame["tab"].tolist(), frame["lo"].tolist(), frame["hi"].tolist(), strict=True))
        start = 0
        for at in range(1, len(keys) + 1):
            if at == len(keys) or keys[at] != keys[start]:
                if keys[start] != key:
                    if key is not None:
                        yield work(held, key[2], key[3])
                    key, held = keys[start], {n: [] for n in names}
                for n in names:
                    held[n] += columns[n][start:at]
                start = at
    if key is not None:
        yield work(held, key[2], key[3])


def _framed(groups: Iterator[list[tuple]], columns: list[str]) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    for rows in groups:
        out += rows
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


def _near(cosine: float):
    """Rows of each group with a partner whose sketch is near, one of the two being at home: (bucket, tab, rep)."""
    most = far(cosine)

    def group(part: dict[str, list], lo: int, hi: int) -> list[tuple]:
        m = len(part["rep"])
        if m < 2:
            return []
        sketch, home = np.frombuffer(b"".join(part["sketch"]), dtype="<u8").reshape(m, -1), np.array(part["home"])
        block = np.array(part["block"])
        one, two = (np.flatnonzero(block == lo), np.flatnonzero(block == hi))
        met = np.zeros(m, dtype=bool)
        for start in range(0, len(one), 256):
            g = one[start : start + 256]
            apart = np.zeros((len(g), len(two)), dtype=np.uint16)
            for w in range(sketch.shape[1]):
                apart += np.bitwise_count(sketch[g, w][:, None] ^ sketch[two, w][None, :])
            close = (apart <= most) & (home[g][:, None] | home[two][None, :]) & (g[:, None] != two[None, :])
            met[g] |= close.any(axis=1)
            met[two] |= close.any(axis=0)
        bucket, tab = part["bucket"][0], part["tab"][0]
        return [(bucket, tab, part["rep"][x]) for x in np.flatnonzero(met)]

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _framed(_grouped(frames, ("bucket", "tab", "home", "rep", "sketch", "block"), group), ["bucket", "tab", "rep"])

    return near


def _compare(rows: int, kind: str, crowd: int, cosine: float):
    """Link counts and a forest of each (bucket, tab, lo, hi) group."""

    def group(part: dict[str, list], lo: int, hi: int) -> list[tuple]:
        m = len(part["rep"])
        if m < 2:
            return []
        v = _unit(np.frombuffer(b"".join(part["vec"]), dtype=kind).reshape(m, -1))
        block, tab, bucket = np.array(part["block"]), part["tab"][0], part["bucket"][0]
        one, two = (np.flatnonzero(block == lo), np.flatnonzero(block == hi))
        close = v[one] @ v[two].T >= cosine - 1e-12
        i, j = np.nonzero(np.triu(close, 1) if lo == hi else close)
        i, j = one[i], two[j]
        if not len(i):
            return []
        dim = v.shape[1]
        tables, k = plan(rows, dim, crowd=crowd)
        some = np.unique(np.concatenate([i, j]))
        code = np.zeros((m, tables, 1 + PROBES), dtype=np.int64)
        code[some] = codes(v[some], tables, k)
        mine = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), CHUNK):  # codes of a bounded number of pairs at a time
            a, b = i[at : at + CHUNK], j[at : at + CHUNK]
            exact = (v[a] * v[b]).sum(axis=1) >= cosine
            met = meets(code[a][:, : tab + 1], code[b][:, : tab + 1])
            earlier = (met[:, :tab] >= 0).any(axis=(1, 2)) if tab else np.zeros(len(a), dtype=bool)
            here = np.where(met[:, tab] < 0, np.iinfo(np.int64).max, met[:, tab]).min(axis=1)
            first = exact & ~earlier & (here < np.iinfo(np.int64).max)
            first[first] = _bucket(dim, tab, here[first]) == bucket
            mine[at : at + CHUNK] = first
        i, j = i[mine], j[mine]
        if not len(i):
            return []
        weight, rep = np.array(part["weight"]), part["rep"]
        links = np.bincount(i, weights=weight[j], minlength=m) + np.bincount(j, weights=weight[i], minlength=m)
        out: list[tuple] = [(rep[x], None, int(links[x])) for x in np.flatnonzero(links)]
        parent = list(range(m))
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a != b:
                parent[b] = a
                out.append((rep[a], rep[b], 0))
        return out

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _framed(_grouped(frames, ("bucket", "tab", "rep", "weight", "vec", "block"), group), ["a", "b", "n"]):
            yield frame.astype({"b": "Int64"})

    return compare


def _raw(kind: str):
    def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["vec"] = [np.asarray(v, dtype=kind).tobytes() for v in frame["vec"]]
            yield frame

    return raw


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` of buckets as pairs of blocks (lo, hi), sorted by them; buckets of one row are left out."""
    sizes = rows.groupBy("bucket", "tab").agg(F.count("*").alias("m")).where("m > 1").select("bucket", "tab", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    placed = rows.join(sizes, ["bucket", "tab"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")
    return placed.repartition("bucket", "tab", "lo", "hi").sortWithinPartitions("bucket", "tab", "lo", "hi", "rep")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, crowd: int = CROWD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing; nor do vectors of
    different lengths with each other. Repeated rows are vectors of their own that link with each other; rows that
    share a vec_id are one node of a component. A row without a vec_id links with nothing and has no component. An
    empty table gives no rows. Other columns are not read.
    """
    element = vectors.schema[embedding].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if kind == "<f4" else "array<double>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~odd & F.exists("vec", lambda x: x != 0)
    key = F.unhex(F.md5(F.concat_ws(",", F.xxhash64("vec").cast("string"), F.xxhash64(F.lit(1), "vec").cast("string"))))
    rows = rows.withColumn("key", F.when(F.coalesce(good, F.lit(False)), key))
    with Scratch(vectors.sparkSession) as scratch:
        classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
        classes = scratch.table(classes.select("key", F.monotonically_increasing_id().alias("cid"), "rep", "weight", "vec"))
        n, total = classes.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
        hashed = scratch.table(classes.select(F.col("cid").alias("rep"), "vec").mapInPandas(_hashed(n, kind, crowd), HASHED_DDL))
        near = scratch.table(_dealt(hashed, SKETCH_BLOCK).mapInPandas(_near(cosine), "bucket long, tab int, rep long").distinct())
        raw = classes.select(F.col("cid").alias("rep"), "weight", "vec").mapInPandas(_raw(kind), "rep long, weight long, vec binary")
        found = scratch.table(_dealt(near.join(raw, "rep"), BLOCK).mapInPandas(_compare(n, kind, crowd, cosine), "a long, b long, n long"))

        links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "cid")
        comps = components(found.where("b is not null").select("a", "b"), scratch)
        comps = comps.unionByName(comps.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "cid")
        linked = scratch.table(classes.drop("vec").join(links, "cid", "left").join(comps, "cid", "left").where("weight > 1 or links is not null").withColumn("component", F.coalesce("component", "cid")))
        heads = scratch.table(linked.groupBy("component").agg(F.min("rep").alias("head"), F.count("*").alias("n")))
        index = look_up(linked, heads, "component", "n", linked.count()).select("key", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "head")
        out = look_up(scratch.table(rows.select("vec_id", "key")), scratch.table(index), "key", "weight", total)
        out = cut(out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("head", "vec_id")).alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
