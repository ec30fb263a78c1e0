"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id.

Only suffixes that may repeat are sorted. Each string of LENGTH bytes holds grams of GRAM bytes, and the one with the
smallest hash, its anchor, depends on the string alone: equal strings have equal anchors. Neighbouring strings with one
anchor make a stretch.

1. The anchors of all texts are dealt out by hash, as packed columns; those of two texts or more are open. A task sends
   an anchor it met in many texts twice only, and hands the others through, for it knows them to be open.
2. The stretches of open anchors are dealt out by anchor. Where they meet, ``settle`` sorts their suffixes: equal
   stretches first become one; multikey quicksort, on characters of eight bytes and for all groups at once, orders
   suffixes to the shallow depth, and blind tries order the groups that are still equal there. Suffixes that agree for
   LENGTH bytes are one string, whose smallest doc_id owns it; the string goes from all other documents.
3. Stretches of a hot anchor (over 1/HEAVY of all open ones) are settled in the task that made them. Only strings that
   no smaller doc_id takes there go on, dealt out by their own bytes, and are settled again: the owner wins each time.
4. Removed spans meet their texts again and are cut out.

Equal texts need no suffixes: all but the one with the smallest doc_id go whole, found by SHA-256, and take no part in the
steps above. Rows that a blocked Bloom filter of such copies may hold are shuffled to find out; a filter that is too
small for them sends more rows there, and changes nothing else. Cut hashes in step 1 only open more anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.llm.exact_dedup import key_filter, parted, passing
from weftgraph.llm.skew import HEAVY, look_up
from weftgraph.llm.workers import task
from weftgraph.session import Scratch, cut

#: Bytes of a string, of a gram, and of a character of the quicksort; characters to the shallow depth.
LENGTH, GRAM, CHARACTER, SHALLOW = 50, 16, 8, 3
#: Strings of one stretch at most.
STRINGS = 64
#: Bytes of text of a bucket of anchors, and of text or stretches that a task holds before it deals them out.
BUCKET_BYTES, HELD_BYTES = 4 << 20, 16 << 20
#: Order of a null doc_id: after all others.
LAST = 2**63 - 1
#: Bytes of a hash that step 1 moves.
CUT = 6

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 8 * CUT) - 1)

ANCHORS = pa.schema([("bucket", pa.int64()), ("known", pa.bool_()), ("anchors", pa.binary()), ("texts", pa.binary())])
ANCHORS_DDL = "bucket long, known boolean, anchors binary, texts binary"
OPEN = pa.schema([("text_key", pa.int64()), ("anchor", pa.int64())])
OPEN_DDL = "text_key long, anchor long"
STRETCHES = pa.schema([("bucket", pa.int64()), ("spans", pa.bool_()), *[(c, pa.binary()) for c in ("anchor", "at", "row", "start", "count", "body")]])
STRETCHES_DDL = "bucket long, spans boolean, anchor binary, at binary, row binary, start binary, count binary, body binary"
SPANS = pa.schema([(c, pa.int64()) for c in ("at", "row", "first", "end")])
SPANS_DDL = "at long, row long, first long, end long"
CUTS = pa.schema([("at", pa.int64()), ("row", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
CUTS_DDL = "at long, row long, n_removed long, n_spans long, kept_sha256 string"


# ---- anchors ----


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each gram, by doubling."""
    x, m = _BYTES[data], 1
    while m < GRAM:
        x = (x[:-m] * _MULTIPLIER) ^ (x[m:] + (x[:-m] >> np.uint64(29)))
        m *= 2
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIER
    return x ^ (x >> np.uint64(29))


def stretches(body: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first string, number of strings) of each stretch, STRINGS at most; nothing for texts that are shorter."""
    if len(body) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    low, m, width = _gram_hashes(np.frombuffer(body, np.uint8)), 1, length - GRAM + 1
    while 2 * m <= width:
        low, m = np.minimum(low[:-m], low[m:]), 2 * m
    if rest := width - m:
        low = np.minimum(low[:-rest], low[rest:])
    begins = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    sizes = np.diff(np.append(begins, len(low)))
    if (sizes > STRINGS).any():
        pieces = -(-sizes // STRINGS)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begins, sizes = np.repeat(begins, pieces) + nth * STRINGS, np.minimum(np.repeat(sizes, pieces) - nth * STRINGS, STRINGS)
    return low[begins], begins, sizes


def _packed(x: np.ndarray) -> bytes:
    """The CUT low bytes of each hash."""
    return np.ascontiguousarray(np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(-1, 8)[:, :CUT]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // CUT, 8), np.uint8)
    wide[:, :CUT] = np.frombuffer(data, np.uint8).reshape(-1, CUT)
    return wide.view(np.uint64).ravel()


def _buckets(x: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors are small hashes, so they are mixed again."""
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLIER
    return (((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _dealt(anchors: np.ndarray, texts: np.ndarray, buckets: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows of ANCHORS: of each anchor two texts, dealt out by its hash; the others of three texts or more as known."""
    order = np.lexsort((texts, anchors))
    anchors, texts = anchors[order], texts[order]
    fresh = np.concatenate(([True], anchors[1:] != anchors[:-1]))
    new = fresh | np.concatenate(([True], texts[1:] != texts[:-1]))
    anchors, texts, fresh = anchors[new], texts[new], fresh[new]
    nth = np.arange(len(anchors)) - np.maximum.accumulate(np.where(fresh, np.arange(len(anchors)), 0))
    asked = nth < 2
    order = np.flatnonzero(asked)[np.argsort(_buckets(anchors[asked], buckets), kind="stable")]
    of = _buckets(anchors[order], buckets)
    ends = np.flatnonzero(np.concatenate((of[1:] != of[:-1], [True]))) + 1
    rows, begin = [], 0
    for end in ends.tolist():
        part = order[begin:end]
        rows.append((int(of[begin]), False, _packed(anchors[part]), _packed(texts[part])))
        begin = end
    known = np.flatnonzero(~asked)
    for i in range(0, len(known), 65_536):
        part = known[i : i + 65_536]
        rows.append(((seed + i // 65_536) * 7919 % buckets, True, _packed(anchors[part]), _packed(texts[part])))
    for i in range(0, len(rows), 256):
        yield _batch(rows[i : i + 256], ANCHORS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _number(batch: pa.RecordBatch, name: str) -> list[int]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _bodies(batch: pa.RecordBatch, name: str = "body") -> Iterator[bytes]:
    """One binary value at a time."""
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py()


def anchors_of(buckets: int, held_bytes: int = HELD_BYTES):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, keys, seen, held, flushed = [], [], set(), 0, 0
        for batch in batches:
            for key, row, body in zip(_number(batch, "text_key"), _number(batch, "row"), _bodies(batch), strict=True):
                if len(body) < LENGTH or (row, len(body)) in seen:
                    continue  # a copy of this task's: the first stands for it
                seen.add((row, len(body)))
                at = np.unique(stretches(body)[0])
                found.append(at)
                keys.append(np.full(len(at), key, np.int64).view(np.uint64))
                held += len(body)
                if held > held_bytes:
                    yield from _dealt(np.concatenate(found), np.concatenate(keys), buckets, flushed)
                    found, keys, seen, held, flushed = [], [], set(), 0, flushed + 1
        if found:
            yield from _dealt(np.concatenate(found), np.concatenate(keys), buckets, flushed)

    return task(anchors)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each bucket; they arrive in its order."""
    last, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["bucket"] != last:
                yield rows
                rows = []
            last = row["bucket"]
            rows.append(row)
    if rows:
        yield rows


@task
def open_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, anchor) of the anchors that two texts or more hold."""
    for rows in _by_bucket(batches):
        told = [(_unpacked(r["texts"]), _unpacked(r["anchors"])) for r in rows if r["known"]]
        asked = [r for r in rows if not r["known"]]
        if asked:
            anchors, texts = (np.concatenate([_unpacked(r[c]) for r in asked]) for c in ("anchors", "texts"))
            order = np.argsort(anchors, kind="stable")
            anchors, texts = anchors[order], texts[order]
            begins = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
            several = np.minimum.reduceat(texts, begins) != np.maximum.reduceat(texts, begins)
            several = np.repeat(several, np.diff(np.append(begins, len(anchors))))
            told.append((texts[several], anchors[several]))
        for texts, anchors in told:
            yield pa.record_batch([pa.array(texts.view(np.int64)), pa.array(anchors.view(np.int64))], schema=OPEN)


# ---- deep-shallow sorting ----


def multikey_groups(words: np.ndarray, places: np.ndarray, groups: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in groups that agree on ``depth`` characters: their indexes, and where each group begins.

    ``words`` is the character that begins at each byte, ``places`` the suffixes, ``groups`` the beginnings of groups to
    sort within. Multikey quicksort, all groups in step: each is split into smaller, equal and larger at a pivot; the
    equal part goes on with the next character. Suffixes alone in a part are done: nothing equals them.
    """
    active, begins = np.arange(len(places)), groups
    depths = np.zeros(len(begins), np.int64)
    done, sizes_done = [], []
    draw = np.random.default_rng(len(places))
    while len(active):
        sizes = np.diff(np.append(begins, len(active)))
        group = np.repeat(np.arange(len(begins)), sizes)
        word = words[places[active] + CHARACTER * depths[group]]
        pivot = word[begins + (draw.random(len(begins)) * sizes).astype(np.int64)][group]
        side = (word > pivot).astype(np.int64) - (word < pivot) + 1
        # where each goes: the parts of a group follow each other, each in its former order
        part = 3 * group + side
        counts = np.bincount(part, minlength=3 * len(begins))
        starts = np.cumsum(counts) - counts
        to = np.empty(len(active), np.int64)
        for s in range(3):
            mine = side == s
            ranks = np.cumsum(mine) - 1
            first = ranks[begins] - (mine[begins] - 1)  # members of earlier groups
            to[mine] = (starts[3 * group + s] + ranks - first[group])[mine]
        moved = np.empty_like(active)
        moved[to] = active
        depths = np.repeat(depths, 3) + np.tile([0, 1, 0], len(begins))
        live = counts > 1
        ready = live & (depths >= depth)
        part = np.repeat(np.arange(len(counts)), counts)
        done.append(moved[ready[part]])
        sizes_done.append(counts[ready])
        going = live & ~ready
        active, depths, sizes = moved[going[part]], depths[going], counts[going]
        begins = np.cumsum(sizes) - sizes
    return (np.concatenate(done), np.concatenate(sizes_done)) if done else (np.empty(0, np.int64), np.empty(0, np.int64))


class BlindTrie:
    """Strings of one length that agree to some depth: nodes know a depth and the next byte of each branch, no more.

    A string goes down by the bytes at the nodes' depths, blind to those between, and is compared once, with the leaf
    it reaches. Where it differs first, it branches off.
    """

    def __init__(self, text: bytes, length: int):
        self.text, self.length, self.root = text, length, None

    def add(self, place: int) -> list[int]:
        """The leaf of the string at ``place``: a list that begins with the place of the first string equal to it."""
        text, length = self.text, self.length
        if self.root is None:
            self.root = [place]
            return self.root
        node = self.root
        while type(node) is tuple:
            branches = node[1]
            node = branches.get(text[place + node[0]]) or next(iter(branches.values()))
        one, other = text[place : place + length], text[node[0] : node[0] + length]
        if one == other:
            return node
        split = (int.from_bytes(one, "big") ^ int.from_bytes(other, "big")).bit_length()
        split = length - 1 - (split - 1) // 8
        leaf = [place]
        above, node = None, self.root
        while type(node) is tuple and node[0] < split:
            above, node = node, node[1][one[node[0]]]
        if type(node) is tuple and node[0] == split:
            node[1][one[split]] = leaf
            return leaf
        branch = (split, {one[split]: leaf, other[split]: node})
        if above is None:
            self.root = branch
        else:
            above[1][one[above[0]]] = branch
        return leaf


def owned_elsewhere(text: bytes, places: np.ndarray, owners: np.ndarray, groups: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each string (at ``places`` of ``text``, of a document ``owners``): does a smaller document hold it?

    Equal strings lie in one of ``groups`` (beginnings).
    """
    taken = np.zeros(len(places), bool)
    if not len(places):
        return taken
    padded = text + bytes(CHARACTER * SHALLOW)
    words = np.ndarray((len(padded) - CHARACTER + 1,), ">u8", padded, 0, (1,)).astype(np.uint64)
    found, sizes = multikey_groups(words, places, groups)
    if not len(found):
        return taken
    begins = np.cumsum(sizes) - sizes
    mixed = np.minimum.reduceat(owners[found], begins) != np.maximum.reduceat(owners[found], begins)
    found, sizes = found[np.repeat(mixed, sizes)], sizes[mixed]
    at, who = places[found].tolist(), owners[found].tolist()
    leaves: list[list[int]] = []
    least: dict[int, int] = {}
    begin = 0
    for size in sizes.tolist():
        trie = BlindTrie(text, length)
        for i in range(begin, begin + size):
            leaf = trie.add(at[i])[0]
            leaves.append(leaf)
            if (held := least.get(leaf)) is None or who[i] < held:
                least[leaf] = who[i]
        begin += size
    taken[found] = np.fromiter(map(least.__getitem__, leaves), np.int64, len(leaves)) < owners[found]
    return taken


class Stretches:
    """Columns of stretches, as they are dealt out."""

    KINDS = {"anchor": np.uint64, "at": np.int64, "row": np.int64, "start": np.int64, "count": np.int16}

    def __init__(self, columns: dict[str, np.ndarray], body: bytes):
        self.columns, self.body = columns, body
        for name, values in columns.items():
            setattr(self, name, values)
        self.length = columns["count"].astype(np.int64) + LENGTH - 1
        self.offset = np.cumsum(self.length) - self.length

    @classmethod
    def read(cls, rows: list[dict]) -> Stretches:
        return cls({c: np.concatenate([np.frombuffer(r[c], k) for r in rows]) for c, k in cls.KINDS.items()}, b"".join(r["body"] for r in rows))

    def rows(self, buckets: np.ndarray) -> list[tuple]:
        order = np.argsort(buckets, kind="stable")
        of = buckets[order]
        out, begin = [], 0
        for end in (np.flatnonzero(np.concatenate((of[1:] != of[:-1], [True]))) + 1).tolist() if len(of) else []:
            part = order[begin:end]
            body = b"".join(self.body[o : o + n] for o, n in zip(self.offset[part].tolist(), self.length[part].tolist(), strict=True))
            out.append((int(of[begin]), False, *[np.ascontiguousarray(self.columns[c][part], k).tobytes() for c, k in self.KINDS.items()], body))
            begin = end
        return out

    def where(self, mine: np.ndarray) -> Stretches:
        part = np.flatnonzero(mine)
        body = b"".join(self.body[o : o + n] for o, n in zip(self.offset[part].tolist(), self.length[part].tolist(), strict=True))
        return Stretches({c: v[part] for c, v in self.columns.items()}, body)


def settle(s: Stretches) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Spans that go (columns of SPANS), and the strings left: (stretch, nth string) of each."""
    known: dict[bytes, int] = {}
    body = s.body
    kind = np.fromiter((known.setdefault(body[o : o + n], len(known)) for o, n in zip(s.offset.tolist(), s.length.tolist(), strict=True)), np.int64, len(s.offset))
    order = np.lexsort((s.at, kind))
    begins = np.flatnonzero(np.concatenate(([True], kind[order][1:] != kind[order][:-1])))
    head = order[begins]  # of each kind: the stretch with the smallest document
    whole = s.at > s.at[head][kind]
    # the strings of each kind, in groups by anchor
    head = head[np.argsort(s.anchor[head], kind="stable")]
    count = s.count[head].astype(np.int64)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    of = np.repeat(head, count)
    anchors = s.anchor[of]
    groups = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    taken = owned_elsewhere(body, s.offset[of] + nth, s.at[of], groups)
    # runs of strings that go, and of those left, for each stretch that isn't gone whole
    base = np.zeros(len(s.at), np.int64)
    base[head] = np.cumsum(count) - count
    rest = np.flatnonzero(~whole)
    twin = np.zeros(len(known), np.int64)
    twin[kind[head]] = head
    count = s.count[rest].astype(np.int64)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    mine = np.repeat(rest, count)
    gone = taken[base[twin[kind[mine]]] + nth]
    edge = np.concatenate(([True], mine[1:] != mine[:-1])) if len(mine) else np.empty(0, bool)
    first = gone & (edge | ~np.concatenate(([False], gone[:-1])))
    last = gone & (np.concatenate((edge[1:], [True])) | ~np.concatenate((gone[1:], [False]))) if len(mine) else gone
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    all_of, part_of = np.flatnonzero(whole), mine[a]
    spans = {
        "at": np.concatenate((s.at[all_of], s.at[part_of])),
        "row": np.concatenate((s.row[all_of], s.row[part_of])),
        "first": np.concatenate((s.start[all_of], s.start[part_of] + nth[a])),
        "end": np.concatenate((s.start[all_of] + s.length[all_of], s.start[part_of] + nth[b] + LENGTH)),
    }
    return spans, mine[~gone], nth[~gone]


def _joined(spans: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Spans of a text that touch become one."""
    if not len(spans["at"]):
        return spans
    order = np.lexsort((spans["first"], spans["row"], spans["at"]))
    at, row, first, end = (spans[c][order] for c in ("at", "row", "first", "end"))
    change = np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])))
    text = np.cumsum(change) - 1
    reach = np.maximum.accumulate(end + text * (1 << 40)) - text * (1 << 40)  # a text has under 2^40 bytes
    begins = change | np.concatenate(([True], first[1:] > reach[:-1]))
    a = np.flatnonzero(begins)
    return {"at": at[a], "row": row[a], "first": first[a], "end": reach[np.append(a[1:], len(at)) - 1]}


def _settled_here(s: Stretches, buckets: int) -> list[tuple]:
    """Stretches of hot anchors: spans that go, and the strings left, one stretch each, dealt out by their bytes."""
    spans, of, nth = settle(s)
    spans = _joined(spans)
    rows = [(int(spans["first"].sum()) % buckets, True, b"", *[spans[c].tobytes() for c in ("at", "row", "first", "end")], b"")] if len(spans["at"]) else []
    places = (s.offset[of] + nth).tolist()
    strings = [s.body[p : p + LENGTH] for p in places]
    columns = {"anchor": s.anchor[of], "at": s.at[of], "row": s.row[of], "start": s.start[of] + nth, "count": np.ones(len(of), np.int16)}
    left = Stretches(columns, b"".join(strings))
    to = np.fromiter((int.from_bytes(hashlib.blake2b(x, digest_size=7).digest(), "big") % buckets for x in strings), np.int64, len(strings))
    return rows + left.rows(to)


def stretches_of(buckets: int, hot: list[int], held_bytes: int = HELD_BYTES):
    hot = np.array(sorted(hot), np.int64).view(np.uint64)

    def flush(columns: dict[str, list], body: list[bytes]) -> Iterator[pa.RecordBatch]:
        s = Stretches({c: np.concatenate(v).astype(Stretches.KINDS[c]) for c, v in columns.items()}, b"".join(body))
        heavy = np.isin(s.anchor & _LOW, hot)
        rows = s.where(~heavy).rows(_buckets(s.anchor[~heavy], buckets)) if heavy.any() else s.rows(_buckets(s.anchor, buckets))
        if heavy.any():
            rows += _settled_here(s.where(heavy), buckets)
        for i in range(0, len(rows), 64):
            yield _batch(rows[i : i + 64], STRETCHES)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, bodies, held = {c: [] for c in Stretches.KINDS}, [], 0
        for batch in batches:
            wanted = batch.column(batch.schema.get_field_index("anchors"))
            for i, (at, row, body) in enumerate(zip(_number(batch, "at"), _number(batch, "row"), _bodies(batch), strict=True)):
                anchor, start, count = stretches(body)
                mine = np.isin(anchor & _LOW, wanted[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                anchor, start, count = anchor[mine], start[mine], count[mine]
                bodies += [body[a : a + n + LENGTH - 1] for a, n in zip(start.tolist(), count.tolist(), strict=True)]
                for c, v in (("anchor", anchor), ("at", np.full(len(anchor), at)), ("row", np.full(len(anchor), row)), ("start", start), ("count", count)):
                    columns[c].append(v)
                held += int(count.sum()) + (LENGTH + 40) * len(count)
                if held > held_bytes:
                    yield from flush(columns, bodies)
                    columns, bodies, held = {c: [] for c in Stretches.KINDS}, [], 0
        if bodies:
            yield from flush(columns, bodies)

    return task(dealt)


@task
def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each bucket's stretches, and those that came settled."""
    for rows in _by_bucket(batches):
        told = [{c: np.frombuffer(r[k], np.int64) for c, k in (("at", "at"), ("row", "row"), ("first", "start"), ("end", "count"))} for r in rows if r["spans"]]
        if asked := [r for r in rows if not r["spans"]]:
            told.append(_joined(settle(Stretches.read(asked))[0]))
        for spans in told:
            yield pa.record_batch([pa.array(spans[c]) for c in ("at", "row", "first", "end")], schema=SPANS)


@task
def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its spans."""
    for batch in batches:
        rows = []
        firsts, ends = (batch.column(batch.schema.get_field_index(c)) for c in ("firsts", "ends"))
        for i, (at, row, body) in enumerate(zip(_number(batch, "at"), _number(batch, "row"), _bodies(batch), strict=True)):
            first, end = (x[i].values.to_numpy(zero_copy_only=False) for x in (firsts, ends))
            one = _joined({"at": np.zeros(len(first), np.int64), "row": np.zeros(len(first), np.int64), "first": first, "end": end})
            first, end = one["first"].tolist(), one["end"].tolist()
            left = hashlib.sha256()
            for a, b in zip([0, *end], [*first, len(body)], strict=True):
                left.update(body[a:b])
            rows.append((at, row, sum(end) - sum(first), len(first), left.hexdigest()))
        yield _batch(rows, CUTS)


# ---- jobs ----


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(at, row, text_key, body) of every row: order, hash of the text, hash of both that step 1 moves, bytes."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("at"), body.alias("body"))
    rows = rows.withColumn("row", F.xxhash64("body"))
    return rows.select("at", "row", F.xxhash64("at", "row").bitwiseAND(F.lit((1 << 8 * CUT) - 1)).alias("text_key"), "body")


def removed_spans(docs: DataFrame, copies: DataFrame, scratch: Scratch, total: int, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, heavy: int = HEAVY) -> DataFrame:
    """(at, row, first, end): byte spans that go from texts, those of ``copies`` (at, row) left aside."""
    texts = _texts(docs, doc_id, text)
    buckets = max(1, total // bucket_bytes)
    dealt = lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket")
    gone = copies.select(F.xxhash64("at", "row").alias("key")).distinct()
    maybe, surely = parted(texts.withColumn("key", F.xxhash64("at", "row")), key_filter(gone, gone.count()))
    own = surely.unionByName(maybe.join(copies, ["at", "row"], "left_anti").select(*surely.columns)).select("text_key", "row", "body")
    anchors = own.mapInArrow(anchors_of(buckets), ANCHORS_DDL)
    found = scratch.table(dealt(anchors).mapInArrow(open_anchors, OPEN_DDL))
    bound = max(2, found.count() // heavy)
    hot = [r["anchor"] for r in found.groupBy("anchor").count().where(F.col("count") > bound).collect()]  # under ``heavy``, by counting
    wanted = found.groupBy("text_key").agg(F.collect_set("anchor").alias("anchors"))
    opened = texts.join(wanted, "text_key").select("at", "row", "body", "anchors")
    return dealt(opened.mapInArrow(stretches_of(buckets, hot), STRETCHES_DDL)).mapInArrow(settled, SPANS_DDL)


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts count as empty, and texts under LENGTH bytes lose nothing. A null doc_id comes after all others; rows of
    one doc_id are no smaller than each other, so what they share stays. Repeated rows get the same values. An empty
    table gives no rows, other columns are not read, and texts of any length are read whole.
    """
    with Scratch(docs.sparkSession) as scratch:
        all_rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("body"))
        all_rows = all_rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("at"), F.xxhash64("body").alias("row"), F.unhex(F.sha2("body", 256)).alias("sha"), F.length("body").cast("long").alias("n_bytes"))
        rows = scratch.table(all_rows)
        total, n = rows.agg(F.sum("n_bytes"), F.count("*")).first()
        index = scratch.table(rows.groupBy("sha").agg(F.min("at").alias("smallest"), F.count("*").alias("size")))
        known = scratch.table(look_up(rows, index.where("size > 1"), "sha", "size", n))
        copies = known.where("at > smallest").select("at", "row").distinct()
        spans = scratch.table(removed_spans(docs, copies, scratch, total or 0, doc_id, text, bucket_bytes, heavy))
        per_text = spans.groupBy("at", "row").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
        per_text = per_text.select("at", "row", F.col("spans.first").alias("firsts"), F.col("spans.end").alias("ends"))
        key = F.xxhash64("at", "row")
        texts = _texts(docs, doc_id, text).select("at", "row", "body")
        held = spans.select(key.alias("key")).distinct()
        with_spans = passing(texts.withColumn("key", key), key_filter(held, held.count())).select("at", "row", "body")
        cuts = with_spans.join(per_text, ["at", "row"]).mapInArrow(cut_out, CUTS_DDL).dropDuplicates(["at", "row"])
        copy = F.coalesce(F.col("at") > F.col("smallest"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
        out = known.join(cuts, ["at", "row"], "left")
        pick = lambda whole, part, none: F.when(copy, whole).otherwise(F.coalesce(part, none))
        columns = [pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"), pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans")]
        sha: Column = pick(F.lit(hashlib.sha256().hexdigest()), F.col("kept_sha256"), F.lower(F.hex("sha"))).alias("kept_sha256")
        return cut(out.select("doc_id", "n_bytes", *columns, sha))
