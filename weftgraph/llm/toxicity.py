"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

A window is one word with its bounding blanks. (Windows of several words were tried and measured: toxic language sits
in single words among ordinary ones, and longer windows drown it; the README has the figures.) A compressor cannot show
much on ten bytes, so a window is written as its overlapping character pairs, four bytes for each pair: text that a
dictionary holds is then one long match, and text that it lacks costs several short ones. The margin of a window is its
compressed length under the ordinary dictionary less that under the toxic one.

Both classes share most of their language, so the toxic dictionary is trained on what sets toxic text apart: windows
with a character n-gram whose rate in toxic text (by distinct contexts, for a toxic document may have many copies) is
RATIO times its rate in ordinary text. No window decides by being on that list: every window of a document counts, by
its margin. The odds of a margin are those of its frequency in toxic and in ordinary documents, measured by
cross-fitting: dictionaries of either half of the texts are held against the other half. A document's raw score is the
sum of its windows' log odds, calibrated by isotonic regression on the same half; its score is the mean of both models.

Training is on the driver and on bounded samples (``SAMPLE``, ``TRAIN_WINDOWS``).
"""

from __future__ import annotations

import math
import pickle
import random
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from operator import add

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.labelled import documents, held_out, samples
from weftgraph.llm.workers import strings, task

#: Most training texts of each class, and most windows that a dictionary is trained on (a random sample beyond that).
SAMPLE, TRAIN_WINDOWS = {1: 4_000, 0: 8_000}, 200_000
#: Dictionary sizes in bytes, segment lengths, and how often a window counts at most; the compression level of all windows.
TOXIC, ORDINARY, LEVEL = (8_192, 32, 30), (400_000, 64, 8), 9
#: Windows too few for the trainer are a dictionary themselves, up to this many bytes.
SMALL_BYTES = 4_096
#: N-grams that set toxic windows apart: their lengths, least contexts, and least ratio of the rates.
GRAMS, CONTEXTS, RATIO = (5, 6, 7), 4, 20
#: Margins are counted in bins of two bytes, up to the last one; one window of each bin is added to either class.
BIN, BINS = 2, 21
#: Words above this many characters are windows of this width that overlap by half.
WIDTH = 48
#: Windows whose margins a scoring task remembers (and two chunks' above that), those used lately when more turn up, and
#: windows that make a chunk: texts are scored together up to it, longer texts piece by piece.
CACHE, CHUNK = 600_000, 100_000
THRESHOLD = 0.3


def windows(text: str) -> list[str]:
    """Windows of a text in their order, in lower case."""
    ws = text.lower().split()
    if max(map(len, ws), default=0) <= WIDTH:
        return ws
    return [p for w in ws for p in ([w] if len(w) <= WIDTH else [w[i : i + WIDTH] for i in range(0, len(w) - WIDTH // 2, WIDTH // 2)])]


class PairCode(dict):
    """The window's character pairs, each as four bytes of its hash."""

    def __missing__(self, pair: str) -> bytes:
        if len(self) > 1 << 18:
            self.clear()
        code = self[pair] = blake2b(pair.encode("utf-8", "surrogatepass"), digest_size=4).digest()
        return code

    def __call__(self, window: str) -> bytes:
        w = f" {window} "
        return b"".join(map(self.__getitem__, map(add, w, w[1:])))


def _grams(window: str, n: int) -> set[str]:
    w = f" {window} "
    return {w[i : i + n] for i in range(len(w) - n + 1)}


def _contexts(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct windows, how often each occurs, and between how many distinct pairs of neighbours."""
    ids: dict[str, int] = {}
    seq = array("q", [-1])
    for text in texts:
        seq.extend(ids.setdefault(w, len(ids)) for w in windows(text))
        seq.append(-1)
    s = np.frombuffer(seq, dtype=np.int64)
    at = np.flatnonzero(s >= 0)
    here, before, after = s[at].astype(np.uint64), s[at - 1].astype(np.uint64), s[at + 1].astype(np.uint64)
    around = (before * np.uint64(0x9E3779B97F4A7C15) + after) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(28)
    places = np.unique(here << np.uint64(36) | around) >> np.uint64(36)
    return list(ids), np.bincount(here.astype(np.int64), minlength=len(ids)), np.bincount(places.astype(np.int64), minlength=len(ids))


def telling_windows(toxic: list[str], ordinary: Counter) -> Counter:
    """Windows of the toxic texts that an n-gram sets apart from ordinary ones, with their counts."""
    names, counts, contexts = _contexts(toxic)
    scale = RATIO * int(counts.sum()) / max(1, ordinary.total())
    marked: set[str] = set()
    for n in GRAMS:  # one length at a time, for memory
        found: Counter = Counter()
        for w, c in zip(names, contexts.tolist(), strict=True):
            for g in _grams(w, n):
                found[g] += c
        telling = {g: c for g, c in found.items() if c >= max(CONTEXTS, scale)}
        del found
        plain: Counter = Counter()
        for w, c in ordinary.items():
            for g in _grams(w, n):
                if g in telling:
                    plain[g] += c
        apart = {g for g, c in telling.items() if c >= scale * (plain[g] + 1)}
        marked.update(w for w in names if not apart.isdisjoint(_grams(w, n)))
    return Counter({w: c for w, c in zip(names, counts.tolist(), strict=True) if w in marked})


def _dictionary(counts: Counter, size: int, segment: int, most: int) -> bytes:
    code = PairCode()
    picked = [w for w in sorted(counts) for _ in range(min(counts[w], most))]
    random.Random(7).shuffle(picked)
    made = [code(w) for w in picked[:TRAIN_WINDOWS]]
    del picked
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, made, k=segment, d=8).as_bytes()
        except zstandard.ZstdError:
            size //= 2  # too few samples for a dictionary of this size
    return b"".join(dict.fromkeys(made))[-SMALL_BYTES:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes] | None:
    """(toxic, ordinary) dictionaries; None where no window sets the toxic texts apart."""
    known: Counter = Counter()
    for text in ordinary:
        known.update(windows(text))
    marked = telling_windows(toxic, known)
    return (_dictionary(marked, *TOXIC), _dictionary(known, *ORDINARY)) if marked else None


class CompressionModel:
    """Two dictionaries, the log odds of margins and a calibration; small enough to ship with a task (under 1 MB)."""

    def __init__(self, toxic: bytes, ordinary: bytes, odds: list[float], calibration: list[tuple[float, float]]):
        self.toxic, self.ordinary, self.odds, self.calibration = toxic, ordinary, odds, calibration
        self._ready = False

    def __getstate__(self) -> tuple:
        return self.toxic, self.ordinary, self.odds, self.calibration

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _start(self) -> None:
        def lengths(dictionary: bytes) -> Callable[[list[bytes]], np.ndarray]:
            held = zstandard.ZstdCompressionDict(dictionary)
            held.precompute_compress(level=LEVEL)
            by = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
            return lambda coded: np.fromiter(map(len, by.multi_compress_to_buffer(coded, threads=1)), np.int64, len(coded))

        self._by_toxic, self._by_ordinary, self._ready = lengths(self.toxic), lengths(self.ordinary), True

    def margins(self, coded: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, for windows written as pairs. All go through one
        dictionary before the other: taken in turns they'd push each other out of the processor's cache."""
        if not self._ready:
            self._start()
        return self._by_ordinary(coded) - self._by_toxic(coded)

    def bins(self, coded: list[bytes]) -> np.ndarray:
        return np.minimum(BINS - 1, np.maximum(0, self.margins(coded)) // BIN)

    def raw(self, bins: list[int]) -> float:
        return math.fsum(n * o for n, o in zip(bins, self.odds, strict=True) if n)

    def probability(self, bins: list[int]) -> float:
        """Linear interpolation over the calibration points; the least of them for a text without windows."""
        at, p = zip(*self.calibration, strict=True)
        return float(np.interp(self.raw(bins), at, p)) if len(at) > 1 and any(bins) else p[0]


def _isotonic(raws: list[float], ys: list[int]) -> list[tuple[float, float]]:
    """Pool adjacent violators on (raw, y), with one smoothing row of the common rate in each pool."""
    pools: list[list[float]] = []
    for x, y in sorted(zip(raws, ys, strict=True)):
        if pools and pools[-1][2] == x:
            pools[-1][0] += y
            pools[-1][1] += 1
        else:
            pools.append([y, 1, x, x])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            y2, n2, _, high = pools.pop()
            pools[-1][0] += y2
            pools[-1][1] += n2
            pools[-1][3] = high
    points: list[tuple[float, float]] = []
    rate = sum(ys) / len(ys) if ys else 0.0
    for y, n, low, high in pools:
        p = (y + rate) / (n + 1)
        p = max(p, points[-1][1]) if points else p
        points += [(low, p)] if low == high else [(low, p), (high, p)]
    return points or [(0.0, 0.0)]


class Committee:
    """Models whose scores are averaged. Texts are cut into windows once, and what all models make of one is remembered."""

    def __init__(self, members: list[CompressionModel]):
        self.members = members
        self._code, self._known, self._older = PairCode(), {}, {}

    def __reduce__(self) -> tuple:
        return Committee, (self.members,)  # without what it remembers

    def _kinds(self, distinct: set[str]) -> dict[str, int]:
        """Windows' bins in all models as one number, the first model's its lowest digit; these windows are among the keys."""
        if len(self._known) >= CACHE // 2:
            self._known, self._older = {}, self._known
        known, older, new = self._known, self._older, []
        for w in distinct.difference(known):
            kind = older.get(w)
            if kind is None:
                new.append(w)
            else:
                known[w] = kind
        if new:
            new.sort()  # alike ones meet the same places of a dictionary
            coded = [self._code(w) for w in new]
            known.update(zip(new, sum(m.bins(coded) * BINS**i for i, m in enumerate(self.members)).tolist(), strict=True))
        return known

    def _count(self, chunk: list[tuple[list[list[int]], list[str]]]) -> None:
        kinds = self._kinds(set().union(*(ws for _, ws in chunk)))
        for row, ws in chunk:
            for kind, n in Counter(map(kinds.__getitem__, ws)).items():
                for bins in row:
                    kind, b = divmod(kind, BINS)
                    bins[b] += n

    def bins(self, texts: Iterable[str]) -> list[list[list[int]]]:
        """For each text and each model, the windows in each bin of margins."""
        rows, chunk, n = [], [], 0
        for text in texts:
            rows.append([[0] * BINS for _ in self.members])
            ws = windows(text)
            for i in range(0, len(ws), CHUNK):
                chunk.append((rows[-1], ws[i : i + CHUNK]))
                n += len(chunk[-1][1])
                if n >= CHUNK:
                    self._count(chunk)
                    chunk, n = [], 0
        self._count(chunk)
        return rows

    def scores(self, texts: Iterable[str]) -> list[float]:
        if not self.members:
            return [0.0 for _ in texts]
        return [math.fsum(m.probability(b) for m, b in zip(self.members, bins, strict=True)) / len(self.members) for bins in self.bins(texts)]

    def score(self, text: str) -> float:
        return self.scores([text])[0]


#: Scores every text 0.
NOTHING = Committee([])


def _calibrated(trained: tuple[bytes, bytes], toxic: list[str], ordinary: list[str]) -> CompressionModel:
    """Odds of margins and calibration from texts that the dictionaries weren't trained on."""
    model = CompressionModel(*trained, [0.0] * BINS, [(0.0, 0.0)])
    alone = Committee([model])
    rows = [(bins, y) for y, texts in ((0, ordinary), (1, toxic)) for (bins,) in alone.bins(texts)]
    counts = [np.sum([b for b, y in rows if y == label] or [[0] * BINS], axis=0) + 1.0 for label in (0, 1)]
    model.odds = (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).tolist()
    model.calibration = _isotonic([model.raw(b) for b, _ in rows], [y for _, y in rows])
    return CompressionModel(*model.__getstate__())  # without what it remembers


def train(toxic: list[str], ordinary: list[str]) -> Committee:
    """Two models, each with dictionaries of one half of the texts and calibrated on the other. Without toxic text all score 0."""
    found = [(i, dictionaries(toxic[i::2], ordinary[i::2])) for i in (0, 1)]
    return Committee([_calibrated(d, toxic[1 - i :: 2], ordinary[1 - i :: 2]) for i, d in found if d is not None])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: dict[int, int] | None = None) -> Committee:
    """Train on bounded samples of the labelled rows outside the held-out fold."""
    texts = samples(docs, labels, label, most or SAMPLE, doc_id, text)
    return train(texts[1], texts[0])


def scorer(docs: DataFrame, model: Committee):
    """The model as an Arrow-batched column function; each task unpacks it once, and its memory goes with the task."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = pickle.loads(held.value)
        for texts in batches:
            yield pa.array(own.scores(strings(texts)), pa.float64())

    return F.arrow_udf(task(scored), "double")


def keep(docs: DataFrame, model: Committee, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose score stays below the threshold, with all their columns; null texts count as empty."""
    return docs.where(scorer(docs, model)(F.col(text)) < threshold)


def score(docs: DataFrame, model: Committee, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null texts count as empty; an empty text has no window and gets the lowest calibrated score. Repeated rows and ties are
    scored alike. An empty table gives no rows. Columns beside doc_id and text are not read.
    """
    rows = documents(docs, doc_id, text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(docs, model)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on the labelled rows and score every document."""
    return score(docs, fit(docs, labels, doc_id, text), doc_id, text)
