"""Packing by optimal length buckets: dynamic programming over the global length histogram.

Every document has a length in tokens of the package's own encoder. Lengths fall into buckets; a batch holds documents
of one bucket, padded to the bucket's longest length, and as many of them as the token budget allows. The bucket
boundaries are those that need the fewest padding tokens over all documents, found exactly by dynamic programming over
the histogram of lengths.

The histogram holds every distinct length, so it has at most sqrt(2 * tokens of the table) rows, which the driver holds.
The padding of a bucket obeys the quadrangle inequality, so best cuts never move back as the last length grows: each
cut is sought only between those of its neighbours, in about n log n steps a bucket and whole numbers throughout.
Tokens are counted in Arrow-batched Python; the rest is DataFrame functions only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.llm.bpe import token_counter
from weftgraph.llm.sharding import with_slots
from weftgraph.session import cut

BUCKETS, BUDGET = 16, 16_384


def _cheapest(best: np.ndarray, first: int, docs: np.ndarray, toks: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of bins 0..j-1 with one more bucket, and where that bucket begins, for each j above ``first``.

    best[i]: least cost of bins 0..i-1, known from ``first`` on. Places are settled at halving strides, all of a stride
    at once; the first of equal places is taken.
    """
    n = len(top)
    cost, came = np.zeros(n + 1, dtype=np.int64), np.full(n + 1, first, dtype=np.int64)
    stride = 1 << (n - first).bit_length()
    while stride:
        js = np.arange(first + stride, n + 1, 2 * stride)
        if len(js):
            low = came[js - stride]
            high = np.where(js + stride <= n, came[np.minimum(js + stride, n)], n)
            sizes = np.minimum(high, js - 1) - low + 1
            starts = np.cumsum(sizes) - sizes
            i = np.arange(sizes.sum()) + np.repeat(low - starts, sizes)
            j = np.repeat(js, sizes)
            costs = best[i] + top[j - 1] * (docs[j] - docs[i]) - (toks[j] - toks[i])
            cost[js] = np.minimum.reduceat(costs, starts)
            hits = np.flatnonzero(costs == np.repeat(cost[js], sizes))
            came[js] = i[hits[np.searchsorted(hits, starts)]]
        stride //= 2
    return cost, came


def best_boundaries(counts: list[int], tokens: list[int], longest: list[int], buckets: int) -> tuple[list[int], int]:
    """Last bins of the at most ``buckets`` buckets with the least padding, and that padding.

    counts, tokens and longest: documents, sum of lengths and longest length of each bin, by length. The cost of a
    bucket of bins i..j is longest[j] * documents - tokens. Among equal costs the fewest buckets win.
    """
    n = len(counts)
    if not n:
        return [], 0
    docs, toks, top = (np.array(x, dtype=np.int64) for x in ([0, *counts], [0, *tokens], longest))
    docs, toks = np.cumsum(docs), np.cumsum(toks)
    best = np.concatenate([[0], top * docs[1:] - toks[1:]])  # one bucket
    totals, choice = [int(best[n])], [np.zeros(n + 1, dtype=np.int64)]
    for k in range(1, min(buckets, n)):
        best, came = _cheapest(best, k, docs, toks, top)
        totals.append(int(best[n]))
        choice.append(came)
    used = int(np.argmin(totals))
    ends, j = [], n
    for k in range(used, -1, -1):
        ends.append(j - 1)
        j = int(choice[k][j])
    return ends[::-1], totals[used]


def pack(docs: DataFrame, doc_id: str = "doc_id", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, pad_to, batch, place, padding.

    ``batch`` numbers the batches of a bucket, ``place`` the rows of a batch; both count from 0. A batch holds
    floor(budget / pad_to) rows, at least one: a bucket longer than the budget has one row a batch. ``n_tokens`` is the
    encoder's count of the whole text, or ``length`` where given; ``budget`` is in the same unit. Null and empty texts
    have length 0 and are packed with the shortest. Ties and repeated rows each get a place. An empty table gives no
    rows. Columns beside doc_id and the length's are not read.
    """
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.greatest(token_counter(docs)(F.col(text)) if length is None else length.cast("long"), F.lit(0)).alias("n_tokens")))
    bins = sorted(tuple(r) for r in rows.groupBy("n_tokens").count().collect())  # distinct lengths: see above
    ends, _ = best_boundaries([n for _, n in bins], [t * n for t, n in bins], [t for t, _ in bins], buckets)
    tops = [bins[e][0] for e in ends]
    bucket = sum((F.when(F.col("n_tokens") > F.lit(t), 1).otherwise(0) for t in tops[:-1]), F.lit(0)).cast("int")
    pad_to = F.element_at(F.array(*[F.lit(t).cast("long") for t in tops] or [F.lit(0).cast("long")]), F.col("bucket") + 1)
    placed = with_slots(rows.withColumn("bucket", bucket), "doc_id", "bucket").withColumn("pad_to", pad_to)
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("pad_to"), F.lit(1))), F.lit(1)).cast("long")
    return placed.select("doc_id", "n_tokens", "bucket", "pad_to", F.floor(F.col("slot") / room).cast("long").alias("batch"), (F.col("slot") % room).cast("long").alias("place"), (F.col("pad_to") - F.col("n_tokens")).alias("padding"))
