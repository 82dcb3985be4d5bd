"""Packing: length buckets whose boundaries minimise padding over all documents, and token-budget batches inside them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scatterwave.llm.common import whole_text
from scatterwave.runtime import broadcast_if_small, cut

BUCKETS = 16
#: Padded tokens of a batch. A document longer than this is a batch of its own.
TOKEN_BUDGET = 262_144
#: Rows that a ranking task aims at.
CELL_ROWS = 10_000


def byte_tokens(column: str = "text") -> Column:
    """Length in byte-level tokens: UTF-8 bytes and an end id. Other tokenizers bring a length column of their own."""
    return (F.octet_length(whole_text(column)) + 1).cast("long")


def _layer(layer: np.ndarray, L: np.ndarray, N: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``min_i layer[i] + L_j (N_j - N_i)`` over i < j, and the least such i, for j = 1..n.

    The best i never falls as j grows, so the middle j of a range halves the choices of both sides. All ranges of a
    depth are looked at together, in arrays of n and a bit numbers.
    """
    n = len(L)
    out, pick = np.zeros(n + 1, layer.dtype), np.zeros(n + 1, np.int64)
    first, last, low, high = (np.array([x], np.int64) for x in (1, n, 0, n - 1))
    while len(first):
        mid = (first + last) // 2
        sizes = np.minimum(high, mid - 1) - low + 1
        starts = np.cumsum(sizes) - sizes
        i = np.arange(sizes.sum()) - np.repeat(starts - low, sizes)
        own = np.repeat(mid, sizes)
        cost = layer[i] + L[own - 1] * (N[own] - N[i])
        least = np.minimum.reduceat(cost, starts)
        at = np.flatnonzero(cost == np.repeat(least, sizes))
        best = i[at[np.searchsorted(at, starts)]]
        out[mid], pick[mid] = least, best
        first, last, low, high = (np.concatenate(x) for x in ((first, mid + 1), (mid - 1, last), (low, best), (best, high)))
        some = first <= last
        first, last, low, high = first[some], last[some], low[some], high[some]
    return out, pick


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total of (bound x rows), by dynamic programming.

    Lengths are distinct and ascending, and none is left out or rounded. Equal costs take fewer buckets.
    """
    n = len(lengths)
    if not n:
        return []
    exact = int(lengths[-1]) * sum(map(int, counts)) < 2**62
    kind = np.int64 if exact else np.longdouble  # beyond, 64 bits of mantissa
    L, N = np.asarray(lengths, kind), np.concatenate([[0], np.cumsum(np.asarray(counts, kind))]).astype(kind)
    layer = np.concatenate([np.zeros(1, kind), L * N[1:]])
    totals, picks = [layer[n]], [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        layer, pick = _layer(layer, L, N)
        totals.append(layer[n])
        picks.append(pick)
    k, j, bounds = int(np.argmin(np.array(totals))), n, []
    while j > 0:
        bounds.append(int(lengths[j - 1]))
        j, k = (int(picks[k][j]), k - 1) if k > 0 else (0, 0)
    return bounds[::-1]


@dataclass(frozen=True)
class Bucket:
    bound: int
    rows: int
    per_batch: int


def plan_buckets(sized: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> list[Bucket]:
    """Histogram of all rows, then the boundaries. D distinct lengths sum to at least D^2 / 2, so a corpus of T tokens has at most sqrt(2 T)."""
    histogram = sized.groupBy("size").count().toArrow().to_pandas().sort_values("size")
    lengths, counts = histogram["size"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64)
    bounds = optimal_boundaries(lengths, counts, buckets)
    edges = np.searchsorted(lengths, bounds, side="right")
    per = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(counts)])[edges]])) if bounds else []
    return [Bucket(b, int(n), max(1, budget // b)) for b, n in zip(bounds, per)]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, bucket, padded_length, batch, slot``.

    A batch (``bucket, batch``) holds up to ``budget`` padded tokens. Inside a bucket rows stand in a pseudo-random,
    order (hash of doc_id, length and the row's place in the table, so that rows which repeat or lack an id are dealt out
    as well). Ranks are made of counts of cells of about ``CELL_ROWS`` rows, so no task ever ranks a whole bucket. Null
    and empty texts have the end id alone; an empty table gives no rows. Other columns may have any names.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id"), (byte_tokens() if length is None else length.cast("long")).alias("n_tokens"))
    sized = cut(sized.withColumn("size", F.greatest(F.col("n_tokens"), F.lit(1))).withColumn("row", F.monotonically_increasing_id()))
    plan = plan_buckets(sized, buckets, budget)
    if not plan:
        kind = dict(docs.dtypes)["doc_id"]
        return spark.createDataFrame([], f"doc_id {kind}, n_tokens long, bucket int, padded_length long, batch long, slot int")
    bucket = F.lit(0)
    for b in plan[:-1]:
        bucket = bucket + (F.col("size") > b.bound).cast("int")
    pick = lambda values: F.array(*[F.lit(v).cast("long") for v in values])[F.col("bucket")]
    mix = F.xxhash64("doc_id", "n_tokens", "row")
    placed = sized.withColumn("bucket", bucket.cast("int")).withColumn("mix", mix)
    placed = placed.withColumn("cell", F.pmod("mix", pick([max(1, -(-b.rows // CELL_ROWS)) for b in plan])))
    cells = placed.groupBy("bucket", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("bucket", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    known = sum(-(-b.rows // CELL_ROWS) for b in plan)
    inside = Window.partitionBy("bucket", "cell").orderBy("mix", "row")
    ranked = placed.withColumn("at", F.row_number().over(inside) - 1).join(broadcast_if_small(cells, known), ["bucket", "cell"])
    place, per = F.col("offset") + F.col("at"), pick([b.per_batch for b in plan])
    return ranked.select(
        "doc_id", "n_tokens", "bucket", pick([b.bound for b in plan]).alias("padded_length"), F.floor(place / per).cast("long").alias("batch"), F.pmod(place, per).cast("int").alias("slot")
    )
