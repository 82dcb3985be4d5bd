"""SimHash near-dedup: fingerprints of 3-word shingles, linked through a sharded vantage-point tree."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from scatterwave.llm.common import arrow_map, dealt_anew, fresh, join_back, roots
from scatterwave.llm.components import connected_components
from scatterwave.runtime import broadcast_if_small, cut, ship

RADIUS = 2
#: Fingerprints that a shard aims at. The tree that assigns shards grows a level whenever these double, up to the
#: 131,072 shards that a driver can hold (10^9 fingerprints at SHARD_ROWS); beyond, shards grow and are split in blocks.
SHARD_ROWS, MAX_LEVELS = 8_192, 17
#: Sampled fingerprints for each shard, from which vantage points and radii are taken.
SAMPLE_PER_SHARD = 16
LEAF = 128
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included; A-Z lower-cased, words between ASCII white space.

    Fewer words than ``size``: the whole sequence is the one shingle. No words: none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)]))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(words) - size + 1)


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes; no hashes give zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 16_384):
        own = hashes[i : i + 16_384]
        counts += np.unpackbits(own.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch):
        fps = np.array([simhash(shingle_hashes(t)) for t in batch["text"]], np.uint64).view(np.int64)
        return {"doc_id": batch["doc_id"], "fp": fps}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long").select(F.col("doc_id").cast(kind), "fp")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build_router(sample: np.ndarray, levels: int):
    """Nested ``(vantage, radius, near, far)``; a leaf is its shard's number."""
    shards = iter(range(2 ** (levels + 1)))

    def grow(points: np.ndarray, depth: int):
        if depth == 0 or len(points) < 2:
            return next(shards)
        vantage = points[len(points) // 2]
        d = distance(points, vantage)
        radius = int(np.median(d))
        if (d <= radius).all():
            radius -= 1
        if not (d <= radius).any():
            return next(shards)
        return int(vantage), radius, grow(points[d <= radius], depth - 1), grow(points[d > radius], depth - 1)

    return grow(np.sort(sample), levels)


def route(tree, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``index, shard, home``: the one shard that owns a point, and each shard whose boundary lies within the radius."""
    found = []

    def walk(node, at: np.ndarray, home: np.ndarray):
        if not len(at):
            return
        if isinstance(node, int):
            found.append((at, np.full(len(at), node, np.int64), home))
            return
        vantage, mu, near, far = node
        d = distance(points[at], np.uint64(vantage)).astype(np.int64)
        inside = d <= mu
        go = d <= mu + radius
        walk(near, at[go], home[go] & inside[go])
        go = d > mu - radius
        walk(far, at[go], home[go] & ~inside[go])

    walk(tree, np.arange(len(points)), np.ones(len(points), bool))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def tree_links(points: np.ndarray, queries: np.ndarray, radius: int = RADIUS, leaf: int = LEAF):
    """Yields index pairs (point, query) within the radius, through a vantage-point tree over the points.

    A branch is entered only where the triangle inequality allows a match; pairs at leaves are compared exactly.
    """
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > leaf:
            vantage = points[p[len(p) // 2]]
            d = distance(points[p], vantage).astype(np.int64)
            mu = int(np.median(d))
            if (d <= mu).all():
                mu -= 1
            near = d <= mu
            if near.any():
                dq = distance(queries[q], vantage).astype(np.int64)
                stack.append((p[near], q[dq <= mu + radius]))
                stack.append((p[~near], q[dq > mu - radius]))
                continue
        step = max(1, 2**21 // len(p))
        for i in range(0, len(q), step):
            own = q[i : i + step]
            a, b = np.nonzero(distance(points[p][:, None], queries[own][None, :]) <= radius)
            yield p[a], own[b]


def shard_forest(points: np.ndarray, point_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All links of a shard, reduced to a spanning forest as they are found: memory grows with nodes, not with pairs."""
    ids, where = np.unique(np.concatenate([point_ids, query_ids]), return_inverse=True)
    at_p, at_q = where[: len(point_ids)], where[len(point_ids) :]
    parent, held, size = np.arange(len(ids)), [], 0

    def fold():
        nonlocal parent, held, size
        star = np.flatnonzero(parent != np.arange(len(ids)))
        a, b = (np.concatenate([x, *[h[k] for h in held]]) for k, x in enumerate((star, parent[star])))
        parent, held, size = roots(len(ids), a, b), [], 0

    for a, b in tree_links(points, queries, radius):
        a, b = at_p[a], at_q[b]
        apart = parent[a] != parent[b]
        held.append((a[apart], b[apart]))
        size += int(apart.sum())
        if size > 2_000_000:
            fold()
    fold()
    star = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[star], ids[parent[star]]


def link_classes(classes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``u, v`` between the ids of distinct fingerprints (``fp, rep``) that join everything within the radius.

    A bounded sample places the vantage points; every fingerprint is routed to the one shard that owns it and, as a
    query, to each shard whose boundary it may reach across. Shards larger than planned (fingerprints closer than any
    boundary can part) are split in blocks: their points are dealt out and their queries visit every block.
    """
    spark = classes.sparkSession
    ship(spark)
    n = classes.count()
    levels = min(MAX_LEVELS, max(0, int(np.ceil(np.log2(max(1, n / shard_rows))))))
    sample = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_PER_SHARD * 2**levels).toArrow().to_pandas()
    tree = spark.sparkContext.broadcast(build_router(sample["fp"].to_numpy(np.int64).view(np.uint64), levels))

    def deal(batch):
        fps = np.array(batch["fp"], np.int64)
        at, shard, home = route(tree.value, fps.view(np.uint64), radius)
        return {"shard": shard, "home": home, "fp": fps[at], "rep": np.array(batch["rep"], np.int64)[at]}

    dealt = cut(arrow_map(classes, deal, "shard long, home boolean, fp long, rep long"))
    sizes = dealt.groupBy("shard").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("n"))
    parts = lambda c, most, of: F.when(F.col(c) > most, F.ceil(F.col(c) / of)).otherwise(1).cast("int")
    sizes = sizes.select("shard", parts("homes", 4 * shard_rows, 4 * shard_rows).alias("nb"), parts("n", 64 * shard_rows, 64 * shard_rows).alias("ns"))
    spread = dealt.join(F.broadcast(sizes), "shard")  # 2 ** MAX_LEVELS rows at most
    mine, slice_ = F.pmod(F.xxhash64("fp"), F.col("nb")), F.pmod(F.xxhash64("fp", F.lit(7)), F.col("ns"))
    points = spread.filter("home").select("shard", mine.alias("block"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("slice"), F.lit(True).alias("point"), "fp", "rep")
    queries = spread.select("shard", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), slice_.alias("slice"), F.lit(False).alias("point"), "fp", "rep")
    both = points.select("shard", F.col("block").cast("int"), F.col("slice").cast("int"), "point", "fp", "rep").unionByName(queries.select("shard", F.col("block").cast("int"), F.col("slice").cast("int"), "point", "fp", "rep"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf[pdf["point"]], pdf[~pdf["point"]]
        u, v = shard_forest(p["fp"].to_numpy(np.int64).view(np.uint64), p["rep"].to_numpy(np.int64), q["fp"].to_numpy(np.int64).view(np.uint64), q["rep"].to_numpy(np.int64), radius)
        return pd.DataFrame({"u": u, "v": v})

    return both.groupBy("shard", "block", "slice").applyInPandas(search, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; ``component_id`` is the smallest doc_id reachable over links.

    Documents with equal fingerprints are one class before any search, so copies never meet in pairs. Rows that
    share a doc_id are one document with several texts. Rows without an id link to nothing and have no component.
    Null and empty texts have the fingerprint zero, which links like any other. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs))
    named = fps.filter("doc_id IS NOT NULL").withColumn("id", F.col("doc_id").cast("long"))
    rows = fps.count()
    classes = cut(named.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), rows)
    links = link_classes(classes.select("fp", "rep"), radius, shard_rows)
    # A document with several fingerprints ties its classes together.
    repeated = cut(named.groupBy("id").agg(F.count_distinct("fp").alias("k")).filter("k > 1").select("id"), rows)
    several = named.select("id", "fp").join(broadcast_if_small(repeated, repeated.count()), "id", "left_semi")
    ties = several.distinct().join(classes.select("fp", "rep"), "fp").filter("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    found = cut(connected_components(links.unionByName(ties), 2 * rows), 2 * rows)
    total = classes.agg(F.sum("n")).first()[0] or 0
    values = classes.join(dealt_anew(found, "node"), classes["rep"] == F.col("node"), "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    out = join_back(named, cut(values, rows), "fp", total).select("doc_id", "fp", "component_id")
    return out.unionByName(fps.filter("doc_id IS NULL").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))


def keep_representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The document with the smallest doc_id of each component within the radius; rows without an id stay.

    Columns are those of ``docs``, of any names. For similarity instead of a radius see ``near_copies``.
    """
    (name,) = fresh(docs.columns, "gone")
    gone = cut(near_duplicates(docs, radius).filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(broadcast_if_small(gone, gone.count()), docs["doc_id"] == gone[name], "left_anti")


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits), ``component_id``; see ``near_duplicates`` for odd rows."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
