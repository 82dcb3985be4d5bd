"""Exact dedup by two-pass Bloom filtering: rows that the filter proves unique never shuffle."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterwave.llm.common import dealt_anew, drop_rows, fresh, join_back, whole_text
from scatterwave.runtime import cut, delete_path, scratch_path, ship

#: Slots of the filter for each row, and those of one shard of it (a bit each: 64 MiB). Larger corpora have more shards.
SLOTS_PER_ROW, SHARD_SLOTS = 16, 2**29
_SEGMENT = 65_536  # slots whose numbers inside a segment fit 16 bits


def filter_size(rows: int, shard_slots: int = SHARD_SLOTS) -> tuple[int, int]:
    """Shards of the filter and slots of each (a power of two); together they grow with the rows."""
    want = max(_SEGMENT, 1 << (max(1, rows * SLOTS_PER_ROW) - 1).bit_length())
    return (1, want) if want <= shard_slots else (want // shard_slots, shard_slots)


def _slots(h1: np.ndarray, h2: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    return h1 & (slots - 1), h2 & (slots - 1)


def repeated_filter(hashes: DataFrame, slots: int) -> np.ndarray:
    """First pass over ``h1, h2``: a bitmap of the slots that at least two rows set.

    Each task marks its rows in a private sparse bitmap of the slots seen once and seen again; only these bitmaps (two
    bytes a slot) are merged, segment by segment. The driver receives the finished filter: ``slots / 8`` bytes.
    """

    def mark(batches):
        held = [np.concatenate(_slots(*(b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)), slots)) for b in batches]
        at, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
        edges = np.flatnonzero(np.diff(at // _SEGMENT, prepend=-1))
        for i in range(0, len(edges), 4_096):
            rows = [(at[a:b], n[a:b]) for a, b in zip(edges[i : i + 4_096], [*edges[i + 1 : i + 4_097], len(at)])]
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array([int(s[0]) // _SEGMENT for s, _ in rows], pa.int64()),
                "seen": [(s % _SEGMENT).astype("<u2").tobytes() for s, _ in rows],
                "again": [(s[k > 1] % _SEGMENT).astype("<u2").tobytes() for s, k in rows],
            })

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(_SEGMENT, np.int64)
        for seen, again in zip(pdf["seen"], pdf["again"]):
            n[np.frombuffer(seen, "<u2")] += 1
            n[np.frombuffer(again, "<u2")] += 1
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "bits": [np.packbits(n > 1, bitorder="little").tobytes()]})

    marks = hashes.select("h1", "h2").mapInArrow(mark, "segment long, seen binary, again binary")
    maps = marks.groupBy("segment").applyInPandas(merge, "segment long, bits binary")
    bits = np.zeros((slots // _SEGMENT, _SEGMENT // 8), np.uint8)
    for row in maps.toLocalIterator():
        bits[row["segment"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return bits.ravel()


def _maybe_repeated(spark: SparkSession, bits: np.ndarray, slots: int):
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
        held, out = shared.value, True
        for slot in _slots(h1.to_numpy(np.int64), h2.to_numpy(np.int64), slots):
            out = out & ((held[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0)
        return pd.Series(out)

    return test


def decide(docs: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``doc_id, sha, keep_id, group_size, kept`` for every row.

    Texts are equal when they are identical; null counts as empty. The largest doc_id of a group stays; ids that
    are null lose to any other. Rows that share both id and text are one row's copies: one of them stays. Equality
    is decided on SHA-256, and a row passes untouched only if the filter proves that its hash occurs once. An empty
    table gives no rows. Texts are read once, for ids and hashes, which are written to the shared folder.
    """
    spark = docs.sparkSession
    ship(spark)
    sha = F.sha2(whole_text(), 256)
    rows = docs.select("doc_id", sha.alias("sha"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows.withColumn("h1", F.xxhash64("sha")).withColumn("h2", F.xxhash64("sha", F.lit(1))))
    n = rows.count()
    shards, slots = filter_size(n, shard_slots)
    if shards == 1:
        parts = [rows]
    else:  # files of their own for each shard of the filter, so that each is read once
        path = scratch_path(spark, "hashes")
        rows.withColumn("shard", F.pmod(F.xxhash64("sha", F.lit(2)), F.lit(shards))).write.partitionBy("shard").parquet(path)
        whole = spark.read.parquet(path)
        parts = [whole.filter(F.col("shard") == k).drop("shard") for k in range(shards)]
    tested = []
    for part in parts:
        test = _maybe_repeated(spark, repeated_filter(part, slots), slots)
        tested.append(cut(part.select("doc_id", "sha", "row", test("h1", "h2").alias("maybe"))))
    if shards > 1:
        delete_path(spark, path)
    marked = reduce(DataFrame.unionByName, tested)
    unique = marked.filter("NOT maybe").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    rest = marked.filter("maybe").select("doc_id", "sha", "row")

    # Counted map-side, so a group of any size is one row for each task. Verdicts go back to large groups by a broadcast.
    groups = cut(rest.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("stays"), F.count("*").alias("group_size")), n)
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    judged = join_back(rest, groups.withColumn("n", F.col("group_size")), "sha", total)
    judged = judged.select("doc_id", "sha", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"))
    return unique.unionByName(judged)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs``, which may have any names. See ``decide`` for which."""
    d, t = fresh(docs.columns, "d", "t")
    verdicts = decide(docs.select("doc_id", "text"))
    groups = cut(verdicts.filter("group_size > 1"), docs.count())
    lost = groups.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "sha").distinct()
    left = drop_rows(docs, lost, key=F.sha2(whole_text(), 256), name="sha")
    # Rows that repeat both id and text: one of them stays, whichever is met first; counted map-side like the groups.
    twins = cut(groups.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "sha").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "sha"))
    if twins.isEmpty():
        return left
    keyed = left.withColumn(d, F.col("doc_id")).withColumn(t, F.sha2(whole_text(), 256))
    same = twins.select(F.col("doc_id").alias("x"), F.col("sha").alias("y"))
    of_twins = keyed.join(dealt_anew(same, "y"), keyed[d].eqNullSafe(same["x"]) & (keyed[t] == F.col("y")), "left_semi")
    one = of_twins.groupBy(d, t).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("r")).select("r.*")
    return drop_rows(left, twins, key=F.sha2(whole_text(), 256), name="sha").unionByName(one)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``. An empty table gives no rows."""
    return decide(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
