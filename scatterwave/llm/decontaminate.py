"""Benchmark decontamination, all in DataFrame functions: SimHash of item-sized windows, multi-index Hamming blocks,
and an exact weighted-shingle similarity.

Texts are lower-cased and cut into words at anything that is neither letter nor digit. A shingle is five words (an item
with fewer words is one shingle). A window has as many words as an item; a document with fewer words is one window. A document is contaminated by an item if one
of its windows and the item have a weighted Jaccard similarity of at least 0.8: the sum over shingles of the smaller
multiplicity, over the sum of the larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterwave.llm.common import drop_rows, whole_text
from scatterwave.runtime import broadcast_if_small, cut

SHINGLE = 5
SIMILARITY = 0.8
#: Hamming radius of 64-bit fingerprints. At similarity 0.8 a bit differs with probability 0.15, so 19 lies over three
#: standard deviations above the mean of 9.7.
RADIUS = 19
#: Five blocks: two fingerprints within 19 bits are within 3 bits in at least one of them.
BLOCKS = (13, 13, 13, 13, 12)
_BLOCK_RADIUS = RADIUS // len(BLOCKS)
#: Shingles of a benchmark that are sent to every worker; a larger benchmark is joined by shuffling hashes.
BROADCAST_SHINGLES = 500_000
_LANES = 16  # bits of a counter; four counters share a long
#: Shingles of an item that such counters surely hold; where an item has more, counters of 32 bits are used.
LANE_SHINGLES = 30_000


def words(text: Column) -> Column:
    """Words of a text; a text without any gives an empty array."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_at(w: Column, i: Column, size: int = SHINGLE) -> Column:
    """Hash of the words from position ``i`` on; fewer remain only where the whole sequence is shorter."""
    return F.xxhash64(*[F.get(w, i + k) for k in range(size)])


def _positions(rows: DataFrame, keep: list[str], sizes: list[int] = [SHINGLE]) -> DataFrame:  # noqa: B006
    """One row per shingle of each size: ``keep, pos, h``. Built of codegen operators: the words are exploded, never copied."""
    exploded = rows.select(*dict.fromkeys([*keep, "w"]), F.posexplode("w").alias("pos", "_"))
    whole = lambda size: (F.col("pos") <= F.size("w") - size) | (F.col("pos") == 0)
    if len(sizes) == 1:
        return exploded.filter(whole(sizes[0])).select(*keep, F.col("pos"), shingle_at(F.col("w"), F.col("pos"), sizes[0]).alias("h"))
    every = F.array(*[F.when(whole(size), shingle_at(F.col("w"), F.col("pos"), size)) for size in sizes])
    return exploded.select(*keep, F.col("pos"), F.explode(every).alias("h")).filter("h IS NOT NULL")


def _simhash(rows: DataFrame, keys: list[str], lanes: int = _LANES) -> DataFrame:
    """Fingerprint of each group of shingle hashes ``h``: a bit is set if it is set in over half of them.

    ``lanes`` sums hold 64 / lanes counters of ``lanes`` bits each; the uppermost must stay positive.
    """
    share = 64 // lanes
    lane = sum(1 << (lanes * j) for j in range(share))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(lane))).alias(f"c{i}") for i in range(lanes)]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    fp = F.lit(0).cast("long")
    for i in range(lanes):
        for j in range(share):
            count = F.shiftrightunsigned(f"c{i}", lanes * j).bitwiseAND(F.lit((1 << lanes) - 1))
            bit = 1 << (i + lanes * j)
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("n"), F.lit(bit - 2**64 if bit >= 2**63 else bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, fp.alias("fp"))


def _block_values(fp: Column) -> list[Column]:
    out, shift = [], 0
    for width in BLOCKS:
        out.append(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)))
        shift += width
    return out


def items_of(benchmark: DataFrame) -> DataFrame:
    """``item_id, w, len``: items that have words. Null ids are kept apart from none, null texts have no words."""
    rows = benchmark.select("item_id", words(whole_text()).alias("w"))
    return rows.withColumn("len", F.size("w")).filter("len > 0")


def _neighbourhood(items: DataFrame) -> DataFrame:
    """Every item under each value that a near fingerprint may show in a block: ``len, block, value, item_id, item_fp``."""
    spark = items.sparkSession
    flips = None
    for b, width in enumerate(BLOCKS):
        own = spark.range(2**width).filter(F.bit_count("id") <= _BLOCK_RADIUS).select(F.lit(b).alias("block"), F.col("id").alias("flip"))
        flips = own if flips is None else flips.unionByName(own)
    blocks = items.select("item_id", "len", F.col("fp").alias("item_fp"), F.posexplode(F.array(*_block_values(F.col("fp")))).alias("block", "value"))
    near = blocks.join(F.broadcast(flips), "block")  # 1,811 rows, fixed by the radius
    return near.select("len", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), "item_id", "item_fp")


def _counts(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys, "h").agg(F.count("*").alias(name))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, t, item_id, start, similarity``: the best window of every contaminated text (``t``: its XXH64) and item.

    ``start`` is in words; of windows as good as each other, the earliest that is laid. A similarity above zero needs a shared shingle, so windows are laid
    wherever a document's shingle is one of the benchmark's, at the start which that shingle has in an item of that
    length; each is then fingerprinted, found by blocks, and verified. Null and empty texts match nothing; empty tables give no rows.
    """
    items = cut(items_of(benchmark))
    n_items, longest = items.agg(F.count("*"), F.max("len")).first()
    lanes = _LANES if (longest or 0) <= LANE_SHINGLES else 32
    item_shingles = cut(_positions(items, ["item_id", "len"]))
    n_shingles = item_shingles.count()
    prints = _simhash(item_shingles, ["item_id", "len"], lanes)
    anchors = item_shingles.select("h", F.col("pos").alias("at"), "len").distinct()

    # A text's hash tells apart rows that share an id; rows alike in both give the same windows, which are made distinct.
    # ``m`` is the number of words of the window: ``len``, or fewer where the whole document is shorter than the item.
    keys = ["doc_id", "t", "len", "start", "m"]
    # Items under five words are one shorter shingle each, of at most four lengths; documents show those as well.
    short = [r["len"] for r in items.filter(F.col("len") < SHINGLE).select("len").distinct().collect()]

    def shown(keep: list[str]) -> DataFrame:
        return _positions(rows, keep, [SHINGLE, *sorted(short)])

    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("t"), words(whole_text()).alias("w")).withColumn("n", F.size("w"))
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("n") - F.col("len"))).alias("start")
    cut_out = F.slice("w", F.col("start") + 1, F.col("len")).alias("w")
    m = F.least(F.size("w"), F.col("len")).alias("m")
    ours, its = F.greatest(F.col("n") - SHINGLE + 1, F.lit(1)), F.greatest(F.col("len") - SHINGLE + 1, F.lit(1))
    enough = (F.col("n") >= F.col("len")) | (ours >= SIMILARITY * its - 1e-9)  # a shorter document's similarity is ours / its at most
    if n_shingles <= BROADCAST_SHINGLES:
        # The words are still at hand where a document's shingle meets the benchmark's, so windows alone are shuffled.
        laid = shown(["doc_id", "t", "n", "w"]).join(F.broadcast(anchors), "h").filter(enough)
        windows = laid.select("doc_id", "t", "len", start, m, "w").select(*keys, cut_out).distinct()
    else:
        laid = shown(["doc_id", "t", "n"]).join(anchors, "h").filter(enough)
        places = cut(laid.select("doc_id", "t", "len", start).distinct().groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "len")).alias("places")))
        places = places.withColumnsRenamed({"doc_id": "d", "t": "tt"})
        touched = rows.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("tt"))).select("doc_id", "t", "w", F.explode("places").alias("x"))
        windows = touched.select("doc_id", "t", F.col("x.len").alias("len"), F.col("x.start").alias("start"), "w").select("*", m).select(*keys, cut_out).distinct()
    shingles = cut(_positions(windows, keys))

    fps = _simhash(shingles, keys, lanes)
    blocks = fps.select(*keys, "fp", F.posexplode(F.array(*_block_values(F.col("fp")))).alias("block", "value"))
    near = broadcast_if_small(_neighbourhood(prints), n_items * 1_811, 2_000_000)
    pairs = blocks.join(near, ["len", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select(*keys, "item_id").distinct()

    # Exact check: multiplicities of shared shingles. The sides have m - 4 and len - 4 shingles (one at least), so the
    # sum of the larger multiplicities is the total of both less the sum of the smaller.
    mine = _counts(shingles, keys, "a").withColumnsRenamed({"doc_id": "d", "t": "tt", "len": "l", "start": "s"}).drop("m")
    theirs = _counts(item_shingles, ["item_id", "len"], "b").withColumnsRenamed({"item_id": "i", "len": "il", "h": "ih"})
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("tt")) & (F.col("len") == F.col("l")) & (F.col("start") == F.col("s"))
    shared = pairs.join(mine, same).join(broadcast_if_small(theirs, n_shingles, BROADCAST_SHINGLES), F.col("item_id").eqNullSafe(F.col("i")) & (F.col("len") == F.col("il")) & (F.col("h") == F.col("ih")))
    common = shared.groupBy("doc_id", "t", "len", "start", "m", "item_id").agg(F.sum(F.least("a", "b")).alias("c"))
    total = its + F.greatest(F.col("m") - SHINGLE + 1, F.lit(1))
    scored = common.withColumn("similarity", F.col("c") / (total - F.col("c"))).filter(F.col("similarity") >= SIMILARITY)
    best = scored.groupBy("doc_id", "t", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "t", "item_id", (-F.col("best.back")).cast("int").alias("start"), F.col("best.similarity").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, similarity``: one row a pair, with the best window of ``matches``.

    Rows that repeat a doc_id count as one document with several texts, each looked at on its own; rows without an id
    count as one document with the id null. Ties go to the earliest window. Null and empty texts match nothing, and
    empty tables give no rows. Only ``doc_id``, ``text`` and ``item_id`` are read, so other columns may have any names.
    """
    best = matches(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.back")).cast("int").alias("start"), F.col("best.similarity").alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows whose text no item contaminates, with the columns of ``docs``.

    Each row is judged by its own text, also where rows share an id or have none. Null and empty texts stay; an empty
    benchmark keeps everything.
    """
    return drop_rows(docs, matches(docs, benchmark).select("doc_id", "t"))
