"""SimHash near-dedup by similarity: operator 9's fingerprints and vantage-point trees, with an exact check on shingle sets.

The fixed radius of ``simhash.digest`` keeps nearly every edited copy. This interface links documents whose sets of
5-word shingles have a Jaccard similarity of 0.8 or more. At that similarity a bit of the fingerprint differs with
probability 0.15 at most, so the radius is 19 of 64 bits. A tree over all fingerprints could not prune at that radius,
so trees are grown inside blocks of documents that share one of their rarest shingles: similar sets always share one.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from scatterwave.llm.common import arrow_map, dealt_anew, drop_rows, slices, whole_text
from scatterwave.llm.components import connected_components
from scatterwave.llm.simhash import shingle_hashes, simhash, tree_links
from scatterwave.runtime import broadcast_if_small, cut, ship

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
#: Counters (a power of two) that order shingles by frequency, over all documents. Sharing a counter costs time, never a link.
SLOTS = 2**17
#: Members of a block that one search holds at a time, and rows of small blocks that share a task.
CHUNK, TASK_ROWS = 2_048, 50_000


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes, ascending; texts without words share one value, so they are alike."""
    found = np.unique(shingle_hashes(text, size).view(np.int64))
    return found if len(found) else np.zeros(1, np.int64)


def _signature(found: np.ndarray) -> int:
    return int(np.uint64(xxh64_intdigest(found.tobytes())).view(np.int64))


def shingle_counts(rows: DataFrame, size: int, slots: int) -> np.ndarray:
    """In how many documents the shingles of each slot stand, counted over all rows: ``slots`` numbers, whatever the corpus."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(slots, np.int64)
        for batch in (own for b in batches for own in slices(b)):
            for text in batch.column("text").to_pylist():
                np.add.at(total, shingle_set(text, size) & (slots - 1), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    got = rows.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out = np.zeros(slots, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def _sets(docs: DataFrame, share: Fraction, size: int, slots: int) -> DataFrame:
    """``doc_id, t`` (hash of the text), ``sig`` (of the shingle set), ``k`` (its size), ``fp`` and ``first``, the rarest shingles."""
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("t"), "text")
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(rows, size, slots))
    p, q = share.numerator, share.denominator

    def run(batch):
        out = {"doc_id": batch["doc_id"], "t": batch["t"], "sig": [], "k": [], "fp": [], "first": []}
        for text in batch["text"]:
            found = shingle_set(text, size)
            k = len(found)
            out["sig"].append(_signature(found))
            out["k"].append(k)
            out["fp"].append(int(np.uint64(simhash(found.view(np.uint64))).view(np.int64)))
            out["first"].append(found[np.lexsort((found, counts.value[found & (slots - 1)]))][: k + 1 - -(-p * k // q)])
        return out

    return cut(arrow_map(rows, run, "doc_id long, t long, sig long, k long, fp long, first array<long>"))


def _verified(pairs: DataFrame, count: int, rows: DataFrame, homes: DataFrame, share: Fraction, size: int) -> DataFrame:
    """Of ``count`` pairs ``a, b`` of classes, those whose whole shingle sets are similar enough; only texts of classes in pairs are read again."""
    p, q = share.numerator, share.denominator
    nodes = cut(pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct().join(homes.select("sig", "doc_id", "t"), "sig"), 2 * count)
    n = nodes.count()
    asked = broadcast_if_small(nodes.select("doc_id", "t", "sig"), n)

    def whole(batch):
        return {"sig": batch["sig"], "found": [shingle_set(t, size) for t in batch["text"]]}

    texts = rows.join(asked, ["doc_id", "t"]).dropDuplicates(["sig"]).select("sig", "text")
    full = cut(arrow_map(texts, whole, "sig long, found array<long>"), n, 2_000)
    left, right = full.select(F.col("sig").alias("a"), F.col("found").alias("x")), full.select(F.col("sig").alias("b"), F.col("found").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared * (p + q) >= p * (F.size("x") + F.size("y"))).select("a", "b")


def _search(share: Fraction, radius: int):
    """Pairs of one task's blocks that a vantage-point tree finds within the radius and that sizes and places allow."""
    p, q = share.numerator, share.denominator

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        h, fp, sig, k, at, comp, side = (pdf[c].to_numpy(np.int64) for c in ("h", "fp", "sig", "k", "at", "comp", "side"))
        fp, out = fp.view(np.uint64), []
        edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        for lo, hi in zip(edges, edges[1:]):
            own = np.arange(lo, hi)
            apart = side[lo:hi].any()  # two chunks of a block: side 0 against side 1
            points, queries = (own[side[lo:hi] == 0], own[side[lo:hi] == 1]) if apart else (own, own)
            for a, b in tree_links(fp[points], fp[queries], radius):
                a, b = points[a], queries[b]
                rest = np.minimum(k[a] - at[a], k[b] - at[b])
                fits = (comp[a] != comp[b]) & (rest * (p + q) >= p * (k[a] + k[b])) & (k[a] * q >= p * k[b]) & (k[b] * q >= p * k[a])
                if not apart:
                    fits &= a < b
                a, b = sig[a[fits]], sig[b[fits]]
                out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        found = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
        return pd.DataFrame({"a": found[0], "b": found[1]})

    return run


def _blocked(members: DataFrame, chunk: int) -> DataFrame:
    """Rows ``h, ...`` with ``task, side``: small blocks share a task; a large one is cut into chunks, of which every two meet."""
    sizes = members.groupBy("h").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / chunk).cast("long")
    rows = members.join(dealt_anew(sizes, "h"), "h").withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("sig"), F.col("parts")))
    total = members.count()
    tasks = max(1, -(-total // TASK_ROWS))
    small = rows.filter("parts = 1").withColumn("task", F.struct(F.pmod(F.xxhash64("h"), F.lit(tasks)).alias("g"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"))).withColumn("side", F.lit(0))
    met = rows.filter("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    large = met.withColumn("task", F.struct(F.col("h").alias("g"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))).withColumn("side", (F.col("mine") > F.col("other")).cast("int"))
    keep = ["task", "side", "h", "sig", "k", "fp", "at", "comp"]
    return small.select(*keep).unionByName(large.select(*keep))


def _first_met(members: DataFrame, share: Fraction, radius: int) -> DataFrame:
    """Pairs ``a, b``, two at most for each member: the closest of the first, and of the second, members of its blocks.

    First is the one in which fewest rarer shingles stand before the block's own, usually the original of edited copies.
    """
    p, q = share.numerator, share.denominator
    own = F.struct("at", "sig", "k", "fp")
    with_x = members.join(dealt_anew(members.groupBy("h").agg(F.min(own).alias("x")), "h"), "h")
    second = with_x.filter(F.col("sig") != F.col("x.sig")).groupBy("h").agg(F.min(own).alias("y"))
    both = with_x.join(dealt_anew(second, "h"), "h")

    def met(lead: str):
        rest = F.least(F.col("k") - F.col("at"), F.col(f"{lead}.k") - F.col(f"{lead}.at"))  # the shared shingle and what may follow it
        sizes = (F.col("k") * q >= p * F.col(f"{lead}.k")) & (F.col(f"{lead}.k") * q >= p * F.col("k"))
        bits = F.bit_count(F.col("fp").bitwiseXOR(F.col(f"{lead}.fp")))
        fits = (F.col("sig") != F.col(f"{lead}.sig")) & (rest * (p + q) >= p * (F.col("k") + F.col(f"{lead}.k"))) & sizes & (bits <= radius)
        return F.min(F.when(fits, F.struct(bits.alias("bits"), F.col(f"{lead}.sig").alias("to")))).alias(lead)

    best = both.groupBy("sig").agg(met("x"), met("y")).select("sig", F.explode(F.array("x.to", "y.to")).alias("to")).filter("to IS NOT NULL")
    return best.select(F.least("sig", "to").alias("a"), F.greatest("sig", "to").alias("b")).distinct()


def _merged(comps: DataFrame | None, links: DataFrame, n: int) -> DataFrame:
    """``sig, comp`` of every class that has links, of at most ``n``, after more of them: components of components."""
    if comps is None:
        ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        return cut(connected_components(ends, n).select(F.col("node").alias("sig"), F.col("component").alias("comp")), n)
    name = lambda side: comps.select(F.col("sig").alias(side), F.col("comp").alias(f"c{side}"))
    known = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v"))
    more = cut(connected_components(known, n).select(F.col("node").alias("comp"), F.col("component").alias("to")), n)
    old = comps.join(dealt_anew(more, "comp"), "comp", "left").select("sig", F.coalesce("to", "comp").alias("comp"))
    new = more.select(F.col("comp").alias("sig"), F.col("to").alias("comp")).join(comps, "sig", "left_anti")
    return cut(old.unionByName(new), n)


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, radius: int = RADIUS, chunk: int = CHUNK, slots: int = SLOTS) -> DataFrame:
    """``doc_id, t, class``: a number for each component of documents linked by a similarity of ``similarity`` or more.

    Under any one order of all shingles, sets x and y as similar as s share one of their first |x| - ceil(s |x|) + 1 and
    |y| - ceil(s |y|) + 1 shingles. The order is rare ones first, by counts over all documents; documents that share
    such a shingle form a block. Equal sets are one class from the start. Then every member meets the first and the second
    member of one of its blocks each: work linear in the blocks. Blocks that still hold several components are
    searched by vantage-point trees, and only pairs across components leave them. All pairs are checked on whole
    sets, so a link is never wrong; a similar pair is missed only where its fingerprints differ in more than ``radius``
    bits (about 0.1 % of pairs at a similarity of just 0.8).

    Null and empty texts, and those without words, are alike. Rows without an id are left out. ``t`` tells apart rows
    that share an id; each is looked at on its own. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    share = Fraction(str(similarity))
    sets = _sets(docs, share, size, slots)
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("t"), "text")
    counted = sets.groupBy("sig").agg(F.min(F.struct("doc_id", "t")).alias("home"), F.count("*").alias("n"))
    n = sets.count()
    homes = cut(counted, n).select("sig", "home.doc_id", "home.t", "n")
    copied = cut(homes.filter("n > 1").select("sig", F.col("doc_id").alias("d"), F.col("t").alias("tt")), n)
    copied = broadcast_if_small(copied, copied.count())
    one = sets.join(copied, "sig", "left").filter("d IS NULL OR (doc_id = d AND t = tt)")  # each class by its home

    index = one.select("sig", "k", "fp", F.posexplode("first").alias("at", "h"))
    often = cut(index.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), 20 * n)
    # Only hash, class and place of each shingle are shuffled, at every size alike; few shingles are shared.
    shared = index.select("h", "sig", "at").join(often, "h", "left_semi")
    members = cut(shared.join(broadcast_if_small(one.select("sig", "k", "fp"), n), "sig"))
    pairs = cut(_first_met(members, share, radius), 2 * n)
    comps = _merged(None, _verified(pairs, pairs.count(), rows, homes, share, size), n)
    marked = cut(_marked(members, comps))
    mixed = marked.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("h")
    left = cut(marked.join(dealt_anew(mixed, "h"), "h", "left_semi"), marked.count(), 200_000)
    found = _blocked(left, chunk).groupBy("task").applyInPandas(_search(share, radius), "a long, b long")
    pairs = cut(found.distinct(), 20 * n)
    comps = _merged(comps, _verified(pairs, pairs.count(), rows, homes, share, size), n)
    return _marked(sets.select("doc_id", "t", "sig"), comps).select("doc_id", "t", F.col("comp").alias("class"))


def _marked(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``rows`` with their class's component; a class without links is its own."""
    if comps is None:
        return rows.withColumn("comp", F.col("sig"))
    return rows.join(broadcast_if_small(comps, comps.count()), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))


def keep_representatives(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """The document with the smallest doc_id of each class stays, with the columns of ``docs``.

    Rows without an id stay. Of rows that share an id, each is judged by its own text; rows that repeat both id and text
    stay or go together. An empty table stays empty. Columns of any name may come along.
    """
    classes = cut(near_classes(docs, similarity, size))
    n = classes.count()
    stays = classes.groupBy("class").agg(F.min(F.struct("doc_id", "t")).alias("stays"), F.count("*").alias("n")).filter("n > 1").select("class", "stays")
    gone = classes.join(dealt_anew(stays, "class"), "class").filter(F.struct("doc_id", "t") != F.col("stays")).select("doc_id", "t")
    return drop_rows(docs, gone, bound=n)
