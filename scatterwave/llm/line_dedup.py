"""Line dedup, all in DataFrame functions: winnowing over line hashes, and removal of later repeated runs.

Lines are compared lower-cased, without blanks, tabs and returns at their ends, by 128 bits of hash; blank lines are neither compared nor removed on their
own. A run is ``WINDOW`` or more consecutive lines, or fewer that have ``LONG`` words together. A run is repeated if the
same lines stand, in the same order, earlier: in a document of smaller doc_id (a null id is the smallest), or above in
the same one. Repeated runs are removed at their full length, and the first occurrence stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scatterwave.llm.common import dealt_anew, fresh, whole_text
from scatterwave.runtime import cut

WINDOW = 3
LONG = 20
#: Windows around a line: how many lines they have, and how many of those stand before it.
_PLACES = [(size, before) for size in range(1, WINDOW + 1) for before in range(size)]
#: Runs, and documents that have some, of which the list is sent to every worker; a longer list is joined by a shuffle.
BROADCAST_RUNS = 1_000_000


def _plain(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r")))


def _words(line: Column) -> Column:
    """Words of a trimmed line that blanks part; only lines with two blanks side by side need to be split for it."""
    single = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return F.when(F.instr(line, "  ") > 0, F.size(F.split(line, " +"))).otherwise(single)


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, t`` (hash of the text), and of its lines that are not blank ``a, b`` (two hashes) and ``w`` (words)."""
    texts = docs.select("doc_id", whole_text().alias("text")).filter(F.length("text") > 0)
    full = F.filter(F.transform(F.split("text", "\n"), _plain), lambda x: x != "")
    lines = F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"), _words(x).alias("w")))
    return texts.select("doc_id", F.xxhash64("text").alias("t"), lines.alias("x")).select("doc_id", "t", F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("x.w").alias("w"))


def _seeds(j: Column) -> Column:
    """Bits, in the order of ``_PLACES``, of the windows in which line ``j`` has the least hash, the rightmost of equal ones.

    Windows count if they have WINDOW lines, or LONG words together. Two runs that share such a window choose the
    same line of it, so every repeat shows up as a repeated print.
    """
    out, own, n = F.lit(0), F.get("a", j), F.size("a")
    for bit, (size, before) in enumerate(_PLACES):
        others = [o for o in range(-before, size - before) if o]
        least = [own <= F.get("a", j + o) if o < 0 else own < F.get("a", j + o) for o in others]
        long = reduce(lambda x, y: x + y, [F.get("w", j + o) for o in range(-before, size - before)]) >= LONG
        inside = (j >= before) & (j + (size - before) <= n)
        out = out + F.when(reduce(lambda x, y: x & y, [inside, *least, *([long] if size < WINDOW else [])]), 1 << bit).otherwise(0)
    return out


def matches(docs: DataFrame) -> DataFrame:
    """``doc_id, t, first, last, from_id, from_t, from_first``: repeated runs and where the same lines stand first.

    Positions count lines that are not blank. Prints are the winnowed lines, with the WINDOW - 1 lines on both sides.
    Those that occur once in the corpus end there. The positions of the others are joined, window by window, to the
    first position of the same lines: work is linear in the prints, as an occurrence meets the first and never all
    others. Matches that go on along the same pair of texts are extended to both ends of the run. Frequent lines
    are counted map-side and joined by equi-joins that Spark can split.
    """
    # Lines are exploded beside their arrays, never copied, and told apart by generated code.
    lines = _lines(docs).select("doc_id", "t", "a", "b", "w", F.posexplode("a").alias("p", "f"))
    chosen = lines.withColumn("seeds", _seeds(F.col("p"))).filter("seeds > 0")
    left = F.greatest(F.col("p") - (WINDOW - 1), F.lit(0))
    around = [F.slice(c, left + 1, 2 * WINDOW - 1).alias(c) for c in ("a", "b")]
    prints = cut(chosen.select("doc_id", "t", "p", (F.col("p") - left).alias("mid"), "seeds", "f", *around).distinct())
    often = prints.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f")
    kept = prints.join(dealt_anew(often, "f"), "f", "left_semi")

    def seed(size: int, before: int) -> Column:
        key = lambda c: F.xxhash64(F.lit(size), *[F.get(c, F.col("mid") - before + k) for k in range(size)])
        return F.struct(F.lit(size).alias("size"), key("a").alias("ka"), key("b").alias("kb"), (F.col("p") - before).alias("first"))

    seeds = F.filter(F.array(*[F.when(F.col("seeds").bitwiseAND(F.lit(1 << bit)) != 0, seed(*place)) for bit, place in enumerate(_PLACES)]), lambda s: s.isNotNull())
    found = cut(kept.select("doc_id", "t", F.explode(seeds).alias("s")).select("doc_id", "t", "s.*"))
    place = F.struct(F.col("doc_id"), F.col("t"), F.col("first"))
    earliest = found.groupBy("size", "ka", "kb").agg(F.min(place).alias("head"), F.count("*").alias("n")).filter("n > 1").select("size", "ka", "kb", "head")
    later = found.join(dealt_anew(earliest, "ka"), ["size", "ka", "kb"]).filter(~place.eqNullSafe(F.col("head")))
    pairs = later.select("doc_id", "t", "first", (F.col("first") + F.col("size") - 1).alias("last"), F.col("head.doc_id").alias("from_id"), F.col("head.t").alias("from_t"), (F.col("head.first") - F.col("first")).alias("shift"))
    runs = _joined(pairs, ["doc_id", "t", "from_id", "from_t", "shift"])
    return runs.select("doc_id", "t", "first", "last", "from_id", "from_t", (F.col("first") + F.col("shift")).alias("from_first"))


def _joined(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, first, last``: overlapping ranges of a text become one. A text's own lines bound the window."""
    order = Window.partitionBy(*keys).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cutset = ranges.withColumn("new", F.when(reach.isNull() | (F.col("first") > reach), 1).otherwise(0)).withColumn("g", F.sum("new").over(order))
    return cutset.groupBy(*keys, "g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("g")


def dedup_lines(docs: DataFrame, removed: str = "n_removed") -> DataFrame:
    """``docs`` with repeated runs taken out of ``text``, and a column for the number of lines removed.

    Rows that share doc_id and text are one document and change alike. Null texts stay null, and empty ones empty;
    an empty table stays empty. Blank lines inside a removed run go with it. Columns of any name may come along;
    one that is called like ``removed`` gives way to it. Work is linear in lines and runs.
    """
    d, t, r, x, at = fresh([*docs.columns, removed], "d", "t", "runs", "lines", "at")
    whole = cut(_joined(matches(docs.select("doc_id", "text")).select("doc_id", "t", "first", "last"), ["doc_id", "t"]))
    grouped = whole.groupBy(F.col("doc_id").alias(d), F.col("t").alias(t)).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias(r))
    runs = F.broadcast(grouped) if whole.count() <= BROADCAST_RUNS else grouped
    joined = docs.join(runs, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64(whole_text()) == F.col(t)), "left")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", removed)]
    split = joined.withColumn(x, F.when(F.col(r).isNotNull(), F.split("text", "\n")))
    # Numbers in the text of the lines that are not blank; runs count only those.
    full = F.filter(F.transform(x, lambda s, i: F.when(_plain(s) != "", i)), lambda i: i.isNotNull())
    split = split.withColumn(at, full)
    ranges = F.transform(r, lambda s: F.struct(F.get(at, s["first"]).alias("first"), F.get(at, s["last"]).alias("last")))
    split = split.withColumn(r, ranges)
    n, m = F.size(x), F.size(r)
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(r, i - 1)["last"] + 1)
    end = lambda i: F.when(i == m, n).otherwise(F.get(r, i)["first"])
    left = F.flatten(F.transform(F.sequence(F.lit(0), m), lambda i: F.slice(x, begin(i) + 1, end(i) - begin(i))))
    gone = F.aggregate(r, F.lit(0), lambda acc, s: acc + s["last"] - s["first"] + 1)
    text = F.when(F.col(r).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return split.select(*others, text.alias("text"), F.coalesce(gone, F.lit(0)).cast("long").alias(removed))


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_removed, clean_sha256`` of the text that is left.

    Null counts as empty, which has one line. Rows that repeat an id and a text change alike; an empty table gives no rows.
    """
    out = dedup_lines(docs.select("doc_id", "text", F.size(F.split(whole_text(), "\n")).cast("long").alias("n_lines")))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(whole_text(), 256).alias("clean_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS ln FROM d),
l AS (SELECT doc_id, ln, lower(trim(raw, ' ' || chr(9) || chr(13))) AS x FROM e),
f AS (SELECT *, len(string_split_regex(x, ' +')) AS w, lead(x) OVER o AS x2, lead(ln) OVER o AS ln2, lead(x, 2) OVER o AS x3, lead(ln, 2) OVER o AS ln3 FROM l WHERE x <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY ln)),
r AS (SELECT doc_id, ln AS first, ln3 AS last, x || chr(10) || x2 || chr(10) || x3 AS run FROM f WHERE x3 IS NOT NULL
      UNION ALL SELECT doc_id, ln, ln2, x || chr(10) || x2 FROM f WHERE x2 IS NOT NULL AND w + len(string_split_regex(x2, ' +')) >= {LONG}
      UNION ALL SELECT doc_id, ln, ln, x FROM f WHERE w >= {LONG}),
s AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS nth FROM r),
g AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS ln FROM s WHERE nth > 1),
k AS (SELECT e.doc_id, count(*) AS n_lines, count(g.ln) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY e.ln) FILTER (g.ln IS NULL), '') AS clean
      FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.ln = g.ln GROUP BY e.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(clean) AS clean_sha256 FROM k
"""
