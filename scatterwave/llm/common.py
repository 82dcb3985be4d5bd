"""What the operators share: learning folds, null-safe texts, Arrow batches and small array helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scatterwave.runtime import broadcast_if_small, cut


SLICE_ROWS = 1_000


def held_out(doc_id: Column) -> Column:
    """Rows that no learner sees: crc32 of the id as text is a multiple of five. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, an aggregate by ``keys`` (long or string), with values alike but of unknown partitioning.

    A join reads an aggregate by its keys in place, and adaptive execution then can't split the other side's frequent
    keys: it does so only where both sides come straight from a shuffle made for the join.
    """
    kinds = dict(df.dtypes)
    return df.withColumns({k: F.concat(F.col(k), F.lit("")) if kinds[k] == "string" else F.bitwise_not(F.bitwise_not(F.col(k))) for k in keys})


def join_back(rows: DataFrame, values: DataFrame, key: str, total: int, share: int = 1_000) -> DataFrame:
    """``rows`` inner-joined by ``key`` to ``values``, which have one row a key and ``n``, the number of its rows out of ``total``.

    Keys with at least a ``share``-th of all rows, ``share`` of them at most, are joined by a broadcast, so none of
    their rows move; the others by a shuffle that Spark can split. ``n`` is dropped.
    """
    heavy = F.col("n") >= max(2, -(-total // share))
    large = F.broadcast(values.filter(heavy).drop("n"))
    light = rows.join(F.broadcast(values.filter(heavy).select(key)), key, "left_anti").join(dealt_anew(values.filter(~heavy).drop("n"), key), key)
    return rows.join(large, key).unionByName(light)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores put on until no column has it in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def drop_rows(docs: DataFrame, gone: DataFrame, key: Column | None = None, name: str = "t", bound: int | None = None) -> DataFrame:
    """``docs`` without the rows whose doc_id and text (by a hash of it, XXH64 unless given) stand in ``gone``; null ids equal null ids.

    Up to two million rows of ``gone`` are sent to every worker, so texts stay where they are; more are joined by a shuffle.
    ``bound``: a known bound of the rows of ``gone``.
    """
    gone = cut(gone.distinct(), bound)
    d, t = fresh(docs.columns, "gone_id", "gone_text")
    named = broadcast_if_small(gone.select(F.col("doc_id").alias(d), F.col(name).alias(t)), gone.count())
    return docs.join(named, F.col("doc_id").eqNullSafe(F.col(d)) & ((F.xxhash64(whole_text()) if key is None else key) == F.col(t)), "left_anti")


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(columns: dict of lists) -> dict of lists or arrays`` over slices of Arrow batches; columns take the schema's types."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for own in slices(batch):
                yield pa.RecordBatch.from_pydict(fn(own.to_pydict()), schema=kinds)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch):
    """A batch in slices of ``SLICE_ROWS``, so that no worker holds more whole texts as Python objects."""
    for i in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(i, SLICE_ROWS)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the edges a-b."""
    parent = np.arange(n)
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
    return parent
