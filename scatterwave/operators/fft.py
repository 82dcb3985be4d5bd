"""Uniform transforms of a grid held as rows ``transform_id, cell, re, im`` (absent cells are zero)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterwave.runtime import ship

#: Cells that one task transforms at once.
TASK_CELLS = 2**24
GRID_SCHEMA = "transform_id int, cell long, re double, im double"


def fft_array(grid: np.ndarray, sign: int, axes=None) -> np.ndarray:
    """Unnormalised; sign > 0 is exp(+i), which numpy calls inverse."""
    if sign < 0:
        return np.fft.fftn(grid, axes=axes)
    n = math.prod(grid.shape) if axes is None else math.prod(grid.shape[a] for a in axes)
    return np.fft.ifftn(grid, axes=axes) * n


def dense(pdf: pd.DataFrame, shape) -> np.ndarray:
    """Rows to an array whose axis order is reversed, as dimension zero is the fastest."""
    flat = np.zeros(math.prod(shape), complex)
    flat[pdf["cell"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
    return flat.reshape(shape[::-1])


def fft_single(grid: DataFrame, shape, sign: int) -> DataFrame:
    """One task for each transform."""
    ship(grid.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fft_array(dense(pdf, shape), sign).ravel()
        return pd.DataFrame({"transform_id": np.full(out.size, pdf["transform_id"].iloc[0], np.int32), "cell": np.arange(out.size), "re": out.real, "im": out.imag})

    return grid.groupBy("transform_id").applyInPandas(run, GRID_SCHEMA)


def _pass(grid: DataFrame, outer: int, length: int, sign: int, twiddle: int = 0, lines: int = 1) -> DataFrame:
    """Transform along one axis of stride ``outer``. Lines are grouped so that a task gets a bounded block of them.

    ``twiddle``: the full length of a four-step transform, whose phase is applied after this pass.
    """
    block = max(1, min(lines, TASK_CELLS // 16 // length))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = pdf["cell"].to_numpy()
        low, at, high = cell % outer, cell // outer % length, cell // (outer * length)
        keys, line = np.unique(high * outer + low, return_inverse=True)
        work = np.zeros((len(keys), length), complex)
        work[line, at] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        work = fft_array(work, sign, axes=(1,))
        k = np.arange(length)
        if twiddle:
            work *= np.exp(sign * 2j * np.pi * np.outer(keys % outer, k) / twiddle)
        cells = (keys // outer * outer * length + keys % outer)[:, None] + k * outer
        return pd.DataFrame({"transform_id": np.full(work.size, pdf["transform_id"].iloc[0], np.int32), "cell": cells.ravel(), "re": work.real.ravel(), "im": work.imag.ravel()})

    line = F.floor(F.col("cell") / (outer * length)) * outer + F.pmod(F.col("cell"), F.lit(outer))
    return grid.groupBy("transform_id", F.floor(line / block).alias("block")).applyInPandas(lambda pdf: run(pdf), GRID_SCHEMA)


def fft_distributed(grid: DataFrame, shape, sign: int) -> DataFrame:
    """One shuffle per axis; a one-dimensional grid is first cut into rows and columns (four steps)."""
    ship(grid.sparkSession)
    if len(shape) == 1:
        n = shape[0]
        n1 = max(d for d in range(1, math.isqrt(n) + 1) if n % d == 0)
        n2 = n // n1
        # cell = a + n1 b  ->  over b with the twiddle, then over a; frequency = kb + n2 ka sits at a' = ka, b' = kb.
        first = _pass(grid, n1, n2, sign, twiddle=n, lines=n1)
        second = _pass(first, 1, n1, sign, lines=n2)
        return second.withColumn("cell", F.floor(F.col("cell") / n1) + F.pmod(F.col("cell"), F.lit(n1)) * F.lit(n2))
    out, stride, total = grid, 1, math.prod(shape)
    for length in shape:
        out = _pass(out, stride, length, sign, lines=total // length)
        stride *= length
    return out


def fft_grid(grid: DataFrame, shape, sign: int) -> DataFrame:
    return fft_single(grid, shape, sign) if math.prod(shape) <= TASK_CELLS else fft_distributed(grid, shape, sign)


def uniform_fft(values: DataFrame, id_col: str, index_col: str, n: int, inverse: bool = False, normalization: str = "none") -> DataFrame:
    """Fast uniform transform of rows ``(id, index 0..n-1, re, im)``: ``id, k 0..n-1, re, im``; absent indices count as zero.

    ``normalization``: none, forward or inverse (1/n in that direction only), orthogonal (1/sqrt n). A row of n numbers
    is one array, and the arrays of a batch are transformed together, so n is bounded by ``TASK_CELLS``; longer ones go
    through ``fft_distributed``.
    """
    ship(values.sparkSession)
    scale = {"none": 1.0, "orthogonal": n**-0.5, "forward": 1.0 if inverse else 1.0 / n, "inverse": 1.0 / n if inverse else 1.0}[normalization]
    sign, kind = 1 if inverse else -1, dict(values.dtypes)[id_col]
    if n > TASK_CELLS:
        raise ValueError(f"{n} is beyond {TASK_CELLS}")
    packed = values.groupBy(id_col).agg(F.collect_list(F.struct(F.col(index_col).cast("long").alias("i"), "re", "im")).alias("v"))

    def run(batches):
        import pyarrow as pa

        step = max(1, TASK_CELLS // 16 // n)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                own = batch.slice(a, step)
                lists = own.column(1)
                flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
                grid = np.zeros((own.num_rows, n), complex)
                grid[np.repeat(np.arange(own.num_rows), sizes), flat.field("i").to_numpy()] = flat.field("re").to_numpy() + 1j * flat.field("im").to_numpy()
                out = fft_array(grid, sign, axes=(1,)) * scale
                ids = own.column(0).take(pa.array(np.repeat(np.arange(own.num_rows), n)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(n, dtype=np.int32), own.num_rows)), pa.array(out.real.ravel()), pa.array(out.imag.ravel())], [id_col, "k", "re", "im"])

    return packed.mapInArrow(run, f"`{id_col}` {kind}, k int, re double, im double")
