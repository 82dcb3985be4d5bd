"""From points to a fine grid: supports, bins, and two ways to scatter kernel weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scatterwave.functions.columns import grid_position, kernel_at, support_start
from scatterwave.functions.kernel import Kernel, Layout, support
from scatterwave.runtime import dealt_out, ship

#: Cells of a task's private dense grid over all transforms; above it the relational way is taken.
DENSE_CELLS = 2**22
GRID_SCHEMA = "transform_id int, cell long, re double, im double"


def with_support(points: DataFrame, layout: Layout, prefix: str = "x") -> DataFrame:
    """Adds ``p{d}`` (position in cells) and ``start{d}`` (first support cell, not wrapped) for each axis."""
    out = points
    for d, length in enumerate(layout.shape):
        out = out.withColumn(f"p{d}", grid_position(F.col(f"{prefix}{d}"), length))
        out = out.withColumn(f"start{d}", support_start(F.col(f"p{d}"), layout.kernel.width))
    return out


def bin_column(layout: Layout, side: int = 32):
    """Bin number of a supported point: cubes of ``side`` cells, dimension zero fastest."""
    out, stride = F.lit(0).cast("long"), 1
    for d, length in enumerate(layout.shape):
        out = out + F.least(F.floor(F.col(f"p{d}") / side), F.lit((length - 1) // side)).cast("long") * F.lit(stride)
        stride *= -(-length // side)
    return out


def bin_histogram(points: DataFrame, layout: Layout, side: int = 32) -> DataFrame:
    return with_support(points, layout).groupBy(bin_column(layout, side).alias("bin")).agg(F.count("*").alias("n"))


def bin_offsets(histogram: DataFrame) -> DataFrame:
    """Exclusive prefix sum of a histogram. Its rows are bounded by the grid, so one ordered window is in order."""
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return histogram.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def bin_sorted(points: DataFrame, layout: Layout, side: int = 32) -> DataFrame:
    """Points beside their neighbours on the grid: prepared input for repeated transforms."""
    supported = with_support(points, layout).withColumn("bin", bin_column(layout, side))
    return supported.repartitionByRange("bin", "point_id").sortWithinPartitions("bin", "point_id")


def spread_relational(data: DataFrame, layout: Layout) -> DataFrame:
    """Scatter-add inside Catalyst: each point meets the kernel's offsets, and cells are summed map-side first."""
    kernel, rank = layout.kernel, len(layout.shape)
    spark = data.sparkSession
    offsets = spark.range(kernel.width**rank)
    for d in range(rank):
        offsets = offsets.withColumn(f"o{d}", F.pmod(F.floor(F.col("id") / F.lit(kernel.width**d)), F.lit(kernel.width)))
    joined = with_support(data, layout).crossJoin(F.broadcast(offsets.drop("id")))
    weight, cell, stride = F.lit(1.0), F.lit(0).cast("long"), 1
    for d, length in enumerate(layout.shape):
        at = F.col(f"start{d}") + F.col(f"o{d}")
        weight = weight * kernel_at(F.col(f"p{d}"), at, kernel)
        cell = cell + F.pmod(at, F.lit(length)) * F.lit(stride)
        stride *= length
    rows = joined.select("transform_id", cell.alias("cell"), (F.col("re") * weight).alias("re"), (F.col("im") * weight).alias("im"))
    return rows.groupBy("transform_id", "cell").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def scatter_batch(coords: list[np.ndarray], shape, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Cells and weights, one row a point, of the product kernel over all axes."""
    m = len(coords[0])
    cells, weights, stride = np.zeros((m, 1), np.int64), np.ones((m, 1)), 1
    for x, length in zip(coords, shape):
        start, w = support(x, length, kernel)
        at = np.mod(start[:, None] + np.arange(kernel.width), length) * stride
        cells = (cells[:, :, None] + at[:, None, :]).reshape(m, -1)
        weights = (weights[:, :, None] * w[:, None, :]).reshape(m, -1)
        stride *= length
    return cells, weights


def spread_dense(data: DataFrame, layout: Layout, prefix: str = "x") -> DataFrame:
    """Each task adds its points to a private dense grid with numpy; only touched cells are shuffled and summed."""
    ship(data.sparkSession)
    kernel, shape, total = layout.kernel, layout.shape, layout.cells
    names = [f"{prefix}{d}" for d in range(len(shape))]
    step = max(1, 2**20 // kernel.width ** len(shape))

    def run(batches):
        grids: dict[int, np.ndarray] = {}
        for pdf in batches:
            for t, part in pdf.groupby("transform_id", sort=False):
                grid = grids.setdefault(int(t), np.zeros((2, total)))
                for i in range(0, len(part), step):
                    own = part.iloc[i : i + step]
                    cells, w = scatter_batch([own[n].to_numpy(float) for n in names], shape, kernel)
                    at = cells.ravel()
                    for row, c in enumerate(("re", "im")):
                        add = np.bincount(at, weights=(w * own[c].to_numpy(float)[:, None]).ravel(), minlength=total if len(at) * 4 > total else 0)
                        grid[row, : len(add)] += add
        for t, grid in grids.items():
            at = np.flatnonzero(grid.any(axis=0))
            for i in range(0, len(at), 100_000):
                j = at[i : i + 100_000]
                yield pd.DataFrame({"transform_id": np.full(len(j), t, np.int32), "cell": j, "re": grid[0, j], "im": grid[1, j]})

    parts = dealt_out(data.select("transform_id", "re", "im", *names)).mapInPandas(run, GRID_SCHEMA)
    return parts.groupBy("transform_id", "cell").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def spread_sparse(data: DataFrame, layout: Layout, prefix: str = "x") -> DataFrame:
    """For ranks above 3 and grids too large for a task: each batch adds up the cells that it touches, and no more.

    Memory is bounded by a batch's terms (2^20 at a time, or one point's), whatever the grid.
    """
    ship(data.sparkSession)
    kernel, shape = layout.kernel, layout.shape
    names = [f"{prefix}{d}" for d in range(len(shape))]
    step = max(1, 2**20 // kernel.width ** len(shape))

    def run(batches):
        for pdf in batches:
            for t, part in pdf.groupby("transform_id", sort=False):
                for i in range(0, len(part), step):
                    own = part.iloc[i : i + step]
                    cells, w = scatter_batch([own[n].to_numpy(float) for n in names], shape, kernel)
                    at, inverse = np.unique(cells.ravel(), return_inverse=True)
                    re, im = (np.bincount(inverse, weights=(w * own[c].to_numpy(float)[:, None]).ravel()) for c in ("re", "im"))
                    yield pd.DataFrame({"transform_id": np.full(len(at), t, np.int32), "cell": at, "re": re, "im": im})

    parts = dealt_out(data.select("transform_id", "re", "im", *names)).mapInPandas(run, GRID_SCHEMA)
    return parts.groupBy("transform_id", "cell").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def spread(data: DataFrame, layout: Layout, active: int = 1, strategy: str = "auto") -> DataFrame:
    """``strategy``: dense, relational, sparse, or auto: dense while a task's private grids fit; beyond, relational up to rank 3 and sparse above."""
    if strategy == "auto":
        strategy = "dense" if layout.cells * active <= DENSE_CELLS else "relational" if len(layout.shape) <= 3 else "sparse"
    return {"dense": spread_dense, "relational": spread_relational, "sparse": spread_sparse}[strategy](data, layout)
