"""Fast transforms of types 1 and 2: spread or interpolate, a uniform transform, and deconvolution."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterwave.config import TransformConfig
from scatterwave.functions.columns import kernel_at, linear_index
from scatterwave.functions.kernel import Kernel, axis_factors, layout_for, signed_modes
from scatterwave.operators import fft
from scatterwave.operators.direct import attach, fold, rounded
from scatterwave.operators.modes import axis_names, mode_table, transform_ids
from scatterwave.operators.spread import scatter_batch, spread, with_support
from scatterwave.runtime import dealt_out, ship

#: Grid cells over all transforms that are sent to every worker; above it grids stay rows and are joined.
BROADCAST_CELLS = 2**22


def _factor_table(spark, config: TransformConfig, d: int) -> DataFrame:
    layout, n = layout_for(config), config.n_modes[d]
    factors = axis_factors(n, layout.shape[d], layout.kernel)
    return spark.createDataFrame(pd.DataFrame({f"k{d}": signed_modes(n).astype(np.int32), f"a{d}": factors}))


def with_amplitude(modes: DataFrame, config: TransformConfig) -> DataFrame:
    """Adds ``amp``, the product of the axes' deconvolution factors; the factor tables have a row per axis mode."""
    out = modes
    for d, n in enumerate(config.n_modes):
        table = _factor_table(modes.sparkSession, config, d)
        out = out.join(F.broadcast(table) if n <= 2**20 else table, f"k{d}")
    amp = F.lit(1.0)
    for d in range(config.rank):
        amp = amp * F.col(f"a{d}")
    return out.withColumn("amp", amp).drop(*[f"a{d}" for d in range(config.rank)])


def cell_of_mode(config: TransformConfig):
    cell, stride = F.lit(0).cast("long"), 1
    for d, length in enumerate(layout_for(config).shape):
        cell, stride = cell + F.pmod(F.col(f"k{d}"), F.lit(length)).cast("long") * F.lit(stride), stride * length
    return cell


def type1(points: DataFrame, strengths: DataFrame, config: TransformConfig, active: int | None = None, strategy: str = "auto", deterministic: bool = False) -> DataFrame:
    """Same rows as the direct type 1, to within the tolerance.

    ``deterministic``: cells are summed by a task in point order, so the bits do not depend on the layout; it
    holds while a transform's grid fits a task.
    """
    active = config.check_active_batch(active)
    layout, ks = layout_for(config), axis_names("k", config.rank)
    spark = points.sparkSession
    data = attach(points, strengths, axis_names("x", config.rank), "point_id", config.precision).filter(F.col("transform_id").between(0, active - 1))
    if deterministic:
        grid = ordered_grid(data, layout)
    else:
        grid = spread(data, layout, active, strategy)
    spectrum = fft.fft_grid(grid, layout.shape, config.sign)
    modes = transform_ids(spark, active).crossJoin(with_amplitude(mode_table(spark, config), config)).withColumn("cell", cell_of_mode(config))
    out = modes.join(spectrum, ["transform_id", "cell"], "left")
    value = lambda c: (F.coalesce(F.col(c), F.lit(0.0)) * F.col("amp")).alias(c)
    return out.select("transform_id", "lin", *ks, value("re"), value("im"))


def ordered_grid(data: DataFrame, layout) -> DataFrame:
    """Blocks of 1,024 ids are spread each on its own, in id order, then added in block order: both orders are fixed."""
    ship(data.sparkSession)
    kernel, shape, total = layout.kernel, layout.shape, layout.cells
    names = [f"x{d}" for d in range(len(shape))]
    schema = "transform_id int, block long, cell long, re double, im double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["point_id", *names, "re", "im"], kind="stable")
        cells, w = scatter_batch([pdf[n].to_numpy(float) for n in names], shape, kernel)
        at, inverse = np.unique(cells.ravel(), return_inverse=True)
        re, im = (np.bincount(inverse, weights=(w * pdf[c].to_numpy(float)[:, None]).ravel()) for c in ("re", "im"))
        return pd.DataFrame({"transform_id": np.full(len(at), pdf["transform_id"].iloc[0], np.int32), "block": np.full(len(at), pdf["block"].iloc[0]), "cell": at, "re": re, "im": im})

    blocks = data.withColumn("block", F.floor(F.col("point_id") / 1024)).groupBy("transform_id", "block").applyInPandas(run, schema)
    return fold(blocks, ["transform_id", "cell"], "block")


def coefficient_grid(modes: DataFrame, config: TransformConfig, active: int) -> DataFrame:
    """Deconvolved modes at their cells; cells without a mode have no row and count as zero."""
    tid = F.col("transform_id") if "transform_id" in modes.columns else F.lit(0)
    ks = axis_names("k", config.rank)
    rows = modes.select(tid.cast("int").alias("transform_id"), *[F.col(k).cast("int").alias(k) for k in ks], rounded(F.col("re"), config.precision).alias("re"), rounded(F.col("im"), config.precision).alias("im"))
    rows = with_amplitude(rows.filter(F.col("transform_id").between(0, active - 1)), config)
    return rows.select("transform_id", cell_of_mode(config).alias("cell"), (F.col("re") * F.col("amp")).alias("re"), (F.col("im") * F.col("amp")).alias("im"))


def interpolate_broadcast(points: DataFrame, grids: np.ndarray, shape, kernel: Kernel, names: list[str], id_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Gather from dense grids that every worker holds (``grids``: transform x cells); points are never shuffled.

    ``carry``: columns of the points that go along with each result.
    """
    spark = points.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(grids)
    step = max(1, 2**20 // kernel.width ** len(shape))

    def run(batches):
        grid = held.value
        for pdf in batches:
            for i in range(0, len(pdf), step):
                own = pdf.iloc[i : i + step]
                cells, w = scatter_batch([own[n].to_numpy(float) for n in names], shape, kernel)
                for t in range(len(grid)):
                    c = np.einsum("ij,ij->i", grid[t][cells], w)
                    yield pd.DataFrame({"transform_id": np.full(len(own), t, np.int32), **{k: own[k].to_numpy() for k in kept}, "re": c.real, "im": c.imag})

    kept, kinds = [id_col, *carry], dict(points.dtypes)
    return dealt_out(points.select(*kept, *names)).mapInPandas(run, "transform_id int, " + ", ".join(f"{k} {kinds[k]}" for k in kept) + ", re double, im double")


def interpolate_relational(points: DataFrame, grid: DataFrame, layout, active: int, id_col: str, prefix: str = "x", carry: tuple[str, ...] = ()) -> DataFrame:
    """Gather as a join on the cell, for grids too large to send; all built-in operators.

    Points are told apart by their row, so those that share an id each have a result. A point's terms are added in the
    order of its cells, whatever the layout. Cells without a row count as zero.
    """
    kernel, rank = layout.kernel, len(layout.shape)
    spark = points.sparkSession
    kept = [id_col, *carry]
    rows = with_support(points.withColumn("row", F.monotonically_increasing_id()), layout, prefix)
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(kernel.width**rank - 1).cast("long"))))
    weight, cell, stride = F.lit(1.0), F.lit(0).cast("long"), 1
    for d, length in enumerate(layout.shape):
        at = F.col(f"start{d}") + F.pmod(F.floor(F.col("o") / F.lit(kernel.width**d)), F.lit(kernel.width))
        weight, cell, stride = weight * kernel_at(F.col(f"p{d}"), at, kernel), cell + F.pmod(at, F.lit(length)) * F.lit(stride), stride * length
    terms = rows.select("row", *kept, "o", cell.alias("cell"), weight.alias("w")).crossJoin(F.broadcast(transform_ids(spark, active)))  # one row a transform
    met = terms.join(grid, ["transform_id", "cell"], "left")
    value = lambda c: (F.coalesce(F.col(c), F.lit(0.0)) * F.col("w")).alias(c)
    items = F.sort_array(F.collect_list(F.struct("o", value("re"), value("im")))).alias("items")  # width ** rank of them
    total = lambda c: F.aggregate("items", F.lit(0.0), lambda acc, s: acc + s[c]).alias(c)
    return met.groupBy("transform_id", "row", *kept).agg(items).select("transform_id", *kept, total("re"), total("im"))


def gather_grids(grid: DataFrame, cells: int, active: int) -> np.ndarray:
    """A grid of proven size (checked by the caller) as one array on the driver."""
    out = np.zeros((active, cells), complex)
    pdf = grid.toPandas()
    out[pdf["transform_id"].to_numpy(), pdf["cell"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
    return out


def type2(points: DataFrame, modes: DataFrame, config: TransformConfig, active: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Same rows as the direct type 2, to within the tolerance, one for each row of points. The size of the grid picks the way."""
    active = config.check_active_batch(active)
    layout, xs = layout_for(config), axis_names("x", config.rank)
    grid = coefficient_grid(modes, config, active)
    pts = points.select("point_id", *carry, *[rounded(F.col(x), config.precision).alias(x) for x in xs])
    if layout.cells * active <= BROADCAST_CELLS:
        held = gather_grids(grid, layout.cells, active)
        for t in range(active):
            held[t] = fft.fft_array(held[t].reshape(layout.shape[::-1]), config.sign).ravel()
        return interpolate_broadcast(pts, held, layout.shape, layout.kernel, xs, "point_id", carry)
    spectrum = fft.fft_grid(grid, layout.shape, config.sign)
    return interpolate_relational(pts, spectrum, layout, active, "point_id", carry=carry)


def expected_cells(config: TransformConfig) -> int:
    return math.prod(layout_for(config).shape)


__all__ = ["coefficient_grid", "interpolate_broadcast", "interpolate_relational", "linear_index", "type1", "type2"]
