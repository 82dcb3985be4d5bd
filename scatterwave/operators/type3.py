"""Fast type 3: rescale both sets, spread sources on an outer grid, read it as modes of a type 2, correct."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterwave.config import Interval, Type3Config
from scatterwave.errors import TransformError
from scatterwave.functions.columns import phase, rotate
from scatterwave.functions.kernel import Kernel, Layout, continuous_kernel_fourier, kernel_for, layout_for, next_even_235
from scatterwave.operators import gridded
from scatterwave.operators.direct import attach, rounded
from scatterwave.operators.modes import axis_names
from scatterwave.operators.spread import spread
from scatterwave.runtime import ship

MAX_GRID = 10**12


@dataclass(frozen=True)
class Axis:
    """Planned geometry of one axis."""

    source_half: float
    source_center: float
    target_half: float
    target_center: float
    length: int
    spacing: float
    scale: float


def plan_axis(sources: Interval, targets: Interval, kernel: Kernel) -> Axis:
    x, c = sources.half_width_and_center()
    s, d = targets.half_width_and_center()
    if x == 0.0:
        x, s = (1.0, 1.0) if s == 0.0 else (1.0 / s, s)
    else:
        s = max(s, 1.0 / x)
    least = max(math.floor(2.0 * kernel.sigma * s * x / math.pi + kernel.width + 1), 2 * kernel.width)
    if least > MAX_GRID:
        raise TransformError(TransformError.T3_GRID_SIZE, length=least)
    length = next_even_235(least)
    scale = length / (2.0 * kernel.sigma * s)
    if not (math.isfinite(scale) and scale > 0):
        raise TransformError(TransformError.T3_RESCALING, scale=scale)
    return Axis(x, c, s, d, length, 2.0 * math.pi / length, scale)


@lru_cache(maxsize=32)
def plan_axes(config: Type3Config) -> tuple[Kernel, tuple[Axis, ...]]:
    kernel = kernel_for(config.eps, config.sigma)
    axes = tuple(plan_axis(a, b, kernel) for a, b in zip(config.source_bounds, config.target_bounds))
    if math.prod(a.length for a in axes) > MAX_GRID:
        raise TransformError(TransformError.T3_GRID_VOLUME, lengths=[a.length for a in axes])
    return kernel, axes


def bounds_of(rows: DataFrame, prefix: str, rank: int) -> tuple[Interval, ...]:
    """Per-axis minimum and maximum in one aggregate; an empty set has the point zero."""
    names = axis_names(prefix, rank)
    got = rows.agg(*[f(F.col(n)).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    return tuple(Interval(float(got[f"lo_{n}"] or 0.0), float(got[f"hi_{n}"] or 0.0)) for n in names)


def rescale_source(x, axis: Axis):
    return (x - axis.source_center) / axis.scale


def rescale_target(s, axis: Axis):
    return (s - axis.target_center) * (axis.spacing * axis.scale)


def prepare_sources(data: DataFrame, config: Type3Config) -> DataFrame:
    """Strengths turned by the targets' centre, coordinates scaled onto the outer grid."""
    _, axes = plan_axes(config)
    xs = axis_names("x", config.rank)
    angle = phase([F.col(x) for x in xs], [F.lit(a.target_center) for a in axes], config.sign)
    re, im = rotate(F.col("re"), F.col("im"), angle)
    return data.select("transform_id", "point_id", *[rescale_source(F.col(x), a).alias(x) for x, a in zip(xs, axes)], re.alias("re"), im.alias("im"))


def prepare_targets(targets: DataFrame, config: Type3Config) -> DataFrame:
    """Scaled frequencies ``x0..`` and the factor ``fre, fim`` that undoes the kernel and the sources' centre."""
    _, axes = plan_axes(config)
    ship(targets.sparkSession)
    ss, rank = axis_names("s", config.rank), config.rank

    def run(batches):
        for pdf in batches:
            s = pdf[ss].to_numpy(float)
            out = {"target_id": pdf["target_id"].to_numpy()} | {f"x{d}": rescale_target(s[:, d], a) for d, a in enumerate(axes)}
            factor = post_phase(s, config)
            yield pd.DataFrame(out | {"fre": factor.real, "fim": factor.imag})

    kind = dict(targets.dtypes)["target_id"]
    schema = f"target_id {kind}, " + ", ".join(f"x{d} double" for d in range(rank)) + ", fre double, fim double"
    return targets.select("target_id", *[rounded(F.col(s), config.precision).alias(s) for s in ss]).mapInPandas(run, schema)


def type3(sources: DataFrame, strengths: DataFrame, targets: DataFrame, config: Type3Config, active: int | None = None, prepared: tuple[DataFrame, DataFrame] | None = None, deterministic: bool = False) -> DataFrame:
    """Same rows as the direct type 3, to within the tolerance, one for each row of targets; targets are never shuffled
    while the inner grid can be sent. ``prepared``: sources with strengths, and targets. ``deterministic``: sources are
    spread in id order, so the bits do not depend on the layout.
    """
    from scatterwave.config import TransformConfig

    active = config.check_active_batch(active)
    kernel, axes = plan_axes(config)
    shape = tuple(a.length for a in axes)
    outer = Layout(kernel, shape)
    if prepared is None:
        data = attach(sources, strengths, axis_names("x", config.rank), "point_id", config.precision).filter(F.col("transform_id").between(0, active - 1))
        prepared = prepare_sources(data, config), prepare_targets(targets, config)
    data, goals = prepared
    grid = gridded.ordered_grid(data, outer) if deterministic else spread(data, outer, active)
    # Cell i of the outer grid is mode i - length/2 of the inner transform.
    modes, stride = grid, 1
    for d, n in enumerate(shape):
        modes = modes.withColumn(f"k{d}", (F.pmod(F.floor(F.col("cell") / stride), F.lit(n)) - n // 2).cast("int"))
        stride *= n
    inner = TransformConfig(shape, batch=active, eps=config.eps, isign=config.sign, sigma=config.sigma)
    layout_for(inner)
    out = gridded.type2(goals.withColumnRenamed("target_id", "point_id"), modes, inner, active, ("fre", "fim"))
    re, im = F.col("re") * F.col("fre") - F.col("im") * F.col("fim"), F.col("re") * F.col("fim") + F.col("im") * F.col("fre")
    return out.select("transform_id", F.col("point_id").alias("target_id"), re.alias("re"), im.alias("im"))


def axes_of(config: Type3Config) -> list[dict[str, float]]:
    """The planned geometry of each axis: half-widths and centres of both sets, length, spacing and scale of the grid."""
    from dataclasses import asdict

    return [asdict(a) for a in plan_axes(config)[1]]


def post_phase(s, config: Type3Config):
    """Factor that undoes the kernel and the sources' centre at frequencies ``s`` (targets x axes), as numpy."""
    kernel, axes = plan_axes(config)
    s = np.asarray(s, float)
    turn = sum(a.source_center * (s[:, d] - a.target_center) for d, a in enumerate(axes))
    fade = np.prod([continuous_kernel_fourier(rescale_target(s[:, d], a), kernel) for d, a in enumerate(axes)], axis=0)
    return np.exp(1j * config.sign * turn) / fade
