"""Exact transforms as joins and aggregates; a Python worker takes part only in ordered sums of type 1.
Type 3 over many targets of one axis sums at nodes and interpolates, beyond the precision of doubles.

Rows: ``points(point_id, x0..)``, ``strengths(transform_id, point_id, re, im)``,
``modes(transform_id, k0.., re, im)``, ``targets(target_id, s0..)``.
Empty inputs give zeros for every mode or target, and no rows where there is no point to answer for.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterwave.config import ModeOrder, Precision, TransformConfig, Type3Config
from scatterwave.functions.columns import phase, rotate
from scatterwave.functions.kernel import signed_modes
from scatterwave.operators.modes import axis_names, mode_table, transform_ids
from scatterwave.runtime import broadcast_if_small, dealt_out, ship

FOLD = 1024
#: Modes of one array of type 2, and those that an ordered task sums at once; beyond, terms are ordered as rows.
BLOCK_MODES, ORDERED_MODES = 65_536, 2**18
#: Type 3 on one axis: most radians by which a term turns over half a panel of targets, and Chebyshev nodes of a panel.
#: Interpolation is off by 4 (PANEL_PHASE / 2)^n / n! of the strengths' magnitude, summed over n >= PANEL_NODES: under 6e-20.
PANEL_PHASE, PANEL_NODES = 8.0, 36


def rounded(column: Column, precision: Precision) -> Column:
    return column.cast("float").cast("double") if precision is Precision.F32 else column.cast("double")


def attach(points: DataFrame, values: DataFrame, names: list[str], id_col: str, precision: Precision) -> DataFrame:
    """Coordinates beside each strength. One table may hold both, and then nothing is joined."""
    cols = [rounded(F.col(c), precision).alias(c) for c in names]
    tid = F.col("transform_id") if "transform_id" in values.columns else F.lit(0)
    own = [tid.cast("int").alias("transform_id"), F.col(id_col), rounded(F.col("re"), precision).alias("re"), rounded(F.col("im"), precision).alias("im")]
    if values is points:
        return points.select(*own, *cols)
    return values.select(*own).join(points.select(id_col, *cols), id_col)


def fold(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Adds ``re, im`` of each key in the order of ``at``, FOLD partial sums at a time, so no list grows with the data."""

    def folded(value: str) -> Column:
        return F.aggregate(F.sort_array(F.col("items")), F.lit(0.0), lambda acc, s: acc + s[value]).alias(value)

    items = F.collect_list(F.struct(F.col(at).alias("at"), "re", "im")).alias("items")
    parts = rows.groupBy(*keys, F.floor(F.col(at) / FOLD).alias("part")).agg(items).select(*keys, "part", folded("re"), folded("im"))
    last = F.collect_list(F.struct(F.col("part").alias("at"), "re", "im")).alias("items")
    return parts.groupBy(*keys).agg(last).select(*keys, folded("re"), folded("im"))


def _ordered_type1(data: DataFrame, config: TransformConfig) -> DataFrame:
    """``transform_id, lin, re, im`` with a fixed order of summation: blocks of 1,024 ids are each summed in id order in one
    place, then the blocks in order. A block gives one row for each mode, so points are shuffled once and terms never.
    """
    ship(data.sparkSession)
    xs = axis_names("x", config.rank)
    axes = [np.fft.ifftshift(signed_modes(n)) if config.mode_order is ModeOrder.FFT else signed_modes(n) for n in config.n_modes]
    sign, count = config.sign, config.mode_count

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["point_id", *xs, "re", "im"], kind="stable")
        c, x = pdf["re"].to_numpy(float) + 1j * pdf["im"].to_numpy(float), [pdf[n].to_numpy(float) for n in xs]
        total = np.zeros(count, complex)
        step = max(1, 2**20 // count)
        for i in range(0, len(c), step):
            terms = c[i : i + step, None]
            for d, k in enumerate(axes):  # dimension zero is the fastest
                terms = (np.exp(1j * sign * np.outer(x[d][i : i + step], k))[:, :, None] * terms[:, None, :]).reshape(len(terms), -1)
            for row in terms:
                total += row
        return pd.DataFrame({"transform_id": np.full(count, pdf["transform_id"].iloc[0], np.int32), "block": np.full(count, pdf["block"].iloc[0]), "lin": np.arange(count), "re": total.real, "im": total.imag})

    blocks = data.withColumn("block", F.floor(F.col("point_id") / FOLD)).groupBy("transform_id", "block").applyInPandas(run, "transform_id int, block long, lin long, re double, im double")
    return fold(blocks, ["transform_id", "lin"], "block")


def _sums(rows: DataFrame, keys: list[str], deterministic: bool, id_col: str) -> DataFrame:
    """Sum re and im for each key; the ordered way adds the terms in id order, so layout cannot change a bit."""
    if not deterministic:
        return rows.groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return fold(rows, keys, id_col)


def type1(points: DataFrame, strengths: DataFrame, config: TransformConfig, active: int | None = None, deterministic: bool = False) -> DataFrame:
    """``f_k = sum_j c_j exp(i sign k x_j)`` over every mode: ``transform_id, lin, k0.., re, im``.

    Points stream past the broadcast mode table and are summed map-side, so the shuffle carries one row
    per mode and task. Modes beyond the broadcast limit make Spark deal both sides out instead.
    """
    active = config.check_active_batch(active)
    spark, xs, ks = points.sparkSession, axis_names("x", config.rank), axis_names("k", config.rank)
    modes = mode_table(spark, config)
    data = attach(points, strengths, xs, "point_id", config.precision).filter(F.col("transform_id").between(0, active - 1))
    every = transform_ids(spark, active).crossJoin(modes)
    if deterministic and config.mode_count <= ORDERED_MODES:
        sums = _ordered_type1(data, config)
        return every.join(sums, ["transform_id", "lin"], "left").select("transform_id", "lin", *ks, F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im"))
    angle = phase([F.col(x) for x in xs], [F.col(k) for k in ks], config.sign)
    re, im = rotate(F.col("re"), F.col("im"), angle)
    terms = dealt_out(data).crossJoin(broadcast_if_small(modes, config.mode_count)).select("transform_id", "lin", *ks, "point_id", re.alias("re"), im.alias("im"))
    zeros = every.select("transform_id", "lin", *ks, F.lit(-1).cast("long").alias("point_id"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    return _sums(terms.unionByName(zeros), ["transform_id", "lin", *ks], deterministic, "point_id")


def type2(points: DataFrame, modes: DataFrame, config: TransformConfig, active: int | None = None) -> DataFrame:
    """``c_j = sum_k f_k exp(i sign k x_j)`` at every point: ``transform_id, point_id, re, im``.

    The modes of a transform travel as one array, sorted by mode, beside which points are evaluated in place:
    no shuffle of points, and a fixed order of summation. More than ``BLOCK_MODES`` modes travel in several arrays,
    whose sums meet by the point's row, so no task holds them all. Points that share an id each have their row.
    """
    active = config.check_active_batch(active)
    xs, ks = axis_names("x", config.rank), axis_names("k", config.rank)
    spark = points.sparkSession
    tid = F.col("transform_id") if "transform_id" in modes.columns else F.lit(0)
    rows = modes.select(tid.cast("int").alias("transform_id"), *ks, rounded(F.col("re"), config.precision).alias("re"), rounded(F.col("im"), config.precision).alias("im"))
    rows = rows.filter(F.col("transform_id").between(0, active - 1))
    blocks = -(-config.mode_count // BLOCK_MODES)
    block = F.pmod(F.xxhash64(*ks), F.lit(blocks)) if blocks > 1 else F.lit(0).cast("long")
    packed = rows.groupBy("transform_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct(*[F.col(k) for k in reversed(ks)], "re", "im"))).alias("f"))
    every = transform_ids(spark, active).crossJoin(spark.range(blocks).withColumnRenamed("id", "block"))
    packed = every.join(packed, ["transform_id", "block"], "left")
    pts = dealt_out(points.select("point_id", *[rounded(F.col(x), config.precision).alias(x) for x in xs]))
    if blocks > 1:
        pts = pts.withColumn("row", F.monotonically_increasing_id())

    def step(acc: Column, m: Column) -> Column:
        re, im = rotate(m["re"], m["im"], phase([F.col(x) for x in xs], [m[k] for k in ks], config.sign))
        return F.struct((acc["re"] + re).alias("re"), (acc["im"] + im).alias("im"))

    zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    total = F.when(F.col("f").isNull(), zero).otherwise(F.aggregate(F.col("f"), zero, step))
    out = pts.crossJoin(broadcast_if_small(packed, config.mode_count * active))
    if blocks == 1:
        return out.select("transform_id", "point_id", total.alias("c")).select("transform_id", "point_id", "c.re", "c.im")
    parts = out.select("transform_id", "point_id", "row", "block", total.alias("c")).select("transform_id", "point_id", "row", "block", "c.re", "c.im")
    return fold(parts, ["transform_id", "row", "point_id"], "block").drop("row")


def _pairs(data: DataFrame, goals: DataFrame, config: Type3Config, active: int, deterministic: bool) -> DataFrame:
    """Every source with every target."""
    xs, ss = axis_names("x", config.rank), axis_names("s", config.rank)
    re, im = rotate(F.col("re"), F.col("im"), phase([F.col(x) for x in xs], [F.col(s) for s in ss], config.sign))
    terms = dealt_out(data).crossJoin(goals).select("transform_id", "target_id", "point_id", re.alias("re"), im.alias("im"))
    zeros = transform_ids(goals.sparkSession, active).crossJoin(goals).select("transform_id", "target_id", F.lit(-1).cast("long").alias("point_id"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    return _sums(terms.unionByName(zeros), ["transform_id", "target_id"], deterministic, "point_id")


def _extent(rows: DataFrame, name: str) -> tuple[int, float, float]:
    """Rows, and the least and largest finite value of an axis."""
    own = F.when(F.abs(F.col(name)) < math.inf, F.col(name))
    n, lower, upper = rows.agg(F.count(F.lit(1)), F.min(own), F.max(own)).first()
    return n, lower or 0.0, upper or 0.0


def _panels(sources: DataFrame, goals: DataFrame) -> tuple[int, float, float, float] | None:
    """Number of panels, lower end, width of a panel and the sources' centre; nothing where all pairs are less work."""
    points, left, right = _extent(sources, "x0")
    targets, lower, upper = _extent(goals, "s0")
    turn = (right / 2 - left / 2) * (upper / 2 - lower / 2)
    if not (turn < PANEL_PHASE * targets and upper - lower < math.inf):
        return None
    panels = max(1, math.ceil(turn / PANEL_PHASE))
    if points * panels * PANEL_NODES + targets * PANEL_NODES >= points * targets:
        return None
    return panels, lower, (upper - lower) / panels or 1.0, left / 2 + right / 2


def _by_panels(data: DataFrame, goals: DataFrame, config: Type3Config, active: int, deterministic: bool, plan: tuple[int, float, float, float]) -> DataFrame:
    """Every source with the Chebyshev nodes of each panel of targets, then each target by its panel's polynomial.

    Around the sources' centre a sum turns by PANEL_PHASE at most over half a panel, so PANEL_NODES values determine it to
    more digits than a double has, for any strengths. Targets are not shuffled but to add up rows that share an id, as all pairs do.
    """
    spark, (panels, lower, width, center), sign = goals.sparkSession, plan, config.sign
    count = panels * PANEL_NODES
    angle = (F.col("target_id") % PANEL_NODES + 0.5) * (math.pi / PANEL_NODES)
    place = F.floor(F.col("target_id") / PANEL_NODES) + (F.cos(angle) + 1.0) / 2.0
    nodes = spark.range(count).withColumnRenamed("id", "target_id").withColumn("s0", lower + place * width)
    at_nodes = _pairs(data.withColumn("x0", F.col("x0") - center), broadcast_if_small(nodes, count), config, active, deterministic)
    orders = broadcast_if_small(spark.range(PANEL_NODES).withColumnRenamed("id", "order"), PANEL_NODES)
    weight = F.cos(angle * F.col("order")) * F.when(F.col("order") == 0, 1.0 / PANEL_NODES).otherwise(2.0 / PANEL_NODES)
    terms = at_nodes.crossJoin(orders).select("transform_id", F.floor(F.col("target_id") / PANEL_NODES).alias("panel"), "order", "target_id", (F.col("re") * weight).alias("re"), (F.col("im") * weight).alias("im"))
    series = _sums(terms, ["transform_id", "panel", "order"], deterministic, "target_id")
    series = series.groupBy("transform_id", "panel").agg(F.reverse(F.array_sort(F.collect_list(F.struct("order", "re", "im")))).alias("f"))

    within = (F.col("s0") - lower) / width
    panel = F.least(F.greatest(F.floor(within), F.lit(0)), F.lit(panels - 1))  # 0 for null and NaN
    rows = dealt_out(goals).withColumn("panel", panel.cast("long")).withColumn("t", (within - F.col("panel")) * 2.0 - 1.0)

    def step(acc: Column, c: Column) -> Column:
        """Clenshaw's recurrence, from the highest order down."""
        now = [(c[v] + F.col("t") * 2.0 * acc[v] - acc[f"{v}_before"]).alias(v) for v in ("re", "im")]
        return F.struct(*now, acc["re"].alias("re_before"), acc["im"].alias("im_before"))

    zero = F.struct(*[F.lit(0.0).alias(v) for v in ("re", "im", "re_before", "im_before")])
    met = rows.join(broadcast_if_small(series, count * active), "panel").select("transform_id", "target_id", "s0", "t", F.aggregate(F.col("f"), zero, step).alias("c"))
    re, im = rotate(*[F.col(f"c.{v}") - F.col("t") * F.col(f"c.{v}_before") for v in ("re", "im")], phase([F.lit(center)], [F.col("s0")], sign))
    out = met.select("transform_id", "target_id", F.lit(-1).cast("long").alias("point_id"), F.coalesce(re, F.lit(0.0)).alias("re"), F.coalesce(im, F.lit(0.0)).alias("im"))
    return _sums(out, ["transform_id", "target_id"], deterministic, "point_id")


def type3(sources: DataFrame, strengths: DataFrame, targets: DataFrame, config: Type3Config, active: int | None = None, deterministic: bool = False) -> DataFrame:
    """``f_k = sum_j c_j exp(i sign s_k x_j)`` at every target: ``transform_id, target_id, re, im``.

    All pairs, or on one axis, where that is less work, all sources with the nodes of panels of targets: as many as the
    product of both extents asks for, with results as exact as all pairs give. Extents are taken from the rows, not from
    the configured bounds. ``scatterwave.operators.type3`` is the near-linear way, to within a tolerance.
    """
    active = config.check_active_batch(active)
    xs, ss = axis_names("x", config.rank), axis_names("s", config.rank)
    data = attach(sources, strengths, xs, "point_id", config.precision).filter(F.col("transform_id").between(0, active - 1))
    goals = targets.select("target_id", *[rounded(F.col(s), config.precision).alias(s) for s in ss])
    plan = _panels(sources.select(rounded(F.col("x0"), config.precision).alias("x0")), goals) if config.rank == 1 else None
    return _by_panels(data, goals, config, active, deterministic, plan) if plan else _pairs(data, goals, config, active, deterministic)


def uniform_dft(values: DataFrame, id_col: str, index_col: str, n: int, inverse: bool = False, normalization: str = "none") -> DataFrame:
    """Uniform transform of rows ``(id, index 0..n-1, re, im)`` as a direct sum: ``id, k 0..n-1, re, im``.

    ``normalization``: none, forward or inverse (1/n in that direction only), orthogonal (1/sqrt n).
    """
    scale = {"none": 1.0, "orthogonal": n**-0.5, "forward": 1.0 if inverse else 1.0 / n, "inverse": 1.0 / n if inverse else 1.0}[normalization]
    ks = values.sparkSession.range(n).select(F.col("id").cast("int").alias("k"))
    angle = (F.pmod(F.col(index_col) * F.col("k"), F.lit(n)).cast("double")) * ((2.0 if inverse else -2.0) * 3.141592653589793 / n)
    re, im = rotate(F.col("re"), F.col("im"), angle)
    terms = values.crossJoin(broadcast_if_small(ks, n)).select(id_col, "k", re.alias("re"), im.alias("im"))
    return terms.groupBy(id_col, "k").agg((F.sum("re") * scale).alias("re"), (F.sum("im") * scale).alias("im"))
