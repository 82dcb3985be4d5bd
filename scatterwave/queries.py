"""Registered queries of the transforms, and the same questions in plain SQL.

Values are divided by the sum of the strengths' magnitudes and rounded to six places on both sides, so that the
order in which doubles are summed cannot show.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterwave.config import TransformConfig, Type3Config
from scatterwave.errors import TransformError
from scatterwave.functions import kernel as kern
from scatterwave.functions.columns import es_kernel, join_df64, split_df64
from scatterwave.operators import direct, fft, gridded, type3
from scatterwave.operators.modes import axis_names, mode_table
from scatterwave.operators.spread import bin_histogram, bin_offsets, bin_sorted, spread_dense, spread_relational
from scatterwave.operators.validate import violations
from scatterwave.plans import arrays, sql
from scatterwave.plans.plan import AutoBoundsType3, Plan
from scatterwave.runtime import broadcast_if_small
from scatterwave.sources.tables import event_points, lineitem_points, table
from scatterwave.streaming.type1 import type1_stream

SQL_EVENTS = (
    "(SELECT event_id AS point_id, event_type, user_id, value AS re, CAST((((date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts)"
    " % 86400000000) + 86400000000) % 86400000000) AS DOUBLE) / 86400000000.0::DOUBLE * 6.283185307179586::DOUBLE - 3.141592653589793::DOUBLE AS x0 FROM events)"
)
SQL_LINES = "(SELECT l_discount * 31.0::DOUBLE - 1.5::DOUBLE AS x0, l_quantity * 0.12::DOUBLE - 3.0::DOUBLE AS x1, l_tax * 37.0::DOUBLE - 1.4::DOUBLE AS x2, l_extendedprice / 100000.0::DOUBLE AS re FROM lineitem)"


def _round(c: Column, name: str, digits: int = 6) -> Column:
    return (F.round(c, digits) + 0.0).alias(name)


def _normal(out: DataFrame, points: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    norm = points.agg(F.coalesce(F.sum(F.abs("re")), F.lit(1.0)).alias("norm"))
    rows = out.crossJoin(F.broadcast(norm))  # one row
    return rows.select(*keys, _round(F.col("re") / F.col("norm"), "re", digits), _round(F.col("im") / F.col("norm"), "im", digits))


def _sql_modes(n_modes, order: str = "centered") -> str:
    """Mode table as SQL over generate_series."""
    axes = []
    for d, n in enumerate(n_modes):
        k = f"i{d} - {n // 2}" if order == "centered" else f"CASE WHEN i{d} < {(n + 1) // 2} THEN i{d} ELSE i{d} - {n} END"
        axes.append(f"(SELECT CAST(i{d} AS BIGINT) AS i{d}, CAST({k} AS INTEGER) AS k{d} FROM generate_series(0, {n - 1}) g{d}(i{d}))")
    lin, stride = [], 1
    for d, n in enumerate(n_modes):
        lin.append(f"i{d} * {stride}")
        stride *= n
    ks = ", ".join(f"k{d}" for d in range(len(n_modes)))
    return f"(SELECT CAST({' + '.join(lin)} AS BIGINT) AS lin, {ks} FROM {', '.join(axes)})"


def _sql_type1(points: str, n_modes, sign: int = 1, order: str = "centered", extra: str = "", digits: int = 6) -> str:
    rank = len(n_modes)
    angle = "(" + " + ".join(f"x{d} * k{d}" for d in range(rank)) + ")"
    ks = ", ".join(f"k{d}" for d in range(rank))
    return (
        f"WITH p AS (SELECT * FROM {points} WHERE 1 = 1 {extra}), m AS {_sql_modes(n_modes, order)}, n AS (SELECT coalesce(sum(abs(re)), 1.0) AS norm FROM p),"
        f" f AS (SELECT lin, {ks}, sum(re * cos({angle})) AS re, {sign} * sum(re * sin({angle})) AS im FROM m LEFT JOIN p ON TRUE GROUP BY ALL)"
        f" SELECT lin, {ks}, round(coalesce(re, 0) / norm, {digits}) + 0.0 AS re, round(coalesce(im, 0) / norm, {digits}) + 0.0 AS im FROM f, n"
    )


def _type1(points: DataFrame, config: TransformConfig, run=direct.type1) -> DataFrame:
    return _normal(run(points, points, config), points, ["lin", *axis_names("k", config.rank)])


def _events(n: int, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _type1(event_points(spark, sf_dir), TransformConfig((n,), **options))

    return query


def _lines(n_modes, run=direct.type1, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _type1(lineitem_points(spark, sf_dir, len(n_modes)), TransformConfig(n_modes, **options), run)

    return query


def t1_no_points(spark, sf_dir):
    return _type1(event_points(spark, sf_dir).filter("point_id < 0"), TransformConfig((6,)))


def _typed_events(spark, sf_dir):
    """Five event types as five transforms; types are numbered in alphabetic order by a small aggregate."""
    from pyspark.sql import Window

    points = event_points(spark, sf_dir).drop("transform_id")
    kinds = points.select("event_type").distinct().withColumn("transform_id", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int"))
    return points.join(broadcast_if_small(kinds, kinds.count()), "event_type"), kinds


def t1_batch_by_event_type(spark, sf_dir):
    points, kinds = _typed_events(spark, sf_dir)
    active = kinds.count()
    out = direct.type1(points, points, TransformConfig((16,), batch=active))
    return _normal(out, points, ["transform_id", "lin", "k0"])


def t1_grouped_by_user(spark, sf_dir):
    """A transform for each user, keyed by the user: groups need no numbering."""
    points = event_points(spark, sf_dir)
    modes = mode_table(spark, TransformConfig((8,)))
    angle = F.col("x0") * F.col("k0")
    terms = points.crossJoin(F.broadcast(modes))  # eight rows
    out = terms.groupBy("user_id", "k0").agg(F.sum(F.col("re") * F.cos(angle)).alias("re"), F.sum(F.col("re") * F.sin(angle)).alias("im"), F.sum(F.abs("re")).alias("norm"))
    return out.select("user_id", "k0", _round(F.col("re") / F.col("norm"), "re"), _round(F.col("im") / F.col("norm"), "im"))


def _coefficients(spark: SparkSession, n_modes, batch: int = 1) -> DataFrame:
    """Decaying coefficients, made by a rule."""
    ids = spark.range(batch).select(F.col("id").cast("int").alias("transform_id"))
    modes = mode_table(spark, TransformConfig(n_modes)).crossJoin(ids)
    return modes.withColumn("re", 1.0 / (1.0 + F.col("lin") + F.col("transform_id"))).withColumn("im", 0.5 / (2.0 + F.col("lin")))


def _sql_type2(points: str, n_modes, batch: int = 1, keys: str = "point_id", digits: int = 6) -> str:
    angle = "(" + " + ".join(f"x{d} * k{d}" for d in range(len(n_modes))) + ")"
    return (
        f"WITH f AS (SELECT *, CAST(t AS INTEGER) AS transform_id, 1.0::DOUBLE / (1.0::DOUBLE + lin + t) AS fre, 0.5::DOUBLE / (2.0::DOUBLE + lin) AS fim FROM {_sql_modes(n_modes)}, generate_series(0, {batch - 1}) g(t))"
        f" SELECT transform_id, {keys}, round(sum(fre * cos({angle}) - fim * sin({angle})), {digits}) + 0.0 AS re, round(sum(fre * sin({angle}) + fim * cos({angle})), {digits}) + 0.0 AS im FROM {points}, f GROUP BY transform_id, {keys}"
    )


def _type2_events(n: int, batch: int = 1, run=direct.type2):
    def query(spark, sf_dir):
        out = run(event_points(spark, sf_dir), _coefficients(spark, (n,), batch), TransformConfig((n,), batch=batch))
        return out.select("transform_id", "point_id", _round(F.col("re"), "re"), _round(F.col("im"), "im"))

    return query


def _order_points(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_totalprice") / 100000.0 - 2.0).alias("x0"), (F.pmod(F.col("o_custkey"), F.lit(100)) / 20.0 - 2.0).alias("x1"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"), F.lit(0).alias("transform_id"))


SQL_ORDERS = "(SELECT o_orderkey AS point_id, o_totalprice / 100000.0::DOUBLE - 2.0::DOUBLE AS x0, (o_custkey % 100) / 20.0::DOUBLE - 2.0::DOUBLE AS x1, 1.0::DOUBLE AS re FROM orders)"


def t2_2d_orders(spark, sf_dir):
    out = direct.type2(_order_points(spark, sf_dir), _coefficients(spark, (6, 5)), TransformConfig((6, 5)))
    return out.select("transform_id", "point_id", _round(F.col("re"), "re"), _round(F.col("im"), "im"))


def _supplier_sources(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_acctbal") / 1000.0).alias("x0"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"), F.lit(0).alias("transform_id"))


def _customer_targets(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_id"), (F.col("c_acctbal") / 500.0).alias("s0"))


def _type3(sources, targets, run, **options):
    rank = sum(c[0] == "x" for c in sources.columns)
    config = Type3Config(type3.bounds_of(sources, "x", rank), type3.bounds_of(targets, "s", rank), **options)
    return _normal(run(sources, sources, targets, config), sources, ["target_id"])


def t3_1d_supplier_customer(spark, sf_dir):
    return _type3(_supplier_sources(spark, sf_dir), _customer_targets(spark, sf_dir), direct.type3)


def _nation_targets(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("target_id"), (F.col("n_nationkey") * 0.7 - 8.0).alias("s0"), (F.col("n_regionkey") * 1.3 - 2.0).alias("s1"))


def t3_2d_orders(spark, sf_dir):
    return _type3(_order_points(spark, sf_dir), _nation_targets(spark, sf_dir), direct.type3)


def t3_bounds(spark, sf_dir):
    src, goals = _supplier_sources(spark, sf_dir), _customer_targets(spark, sf_dir)
    part = lambda df, c, name: df.agg(F.lit(name).alias("set"), F.min(c).alias("lower"), F.max(c).alias("upper"))
    return part(src, "x0", "sources").unionByName(part(goals, "s0", "targets"))


def uniform_dft_embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    values = vectors.select("vec_id", "i", F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    out = direct.uniform_dft(values, "vec_id", "i", 64, normalization="forward")
    return out.select("vec_id", "k", _round(F.col("re"), "re"), _round(F.col("im"), "im"))


def uniform_fft_embeddings(spark, sf_dir):
    """The fast uniform transform over rows, inverse direction, orthogonal normalisation."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    values = vectors.select("vec_id", "i", F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    out = fft.uniform_fft(values, "vec_id", "i", 64, inverse=True, normalization="orthogonal")
    return out.select("vec_id", "k", _round(F.col("re"), "re"), _round(F.col("im"), "im"))


def fft_distributed_1d(spark, sf_dir):
    """A grid's transform axis by axis, in four steps, over rows."""
    cells = spark.range(60).select(F.lit(0).alias("transform_id"), F.col("id").alias("cell"), (1.0 / (1.0 + F.col("id"))).alias("re"), (0.5 / (2.0 + F.col("id"))).alias("im"))
    out = fft.fft_distributed(cells, (60,), 1)
    return out.select(F.col("cell").cast("long").alias("cell"), _round(F.col("re"), "re"), _round(F.col("im"), "im"))


def roundtrip_adjoint(spark, sf_dir):
    """<type2(f), c> and <f, type1 with the opposite sign (c)>, both divided by the strengths' magnitude."""
    config, points = TransformConfig((12,)), event_points(spark, sf_dir)
    f = _coefficients(spark, (12,))
    left = direct.type2(points, f, config).join(points.select("point_id", F.col("re").alias("c")), "point_id").agg(F.sum(F.col("re") * F.col("c")).alias("a_re"), F.sum(F.col("im") * F.col("c")).alias("a_im"))
    g = direct.type1(points, points, config.adjoint()).select("k0", F.col("re").alias("g_re"), F.col("im").alias("g_im"))
    right = f.join(g, "k0").agg(F.sum(F.col("re") * F.col("g_re") + F.col("im") * F.col("g_im")).alias("b_re"), F.sum(F.col("im") * F.col("g_re") - F.col("re") * F.col("g_im")).alias("b_im"))
    norm = points.agg(F.sum(F.abs("re")).alias("norm"))
    both = left.crossJoin(right).crossJoin(norm)  # one row each
    return both.select(*[_round(F.col(c) / F.col("norm"), c) for c in ("a_re", "a_im", "b_re", "b_im")])


def es_kernel_table(spark, sf_dir):
    k = kern.kernel_for(1e-6, 2.0)
    d = F.col("id") / 8.0 - 4.0
    return spark.range(65).select(F.col("id").alias("i"), _round(es_kernel(d, k.width, k.beta), "phi", 9))


def _mode_table(order):
    return lambda spark, sf_dir: mode_table(spark, TransformConfig((7, 4), mode_order=order))


def _grid_config():
    return TransformConfig((32,))


def spread_grid_1d(spark, sf_dir):
    points = event_points(spark, sf_dir)
    grid = spread_relational(points, kern.layout_for(_grid_config()))
    return _normal(grid, points, ["cell"])


def interp_grid_1d(spark, sf_dir):
    layout = kern.layout_for(_grid_config())
    cells = spark.range(layout.shape[0]).select(F.lit(0).alias("transform_id"), F.col("id").alias("cell"), (1.0 / (1.0 + F.col("id"))).alias("re"), F.lit(0.0).alias("im"))
    out = gridded.interpolate_relational(event_points(spark, sf_dir).select("point_id", "x0"), cells, layout, 1, "point_id")
    return out.select("point_id", _round(F.col("re"), "re"))


def _sql_support() -> str:
    layout = kern.layout_for(_grid_config())
    n, w, beta = layout.shape[0], layout.kernel.width, layout.kernel.beta
    scale = repr(n / (2.0 * math.pi))
    return (
        f"q AS (SELECT *, p0 - {n}.0::DOUBLE * floor(p0 / {n}.0::DOUBLE) AS p FROM (SELECT *, x0 * {scale}::DOUBLE + {n / 2}::DOUBLE AS p0 FROM {SQL_EVENTS})),"
        f" s AS (SELECT *, CAST(ceil(p - {w / 2}::DOUBLE) AS BIGINT) + o AS pos FROM q, generate_series(0, {w - 1}) g(o)),"
        f" w AS (SELECT *, ((pos % {n}) + {n}) % {n} AS cell, CASE WHEN 1 - pow((pos - p) * {2.0 / w!r}::DOUBLE, 2) > 0 THEN exp({beta!r}::DOUBLE * (sqrt(1 - pow((pos - p) * {2.0 / w!r}::DOUBLE, 2)) - 1)) ELSE 0 END AS phi FROM s)"
    )


def _bins(spark, sf_dir):
    return bin_histogram(lineitem_points(spark, sf_dir, 2), kern.layout_for(TransformConfig((32, 32))), side=16)


def validate_points(spark, sf_dir):
    """Suppliers' balances in thousands taken as coordinates: most lie beyond three half-periods and are reported."""
    found = violations(_supplier_sources(spark, sf_dir), "point_id", ["x0"], [(-3.0, 3.0)])
    return found.select(F.col("id").alias("point_id"), "axis", _round(F.col("value"), "value"), "kind")


def df64_split(spark, sf_dir):
    hi, lo = split_df64(F.col("value"))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value"), hi.alias("hi"), lo.alias("lo"))
    back = join_df64(F.col("hi"), F.col("lo"))
    return rows.select("event_id", (F.abs(back - F.col("value")) <= F.abs(F.col("value")) * 2.0**-44).alias("kept"), _round(F.col("hi").cast("double"), "hi", 4))


#: Tolerance of fast transforms that are held against exact values of SQL, and the places that are compared.
FINE, PLACES = 1e-12, 5


def t1_fast(spark, sf_dir):
    points, config = event_points(spark, sf_dir), TransformConfig((64,), eps=FINE)
    return _normal(gridded.type1(points, points, config), points, ["lin", "k0"], PLACES)


def t1_ordered(spark, sf_dir):
    points, config = event_points(spark, sf_dir), TransformConfig((16,))
    return _normal(direct.type1(points, points, config, deterministic=True), points, ["lin", "k0"])


def t1_ordered_fast(spark, sf_dir):
    points, config = event_points(spark, sf_dir), TransformConfig((16,), eps=FINE)
    return _normal(gridded.type1(points, points, config, deterministic=True), points, ["lin", "k0"], PLACES)


def _values(out: DataFrame, keys: list[str]) -> DataFrame:
    return out.select(*keys, _round(F.col("re"), "re", PLACES), _round(F.col("im"), "im", PLACES))


def t2_fast(spark, sf_dir):
    points, config, f = event_points(spark, sf_dir), TransformConfig((64,), eps=FINE), _coefficients(spark, (64,))
    return _values(gridded.type2(points, f, config), ["transform_id", "point_id"])


def t2_fast_joined(spark, sf_dir):
    """The grid stays rows and points are joined to its cells."""
    config = TransformConfig((64,), eps=1e-10)
    layout = kern.layout_for(config)
    spectrum = fft.fft_distributed(gridded.coefficient_grid(_coefficients(spark, (64,)), config, 1), layout.shape, 1)
    points = event_points(spark, sf_dir).select("point_id", "x0")
    return _values(gridded.interpolate_relational(points, spectrum, layout, 1, "point_id"), ["transform_id", "point_id"])


def t3_fast(spark, sf_dir):
    src, goals = _supplier_sources(spark, sf_dir), _customer_targets(spark, sf_dir)
    config = Type3Config(type3.bounds_of(src, "x", 1), type3.bounds_of(goals, "s", 1), eps=FINE)
    return _normal(type3.type3(src, src, goals, config), src, ["target_id"], PLACES)


def t3_fast_2d(spark, sf_dir):
    src, goals = _order_points(spark, sf_dir), _nation_targets(spark, sf_dir)
    config = Type3Config(type3.bounds_of(src, "x", 2), type3.bounds_of(goals, "s", 2), eps=1e-10)
    return _normal(type3.type3(src, src, goals, config, deterministic=True), src, ["target_id"], PLACES)


def _heavy_points(spark, sf_dir):
    """All events but every thousandth within 1e-3 of a centre: a cluster in one cell of the grid."""
    near = 0.7 + F.col("x0") * 1e-4
    return event_points(spark, sf_dir).withColumn("x0", F.when(F.pmod(F.col("point_id"), F.lit(1000)) == 0, F.col("x0")).otherwise(near))


SQL_HEAVY = SQL_EVENTS.replace(" AS x0 FROM events)", " AS y FROM events)")
SQL_HEAVY = f"(SELECT point_id, re, CASE WHEN point_id % 1000 = 0 THEN y ELSE 0.7::DOUBLE + y * 0.0001::DOUBLE END AS x0 FROM {SQL_HEAVY})"


def t1_heavy_cluster(spark, sf_dir):
    points, config = _heavy_points(spark, sf_dir), TransformConfig((64,), eps=FINE)
    return _normal(gridded.type1(points, points, config), points, ["lin", "k0"], PLACES)


def _high_rank(n_modes, run=direct.type1, **options):
    """Suppliers as points of a high rank: axis d is the balance, scaled and shifted by d."""

    def query(spark, sf_dir):
        axes = [((F.col("s_acctbal") / 5000.0) * (1.0 - 0.1 * d) + 0.2 * d - 0.5).alias(f"x{d}") for d in range(len(n_modes))]
        points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), *axes, F.lit(1.0).alias("re"), F.lit(0.0).alias("im"), F.lit(0).alias("transform_id"))
        return _normal(run(points, points, TransformConfig(n_modes, **options)), points, ["lin", *axis_names("k", len(n_modes))], PLACES)

    return query


def _sql_high_rank(rank: int) -> str:
    axes = ", ".join(f"(s_acctbal / 5000.0::DOUBLE) * {1.0 - 0.1 * d!r}::DOUBLE + {0.2 * d!r}::DOUBLE - 0.5::DOUBLE AS x{d}" for d in range(rank))
    return f"(SELECT s_suppkey AS point_id, 1.0::DOUBLE AS re, {axes} FROM supplier)"


def t1_prepared(spark, sf_dir):
    """A checked, sorted and kept point set, then two executions, of which the second is returned."""
    points, plan = event_points(spark, sf_dir), Plan(1, TransformConfig((24,), eps=FINE))
    plan.set_points(points)
    plan.execute(points.withColumn("re", F.lit(1.0)), method="gridded")
    out = plan.execute(points.select("transform_id", "point_id", "re", "im"), method="gridded")
    return _normal(out, points, ["lin", "k0"], PLACES)


def t2_prepared(spark, sf_dir):
    """Points prepared for type 1 serve its adjoint, a type 2."""
    points, one = event_points(spark, sf_dir), Plan(1, TransformConfig((24,), eps=FINE, isign=-1))
    out = one.adjoint().execute(_coefficients(spark, (24,)), prepared=one.prepare_points(points), method="gridded")
    return _values(out, ["transform_id", "point_id"])


def t3_prepared(spark, sf_dir):
    src, goals = _supplier_sources(spark, sf_dir), _customer_targets(spark, sf_dir)
    plan = AutoBoundsType3(1, eps=FINE).set_points(src, goals)
    return _normal(plan.execute(src.select("transform_id", "point_id", "re", "im")), src, ["target_id"], PLACES)


def plan_dispatch(spark, sf_dir):
    """One call of a plan for each kind, on small tables; the chooser picks the way."""
    src, goals = _supplier_sources(spark, sf_dir), _nation_targets(spark, sf_dir).select("target_id", "s0")
    points = src.withColumn("x0", F.col("x0") / 5.0)
    one = Plan(1, TransformConfig((5,), eps=FINE)).transform(points, points).select(F.lit(1).alias("kind"), F.col("lin").alias("row"), "re", "im")
    two = Plan(2, TransformConfig((5,), eps=FINE)).transform(points, _coefficients(spark, (5,))).select(F.lit(2), "point_id", "re", "im")
    three = Plan(3, Type3Config(type3.bounds_of(src, "x", 1), type3.bounds_of(goals, "s", 1))).transform(src, src, goals, method="direct").select(F.lit(3), "target_id", "re", "im")
    return _values(one.union(two).union(three), ["kind", "row"])


def one_call_arrays(spark, sf_dir):
    """Numpy in and out: the helpers are for arrays on the driver, here one of 25 points."""
    x = np.arange(25) * 0.23 - 2.9
    f = arrays.nufft1d1(x, np.cos(x) + 0j, 9, eps=FINE)
    back = arrays.nufft1d2(x, f, eps=FINE)
    third = arrays.nufft1d3(x, np.cos(x) + 0j, np.arange(7) * 1.7 - 5.0, eps=FINE)
    rows = [(kind, i, float(v.real), float(v.imag)) for kind, a in ((1, f), (2, back), (3, third)) for i, v in enumerate(a)]
    return _values(spark.createDataFrame(rows, "kind int, row long, re double, im double"), ["kind", "row"])


def sql_functions(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT id, round(es_kernel(id / 8D - 4D, 7, 16.1D), 9) AS phi, mode_of_index(id, 65, true) AS fft, mode_of_index(id, 65, false) AS centered, round(grid_position(id / 7D - 4D, 50), 6) AS position, CAST(df64_hi(id / 10D) AS DOUBLE) + CAST(df64_lo(id / 10D) AS DOUBLE) - id / 10D < 1e-13 AS whole FROM range(65)")


def sql_view(spark, sf_dir):
    """Views in, a view out."""
    event_points(spark, sf_dir).createOrReplaceTempView("scatterwave_points")
    sql.nufft_view(spark, 1, "scatterwave_points", "scatterwave_points", "scatterwave_spectrum", n_modes=(6,))
    return _normal(spark.table("scatterwave_spectrum"), event_points(spark, sf_dir), ["lin", "k0"])


def t1_by_window(spark, sf_dir):
    """The streaming operator over a bounded table: a transform for each hour."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("re"), F.lit(0.0).alias("im"))
    x = event_points(spark, sf_dir).select(F.col("point_id").alias("event_id"), "x0")
    out = type1_stream(events.join(x, "event_id"), TransformConfig((4,)), ts="at", window="1 day")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "lin", "n", _round(F.col("re"), "re", 4), _round(F.col("im"), "im", 4))


def kernel_spectrum(spark, sf_dir):
    """Transform of the kernel at the modes of a fine grid, from which deconvolution factors are made."""
    layout = kern.layout_for(_grid_config())
    values = kern.centered_kernel_fourier(layout.shape[0], layout.kernel)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k long, v double").select("k", _round(F.col("v"), "phi"))


def kernel_integral(spark, sf_dir):
    """Continuous transform of the kernel, for type 3."""
    k = kern.kernel_for(1e-6, 2.0)
    at = [i / 16.0 for i in range(26)]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(kern.continuous_kernel_fourier(at, k))], "i long, v double").select("i", _round(F.col("v"), "phi"))


def _sql_integral(k, arguments: str, key: str, sign: str = "1", angle: str = "s") -> str:
    """Midpoint sums of kernel times cosine; the kernel is below 1e-7 at its ends, so 40,000 steps are plenty."""
    h = k.width / 40_000
    return (
        f"(SELECT {key}, {sign} * sum(exp({k.beta!r}::DOUBLE * (sqrt(1 - pow(2 * d / {k.width}.0::DOUBLE, 2)) - 1)) * cos({angle} * d)) * {h!r}::DOUBLE AS phi"
        f" FROM {arguments}, (SELECT (j + 0.5::DOUBLE) * {h!r}::DOUBLE - {k.width / 2!r}::DOUBLE AS d FROM generate_series(0, 39999) q(j)) GROUP BY {key})"
    )


def fine_lengths(spark, sf_dir):
    rows = [(n, kern.fine_length(n, 2.0, 7), kern.next_even_235(n)) for n in range(1, 301)]
    return spark.createDataFrame(rows, "n long, fine long, next_even long")


def kernel_parameters(spark, sf_dir):
    rows = [(e, k.width, k.beta) for e in range(1, 15) for k in [kern.kernel_for(10.0**-e, 2.0)]]
    return spark.createDataFrame(rows, "e int, width int, beta double").select("e", "width", _round(F.col("beta"), "beta"))


def deconvolved_modes(spark, sf_dir):
    """Coefficients at their cells of the fine grid, before the uniform transform of type 2."""
    return gridded.coefficient_grid(_coefficients(spark, (32,)), _grid_config(), 1).select("transform_id", "cell", _round(F.col("re"), "re"), _round(F.col("im"), "im"))


#: Bounds that hold suppliers' and customers' balances as they are scaled here.
TYPE3_BOUNDS = Type3Config([(-1.5, 10.5)], [(-2.5, 20.5)])


def t3_scaled_sources(spark, sf_dir):
    out = type3.prepare_sources(_supplier_sources(spark, sf_dir), TYPE3_BOUNDS)
    return out.select("point_id", _round(F.col("x0"), "x0"), _round(F.col("re"), "re"), _round(F.col("im"), "im"))


def t3_target_factors(spark, sf_dir):
    out = type3.prepare_targets(_customer_targets(spark, sf_dir), TYPE3_BOUNDS)
    return out.select("target_id", _round(F.col("x0"), "x0"), _round(F.col("fre"), "fre"), _round(F.col("fim"), "fim"))


def spread_grid_dense(spark, sf_dir):
    """Private grids of tasks, added up."""
    points = event_points(spark, sf_dir)
    return _normal(spread_dense(points, kern.layout_for(_grid_config())), points, ["cell"])


def bin_sorted_points(spark, sf_dir):
    """Prepared points beside their bins; the order inside a bin shows as a rank."""
    from pyspark.sql import Window

    points = _order_points(spark, sf_dir).select("point_id", "x0", "x1")
    out = bin_sorted(points, kern.layout_for(TransformConfig((32, 32))), side=16)
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("point_id"))  # a bin of this small grid
    return out.select("bin", "point_id", rank.cast("long").alias("rank"))


def t1_active_batch(spark, sf_dir):
    """Two of five planned transforms are active; strengths of the others are passed over."""
    points, kinds = _typed_events(spark, sf_dir)
    return _normal(direct.type1(points, points, TransformConfig((8,), batch=5), active=2), points, ["transform_id", "lin", "k0"])


def plan_sizes(spark, sf_dir):
    """Rows in and out that a plan foresees, for each kind."""
    one, three = TransformConfig((6, 5), batch=3), Type3Config([(-1, 1)], [(-5, 5)], batch=2)
    rows = [(k, active, *[plan.expected_rows(100, active, targets=40)[c] for c in ("points", "input", "output")]) for k, plan in ((1, Plan(1, one)), (2, Plan(2, one)), (3, Plan(3, three))) for active in (1, 2)]
    return spark.createDataFrame(rows, "kind int, active int, points long, input long, output long")


def error_codes(spark, sf_dir):
    """Codes of configurations and rows that break the contract."""
    bad = [
        ("no axes", lambda: TransformConfig(())), ("nine axes", lambda: TransformConfig((2,) * 9)), ("zero modes", lambda: TransformConfig((4, 0))),
        ("no batch", lambda: TransformConfig((4,), batch=0)), ("eps zero", lambda: TransformConfig((4,), eps=0.0)), ("sigma one", lambda: TransformConfig((4,), sigma=1.0)),
        ("eps too small", lambda: kern.kernel_for(1e-16, 2.0)), ("odd grid", lambda: kern.centered_kernel_fourier(7, kern.kernel_for(1e-3, 2.0))),
        ("float tolerance", lambda: Plan(1, TransformConfig((256, 256), sigma=1.25, precision="f32"))), ("interval", lambda: Type3Config([(1, -1)], [(0, 1)])),
        ("active batch", lambda: TransformConfig((4,), batch=2).check_active_batch(3)), ("far point", lambda: Plan(1, TransformConfig((4,))).transform(*[spark.createDataFrame([(0, 12.6, 1.0, 0.0)], "point_id long, x0 double, re double, im double")] * 2)),
    ]
    rows = []
    for case, make in bad:
        try:
            make()
        except TransformError as e:
            rows.append((case, e.code))
    return spark.createDataFrame(rows, "case string, code string")


def queries() -> dict:
    return {
        "t1_1d_events_daily": _events(64),
        "t1_1d_neg_sign": _events(32, isign=-1),
        "t1_1d_fft_order": _events(16, mode_order="fft"),
        "t1_1d_odd_modes": _events(37),
        "t1_2d_lineitem": _lines((16, 8)),
        "t1_3d_lineitem": _lines((4, 4, 3)),
        "t1_singleton_axis": _lines((1, 4, 1)),
        "t1_2d_lineitem_fast": _lines((32, 32), run=gridded.type1, eps=1e-10),
        "t1_batch_by_event_type": t1_batch_by_event_type,
        "t1_grouped_by_user": t1_grouped_by_user,
        "t1_no_points": t1_no_points,
        "t2_1d_events": _type2_events(64),
        "t2_2d_orders": t2_2d_orders,
        "t2_batch": _type2_events(12, batch=3),
        "t3_1d_supplier_customer": t3_1d_supplier_customer,
        "t3_2d_orders": t3_2d_orders,
        "t3_bounds": t3_bounds,
        "uniform_dft_embeddings": uniform_dft_embeddings,
        "es_kernel_table": es_kernel_table,
        "mode_table_centered": _mode_table("centered"),
        "mode_table_fft": _mode_table("fft"),
        "spread_grid_1d": spread_grid_1d,
        "interp_grid_1d": interp_grid_1d,
        "bin_histogram": _bins,
        "bin_offsets": lambda spark, sf_dir: bin_offsets(_bins(spark, sf_dir)),
        "validate_points": validate_points,
        "df64_split": df64_split,
        "t1_fast": t1_fast,
        "t1_ordered": t1_ordered,
        "t1_ordered_fast": t1_ordered_fast,
        "t1_heavy_cluster": t1_heavy_cluster,
        "t2_fast": t2_fast,
        "t2_fast_joined": t2_fast_joined,
        "t3_fast": t3_fast,
        "t3_fast_2d": t3_fast_2d,
        "t1_4d_fast": _high_rank((4, 3, 3, 2), run=gridded.type1, eps=1e-8),
        "t1_4d_sparse": _high_rank((3, 2, 3, 2), run=lambda p, c, config: gridded.type1(p, c, config, strategy="sparse"), eps=1e-8),
        "t1_5d": _high_rank((3, 2, 3, 2, 2)),
        "t1_6d": _high_rank((4, 3, 2, 2, 2, 2)),
        "t1_8d": _high_rank((3, 2, 2, 2, 2, 2, 2, 2)),
        "t1_prepared": t1_prepared,
        "t2_prepared": t2_prepared,
        "t3_prepared": t3_prepared,
        "plan_dispatch": plan_dispatch,
        "one_call_arrays": one_call_arrays,
        "uniform_fft_embeddings": uniform_fft_embeddings,
        "fft_distributed_1d": fft_distributed_1d,
        "roundtrip_adjoint": roundtrip_adjoint,
        "sql_functions": sql_functions,
        "sql_view": sql_view,
        "t1_by_window": t1_by_window,
        "t1_f32": _events(24, precision="f32"),
        "t1_df64": _events(24, precision="df64"),
        "t1_active_batch": t1_active_batch,
        "kernel_spectrum": kernel_spectrum,
        "kernel_integral": kernel_integral,
        "kernel_parameters": kernel_parameters,
        "fine_lengths": fine_lengths,
        "deconvolved_modes": deconvolved_modes,
        "t3_scaled_sources": t3_scaled_sources,
        "t3_target_factors": t3_target_factors,
        "spread_grid_dense": spread_grid_dense,
        "bin_sorted_points": bin_sorted_points,
        "plan_sizes": plan_sizes,
        "error_codes": error_codes,
    }


def oracle_sql() -> dict[str, str]:
    k, grid, (wide, (axis,)) = kern.kernel_for(1e-6, 2.0), kern.layout_for(_grid_config()), type3.plan_axes(TYPE3_BOUNDS)
    n2 = kern.layout_for(TransformConfig((32, 32))).shape
    sup = "(SELECT s_suppkey AS point_id, s_acctbal / 1000.0::DOUBLE AS x0 FROM supplier)"
    cust = "(SELECT c_custkey AS target_id, c_acctbal / 500.0::DOUBLE AS s0 FROM customer)"
    nation = "(SELECT CAST(n_nationkey AS BIGINT) AS target_id, n_nationkey * 0.7::DOUBLE - 8.0::DOUBLE AS s0, n_regionkey * 1.3::DOUBLE - 2.0::DOUBLE AS s1 FROM nation)"
    position = lambda x, n: f"(({x} * {n / (2.0 * math.pi)!r}::DOUBLE + {n / 2}::DOUBLE) - {n}.0::DOUBLE * floor(({x} * {n / (2.0 * math.pi)!r}::DOUBLE + {n / 2}::DOUBLE) / {n}.0::DOUBLE))"
    bins = f"SELECT CAST(floor({position('x0', n2[0])} / 16) AS BIGINT) + CAST(floor({position('x1', n2[1])} / 16) AS BIGINT) * {-(-n2[0] // 16)} AS bin, count(*) AS n FROM {SQL_LINES} GROUP BY 1"
    return {
        "t1_1d_events_daily": _sql_type1(SQL_EVENTS, (64,)),
        "t1_1d_neg_sign": _sql_type1(SQL_EVENTS, (32,), sign=-1),
        "t1_1d_fft_order": _sql_type1(SQL_EVENTS, (16,), order="fft"),
        "t1_1d_odd_modes": _sql_type1(SQL_EVENTS, (37,)),
        "t1_2d_lineitem": _sql_type1(SQL_LINES, (16, 8)),
        "t1_3d_lineitem": _sql_type1(SQL_LINES, (4, 4, 3)),
        "t1_singleton_axis": _sql_type1(SQL_LINES, (1, 4, 1)),
        "t1_2d_lineitem_fast": _sql_type1(SQL_LINES, (32, 32)),
        "t1_batch_by_event_type": (
            f"WITH p AS (SELECT *, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS transform_id FROM {SQL_EVENTS}), n AS (SELECT sum(abs(re)) AS norm FROM p)"
            f" SELECT transform_id, lin, k0, round(sum(re * cos(x0 * k0)) / any_value(norm), 6) + 0.0 AS re, round(sum(re * sin(x0 * k0)) / any_value(norm), 6) + 0.0 AS im FROM p, n, {_sql_modes((16,))} GROUP BY ALL"
        ),
        "t1_grouped_by_user": f"SELECT user_id, k0, round(sum(re * cos(x0 * k0)) / sum(abs(re)), 6) + 0.0 AS re, round(sum(re * sin(x0 * k0)) / sum(abs(re)), 6) + 0.0 AS im FROM {SQL_EVENTS}, {_sql_modes((8,))} GROUP BY ALL",
        "t1_no_points": _sql_type1(SQL_EVENTS, (6,), extra="AND point_id < 0"),
        "t2_1d_events": _sql_type2(SQL_EVENTS, (64,)),
        "t2_2d_orders": _sql_type2(SQL_ORDERS, (6, 5)),
        "t2_batch": _sql_type2(SQL_EVENTS, (12,), batch=3),
        "t3_1d_supplier_customer": f"SELECT target_id, round(sum(cos(x0 * s0)) / count(*), 6) + 0.0 AS re, round(sum(sin(x0 * s0)) / count(*), 6) + 0.0 AS im FROM {sup}, {cust} GROUP BY target_id",
        "t3_2d_orders": f"SELECT target_id, round(sum(cos(x0 * s0 + x1 * s1)) / count(*), 6) + 0.0 AS re, round(sum(sin(x0 * s0 + x1 * s1)) / count(*), 6) + 0.0 AS im FROM {SQL_ORDERS}, {nation} GROUP BY target_id",
        "t3_bounds": f"SELECT 'sources' AS set, min(x0) AS lower, max(x0) AS upper FROM {sup} UNION ALL SELECT 'targets', min(s0), max(s0) FROM {cust}",
        "uniform_dft_embeddings": "WITH v AS (SELECT vec_id, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS re FROM embeddings, generate_series(1, 64) g(i)) SELECT vec_id, CAST(k AS INTEGER) AS k, round(sum(re * cos((i * k % 64) * (-2.0::DOUBLE * 3.141592653589793::DOUBLE / 64))) / 64, 6) + 0.0 AS re, round(sum(re * sin((i * k % 64) * (-2.0::DOUBLE * 3.141592653589793::DOUBLE / 64))) / 64, 6) + 0.0 AS im FROM v, generate_series(0, 63) h(k) GROUP BY vec_id, k",
        "es_kernel_table": f"SELECT CAST(i AS BIGINT) AS i, round(CASE WHEN 1 - pow((i / 8.0::DOUBLE - 4) * 2 / {k.width}, 2) > 0 THEN exp({k.beta!r}::DOUBLE * (sqrt(1 - pow((i / 8.0::DOUBLE - 4) * 2 / {k.width}, 2)) - 1)) ELSE 0 END, 9) + 0.0 AS phi FROM generate_series(0, 64) g(i)",
        "mode_table_centered": f"SELECT * FROM {_sql_modes((7, 4))}",
        "mode_table_fft": f"SELECT * FROM {_sql_modes((7, 4), 'fft')}",
        "spread_grid_1d": f"WITH {_sql_support()}, n AS (SELECT sum(abs(re)) AS norm FROM {SQL_EVENTS}) SELECT cell, round(sum(re * phi) / any_value(norm), 6) + 0.0 AS re, 0.0::DOUBLE AS im FROM w, n GROUP BY cell",
        "interp_grid_1d": f"WITH {_sql_support()} SELECT point_id, round(sum(phi / (1.0::DOUBLE + cell)), 6) + 0.0 AS re FROM w GROUP BY point_id",
        "bin_histogram": bins,
        "bin_offsets": f"SELECT bin, n, CAST(coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ({bins})",
        "validate_points": f"SELECT point_id, CAST(0 AS INTEGER) AS axis, round(x0, 6) + 0.0 AS value, 'out_of_range' AS kind FROM {sup} WHERE abs(x0) > 3.0::DOUBLE",
        "df64_split": "SELECT event_id, abs(CAST(CAST(value AS FLOAT) AS DOUBLE) + CAST(CAST(value - CAST(CAST(value AS FLOAT) AS DOUBLE) AS FLOAT) AS DOUBLE) - value) <= abs(value) * pow(2.0::DOUBLE, -44) AS kept, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) + 0.0 AS hi FROM events",
        "t1_fast": _sql_type1(SQL_EVENTS, (64,), digits=PLACES),
        "t1_ordered": _sql_type1(SQL_EVENTS, (16,)),
        "t1_ordered_fast": _sql_type1(SQL_EVENTS, (16,), digits=PLACES),
        "t1_heavy_cluster": _sql_type1(SQL_HEAVY, (64,), digits=PLACES),
        "t2_fast": _sql_type2(SQL_EVENTS, (64,), digits=PLACES),
        "t2_fast_joined": _sql_type2(SQL_EVENTS, (64,), digits=PLACES),
        "t3_fast": f"SELECT target_id, round(sum(cos(x0 * s0)) / count(*), {PLACES}) + 0.0 AS re, round(sum(sin(x0 * s0)) / count(*), {PLACES}) + 0.0 AS im FROM {sup}, {cust} GROUP BY target_id",
        "t3_fast_2d": f"SELECT target_id, round(sum(cos(x0 * s0 + x1 * s1)) / count(*), {PLACES}) + 0.0 AS re, round(sum(sin(x0 * s0 + x1 * s1)) / count(*), {PLACES}) + 0.0 AS im FROM {SQL_ORDERS}, {nation} GROUP BY target_id",
        "t1_4d_fast": _sql_type1(_sql_high_rank(4), (4, 3, 3, 2), digits=PLACES),
        "t1_4d_sparse": _sql_type1(_sql_high_rank(4), (3, 2, 3, 2), digits=PLACES),
        "t1_5d": _sql_type1(_sql_high_rank(5), (3, 2, 3, 2, 2), digits=PLACES),
        "t1_6d": _sql_type1(_sql_high_rank(6), (4, 3, 2, 2, 2, 2), digits=PLACES),
        "t1_8d": _sql_type1(_sql_high_rank(8), (3, 2, 2, 2, 2, 2, 2, 2), digits=PLACES),
        "t1_prepared": _sql_type1(SQL_EVENTS, (24,), digits=PLACES),
        "t2_prepared": _sql_type2(SQL_EVENTS, (24,), digits=PLACES),
        "t3_prepared": f"SELECT target_id, round(sum(cos(x0 * s0)) / count(*), {PLACES}) + 0.0 AS re, round(sum(sin(x0 * s0)) / count(*), {PLACES}) + 0.0 AS im FROM {sup}, {cust} GROUP BY target_id",
        "plan_dispatch": (
            f"WITH p AS (SELECT point_id, x0 / 5.0::DOUBLE AS x FROM {sup}), f AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + lin) AS fre, 0.5::DOUBLE / (2.0::DOUBLE + lin) AS fim FROM {_sql_modes((5,))}),"
            " a AS (SELECT 1 AS kind, lin AS row, sum(cos(x * k0)) AS re, sum(sin(x * k0)) AS im FROM p, f GROUP BY lin"
            " UNION ALL SELECT 2, point_id, sum(fre * cos(x * k0) - fim * sin(x * k0)), sum(fre * sin(x * k0) + fim * cos(x * k0)) FROM p, f GROUP BY point_id"
            f" UNION ALL SELECT 3, target_id, sum(cos(x0 * s0)), sum(sin(x0 * s0)) FROM {sup}, {nation} GROUP BY target_id)"
            f" SELECT CAST(kind AS INTEGER) AS kind, row, round(re, {PLACES}) + 0.0 AS re, round(im, {PLACES}) + 0.0 AS im FROM a"
        ),
        "one_call_arrays": (
            "WITH p AS (SELECT CAST(i AS BIGINT) AS i, i * 0.23::DOUBLE - 2.9::DOUBLE AS x FROM generate_series(0, 24) g(i)), f AS (SELECT CAST(k AS BIGINT) + 4 AS lin, k, sum(cos(x) * cos(x * k)) AS fre, sum(cos(x) * sin(x * k)) AS fim FROM p, generate_series(-4, 4) h(k) GROUP BY k),"
            " a AS (SELECT 1 AS kind, lin AS row, fre AS re, fim AS im FROM f UNION ALL SELECT 2, i, sum(fre * cos(x * k) - fim * sin(x * k)), sum(fre * sin(x * k) + fim * cos(x * k)) FROM p, f GROUP BY i"
            " UNION ALL SELECT 3, CAST(j AS BIGINT), sum(cos(x) * cos(x * (j * 1.7::DOUBLE - 5.0::DOUBLE))), sum(cos(x) * sin(x * (j * 1.7::DOUBLE - 5.0::DOUBLE))) FROM p, generate_series(0, 6) h(j) GROUP BY j)"
            f" SELECT CAST(kind AS INTEGER) AS kind, row, round(re, {PLACES}) + 0.0 AS re, round(im, {PLACES}) + 0.0 AS im FROM a"
        ),
        "uniform_fft_embeddings": "WITH v AS (SELECT vec_id, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS re FROM embeddings, generate_series(1, 64) g(i)) SELECT vec_id, CAST(k AS INTEGER) AS k, round(sum(re * cos((i * k % 64) * (2.0::DOUBLE * 3.141592653589793::DOUBLE / 64))) / 8, 6) + 0.0 AS re, round(sum(re * sin((i * k % 64) * (2.0::DOUBLE * 3.141592653589793::DOUBLE / 64))) / 8, 6) + 0.0 AS im FROM v, generate_series(0, 63) h(k) GROUP BY vec_id, k",
        "fft_distributed_1d": (
            "WITH c AS (SELECT i, 1.0::DOUBLE / (1.0::DOUBLE + i) AS re, 0.5::DOUBLE / (2.0::DOUBLE + i) AS im FROM generate_series(0, 59) g(i)), t AS (SELECT *, (i * k % 60) * (2.0::DOUBLE * 3.141592653589793::DOUBLE / 60) AS a FROM c, generate_series(0, 59) h(k))"
            " SELECT CAST(k AS BIGINT) AS cell, round(sum(re * cos(a) - im * sin(a)), 6) + 0.0 AS re, round(sum(re * sin(a) + im * cos(a)), 6) + 0.0 AS im FROM t GROUP BY k"
        ),
        "roundtrip_adjoint": (
            f"WITH p AS (SELECT * FROM {SQL_EVENTS}), f AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + lin) AS fre, 0.5::DOUBLE / (2.0::DOUBLE + lin) AS fim FROM {_sql_modes((12,))}),"
            " s AS (SELECT sum(re * (fre * cos(x0 * k0) - fim * sin(x0 * k0))) AS a, sum(re * (fre * sin(x0 * k0) + fim * cos(x0 * k0))) AS b FROM p, f), n AS (SELECT sum(abs(re)) AS norm FROM p)"
            " SELECT round(a / norm, 6) + 0.0 AS a_re, round(b / norm, 6) + 0.0 AS a_im, round(a / norm, 6) + 0.0 AS b_re, round(b / norm, 6) + 0.0 AS b_im FROM s, n"
        ),
        "sql_functions": (
            "SELECT CAST(i AS BIGINT) AS id, round(CASE WHEN 1 - pow((i / 8.0::DOUBLE - 4) * 2 / 7, 2) > 0 THEN exp(16.1::DOUBLE * (sqrt(1 - pow((i / 8.0::DOUBLE - 4) * 2 / 7, 2)) - 1)) ELSE 0 END, 9) AS phi,"
            " CAST(CASE WHEN i < 33 THEN i ELSE i - 65 END AS BIGINT) AS fft, CAST(i - 32 AS BIGINT) AS centered,"
            " round((((i / 7.0::DOUBLE - 4) * 50 / (2 * pi()) + 25) - 50 * floor(((i / 7.0::DOUBLE - 4) * 50 / (2 * pi()) + 25) / 50)), 6) AS position, TRUE AS whole FROM generate_series(0, 64) g(i)"
        ),
        "sql_view": _sql_type1(SQL_EVENTS, (6,)),
        "t1_f32": _sql_type1(f"(SELECT point_id, CAST(CAST(re AS FLOAT) AS DOUBLE) AS re, CAST(CAST(x0 AS FLOAT) AS DOUBLE) AS x0 FROM {SQL_EVENTS})", (24,)),
        "t1_df64": _sql_type1(SQL_EVENTS, (24,)),
        "t1_active_batch": (
            f"WITH p AS (SELECT *, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS transform_id FROM {SQL_EVENTS}), n AS (SELECT sum(abs(re)) AS norm FROM p)"
            f" SELECT transform_id, lin, k0, round(sum(re * cos(x0 * k0)) / any_value(norm), 6) + 0.0 AS re, round(sum(re * sin(x0 * k0)) / any_value(norm), 6) + 0.0 AS im FROM p, n, {_sql_modes((8,))} WHERE transform_id < 2 GROUP BY transform_id, lin, k0"
        ),
        "kernel_spectrum": f"SELECT CAST(k AS BIGINT) AS k, round(phi, 6) + 0.0 AS phi FROM {_sql_integral(grid.kernel, f'generate_series(0, {grid.shape[0] // 2}) g(k)', 'k', '(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END)', f'(k * {2 * math.pi / grid.shape[0]!r}::DOUBLE)')}",
        "kernel_integral": f"SELECT CAST(i AS BIGINT) AS i, round(phi, 6) + 0.0 AS phi FROM {_sql_integral(k, 'generate_series(0, 25) g(i)', 'i', angle='(i / 16.0::DOUBLE)')}",
        "kernel_parameters": "SELECT CAST(e AS INTEGER) AS e, CAST(greatest(2, e + 1) AS INTEGER) AS width, round(greatest(2, e + 1) * CASE e WHEN 1 THEN 2.20 WHEN 2 THEN 2.26 WHEN 3 THEN 2.38 ELSE 2.30 END, 6) + 0.0::DOUBLE AS beta FROM generate_series(1, 14) g(e)",
        "fine_lengths": (
            "WITH c AS (SELECT 2 * CAST(i AS BIGINT) AS m FROM generate_series(1, 400) g(i)), t AS (SELECT m, (CAST(1073741824 AS HUGEINT) * 94143178827 * 30517578125) % m = 0 AS smooth5,"
            " (CAST(1024 AS HUGEINT) * 729 * 625 * 343 * 121) AS x, (CAST(1024 AS HUGEINT) * 729 * 625 * 343 * 121) % m = 0 AS smooth11 FROM c)"
            " SELECT CAST(n AS BIGINT) AS n, (SELECT min(m) FROM t WHERE smooth11 AND m >= greatest(2 * n, 14)) AS fine, (SELECT min(m) FROM t WHERE smooth5 AND m >= n) AS next_even FROM generate_series(1, 300) h(n)"
        ),
        "deconvolved_modes": (
            f"WITH a AS {_sql_integral(grid.kernel, 'generate_series(0, 16) g(k)', 'k', '(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END)', f'(k * {2 * math.pi / grid.shape[0]!r}::DOUBLE)')}"
            f" SELECT CAST(0 AS INTEGER) AS transform_id, CAST(((k0 % {grid.shape[0]}) + {grid.shape[0]}) % {grid.shape[0]} AS BIGINT) AS cell, round(1.0::DOUBLE / (1.0::DOUBLE + lin) / phi, 6) + 0.0 AS re, round(0.5::DOUBLE / (2.0::DOUBLE + lin) / phi, 6) + 0.0 AS im FROM {_sql_modes((32,))} JOIN a ON a.k = abs(k0)"
        ),
        "t3_scaled_sources": f"SELECT point_id, round((x0 - {axis.source_center!r}::DOUBLE) / {axis.scale!r}::DOUBLE, 6) + 0.0 AS x0, round(cos(x0 * {axis.target_center!r}::DOUBLE), 6) + 0.0 AS re, round(sin(x0 * {axis.target_center!r}::DOUBLE), 6) + 0.0 AS im FROM {sup}",
        "t3_target_factors": (
            f"WITH t AS (SELECT target_id, s0 - {axis.target_center!r}::DOUBLE AS s FROM {cust}), u AS (SELECT DISTINCT s FROM t), a AS {_sql_integral(wide, 'u', 's', angle=f'(s * {axis.spacing * axis.scale!r}::DOUBLE)').replace('39999', '3999').replace(repr(wide.width / 40_000), repr(wide.width / 4_000))}"
            f" SELECT target_id, round(t.s * {axis.spacing * axis.scale!r}::DOUBLE, 6) + 0.0 AS x0, round(cos(t.s * {axis.source_center!r}::DOUBLE) / phi, 6) + 0.0 AS fre, round(sin(t.s * {axis.source_center!r}::DOUBLE) / phi, 6) + 0.0 AS fim FROM t JOIN a USING (s)"
        ),
        "spread_grid_dense": f"WITH {_sql_support()}, n AS (SELECT sum(abs(re)) AS norm FROM {SQL_EVENTS}) SELECT cell, round(sum(re * phi) / any_value(norm), 6) + 0.0 AS re, 0.0::DOUBLE AS im FROM w, n GROUP BY cell",
        "bin_sorted_points": f"SELECT bin, point_id, row_number() OVER (PARTITION BY bin ORDER BY point_id) AS rank FROM (SELECT point_id, CAST(floor({position('x0', n2[0])} / 16) AS BIGINT) + CAST(floor({position('x1', n2[1])} / 16) AS BIGINT) * {-(-n2[0] // 16)} AS bin FROM {SQL_ORDERS})",
        "plan_sizes": (
            "SELECT CAST(kind AS INTEGER) AS kind, CAST(active AS INTEGER) AS active, CAST(100 AS BIGINT) AS points, CAST(active * CASE kind WHEN 2 THEN 6 * 5 ELSE 100 END AS BIGINT) AS input,"
            " CAST(active * CASE kind WHEN 1 THEN 6 * 5 WHEN 2 THEN 100 ELSE 40 END AS BIGINT) AS output FROM generate_series(1, 3) g(kind), generate_series(1, 2) h(active)"
        ),
        "error_codes": (
            'SELECT * FROM (VALUES (\'no axes\', \'InvalidDimensions\'), (\'nine axes\', \'InvalidDimensions\'), (\'zero modes\', \'ZeroMode\'), (\'no batch\', \'InvalidBatch\'), (\'eps zero\', \'InvalidTolerance\'), (\'sigma one\', \'InvalidSigma\'),'
            ' (\'eps too small\', \'KernelWidthUnsupported\'), (\'odd grid\', \'FineGridMustBeEven\'), (\'float tolerance\', \'F32ToleranceUnreachable\'), (\'interval\', \'InvalidType3Interval\'), (\'active batch\', \'InvalidBatch\'), (\'far point\', \'PointOutOfRange\')) v("case", code)'
        ),
        "t1_by_window": (
            f"WITH p AS (SELECT point_id, x0, re, strftime(e.ts, '%Y-%m-%d') AS day FROM {SQL_EVENTS} JOIN events e ON e.event_id = point_id)"
            f" SELECT day, lin, count(*) AS n, round(sum(re * cos(x0 * k0)), 4) + 0.0 AS re, round(sum(re * sin(x0 * k0)), 4) + 0.0 AS im FROM p, {_sql_modes((4,))} GROUP BY day, lin"
        ),
    }
