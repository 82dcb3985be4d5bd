"""What must not depend on sizes, layouts or the way of calling: rows for repeated ids, checks, and bits."""

import numpy as np
import pandas as pd
import pytest

from scatterwave import TransformConfig, TransformError, Type3Config
from scatterwave.operators import direct, fft, gridded, spread, type3
from scatterwave.operators.modes import mode_table
from scatterwave.plans.plan import Plan

RNG = np.random.default_rng(12)


def bits(df, keys):
    return df.toPandas().sort_values(keys, ignore_index=True)[[*keys, "re", "im"]]


def points_with_repeats(spark):
    ids, x = [1, 1, 2, 7, 7, 7], [0.3, -1.2, 2.0, 0.0, 0.5, 0.5]
    return spark.createDataFrame(pd.DataFrame({"point_id": ids, "x0": x, "re": 1.0, "im": 0.5})), np.array(x)


@pytest.mark.parametrize("limit", [2**22, 0])
def test_repeated_ids_keep_their_rows(spark, limit, monkeypatch):
    monkeypatch.setattr(gridded, "BROADCAST_CELLS", limit)
    points, x = points_with_repeats(spark)
    config = TransformConfig((8,), batch=2, eps=1e-9)
    modes = mode_table(spark, config).crossJoin(spark.range(2).selectExpr("CAST(id AS INT) AS transform_id")).selectExpr("*", "1D / (1 + lin) AS re", "CAST(transform_id AS DOUBLE) AS im")
    got = gridded.type2(points, modes, config).toPandas()
    want = direct.type2(points, modes, config).toPandas()
    assert len(got) == len(want) == 12
    for a, b in zip(*(d.sort_values(["transform_id", "point_id", "re"]).to_numpy(float) for d in (got, want))):
        assert np.allclose(a, b, atol=1e-7)
    goals = points.selectExpr("point_id AS target_id", "x0 AS s0")
    plan = Type3Config([(-1.5, 2.5)], [(-1.5, 2.5)], eps=1e-9)
    got, want = (f(points, points, goals, plan).toPandas() for f in (type3.type3, direct.type3))
    assert len(got) == 6 and sorted(got["target_id"]) == [1, 1, 2, 7, 7, 7]
    first = want[want["target_id"] == 2]["re"].iloc[0]
    assert got[got["target_id"] == 2]["re"].iloc[0] == pytest.approx(first, abs=1e-6)


@pytest.mark.parametrize("most", [65_536, 5])
def test_modes_in_blocks(spark, most, monkeypatch):
    monkeypatch.setattr(direct, "BLOCK_MODES", most)
    points, x = points_with_repeats(spark)
    config = TransformConfig((16,))
    modes = mode_table(spark, config).selectExpr("*", "0 AS transform_id", "1D / (1 + lin) AS re", "0.25D AS im")
    f = 1 / (1 + np.arange(16)) + 0.25j
    want = np.sort((np.exp(1j * np.outer(x, np.arange(-8, 8))) @ f).real)
    out = direct.type2(points, modes, config).toPandas()
    assert len(out) == 6 and np.allclose(np.sort(out["re"]), want)


@pytest.mark.parametrize("strategy", ["sparse", "dense", "relational"])
def test_spreading_above_rank_three(spark, strategy):
    config = TransformConfig((3, 2, 3, 2), eps=1e-4)
    x = RNG.uniform(-3, 3, (20, 4))
    p = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(20), "re": 1.0, "im": -0.5} | {f"x{d}": x[:, d] for d in range(4)}))
    a, b = (bits(f, ["lin"]) for f in (gridded.type1(p, p, config, strategy=strategy), direct.type1(p, p, config)))
    assert np.abs(a[["re", "im"]].to_numpy() - b[["re", "im"]].to_numpy()).max() < 2e-2


def test_large_grids_of_high_rank_are_spread_sparsely(spark, monkeypatch):
    monkeypatch.setattr(spread, "DENSE_CELLS", 10)
    monkeypatch.setattr(spread, "spread_dense", None)
    test_spreading_above_rank_three(spark, "auto")


@pytest.mark.parametrize("kind,method", [(1, "gridded"), (1, "direct"), (2, "gridded"), (3, "gridded")])
def test_prepared_equals_one_call_bit_for_bit(spark, kind, method):
    n = 3_000
    pdf = pd.DataFrame({"transform_id": 0, "point_id": np.arange(n), "x0": np.where(np.arange(n) % 2, RNG.uniform(-3, 3, n), -0.7 + 0.01 * RNG.uniform(size=n)), "re": RNG.normal(size=n), "im": RNG.normal(size=n)})
    p = spark.createDataFrame(pdf)
    config = Type3Config([(-3, 3)], [(-9, 9)], eps=1e-7) if kind == 3 else TransformConfig((64,), eps=1e-7)
    goals = spark.createDataFrame(pd.DataFrame({"target_id": np.arange(50), "s0": RNG.uniform(-9, 9, 50)})) if kind == 3 else None
    values = mode_table(spark, config).selectExpr("*", "0 AS transform_id", "1D / (1 + lin) AS re", "0.25D AS im") if kind == 2 else p.select("transform_id", "point_id", "re", "im")
    key = {1: "lin", 2: "point_id", 3: "target_id"}[kind]
    plan = Plan(kind, config)
    one = [bits(plan.transform(p.repartition(k, "x0"), values, goals, method=method, deterministic=True), [key]) for k in (1, 6)]
    plan.set_points(p, goals)
    two = [bits(plan.execute(v, method=method, deterministic=True), [key]) for v in (values, values.repartition(5))]
    for other in (one[1], *two):
        assert (one[0].to_numpy() == other.to_numpy()).all()
    out = plan.run(plan.execute(values, method=method))
    assert plan.timings()["execute"] > 0 and out.count() == len(two[0])
    plan.unpersist()


def test_one_call_checks_its_values(spark):
    p = spark.createDataFrame([(0, 0.5), (1, 1.5)], "point_id long, x0 double")
    plan = Plan(1, TransformConfig((4,)))
    for rows, code in (([(0, 1.0, 0.0)], "InputLength"), ([(0, 1.0, 0.0), (0, 1.0, 0.0)], "InputLength"), ([(0, 1.0, 0.0), (1, float("nan"), 0.0)], "NonFiniteComplex"), ([(0, 1.0, 0.0), (5, 1.0, 0.0)], "InputLength")):
        with pytest.raises(TransformError) as e:
            plan.transform(p, spark.createDataFrame(rows, "point_id long, re double, im double"))
        assert e.value.code == code
    two = Plan(2, TransformConfig((3,)))
    good = [(-1, 1.0, 0.0), (0, 1.0, 0.0), (1, 1.0, 0.0)]
    assert two.transform(p, spark.createDataFrame(good, "k0 int, re double, im double")).count() == 2
    for rows, code in ((good[:2], "InputLength"), ([*good, good[0]], "InputLength"), ([*good[:2], (2, 1.0, 0.0)], "InputLength"), ([*good[:2], (1, float("inf"), 0.0)], "NonFiniteComplex")):
        with pytest.raises(TransformError) as e:
            two.transform(p, spark.createDataFrame(rows, "k0 int, re double, im double"))
        assert e.value.code == code


def test_type_3_honours_the_method(spark):
    config = Type3Config([(-1, 1)], [(-5, 5)], eps=1e-3)
    src = spark.createDataFrame([(0, 0.5, 1.0, 0.0), (1, -0.25, 2.0, 1.0)], "point_id long, x0 double, re double, im double")
    goals = spark.createDataFrame([(0, 1.5), (1, -4.5)], "target_id long, s0 double")
    plan = Plan(3, config).set_points(src, goals)
    truth = np.exp(1j * np.outer([1.5, -4.5], [0.5, -0.25])) @ np.array([1, 2 + 1j])
    got = bits(plan.execute(src.selectExpr("0 AS transform_id", "point_id", "re", "im"), method="direct"), ["target_id"])
    assert np.allclose(got["re"], truth.real, atol=1e-13)
    assert plan.expected_rows(2, targets=7)["output"] == 7
    (axis,) = type3.axes_of(config)
    assert axis["length"] % 2 == 0 and np.allclose(type3.rescale_target(type3.plan_axes(config)[1][0].target_center, type3.plan_axes(config)[1][0]), 0)
    plan.unpersist()


@pytest.mark.parametrize("inverse,normalization", [(False, "none"), (True, "inverse"), (False, "forward"), (True, "orthogonal")])
def test_fast_uniform_transform(spark, inverse, normalization):
    rows = [(v, i, float(np.sin(v + i)), float(i % 3)) for v in range(7) for i in range(12) if (v, i) != (3, 5)]
    df = spark.createDataFrame(rows, "id long, i int, re double, im double")
    a, b = (bits(f(df, "id", "i", 12, inverse, normalization), ["id", "k"]) for f in (fft.uniform_fft, direct.uniform_dft))
    assert np.allclose(a.to_numpy(float), b.to_numpy(float))
    assert fft.uniform_fft(df.limit(0), "id", "i", 12).count() == 0
