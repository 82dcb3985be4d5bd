"""Fast and direct transforms against numpy sums over the definition."""

import threading

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from scatterwave import TransformConfig, Type3Config
from scatterwave.operators import direct, fft, gridded, type3
from scatterwave.operators.spread import bin_offsets, bin_histogram
from scatterwave.functions.kernel import layout_for

RNG = np.random.default_rng(7)


def frame(rank, m, batch=1, lo=-9.4, hi=9.4, prefix="x"):
    x = RNG.uniform(lo, hi, (m, rank))
    c = RNG.normal(size=(batch, m)) + 1j * RNG.normal(size=(batch, m))
    points = pd.DataFrame({"point_id": np.arange(m)} | {f"{prefix}{d}": x[:, d] for d in range(rank)})
    values = pd.concat([pd.DataFrame({"transform_id": t, "point_id": np.arange(m), "re": c[t].real, "im": c[t].imag}) for t in range(batch)])
    return x, c, points, values


def cube(df, ids, batch, n):
    pdf = df.toPandas()
    assert len(pdf) == batch * n
    out = np.zeros((batch, n), complex)
    out[pdf["transform_id"], pdf[ids]] = pdf["re"] + 1j * pdf["im"]
    return out


def error(a, b):
    return np.linalg.norm(a - b) / np.linalg.norm(b)


def mode_list(config):
    axes = []
    for n in config.n_modes:
        k = np.arange(-(n // 2), (n + 1) // 2)
        axes.append(k if config.mode_order.value == "centered" else np.concatenate([k[k >= 0], k[k < 0]]))
    grids = np.meshgrid(*axes[::-1], indexing="ij")  # the last axis of the array is dimension zero
    return np.stack([g.ravel() for g in grids[::-1]], axis=1)


CASES = [((37,), 1, "centered"), ((64,), -1, "fft"), ((12, 9), 1, "fft"), ((8, 6, 5), -1, "centered"), ((4, 5, 3, 4), 1, "centered"), ((1, 4, 1), 1, "fft")]


@pytest.mark.parametrize("shape,sign,order", CASES)
def test_types_1_and_2(spark, shape, sign, order):
    config = TransformConfig(shape, batch=2, eps=1e-10, isign=sign, mode_order=order)
    x, c, points, values = frame(len(shape), 60, 2)
    p, s, ks = spark.createDataFrame(points), spark.createDataFrame(values), mode_list(config)
    wave = np.exp(1j * sign * ks @ x.T)
    truth = c @ wave.T
    exact = direct.type1(p, s, config).cache()
    assert error(cube(exact, "lin", 2, len(ks)), truth) < 1e-12
    assert error(cube(gridded.type1(p, s, config), "lin", 2, len(ks)), truth) < 1e-9
    back = truth @ wave
    assert error(cube(direct.type2(p, exact, config), "point_id", 2, 60), back) < 1e-12
    assert error(cube(gridded.type2(p, exact, config), "point_id", 2, 60), back) < 1e-9


@pytest.mark.parametrize("eps", [1e-2, 1e-4, 1e-7, 1e-12])
def test_tolerances(spark, eps):
    config = TransformConfig((10, 14), eps=eps)
    x, c, points, values = frame(2, 100)
    p, s = spark.createDataFrame(points), spark.createDataFrame(values)
    truth = c @ np.exp(1j * mode_list(config) @ x.T).T
    assert error(cube(gridded.type1(p, s, config), "lin", 1, 140), truth) < 10 * eps


def test_other_ways_agree(spark, monkeypatch):
    config = TransformConfig((24,), eps=1e-9)
    x, c, points, values = frame(1, 80)
    p, s = spark.createDataFrame(points), spark.createDataFrame(values)
    truth = cube(direct.type1(p, s, config), "lin", 1, 24)
    modes = direct.type1(p, s, config).cache()
    back = cube(direct.type2(p, modes, config), "point_id", 1, 80)
    assert error(cube(gridded.type1(p, s, config, strategy="relational"), "lin", 1, 24), truth) < 1e-8
    monkeypatch.setattr(fft, "TASK_CELLS", 16)
    monkeypatch.setattr(gridded, "BROADCAST_CELLS", 0)
    assert error(cube(gridded.type1(p, s, config), "lin", 1, 24), truth) < 1e-8
    assert error(cube(gridded.type2(p, modes, config), "point_id", 1, 80), back) < 1e-8


@pytest.mark.parametrize("run", [direct.type1, gridded.type1])
def test_ordered_sums_do_not_depend_on_the_layout(spark, run):
    config = TransformConfig((20,), eps=1e-7)
    _, _, points, values = frame(1, 3000)
    rows = spark.createDataFrame(points.merge(values, on="point_id"))
    bits = []
    for n in (1, 5):
        own = rows.repartition(n, "x0")
        bits.append(cube(run(own, own, config, deterministic=True), "lin", 1, 20))
    assert (bits[0] == bits[1]).all()


def test_clustered_and_boundary_points(spark):
    config = TransformConfig((16, 20), eps=1e-9)
    edge = [3 * np.pi, -3 * np.pi, np.pi, -np.pi, 0.0, -1e-300, 2 * np.pi]
    x = np.concatenate([1.234 + 1e-4 * RNG.uniform(size=(100, 2)), np.stack([edge, edge[::-1]], axis=1)])
    c = RNG.normal(size=len(x)) + 0j
    p = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(x)), "x0": x[:, 0], "x1": x[:, 1], "re": c.real, "im": c.imag}))
    truth = c @ np.exp(1j * mode_list(config) @ x.T).T
    assert error(cube(gridded.type1(p, p, config), "lin", 1, 320)[0], truth) < 1e-8


BOUNDS = [((-1.5, 2.5), (-30, 50)), ((0.5, 3), (-10, 25)), ((-4, -1), (5, 45))]


@pytest.mark.parametrize("rank", [1, 2, 3])
def test_type_3(spark, rank):
    eps = 1e-8 if rank < 3 else 1e-5
    config = Type3Config([b[0] for b in BOUNDS[:rank]], [b[1] for b in BOUNDS[:rank]], eps=eps, isign=-1)
    x = np.stack([RNG.uniform(*b[0], 80) for b in BOUNDS[:rank]], axis=1)
    t = np.stack([RNG.uniform(*b[1], 50) for b in BOUNDS[:rank]], axis=1)
    c = RNG.normal(size=80) + 1j * RNG.normal(size=80)
    src = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(80), "re": c.real, "im": c.imag} | {f"x{d}": x[:, d] for d in range(rank)}))
    goals = spark.createDataFrame(pd.DataFrame({"target_id": np.arange(50)} | {f"s{d}": t[:, d] for d in range(rank)}))
    truth = np.exp(-1j * t @ x.T) @ c
    assert error(cube(direct.type3(src, src, goals, config), "target_id", 1, 50)[0], truth) < 1e-12
    assert error(cube(type3.type3(src, src, goals, config), "target_id", 1, 50)[0], truth) < 20 * eps


def test_type_3_degenerate_intervals(spark):
    config = Type3Config([(0.75, 0.75), (-2, 2)], [(-20, 20), (3, 3)], eps=1e-9)
    src = spark.createDataFrame(pd.DataFrame({"point_id": [0, 1, 2], "x0": [0.75] * 3, "x1": [-2.0, 0.3, 2.0], "re": [1.0, -2, 0.5], "im": [0.0, 1, 2]}))
    goals = spark.createDataFrame(pd.DataFrame({"target_id": [0, 1, 2], "s0": [-20.0, 1.5, 20.0], "s1": [3.0] * 3}))
    a, b = (cube(f(src, src, goals, config), "target_id", 1, 3) for f in (type3.type3, direct.type3))
    assert error(a, b) < 1e-8


@pytest.mark.parametrize("run", [direct, gridded])
def test_empty_inputs(spark, run):
    config = TransformConfig((6, 4))
    none = spark.createDataFrame([], "point_id long, x0 double, x1 double, re double, im double")
    zeros = run.type1(none, none, config).toPandas()
    assert len(zeros) == 24 and (zeros[["re", "im"]] == 0).all().all()
    modes = direct.type1(none, none, config)
    assert run.type2(none, modes, config).count() == 0


def test_empty_type_3(spark):
    config = Type3Config([(0, 1)], [(0, 5)])
    none = spark.createDataFrame([], "point_id long, x0 double, re double, im double")
    goals = spark.createDataFrame([(0, 1.0), (1, 2.0)], "target_id long, s0 double")
    for run in (direct.type3, type3.type3):
        out = run(none, none, goals, config).toPandas()
        assert len(out) == 2 and (out[["re", "im"]] == 0).all().all()


def test_high_rank(spark):
    config = TransformConfig((3, 2, 2, 2, 2), eps=1e-2)
    x, c, points, values = frame(5, 20)
    p, s = spark.createDataFrame(points), spark.createDataFrame(values)
    truth = c @ np.exp(1j * mode_list(config) @ x.T).T
    assert error(cube(gridded.type1(p, s, config), "lin", 1, 48), truth) < 0.1


def test_uniform_dft(spark):
    v = RNG.normal(size=8) + 1j * RNG.normal(size=8)
    df = spark.createDataFrame(pd.DataFrame({"id": 0, "i": np.arange(8), "re": v.real, "im": v.imag}))
    for inverse, norm, truth in [(False, "none", np.fft.fft(v)), (True, "inverse", np.fft.ifft(v)), (False, "orthogonal", np.fft.fft(v, norm="ortho"))]:
        out = direct.uniform_dft(df, "id", "i", 8, inverse, norm).orderBy("k").toPandas()
        assert np.allclose(out["re"] + 1j * out["im"], truth)


def test_bins(spark):
    points = spark.createDataFrame(frame(2, 500)[2])
    out = bin_offsets(bin_histogram(points, layout_for(TransformConfig((32, 32))), 16)).orderBy("bin").toPandas()
    assert out["n"].sum() == 500 and (out["offset"] == out["n"].cumsum() - out["n"]).all()


def all_pairs(monkeypatch, *args, **options):
    with monkeypatch.context() as m:
        m.setattr(direct, "_panels", lambda sources, goals: None)
        return direct.type3(*args, **options).toPandas()


def test_direct_type_3_of_many_targets_does_not_form_all_pairs(spark):
    """20,000 sources and 300,000 targets would be 6 billion pairs, which the timer cuts off; every target has its value all the same."""
    src = spark.range(20_000).selectExpr("id AS point_id", "(id * 7919 % 1000003) / 91000D - 1 AS x0", "1D AS re", "0D AS im")
    goals = spark.range(300_000).selectExpr("id AS target_id", "(id * 104729 % 1000003) / 45000D - 2 AS s0")
    late = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        out = direct.type3(src, src, goals, Type3Config([(-1, 10)], [(-2, 21)])).toPandas()
    finally:
        late.cancel()
    assert len(out) == out["target_id"].nunique() == 300_000
    out, x = out.set_index("target_id"), src.toPandas()["x0"].to_numpy()
    some = goals.filter("target_id % 9001 = 0 OR s0 = -2 OR s0 > 20.222").toPandas()
    truth = np.array([np.exp(1j * s * x).sum() for s in some["s0"]])
    got = out.loc[some["target_id"]]
    assert np.abs(got["re"].to_numpy() + 1j * got["im"].to_numpy() - truth).max() / 20_000 < 1e-13


@pytest.mark.parametrize("sign,x_lo,x_hi,s_lo,s_hi", [(1, -1, 10, -2, 20), (-1, 1e4, 1e4 + 3, -700, -690), (1, -3, 3, 5, 5), (-1, 2, 2, -9, 9), (1, -1e-9, 1e-9, -1, 1)])
def test_panels_equal_all_pairs(spark, sign, x_lo, x_hi, s_lo, s_hi):
    config = Type3Config([(x_lo, x_hi)], [(s_lo, s_hi)], batch=3, isign=sign)
    x, s = RNG.uniform(x_lo, x_hi, 900), RNG.uniform(s_lo, s_hi, 2000)
    x[:2], s[:2] = (x_lo, x_hi), (s_lo, s_hi)
    c = RNG.normal(size=(2, 900)) + 1j * RNG.normal(size=(2, 900))
    src = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(900), "x0": x}))
    values = spark.createDataFrame(pd.concat([pd.DataFrame({"transform_id": t, "point_id": np.arange(900), "re": c[t].real, "im": c[t].imag}) for t in range(2)]))
    goals = spark.createDataFrame(pd.DataFrame({"target_id": np.arange(2000), "s0": s}))
    assert direct._panels(src, goals)
    out = cube(direct.type3(src, values, goals, config), "target_id", 3, 2000)
    assert np.abs(out[:2] - c @ np.exp(1j * sign * np.outer(x, s))).max() / np.abs(c).sum() < (1e-13 if x_hi < 100 else 1e-10)
    assert (out[2] == 0).all()
    ordered = [cube(direct.type3(src, values.repartition(n), goals.repartition(n), config, deterministic=True), "target_id", 3, 2000) for n in (1, 5)]
    assert (ordered[0] == ordered[1]).all() and np.abs(ordered[0] - out).max() < 1e-11


def test_panels_take_odd_rows_as_all_pairs_do(spark, monkeypatch):
    """Targets beyond the configured bounds, repeated ids, nulls, NaN and infinities."""
    config = Type3Config([(0, 1)], [(0, 1)])
    src = spark.range(500).selectExpr("id AS point_id", "IF(id = 3, NULL, id / 100D) AS x0", "1D AS re", "IF(id = 4, NULL, 0D) AS im")
    goals = spark.range(700).selectExpr("id DIV 2 AS target_id", "CASE id WHEN 20 THEN NULL WHEN 30 THEN double('NaN') WHEN 40 THEN double('inf') WHEN 50 THEN double('-inf') ELSE id / 50D - 3 END AS s0")
    worse = src.withColumn("x0", F.expr("IF(point_id = 9, double('NaN'), x0)"))
    for own in (src, worse):
        assert direct._panels(own, goals)
        a, b = (d.sort_values("target_id") for d in (direct.type3(own, own, goals, config).toPandas(), all_pairs(monkeypatch, own, own, goals, config)))
        assert len(a) == len(b) == 350 and a[["re", "im"]].isna().sum().tolist() == b[["re", "im"]].isna().sum().tolist()
        assert np.allclose(a.to_numpy(float), b.to_numpy(float), atol=1e-10, equal_nan=True)
