import numpy as np
import pandas as pd
import pytest

from scatterwave import TransformConfig, TransformError, Type3Config
from scatterwave.plans import arrays, sql
from scatterwave.plans.plan import AutoBoundsType3, Plan, cached_plan, choose_method
from scatterwave.streaming.type1 import type1_stream

RNG = np.random.default_rng(3)


def rows(spark, m=50, rank=1):
    x = RNG.uniform(-3, 3, (m, rank))
    return x, spark.createDataFrame(pd.DataFrame({"point_id": np.arange(m), "transform_id": 0, "re": RNG.normal(size=m), "im": 0.0} | {f"x{d}": x[:, d] for d in range(rank)}))


def test_prepared_points_serve_both_types(spark):
    _, p = rows(spark)
    one = Plan(1, TransformConfig((9,), eps=1e-9)).set_points(p)
    modes = one.execute(p, method="gridded")
    exact = one.execute(p, method="direct").toPandas().sort_values("lin")
    got = modes.toPandas().sort_values("lin")
    assert np.allclose(got["re"], exact["re"], atol=1e-7)
    two = one.adjoint()
    out = two.execute(modes, prepared=one._points)
    assert out.count() == 50
    with pytest.raises(TransformError) as e:
        Plan(2, TransformConfig((64,))).execute(modes, prepared=one._points)
    assert e.value.code == "PointSetMismatch"
    assert one.describe()["prepared"] and "prepare" in one.timings()
    assert one.expected_rows(50) == {"points": 50, "input": 50, "output": 9}
    one.unpersist()


@pytest.mark.parametrize("bad,code", [(float("nan"), "NonFiniteCoordinate"), (12.6, "PointOutOfRange"), (float("inf"), "NonFiniteCoordinate"), (None, "NonFiniteCoordinate")])
def test_points_are_checked(spark, bad, code):
    p = spark.createDataFrame([(0, 0.5, 1.0, 0.0), (1, bad, 1.0, 0.0), (2, 99.0, 1.0, 0.0)], "point_id long, x0 double, re double, im double")
    with pytest.raises(TransformError) as e:
        Plan(1, TransformConfig((4,))).transform(p, p)
    assert e.value.code == code and e.value.fields["point"] == 1


def test_values_are_checked(spark):
    _, p = rows(spark, 5)
    plan = Plan(1, TransformConfig((4,))).set_points(p)
    with pytest.raises(TransformError) as e:
        plan.execute(p.filter("point_id > 0"))
    assert e.value.code == "InputLength"
    with pytest.raises(TransformError) as e:
        plan.execute(p.withColumn("im", p["im"] + float("inf")))
    assert e.value.code == "NonFiniteComplex"
    plan.unpersist()


def test_type3_bounds_are_checked(spark):
    src = spark.createDataFrame([(0, 1.5, 1.0, 0.0)], "point_id long, x0 double, re double, im double")
    goals = spark.createDataFrame([(0, 1.0)], "target_id long, s0 double")
    with pytest.raises(TransformError) as e:
        Plan(3, Type3Config([(-1, 1)], [(-5, 5)])).transform(src, src, goals)
    assert e.value.code == "Type3CoordinateOutOfBounds"


def test_auto_bounds_keep_their_plan(spark):
    _, p = rows(spark)
    goals = spark.createDataFrame([(0, 1.0), (1, 9.0)], "target_id long, s0 double")
    auto = AutoBoundsType3(1, eps=1e-8)
    first = auto.set_points(p, goals)
    assert first.execute(p).count() == 2
    assert auto.set_points(p.filter("abs(x0) < 1"), goals) is first
    assert auto.set_points(p.withColumn("x0", p["x0"] * 2), goals) is not first


def test_chooser():
    assert choose_method(TransformConfig((4,)), 2) == "direct"
    assert choose_method(TransformConfig((512, 512)), 10**7) == "gridded"


def test_arrays(spark):
    x, c = RNG.uniform(-3, 3, (30, 2)), RNG.normal(size=30) + 1j * RNG.normal(size=30)
    f = arrays.nufft2d1(x, c, (5, 4), eps=1e-9)
    k0, k1 = np.meshgrid(np.arange(-2, 3), np.arange(-2, 2), indexing="ij")
    truth = np.einsum("j,abj->ab", c, np.exp(1j * (k0[..., None] * x[:, 0] + k1[..., None] * x[:, 1])))
    assert np.allclose(f, truth, atol=1e-6)
    assert np.allclose(arrays.nufft2d2(x, f, eps=1e-9), np.einsum("ab,abj->j", f, np.exp(1j * (k0[..., None] * x[:, 0] + k1[..., None] * x[:, 1]))), atol=1e-5)
    s = RNG.uniform(-9, 9, 11)
    assert np.allclose(arrays.nufft1d3(x[:, 0], c, s, eps=1e-9), np.exp(1j * np.outer(s, x[:, 0])) @ c, atol=1e-6)
    assert arrays.nufftf1d1(x[:, 0], np.stack([c, 2 * c]), 7).shape == (2, 7)
    assert len(arrays.ONE_CALL) == 18
    with pytest.raises(TransformError):
        arrays.nufft2d1(x[:, 0], c, (5, 4))
    assert cached_plan(1, TransformConfig((3,))) is cached_plan(1, TransformConfig((3,)))


def test_sql(spark):
    assert "es_kernel" in sql.register(spark)
    got = spark.sql("SELECT es_kernel(0D, 7, 16.1D) a, es_kernel(3.5D, 7, 16.1D) b, mode_of_index(5, 6, true) c, df64_hi(0.1D) + df64_lo(0.1D) d").first()
    assert (got["a"], got["b"], got["c"]) == (1.0, 0.0, -1) and got["d"] == pytest.approx(0.1)
    _, p = rows(spark)
    p.createOrReplaceTempView("pts")
    assert sql.nufft_view(spark, 1, "pts", "pts", "spectrum", n_modes=(6,)).count() == 6
    assert spark.table("spectrum").count() == 6


def test_streaming_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    n = 40
    pdf = pd.DataFrame({"ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(n) * 5, unit="min"), "x0": RNG.uniform(-3, 3, n), "re": 1.0, "im": 0.0})
    df = spark.createDataFrame(pdf)
    df.write.parquet(str(tmp_path / "in"))
    config = TransformConfig((5,))
    stream = type1_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), config)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("t1_stream").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("t1_stream").groupBy("lin").agg(F.sum("re").alias("re")).orderBy("lin").toPandas()
    truth = np.cos(np.outer(np.arange(-2, 3), pdf["x0"])).sum(axis=1)
    assert np.allclose(got["re"], truth)


def test_entry_and_queries(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 64
    core = e.core.queries()
    assert set(e.core.oracle_sql()) <= set(core)
