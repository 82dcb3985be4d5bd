"""One-call transforms with numpy arrays in and out: ``nufft1d1`` ... ``nufft3d3`` and float forms ``nufftf1d1`` ...

Points are ``(M,)`` or ``(M, d)``; values ``(M,)`` or ``(B, M)``; modes ``(n0, .., )`` or ``(B, n0, ..)``.
Arrays live on the driver by their nature; DataFrames of any size go to ``scatterwave.plans.plan.Plan``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from scatterwave.config import Interval, ModeOrder, TransformConfig, Type3Config
from scatterwave.errors import TransformError
from scatterwave.functions.kernel import signed_modes
from scatterwave.plans.plan import Plan, cached_plan


def _session() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def _points(x, rank: int) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    x = x[:, None] if x.ndim == 1 and rank == 1 else x
    if x.ndim != 2 or x.shape[1] != rank:
        raise TransformError(TransformError.COORDINATE_LENGTH, shape=x.shape, rank=rank)
    return x


def _points_df(x: np.ndarray, id_col: str, prefix: str):
    data = {id_col: np.arange(len(x))} | {f"{prefix}{d}": x[:, d] for d in range(x.shape[1])}
    schema = f"{id_col} long, " + ", ".join(f"{prefix}{d} double" for d in range(x.shape[1]))
    return _session().createDataFrame(pd.DataFrame(data), schema)


def _values_df(c: np.ndarray, id_col: str = "point_id"):
    b, m = c.shape
    pdf = pd.DataFrame({"transform_id": np.repeat(np.arange(b, dtype=np.int32), m), id_col: np.tile(np.arange(m), b), "re": c.real.ravel(), "im": c.imag.ravel()})
    return _session().createDataFrame(pdf, f"transform_id int, {id_col} long, re double, im double")


def _axis_modes(n: int, order: ModeOrder) -> np.ndarray:
    k = signed_modes(n)
    return k if order is ModeOrder.CENTERED else np.concatenate([k[k >= 0], k[k < 0]])


def _batched(a, ndim: int) -> tuple[np.ndarray, bool]:
    a = np.asarray(a, dtype=complex)
    if a.ndim == ndim:
        return a[None], True
    if a.ndim != ndim + 1:
        raise TransformError(TransformError.INPUT_LENGTH, shape=a.shape)
    return a, False


def execute(plan: Plan, points, values, targets=None) -> np.ndarray:
    """Run a plan on arrays and give an array of the plan's shape."""
    config, rank = plan.config, plan.config.rank
    x = _points(points, rank)
    df = _points_df(x, "point_id", "x")
    if plan.kind == 2:
        f, single = _batched(values, rank)
        if f.shape[1:] != config.n_modes:
            raise TransformError(TransformError.INPUT_LENGTH, shape=f.shape, n_modes=config.n_modes)
        ks = np.meshgrid(*[_axis_modes(n, config.mode_order) for n in config.n_modes], indexing="ij")
        data = {"transform_id": np.repeat(np.arange(len(f), dtype=np.int32), f[0].size)} | {f"k{d}": np.tile(k.ravel(), len(f)).astype(np.int32) for d, k in enumerate(ks)}
        modes = _session().createDataFrame(pd.DataFrame(data | {"re": f.real.ravel(), "im": f.imag.ravel()}))
        out, n_out, id_col = plan.transform(df, modes, active=len(f)).toPandas(), len(x), "point_id"
    else:
        c, single = _batched(values, 1)
        f = c
        if c.shape[1] != len(x):
            raise TransformError(TransformError.INPUT_LENGTH, expected=len(x), actual=c.shape[1])
        if plan.kind == 1:
            out, n_out, id_col = plan.transform(df, _values_df(c), active=len(c)).toPandas(), config.mode_count, "lin"
        else:
            s = _points(targets, rank)
            out, n_out, id_col = plan.transform(df, _values_df(c), _points_df(s, "target_id", "s"), active=len(c)).toPandas(), len(s), "target_id"
    result = np.zeros((len(f), n_out), complex)
    result[out["transform_id"].to_numpy(int), out[id_col].to_numpy(int)] = out["re"].to_numpy() + 1j * out["im"].to_numpy()
    if plan.kind == 1:  # dimension zero is the fastest in rows, the slowest in arrays
        result = result.reshape((len(f), *config.n_modes[::-1])).transpose(0, *range(rank, 0, -1))
    return result[0] if single else result


def _batch(a, ndim: int) -> int:
    return np.shape(a)[0] if np.ndim(a) == ndim + 1 else 1


def _one_call(rank: int, kind: int, precision: str):
    options = "eps=1e-6, isign=+1, sigma=2.0"

    def type1(points, strengths, n_modes, eps=1e-6, isign=1, sigma=2.0, mode_order="centered"):
        n_modes = (n_modes,) if np.isscalar(n_modes) else tuple(n_modes)
        if len(n_modes) != rank:
            raise TransformError(TransformError.DIMENSIONS, rank=rank, n_modes=n_modes)
        return execute(cached_plan(1, TransformConfig(n_modes, _batch(strengths, 1), eps, isign, mode_order, sigma, precision)), points, strengths)

    def type2(points, modes, eps=1e-6, isign=1, sigma=2.0, mode_order="centered"):
        n_modes = np.shape(modes)[-rank:]
        return execute(cached_plan(2, TransformConfig(n_modes, _batch(modes, rank), eps, isign, mode_order, sigma, precision)), points, modes)

    def type3(points, strengths, targets, eps=1e-6, isign=1, sigma=2.0):
        def hull(a):
            a = _points(a, rank)
            return tuple(Interval(float(v.min()), float(v.max())) if len(a) else Interval(0.0, 0.0) for v in a.T)

        return execute(cached_plan(3, Type3Config(hull(points), hull(targets), _batch(strengths, 1), eps, isign, sigma, precision)), points, strengths, targets)

    made = {1: type1, 2: type2, 3: type3}[kind]
    made.__name__ = f"nufft{'f' if precision == 'f32' else ''}{rank}d{kind}"
    made.__doc__ = f"Type {kind} over {rank} axes in {precision}; {options}."
    return made


ONE_CALL = {f.__name__: f for p in ("f64", "f32") for d in (1, 2, 3) for k in (1, 2, 3) for f in [_one_call(d, k, p)]}
globals().update(ONE_CALL)
__all__ = ["ONE_CALL", "execute", *ONE_CALL]
