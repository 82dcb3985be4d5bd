"""Data contracts as one aggregate each: the first violating row is found, and nothing else is moved."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterwave.config import Interval, TransformConfig
from scatterwave.errors import TransformError
from scatterwave.functions.columns import linear_index

LIMIT = 3.0 * math.pi


def _not_finite(c):
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def violations(points: DataFrame, id_col: str, columns: list[str], bounds: list[tuple[float, float]]) -> DataFrame:
    """Every coordinate that is missing, not finite or outside its bounds: ``id, axis, value, kind``."""
    checks = [
        F.struct(
            F.lit(axis).alias("axis"),
            F.col(c).cast("double").alias("value"),
            F.when(_not_finite(F.col(c)), F.lit("non_finite")).when((F.col(c) < lo) | (F.col(c) > hi), F.lit("out_of_range")).alias("kind"),
        )
        for axis, (c, (lo, hi)) in enumerate(zip(columns, bounds))
    ]
    bad = F.filter(F.array(*checks), lambda s: s["kind"].isNotNull())
    return points.select(F.col(id_col).alias("id"), F.explode(bad).alias("v")).select("id", "v.axis", "v.value", "v.kind")


def _first(found: DataFrame):
    return found.agg(F.min_by(F.struct("id", "axis", "value", "kind"), F.struct("id", "axis")).alias("first")).first()["first"]


def check_points(points: DataFrame, rank: int) -> None:
    """Types 1 and 2: finite and within three periods' half-width; the first failure by id and axis is raised."""
    names = [f"x{d}" for d in range(rank)]
    if missing := [n for n in names if n not in points.columns]:
        raise TransformError(TransformError.COORDINATE_LENGTH, missing=missing)
    if first := _first(violations(points, "point_id", names, [(-LIMIT, LIMIT)] * rank)):
        code = TransformError.NON_FINITE_COORDINATE if first["kind"] == "non_finite" else TransformError.POINT_RANGE
        raise TransformError(code, point=first["id"], axis=first["axis"], value=first["value"])


def check_type3(rows: DataFrame, id_col: str, prefix: str, bounds: tuple[Interval, ...]) -> None:
    names = [f"{prefix}{d}" for d in range(len(bounds))]
    if missing := [n for n in names if n not in rows.columns]:
        raise TransformError(TransformError.COORDINATE_LENGTH, missing=missing)
    if first := _first(violations(rows, id_col, names, [(b.lower, b.upper) for b in bounds])):
        code = TransformError.T3_NON_FINITE if first["kind"] == "non_finite" else TransformError.T3_OUT_OF_BOUNDS
        raise TransformError(code, set=id_col, row=first["id"], axis=first["axis"], value=first["value"])


def check_complex(rows: DataFrame, id_col: str) -> None:
    """Finite real and imaginary parts; the first failure by transform and row is raised."""
    if "transform_id" not in rows.columns:
        rows = rows.withColumn("transform_id", F.lit(0))
    bad = rows.filter(_not_finite(F.col("re")) | _not_finite(F.col("im")))
    first = bad.agg(F.min(F.struct(F.col("transform_id"), F.col(id_col)))).first()[0]
    if first is not None:
        raise TransformError(TransformError.NON_FINITE_COMPLEX, transform=first[0], row=first[1])


def check_modes(modes: DataFrame, config: TransformConfig, active: int) -> None:
    """Type 2: every transform carries each mode of the configuration exactly once, with finite values."""
    ks = [f"k{d}" for d in range(config.rank)]
    if missing := [k for k in ks if k not in modes.columns]:
        raise TransformError(TransformError.COORDINATE_LENGTH, missing=missing)
    if "transform_id" not in modes.columns:
        modes = modes.withColumn("transform_id", F.lit(0))
    inside = F.lit(True)
    for k, n in zip(ks, config.n_modes):
        inside = inside & F.col(k).between(-(n // 2), (n + 1) // 2 - 1)
    outside = modes.filter(~F.coalesce(inside, F.lit(False))).agg(F.min(F.struct("transform_id", *ks))).first()[0]
    if outside is not None:
        raise TransformError(TransformError.INPUT_LENGTH, transform=outside[0], outside=tuple(outside)[1:])
    _check_counts(modes, linear_index([F.col(k) for k in ks], config.n_modes, config.mode_order), config.mode_count, active)
    check_complex(modes.withColumn("lin", linear_index([F.col(k) for k in ks], config.n_modes, config.mode_order)), "lin")


def _check_counts(values: DataFrame, key, want: int, active: int) -> None:
    got = {r["transform_id"]: (r["n"], r["d"]) for r in values.groupBy("transform_id").agg(F.count("*").alias("n"), F.countDistinct(key).alias("d")).limit(active + 1).collect()}
    for t in range(active):
        n, distinct = got.get(t, (0, 0))
        if n != want or distinct != want:
            raise TransformError(TransformError.INPUT_LENGTH, transform=t, expected=want, actual=n, distinct=distinct)
    if len(got) > active:
        raise TransformError(TransformError.BATCH, batch=len(got), capacity=active)


def check_lengths(points: DataFrame, values: DataFrame, id_col: str, active: int) -> None:
    """Every transform carries exactly one value for each point. One table that holds both needs no count of its own."""
    if "transform_id" not in values.columns:
        values = values.withColumn("transform_id", F.lit(0))
    _check_counts(values, F.col(id_col), points.count(), active)


def check_attached(points: DataFrame, values: DataFrame, id_col: str, active: int) -> None:
    """Strengths of a call that has both sides at hand: counts as in ``check_lengths``, and no strength without its point."""
    if values is points:  # a row holds a point and its strength, so only the transforms are counted
        if "transform_id" in values.columns:
            known = values.agg(F.min("transform_id").alias("a"), F.max("transform_id").alias("b")).first()
            if known["a"] is not None and (known["a"] < 0 or known["b"] >= active):
                raise TransformError(TransformError.BATCH, batch=known["b"] + 1, capacity=active)
        return
    check_lengths(points, values, id_col, active)
    alone = values.join(points.select(id_col), id_col, "left_anti").agg(F.min(id_col)).first()[0]
    if alone is not None:
        raise TransformError(TransformError.INPUT_LENGTH, strength_without_point=alone)
