"""SQL surface: scalar functions that Catalyst inlines, and transforms of registered views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scatterwave.config import TransformConfig, Type3Config
from scatterwave.operators import type3
from scatterwave.plans.plan import Plan

FUNCTIONS = {
    "es_kernel(d DOUBLE, w INT, beta DOUBLE) RETURNS DOUBLE": "CASE WHEN 1 - power(2 * d / w, 2) > 0 THEN exp(beta * (sqrt(1 - power(2 * d / w, 2)) - 1)) ELSE 0D END",
    "grid_position(x DOUBLE, n INT) RETURNS DOUBLE": "pmod(x * n / (2 * pi()) + n / 2D, CAST(n AS DOUBLE))",
    "mode_of_index(i BIGINT, n INT, fft_order BOOLEAN) RETURNS BIGINT": "CASE WHEN NOT fft_order THEN i - n DIV 2 WHEN i < (n + 1) DIV 2 THEN i ELSE i - n END",
    "df64_hi(x DOUBLE) RETURNS FLOAT": "CAST(x AS FLOAT)",
    "df64_lo(x DOUBLE) RETURNS FLOAT": "CAST(x - CAST(CAST(x AS FLOAT) AS DOUBLE) AS FLOAT)",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; gives their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]


def nufft_view(spark: SparkSession, kind: int, points: str, values: str, into: str, targets: str | None = None, **options) -> DataFrame:
    """Transform views by name and register the result as the view ``into``."""
    src, vals = spark.table(points), spark.table(values)
    if kind == 3:
        goals = spark.table(targets)
        rank = sum(c.startswith("x") and c[1:].isdigit() for c in src.columns)
        out = Plan(3, Type3Config(type3.bounds_of(src, "x", rank), type3.bounds_of(goals, "s", rank), **options)).transform(src, vals, goals)
    else:
        out = Plan(kind, TransformConfig(**options)).transform(src, vals)
    out.createOrReplaceTempView(into)
    return out
