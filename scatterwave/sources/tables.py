"""Point sets, strengths, modes and targets read from parquet tables, with only the columns they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586
PI = 3.141592653589793


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 2024 of a zone-free timestamp; independent of the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})")


def daily_phase(ts: str) -> Column:
    return F.pmod(micros(ts), F.lit(86_400_000_000)).cast("double") / 86_400_000_000.0 * TWO_PI - PI


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points on the day's circle, with ``value`` as a real strength."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), daily_phase("ts").alias("x0"), F.col("value").alias("re"), F.lit(0.0).alias("im"), F.lit(0).alias("transform_id"), "event_type", "user_id")


def lineitem_points(spark: SparkSession, sf_dir: str, rank: int) -> DataFrame:
    """Line items as points: discount, quantity and tax scaled into one period. Their keys repeat, so ids do too."""
    own = [F.col("l_discount") * 31.0 - 1.5, F.col("l_quantity") * 0.12 - 3.0, F.col("l_tax") * 37.0 - 1.4]
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("point_id"), *[c.alias(f"x{d}") for d, c in enumerate(own[:rank])], (F.col("l_extendedprice") / 100000.0).alias("re"), F.lit(0.0).alias("im"), F.lit(0).alias("transform_id"))


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Results are DataFrames; any Spark writer takes them. This one writes parquet."""
    df.write.mode(mode).parquet(path)
