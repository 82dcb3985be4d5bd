"""Mode tables: signed frequencies, their storage position and the deconvolution amplitude."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterwave.config import TransformConfig
from scatterwave.functions.columns import mode_of_index


def axis_names(prefix: str, rank: int) -> list[str]:
    return [f"{prefix}{d}" for d in range(rank)]


def mode_table(spark: SparkSession, config: TransformConfig) -> DataFrame:
    """One row per mode: ``lin`` (dimension zero fastest) and signed ``k0..``; generated, nothing is collected."""
    out = spark.range(config.mode_count).withColumnRenamed("id", "lin")
    stride = 1
    for d, n in enumerate(config.n_modes):
        index = F.pmod(F.floor(F.col("lin") / F.lit(stride)), F.lit(n)).cast("int") if stride > 1 else F.pmod(F.col("lin"), F.lit(n)).cast("int")
        out = out.withColumn(f"k{d}", mode_of_index(index, n, config.mode_order).cast("int"))
        stride *= n
    return out


def transform_ids(spark: SparkSession, active: int) -> DataFrame:
    return spark.range(active).select(F.col("id").cast("int").alias("transform_id"))
