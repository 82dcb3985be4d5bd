"""Incremental type 1: the transform is a sum over points, so a windowed streaming aggregate is exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterwave.config import TransformConfig
from scatterwave.functions.columns import phase, rotate
from scatterwave.operators.modes import axis_names, mode_table
from scatterwave.runtime import broadcast_if_small


def type1_stream(points: DataFrame, config: TransformConfig, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows ``ts, x0.., re, im`` of a stream to ``window, lin, k0.., n, re, im``; rows later than ``late`` are dropped.

    State is one row per open window and mode, whatever the number of points. The mode table is generated and
    its size is the configuration's, so it is broadcast up to a checked number of modes.
    """
    xs, ks = axis_names("x", config.rank), axis_names("k", config.rank)
    joined = points.withWatermark(ts, late).crossJoin(broadcast_if_small(mode_table(points.sparkSession, config), config.mode_count))
    re, im = rotate(F.col("re"), F.col("im"), phase([F.col(x) for x in xs], [F.col(k) for k in ks], config.sign))
    terms = joined.select(ts, "lin", *ks, re.alias("re"), im.alias("im"))
    return terms.groupBy(F.window(ts, window), "lin", *ks).agg(F.count("*").alias("n"), F.sum("re").alias("re"), F.sum("im").alias("im"))
