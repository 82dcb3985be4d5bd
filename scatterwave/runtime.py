"""Session helpers: the package reaches Python workers, and scratch data goes to the shared folder."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once for each application, so no executor needs it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, f"{_ROOT.name}/{p.relative_to(_ROOT)}")
    folder = tempfile.mkdtemp(prefix="scatterwave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{_ROOT.name}.zip")
    Path(path).write_bytes(packed.getvalue())
    sc.addPyFile(path)  # the driver's file server hands it to executors
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset, a temporary one serves a local session; a cluster has to name one."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="scatterwave-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder, wherever Spark's file systems keep it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, rows: int | None = None, per: int = 50_000) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: its lineage ends and a lost executor costs nothing.

    ``rows``, a known bound of its rows, keeps the number of files to one for every ``per`` of them, as a table that is
    small beside the shuffle's partitions would be written in as many tiny files.

    The frame that comes back has no size estimate: a checkpoint keeps the one of its plan, and over many joins and
    rounds the products of estimates grow to numbers so long that planning takes minutes.
    """
    spark = df.sparkSession
    shared_dir(spark)
    held = (df if rows is None else df.coalesce(max(1, -(-rows // per)))).checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)


def dealt_out(df: DataFrame) -> DataFrame:
    """A small table over all cores, for work that is heavy in each row.

    A file of one row group is one task, however many cores wait. Tables whose estimated size is beyond a usual split
    for each core have tasks enough and stay where they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) <= cores * 2**26 else df


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 2_000_000) -> DataFrame:
    """Broadcast hint only where ``rows``, a count or a proven bound, is under ``limit``; beyond it Spark shuffles."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= limit else df
