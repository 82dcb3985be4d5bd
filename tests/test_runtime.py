"""Session helpers: where scratch data may lie, and how small tables are dealt out and written."""

from types import SimpleNamespace

import pytest

from scatterwave import runtime


def test_a_cluster_has_to_name_its_folder():
    undefined = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: undefined)), getConf=lambda: SimpleNamespace(get=lambda k: None))
    spark = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(RuntimeError):
        runtime.shared_dir(spark)


def test_small_tables_use_all_cores(spark):
    one = spark.range(1000).coalesce(1)
    assert runtime.dealt_out(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    unknown = runtime.cut(one)  # its size is not known, so it stays
    assert runtime.dealt_out(unknown).rdd.getNumPartitions() == 1


def test_known_rows_bound_the_files(spark):
    rows = spark.range(0, 1000, 1, 40)
    assert runtime.cut(rows).rdd.getNumPartitions() == 40
    few = runtime.cut(rows, 1000, 300)
    assert few.rdd.getNumPartitions() == 4 and few.count() == 1000


def test_scratch_is_removed(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.range(3).write.parquet(path)
    runtime.delete_path(spark, path)
    assert not (tmp_path / "x").exists()
