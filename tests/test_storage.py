import pytest
from pyspark.sql import functions as F

from civicflow import storage
from civicflow.operators import components as module


class Elsewhere:
    """A session of a cluster without the setting."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Elsewhere)
    Elsewhere.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        storage.shared_dir(Elsewhere)


def test_tables_go_when_they_are_dropped(spark):
    df = storage.cut(spark.range(5), "t")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert storage.exists(spark, path) and df.count() == 5
    storage.dropped(df, spark.range(1))
    assert not storage.exists(spark, path)


def test_a_single_process_gets_a_folder_of_its_own():
    Elsewhere.sparkContext.master = "local[4]"
    assert storage.shared_dir(Elsewhere) == storage.shared_dir(Elsewhere) != ""


def test_components_leave_one_table(spark, monkeypatch):
    left = []
    cut, dropped = storage.cut, storage.dropped
    monkeypatch.setattr(module, "cut", lambda df, tag: left.append(out := cut(df, tag)) or out)
    monkeypatch.setattr(module, "dropped", lambda *dfs: [left.remove(d) for d in dfs] and dropped(*dfs))
    found = module.components(spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert found.agg(F.max("root")).first()[0] == 0 and found.count() == 51
    assert len(left) == 1
