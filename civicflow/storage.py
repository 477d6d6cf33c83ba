"""Shared storage for intermediate tables, so that lost executors cost no lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cache
from weakref import WeakKeyDictionary

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@cache
def _own_dir() -> str:
    folder = tempfile.mkdtemp(prefix="civicflow-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a session of a single process, as in tests, gets a temporary
    folder that goes when the process ends. On a cluster there is no such folder, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own_dir()
    return found.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def put_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Creates a file with all of its content, unless there is one of that name; of several writers one succeeds.

    On a local file system the complete file gets its name by a link, elsewhere by a rename that
    overwrites nothing, which HDFS does as one step. Object stores without such a rename aren't fit for it.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, name = path.rsplit("/", 1)
    target, temporary = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}.{uuid.uuid4().hex}")
    system = target.getFileSystem(conf)
    out = system.create(temporary, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if system.getScheme() == "file":
            os.link(temporary.toUri().getPath(), target.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(temporary, target, none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        system.delete(temporary, False)


def removed(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame, tag: str, packed: bool = True) -> DataFrame:
    """Writes a frame to the shared folder and reads it back. Hashes gain nothing from being packed, that is from dictionaries and compression."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd" if packed else "none", "parquet.enable.dictionary": str(packed).lower()}).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[back] = path
    return back


def dropped(*frames: DataFrame) -> None:
    """Removes the tables behind frames that ``cut`` returned and that nothing will read again."""
    for df in frames:
        if path := _paths.pop(df, None):
            removed(df.sparkSession, path)
