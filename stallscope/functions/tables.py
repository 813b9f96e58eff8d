"""Tables in the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []
_scopes: list[list[str]] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What is written inside goes at the end of the block, so results have to be used inside."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where, system = _on_disk(spark, path)
            system.delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of our own if all tasks run on this machine, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="stallscope-"))
    return _own_folder[0]


def _on_disk(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes at the end of ``released`` or of the application, if not before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where, system = _on_disk(spark, path)
    system.deleteOnExit(where)
    if _scopes:
        _scopes[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, which cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            where, system = _on_disk(df.sparkSession, path)
            system.delete(where, True)
