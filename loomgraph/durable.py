"""Cutting lineage with tables written to the folder that all executors share.

The folder is the session's `spark.checkpoint.dir`. Only where that is unset (tests, a notebook in local mode) a
temporary folder is made. A written table survives the loss of any executor, unlike a local checkpoint, and unlike an
RDD checkpoint it is columnar and compressed and has statistics.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; in local mode a temporary one if none is set. On a cluster it must be set: a folder
    of one machine would hold only what that machine's executors wrote."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        holder = tempfile.TemporaryDirectory(prefix="loomgraph-")
        atexit.register(holder.cleanup)
        _OWN["dir"] = "file://" + holder.name
    return _OWN["dir"]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that cut() wrote."""
    _WRITTEN.discard(path)
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


_WRITTEN: set[str] = set()


def sweep(spark: SparkSession) -> None:
    """Delete every table that this process has cut and not dropped. Results that still read one can't be read after."""
    for path in list(_WRITTEN):
        remove(spark, path)


class Cut:
    """A materialised table: `df` to read it, `rows` it holds, `drop()` once nothing reads it any more."""

    def __init__(self, spark: SparkSession, path: str, df: DataFrame):
        self.spark, self.path, self.df = spark, path, df
        self._rows: int | None = None

    @property
    def rows(self) -> int:
        if self._rows is None:
            self._rows = self.df.count()  # from the files' footers
        return self._rows

    def drop(self) -> None:
        remove(self.spark, self.path)


def cut(df: DataFrame, codec: str = "zstd") -> Cut:
    """Write `df` to the shared folder and read it back, with its lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    df.write.option("compression", codec).parquet(path)
    return Cut(spark, path, spark.read.schema(df.schema).parquet(path))
