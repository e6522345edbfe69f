"""Tables written in the folder that driver and executors share: what cuts lineage and outlives a lost executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that `written` made and nobody has forgotten yet.
_KEPT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A new folder for written tables below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent, a local master (tests) gets a folder of its own; any other raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/marlstone-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and the loss of an executor costs nothing already written."""
    path = shared_dir(df.sparkSession)
    _KEPT.add(path)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _KEPT.discard(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing lazy reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.stored_at)


def sweep(spark: SparkSession) -> int:
    """Delete all tables of `written` that are still there, and count them.

    Operators that need such a table return frames that read it: sweep once their results are stored elsewhere.
    """
    todo = sorted(_KEPT)
    for path in todo:
        _delete(spark, path)
    return len(todo)
