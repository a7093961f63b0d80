"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which is read from the session.

    Only a local session without that setting (tests) gets a folder of its own; a cluster without it is refused, as
    machine-local folders are not shared there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local_base()
    path = f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


#: Folders that this driver has made and not removed.
_MADE: list[str] = []


@functools.cache
def _local_base() -> str:
    import atexit

    path = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once and read back: its rows are the same for all that use it, and survive executors.  The path is for
    ``drop`` when nothing will read the table again."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``stored`` for a table that the result is read from; ``clean`` removes it."""
    return stored(df, name)[0]


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes tables in the shared folder that nothing will read again."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in _MADE:
            _MADE.remove(path)


def clean(spark: SparkSession) -> None:
    """Removes all intermediate tables of this driver; results that are read from them must have been written before."""
    drop(spark, *list(_MADE))
