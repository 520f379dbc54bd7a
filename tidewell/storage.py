"""Tables that outlive an executor.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, the folder the cluster
shares between driver and executors. Only where that setting is absent in local mode (unit
tests, a notebook) a folder of our own is used; a cluster without it is an error, since a
folder of one machine would lose rows. All tables of an application lie in one folder, which
is deleted when its driver ends; :func:`scratch` deletes sooner.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT = "/tmp/checkpoints"
_marked: set[str] = set()
_open: ContextVar[list | None] = ContextVar("scratch", default=None)


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) as Hadoop resolves them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme; one without goes to the cluster's default file system, as Spark has it."""
    files, hadoop = _hadoop(spark, path)
    return files.makeQualified(hadoop).toString()


def shared_root(spark: SparkSession) -> str:
    """URI of this application's folder for intermediate tables, read from the session."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        master = conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = f"file:{_LOCAL_ROOT}"
    return qualified(spark, f"{root.rstrip('/')}/tidewell/{spark.sparkContext.applicationId}")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared root; the folder itself is not created."""
    root = shared_root(spark)
    if root not in _marked:
        files, hadoop = _hadoop(spark, root)
        files.mkdirs(hadoop)
        files.deleteOnExit(hadoop)
        _marked.add(root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written.

    The schema travels along, so a table of no rows reads back as such.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _open.get() is not None:
        _open.get().append(out)
    return out


def hold(df: DataFrame) -> DataFrame:
    """Keep a small table that several plans read on the executors; what is lost with one is computed again.

    For tables a step away from a materialized one; :func:`release` lets go of them.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def release(*tables: DataFrame) -> None:
    """Delete materialized tables, and let go of held ones, that no later plan reads."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            delete(table.sparkSession, path)
        elif table.is_cached:
            table.unpersist()


@contextmanager
def scratch() -> Iterator[None]:
    """Tables materialized inside are deleted at the end; what is returned must not read them."""
    made: list[DataFrame] = []
    token = _open.set(made)
    try:
        yield
    finally:
        _open.reset(token)
        release(*made)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file systems, whatever its scheme."""
    files, hadoop = _hadoop(spark, path)
    files.delete(hadoop, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    files, hadoop = _hadoop(spark, path)
    if not files.rename(hadoop, _hadoop(spark, to)[1]):
        raise OSError(f"{path} could not be renamed")


def exists(spark: SparkSession, path: str) -> bool:
    files, hadoop = _hadoop(spark, path)
    return files.exists(hadoop)


def sliced(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """Arrow batches, which Spark bounds by bytes, in frames of at most ``rows`` rows; no setting of the session changes."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]

