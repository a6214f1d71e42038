"""Derived tables that many queries read, written once per session in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple[str, str], tuple[SparkSession, str]] = {}
_temporary: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder that its context was given.

    Where both are unset a temporary folder serves a local master, whose
    executor is the driver's own process; on a cluster that is an error, as
    other machines couldn't read what was written.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="parley-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def temporary(spark: SparkSession, name: str) -> str:
    """The path of a fresh folder among the shared ones, which is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/parley-{name}-{uuid.uuid4().hex}"
    _temporary.append((spark, path))
    return path


def stored(spark: SparkSession, name: str, made: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name: written when first asked for, read from then on until the driver ends or `forget` is called."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _written:
        path = temporary(spark, "stored")
        made().write.option("compression", "zstd").parquet(path)
        _written[key] = (spark, path)
    return spark.read.parquet(_written[key][1])


def forget(spark: SparkSession, name: str | None = None) -> None:
    """Delete stored tables of the session, so that they are made anew."""
    for key in [k for k in _written if k[0] == spark.sparkContext.applicationId and name in (None, k[1])]:
        delete(*_written.pop(key))


def _at_exit() -> None:
    for spark, path in _temporary:
        if spark._sc is not None and spark._sc._jsc is not None:
            delete(spark, path)


atexit.register(_at_exit)
