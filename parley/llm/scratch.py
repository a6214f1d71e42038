"""Written intermediate tables in the folder that the cluster shares.

A table written here cuts the lineage once, is read back by every consumer, and
survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.stored import delete, shared_folder

_made: list[tuple[SparkSession, str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, the tables that operators called inside have written.

    For long-lived drivers: write or count an operator's result inside.
    """
    before = len(_made)
    try:
        yield
    finally:
        for made_by, folder in _made[before:]:
            delete(made_by, folder)
        del _made[before:]


class Scratch:
    """Tables of one operator call, under one folder of their own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/parley-{label}-{uuid.uuid4().hex}"
        self.count = 0
        _made.append((spark, self.folder))

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df once and return a reader of what was written."""
        self.count += 1
        path = f"{self.folder}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._parley_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        delete(self.spark, df._parley_path)


def _at_exit() -> None:
    for spark, folder in _made:
        if spark._sc is not None and spark._sc._jsc is not None:
            delete(spark, folder)


atexit.register(_at_exit)
