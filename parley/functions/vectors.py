"""Vector functions: native Columns for one query vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def mean_rows(df: DataFrame, keys: list[str], vec: str = "vec", *others: str) -> DataFrame:
    """Of each group (keys) the number of rows, the mean vector, and the means of other columns; by position with partial aggregation."""
    each = df.select(*keys, *others, F.posexplode(vec).alias("pos", "x")).groupBy(*keys, "pos").agg(
        F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"), *(F.avg(c).alias(c) for c in others)
    )
    first = (F.min_by(c, "pos").alias(c) for c in ("n", *others))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias(vec), *first)


def mean_vectors(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Unit mean of each group's vectors (keys, vec): sums by position with partial aggregation, never a whole group in one row list."""
    sums = df.select(*keys, F.posexplode(vec).alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("e"))
    total = F.transform("e", lambda e: e["s"])
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, e: a + e["s"] * e["s"]))
    return packed.select(*keys, F.transform(total, lambda x: x / F.when(length == 0, F.lit(1.0)).otherwise(length)).alias("vec"))
