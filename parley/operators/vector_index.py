"""Exact nearest neighbours by cosine over vectors stored in cells, most of which a query never reads.

Vectors of length 1 are stored in order of the k-means cell they belong to, and a
small table has each cell's centre, radius and size. A vector of a cell is at
least |query - centre| - radius away, so cells beyond the k-th best distance hold
nothing nearer: leaving them out loses no neighbour, however the data lie.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import literal

SAMPLE, MOST_CELLS = 16_384, 4_096
#: Rounding of distances between unit vectors stays well below this.
SLACK = 1e-6


def _centres(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means over rows of length 1."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T - (c * c).sum(1) / 2, axis=1)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def build(rows: DataFrame, path: str, *, vec: str = "vec", cells: int | None = None, seed: int = 7) -> None:
    """Store rows with their vectors in cells under path. Centres come from at most SAMPLE vectors, by their hash; every row with a vector of length over 0 is stored."""
    spark = rows.sparkSession
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = rows.withColumn("__norm", norm).where("__norm > 0").withColumn(vec, F.transform(vec, lambda x: x.cast("double") / F.col("__norm"))).drop("__norm")
    n = unit.count()
    turn, parts = F.pmod(F.xxhash64(vec), F.lit(1 << 30)), 1 << 30
    near = unit if n <= 2 * SAMPLE else unit.where(turn < int(parts * 1.2 * SAMPLE / n))  # so no task sends a full sample of its own
    sample = near.select(vec).orderBy(turn, vec).limit(SAMPLE).toPandas()[vec]
    x = np.stack(sample) if n else np.zeros((1, 1))
    centres = _centres(x, min(len(x), cells or max(1, min(MOST_CELLS, int(n**0.5)))), seed)
    carried = [f for f in unit.schema.fields]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried) + ", cell int, far double"

    def assign(batches):
        for pdf in batches:
            own, far = [], []
            for at in range(0, len(pdf), 1024):
                v = np.stack(pdf[vec].iloc[at : at + 1024])
                k = np.argmax(v @ centres.T - (centres * centres).sum(1) / 2, axis=1)
                own.append(k), far.append(np.linalg.norm(v - centres[k], axis=1))
            if own:
                yield pdf.assign(cell=np.concatenate(own), far=np.concatenate(far))

    placed = unit.mapInPandas(assign, types)
    placed.repartitionByRange("cell", F.xxhash64(vec)).sortWithinPartitions("cell").write.parquet(f"{path}/vectors")
    sizes = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    middle = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")  # MOST_CELLS rows at most
    sizes.join(F.broadcast(middle), "cell").coalesce(1).write.parquet(f"{path}/cells")


def _reach(cells: pd.DataFrame, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each cell's centre, and the least that any of its vectors can have."""
    away = np.linalg.norm(np.stack(cells["centre"]) - query, axis=1)
    return away, np.maximum(0, away - cells["radius"].to_numpy())


def cells_to_read(cells: pd.DataFrame, query: np.ndarray, k: int, kth: float | None = None) -> list[int]:
    """Cells of the nearest centres that hold k vectors together; with the k-th distance known, all that may hold a nearer one."""
    away, least = _reach(cells, query)
    if kth is not None:
        return cells["cell"].to_numpy()[least <= kth + SLACK].tolist()
    order = np.argsort(away, kind="stable")
    enough = np.searchsorted(np.cumsum(cells["n"].to_numpy()[order]), k) + 1
    return cells["cell"].to_numpy()[order[:enough]].tolist()


def nearest(spark: SparkSession, path: str, query, k: int, *ties: str, vec: str = "vec") -> DataFrame:
    """The k nearest stored rows with their cosine distance (dist), in order; all of them where fewer are stored."""
    cells = spark.read.parquet(f"{path}/cells").toPandas()  # MOST_CELLS rows at most
    q = np.asarray(query, np.float64)
    stored = spark.read.parquet(f"{path}/vectors")
    if not len(cells) or not np.linalg.norm(q) > 0:
        return stored.limit(0).withColumn("dist", F.lit(0.0)).drop("cell", "far")
    q = q / np.linalg.norm(q)
    dist = 1 - F.aggregate(F.zip_with(vec, literal(q), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    among = lambda wanted: stored.where(F.col("cell").isin(wanted)).withColumn("dist", dist).orderBy("dist", *ties).limit(k)
    first = among(cells_to_read(cells, q, k)).agg(F.max("dist").alias("kth"), F.count("*").alias("n")).first()
    kth = None if first["n"] < k else float(np.sqrt(max(0.0, 2 * first["kth"])))
    wanted = cells["cell"].tolist() if kth is None else cells_to_read(cells, q, k, kth)
    return among(wanted).drop("cell", "far")
