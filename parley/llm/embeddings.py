"""Embedding near-duplicates through an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import distributed_roots, local_roots
from .scratch import Scratch

THRESHOLD = 0.95
RECALL = 0.995
#: Bounds of what the index is fitted on; every vector is indexed.
SAMPLE = 16_384
TRIALS = 4_096
OWN_LINKS = 8_192
CELL_ROWS = 32
MAX_CODES = 1_024
BLOCK = 2_048
#: Blocks of more cells than this are shuffled to their rows, not broadcast.
FEW_CELLS = 100_000


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision at length 1; scaled first, so that no square overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k-means centres."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class MultiIndex:
    """Two codebooks on vector halves, whose product grid has the cells; and how far a query has to look."""

    first: np.ndarray
    second: np.ndarray
    reach: float

    @staticmethod
    def single(dim: int) -> MultiIndex:
        """One cell for everything."""
        half = max(1, dim // 2)
        return MultiIndex(np.zeros((1, half)), np.zeros((1, dim - half)), 0.0)

    @property
    def split(self) -> int:
        return self.first.shape[1]

    def margins(self, half: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own code, and the distance of each half vector from the border of every code's region."""
        d = (centres**2).sum(1) - 2 * half @ centres.T
        own = np.argmin(d, axis=1)
        apart = np.linalg.norm(centres[own][:, None, :] - centres[None, :, :], axis=2) if len(half) * len(centres) < 1 << 22 else np.sqrt(
            np.maximum(0, (centres**2).sum(1)[own][:, None] + (centres**2).sum(1)[None, :] - 2 * centres[own] @ centres.T)
        )
        gap = (d - d[np.arange(len(d)), own][:, None]) / np.where(apart > 0, 2 * apart, 1)
        return own, np.maximum(0, gap)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a = np.argmin((self.first**2).sum(1) - 2 * x[:, : self.split] @ self.first.T, axis=1)
        b = np.argmin((self.second**2).sum(1) - 2 * x[:, self.split :] @ self.second.T, axis=1)
        return a * len(self.second) + b

    def traverse(self, x: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Own cell of each row, and the cells that multi-sequence traversal visits, nearest first, until `reach`."""
        own_a, far_a = self.margins(x[:, : self.split], self.first)
        own_b, far_b = self.margins(x[:, self.split :], self.second)
        limit, width = self.reach**2, len(self.second)
        far_a, far_b = far_a**2, far_b**2
        for row in range(len(x)):
            ia, ib = np.flatnonzero(far_a[row] <= limit), np.flatnonzero(far_b[row] <= limit)
            ia, ib = ia[np.argsort(far_a[row, ia], kind="stable")], ib[np.argsort(far_b[row, ib], kind="stable")]
            da, db = far_a[row, ia].tolist(), far_b[row, ib].tolist()
            heap, visited = [(da[0] + db[0], 0, 0)], []
            while heap:
                d, i, j = heapq.heappop(heap)
                if d > limit:
                    break
                visited.append(int(ia[i]) * width + int(ib[j]))
                if j + 1 < len(db):
                    heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(da):
                    heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
            yield int(own_a[row]) * width + int(own_b[row]), visited


def fit(sample: np.ndarray, n: int, *, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 3) -> MultiIndex:
    """Codebooks from the sample, and the reach at which the target share of links is visited.

    The share is measured on the hardest links there are, partners in a random
    direction at exactly the threshold, and on the sample's own links. With a
    recall of 1 no link is lost: unit vectors at the threshold are at most
    sqrt(2 - 2 * threshold) apart, and a vector is as far from a cell as from
    its border at least.
    """
    x = unit(sample)
    half = max(1, x.shape[1] // 2)
    k = int(min(MAX_CODES, max(1, np.sqrt(n / CELL_ROWS))))
    index = MultiIndex(codebook(x[:, :half], k, seed), codebook(x[:, half:], k, seed + 1) if half < x.shape[1] else np.zeros((1, 0)), 0.0)
    if recall >= 1:
        index.reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
        return index
    rng = np.random.default_rng(seed + 2)
    u = x[rng.choice(len(x), min(TRIALS, len(x)), replace=False)]
    w = rng.standard_normal(u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    norm = np.linalg.norm(w, axis=1, keepdims=True)
    w = np.where(norm > 1e-9, w / np.maximum(norm, 1e-9), 0)
    v = threshold * u + np.sqrt(1 - threshold**2) * w
    needed = [_needed(index, u, v)]
    own = []
    for at in range(0, len(u), 512):
        i, j = np.nonzero(u[at : at + 512] @ x.T >= threshold)
        some = rng.choice(len(i), min(len(i), OWN_LINKS), replace=False)  # of each slice, so a large group can't fill memory
        own.append(_needed(index, u[at + i[some]], x[j[some]]) if len(some) else np.empty(0))
    if len(own := np.concatenate(own)):
        needed.append(own)
    index.reach = max(float(np.quantile(d, recall)) for d in needed) + 1e-9
    return index


def _needed(index: MultiIndex, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How far u must look to visit v's cell."""
    out = [np.empty(0)]
    width = len(index.second)
    for at in range(0, len(u), 2048):
        a, b = index.margins(u[at : at + 2048, : index.split], index.first)[1], index.margins(u[at : at + 2048, index.split :], index.second)[1]
        cell = index.cells(v[at : at + 2048])
        row = np.arange(len(cell))
        out.append(np.sqrt(a[row, cell // width] ** 2 + b[row, cell % width] ** 2))
    return np.concatenate(out)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _route(indexes: dict[int, MultiIndex]):
    """(uid, mult, vector) -> a row for the own cell (probe false) and for each later cell that traversal visits (probe true).

    Vectors of each length have cells of their own; a length without an index is one cell.
    """
    singles: dict[int, MultiIndex] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                index = indexes.get(dim) or singles.setdefault(dim, MultiIndex.single(dim))
                alike = batch if (dims == dim).all() else batch.take(pa.array(np.flatnonzero(dims == dim)))
                for at in range(0, alike.num_rows, 1024):
                    part = alike.slice(at, 1024)
                    which, cells, probes = [], [], []
                    for row, (own, visited) in enumerate(index.traverse(unit(_matrix(part.column(2))))):
                        later = [c for c in visited if c > own]
                        which += [row] * (1 + len(later))
                        cells += [own, *later]
                        probes += [False] + [True] * len(later)
                    at_rows = pa.array(which, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(cells, np.int64) + dim * MAX_CODES**2), pa.array(probes), *(part.column(k).take(at_rows) for k in range(3))],
                        ["cell", "probe", "uid", "mult", "vector"],
                    )

    return run


def _sampled(vectors: DataFrame, n: int) -> np.ndarray:
    """At most SAMPLE of n vectors of one length, by their hash."""
    turn, parts = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)), 1 << 30
    near = vectors if n <= 2 * SAMPLE else vectors.where(turn < int(parts * 1.2 * SAMPLE / n))  # so no task sends a full sample of its own
    return _matrix(near.orderBy(turn, "vector").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks())


def verify(left: np.ndarray, right: np.ndarray, left_mult: np.ndarray, right_mult: np.ndarray, same: bool, threshold: float):
    """Exact links of two blocks: how many vectors each row links to, and a spanning forest of roots (indexes into left then right)."""
    n, m = len(left), len(right)
    counts_l, counts_r = np.zeros(n, np.int64), np.zeros(m, np.int64)
    root, shift = np.arange(n if same else n + m), 0 if same else n
    for at in range(0, n, 512):
        near = left[at : at + 512] @ right.T >= threshold
        if same:
            near &= np.arange(at, at + len(near))[:, None] < np.arange(m)[None, :]
        if near.any():
            counts_l[at : at + 512] += near @ right_mult
            counts_r += left_mult[at : at + 512] @ near
            i, j = np.nonzero(near)
            root = local_roots(len(root), i + at, j + shift, root)
    return (counts_l + counts_r if same else np.concatenate((counts_l, counts_r))), root


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table["right"].to_numpy(zero_copy_only=False)
        uid, mult = table["uid"].to_numpy(), table["mult"].to_numpy()
        x = unit(_matrix(table["vector"].combine_chunks()))
        same = bool(table["same"][0].as_py())
        left, right = (np.arange(len(uid)), np.arange(len(uid))) if same else (np.flatnonzero(~side), np.flatnonzero(side))
        links, root = verify(x[left], x[right], mult[left], mult[right], same, threshold)
        order = left if same else np.concatenate((left, right))
        hit = np.flatnonzero(links)
        return pa.table({"uid": uid[order[hit]], "links": links[hit], "root": uid[order[root[hit]]]})

    return run


def near_duplicates(
    table: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """Per row: vec_id, n_links (other vectors at a cosine of `threshold` or more), component_id, kept.

    Traversal goes on until the share `recall` of the hardest links is visited;
    a recall of 1 finds every link. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing and stay alone, as do rows
    with a null vec_id (component_id null, kept false). Vectors link with those
    of their own length only; every length is indexed, one of at most BLOCK
    vectors as one cell, which loses no link. Equal vectors meet first and count
    as one with a multiplicity. Repeated rows, and rows that repeat a vec_id
    with another vector, count as vectors. An empty table gives an empty result.
    Each pair is looked for from the lower cell to the higher; cells with many
    vectors are cut into blocks that are compared block by block, so none is
    dropped and no task holds a whole cell.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("vector", lambda v: v != 0), F.lit(False))
    distinct = rows.where(good).groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    distinct = scratch.keep(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct")
    lengths = distinct.groupBy(F.size("vector").alias("d")).count().where(F.col("count") > BLOCK).collect()  # lengths in common use: a row a model
    indexes = {r["d"]: fit(_sampled(distinct.where(F.size("vector") == r["d"]), r["count"]), r["count"], threshold=threshold, recall=recall) for r in lengths}
    vector = distinct.schema["vector"].dataType.simpleString()
    routed = distinct.select("uid", "mult", "vector").mapInArrow(_route(indexes), f"cell long, probe boolean, uid long, mult long, vector {vector}")
    blocks = _blocks(scratch.keep(routed, "cells"), scratch)
    found = scratch.keep(blocks.groupBy("cell", "same", "a", "b").applyInArrow(_compare(threshold), "uid long, links long, root long"), "links")
    # a vector has a root in every comparison it links in; those few roots stand for all that they gather
    per = scratch.keep(found.groupBy("uid").agg(F.sum("links").alias("links"), F.collect_set("root").alias("roots")).withColumn("hub", F.array_min("roots")), "roots")
    across = distributed_roots(per.select(F.explode("roots").alias("src"), F.col("hub").alias("dst")), scratch)
    linked = per.join(across, F.col("hub") == F.col("node"), "left").select("uid", "links", F.coalesce("root", "hub").alias("root"))
    nodes = distinct.join(linked, "uid", "left").select("uid", "least", "mult", "vector", "links", F.coalesce("root", "uid").alias("root"))
    least = scratch.keep(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    full = nodes.join(least, "root").select(
        F.col("vector").alias("v"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    named = rows.withColumn("key", F.when(good, F.col("vector"))).drop("vector")
    out = named.join(full, F.col("key") == F.col("v"), "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


def _blocks(routed: DataFrame, scratch: Scratch) -> DataFrame:
    """Deal each cell's members and probes into blocks, and send every block to all comparisons it takes part in.

    A cell's members are compared with one another (same: a block with itself;
    else blocks a < b), and its probes with its members (a below 0: probes).
    """
    counts = routed.groupBy("cell").agg(F.sum(F.col("probe").cast("long")).alias("p"), F.sum((~F.col("probe")).cast("long")).alias("m"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    hot = scratch.keep(counts.where((F.col("p") > BLOCK) | (F.col("m") > BLOCK)).select("cell", blocks("p").alias("np"), blocks("m").alias("nm")), "hot")
    few = hot.count() <= FEW_CELLS  # checked; more are shuffled
    dealt = routed.join(F.broadcast(hot) if few else hot, "cell", "left").na.fill({"np": 1, "nm": 1})
    turn = lambda n: F.pmod(F.xxhash64(F.lit(5), "uid"), F.col(n)).cast("int")
    item = lambda same, a, b, right: F.struct(same.alias("same"), a.cast("int").alias("a"), b.cast("int").alias("b"), right.alias("right"))
    yes, no = F.lit(True), F.lit(False)
    own = dealt.where(~F.col("probe")).withColumn("k", turn("nm"))
    own = own.withColumn("to", F.concat(
        F.array(item(yes, F.col("k"), F.col("k"), no)),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("nm") - 1), lambda j: j > F.col("k")), lambda j: item(no, F.col("k"), j, no)),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("nm") - 1), lambda j: j < F.col("k")), lambda j: item(no, j, F.col("k"), yes)),
        F.transform(F.sequence(F.lit(1), F.col("np")), lambda j: item(no, -j, F.col("k"), yes)),
    ))
    probes = dealt.where("probe").withColumn("k", turn("np"))
    probes = probes.withColumn("to", F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda j: item(no, -F.col("k") - 1, j, no)))
    both = own.unionByName(probes).select("cell", "uid", "mult", "vector", F.explode("to").alias("to"))
    return both.select("cell", "to.same", "to.a", "to.b", "to.right", "uid", "mult", "vector")
