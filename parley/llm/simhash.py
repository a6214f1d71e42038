"""SimHash near-duplicate groups by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import by_place, place, restored
from .components import distributed_roots, local_roots
from .scratch import Scratch

SHINGLE = 3
RADIUS = 3
TILE = 4096
#: Quarters of a fingerprint have 0 to 16 bits set, so there are 17**4 cells at most, whatever the input.
SIDE, QUARTERS = 17, 4
CHUNK = 1 << 16
MAX_TILES = 4096
FEW_PAIRS = 200_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits over the XXH64 (seed 42) of each word shingle, repeats included; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, and split at \x20\x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    a, z = first[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(a), CHUNK):
        h = np.array([digest(line[x:y], 42) for x, y in zip(a[at : at + CHUNK], z[at : at + CHUNK])], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(a), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
        found = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], ["doc_id", "fp", "h"])


def _cell(fp) -> F.Column:
    cell = F.lit(0)
    for k in range(QUARTERS):
        cell = cell * SIDE + F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)))
    return cell.cast("int")


def plan_tiles(counts: dict[int, int], tile: int) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Cells in order of their population counts -> (cell, first tile, tiles) rows, and the least and greatest population counts of each tile."""
    cells, boxes, room = [], [], 0
    for cell in sorted(counts):
        n, rest, p = counts[cell], cell, []
        for _ in range(QUARTERS):
            rest, digit = divmod(rest, SIDE)
            p.append(digit)
        if n > tile:
            cells.append((cell, len(boxes), -(-n // tile)))
            boxes += [[p, p]] * (-(-n // tile))
            room = 0
        else:
            if n > room:
                boxes.append([p, p])
                room = tile
            boxes[-1] = [list(map(min, boxes[-1][0], p)), list(map(max, boxes[-1][1], p))]
            cells.append((cell, len(boxes) - 1, 1))
            room -= n
    low, high = (np.array([b[k] for b in boxes], np.int32).reshape(-1, QUARTERS) for k in (0, 1))
    return cells, low, high


def near_tiles(a: int, low: np.ndarray, high: np.ndarray, radius: int) -> np.ndarray:
    """Later tiles to compare tile a with.

    A tile is skipped if the population counts of all its rows are further from
    those of a than the radius: then so are the fingerprints.
    """
    gap = np.maximum(0, np.maximum(low[a] - high[a + 1 :], low[a + 1 :] - high[a])).sum(axis=1)
    return np.flatnonzero(gap <= radius) + a + 1


def _pairs(low: np.ndarray, high: np.ndarray, radius: int):
    """Tile numbers -> a row per pair to compare; the boxes are a few numbers for each of some thousand tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column(0).to_pylist():
                b = near_tiles(a, low, high, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a * len(low) + b, pa.int64()), pa.array(np.full(len(b), a, np.int32)), pa.array(b, pa.int32())], ["pair", "a", "b"])

    return run


def inner_roots(a: np.ndarray, radius: int) -> np.ndarray:
    """Index of each fingerprint's root under the links within one tile."""
    root = np.arange(len(a))
    for at in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(a[at : at + 256, None] ^ a[None, :]) <= radius)
        root = local_roots(len(a), i + at, j, root)
    return root


def cross_links(a: np.ndarray, b: np.ndarray, roots_a: np.ndarray, roots_b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles as a spanning forest over the tiles' own roots: (fingerprint, root fingerprint). Exact."""
    both, shift = np.concatenate((a, b)), len(a)
    root = np.arange(len(both))
    for at in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= radius)
        if len(i):
            root = local_roots(len(both), roots_a[i + at], roots_b[j] + shift, root)
    moved = np.flatnonzero(root != np.arange(len(both)))
    return both[moved], both[root[moved]]


def _within(radius: int):
    """(tile, fingerprints) -> the same with the root of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                fps = np.sort(batch.column(1)[k].values.to_numpy(zero_copy_only=False))
                root = inner_roots(fps.view(np.uint64), radius).astype(np.int32)
                one = [pa.array([0, len(fps)], pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), pa.ListArray.from_arrays(*one, pa.array(fps)), pa.ListArray.from_arrays(*one, pa.array(root))], ["tile", "fps", "roots"]
                )

    return run


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, rx, y, ry = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(4))
                src, dst = cross_links(x.view(np.uint64), y.view(np.uint64), rx, ry, radius)
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], ["src", "dst"])

    return run


def _components(fps: DataFrame, scratch: Scratch, radius: int, tile: int) -> DataFrame:
    """(doc_id, fp) -> (fp, root, component_id) of every distinct fingerprint."""
    spark = fps.sparkSession
    reps = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).withColumn("cell", _cell(F.col("fp"))), "distinct")
    counts = {r["cell"]: r["count"] for r in reps.groupBy("cell").count().collect()}  # 17**4 rows at most
    size = max(tile, -(-sum(counts.values()) // MAX_TILES))
    cells, low, high = plan_tiles(counts, size)
    cell_map = spark.createDataFrame(cells, "cell int, first int, n int")  # 17**4 rows at most, so it may be broadcast
    pairs = scratch.keep(spark.range(len(low)).mapInArrow(_pairs(low, high, radius), "pair long, a int, b int"), "pairs")
    few = pairs.count() <= FEW_PAIRS  # checked; more are shuffled
    pairs = F.broadcast(pairs) if few else pairs
    dealt = (
        reps.join(F.broadcast(cell_map), "cell")
        .select((F.col("first") + F.pmod(F.xxhash64("fp"), F.col("n"))).cast("int").alias("tile"), "fp")
        .groupBy("tile")
        .agg(F.collect_list("fp").alias("fps"))
    )
    # a group of near copies is one root in each tile that it reaches, so few links leave the tiles
    tiles = scratch.keep(dealt.mapInArrow(_within(radius), "tile int, fps array<long>, roots array<int>"), "tiles")
    left = tiles.join(pairs, F.col("tile") == F.col("a")).select("pair", F.col("fps").alias("x"), F.col("roots").alias("rx"))
    right = tiles.join(pairs, F.col("tile") == F.col("b")).select("pair", F.col("fps").alias("y"), F.col("roots").alias("ry"))
    links = left.join(right, "pair").select("x", "rx", "y", "ry").mapInArrow(_compare(radius), "src long, dst long")
    across = distributed_roots(links, scratch)
    inner = tiles.select(F.explode(F.arrays_zip("fps", F.transform("roots", lambda r: F.element_at("fps", r + 1)).alias("top"))).alias("e"))
    moved = inner.select(F.col("e")["fps"].alias("fp0"), F.col("e")["top"].alias("top")).where("fp0 <> top")
    inner_root = moved.join(across, F.col("top") == F.col("node"), "left").select(F.col("fp0").alias("node"), F.coalesce("root", "top").alias("root"))
    roots = inner_root.unionByName(across)  # a root of a tile is never moved within it
    grouped = reps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    return scratch.keep(grouped.join(least, "root").select("fp", "root", "component_id"), "components")


def _fingerprints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, fp and h, a hash of the text, of every row."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), _text_hash(text).alias("h"))
    return plain.mapInArrow(_fingerprint_batches, "doc_id long, fp long, h long")


def _text_hash(text: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Every row's doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links).

    Null and empty texts have the fingerprint zero and link like others. Rows
    with a null doc_id keep it and never name a component unless all of it has
    none. Repeated rows each come back. Other columns of docs are not read. An
    empty table gives an empty result.
    Equal fingerprints meet first, so a group of copies is one node; then tiles
    of at most about `tile` distinct fingerprints (more only where over
    MAX_TILES tiles would be needed) are compared exactly.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(_fingerprints(docs, doc_id, text).select("doc_id", "fp"), "fingerprints")
    by_fp = _components(fps, scratch, radius, tile)
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate group, with the columns of docs, which may have any names.

    It is a row of the smallest doc_id; of several, that whose text has the
    smallest hash; of rows alike in both, that whose columns have. Rows with a
    null doc_id stay: they name no group. Rows of one doc_id whose texts are not
    near copies are in groups of their own, and each group keeps a row.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    placed = by_place(docs)
    own_id, own_text = place(docs, doc_id), place(docs, text)
    fps = scratch.keep(_fingerprints(placed, own_id, own_text), "fingerprints")
    by_fp = _components(fps.select("doc_id", "fp"), scratch, RADIUS, TILE)
    named = fps.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "h").agg(F.first("fp").alias("fp"), F.count("*").alias("n"))
    named = scratch.keep(named.join(by_fp.select("fp", "root"), "fp"), "named")
    # one row a group is written, so that the join with it splits a group of very many copies
    best = scratch.keep(named.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("best")), "best")
    rows = scratch.keep(named.join(best, "root").select("doc_id", "h", "n", (F.struct("doc_id", "h") == F.col("best")).alias("stays")), "rows")
    keyed = placed.withColumn("id", F.col(own_id).cast("long")).withColumn("text_hash", _text_hash(own_text))
    on = (F.col("id") == F.col("doc_id")) & (F.col("text_hash") == F.col("h"))
    left = keyed.join(rows.where("NOT stays OR n > 1").select("doc_id", "h"), on, "left_anti")
    again = rows.where("stays AND n > 1").select("doc_id", "h")
    if again.isEmpty():  # then the texts need no second shuffle
        return restored(left, docs)
    whole = F.struct(*placed.columns)
    alike = keyed.join(again, on).groupBy("doc_id", "h").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row")).select("row.*")
    return restored(left.select(*placed.columns).union(alike), docs)
