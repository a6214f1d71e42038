"""All pairs of vectors: a block of one side stays in its task, the other side streams past it, so neither has to fit in a task or a broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TILE, PIECE, PAIRS = 512, 4096, 65_536
#: What a float32 product of two unit vectors may be off by; scores this near a bound are worked out in float64.
SLACK = 1e-5


def matrix(batch: pa.Table, column: str = "vec") -> np.ndarray:
    flat = batch[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(batch), -1)


def numbers(batch: pa.Table, column: str) -> np.ndarray:
    return batch[column].combine_chunks().to_numpy(zero_copy_only=False)


def streamed(dealt: DataFrame, keys: list[str], kernel: Callable[[tuple, pa.Table], object], schema: str) -> DataFrame:
    """dealt (keys, side 0 or 1, ...) in partitions that hold each key whole, to what the kernels of its keys yield.

    kernel(key, rows of side 0) has add(rows of side 1) and done(), which yield
    record batches; a key without one of its sides yields nothing.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, state = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            columns = [numbers(table, c) for c in (*keys, "side")]
            new = np.zeros(len(table), bool)
            new[:1] = True
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            for at, end in zip(starts, [*starts[1:], len(table)]):
                key, piece = tuple(c[at] for c in columns[:-1]), table.slice(at, end - at)
                if key != current:
                    if state is not None:
                        yield from state.done()
                    current, held, state = key, [], None
                if columns[-1][at] == 0:
                    held.append(piece)
                elif held or state is not None:
                    if state is None:
                        state, held = kernel(key, pa.concat_tables(held)), []
                    yield from state.add(piece)
        if state is not None:
            yield from state.done()

    return dealt.sortWithinPartitions(*keys, "side").mapInArrow(walk, schema)


def pieces(n: int, seen: int) -> Iterator[tuple[int, int]]:
    """Ranges of n rows that double with what was seen before, so that few rows of a range pass the bounds that the earlier ones set."""
    at = 0
    while at < n:
        end = min(n, at + min(PIECE, max(256, seen + at)))
        yield at, end
        at = end


def exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows i of x and j of y."""
    cuts = range(0, len(i), PAIRS)
    return np.concatenate([np.einsum("ij,ij->i", x[i[k : k + PAIRS]], y[j[k : k + PAIRS]]) for k in cuts]) if len(i) else np.empty(0)


class TopMean:
    """The mean of each row's `top` highest products with rows that stream by; those of its own film count as -1."""

    def __init__(self, rows: pa.Table, top: int):
        self.rows, self.films, self.x = rows.select(["movie_id", "idx"]), numbers(rows, "movie_id"), matrix(rows)
        self.narrow, self.length = self.x.astype(np.float32), np.linalg.norm(self.x, axis=1)
        self.best, self.seen = np.full((len(rows), top), -np.inf), 0

    def add(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        films, y = numbers(rows, "movie_id"), matrix(rows)
        narrow, longest = y.astype(np.float32), np.linalg.norm(y, axis=1).max()
        for at, end in pieces(len(y), self.seen):
            for k in range(0, len(self.x), TILE):
                own = self.films[k : k + TILE, None] == films[None, at:end]
                near = self.narrow[k : k + TILE] @ narrow[at:end].T
                np.copyto(near, np.float32(-1), where=own)
                bound = self.best[k : k + TILE].min(axis=1)
                i, j = np.nonzero(near > (bound - SLACK * np.maximum(1, self.length[k : k + TILE] * longest))[:, None])
                value = exact(self.x[k : k + TILE], y[at:end], i, j)
                value[own[i, j]] = -1.0
                kept = value > bound[i]
                self._keep(k, i[kept], value[kept])
        self.seen += len(y)
        return iter(())

    def _keep(self, base: int, i: np.ndarray, value: np.ndarray) -> None:
        if not len(i):
            return
        rows, first, count = np.unique(i, return_index=True, return_counts=True)
        fresh = np.full((len(rows), count.max()), -np.inf)
        fresh[np.repeat(np.arange(len(rows)), count), np.arange(len(i)) - np.repeat(first, count)] = value
        both = np.concatenate((self.best[base + rows], fresh), axis=1)
        self.best[base + rows] = np.partition(both, count.max(), axis=1)[:, count.max() :]

    def done(self) -> Iterator[pa.RecordBatch]:
        yield from self.rows.append_column("raw", pa.array(self.best.mean(axis=1))).combine_chunks().to_batches()


class Crossed:
    """Scores of a block of one film's windows with another film's, which stream by.

    Those of that contrast to the windows' means and of that strength are
    yielded at once, or with `most` each window's highest ones at the end; with
    `summed` there is one row, the highest score of all.
    """

    def __init__(self, key: tuple, names: list[str], rows: pa.Table, penalty: float, contrast: float | None, strength: float | None, most: int | None, summed: bool):
        self.key, self.names, self.penalty, self.contrast, self.strength, self.most, self.summed = key, names, penalty, contrast, strength, most, summed
        self.idx, self.x, self.mean = numbers(rows, "idx"), matrix(rows), numbers(rows, "mean")
        self.half, self.ambient = penalty * numbers(rows, "generic") / 2, float(rows["ambient"][0].as_py())
        self.highest, self.seen, self.kept = -np.inf, 0, None
        self.bound = np.full(len(rows), -np.inf)

    def add(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        idx, y, mean, half = numbers(rows, "idx"), matrix(rows), numbers(rows, "mean"), self.penalty * numbers(rows, "generic") / 2
        for at, end in pieces(len(y), self.seen):
            for k in range(0, len(self.x), TILE):
                score = self.x[k : k + TILE] @ y[at:end].T - (self.half[k : k + TILE, None] + half[None, at:end])
                if self.summed:
                    self.highest = max(self.highest, float(score.max()))
                    continue
                wanted = score >= (self.bound[k : k + TILE, None] if self.strength is None else np.maximum(self.bound[k : k + TILE, None], self.strength))
                if self.contrast is not None:
                    wanted &= score - (self.mean[k : k + TILE, None] + mean[None, at:end]) / 2 >= self.contrast
                i, j = np.nonzero(wanted)
                if not len(i):
                    continue
                found = (i + k, idx[at + j], score[i, j], mean[at + j])
                if self.most is None:
                    yield from self._batch(*found)
                else:
                    self._keep(*found)
        self.seen += len(y)

    def _keep(self, i: np.ndarray, ib: np.ndarray, score: np.ndarray, mean: np.ndarray) -> None:
        """The `most` highest of each window, as rounded scores and then ib order them."""
        own = np.isin(self.kept[0], np.unique(i)) if self.kept is not None else np.zeros(0, bool)
        rest = [c[~own] for c in self.kept] if self.kept is not None else None
        i, ib, score, mean = (np.concatenate((old[own], new)) for old, new in zip(self.kept, (i, ib, score, mean))) if self.kept is not None else (i, ib, score, mean)
        place = np.lexsort((ib, -np.round(score, 9), i))
        i, ib, score, mean = i[place], ib[place], score[place], mean[place]
        rows, first, count = np.unique(i, return_index=True, return_counts=True)
        n = np.arange(len(i)) - np.repeat(first, count)
        full = count >= self.most
        # scores that round to the same stay in, so that ib decides
        self.bound[rows[full]] = score[first[full] + self.most - 1] - 2e-9
        best = n < self.most
        fresh = [c[best] for c in (i, ib, score, mean)]
        self.kept = fresh if rest is None else [np.concatenate(c) for c in zip(rest, fresh)]

    def _batch(self, i: np.ndarray, ib: np.ndarray, score: np.ndarray, mean: np.ndarray) -> Iterator[pa.RecordBatch]:
        made = {n: np.full(len(i), k) for n, k in zip(self.names, self.key)}
        made |= {"ia": self.idx[i], "ib": ib, "score": score, "mean_a": self.mean[i], "mean_b": mean, "ambient": np.full(len(i), self.ambient)}
        yield pa.RecordBatch.from_pydict(made)

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.summed:
            yield pa.RecordBatch.from_pydict({**{n: [k] for n, k in zip(self.names, self.key)}, "best": [self.highest]})
        elif self.kept is not None:
            yield from self._batch(*self.kept)
