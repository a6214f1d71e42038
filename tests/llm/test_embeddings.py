from collections import Counter

import numpy as np
import pytest

from parley.llm import embeddings


def brute(ids, x):
    u = embeddings.unit(np.array(x, np.float64))
    return {(a, b) for i, a in enumerate(ids) for b, near in zip(ids[:i], u[i] @ u[:i].T >= 0.95) if near}


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def planted(spark, sf):
    """The real vectors, and near copies of many of them: 64 components, several cells, cosines from 0.94 up, some in chains."""
    rng = np.random.default_rng(8)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = embeddings.unit(np.array([e for _, e in rows]))
    at = rng.choice(len(x), 2500, replace=len(x) < 2500)
    noise = rng.standard_normal((len(at), x.shape[1]))
    noise -= (noise * x[at]).sum(1, keepdims=True) * x[at]
    cosine = rng.uniform(0.94, 1, len(at))[:, None]
    near = cosine * x[at] + np.sqrt(1 - cosine**2) * embeddings.unit(noise)
    return rows + [(100_000 + k, v.astype(np.float32).tolist()) for k, v in enumerate(near)]


@pytest.mark.parametrize("recall", [0.995, 1.0])
def test_recall_on_whole_table(spark, sf, recall):
    rows = planted(spark, sf.replace("0.01", "0.1"))
    ids = [i for i, _ in rows]
    links = brute(ids, [e for _, e in rows])
    assert len(links) > 2000
    wanted, label = Counter(x for pair in links for x in pair), components(ids, links)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), recall=recall).collect()
    assert sorted(r.vec_id for r in got) == sorted(ids)
    assert all(r.n_links <= wanted[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= (0.99 if recall < 1 else 1) * sum(wanted.values())
    right = sum(r.component_id == label[r.vec_id] for r in got)
    assert right >= (0.97 if recall < 1 else 1) * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_the_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.collect()
    wanted = Counter(x for pair in brute([r.vec_id for r in rows], [r.embedding for r in rows]) for x in pair)
    got = embeddings.near_duplicates(table).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == sorted((r.vec_id, wanted[r.vec_id]) for r in rows)


def test_every_length_links(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, wanted = [], {}
    for dim, n in ((1, 3), (2, 40), (3, 90), (9, 60), (8, 300)):
        x = rng.standard_normal((n, dim))
        x[n // 2 :] = x[: n - n // 2] + 0.05 * rng.standard_normal((n - n // 2, dim))
        ids = list(range(len(rows), len(rows) + n))
        rows += [(i, v.tolist()) for i, v in zip(ids, x)]
        links = brute(ids, x)
        assert links
        counts, label = Counter(i for pair in links for i in pair), components(ids, links)
        wanted |= {i: (counts[i], label[i]) for i in ids}
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (2048, 32):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        monkeypatch.setattr(embeddings, "FEW_CELLS", block - 33)
        got = embeddings.near_duplicates(table, recall=1.0).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == wanted


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (3, [1.0, 0.0, 0.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True)] * 3 + [(2, 1, 1, False), (3, 0, 3, True)]


@pytest.mark.parametrize("block", [2048, 16])
def test_hot_cells_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(0)
    centre = rng.standard_normal(8)
    hot = centre + 0.02 * rng.standard_normal((90, 8))
    loose = rng.standard_normal((120, 8))
    x = np.concatenate((hot, hot[:1].repeat(30, 0), loose, loose[:20] + 0.05)).astype(np.float32)
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] + [1.0] * 7, 0), (903, [None] + [1.0] * 7, 0), (904, [1.0, 2.0], 0), (905, [], 0)]  # 904 alone has two components
    odd += [(None, x[0].tolist(), 1), (906, [float("inf")] + [0.0] * 7, 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, kept int")
    ids = [r[0] for r in rows]
    links = brute(ids, x)
    wanted, label = Counter(i for pair in links for i in pair), components(ids, links)
    got = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    assert len(got) == len(rows) + len(odd)
    assert sum(got[i].n_links for i in ids) >= 0.97 * sum(wanted.values())
    for i in ids[:120]:
        assert got[i].n_links == wanted[i] and got[i].component_id == label[i]
    for i in (900, 901, 902, 903, 904, 905, 906):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)


def test_traversal_visits_nearest_first():
    rng = np.random.default_rng(1)
    x = embeddings.unit(rng.standard_normal((400, 8)))
    index = embeddings.fit(x, 3200)
    a, b = index.margins(x[:, :4], index.first)[1], index.margins(x[:, 4:], index.second)[1]
    for row, (own, visited) in enumerate(index.traverse(x[:50])):
        d = [a[row, c // len(index.second)] ** 2 + b[row, c % len(index.second)] ** 2 for c in visited]
        assert d == sorted(d) and own in visited and len(set(visited)) == len(visited)
        every = a[row][:, None] ** 2 + b[row][None, :] ** 2 <= index.reach**2
        assert every.sum() == len(visited)


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
