import numpy as np
import pytest

from parley.operators import vector_index


def brute(ids, x, q, k):
    d = 1 - (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
    return sorted(zip(np.round(d, 9), ids))[:k]


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Forty tight clusters of uneven sizes, one with a third of all rows; copies, and rows without a direction."""
    rng = np.random.default_rng(2)
    middle = rng.standard_normal((40, 16))
    own = np.concatenate((np.zeros(700, int), rng.integers(0, 40, 1400)))
    x = middle[own] + 0.05 * rng.standard_normal((len(own), 16))
    x[:50] = x[0]
    rows = [(int(k), v.tolist(), "t") for k, v in enumerate(x)]
    path = str(tmp_path_factory.mktemp("index"))
    vector_index.build(spark.createDataFrame([*rows, (9000, [0.0] * 16, "zero"), (9001, None, "none")], "id long, vec array<double>, note string"), path)
    return path, np.arange(len(x)), x


@pytest.mark.parametrize("k", [1, 10, 60, 5000])
def test_equals_brute_force(spark, clustered, k):
    path, ids, x = clustered
    rng = np.random.default_rng(k)
    for q in (x[0], x[1000] * 3, rng.standard_normal(16)):
        got = vector_index.nearest(spark, path, q, k, "id").collect()
        want = brute(ids, x, q, k)
        assert [r.dist for r in got] == pytest.approx([float(d) for d, _ in want], abs=1e-8)
        assert sorted(r.id for r in got if r.dist < want[-1][0] - 1e-6) == sorted(i for d, i in want if d < want[-1][0] - 1e-6)


def test_most_cells_are_not_read(spark, clustered):
    path, _, x = clustered
    cells = spark.read.parquet(f"{path}/cells").toPandas()
    q = x[1000] / np.linalg.norm(x[1000])
    d = np.sqrt(2 * brute(range(len(x)), x, q, 10)[-1][0])
    read = vector_index.cells_to_read(cells, q, 10, float(d))
    assert 40 <= len(cells) <= 45 and len(read) < len(cells) / 4 and cells["n"].sum() == len(x)


def test_odd_tables(spark, clustered, tmp_path):
    vector_index.build(spark.createDataFrame([], "id long, vec array<double>"), str(tmp_path))
    assert vector_index.nearest(spark, str(tmp_path), [1.0, 0.0], 3, "id").collect() == []
    assert vector_index.nearest(spark, clustered[0], [0.0] * 16, 3, "id").collect() == []
