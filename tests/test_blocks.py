"""All pairs in blocks against brute force, over more windows than any sample that was taken before."""

import numpy as np
import pytest

from parley.operators import blocks, corpus, film, titles
from parley.plans import catalog
from parley.plans.bindings import Corpus

SCHEMA = "movie_id long, idx long, vec array<double>"


def unit(rng, n, dim):
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_genericness_compares_with_every_window(spark, monkeypatch):
    n, films = 10_600, 7
    x = unit(np.random.default_rng(5), n, 4)
    x[100:200] = x[0]  # copies
    x[300:400] *= 3  # the bound of float32 scales with lengths
    m = np.arange(n) % films
    w = spark.createDataFrame([(int(m[k]), k, x[k].tolist()) for k in range(n)], SCHEMA)
    monkeypatch.setattr(corpus, "LEAST_ROWS", 3_000)
    raw = {r.idx: r.raw for r in corpus.genericness(w).collect()}
    assert len(raw) == n
    for k in [*range(0, 400, 9), *range(400, n, 511)]:
        near = np.where(m == m[k], -1.0, x @ x[k])
        assert raw[k] == pytest.approx(np.sort(near)[-32:].mean(), abs=1e-12)


@pytest.mark.parametrize("block", [7, 16_384])
def test_cross_scores_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(film, "BLOCK", block)
    monkeypatch.setattr(blocks, "PIECE", 300)
    rng = np.random.default_rng(6)
    sides = {s: (np.round(unit(rng, n, 3), 1), np.round(rng.random(n), 1)) for s, n in (("a", 40), ("b", 700))}  # rounded, so that many scores are equal
    tables = [spark.createDataFrame([(1, 2, k, v.tolist(), float(g)) for k, (v, g) in enumerate(zip(*sides[s]))], "a long, b long, idx long, vec array<double>, generic double") for s in "ab"]
    (x, g), (y, h) = sides["a"], sides["b"]
    score = x @ y.T - film.LAMBDA * (g[:, None] + h[None, :]) / 2
    contrast = score - (score.mean(1)[:, None] + score.mean(0)[None, :]) / 2
    one = film.ambience(*tables, ["a", "b"]).collect()
    assert len(one) == 1 and one[0].n == 28_000 and one[0].best == pytest.approx(score.max()) and one[0].ambient == pytest.approx(score.mean())
    got = {(r.ia, r.ib): r for r in film.cross_scores(*tables, ["a", "b"], 0.161, 0.103).collect()}
    assert got.keys() == set(zip(*map(np.ndarray.tolist, np.nonzero((contrast >= 0.161) & (score >= 0.103)))))
    assert all(r.score == pytest.approx(score[k]) and r.mean_a == pytest.approx(score.mean(1)[k[0]]) and r.mean_b == pytest.approx(score.mean(0)[k[1]]) for k, r in got.items())
    few = film.cross_scores(*tables, ["a", "b"], 0.161, None, 5)
    want = {(i, j) for i in range(40) for j in [j for j in np.lexsort((range(700), -np.round(score[i], 9))) if contrast[i, j] >= 0.161][:5]}
    assert {(r.ia, r.ib) for r in few.collect()} == want
    # a choice among each window's first ones is the choice among all
    all_ = titles.beat_bridge(film.cross_scores(*tables, ["a", "b"], 0.161), 0.161).orderBy("ia").collect()
    assert len(all_) == 5 and titles.beat_bridge(few, 0.161).orderBy("ia").collect() == all_


def test_foremost_keeps_the_choice(spark, monkeypatch):
    rng = np.random.default_rng(8)
    held = [(m, k, b) for m in (1, 2) for k in range(30) for b in (k, k + 1) if b < 30]
    inside = {k: [b for b in (k, k + 1) if b < 30] for k in range(30)}
    for n in range(3):
        score = np.round(rng.random((30, 30)), 1) if n else np.tile(np.round(rng.random((30, 1)), 1), (1, 30))
        rows = [(1, 2, i, j, float(score[i, j]) + 0.3, p, q, float(rng.integers(3))) for i in range(30) for j in range(30) for p in inside[i] for q in inside[j] if rng.random() < 0.4]
        tried = spark.createDataFrame(rows, "a long, b long, ia long, ib long, score double, ba long, bb long, agreement double")
        spans = spark.createDataFrame(held, "movie_id long, idx long, beat long")
        choose = lambda d: sorted(map(tuple, d.groupBy("a", "b").applyInPandas(film._chooser(False), film.CHOICE).collect()))
        kept = film.foremost(tried, spans)
        assert kept.count() < len(rows) and choose(kept) == choose(tried)


def test_bridges_of_every_pair_of_neighbours(spark, tmp_path):
    """Films beyond the tenth have bridges too, and a film without a next one has none."""
    labels = [8, 9, 10, 11, 13]
    x = unit(np.random.default_rng(9), 20 * len(labels), 8)
    rows = [(k, labels[k % len(labels)], v.tolist()) for k, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    pairs = catalog._film_pairs(Corpus(spark, str(tmp_path)))
    assert {tuple(r) for r in pairs.collect()} == {(8, 9), (9, 10), (10, 11)}
    assert {(r.a, r.b) for r in catalog.QUERIES["beat_bridge"](spark, str(tmp_path)).collect()} == {(8, 9), (9, 10), (10, 11)}
