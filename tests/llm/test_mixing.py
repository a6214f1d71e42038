from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, left = sum(sizes.values()), {}, dict(weight)
    while left:
        rest = total - sum(target.values())
        over = {s for s in left if rest * weight[s] / sum(left.values()) > 3 * sizes[s] + 1e-9}
        if not over:
            target |= {s: rest * w / sum(left.values()) for s, w in left.items()}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left = {s: w for s, w in left.items() if s not in over}
    return target


def check(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    wanted = brute_targets(size)
    for s in size:
        assert target[s] == pytest.approx(wanted[s], abs=1e-6 * max(1, wanted[s]))
    return size, taken, target


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size, taken, target = check(spark, docs)
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 200, s
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}


def test_small(spark, small_docs):
    check(spark, small_docs)
    out = mixing.mixed(small_docs)
    assert out.columns == small_docs.columns
    wanted, got = Counter(), Counter()
    for r in mixing.mix(small_docs).collect():
        wanted[r.doc_id] += r.copies
    for r in out.collect():
        got[r.doc_id] += 1
    assert got == +wanted


def test_goes_on_past_what_does_not_fit(spark):
    rows = [(k, "a", "w " * 100) for k in range(100)] + [(100, "a", "w " * 20_000)] + [(k, "b", "w " * 100) for k in range(200, 446)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for seed in range(4):
        got = mixing.mix(docs, seed=seed).groupBy("source").agg({"taken": "sum", "target": "first"}).collect()
        for source, taken, target in ((r["source"], r["sum(taken)"], r["first(target)"]) for r in got):
            assert abs(taken - target) <= 128 + 50, (seed, source, taken, target)


def test_empty(no_docs):
    assert mixing.mix(no_docs).collect() == []


def seats(votes, n):
    won = defaultdict(int)
    for _ in range(n):
        best = min(votes, key=lambda p: (-votes[p] / (2 * won[p] + 1), p))
        won[best] += 1
    return {p: won[p] for p in votes}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=8), st.integers(0, 60))
def test_highest_quotients(spark, votes, n):
    parties = spark.createDataFrame([(f"p{k}", v, n) for k, v in enumerate(votes)], "p string, v long, n long")
    got = {r.p: r["__quota"] for r in mixing.apportion(parties, [], "v", "n").collect()}
    assert got == seats({f"p{k}": v for k, v in enumerate(votes)}, n)
