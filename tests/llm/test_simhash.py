import re
from collections import defaultdict

import numpy as np
import xxhash

from parley.llm import simhash


def fingerprints(rows):
    fps = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return fps


def grouped(of):
    """{fingerprint: rows} -> lists of rows that links join."""
    fps, root = list(of), list(range(len(of)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    out = defaultdict(list)
    for k, f in enumerate(fps):
        out[find(k)] += of[f]
    return list(out.values())


def brute(rows):
    fps, of = fingerprints(rows), defaultdict(list)
    for k, f in enumerate(fps):
        of[f].append(k)
    out = []
    for group in grouped(of):
        named = [rows[k][0] for k in group if rows[k][0] is not None]
        out += [(rows[k][0], f"{fps[k]:016x}", min(named, default=None)) for k in group]
    return sorted(out, key=str)


def test_against_brute_force(small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    got = [tuple(r) for r in simhash.near_duplicates(small_docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in simhash.near_duplicates(docs, tile=64).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.keep_one(no_docs).columns == no_docs.columns


def test_keep_one(small_docs):
    found = simhash.near_duplicates(small_docs).collect()
    kept = simhash.keep_one(small_docs)
    assert kept.columns == small_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in found if r.doc_id is not None})
    assert ids.count(None) == 1
    whole = {str(tuple(r)) for r in small_docs.collect()}
    assert all(str(tuple(r)) in whole for r in kept.collect())


def test_keep_one_of_repeated_ids(spark):
    a, b = "one text of a good many words " * 9, "quite another story told by somebody else altogether " * 9
    rows = [(1, a, "x"), (1, b, "y"), (2, b, "z"), (3, "third one here " * 9, "q"), (3, "third one here " * 9, "p"), (3, "third one here " * 9, "p"), (None, a, "n"), (None, a, "n")]
    found = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(parts)
        found.append(sorted(map(str, simhash.keep_one(docs).collect())))
    assert found[0] == found[1] and len(found[0]) == 5
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (3, rows[3][1]), (None, a), (None, a)], key=str)


def test_tiles_lose_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = base ^ np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate((base, flips)))
    counts = defaultdict(int)
    cell = {}
    for f in fps.tolist():
        c = 0
        for k in range(4):
            c = c * 17 + (f >> 16 * k & 0xFFFF).bit_count()
        cell[f] = c
        counts[c] += 1
    cells, low, high = simhash.plan_tiles(counts, 8)
    tiles = {c: range(first, first + n) for c, first, n in cells}
    compared = {(a, int(b)) for a in range(len(low)) for b in simhash.near_tiles(a, low, high, 3)} | {(a, a) for a in range(len(low))}
    assert len(compared) < len(low) ** 2 / 2
    for a in fps.tolist():
        for b in fps.tolist():
            if (a ^ b).bit_count() <= 3:
                assert all((min(x, y), max(x, y)) in compared for x in tiles[cell[a]] for y in tiles[cell[b]])
