"""Each stage's rows against a brute-force version over its own input, and the whole run against the stages."""

import hashlib
from collections import Counter

import test_line_dedup
import test_packing
import test_quality
import test_simhash

import corpus_pipeline
from parley.llm import mixing


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def check_stages(spark, docs, sf):
    """Every stage's rows against a brute-force version over its own input."""
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)

    good = stage["quality_rules"](spark, docs, sf)
    assert good.columns == columns
    passes = lambda n_words, n_repeat: n_words >= 50 and 100 * n_repeat <= 50 * n_words
    out = test_quality.brute_verdicts([(r.doc_id, r.text, r.source) for r in docs.collect()])
    wanted = [(r.doc_id, r.text) for r in docs.collect() if r.source not in out and passes(*(test_quality.counts(r.text)[k] for k in (0, 4)))]
    assert rows_of(good) == sorted(wanted, key=str)

    lined = stage["dedup_lines"](spark, good, sf)
    assert lined.columns == columns
    kept = sorted(((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in rows_of(lined)), key=str)
    assert kept == sorted(((d, h) for d, _, _, h in test_line_dedup.brute(rows_of(good))), key=str)

    single = stage["near_dedup"](spark, lined, sf)
    assert single.columns == columns
    rows = rows_of(lined)
    groups = {}
    for (doc, text), fingerprint in zip(rows, test_simhash.fingerprints(rows)):
        groups.setdefault(fingerprint, []).append((doc, text))
    merged = test_simhash.grouped(groups)
    left = Counter(doc for doc, _ in rows_of(single))
    assert left[None] == sum(doc is None for doc, _ in rows)
    named = [[doc for doc, _ in group if doc is not None] for group in merged]
    assert +Counter({d: n for d, n in left.items() if d is not None}) == Counter(min(g) for g in named if g)
    assert set(rows_of(single)) <= set(rows)

    mixed = stage["mix_sources"](spark, single, sf)
    assert mixed.columns == columns
    copies = Counter()
    for r in mixing.mix(single).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +copies
    assert set(rows_of(mixed)) <= set(rows_of(single))

    packed = stage["pack_sequences"](spark, mixed, sf)
    n, _, lengths = test_packing.check(mixed)
    assert n == test_packing.greedy(lengths) and packed.count() == len(lengths)
    return packed


def test_stages(spark, sf):
    small = sf.replace("0.01", "0.001")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "dedup_lines", "near_dedup", "mix_sources", "pack_sequences"]
    packed = check_stages(spark, docs, small)
    columns = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).select(*columns).collect())) == sorted(map(tuple, packed.select(*columns).collect()))


def test_odd_rows(spark, small_docs):
    check_stages(spark, small_docs, "")


def test_empty(spark, no_docs):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0 and (name == "pack_sequences" or docs.columns == no_docs.columns)
