import zlib

import numpy as np

from parley.llm import toxicity


def test_held_out_accuracy(spark, sf):
    big = sf.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.toxicity(docs.select("doc_id", "text"), labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    hit = sum(t and p for t, p in test)
    assert hit / sum(t for t, _ in test) > 0.8, "recall"
    assert hit / max(1, sum(p for _, p in test)) > 0.85, "precision"


def test_score_is_over_all_features():
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 100, rng.integers(2, 9)).tolist()) for _ in range(300)]
    found = sorted(toxicity.features(b" ".join(words)))
    model = toxicity.Model({f: float(w) for f, w in zip(found, rng.standard_normal(len(found)) / 9) if rng.random() < 0.5}, -0.3)
    for k in range(0, 280, 20):
        text = b", ".join(words[k : k + 20])
        z = -0.3 + sum(model.weights.get(f, 0) for f in toxicity.features(text))
        assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-9


def test_non_negative_risk_finds_the_telling_word():
    rng = np.random.default_rng(0)
    x = (rng.random((900, 40)) < 0.2).astype(np.uint8)
    toxic = rng.random(900) < 0.2
    x[:, 0] = toxic & (rng.random(900) < 0.9)
    w, b = toxicity.nnpu(np.concatenate((x[:300][toxic[:300]], x)), np.arange(toxic[:300].sum() + 900) < toxic[:300].sum(), 0.2)
    predicted = x @ w + b > 0
    assert (predicted == toxic).mean() > 0.93


def test_odd_rows(spark, small_docs, no_docs):
    labels = spark.createDataFrame([(k, int(k % 9 == 0)) for k in range(60)], "doc_id long, toxic int")
    rows = toxicity.toxicity(small_docs, labels).collect()
    assert len(rows) == small_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(no_docs, labels).collect() == []
    none = toxicity.toxicity(small_docs, labels.where("toxic = 0")).collect()
    assert all(r.score < 0.01 for r in none)


def test_odd_labels(spark):
    rows = [(k, f"plain words number {k} of a story" + (" vileword" if k % 4 == 0 else "")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = lambda found: spark.createDataFrame(found, "doc_id long, toxic int, lang string")
    plain = [(k, int(k % 4 == 0), "en") for k in range(0, 400, 2)]
    wanted = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, table(plain)).collect()}
    assert all(v == int(k % 4 == 0) for k, v in wanted.items())
    odd = plain + plain + [(None, 1, "x"), (1, None, None), (4, 0, "again"), (9_999, 1, None), (None, None, None)]
    assert {r.doc_id: r.predicted for r in toxicity.toxicity(docs, table(odd)).collect()} == wanted
    for none in ([], [(None, 1, "x")], [(4, None, "x")], [(9_999, 1, "x")]):
        got = toxicity.toxicity(docs, table(none)).collect()
        assert len(got) == 400 and not any(r.predicted for r in got)


def test_held_out_labels_teach_nothing(spark):
    held = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 5 == 0]
    docs = spark.createDataFrame([(k, "vileword and more" if k in held[:60] else f"plain {k}") for k in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k in held[:60])) for k in range(3000)], "doc_id long, toxic int")
    assert not any(r.predicted for r in toxicity.toxicity(docs, labels).collect())
