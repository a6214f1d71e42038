"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bounds of the sample that the classifier is fitted on; everything else covers all rows.
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
FEATURES = 256
MIN_POSITIVE_ROWS = 5
FOLDS = 5
#: Word beginnings of these lengths in bytes are features beside whole words.
BEGINNINGS = (5, 6, 7, 8)
#: Letters A-Z fold to lower case, other ASCII separates words, bytes beyond ASCII stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: bytes) -> set[bytes]:
    """Distinct words of a whole text, beginnings of longer words (+), and beginnings that two distinct words share (++)."""
    words = set(text.translate(FOLD).split())
    starts = Counter(w[:k] for w in words for k in BEGINNINGS if len(w) > k)
    return words | {p + b"+" for p in starts} | {p + b"++" for p, n in starts.items() if n > 1}


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


class Model:
    """A linear score over features, as a probability."""

    def __init__(self, weights: dict[bytes, float] | None = None, bias: float = -20.0):
        self.weights, self.bias = weights or {}, bias
        self.short = {w for w in self.weights if b"+" not in w and len(w) < BEGINNINGS[0]}
        self.starts = {w[: BEGINNINGS[0]] for w in self.weights if w not in self.short}

    def score(self, text: bytes) -> float:
        z, words, cut = self.bias, set(text.translate(FOLD).split()), BEGINNINGS[0]
        near = [w for w in words if w[:cut] in self.starts]  # no other long word has a feature with a weight
        for f in self.short & words:
            z += self.weights[f]
        for f in features(b" ".join(near)) if near else ():
            z += self.weights.get(f, 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def nnpu(x: np.ndarray, positive: np.ndarray, prior: float, *, steps: int = 800, rate: float = 0.05, decay: float = 1e-5, seed: int = 1):
    """Linear classifier under the non-negative risk prior*R+(P) + max(0, R-(U) - prior*R-(P)), with sigmoid loss.

    Where the estimate of the negatives' risk falls below zero the step goes
    against it, which unlearns what was fitted to chance words of the positives.
    """
    rng = np.random.default_rng(seed)
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    w, b = np.zeros(x.shape[1]), -1.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, steps + 1):
        xp = x[rng.choice(p, min(len(p), 512), replace=False)].astype(np.float32)
        xu = x[rng.choice(u, min(len(u), 2048), replace=False)].astype(np.float32)
        sp, su = 1 / (1 + np.exp(-(xp @ w + b))), 1 / (1 + np.exp(-(xu @ w + b)))
        dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
        gp, gu = (-2 * prior * dp, du) if su.mean() - prior * sp.mean() >= 0 else (prior * dp, -du)
        grad = np.append(gp @ xp + gu @ xu + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for positive, text in zip(batch.column(0), _binary(batch.column(1))):
            found = sorted(features(text.as_py() or b""))
            yield pa.RecordBatch.from_arrays([pa.array([positive.as_py()] * len(found), pa.bool_()), pa.array(found, pa.binary())], ["positive", "feature"])


def _chosen(order: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(order[f] for f in features(x.as_py() or b"") if f in order) for x in _binary(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], ["positive", "found"])

    return run


def fit(sample: DataFrame, prior: float) -> Model:
    """sample (positive, text) -> model over the FEATURES that tell positives from unlabelled text best."""
    n = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    a, c = n.get(True, 0), n.get(False, 0)
    if not a or not c:
        return Model()
    counts = sample.mapInArrow(_features, "positive boolean, feature binary").groupBy("feature").agg(
        F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")
    )
    pooled = (F.col("p") + F.col("u")) / (a + c)
    z = (F.col("p") / a - F.col("u") / c) / F.sqrt(pooled * (1 - pooled) * (1 / a + 1 / c) + 1e-12)
    best = counts.where(F.col("p") >= min(MIN_POSITIVE_ROWS, a)).withColumn("z", z).where("z > 0").orderBy(F.desc(F.round("z", 9)), "feature").limit(FEATURES).collect()
    if not best:
        return Model()
    chosen = [bytes(r["feature"]) for r in best]
    rows = sample.mapInArrow(_chosen({f: k for k, f in enumerate(chosen)}), "positive boolean, found array<int>").collect()
    rows.sort(key=lambda r: (r["positive"], r["found"]))
    x = np.zeros((len(rows), len(chosen)), np.uint8)
    for k, r in enumerate(rows):
        x[k, r["found"]] = 1
    w, b = nnpu(x, np.array([r["positive"] for r in rows]), prior)
    return Model(dict(zip(chosen, w.tolist())), float(b))


def held_out(doc_id: str) -> F.Column:
    """crc32 of the id as text, modulo FOLDS, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def drawn_by_hash(ids: DataFrame, n: int, most: int) -> DataFrame:
    """At most `most` of n ids, by their hash. A hash bound first leaves about that many, so no task sends a full sample of its own."""
    turn = F.xxhash64(F.lit(11), "id")
    parts = 1 << 30
    near = ids if n <= 2 * most else ids.where(F.pmod(turn, F.lit(parts)) < int(parts * 1.2 * most / n))
    return near.orderBy(F.pmod(turn, F.lit(parts)), "id").limit(most)


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on rows that are not held out.

    Positives are confirmed toxic rows; every other row, labelled or not, is
    unlabelled text. The class prior is the share of positives among all labelled
    training rows. Which rows are sampled follows a hash of the id; equal texts
    count once, so a group of copies teaches no words of its own. Labels with a
    null id or a null label say nothing; of several labels of one id the largest
    counts; labels without a document only count towards the prior. Without any
    confirmed toxic row, or without documents, the model finds nothing toxic.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    row = known.agg(F.avg((F.col("y") == 1).cast("double")).alias("p"), F.count_if(F.col("y") == 1).alias("n")).first()
    share = row["p"]
    yes = drawn_by_hash(known.where("y = 1").select("id"), row["n"], MAX_POSITIVE).select("id", F.lit(True).alias("positive"))
    # a row may be drawn as unlabelled and be positive too: unlabelled text holds positives at the prior rate
    ids = docs.where(F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("id"))
    some = drawn_by_hash(ids, ids.count(), MAX_UNLABELLED).select("id", F.lit(False).alias("positive"))
    drawn = spark.createDataFrame(yes.collect() + some.collect(), "id long, positive boolean")
    drawn_texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "id")
    sample = Scratch(spark, "toxicity").keep(drawn_texts.select("positive", "text").dropDuplicates(["positive", "text"]), "sample")
    return fit(sample, min(0.9, max(0.001, share or 0.001)))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(x.as_py() or b"") for x in _binary(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null and empty texts get the score of no words.

    An empty table gives an empty result; without any confirmed toxic row all
    scores are near 0. Repeated rows come back each.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    scored = plain.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    return score(docs, train(docs, labels, **names), **{k: v for k, v in names.items() if k != "label"})
