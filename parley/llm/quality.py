"""Quality rules on documents and, by shrunken failure rates, on their hosts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import by_place, place, restored
from .scratch import Scratch

SYMBOLS = b"#*$%&|<>"
WINDOW = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: A document that fails one of these is rejected itself: name -> SQL over its counts.
BASE_RULES = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words"}
#: Rules whose failures count against a host: those, and what the base lets pass.
HOST_RULES = BASE_RULES | {"symbols": "10 * n_symbols > word_chars", "dup_lines": "10 * n_dup_lines > 3 * n_lines"}
#: A host's rate is far above the others' from so many standard deviations of the prior over its mean on, but a limit stays within these bounds:
#: a host of which most documents are good is never rejected, one of which nearly none is always.
SPREADS = 2.0
LIMITS = (0.5, 0.9)
#: The rate counts by its posterior's lower bound, so many standard deviations below the shrunken rate (5 % of a normal curve).
DOUBT = 1.645
#: Verdicts of more hosts than this are shuffled, not broadcast.
FEW_HOSTS = 100_000


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    at = np.fromiter((w in often for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : k + len(windows)] |= at
    return int(covered.sum())


def line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of a whole text."""
    words = text.split()
    letters = sum(map(len, words))
    chars = letters if text.isascii() else len(text.decode("utf-8", "replace")) - (len(text) - letters)
    n_lines, n_dup_lines = line_counts(text)
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), n_dup_lines, repeat_words(words), n_lines


def _count(text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at)
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            found = np.array([text_counts(x.as_py() or b"") for x in texts], np.int64).reshape(-1, len(COUNTS))
            new = [pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(list(batch.columns) + new, names)

    return run


def with_counts(docs: DataFrame, text: str) -> DataFrame:
    """docs with the counts of the whole text (null: empty) as COUNTS, which docs may not have."""
    fields = list(docs.schema.fields) + [T.StructField(n, T.LongType()) for n in COUNTS]
    names = [f.name for f in fields]
    return docs.mapInArrow(_count(docs.columns.index(text), names), T.StructType(fields))


def beta_prior(hosts: DataFrame, rules: list[str]) -> dict[str, tuple[float, float]]:
    """Method-of-moments beta prior of each rule's failure rate over hosts, weighted alike; one row reaches the driver."""
    rate = {r: F.col(r) / F.col("n") for r in rules}
    row = hosts.agg(
        F.avg(1.0 / F.col("n")).alias("inverse"),
        *(F.avg(rate[r]).alias(f"mean_{r}") for r in rules),
        *(F.var_samp(rate[r]).alias(f"var_{r}") for r in rules),
    ).first()
    prior = {}
    for r in rules:
        mean, var = row[f"mean_{r}"], row[f"var_{r}"]
        if mean is None or mean <= 0 or mean >= 1:
            prior[r] = (0.5, 0.5) if mean is None else (mean + 0.01, 1 - mean + 0.01)
            continue
        spread = (var or 0.0) - mean * (1 - mean) * row["inverse"]  # of the hosts' true rates, without sampling noise
        weight = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
        prior[r] = (mean * weight, (1 - mean) * weight)
    return prior


def limit_of(a: float, b: float) -> float:
    """The rate that is far above a Beta(a, b) prior: its mean and SPREADS standard deviations, within LIMITS."""
    mean = a / (a + b)
    return min(LIMITS[1], max(LIMITS[0], mean + SPREADS * math.sqrt(mean * (1 - mean) / (a + b + 1))))


def host_verdicts(counted: DataFrame, host: str) -> DataFrame:
    """(host, COUNTS) -> one row per host: host, host_ok, and the shrunken failure rate of each rule and of all together (`any`)."""
    rules = HOST_RULES | {"any": " OR ".join(f"{sql}" for sql in HOST_RULES.values())}
    hosts = counted.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *(F.count_if(F.expr(sql)).alias(r) for r, sql in rules.items()))
    hosts = Scratch(counted.sparkSession, "hosts").keep(hosts, "rates")
    ok, rates = F.lit(True), {}
    for r, (a, b) in beta_prior(hosts, list(rules)).items():
        weight = F.col("n") + F.lit(a + b)
        rates[r] = (F.col(r) + F.lit(a)) / weight
        least = rates[r] - F.lit(DOUBT) * F.sqrt(rates[r] * (1 - rates[r]) / (weight + 1))
        ok = ok & (least <= F.lit(limit_of(a, b)))
    return hosts.select("host", ok.alias("host_ok"), *(rate.alias(f"rate_{r}") for r, rate in rates.items()))


def _judged(placed: DataFrame, host: str, text: str, with_text: bool) -> DataFrame:
    """placed (columns by place) with COUNTS, base_failed and kept."""
    scratch = Scratch(placed.sparkSession, "quality")
    counts = with_counts(placed.withColumn(text, F.col(text).cast("string")), text)
    counted = scratch.keep(counts if with_text else counts.drop(text), "counts")
    verdicts = scratch.keep(host_verdicts(counted, host).select("host", "host_ok"), "verdicts")
    few = verdicts.count() <= FEW_HOSTS
    joined = counted.join(F.broadcast(verdicts) if few else verdicts, F.col(host).eqNullSafe(F.col("host"))).drop("host")
    failed = F.expr(" OR ".join(BASE_RULES.values()))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("host_ok")).drop("host_ok")


def judge(docs: DataFrame, *, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, COUNTS, base_failed and kept (false if base_failed, else the verdict on the host).

    A host is rejected where, for a rule or for all rules together, the
    posterior's lower bound of its failure rate is above the limit that follows
    from the prior over all hosts. Null texts count as empty and fail the base
    rules. A null host is a host of its own. Rows with a null or repeated doc_id
    count and come back each. An empty table gives an empty result; other
    columns, whatever their names, are not read. The join back is on the host,
    whose verdict is one row, so a host with a third of all rows is split by
    adaptive skew joins where the verdicts are too many to broadcast.
    """
    plain = docs.select(doc_id, host, text).toDF("c0", "c1", "c2")
    return _judged(plain, "c1", "c2", False).select(F.col("c0").alias("doc_id"), *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, *, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs that `judge` keeps, with the columns of docs, which may have any names."""
    return restored(_judged(by_place(docs), place(docs, host), place(docs, text), True).where("kept"), docs)
