import math
import random
import re
import statistics
from collections import Counter

from parley.llm import quality, queries


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + d for k, w in enumerate(windows) if w in often for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_counts(small_docs, spark, sf):
    for docs in (small_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        got = [tuple(r[:6]) for r in quality.judge(docs).select("doc_id", *quality.COUNTS[:5]).collect()]
        assert sorted(got, key=str) == sorted(((r.doc_id, *counts(r.text)) for r in docs.collect()), key=str)
        for r in quality.judge(docs).collect():
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_columns_come_back(small_docs):
    kept = quality.keep_good(small_docs)
    assert kept.schema == small_docs.schema
    good = {r.doc_id for r in quality.judge(small_docs).where("kept").collect()}
    rows = sorted(map(tuple, small_docs.collect()), key=str)
    assert sorted(map(tuple, kept.collect()), key=str) == [r for r in rows if r[0] in good]


def good(k):
    return " ".join(f"w{k}x{i}" for i in range(60))


def test_hosts(spark):
    rows = [(k, good(k), "fine") for k in range(50)] + [(100 + k, "too short", "spam") for k in range(200)] + [(400, good(4), "spam"), (401, good(4), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == set(range(50)) | {401}


def planted():
    """20 like hosts, one of them large; two of which most documents are junk that the base rules pass; and a tiny one whose only document is junk."""
    junk = lambda k: " ".join(f"w{k}x{i}&&&" for i in range(60))
    lines = lambda k: "\n".join([f"one more line {k}"] * 8 + [good(k)])
    rows = [(k, "short" if k % 23 == 7 else good(k), f"like{k % 20 if k < 1000 else 0}") for k in range(1600)]
    rows += [(2000 + k, junk(k) if k % 7 else good(k), "symbols") for k in range(70)]
    rows += [(3000 + k, lines(k) if k % 7 else good(k), "lines") for k in range(70)]
    rows += [(4000 + k, lines(k) if k % 2 else junk(k), "both") for k in range(70)]
    return rows + [(5000, junk(0), "tiny"), (5001, junk(1), None)]


def test_planted_hosts_through_the_query(spark, tmp_path):
    spark.createDataFrame(planted(), "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_quality_rules(spark, str(tmp_path)).collect()}
    assert len(got) == len(planted())
    for doc, text, source in planted():
        assert got[doc].base_failed == (text == "short")
        assert got[doc].kept == (text != "short" and source not in ("symbols", "lines", "both")), (doc, source)


def brute_verdicts(rows):
    """Hosts rejected, worked out anew from the counts of every document."""
    fails = {}
    for _, text, source in rows:
        words, chars, symbols, dups, repeats = counts(text)
        lines = len([x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        own = [words < 50, repeats > words / 2, symbols > chars / 10, dups > 0.3 * lines]
        fails.setdefault(source, []).append([*own, any(own)])
    out = set()
    for rule in range(5):
        n = {h: len(f) for h, f in fails.items()}
        k = {h: sum(x[rule] for x in f) for h, f in fails.items()}
        rates = [k[h] / n[h] for h in n]
        mean = statistics.fmean(rates)
        if 0 < mean < 1:
            spread = statistics.variance(rates) - mean * (1 - mean) * statistics.fmean(1 / x for x in n.values())
            weight = min(1e6, max(1, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
            a, b = mean * weight, (1 - mean) * weight
        else:
            a, b = mean + 0.01, 1.01 - mean
        sd = lambda m, w: math.sqrt(m * (1 - m) / (w + 1))
        limit = min(0.9, max(0.5, a / (a + b) + 2 * sd(a / (a + b), a + b)))
        for h in n:
            rate = (k[h] + a) / (n[h] + a + b)
            if rate - 1.645 * sd(rate, n[h] + a + b) > limit:
                out.add(h)
    return out


def test_verdicts_against_brute_force(spark):
    assert brute_verdicts(planted()) == {"symbols", "lines", "both"}
    rng = random.Random(2)
    for bad in (0, 3, 12):
        rows = [
            (k, rng.choice(["short", "a b c " * 30]) if rng.random() < (0.93 if k % 20 < bad else 0.04) else good(k), f"h{k % 20}") for k in range(1200)
        ]
        kept = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept").collect()}
        gone = brute_verdicts(rows)
        assert gone <= {f"h{h}" for h in range(bad)} and (len(gone) == bad or bad == 12)  # of 12 bad hosts in 20 none is far above the others
        assert kept == {d for d, t, h in rows if h not in gone and len(t) > 300}


def test_shrinkage_spares_small_hosts(spark):
    rows = [(k, good(k), f"s{k % 20}") for k in range(200)] + [(1000, "short", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdicts = {r.host: r.host_ok for r in quality.host_verdicts(quality.with_counts(docs, "text"), "source").collect()}
    assert verdicts["tiny"] and all(verdicts.values())


def test_many_hosts_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW_HOSTS", 2)
    docs = spark.createDataFrame(planted(), "doc_id long, text string, source string")
    kept = {r.source for r in quality.keep_good(docs).collect()}
    assert None in kept and "tiny" in kept and not kept & {"symbols", "lines", "both"}


def test_empty(no_docs):
    assert quality.judge(no_docs).collect() == [] and quality.keep_good(no_docs).collect() == []
