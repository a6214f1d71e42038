import hashlib
import re
from collections import defaultdict

from parley.llm import line_dedup, queries

SPACE = " \t\n\v\f\r"


def brute(rows):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))

    docs = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 20:
                docs[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(docs.get(key(x), ())) < 3 or doc == max(docs[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(small_docs):
    done = line_dedup.dedup_lines(small_docs)
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in done.collect()]
    assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in small_docs.collect()])
    assert sum(x[2] for x in got) > 10
    whole = line_dedup.drop_shared_lines(small_docs)
    assert whole.columns == small_docs.columns
    assert sorted((str((r.doc_id, r.text)) for r in whole.collect())) == sorted(str((r.doc_id, r.text)) for r in done.collect())
    others = [c for c in small_docs.columns if c != "text"]
    assert sorted(map(str, whole.select(*(f"`{c}`" for c in others)).collect())) == sorted(map(str, small_docs.select(*(f"`{c}`" for c in others)).collect()))


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op2_line_dedup(spark, sf).collect()), key=str) == brute(rows)


def test_empty(no_docs):
    assert line_dedup.dedup_lines(no_docs).collect() == []
