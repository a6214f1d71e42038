import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import packing


@lru_cache(1)
def fresh():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())  # as its file has it


def plain_ids(texts):
    t = fresh()
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = []
    for (doc, _), ids in zip(rows, plain_ids([t for _, t in rows])):
        cuts = list(range(len(ids), 0, -2048))[::-1]
        start = 0
        for k, end in enumerate(cuts):
            wanted.append((doc, k, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())))
            start = end
    got = packing.pack(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(wanted, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), sum(r.length for r in got), [r.length for r in got]


def greedy(lengths):
    bins = []
    for n in sorted(lengths, reverse=True):
        room = [(2048 - b, k) for k, b in enumerate(bins) if 2048 - b >= n]
        if room:
            bins[min(room)[1]] += n
        else:
            bins.append(n)
    return len(bins)


def test_whole_table(spark, sf):
    n, tokens, lengths = check(spark.read.parquet(f"{sf}/documents.parquet"))
    assert n == greedy(lengths)


def test_small(small_docs):
    n, tokens, lengths = check(small_docs)
    assert n == greedy(lengths)


def test_empty(no_docs):
    assert packing.pack(no_docs).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=120))
def test_counts_equal_one_by_one(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    slots = packing.best_fit_decreasing(counts, 40)
    assert sum(s[2] for s in slots) == len(lengths)
    made = {s[3] + j // s[5] for s in slots for j in range(s[2])}
    bins = []
    for n in sorted(lengths, reverse=True):
        room = [(40 - b, k) for k, b in enumerate(bins) if 40 - b >= n]
        if room:
            bins[min(room)[1]] += n
        else:
            bins.append(n)
    assert len(made) == len(bins)


LITERALS = st.sampled_from(["<|endoftext|>", "<|endoftext", "endoftext|>", " <|endoftext|>\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="ab é'\n\t.,1 <|>s", max_size=20), LITERALS), max_size=4).map("".join))
def test_ids_of_cut_texts(text):
    enc = packing.encoder(packing.vocabulary_path())
    assert np.frombuffer(enc.ids(text), "<u4").tolist() + [0] == plain_ids([text])[0]


def test_literals_of_added_tokens(spark):
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b\n", "w " * 3000 + "<|endoftext|>" + " w" * 3000]
    assert plain_ids(texts[:1])[0][:-1] == [31373, 220, 50256, 995]
    n, _, lengths = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert n == greedy(lengths)
