"""Licence scans: base phrases, and templates found through a positional rare-token index."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrase -> label.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Label, template text, mandatory key phrases.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
#: How many of a template's rarest words in a file are looked up; least share of a template that must stand in place.
RARE = 5
LEAST = 0.4
#: A-Z fold to lower case, other ASCII outside 0-9 and a-z separates words, bytes beyond ASCII stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Index:
    """Postings of template words by relative position, and the licence words' IDF over all documents."""

    def __init__(self, idf: dict[bytes, float]):
        self.base = [(tuple(p.encode().split()), label) for p, label in BASE.items()]
        self.templates = [(label, t.encode().split(), [tuple(k.encode().split()) for k in keys]) for label, t, keys in TEMPLATES]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, words, _) in enumerate(self.templates):
            for at, word in enumerate(words):
                self.postings[word].append((number, at))
        self.vocabulary = frozenset(self.postings)
        self.rarest = [sorted(set(words), key=lambda w: (-idf.get(w, math.inf), w)) for _, words, _ in self.templates]

    def base_places(self, words: list[bytes]) -> list[tuple[int, str]]:
        line = b" " + b" ".join(words) + b" "
        found = []
        for phrase, label in self.base:
            if b" " + b" ".join(phrase) + b" " in line:
                at = -1
                try:
                    while True:
                        at = words.index(phrase[0], at + 1)
                        if tuple(words[at : at + len(phrase)]) == phrase:
                            found.append((at, label))
                except ValueError:
                    continue
        return found

    def aligned(self, words: list[bytes]) -> dict[str, float]:
        """label -> greatest share of a template in place, over the places where its key phrases stand and LEAST is reached.

        A template's RARE rarest words known in the file are looked up, and places
        that two of them agree on are tried. Where all its key phrases stand in the
        file the template's other known words are looked up too, so that no place
        is missed for rare words that stand elsewhere in a long file.
        """
        known = self.vocabulary.intersection(words)
        line = b" " + b" ".join(words) + b" "
        wanted: dict[bytes, list[tuple[int, int]]] = {}
        for number, order in enumerate(self.rarest):
            rare = [w for w in order if w in known]
            if len(rare) > RARE and not all(b" " + b" ".join(key) + b" " in line for key in self.templates[number][2]):
                rare = rare[:RARE]
            if len(rare) > 1:
                for word in rare:
                    wanted.setdefault(word, []).extend(p for p in self.postings[word] if p[0] == number)
        votes = Counter()
        for at, word in enumerate(words) if wanted else ():
            if word in wanted:
                votes.update((number, at - k) for number, k in wanted[word])
        out: dict[str, float] = {}
        for (number, start), n in votes.items():
            label, template, keys = self.templates[number]
            if n < 2:
                continue
            share = sum(1 for k, w in enumerate(template) if 0 <= start + k < len(words) and words[start + k] == w) / len(template)
            if share < LEAST or share <= out.get(label, 0.0):
                continue
            a, z = max(0, start), start + len(template)
            if all(any(tuple(words[k : k + len(key)]) == key for k in range(a, max(a, z - len(key) + 1))) for key in keys):
                out[label] = share
        return out

    def scan(self, text: bytes) -> tuple:
        words = words_of(text)
        places = self.base_places(words)
        own = self.aligned(words)
        base = sorted({label for _, label in places})
        score = 1.0 if base else max(own.values(), default=0.0)
        at = [k for k, _ in places]
        return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *own})), float(score))


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def _frequencies(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, Counter()
        for batch in batches:
            for text in _binary(batch.column(0)):
                n += 1
                seen.update(vocabulary.intersection(words_of(text.as_py() or b"")))
        rows = [("", n), *((w.decode(), k) for w, k in seen.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], ["word", "n"])

    return run


def document_frequencies(docs: DataFrame, *, text: str = "text") -> dict[bytes, float]:
    """IDF of each licence word over all documents; as many rows reach the driver as the templates have words."""
    vocabulary = Index({}).vocabulary
    counted = docs.select(F.col(text).cast("string")).mapInArrow(_frequencies(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r["word"]: r["n"] for r in counted.collect()}
    total = n.pop("", 0)
    return {w: math.log((1 + total) / (1 + n.get(w.decode(), 0))) for w in vocabulary}


COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _scan(idf: dict[bytes, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            rows = [index.scan(x.as_py() or b"") for x in _binary(batch.column(1))]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], COLUMNS)

    return run


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text is empty: no words, null places, empty labels, score 0. Rows with
    a null or repeated doc_id come back each; an empty table gives an empty
    result. A base phrase scores 1, otherwise the best aligned template's share
    of words in place. Two passes: document frequencies, then the scan.
    """
    idf = document_frequencies(docs, text=text)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(_scan(idf), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
