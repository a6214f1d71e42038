import re

from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import licenses


def base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_over_whole_table(spark, sf, small_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), small_docs):
        texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        got = sorted(licenses.scan(docs).collect(), key=lambda r: str((r.doc_id, r.n_words)))
        assert len(got) == len(texts)
        assert sorted((str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)) == sorted(str((d, *base(t))) for d, t in texts)
        for r in got:
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
            assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_templates():
    index = licenses.Index({})
    for label, template, _ in licenses.TEMPLATES:
        found = index.aligned(licenses.words_of(f"some words before\n# {template.upper()}! and more".encode()))
        assert found[label] == 1.0
    both = b"filler " * 50 + licenses.TEMPLATES[0][1].encode() + b" filler " * 50 + licenses.TEMPLATES[12][1].encode()
    assert {"mit", "cc0"} <= set(index.aligned(licenses.words_of(both)))
    gpl = "This work is licensed under the GNU General Public License, version 3".encode()
    assert set(index.aligned(licenses.words_of(gpl))) == {"gpl-3"}
    assert index.aligned(licenses.words_of(b"the work is under the version of this license and the public")) == {}
    damaged = b"permission is hereby granted free of charge to all who hold a copy of such software and associated documentation files"
    assert "mit" in index.aligned(licenses.words_of(damaged))


def brute_aligned(words):
    """Every template at every place of the file."""
    out = {}
    for label, template, keys in licenses.TEMPLATES:
        t = template.split()
        for start in range(1 - len(t), len(words)):
            a, z = max(0, start), min(start + len(t), len(words))
            same = sum(words[k] == t[k - start] for k in range(a, z))
            span = f" {' '.join(words[a:z])} "
            if same >= licenses.LEAST * len(t) and same > 1 and all(f" {key} " in span for key in keys):
                out[label] = max(out.get(label, 0), same / len(t))
    return out


def expected(text):
    words = [w.decode("utf-8", "surrogateescape") for w in licenses.words_of((text or "").encode())]
    own = brute_aligned(words)
    labels = set(own) | set(filter(None, base(text)[4].split(",")))
    return ",".join(sorted(labels)), 1.0 if base(text)[4] else max(own.values(), default=0.0)


def test_labels_against_brute_force(spark, sf, small_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), small_docs):
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, set()).add(r.text)
        for r in licenses.scan(docs).collect():
            assert (r.labels, round(r.score, 12)) in {(a, round(b, 12)) for a, b in map(expected, texts[r.doc_id])}, r


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_damaged_templates_against_brute_force(data):
    index = licenses.Index({b"license": 1.0, b"the": 0.1})
    words = []
    for _ in range(data.draw(st.integers(1, 3))):
        label, template, keys = data.draw(st.sampled_from(licenses.TEMPLATES))
        t = template.split()
        cut = t[data.draw(st.integers(0, len(t) // 2)) :][: data.draw(st.integers(3, len(t)))]
        for _ in range(data.draw(st.integers(0, 4))):
            cut[data.draw(st.integers(0, len(cut) - 1))] = data.draw(st.sampled_from(["x", "license", "software", "version"]))
        words += data.draw(st.lists(st.sampled_from(["filler", "permission", "attribution", "copyright", "public"]), max_size=5)) + cut
    got = index.aligned([w.encode() for w in words])
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in brute_aligned(words).items()}


def test_rare_words_elsewhere_hide_no_place():
    label, template, _ = licenses.TEMPLATES[0]
    short = " ".join(template.split()[:14])
    far = " filler documentation filler associated filler files filler obtaining filler software filler copy " * 3
    words = (far + short + far).split()
    found = licenses.Index({}).aligned([w.encode() for w in words])
    assert found == brute_aligned(words) and found["mit"] >= 14 / len(template.split())


def test_words_beyond_ascii():
    text = "Überß MIT-License cc/by/nc Ａ"
    assert [w.decode() for w in licenses.words_of(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "Überß mit-license cc/by/nc Ａ")


def test_empty(no_docs):
    assert licenses.scan(no_docs).collect() == []
