"""Cases of single operators on small literals."""

import json
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import diff, hashing
from parley.functions import text as T
from parley.operators import analytics, corpus, cues, film, genstore, ladder, quality, retrieval, titles
from parley.sources import pages, tables
from parley.streaming import logs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("Hello,  World!", "hello world"), ("Café déjà", "cafe deja"), ("don’t", "don't"), ("", ""), (" \t", ""), ("ÀÉÎõü ß", "aeiou")],
)
def test_normalize(spark, text, want):
    assert one(spark, T.normalize(F.col("t")), t=text) == want


def test_normalize_is_the_compatibility_form(spark):
    """Against the plain rule over every character there is, each between two letters."""
    from parley.functions.diff import normal

    chars = [chr(k) for k in range(1, 0x20000) if not 0xD800 <= k < 0xE000]
    texts = ["x".join(f"{c}y" for c in chars[at : at + 64]) for at in range(0, len(chars), 64)] + ["ﬁne ½… ＡＢＣ ™ Ⅷ", "plain"]
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize(F.col("t")).alias("n")).collect()}
    assert got["ﬁne ½… ＡＢＣ ™ Ⅷ"] == "fine 1 2 abc tm viii"
    wrong = [t for t in texts if got[t] != normal(t)]
    assert not wrong, [(t, got[t], normal(t)) for t in wrong[:3]]


def test_titles(spark):
    for t in ("The Matrix", "Matrix, The", "matrix"):
        assert one(spark, T.title_key(F.col("t")), t=t) == "matrix"
    assert one(spark, T.title_key(F.col("t")), t="Fast & Furious") == "fastandfurious"
    assert one(spark, T.title_key(F.col("t")), t="A&E") == "ande"
    want = ["Léon & Ann's Day: Two", "Léon & Ann's Day", "Léon and Ann's Day: Two", "Léon & Anns Day: Two", "Leon & Ann's Day: Two", "Leon & Ann's Day"]
    assert one(spark, T.title_variants(F.col("t")), t="Léon & Ann's Day: Two") == want
    assert one(spark, T.title_variants(F.col("t")), t="Up") == ["Up"] and one(spark, T.title_variants(F.col("t")), t="M") == []


def test_clip(spark):
    assert one(spark, T.clip(F.col("t"), 10), t="short") == "short"
    assert one(spark, T.clip(F.col("t"), 10), t="one two three four") == "one two..."
    assert one(spark, T.clip(F.col("t"), 10), t="x" * 20) == "x" * 9 + "..."


def test_jaccard(spark):
    a = F.array(F.lit("a"), F.lit("b"))
    none = F.array().cast("array<string>")
    assert one(spark, T.jaccard(a, F.array(F.lit("b"), F.lit("c")), 1.0), x=1) == pytest.approx(1 / 3)
    assert one(spark, T.jaccard(none, none, 1.0), x=1) == 1 and one(spark, T.jaccard(none, none, 0.0), x=1) == 0


def test_diff():
    s = diff.stats("you shall not pass here", "you shall not walk here")
    assert (s["shared"], s["substitutions"], s["extras"], s["shared_ratio"]) == (4, 1, 0, 0.8)
    assert diff.stats("", "")["shared_ratio"] == 1
    assert [w["changed"] for w in diff.align("Luke, I am your father", "No. I am your father!")] == [True, False, False, False, False]
    assert diff.align("a b", "a - b")[1] == {"word": "-", "changed": False}


def test_visitor_hash(spark):
    assert hashing.fnv1a64("") == str(0xCBF29CE484222325) and hashing.fnv1a64("a") == str(0xAF63DC4C8601EC8C)
    rows = spark.createDataFrame([("1.1.1.1", "ua", t) for t in ("2024-01-01 01:00:00", "2024-01-01 23:00:00", "2024-01-02 01:00:00")], "ip string, ua string, t string")
    h = [r.h for r in rows.select(hashing.visitor_hash(F.col("ip"), F.col("ua"), F.to_timestamp("t")).alias("h")).collect()]
    assert h[0] == h[1] != h[2]


def test_reply_parsing(spark):
    for reply in ('{"a": 1}', 'Sure:\n```json\n{"a": 1}\n```\nbye', 'so {"a": 1} there'):
        assert json.loads(one(spark, T.reply_json(F.col("t")), t=reply)) == {"a": 1}
    assert one(spark, T.prompt_version(F.col("t")), t="x\npromptVersion: 12\n") == 12
    assert one(spark, T.parse_window_id(F.col("t")), t="7:10-21").asDict() == {"movie_id": 7, "start_seq": 10, "end_seq": 21}
    with pytest.raises(Exception, match="malformed window id"):
        one(spark, T.parse_window_id(F.col("t")), t="7:x")


def test_srt(spark):
    body = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\n<i>Hello</i>\r\nthere\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n{\\an8}Bye\r\n\r\njunk\r\n"
    odd = "42\n\n17\n"
    spaced = "3\n00:00:05,000 --> 00:00:06,000\nOne\n   \nTwo\n\n00:00:07,000 --> 00:00:08,000\nNo number\n\nno time\n12\n"
    files = spark.createDataFrame([(1, body), (2, odd), (3, ""), (4, spaced)], "movie_id int, value string")
    got = [(r.movie_id, r.idx, r.text) for r in tables.srt_cues(files).orderBy("movie_id", "idx").collect()]
    assert got == [(1, 0, "Hello there"), (1, 1, "Bye"), (1, 2, "junk"), (4, 0, "One Two"), (4, 1, "No number"), (4, 2, "no time 12")]


def test_store_last_wins_and_torn_lines(spark, tmp_path):
    lines = ['{"windowId":"1:0-5","valid":false}', '{"windowId":"1:0-5","valid":true}', '{"movieId":3,"valid":true}', '{"windowId":"1:6', ""]
    (tmp_path / "store.jsonl").write_text("\n".join(lines))
    rows = tables.read_store(spark, str(tmp_path / "store.jsonl"), "windowId string, movieId long, valid boolean").collect()
    assert {(r.windowId, r.movieId, r.valid) for r in rows} == {("1:0-5", None, True), (None, 3, True)}


def test_matrix(spark, tmp_path):
    x = np.arange(12, dtype="<f4")
    (tmp_path / "m.bin").write_bytes(x.tobytes())
    assert [r.vec for r in tables.read_matrix(spark, str(tmp_path / "m.bin"), 4).orderBy("row").collect()] == x.reshape(3, 4).tolist()
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.bin").write_bytes(x[:8].tobytes()), (tmp_path / "many" / "b.bin").write_bytes(x[8:].tobytes())
    both = tables.read_matrix(spark, str(tmp_path / "many"), 4, 3).orderBy("file", "row").collect()
    assert [(r.file[-5:], r.row, r.vec) for r in both] == [("a.bin", 0, [0, 1, 2, 3]), ("a.bin", 1, [4, 5, 6, 7]), ("b.bin", 0, [8, 9, 10, 11])]
    for dim, count in ((5, None), (4, 2)):
        with pytest.raises(ValueError):
            tables.read_matrix(spark, str(tmp_path / "m.bin"), dim, count)
    rows = spark.createDataFrame([(0,), (1,)], "row long")
    good = spark.createDataFrame([(0, 0.5), (1, 0.25)], "row long, generic double")
    assert [r.generic for r in tables.aligned_scores(rows, good).orderBy("row").collect()] == [0.5, 0.25]
    assert [r.generic for r in tables.aligned_scores(rows, good.limit(1)).collect()] == [0.0, 0.0]


def test_publish(spark, tmp_path):
    df = spark.range(3)
    tables.publish(df, str(tmp_path), "t")
    assert tables.current(spark, str(tmp_path), "t").count() == 3
    with pytest.raises(ValueError):
        tables.publish(df.limit(0), str(tmp_path), "t")
    assert tables.current(spark, str(tmp_path), "t").count() == 3
    for n in (4, 5, 6):
        tables.publish(spark.range(n), str(tmp_path), "t")
        assert tables.current(spark, str(tmp_path), "t").count() == n
    assert sorted(p.name[:11] for p in (tmp_path / "t").iterdir()) == ["v-000000003", "v-000000004"]
    tables.publish(df.limit(0), str(tmp_path), "t", allow_empty=True)
    assert tables.current(spark, str(tmp_path), "t").count() == 0


def test_pages(spark):
    page = '<div class="x content-script y"><div>in</div>One<br>Two &amp;amp; &lt;b&gt;three&lt;/b&gt;<br/> <br>&#39;q&#39;</div>out'
    assert pages.inner_div(page, "content") == page[page.index("<div>in") : -len("</div>out")]
    assert one(spark, pages.break_cues(F.col("t")), t="One<br>Two &amp;#39; &lt;b&gt;x<br/> <br>&hellip;") == ["One", "Two &#39; x", "..."]
    assert one(spark, pages.sentence_cues(F.col("t")), t="1 Part 1 JUSTINE Sir. I came! <i>Why</i>? x") == ["Sir.", "I came!", "Why ?"]
    assert one(spark, pages.heading_year(F.col("t")), t="<h1>Up (2009)</h1>") == 2009
    assert one(spark, pages.slug(F.col("t")), t="It's a Wonderful Life") == "Its_a_Wonderful_Life"


def test_screenplay(spark):
    script = "<pre>\n<b>INT. HOUSE - DAY</b>\n\n                    JOHN (V.O.)\n          Hello (beat) there.\n          More.\n\nHe walks.\n\n                    MARY O'NEIL\n          Hi!\n</pre><pre>x</pre>"
    lines = pages.screenplay_lines(spark.createDataFrame([(1, script)], "script_id long, html string"))
    got = [(r.character, r.text) for r in pages.dialogue(lines).orderBy("block").collect()]
    assert got == [("John", "Hello there. More."), ("Mary O'Neil", "Hi!")]


def test_cleaning(spark):
    cases = {
        "MAN: Hello [door] there": "Hello there", "bYou've been great./b": "You've been great.", "l'm feeIing fine": "I'm feeling fine", "weren 't you": "weren't you",
        "Manure ! I hate": "Manure! I hate", "WOMAN:": "", 'Say "what" again': "Say what again",
    }
    for raw, want in cases.items():
        assert one(spark, cues.clean_cue(F.col("t")), t=raw) == want


def film_of(spark, texts, **more):
    return spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "movie_id long, idx int, text string")


def test_utterances(spark):
    texts = ["Hello there", "my friend.", "- Who is it?", "- Me - You?", "[THUNDER", "ROLLING]", "♪ la la", "♪ lo lo", "Back now.", "Get busy living...", "...or get busy dying."]
    rows = cues.utterances(film_of(spark, texts)).orderBy("seq").collect()
    assert [r.text for r in rows] == ["Hello there my friend.", "Who is it?", "Me", "You?", "Back now.", "Get busy living... or get busy dying."]
    assert (rows[0].lyrics, rows[0].empty) == (4, 0)  # the island reaches over unpunctuated directions
    assert [r.arc for r in rows][0] == 0 and [r.arc for r in rows][-1] == 1


def test_long_text():
    text = " ".join(f"Sentence number {k} goes on a while." for k in range(30))
    parts = cues.long_pieces(text)
    assert max(map(len, parts)) <= 280 and " ".join(parts) == text
    assert max(map(len, cues.long_pieces("word " * 200))) <= 280


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a. ", "bb, ", "ccc ", "d" * 90 + " ", "e! "]), max_size=60))
def test_long_text_keeps_all(parts):
    text = "".join(parts).strip()
    out = cues.long_pieces(text)
    assert "".join(out).replace(" ", "") == text.replace(" ", "") and all(len(p) <= 280 for p in out)


def test_lyric_islands(spark):
    mask = lambda t: [r.lyric for r in cues.lyric_islands(film_of(spark, t)).orderBy("idx").collect()]
    assert mask(["# one", "Two.", "# three", "Four."]) == [True, True, True, False]
    assert mask(["lead in", "♪ x", "tail", "Done."]) == [True, True, True, False]
    assert mask(['"Quoted"', "Plain."]) == [False, False]
    assert mask(['"Sung a"', '"Sung b"', "Plain."]) == [True, True, False]



def test_verse_mask():
    verse = [f"Line of a song {k}" for k in range(18)]
    talk = [f"Talk {k}." for k in range(60)]
    mask = cues.verse_mask(talk[:30] + verse + talk[30:])
    assert sum(mask) >= 18 and not any(mask[:30])
    assert not any(cues.verse_mask(verse))


def test_brackets_across_cues(spark):
    rng = random.Random(3)
    for _ in range(3):
        texts = ["".join(rng.choice("ab[] ") for _ in range(rng.randrange(8))) for _ in range(12)]
        want, open_ = [], False
        for t in texts:
            out = ""
            for ch in t:
                if open_:
                    open_ = ch != "]"
                elif ch == "[":
                    open_ = True
                else:
                    out += ch
            want.append(" ".join(out.split()))
        got = [r.text for r in cues.strip_directions(film_of(spark, texts)).orderBy("idx").collect()]
        assert got == want


def test_beats(spark):
    sizes = [1, 8, 11, 12, 13, 25, 99, 100, 200]
    lines = spark.createDataFrame([(n, k, f"t{k}") for n in sizes for k in range(n)], "movie_id long, seq long, text string")
    rows = ladder.beats(lines).collect()
    for n in sizes:
        own = sorted((r for r in rows if r.movie_id == n), key=lambda r: r.idx)
        assert {s for r in own for s in range(r.start_seq, r.end_seq + 1)} == set(range(n))
        assert [r.start_seq for r in own] == [6 * k for k in range(len(own))] and own[-1].end_seq == n - 1
        assert [r.arc for r in own] == sorted(r.arc for r in own)
        assert all(r.text.split("\n") == [f"t{k}" for k in range(r.start_seq, r.end_seq + 1)] for r in own)


@pytest.mark.parametrize("sims, n, first", [([0.9] * 9, 10, (0, 9)), ([0.9, 0.9, 0.9, 0.2, 0.9, 0.9], 7, (0, 3)), ([], 1, (0, 0)), ([], 0, (0, -1))])
def test_cuts(spark, sims, n, first):
    films = spark.createDataFrame([(k, s, c) for k, (s, c) in enumerate([(sims, n), ([0.95] * 50, 51)])], "k int, s array<double>, n int")
    low = F.when(F.col("k") == 0, float(np.mean(sims) - np.std(sims)) if sims else None).otherwise(0.95)
    got, long = (r.x for r in films.select("k", ladder.cut_points(F.col("s"), F.col("n"), low).alias("x")).orderBy("k").collect())
    assert (got[0]["start"], got[0]["end"]) == first
    assert all(e["end"] - e["start"] < 13 for e in long) and long[-1]["end"] == 50
    assert all(b["start"] == a["end"] + 1 for a, b in zip(long, long[1:]))


def brute_segments(sims, n):
    cut, start, out = np.mean(sims) - np.std(sims) if len(sims) else 0.0, 0, []
    for i, s in enumerate(sims):
        if (s < cut and i + 1 - start >= 2) or i + 1 - start >= 12:
            out.append((start, i))
            start = i + 1
    if n - start < 2 and out:
        out[-1] = (out[-1][0], n - 1)
    else:
        out.append((start, n - 1))
    return out


def test_segments_against_brute_force_on_long_films(spark):
    import time

    rng = np.random.default_rng(5)
    sizes = {1: 1, 2: 2, 3: 3, 4: 13, 5: 40, 6: 2000, 7: 2000}
    vecs = {m: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((n, 4)) + 1) for m, n in sizes.items()}
    rows = [(m, i, v.tolist()) for m, x in vecs.items() for i, v in enumerate(x)]
    windows = spark.createDataFrame(rows, "movie_id long, idx long, vec array<double>")
    began = time.time()
    got = {}
    for r in sorted(ladder.segment_spans(windows).collect()):
        got.setdefault(r.movie_id, []).append((r.start_beat, r.end_beat))
    assert time.time() - began < 20
    assert got == {m: brute_segments((x[:-1] * x[1:]).sum(1), len(x)) for m, x in vecs.items()}


def test_decile_and_rank(spark):
    scored = spark.createDataFrame([(k, 10.0 if k in (3, 7) else 90.0) for k in range(20)], "movie_id long, score double")
    assert {r.movie_id for r in quality.worst_decile(scored).where("downrank").collect()} == {3, 7}
    values = spark.createDataFrame([(1, v) for v in (5, 1, 9, 7)], "k int, v int")
    assert quality.nearest_rank(values, ["k"], "v", 0.5).first()["v"] == 5


def test_quality_prefers_clean(spark):
    clean = ["This is the line that we know."] * 20
    broken = ['wh"t lf l am feII d"wn'] * 20
    rows = spark.createDataFrame([(1, t) for t in clean] + [(2, t) for t in broken], "movie_id long, text string")
    words = spark.createDataFrame([(w,) for w in "this is the line that we know".split()], "word string")
    s = {r.movie_id: r.score for r in quality.score_films(rows, words).collect()}
    assert s[1] > s[2] + 20


def test_cliff(spark):
    def strong(scores):
        return retrieval.score_cliff(spark.createDataFrame(list(enumerate(scores)), "position int, score double")).first()["strong"]

    assert strong([1.0, 0.9, 0.3, 0.29]) == 2 and strong([1.0, 0.9, 0.8, 0.7]) == 4 and strong([1.0, 0.1]) == 2


def test_moments_and_merge(spark):
    beats = spark.createDataFrame([(m, i, 6 * i, 6 * i + 11, 0.1 * i, "a\nb\nc\nd\ne", [1.0, float(i + m) / 10]) for m in range(3) for i in range(3)], "movie_id long, idx long, start_seq long, end_seq long, arc double, text string, vec array<double>")
    movies = spark.createDataFrame([(m, f"t{m}", 2000) for m in range(3)], "id long, title string, year int")
    flags = spark.createDataFrame([(2, True, False)], "movie_id long, non_english boolean, downrank boolean")
    found = retrieval.moments(beats, beats.select("movie_id", "start_seq", "end_seq", "vec"), flags, movies, F.array(F.lit(1.0), F.lit(0.0)))
    rows = found.collect()
    assert len(rows) == 3 and all(r.text == "a\nb\nc\n…" for r in rows)
    hits = spark.createDataFrame([(0, "t0", 2000, 0, 0.0, "x", 0.5)], found.schema)
    assert retrieval.with_moments(hits, found).count() == 3


def test_search_has_all_arms(spark):
    movies = spark.createDataFrame([(m, f"Film {m}", 2000, 10 - m) for m in range(4)], "id long, title string, year int, votes long")
    said = [(0, "we meet again"), (1, "again we meet"), (2, "so long"), (3, "a fine day")]
    lines = spark.createDataFrame([(m, 0, 0.0, t, t, [1.0, float(m)]) for m, t in said], "movie_id long, seq long, arc double, text string, text_norm string, vec array<double>")
    beats = spark.createDataFrame([(m, 1, 6, 17, 0.5, "a\nb", [1.0, 0.1 * m]) for m in range(4)], "movie_id long, idx long, start_seq long, end_seq long, arc double, text string, vec array<double>")
    flags = spark.createDataFrame([(3, True, False)], "movie_id long, non_english boolean, downrank boolean")

    def found(query):
        out = retrieval.search(lines, movies, query, F.array(F.lit(1.0), F.lit(3.0)), beats=beats, summaries=beats, quality=flags)
        return [(x.kind, x.movie_id, x.seq) for x in out.orderBy("position").collect()]

    exact = found("We meet")
    assert exact[:2] == [("line", 0, 0), ("line", 1, 0)] and {x[0] for x in exact} == {"line"} and len(exact) == 4  # two by meaning
    titled = found("film 2")
    assert titled[0] == ("title", 2, None) and {x[0] for x in titled[1:]} == {"line", "moment"}
    assert ("line", 3, 0) in titled and ("moment", 0, 6) in titled
    assert found(" ?! ") == []


def test_bridge(spark):
    rng = np.random.default_rng(0)
    shared = np.eye(8)
    rows = []
    for m in (1, 2):
        for i in range(6):
            v = shared[i] + 0.05 * rng.standard_normal(8)
            rows.append((m, i, 12 * i, 12 * i + 11, i / 6, (v / np.linalg.norm(v)).tolist(), 0.1))
    w = spark.createDataFrame(rows, "movie_id long, idx long, start_seq long, end_seq long, arc double, vec array<double>, generic double")
    flags = spark.createDataFrame([(9, True, False)], "movie_id long, non_english boolean, downrank boolean")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    told = spark.createDataFrame([(1, 0, 11, "First"), (1, 0, 12, "other span"), (2, 12, 23, "")], "movie_id long, start_seq long, end_seq long, headline string")
    said = w.withColumn("text", F.concat_ws("\n", F.lit("a"), "idx", F.lit("c"), F.lit("d")))
    got = film.bridge(w, said, pairs, flags, told).orderBy("n").collect()
    assert len(got) == 5 and all(r.ia == r.ib for r in got) and len({r.beat_a for r in got}) == 5
    assert all(r.excerpt_a == f"a {r.beat_a} c" and r.arc_b == pytest.approx(r.beat_b / 6) and r.start_a == 12 * r.beat_a for r in got)
    assert all((r.headline_a, r.headline_b) == ("First" if r.ia == 0 else None, None) for r in got)
    assert sorted(map(tuple, film.bridge(w, said, pairs, flags, stop_at_weak=True).select("ia", "ib").collect())) == sorted((r.ia, r.ib) for r in got)
    assert film.generic_of(w.drop("generic")).first()["generic"] == 0.0
    assert film.bridge(w, w, pairs, flags.withColumn("movie_id", F.lit(1).cast("long"))).count() == 0
    stored = spark.createDataFrame([(2, 1, 0.9)], "movie_id long, similar_id long, score double")
    assert film.pair_similarity(stored, 1, 2).first()["score"] == 0.9 and film.pair_similarity(stored, 1, 3).first()["score"] == 0.0


def test_panel(spark):
    lines = spark.createDataFrame([(1, k, f"l{k}") for k in range(40)], "movie_id long, seq long, text string")
    spans = spark.createDataFrame([(1, 0, 0, 19), (1, 1, 6, 39)], "movie_id long, idx long, start_seq long, end_seq long")
    summaries = spark.createDataFrame([(1, 6, 39, "Head")], "movie_id long, start_seq long, end_seq long, headline string")
    panel = film.scene_panel(spans, spans, lines, summaries, 1, 22)
    assert panel["summary"].first()["headline"] == "Head"
    e = panel["evidence"].first()
    assert (e.kind, len(e.lines), e.total_lines) == ("segment" if False else 0, 25, 34)
    assert film.scene_panel(spans.limit(0), spans.limit(0), lines, summaries, 1, 5)["evidence"].first()["lines"] == ["l5"]


def test_lint(spark):
    rows = [
        (1, "A talk", "Then Luke fights the Empire.", [(1, 3)], 0, 9, ["luke and the empire"], "Star"),
        (2, "A talk", "Then Gandalf comes.", [(12, 14)], 0, 9, ["nothing"], "Star"),
        (3, "x" * 91, "She leaves.", [], 0, 9, ["nothing"], None),
    ]
    schema = "id long, headline string, summary string, evidence array<struct<start:int,end:int>>, start_seq int, end_seq int, texts array<string>, title string"
    got = {r.id: {(i.kind, i.detail) for i in r.issues} for r in genstore.lint(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: set(), 2: {("bad-range", "12-14"), ("invented-noun", "Gandalf")}, 3: {("no-evidence", ""), ("bad-range", "headline")}}
    window = ([(100, 101)], 100, 111, ["You come to me on the day of my wedding.", "I ask for justice."], "The Godfather")
    said = {
        "A man asks for justice on a wedding day.": set(), 'A man pleads. They refuse, saying "Never again." He walks out.': set(),
        "A man petitions Corleone for justice.": {"Corleone"}, "A wedding-day plea from the Godfather.": set(), "One (Vito) says, But When This is over": {"Vito"},
        "Sonny waits! Then Sonny talks; “Why” Sonny asks": {"Sonny"}, "A word O'Hara and McCoy": {"Mc"},
    }
    rows = [(k, "It begins", s, *window) for k, s in enumerate(said)]
    got = {r.summary: {i.detail for i in r.issues} for r in genstore.lint(spark.createDataFrame(rows, schema)).collect()}
    assert got == said


def test_batches_queue_and_candidates(spark):
    w = spark.createDataFrame([(1, k, ["x" * 100] * 3) for k in range(30)], "movie_id long, idx long, texts array<string>")
    got = sorted((r.idx, r.batch) for r in genstore.batches(w).collect())
    assert [b for _, b in got] == [k // 12 for k in range(30)]
    assert len({r.batch for r in genstore.batches(w, budget=400).collect()}) == 30
    films = spark.createDataFrame([(m, k, ["x" * 76] * n) for m, k, n in ((1, 0, 2), (1, 1, 3), (2, 0, 20), (2, 1, 1))], "movie_id long, idx long, texts array<string>")
    assert [r.batch for r in genstore.batches(films, budget=1000).orderBy("movie_id", "idx").collect()] == [0, 0, 1, 2]
    numbered = spark.createDataFrame([(1, [f"{k:076d}" for k in range(20)]), (2, ["y" * 5000])], "movie_id long, texts array<string>")
    cut = {r.movie_id: r.texts for r in genstore.trimmed(numbered, 1000).collect()}
    assert [int(t) for t in cut[1]] == [0, 1, 2, 3, 4, 5, 6, 17, 18, 19] and len(cut[2]) == 2  # one line is its own head and tail
    saved = spark.createDataFrame([(1, "a", "done", 2)], "movie_id long, title string, status string, attempts int")
    merged = genstore.queue_merge(saved, spark.createDataFrame([(1, "a"), (2, "b")], "movie_id long, title string"))
    assert {(r.movie_id, r.status) for r in merged.collect()} == {(1, "done"), (2, "pending")}
    files = [(1, 1, True, True, 99, 2000, 2000), (1, 2, False, False, 5, None, 2000), (1, 3, False, True, 1, 2001, 2000), (1, 4, False, True, 9, 2005, 2000)]
    schema = "movie_id long, file_id long, hearing_impaired boolean, from_trusted boolean, download_count long, year int, film_year int"
    assert genstore.best_candidates(spark.createDataFrame(files, schema)).first()["file_id"] == 3


def test_genericness_masks_own_film(spark):
    rng = np.random.default_rng(1)
    rows = [(m, i, rng.standard_normal(4).tolist()) for m in range(2) for i in range(20)]
    w = spark.createDataFrame(rows, "movie_id long, idx long, vec array<double>")
    raw = {(r.movie_id, r.idx): r.raw for r in corpus.genericness(w).collect()}
    x = np.array([r[2] for r in rows])
    other = np.sort((x @ x.T)[0, 20:])[::-1]
    assert raw[0, 0] == pytest.approx(np.sort(np.concatenate((other, [-1.0] * 20)))[::-1][:32].mean())
    with pytest.raises(ValueError):
        corpus.genericness(w.limit(10))


def test_vector_sample_is_bounded_and_steady(spark):
    rows = [(m, i, [float(m), float(i), 1.0]) for m in range(30) for i in range(20)]
    w = spark.createDataFrame(rows, "movie_id long, idx long, vec array<double>")
    one, two = (corpus.vector_sample(d, 50) for d in (w, w.repartition(7)))
    assert len(one) == 50 and sorted(map(tuple, one["vec"])) == sorted(map(tuple, two["vec"])) and one["movie_id"].nunique() > 10
    assert len(corpus.vector_sample(w, 10_000)) == 600
    scored = corpus.genericness(w, one).collect()
    assert len(scored) == 600 and all(0 <= r.generic <= 1 for r in scored)


def test_slice(spark):
    movies = spark.createDataFrame([(m, m * 10) for m in range(1, 6)], "id long, votes long")
    scripts, rescued = spark.createDataFrame([(1,), (3,), (5,)], "movie_id long"), spark.createDataFrame([(2,), (5,)], "movie_id long")
    assert [r.id for r in titles.slice_of(movies, scripts, 2, rescued).collect()] == [5, 3]
    assert [r.id for r in titles.slice_of(movies, scripts, None, rescued).collect()] == [5, 3, 2, 1]


def test_logs(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "q", "q", 70000, 1, True, 1.5, "v"), ("2024-06-01 00:00:00", " ", " ", 0, 0, False, 9e9, "v"), ("2024-07-01 00:00:00", "z", "z", 0, 0, False, 9e9, "w")]
    schema = "ts string, query string, query_norm string, hits int, strong int, had_movie boolean, took_ms double, visitor string"
    events = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))
    log = analytics.search_log(events)
    assert [(r.hits, r.took_ms) for r in log.orderBy("ts").collect()] == [(65535, 2), (0, 65535)]
    assert analytics.retained(log, F.to_timestamp(F.lit("2024-07-02"))).count() == 1
    source = str(tmp_path / "in")
    events.write.parquet(source)
    for _ in range(2):
        logs.search_log(logs.read(spark, source, events.schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert logs.daily_uniques(logs.read(spark, source, events.schema)).isStreaming


def test_best_matches_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(m, i, rng.standard_normal(5).tolist()) for m in range(4) for i in range(9)]
    s = spark.createDataFrame(rows, "movie_id long, idx long, vec array<double>")
    want = {(a, i, b): max(np.dot(u, v) for c, _, v in rows if c == b) for a, i, u in rows for b in range(4) if a != b}
    for block in (7, 2048):
        got = {(r.movie_id, r.idx, r.other): r.best for r in corpus.best_matches(s, block).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_titles_resolve_in_order(spark):

    index = spark.createDataFrame([("a", "Alien"), ("b", "Blade Runner: The Final Cut"), ("c", "The Thing")], "slug string, title string")
    aliases = spark.createDataFrame([("Das Ding", "Thing")], "alias string, title string")
    wanted = spark.createDataFrame([(1, "ALIEN"), (2, "Blade Runner"), (3, "Das Ding"), (4, "Nothing")], "id long, title string")
    assert {(r.id, r.way, r.slug) for r in titles.resolve(wanted, index, aliases).collect()} == {(1, 0, "a"), (2, 4, "b"), (3, 1, "c")}
    index = spark.createDataFrame([("a", "Star Wars: A New Hope"), ("b", "Star Wars: The Clone Wars"), ("c", "Runner"), ("d", "My Blade Runner")], "slug string, title string")
    wanted = spark.createDataFrame([(1, "New Hope"), (2, "A New Hope"), (3, "Clone Wars"), (4, "Blade Runner"), (5, "Blade Runner 2049"), (6, "Run")], "id long, title string")
    # a longer title is never cut to meet a shorter entry, and short ones meet whole keys only
    assert {(r.id, r.way, r.slug) for r in titles.resolve(wanted, index, aliases).collect()} == {(3, 3, "b"), (4, 4, "d")}
    tried = spark.createDataFrame([(1, "t", "pending", 2), (2, "t", "pending", 0), (3, "t", "pending", 0), (4, "t", "done", 1)], "movie_id long, title string, status string, attempts int")
    outcomes = spark.createDataFrame([(1, "failed"), (2, "found"), (3, "no-match")], "movie_id long, outcome string")
    assert sorted((r.movie_id, r.status, r.attempts) for r in titles.after_run(tried, outcomes).collect()) == [(1, "parked", 3), (2, "done", 1), (3, "no-match", 1), (4, "done", 1)]
    old = spark.createDataFrame([(1, 50.0), (2, 50.0)], "movie_id long, score double")
    new = spark.createDataFrame([(1, "x", 40.0), (2, "draft", 40.0), (3, "x", 1.0)], "movie_id long, kind string, score double")
    assert {(r.movie_id, r.replace) for r in titles.better_layer(old, new, ["draft"]).collect()} == {(1, False), (2, True), (3, True)}
    queue = spark.createDataFrame([(1, "pending", 3), (2, "pending", 1), (3, "done", 0), (4, "pending", 0)], "movie_id long, status string, attempts int")
    assert [r.movie_id for r in titles.due(queue, 5).collect()] == [4, 2]
