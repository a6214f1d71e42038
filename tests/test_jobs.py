"""The jobs end to end on a small made-up library."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley import jobs
from parley.operators import cues
from parley.sources import pages, tables


def words(spark):
    return spark.createDataFrame([(w,) for w in "we know what you said about the road home and it was not a lie".split()], "word string")


SAID = ["We know what you said.", "It was not a lie.", "What about the road home?", "You said it was."]


def test_transcripts(spark):
    broken = "<div class='x'>no</div><div class=\"scrolling-script-container\">" + "<br>".join(SAID * 3) + "</div><br>outside"
    plain = '<div class="scrolling-script-container"> ' + " ".join(SAID * 3) + " </div>"
    made = jobs.extract(spark.createDataFrame([(1, broken), (2, plain), (3, "<p>no container</p>"), (4, '<div class="scrolling-script-container">one<br>two</div>')], "movie_id long, html string"), least=12)
    got = {}
    for r in made["cues"].orderBy("movie_id", "idx").collect():
        got.setdefault(r.movie_id, []).append(r.text)
    assert got[1] == SAID * 3 and got[2] == SAID * 3 and 3 not in got and got[4] == ["one", "two"]
    assert sorted(map(tuple, made["report"].collect())) == [(1, 12, False, False), (2, 12, True, False), (3, 0, False, True), (4, 2, False, True)]


def test_rescues(spark):
    movies = spark.createDataFrame([(1, "A", 1999, 5), (2, "B", 2001, 9), (3, "C", 2001, 1), (4, "D", 1950, 0)], "id long, title string, year int, votes long")
    have = spark.createDataFrame([(3,)], "movie_id long")
    body = "".join(f"          ANN\n   {s}\n\n" for s in SAID) + "          ANN\n   EVERYBODY RUNS AWAY NOW!\n\n"
    scripts = spark.createDataFrame([(1, f"<pre>{body}</pre>"), (3, f"<pre>{body}</pre>")], "movie_id long, html string")
    got = jobs.rescue_screenplays(movies, have, scripts, least=4).orderBy("idx").collect()
    assert {r.movie_id for r in got} == {1} and [r.text for r in got] == SAID
    assert jobs.rescue_screenplays(movies, have, scripts, least=9).count() == 0
    cue = "".join(f'<div class="subtitle-cue"><p>{s}</p><p>&#89;es <i>x</i>&amp;.</p></div>' for s in SAID)
    cue = f'<div class="subtitle-cue"><p>outside</p></div><div class="full-script">{cue}<div class="other"><p>no</p></div></div>'
    subtitles = spark.createDataFrame([(1, f"<h1>A (2002)</h1>{cue}"), (2, f"<h1>B (2002)</h1>{cue}"), (3, f"<h1>C (2001)</h1>{cue}"), (4, f"<h1>D</h1>{cue}")], "movie_id long, html string")
    got = jobs.rescue_subtitle_pages(movies, have, subtitles, least=4).orderBy("idx").collect()
    assert {r.movie_id for r in got} == {2, 4} and [r.text for r in got if r.movie_id == 2] == [f"{s} Yes x &." for s in SAID]


def test_upgrades(spark):
    frame = spark.createDataFrame
    movies = frame([(k,) for k in range(1, 21)], "id long")
    scores = frame([(k, 95.0 if k < 19 else 10.0) for k in range(1, 21)], "movie_id long, score double")
    found = frame([(m, i, s) for m in (1, 2, 5, 19) for i, s in enumerate(SAID)], "movie_id long, idx int, text string")
    bad = frame([(20, 0, "lf l wh\"t zz"), (20, 1, "qq")], "movie_id long, idx int, text string")
    better = jobs.upgrade(scores, frame([(2,)], "movie_id long"), frame([(5,)], "movie_id long"), found.unionByName(bad), words(spark), movies, least=2)
    assert {r.movie_id for r in better.collect()} == {2, 5, 19}  # named, a draft, and better than its old score; 20 is worse still
    saved = frame([(1, "a", "done", 1), (2, "b", "pending", 2)], "movie_id long, title string, status string, attempts int")
    files = frame([(m, f"1\n00:00:01,000 --> 00:00:02,000\nHello {m}\n") for m in range(1, 5)], "movie_id long, value string")
    outcomes = frame([(2, "failed"), (3, "found"), (4, "found")], "movie_id long, outcome string")
    run = jobs.upgrade_queue(saved, frame([(3, "c"), (4, "d")], "movie_id long, title string"), outcomes, files, 2)
    assert [r.movie_id for r in run["due"].collect()] == [3, 4]
    assert {(r.movie_id, r.status) for r in run["queue"].collect()} == {(1, "done"), (2, "pending"), (3, "done"), (4, "done")}
    assert {r.text for r in run["cues"].collect()} == {"Hello 1", "Hello 3", "Hello 4"}


@pytest.fixture(scope="module")
def film(spark):
    base = spark.createDataFrame([(m, i, SAID[i % 4] + f" {m} {i}.") for m in (1, 2) for i in range(180)], "movie_id long, idx int, text string")
    rescue = spark.createDataFrame([(2, i, SAID[i % 4]) for i in range(160)], "movie_id long, idx int, text string")
    films = spark.createDataFrame([(1, False, "Home"), (2, True, None)], "movie_id long, musical boolean, title string")
    made = jobs.make_utterances([("base", base), ("rescue", rescue)], films, words(spark), spark.createDataFrame([(2,), (1,)], "movie_id long"))
    return {name: df.cache() for name, df in made.items()}


def test_utterances_job(film):
    assert {(r.movie_id, r.n) for r in film["lines"].groupBy("movie_id").agg(F.count("*").alias("n")).collect()} == {(1, 180), (2, 160)}
    assert {(r.movie_id, r.source_kind) for r in film["quality"].collect()} == {(1, "transcript"), (2, "draft")}
    report = film["report"].first()
    assert report.films == 2 and report.p50 > 0 and report.lyrics == 0 and film["worst"].count() == 2


def test_ladder_and_generation(spark, film, tmp_path):
    lines = film["lines"].select("movie_id", "seq", "arc", "text")
    rng = np.random.default_rng(3)
    vectors = [(m, i, (lambda v: v / np.linalg.norm(v))(rng.standard_normal(6)).tolist()) for m in (1, 2) for i in range(60)]
    made = jobs.make_ladder(lines, spark.createDataFrame(vectors, "movie_id long, idx int, vec array<double>"))
    made = {name: df.cache() for name, df in made.items()}
    assert made["beats"].where("generic BETWEEN 0 AND 1").count() == made["beats"].count() > 10
    windows = made["windows"].collect()
    assert {r.movie_id for r in windows} == {1, 2} and all(a.score <= b.score for a in windows for b in windows if a.movie_id == b.movie_id and a["rank"] < b["rank"])
    store = spark.createDataFrame([], "movie_id long, start_seq int, end_seq int, input_hash string, prompt_version int, valid boolean, refused boolean, issues array<struct<kind:string,detail:string>>")
    first = jobs.to_generate(lines, made["windows"], store, 3)
    pending = first["pending"].collect()
    assert pending and first["batches"].count() == len(pending)
    kept = spark.createDataFrame(
        [(r.movie_id, r.start_seq, r.end_seq, r.input_hash, 3, k > 0, False, [("bad-range", "x")] if k == 0 else []) for k, r in enumerate(pending[1:])], store.schema
    )
    again = jobs.to_generate(lines, made["windows"], kept, 3)["pending"].collect()
    assert [(r.movie_id, r.start_seq) for r in again] == [(pending[0].movie_id, pending[0].start_seq)]
    repaired = jobs.to_generate(lines, made["windows"], kept, 3, repair=True)["pending"].collect()
    assert [(r.start_seq, r.feedback) for r in repaired] == [(pending[1].start_seq, ["x"])]
    assert jobs.to_generate(lines, made["windows"], kept, 4)["pending"].count() == len(pending)
    slates = jobs.slates(lines, spark.createDataFrame([], "movie_id long, input_hash string, prompt_version int"), 1).collect()
    assert {r.movie_id for r in slates} <= {1, 2} and all(len(r.texts) <= 120 for r in slates)
    jobs.load({"beats": made["beats"], "summary_vectors": made["beats"].limit(0)}, str(tmp_path))
    assert tables.current(spark, str(tmp_path), "beats").count() == made["beats"].count()
    with pytest.raises(ValueError):
        jobs.load({"beats": made["beats"].limit(0)}, str(tmp_path))


def test_title_cards_and_credits(spark):
    rows = [
        ("PROMETHEUS Get Charlie.", "Prometheus", 0.5, "Get Charlie."), ("PROMETHEU5 Get it.", "Prometheus", 0.5, "Get it."), ("STOP! Get down", "Stop", 0.0, "STOP! Get down"),
        ("NASA We have lift", "Other", 0.01, "We have lift"), ("NASA We have lift", "Other", 0.5, "NASA We have lift"), ("THE ROAD I went home", "The Road", 0.9, "I went home"),
        ("AB Go", None, 0.0, "AB Go"), ("plain words", None, 0.0, "plain words"), ("WHO IS IT? He said", "Who Is It", 0.5, "WHO IS IT? He said"),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, text string, title string, place double, want string")
    got = df.select("want", cues.without_title_card(F.col("text"), F.col("title"), F.col("place")).alias("got"), "k").orderBy("k").collect()
    assert [r.got for r in got] == [r.want for r in got]
    texts = [("Directed by a friend", 50, True), ("HELLO WORLD AGAIN", 0, True), ("HELLO WORLD AGAIN", 50, False), ("HELLO WORLD AGAIN", 98, True), ("HELLO WORLD AGAIN", 97, False), ("OK THEN", 0, False)]
    df = spark.createDataFrame([(t, p, w) for t, p, w in texts], "text string, place int, want boolean")
    assert [r.got for r in df.select(cues.is_credit(F.col("text"), F.col("place"), F.lit(100)).alias("got")).collect()] == [w for *_, w in texts]


def test_verse_runs_against_the_rule():
    """A run lasts while four fifths are unpunctuated; capitals count over the cue that ends it."""
    rng = np.random.default_rng(9)

    def rule(ends, caps, music):
        n, out, k = len(ends), [False] * len(ends), 0
        if not n or sum(ends) / n < 0.6:
            return out
        while k < n:
            if ends[k]:
                k += 1
                continue
            stop = next((j for j in range(k, n) if sum(not e for e in ends[k : j + 1]) < 0.8 * (j + 1 - k)), n)
            seen = caps[k : stop + 1]
            if stop - k >= 6 and sum(seen) >= 0.6 * len(seen) and (stop - k >= 16 or any(music[max(0, k - 3) : stop + 3])):
                out[k:stop] = [True] * (stop - k)
            k = stop
        return out

    for _ in range(60):
        ends, at = [], 0
        while at < 150:
            verse = rng.random() < 0.3
            n = int(rng.integers(3, 25))
            ends += [bool(x) for x in rng.random(n) < (0.1 if verse else 0.97)]
            at += n
        caps, music = [bool(x) for x in rng.random(len(ends)) < 0.75], [bool(x) for x in rng.random(len(ends)) < 0.03]
        texts = [("A" if c else "a") + " line" + (" ♪" if m else "") + ("." if e else "") for e, c, m in zip(ends, caps, music)]
        assert cues.verse_mask(texts) == rule(ends, caps, music)


def test_inner_div():
    page = '<div class="a">0</div><DIV id=x class="big box">1<div>2<p>3</p></div>4</div>5<div class="box">6</div>'
    assert pages.inner_div(page, "box") == "1<div>2<p>3</p></div>4"
    assert pages.inner_div('<div class="box">a<div>b', "box") == "a<div>b" and pages.inner_div(page, "ox") is None and pages.inner_div(None, "a") is None
    assert pages.inner_div('<div class="box"></div>x', "box") == ""
