import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.api import Library, checked_film, checked_place
from parley.functions import misquotes
from parley.operators import retrieval


@pytest.fixture(scope="module")
def library(spark):
    rng = np.random.default_rng(1)
    lines = [(m, s, s / 29, f"line {s} of film {m}" + (" the end" if s == 7 else "")) for m in range(1, 11) for s in range(30)]
    lines += [(m, 30, 1.0, "Play it again for me" if m == 2 else "we all say this one") for m in range(1, 11)]
    rows = [(m, i, 6 * i, 6 * i + 11, i / 4, f"beat {i}\nof {m}", (lambda v: v / np.linalg.norm(v))(np.eye(8)[i] + 0.1 * rng.standard_normal(8)).tolist()) for m in range(1, 11) for i in range(5)]
    frame = spark.createDataFrame
    line = frame(lines, "movie_id long, seq long, arc double, text string").withColumn("text_norm", F.lower("text"))
    beats = frame(rows, "movie_id long, idx long, start_seq long, end_seq long, arc double, text string, vec array<double>")
    spans = beats.select("movie_id", "idx", "start_seq", "end_seq", "arc", "vec")
    return Library(
        movies=frame([(m, f"Film {m}", 1990 + m, 100 - m, 1990) for m in range(1, 11)], "id long, title string, year int, votes long, decade int"), lines=line, beats=beats,
        segments=spans, summaries=spans.select("movie_id", "start_seq", "end_seq", F.concat(F.lit("scene "), "idx").alias("headline")),
        quality=frame([(9, True, False)], "movie_id long, non_english boolean, downrank boolean"), pairs=frame([(1, 1, 2, 0.9), (1, 2, 3, 0.8)], "movie_id long, rank int, similar_id long, score double"),
        picks=frame([(1, [0, 4, 7])], "movie_id long, seqs array<long>"), misquotes=misquotes.table(spark),
        line_vectors=line.where("seq = 1").join(beats.where("idx = 0").select("movie_id", "vec"), "movie_id"), summary_vectors=spans,
    )


def vec(k):
    return F.array(*(F.lit(1.0 if i == k else 0.0) for i in range(8)))


def test_search(library):
    found = library.search("We all say this one", vec(0), 8).collect()
    phrase = [r for r in found if r.kind == "phrase"]
    assert len(phrase) == 1 and (phrase[0].title, phrase[0].year, phrase[0].seq, phrase[0].score) == ("Film 1", 1991, 9, 9.0)
    shown = sorted((r for r in found if r.kind == "line"), key=lambda r: r.position)
    assert [r.movie_id for r in shown[:9]] == [1, 3, 4, 5, 6, 7, 8, 9, 10] and all(r.strong for r in shown[:9]) and not shown[9].strong
    assert not any(r.near_miss for r in shown) and not any(r.kind == "moment" for r in found)
    said = library.search("Play it again, Sam", vec(0), 8).collect()
    assert [(r.title, r.year) for r in said if r.kind == "misquote"] == [("Casablanca", 1942)]
    assert not any(r.near_miss for r in said) and any(r.kind == "moment" for r in said) and not any(r.kind == "phrase" for r in said)
    assert {r.kind for r in library.search("nothing like it", vec(0), 4).collect()} == set()  # another dimension: those arms stay off
    assert library.search("film 3").where("kind = 'title'").first()["movie_id"] == 3
    assert library.search("?!").count() == 0


def test_near_miss(library, spark):
    """A line found by meaning alone, a word off."""
    lines = library.lines.where("movie_id = 4 AND seq = 0").withColumn("text", F.lit("You shall not pass here!"))
    vectors = lines.withColumn("vec", vec(0))
    asked = lambda q: retrieval.search(lines.limit(0), library.movies, q, vec(0), vectors=vectors, misquotes=library.misquotes).collect()
    assert [(r.kind, r.near_miss) for r in asked("you shall not walk here")] == [("line", True)]
    assert [(r.kind, r.near_miss) for r in asked("you shall not pass here")] == [("line", False)]
    assert [(r.kind, r.near_miss) for r in asked("quite another thing")] == [("line", False)]


def test_arm_gate(library):
    assert retrieval.arm_is_usable(library.beats, 8) and not retrieval.arm_is_usable(library.beats, 9) and not retrieval.arm_is_usable(library.beats.limit(0), 8)
    assert retrieval.film_count(library.movies) == 10


def test_pages(library):
    panel = library.neighbours(1, "8")
    assert panel["summary"].first()["headline"] == "scene 0" and panel["evidence"].first()["total_lines"] == 12
    near = panel["moments"].collect()
    assert len(near) == 8 and {r.movie_id for r in near}.isdisjoint({1, 9})
    assert library.neighbours(1, 8, 2)["summary"].first()["headline"] == "scene 2"
    page = library.film("1")
    assert page["header"].first()["line_count"] == 31 and [r.seq for r in page["five_lines"].orderBy("seq").collect()] == [0, 4, 7]
    assert page["segments"].count() == 5 and [r.title for r in page["similar"].orderBy("rank").collect()] == ["Film 2", "Film 3"]
    both = library.versus(1, 2)
    assert both["pairs"].count() >= 2 and both["pairs"].agg(F.max("width")).first()[0] <= 8 and both["ambience"].first()["n"] == 25
    assert both["similarity"].first()["score"] == 0.9
    assert library.versus(1, 9)["pairs"].count() == 0


def test_checked():
    assert checked_film("12") == 12 and checked_place(0) == 0
    for wrong in (0, -1, "1.5", "x", "", "٣", True):
        with pytest.raises(ValueError):
            checked_film(wrong)
    for wrong in (-1, "1.5", ""):
        with pytest.raises(ValueError):
            checked_place(wrong)
