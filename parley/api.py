"""What a page of the library asks for, one call each, with checked parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import film, retrieval

MOST_ASKED = 200


def checked_film(value: int | str) -> int:
    """A film's id: a positive whole number, else an error."""
    text = str(value)
    if not text.isascii() or not text.isdigit() or int(text) <= 0:
        raise ValueError(f"no film id: {value!r}")
    return int(text)


def checked_place(value: int | str) -> int:
    """A place in a film: a whole number from 0, else an error."""
    text = str(value)
    if not text.isascii() or not text.isdigit():
        raise ValueError(f"no place in a film: {value!r}")
    return int(text)


@dataclass
class Library:
    """The tables that pages read; generic is 0 in tables that were made without it."""

    movies: DataFrame
    lines: DataFrame
    beats: DataFrame
    segments: DataFrame
    summaries: DataFrame
    quality: DataFrame
    pairs: DataFrame
    picks: DataFrame
    misquotes: DataFrame | None = None
    line_vectors: DataFrame | None = None
    summary_vectors: DataFrame | None = None

    def search(self, query: str, vec: Column | None = None, dim: int | None = None) -> DataFrame:
        """The whole search; of the query its first 200 characters. Arms whose vectors have another dimension than the query's stay off."""
        fits = lambda table: vec is not None and table is not None and (dim is None or retrieval.arm_is_usable(table, dim))
        moments = fits(self.beats) and fits(self.summary_vectors)
        return retrieval.search(
            self.lines, self.movies, query[:MOST_ASKED], vec if fits(self.line_vectors) else None, vectors=self.line_vectors,
            beats=self.beats if moments else None, summaries=self.summary_vectors, quality=self.quality, misquotes=self.misquotes,
        )

    def neighbours(self, film_id: int | str, seq: int | str, segment: int | str | None = None) -> dict[str, DataFrame]:
        """The panel of a place: summary, evidence, beat, and the nearest moments of other films."""
        movie, at, own = checked_film(film_id), checked_place(seq), None if segment is None else checked_place(segment)
        panel = film.scene_panel(self.segments, self.beats, self.lines, self.summaries, movie, at, own)
        beat = panel["beat"].first()
        if beat is not None:
            vec = self.beats.where((F.col("movie_id") == movie) & (F.col("idx") == beat["idx"])).select("vec").first()["vec"]
            panel["moments"] = film.nearest_beats(self.beats, self.quality, self.movies, movie, F.array(*(F.lit(float(x)) for x in vec)))
        return panel

    def film(self, film_id: int | str) -> dict[str, DataFrame]:
        """A film's header, its five lines, its segments with their headlines, and films like it."""
        movie = checked_film(film_id)
        own = lambda d, c="movie_id": d.where(F.col(c) == movie)
        return {
            "header": film.headers(own(self.movies, "id"), own(self.lines)),
            "five_lines": film.five_lines(own(self.picks), own(self.lines)),
            "segments": film.headlines(own(self.segments), own(self.summaries)),
            "similar": film.similar(own(self.pairs), self.movies),
        }

    def versus(self, a: int | str, b: int | str) -> dict[str, DataFrame]:
        """Two films: their parallel moments with stroke widths, how alike they sound overall, and their stored similarity."""
        one, other = checked_film(a), checked_film(b)
        if one == other:
            raise ValueError("two different films are needed")
        pair = self.movies.sparkSession.createDataFrame([(one, other)], "a long, b long")
        windows, beats = film.generic_of(self.summary_vectors if self.summary_vectors is not None else self.segments), film.generic_of(self.beats)
        return {
            "pairs": film.ribbon(film.bridge(windows, beats, pair, self.quality, self.summaries)),
            "ambience": film.ambience(*film.both_sides(windows, pair), ["a", "b"]),
            "similarity": film.pair_similarity(self.pairs, one, other),
        }
