"""The batch jobs: from pages and files to cues, utterances, the ladder, what to generate, and published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.text import input_hash, sentences
from .operators import corpus, cues, genstore, ladder, quality, titles
from .sources import pages, tables

#: A transcript of fewer cues is suspect, and no rescue.
LEAST_CUES = 200


def _enough(found: DataFrame, least: int) -> DataFrame:
    """Cues of films that have so many."""
    return found.join(found.groupBy("movie_id").count().where(F.col("count") >= least).select("movie_id"), "movie_id", "left_semi")


def _ordered(found: DataFrame, *order: str) -> DataFrame:
    """Cues numbered within their film."""
    return found.withColumn("idx", F.row_number().over(W.partitionBy("movie_id").orderBy(*order)) - 1).select("movie_id", "idx", "text")


def extract(transcripts: DataFrame, div: str = "scrolling-script-container", least: int = LEAST_CUES) -> dict[str, DataFrame]:
    """Transcript pages (movie_id, html) to cues, and a report per film: cues, fallback (sentences, for want of breaks), warning (too few; a page without the container has none)."""
    inner = transcripts.select("movie_id", F.coalesce(pages.div_by_class(F.col("html"), div), F.lit("")).alias("inner"))
    parted = inner.select("movie_id", pages.page_cues(F.col("inner")).alias("c"), F.size(pages.break_cues(F.col("inner"))).alias("parts"))
    found = parted.select("movie_id", F.posexplode("c").alias("idx", "text"))
    fallback = (F.col("parts") < 10) & (F.size("c") > F.col("parts"))
    report = parted.select("movie_id", F.size("c").alias("cues"), fallback.alias("fallback"), (F.size("c") < least).alias("warning"))
    return {"cues": found, "report": report}


def rescue_screenplays(movies: DataFrame, have: DataFrame, scripts: DataFrame, least: int = LEAST_CUES) -> DataFrame:
    """Cues of films without a transcript out of screenplay pages (movie_id, html): spoken blocks by sentences, without shouted action."""
    gaps = titles.missing(movies, have).select(F.col("id").alias("movie_id"))
    blocks = pages.dialogue(pages.screenplay_lines(scripts.join(gaps, "movie_id", "left_semi")), "movie_id")
    said = blocks.select("movie_id", "block", F.posexplode(sentences(F.col("text"))).alias("part", "text")).where(~pages.is_shouted(F.col("text")))
    return _enough(_ordered(said, "block", "part"), least)


def rescue_subtitle_pages(movies: DataFrame, have: DataFrame, subtitles: DataFrame, least: int = LEAST_CUES) -> DataFrame:
    """Cues of films without a transcript out of subtitle pages (movie_id, html) whose heading names no year or one at most one off."""
    gaps = titles.missing(movies, have).select(F.col("id").alias("movie_id"), "year")
    dated = subtitles.join(gaps, "movie_id").withColumn("said", pages.heading_year(F.col("html")))
    able = dated.where(F.col("said").isNull() | (F.abs(F.col("said") - F.col("year")) <= 1))
    return _enough(able.select("movie_id", F.posexplode(pages.subtitle_cues(F.col("html"))).alias("idx", "text")), least)


def upgrade(old_scores: DataFrame, named: DataFrame, drafts: DataFrame, found: DataFrame, dictionary: DataFrame, movies: DataFrame, least: int = LEAST_CUES) -> DataFrame:
    """Films of the worst decile, of the named ones or with drafts, whose found cues (movie_id, idx, text) are enough and better than the old ones; named ones and drafts are always replaced."""
    worst = quality.worst_decile(old_scores).where("downrank")
    wanted = titles.targets([worst, named, drafts], movies)
    fresh = _enough(found.join(wanted, "movie_id", "left_semi"), least)
    always = named.select("movie_id").union(drafts.select("movie_id")).distinct().withColumn("kind", F.lit("always"))
    scored = quality.score_films(fresh, dictionary).join(always, "movie_id", "left").na.fill("page", ["kind"])
    chosen = titles.better_layer(old_scores, scored, ["always"]).where("replace").select("movie_id")
    return fresh.join(chosen, "movie_id", "left_semi")


def upgrade_queue(saved: DataFrame, wanted: DataFrame, outcomes: DataFrame, files: DataFrame, budget: int) -> dict[str, DataFrame]:
    """One run over the queue of films to fetch: due (what to try now), queue (after outcomes), and cues, made anew from the files (movie_id, value) of all done entries."""
    queue = genstore.queue_merge(saved, wanted)
    due = titles.due(queue, budget)
    after = titles.after_run(queue, outcomes.join(due.select("movie_id"), "movie_id", "left_semi"))
    done = after.where("status = 'done'").select("movie_id")
    return {"due": due, "queue": after, "cues": tables.srt_cues(files.join(done, "movie_id", "left_semi"))}


def make_utterances(layers: list[tuple[str, DataFrame]], films: DataFrame, dictionary: DataFrame, rescued: DataFrame | None = None) -> dict[str, DataFrame]:
    """Layers of cues, lowest first, to lines, quality (with downrank and source_kind), report and worst.

    films: movie_id, musical, title. A film's kind is draft where its cues are of
    the layer `rescue` and `rescued` (movie_id) lists it.
    """
    top = cues.layered(layers)
    lines = cues.utterances(top.join(films.select("movie_id", "musical", "title"), "movie_id", "left").na.fill(False, ["musical"]), "musical", "title")
    scored = quality.worst_decile(quality.score_films(top, dictionary))
    source = top.select("movie_id", "layer").distinct()
    if rescued is not None:
        source = source.join(rescued.select("movie_id", F.lit(True).alias("listed")), "movie_id", "left")
        kind = F.when((F.col("layer") == "rescue") & F.col("listed"), "draft").otherwise("transcript")
    else:
        kind = F.lit("transcript")
    judged = scored.join(source.select("movie_id", kind.alias("source_kind")), "movie_id")
    return {"lines": lines, "quality": judged, "report": quality.corpus_report(lines), "worst": quality.worst_films(scored)}


def make_ladder(lines: DataFrame, beat_vectors: DataFrame) -> dict[str, DataFrame]:
    """Lines to beats, and with their vectors (movie_id, idx, vec) to generic scores, segments, and segments ranked by how little generic they are."""
    beats = ladder.beats(lines)
    vectors = beats.join(beat_vectors, ["movie_id", "idx"])
    generic = corpus.genericness(vectors)
    segments = ladder.segments(vectors)
    spans = corpus.with_beat_fallback(segments, beats)
    return {"beats": vectors.join(generic.select("movie_id", "idx", "generic"), ["movie_id", "idx"]), "segments": segments, "windows": corpus.ranked_windows(spans, generic)}


def to_generate(lines: DataFrame, windows: DataFrame, stored: DataFrame, prompt_version: int, tier: str = "1", repair: bool = False) -> dict[str, DataFrame]:
    """Ranked windows of a tier whose texts have no fresh summary in the store, with feedback where invalid ones are to be repaired, and their batches.

    stored: movie_id, start_seq, end_seq, input_hash, prompt_version, valid, refused, issues.
    """
    spans = corpus.tier(windows, tier).select("movie_id", "start_seq", "end_seq")
    wanted = genstore.window_inputs(lines, spans).withColumn("prompt_version", F.lit(prompt_version))
    key = F.concat_ws("", "movie_id", F.lit(":"), "start_seq", F.lit("-"), "end_seq")
    wanted, known = wanted.withColumn("key", key), stored.withColumn("key", key)
    if repair:
        wrong = genstore.repair_set(known).select("key", "feedback")
        pending = wanted.join(wrong, "key")
    else:
        pending = genstore.needs_run(wanted, known).withColumn("feedback", F.array().cast("array<string>"))
    packed = genstore.batches(pending, order=("movie_id", "start_seq"))
    return {"pending": pending, "batches": packed}


def slates(lines: DataFrame, stored: DataFrame, prompt_version: int) -> DataFrame:
    """Per film its sampled lines with their input_hash, where the store (movie_id, input_hash, prompt_version) has none of them."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    made = genstore.sampled_lines(lines).groupBy("movie_id").agg(texts.alias("texts"))
    wanted = made.withColumn("input_hash", input_hash(F.col("texts"))).withColumn("prompt_version", F.lit(prompt_version)).withColumn("key", F.col("movie_id"))
    return genstore.needs_run(wanted, stored.withColumn("key", F.col("movie_id")))


def load(found: dict[str, DataFrame], base: str, may_be_empty: tuple[str, ...] = ("summary_vectors",)) -> dict[str, str]:
    """Publish every table; an empty one is refused, but for those that may be, and leaves the version before it in place."""
    return {name: tables.publish(df, base, name, allow_empty=name in may_be_empty) for name, df in found.items()}
