"""Queries about one film, and the bridge between two."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clip, excerpt
from ..functions.vectors import dot, mean_rows
from . import titles
from .blocks import Crossed, streamed
from .retrieval import flagged, nearest

LAMBDA, EXCESS, STRENGTH, CONSENSUS, PAIRS = 0.75, 0.05, 0.25, 0.28, 5
ALIKE = 0.843
SOURCE_LINES = 25
#: Windows of the left film of a pair in one block.
BLOCK = 16_384


def headers(movies: DataFrame, lines: DataFrame) -> DataFrame:
    """Films with their line count, 0 if none: one pre-aggregation instead of a correlated subquery."""
    n = lines.groupBy("movie_id").agg(F.count("*").alias("line_count"))
    return movies.join(n, movies["id"] == n["movie_id"], "left").drop("movie_id").na.fill(0, ["line_count"])


def five_lines(picks: DataFrame, lines: DataFrame) -> DataFrame:
    """picks (movie_id, seqs) to their lines, by exploding the array into a semi join."""
    wanted = picks.select("movie_id", F.explode("seqs").alias("seq"))
    return lines.join(wanted, ["movie_id", "seq"], "left_semi").select("movie_id", "seq", "arc", "text")


def similar(pairs: DataFrame, movies: DataFrame, most: int = 8) -> DataFrame:
    meta = movies.select(F.col("id").alias("similar_id"), "title", "year")
    ranked = pairs.withColumn("n", F.row_number().over(W.partitionBy("movie_id").orderBy("rank"))).where(F.col("n") <= most).drop("n")
    return ranked.join(meta, "similar_id").select("movie_id", "rank", "similar_id", "title", "year", "score")


def _held(spans: DataFrame) -> DataFrame:
    """Spans once per line they hold, so that lines meet them by an equi join."""
    return spans.withColumn("held", F.explode(F.sequence(F.col("start_seq").cast("long"), F.col("end_seq").cast("long"))))


def span_at(spans: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (movie_id, seq) to the containing span of nearest midpoint, ties by idx."""
    inside = asked.join(_held(spans).withColumn("seq", F.col("held")), ["movie_id", "seq"])
    far = F.abs(F.col("start_seq") + F.col("end_seq") - 2 * F.col("seq"))
    best = inside.groupBy("movie_id", "seq").agg(F.min(F.struct(far.alias("far"), "idx", "start_seq", "end_seq")).alias("x"))
    return best.select("movie_id", "seq", "x.idx", "x.start_seq", "x.end_seq")


def first_overlap(spans: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (movie_id, s, e) to the first span by idx that overlaps: they meet on the lines of both."""
    lines = asked.distinct().withColumn("held", F.explode(F.sequence(F.col("s").cast("long"), F.col("e").cast("long"))))
    over = lines.join(_held(spans).select("movie_id", "held", "idx", "start_seq", "end_seq"), ["movie_id", "held"])
    return over.groupBy("movie_id", "s", "e").agg(F.min(F.struct("idx", "start_seq", "end_seq")).alias("x")).select("movie_id", "s", "e", "x.*")


def source_lines(lines: DataFrame, spans: DataFrame, most: int = SOURCE_LINES) -> DataFrame:
    """spans (movie_id, start_seq, end_seq) to their first lines and how many there are."""
    shown = spans.select("movie_id", "start_seq", "end_seq", F.explode(F.sequence(F.col("start_seq").cast("long"), F.least(F.col("end_seq"), F.col("start_seq") + most - 1).cast("long"))).alias("seq"))
    inside = shown.join(lines.select("movie_id", "seq", "text"), ["movie_id", "seq"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return inside.groupBy("movie_id", "start_seq", "end_seq").agg(ordered.alias("lines")).withColumn("total_lines", F.col("end_seq") - F.col("start_seq") + 1)


def nearest_beats(beats: DataFrame, quality: DataFrame, movies: DataFrame, film: int, vec: Column, keep: int = 8, texts: DataFrame | None = None) -> DataFrame:
    """The nearest moments of other films that aren't flagged: 16 by distance, one per film, `keep` at most.

    The joins with films and with texts (movie_id and, where films have several,
    idx; by default the beats' own) come after the limit. Texts are clipped
    before they are split, so expanded lines never exceed the clip.
    """
    said = beats.select("movie_id", "idx", "text") if texts is None else texts
    near = nearest(beats.drop("text").where(F.col("movie_id") != film).join(flagged(quality), "movie_id", "left_anti"), vec, 16, "movie_id", "idx")
    one = near.withColumn("n", F.row_number().over(W.partitionBy("movie_id").orderBy("dist", "idx"))).where("n = 1").orderBy("dist", "movie_id").limit(keep)
    clipped = clip(F.col("text"))
    told = said.join(F.broadcast(one), [k for k in ("movie_id", "idx") if k in said.columns])  # `keep` rows
    return told.join(movies.select(F.col("id").alias("movie_id"), "title", "year"), "movie_id").select(
        "movie_id", "title", "year", "arc", "start_seq", (1 - F.col("dist")).alias("score"), excerpt(clipped).alias("excerpt"),
        F.slice(F.filter(F.split(clipped, "\n"), lambda x: x != ""), 1, SOURCE_LINES).alias("expanded_lines"),
    )


def scene_panel(segments: DataFrame, beats: DataFrame, lines: DataFrame, summaries: DataFrame, film: int, seq: int, idx: int | None = None) -> dict[str, DataFrame]:
    """Summary, evidence and own beat of a place; with idx the segment is that one and the beat its centre's."""
    own = segments.where(F.col("movie_id") == film)
    asked = lambda s: own.sparkSession.createDataFrame([(film, s)], "movie_id long, seq long")
    segment = own.where(F.col("idx") == idx).select("movie_id", "idx", "start_seq", "end_seq") if idx is not None else span_at(own, asked(seq)).drop("seq")
    if idx is not None and (row := segment.first()):
        seq = (row["start_seq"] + row["end_seq"]) // 2
    beat = span_at(beats.where(F.col("movie_id") == film), asked(seq)).drop("seq")
    by_segment, by_beat = source_lines(lines, segment), source_lines(lines, beat)
    line = lines.where((F.col("movie_id") == film) & (F.col("seq") == seq)).select(F.array("text").alias("lines"), F.lit(1).cast("long").alias("total_lines"))
    tagged = [(k, d.select("lines", F.col("total_lines").cast("long").alias("total_lines"), F.lit(k).alias("kind"))) for k, d in enumerate((by_segment, by_beat, line))]
    evidence = tagged[0][1].unionByName(tagged[1][1]).unionByName(tagged[2][1]).where(F.size("lines") > 0).orderBy("kind").limit(1)
    summary = summaries.join(F.broadcast(segment.select("movie_id", "start_seq", "end_seq")), ["movie_id", "start_seq", "end_seq"])  # one row
    return {"summary": summary, "evidence": evidence, "beat": beat}


def pair_similarity(pairs: DataFrame, a: int, b: int) -> DataFrame:
    """One row: the higher stored score in either direction, 0 if there is none."""
    one = ((F.col("movie_id") == a) & (F.col("similar_id") == b)) | ((F.col("movie_id") == b) & (F.col("similar_id") == a))
    return pairs.where(one).agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))


def _kinds(left: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {left.schema[k].dataType.simpleString()}" for k in keys)


def _middles(rows: DataFrame, keys: list[str], side: str) -> DataFrame:
    """How many windows a film of each pair has, and their mean vector and genericness."""
    return mean_rows(rows, keys, "vec", "generic").select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in ("n", "vec", "generic")))


def _pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row a pair of films with windows: the middles of both, the mean of all their scores, and in how many blocks the left one is dealt.

    A score is linear in either window, so its means are scores of the middles.
    """
    both = _middles(left, keys, "a").join(_middles(right, keys, "b"), keys)
    ambient = dot(F.col("a_vec"), F.col("b_vec")) - LAMBDA * (F.col("a_generic") + F.col("b_generic")) / 2
    return both.withColumn("ambient", ambient).withColumn("blocks", F.ceil(F.col("a_n") / BLOCK).cast("int"))


def _crossed(left: DataFrame, right: DataFrame, keys: list[str], schema: str, **wanted) -> DataFrame:
    """What Crossed yields for each pair of films, whose left windows are dealt into blocks; the right ones stream past every block."""
    pairs = _pairs(left, right, keys)
    mean = lambda p: dot(F.col("x"), F.col(f"{p}_vec")) - LAMBDA * (F.col("own") + F.col(f"{p}_generic")) / 2
    own = lambda d: d.select(*keys, "idx", F.col("vec").cast("array<double>").alias("x"), F.col("generic").cast("double").alias("own")).join(pairs, keys)
    row = lambda d, block, side, p: d.select(*keys, block.alias("block"), F.lit(side).alias("side"), F.col("idx").cast("long").alias("idx"), F.col("x").alias("vec"), F.col("own").alias("generic"), mean(p).alias("mean"), "ambient")
    stay = row(own(left), F.pmod(F.xxhash64("idx"), F.col("blocks")).cast("int"), 0, "b")
    pass_by = row(own(right), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), 1, "a")
    tasks = 4 * left.sparkSession.sparkContext.defaultParallelism  # a stated number, since few bytes can be much work
    kernel = lambda key, rows: Crossed(key, keys, rows, LAMBDA, **wanted)
    return streamed(stay.unionByName(pass_by).repartition(tasks, *keys, "block"), [*keys, "block"], kernel, schema)


def cross_scores(left: DataFrame, right: DataFrame, keys: list[str], contrast: float | None = None, strength: float | None = None, most: int | None = None) -> DataFrame:
    """Adjusted scores of each window of one film with each of another: (keys, ia, ib, score, mean_a, mean_b, ambient).

    left and right: keys, idx, vec, generic. Only scores of that contrast to the
    windows' means and of that strength leave the task, where these are given,
    and with `most` only so many of each left window, highest (rounded) first, ties by ib.
    """
    columns = f"{_kinds(left, keys)}, ia long, ib long, score double, mean_a double, mean_b double, ambient double"
    return _crossed(left, right, keys, columns, contrast=contrast, strength=strength, most=most, summed=False)


def ambience(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row a pair of films: how many scores there are, the best, and their mean (how alike the films sound overall)."""
    best = _crossed(left, right, keys, f"{_kinds(left, keys)}, best double", contrast=None, strength=None, most=None, summed=True)
    known = _pairs(left, right, keys).select(*keys, (F.col("a_n") * F.col("b_n")).alias("n"), "ambient")
    return known.join(best.groupBy(*keys).agg(F.max("best").alias("best")), keys).select(*keys, "n", "best", "ambient")


def bridge_candidates(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Cross scores that are strong, and far above what both windows score against the other film."""
    return cross_scores(left, right, keys, EXCESS, STRENGTH)


def headlines(windows: DataFrame, summaries: DataFrame) -> DataFrame:
    """windows (movie_id, start_seq, end_seq) with the headline of the summary of exactly that span; null where there is none or an empty one."""
    stored = summaries.where("headline <> ''").groupBy("movie_id", "start_seq", "end_seq").agg(F.min("headline").alias("headline"))
    return windows.join(stored, ["movie_id", "start_seq", "end_seq"], "left")


CHOICE = "a long, b long, n int, ia long, ib long, beat_a long, beat_b long, score double"


def _chooser(stop_at_weak: bool):
    """The greedy one-to-one choice among a pair's candidates, strongest first; fewer than two count as none."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        out = []
        for (_, ia, ib), part in pdf.assign(neg=-pdf["score"]).groupby(["neg", "ia", "ib"], sort=True):
            if len(out) == PAIRS or (stop_at_weak and part["score"].iloc[0] < STRENGTH):
                break
            if ("A", ia) in used or ("B", ib) in used:
                continue
            for r in part.sort_values(["agreement", "ba", "bb"], ascending=[False, True, True]).itertuples():
                if ("a", r.ba) not in used and ("b", r.bb) not in used:
                    used |= {("A", ia), ("B", ib), ("a", r.ba), ("b", r.bb)}
                    out.append((r.a, r.b, len(out) + 1, ia, ib, r.ba, r.bb, r.score))
                    break
        return pd.DataFrame(out if len(out) >= 2 else [], columns=["a", "b", "n", "ia", "ib", "beat_a", "beat_b", "score"])

    return choose


def bridge(windows: DataFrame, beats: DataFrame, pairs: DataFrame, quality: DataFrame, summaries: DataFrame | None = None, *, stop_at_weak: bool = False) -> DataFrame:
    """pairs (a, b) of films to at most five pairs of moments each, with arcs, first lines, excerpts and headlines; fewer than two count as none.

    Films flagged as not English have no bridge. Window candidates by score;
    each takes the best beats inside both spans that no earlier one took, if
    they agree enough. Beats meet windows on the lines that windows hold, and
    agreement only on beats of candidates. The greedy choice walks one pair of
    films at a time; with stop_at_weak the strength floor ends the walk instead
    of sorting candidates out before it, as the side-by-side harness has it.
    """
    english = pairs
    for side in ("a", "b"):
        english = english.join(quality.where("non_english").select(F.col("movie_id").alias(side)), side, "left_anti")
    of = lambda d, side: english.join(d, F.col(side) == d["movie_id"]).select("a", "b", *[c for c in d.columns if c != "movie_id"])
    # a walk in order of strength that ends at a weak candidate meets just those that are strong, so either rule lets the same ones in
    wide = cross_scores(of(windows, "a"), of(windows, "b"), ["a", "b"], EXCESS, STRENGTH).select("a", "b", "ia", "ib", "score")
    starts = beats.select("movie_id", F.col("idx").alias("beat"), F.col("start_seq").cast("long").alias("held"))
    held = _held(windows.select("movie_id", "idx", "start_seq", "end_seq")).join(starts, ["movie_id", "held"])
    inside = lambda side: held.select(F.col("movie_id").alias(side), F.col("idx").alias(f"i{side}"), F.col("beat").alias(f"b{side}"))
    fine = cross_scores(of(beats, "a"), of(beats, "b"), ["a", "b"], None, CONSENSUS).select("a", "b", F.col("ia").alias("ba"), F.col("ib").alias("bb"), F.col("score").alias("agreement"))
    tried = foremost(wide.join(inside("a"), ["a", "ia"]).join(inside("b"), ["b", "ib"]).join(fine, ["a", "b", "ba", "bb"]), held)
    picked = tried.select("a", "b", "ia", "ib", "score", "ba", "bb", "agreement").groupBy("a", "b").applyInPandas(_chooser(stop_at_weak), CHOICE)
    line = clip(F.array_join(F.slice(F.split("text", "\n"), 1, 3), " ")) if "text" in beats.columns else F.lit(None).cast("string")
    shown = lambda side: beats.select(F.col("movie_id").alias(side), F.col("idx").alias(f"beat_{side}"), F.col("arc").alias(f"arc_{side}"), F.col("start_seq").alias(f"start_{side}"), line.alias(f"excerpt_{side}"))
    out = picked.join(shown("a"), ["a", "beat_a"]).join(shown("b"), ["b", "beat_b"])
    spans = windows.select("movie_id", "idx", "start_seq", "end_seq")
    named = headlines(spans, summaries) if summaries is not None else spans.withColumn("headline", F.lit(None).cast("string"))
    for side in ("a", "b"):
        out = out.join(named.select(F.col("movie_id").alias(side), F.col("idx").alias(f"i{side}"), F.col("headline").alias(f"headline_{side}")), [side, f"i{side}"])
    return out.select("a", "b", "n", "ia", "ib", "beat_a", "beat_b", "start_a", "start_b", "arc_a", "arc_b", "excerpt_a", "excerpt_b", "headline_a", "headline_b", "score")


def foremost(tried: DataFrame, held: DataFrame) -> DataFrame:
    """The candidates (a, b, ia, ib, ba, bb, score) that a greedy choice of PAIRS pairs can reach; held: movie_id, idx, beat.

    Where a candidate is chosen with the beats ba and bb, each stronger one of
    its ia that could have taken ba was barred by its own ib or bb. At most
    PAIRS - 1 of each are taken, and `most` windows hold one beat, so it stands
    among the first PAIRS + (PAIRS - 1) * most of its ia and ba; likewise of its
    ib and bb. Of what that leaves, each earlier choice bars so many on either
    side by its window or beat, which bounds the place of the last one.
    """
    per = lambda *keys: held.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 1
    most, inside = per("movie_id", "beat"), per("movie_id", "idx")
    first = PAIRS + (PAIRS - 1) * most
    strongest = F.desc("score")
    near = lambda d, own, other: d.withColumn("k", F.dense_rank().over(W.partitionBy("a", "b", *own).orderBy(strongest, other))).where(F.col("k") <= first).drop("k")
    both = near(near(tried, ("ia", "ba"), "ib"), ("ib", "bb"), "ia")
    place = F.dense_rank().over(W.partitionBy("a", "b").orderBy(strongest, "ia", "ib"))
    return both.withColumn("k", place).where(F.col("k") <= PAIRS + (PAIRS - 1) * first * 2 * (inside + most)).drop("k")


def generic_of(rows: DataFrame) -> DataFrame:
    """Rows with generic: 0 where the table was made without that column."""
    return rows if "generic" in rows.columns else rows.withColumn("generic", F.lit(0.0))


def older_bridge(beats: DataFrame, pairs: DataFrame) -> DataFrame:
    """The bridge of titles.beat_bridge over pairs of films. Earlier choices take PAIRS - 1 partners of a window at most, so its first PAIRS are all that it can be chosen with."""
    return titles.beat_bridge(cross_scores(*both_sides(beats, pairs), ["a", "b"], titles.CONTRAST, most=PAIRS), most=PAIRS)


def compared_bridges(windows: DataFrame, beats: DataFrame, pairs: DataFrame, quality: DataFrame) -> DataFrame:
    """Both bridges side by side: (a, b, way, n, ia, ib, score), way beats or consensus."""
    older = older_bridge(beats, pairs)
    place = F.row_number().over(W.partitionBy("a", "b").orderBy(F.desc(F.round("score", 9)), "ia", "ib"))
    first = older.select("a", "b", F.lit("beats").alias("way"), place.alias("n"), "ia", "ib", "score")
    second = bridge(windows, beats, pairs, quality, stop_at_weak=True).select("a", "b", F.lit("consensus").alias("way"), "n", "ia", "ib", "score")
    return first.unionByName(second)


def both_sides(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of either film of each pair."""
    side = lambda s: pairs.join(rows, F.col(s) == rows["movie_id"]).select("a", "b", *[c for c in rows.columns if c != "movie_id"])
    return side("a"), side("b")


def sounds_alike(pairs_found: int, similarity: float) -> bool:
    """Whether two films sound alike throughout: no single bridge, but a high stored similarity."""
    return pairs_found == 0 and similarity >= ALIKE


def ribbon(pairs: DataFrame) -> DataFrame:
    """Stroke widths 2 to 8 over a film pair's scores."""
    w = W.partitionBy("a", "b")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    part = (F.col("score") - lo) / F.greatest(hi - lo, F.lit(0.02))
    return pairs.withColumn("width", 2 + 6 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)))
