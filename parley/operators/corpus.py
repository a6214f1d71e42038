"""Corpus analytics: genericness, film similarity, ranked windows, telling lines, a map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import capital_share, jaccard, words_of
from ..functions.vectors import mean_vectors
from ..sources.stored import temporary
from .blocks import TopMean, streamed

SAMPLE, TOP = 10_240, 32
#: Windows in a block at least, where there are more blocks than tasks to run at once, and at most.
LEAST_ROWS, MOST_ROWS = 512, 32_768
#: What credit cards and dedications say.
CREDIT_TEXT = r"(?i)(?<![A-Za-z0-9_])(dedicated to|in (loving )?memory|subtitles? by|directed by|produced by|screenplay by|based (up)?on the)(?![A-Za-z0-9_])"
ARC_MARGIN = 0.02


def min_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """(x - lo) / max(hi - lo, 1e-9) over the table; one row of bounds is joined back."""
    bounds = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    scaled = (F.col(value) - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-9))
    return df.join(F.broadcast(bounds)).withColumn(out, scaled).drop("__lo", "__hi")  # bounds is one row


def vector_sample(windows: DataFrame, n: int = SAMPLE) -> pd.DataFrame:
    """At most n rows (movie_id, vec), by a hash of their key; the bound keeps the broadcast small."""
    parts = 1 << 30
    key, rows = F.pmod(F.xxhash64(F.lit(42), "movie_id", "idx"), F.lit(parts)), windows.count()
    near = windows if rows <= 2 * n else windows.where(key < int(parts * 1.2 * n / rows))  # so no task sends a full sample of its own
    return near.select("movie_id", "idx", "vec").orderBy(key, "movie_id", "idx").limit(n).select("movie_id", "vec").toPandas()


def genericness(windows: DataFrame, sample: pd.DataFrame | None = None, top: int = TOP) -> DataFrame:
    """windows (movie_id, idx, vec) with raw (mean of the `top` nearest windows of other films) and generic (scaled to 0-1).

    Own-film cosines count as -1, so a window with fewer than `top` foreign
    neighbours averages those in. All windows are compared with all others, or
    with the rows of `sample` (movie_id, vec) where one is given: a block of
    windows stays in its task and the others stream past it. The raw scores are
    written once, as their bounds need a pass of their own.
    """
    spark, own = windows.sparkSession, windows.select("movie_id", "idx", "vec")
    other = own.select("movie_id", "vec") if sample is None else spark.createDataFrame(sample[["movie_id", "vec"]], own.select("movie_id", "vec").schema)
    n, m = own.count(), other.count() if sample is None else len(sample)
    if m < top:
        raise ValueError(f"there are {m} rows to compare with, fewer than {top}")
    groups = max(-(-n // MOST_ROWS), min(-(-n // LEAST_ROWS), 2 * spark.sparkContext.defaultParallelism), 1)
    dealt = own.select(F.pmod(F.xxhash64("movie_id", "idx"), F.lit(groups)).cast("int").alias("block"), F.lit(0).alias("side"), "movie_id", "idx", "vec")
    stream = other.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("block"), F.lit(1).alias("side"), "movie_id", F.lit(None).cast(own.schema["idx"].dataType).alias("idx"), "vec")
    types = {c: windows.schema[c].dataType.simpleString() for c in ("movie_id", "idx")}
    scored = streamed(
        dealt.unionByName(stream).repartitionById(groups, "block"), ["block"], lambda key, rows: TopMean(rows, top), f"movie_id {types['movie_id']}, idx {types['idx']}, raw double"
    )
    path = temporary(spark, "generic")
    scored.write.parquet(path)
    return min_max(spark.read.parquet(path), "raw", "generic")


def best_matches(segments: DataFrame, block: int = 8192, slice_rows: int = 512) -> DataFrame:
    """segments (movie_id, idx, vec) to (movie_id, idx, other, best): the highest cosine with each other film.

    Films are dealt into blocks of about `block` segments, a film within one; a
    pair of blocks is one task, which walks one side in slices and lets only the
    best of each film leave. Neither side has to fit in one task or a broadcast.
    """
    n = segments.count()
    groups = max(1, -(-n // block))
    spread = F.pmod(F.xxhash64("movie_id"), F.lit(groups)).cast("int")
    dealt = segments.select("movie_id", "idx", "vec", spread.alias("g"))
    every = F.sequence(F.lit(0), F.lit(groups - 1))
    left = dealt.select("*", F.explode(every).alias("h"), F.lit(False).alias("right"))
    right = dealt.select("movie_id", "idx", "vec", F.col("g").alias("h"), F.lit(True).alias("right"), F.explode(every).alias("g"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[~pdf["right"]], pdf[pdf["right"]].sort_values("movie_id")
        out = [pd.DataFrame({"movie_id": [], "idx": [], "other": [], "best": []})]
        if len(a) and len(b):
            films, first = np.unique(b["movie_id"], return_index=True)
            across = np.stack(b["vec"]).astype(np.float64).T
            for at in range(0, len(a), slice_rows):
                part = a.iloc[at : at + slice_rows]
                best = np.maximum.reduceat(np.stack(part["vec"]).astype(np.float64) @ across, first, axis=1)
                i, j = np.nonzero(part["movie_id"].to_numpy()[:, None] != films[None, :])
                out.append(pd.DataFrame({"movie_id": part["movie_id"].to_numpy()[i], "idx": part["idx"].to_numpy()[i], "other": films[j], "best": best[i, j]}))
        return pd.concat(out, ignore_index=True)

    # a film is in one block, so its best is final
    return left.unionByName(right).groupBy("g", "h").applyInPandas(product, "movie_id long, idx long, other long, best double")


def film_scores(best: DataFrame) -> DataFrame:
    """Mean centred best match per film pair, made symmetric: (movie_id, other, raw)."""
    centred = best.withColumn("c", F.col("best") - F.avg("best").over(W.partitionBy("movie_id", "idx")))
    one = centred.groupBy("movie_id", "other").agg(F.avg("c").alias("c"))
    swapped = one.select(F.col("other").alias("movie_id"), F.col("movie_id").alias("other"), F.col("c").alias("d"))
    return one.join(swapped, ["movie_id", "other"]).select("movie_id", "other", ((F.col("c") + F.col("d")) / 2).alias("raw"))


def clipped(scores: DataFrame, value: str = "raw", out: str = "seg") -> DataFrame:
    """Scaled between the 1st and 99th percentile (linear), clipped to 0-1; the two are one row that is joined back."""
    bounds = scores.agg(F.percentile(value, F.array(F.lit(0.01), F.lit(0.99))).alias("__p")).select(F.col("__p")[0].alias("__lo"), F.col("__p")[1].alias("__hi"))
    span = F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(F.lit(1.0))
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(value) - F.col("__lo")) / span))
    return scores.join(F.broadcast(bounds)).withColumn(out, scaled).drop("__lo", "__hi")  # bounds is one row


def metadata_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Genres, decade and keywords; empty sets are unlike."""
    decade = F.greatest(F.lit(0.0), 1 - F.abs(a["decade"] - b["decade"]) / 40)
    return 0.5 * jaccard(a["genre_ids"], b["genre_ids"], 0.0) + 0.2 * decade + 0.3 * jaccard(a["keyword_ids"], b["keyword_ids"], 0.0)


def similar_films(scores: DataFrame, movies: DataFrame, keep: int = 12) -> DataFrame:
    """scores (movie_id, other, seg) and movies to (movie_id, rank, similar_id, score)."""
    side = lambda p: movies.select(F.col("id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in ("decade", "genre_ids", "keyword_ids")))
    cols = lambda p: {c: F.col(f"{p}_{c}") for c in ("decade", "genre_ids", "keyword_ids")}
    both = scores.join(side("a"), F.col("movie_id") == F.col("a_id")).join(side("b"), F.col("other") == F.col("b_id"))
    blended = both.withColumn("score", 0.7 * F.col("seg") + 0.3 * metadata_similarity(cols("a"), cols("b")))
    rank = F.row_number().over(W.partitionBy("movie_id").orderBy(F.desc(F.round("score", 12)), F.desc("other")))
    return blended.withColumn("rank", rank).where(F.col("rank") <= keep).select("movie_id", "rank", F.col("other").alias("similar_id"), F.round("score", 4).alias("score"))


def film_vectors(segments: DataFrame) -> DataFrame:
    return mean_vectors(segments, ["movie_id"])


def ranked_windows(segments: DataFrame, generic: DataFrame) -> DataFrame:
    """segments (movie_id, idx, start_beat, end_beat, start_seq, end_seq) with score and rank: within a film from 0, least generic first, ties by idx.

    The score is the mean genericness of the beats a segment spans; a beat
    without one counts as 0. generic: movie_id, idx of the beat, generic.
    """
    beats = segments.select("movie_id", "idx", F.explode(F.sequence(F.col("start_beat").cast("long"), F.col("end_beat").cast("long"))).alias("beat"))
    scored = beats.join(generic.select("movie_id", F.col("idx").cast("long").alias("beat"), "generic"), ["movie_id", "beat"], "left")
    mean = scored.groupBy("movie_id", "idx").agg((F.coalesce(F.sum("generic"), F.lit(0.0)) / F.count("*")).alias("score"))
    rank = F.row_number().over(W.partitionBy("movie_id").orderBy(F.round("score", 12), "idx")) - 1
    return segments.join(mean, ["movie_id", "idx"]).withColumn("rank", rank)


def with_beat_fallback(segments: DataFrame, beats: DataFrame) -> DataFrame:
    """Segments, and for films that have none their beats as spans of one beat."""
    columns = ["movie_id", "idx", "start_beat", "end_beat", "start_seq", "end_seq"]
    lone = beats.join(segments.select("movie_id").distinct(), "movie_id", "left_anti")
    return segments.select(*columns).unionByName(lone.select("movie_id", "idx", F.col("idx").alias("start_beat"), F.col("idx").alias("end_beat"), "start_seq", "end_seq"))


def tier(ranked: DataFrame, which: str, first: int = 10) -> DataFrame:
    """'1': the first ones, '2': the rest, 'all'; in story order."""
    kept = {"1": F.col("rank") < first, "2": F.col("rank") >= first, "all": F.lit(True)}[which]
    return ranked.where(kept).orderBy("movie_id", "start_seq", "idx")


def tokens_of(lines: DataFrame, norm: str = "text_norm") -> Column:
    """A line's tokens: stored ones if the table has them."""
    return F.col("tokens") if "tokens" in lines.columns else F.filter(F.split(norm, " "), lambda x: x != "")


def document_frequency(lines: DataFrame, film: str = "movie_id") -> DataFrame:
    """(token, df): how many films say a token."""
    words = lines.select(film, F.explode(F.array_distinct(tokens_of(lines))).alias("token"))
    return words.groupBy("token", film).agg(F.lit(1).alias("one")).groupBy("token").agg(F.count("*").alias("df"))


def inverse_frequency(df: DataFrame, films: DataFrame) -> DataFrame:
    """(token, df) with idf = ln(films / (1 + df)); the number of films is one row of a table of them."""
    n = films.agg(F.count("*").cast("double").alias("__films"))
    return df.join(F.broadcast(n)).withColumn("idf", F.log(F.col("__films") / (1 + F.col("df")))).withColumnRenamed("__films", "films")  # one row


def is_credit_card(text: Column, arc: Column) -> Column:
    letters = F.regexp_replace(text, "[^a-zA-Z]", "")
    shouted = (F.length(letters) > 0) & (F.length(F.regexp_replace(letters, "[^A-Z]", "")) / F.length(letters) > 0.5)
    return text.rlike(CREDIT_TEXT) | (((arc > 1 - ARC_MARGIN) | (arc < ARC_MARGIN)) & shouted)


def distinctiveness(lines: DataFrame, idf: DataFrame) -> DataFrame:
    """lines with distinct: summed idf over the root of the token count, or -1.

    -1 unless the line has 25-120 characters, four tokens or more, is no credit
    card, and reads as speech: no opening quote, no digit, at most 40 % of the
    later words capitalised, and at least 40 % tokens that over a fifth of the
    films say. idf: token, df, idf, films; its rows are the vocabulary.
    """
    tokens = tokens_of(lines)
    text = F.col("text")
    fit = (
        F.length(text).between(25, 120) & (F.size(tokens) >= 4) & ~is_credit_card(text, F.col("arc")) & ~F.trim(text).rlike("^[\"'”’“]")
        & ~F.exists(tokens, lambda t: t.rlike("[0-9]")) & (capital_share(words_of(text)) <= 0.4)
    )
    judged = lines.withColumn("__fit", fit)
    words = judged.where("__fit").select("movie_id", "seq", F.explode(tokens).alias("token")).join(idf, "token", "left")
    common = F.count_if(F.coalesce(F.col("df") > 0.2 * F.col("films"), F.lit(False)))
    sums = words.groupBy("movie_id", "seq").agg((F.sum("idf") / F.sqrt(F.count("*"))).alias("__d"), (common / F.count("*")).alias("__common"))
    scored = F.when(F.col("__fit") & (F.col("__common") >= 0.4), F.col("__d")).otherwise(F.lit(-1.0))
    return judged.join(sums, ["movie_id", "seq"], "left").withColumn("distinct", scored).drop("__fit", "__d", "__common")


def names_in(text: Column) -> Column:
    """Capitalised words of three letters or more after the first, and the first one if a comma ends it (an address); in lower case."""
    name = lambda w: F.lower(F.regexp_extract(w, "^[A-Z][a-z]{2,}", 0))
    found = F.transform(words_of(text), lambda w, k: F.when((k > 0) | w.rlike("^[A-Z][a-z]{2,},$"), name(w)).otherwise(""))
    return F.array_distinct(F.filter(found, lambda n: n != ""))


def quintile_picks(candidates: DataFrame) -> DataFrame:
    """candidates (movie_id, seq, arc, central, distinct, names) to the five picked lines of each film.

    Ranks within a fifth of the film are native; the walk over the fifths, which
    avoids names picked before, is per film over its candidates.
    """
    fifth = F.least(F.floor(F.col("arc") * 5), F.lit(4)).cast("int")
    rows = candidates.withColumn("q", fifth)
    rank = lambda c: F.row_number().over(W.partitionBy("movie_id", "q").orderBy(F.desc(c), "seq")) - 1
    n = F.count("*").over(W.partitionBy("movie_id", "q"))
    ranked = rows.select("movie_id", "seq", "q", "names", (0.6 * rank("central") + 0.4 * rank("distinct")).alias("blend"), n.alias("n"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, picks = set(), []
        for _, part in pdf.sort_values(["q", "seq"]).groupby("q"):
            cost = [b + (0.5 * n if taken.intersection(names) else 0) for b, n, names in zip(part["blend"], part["n"], part["names"])]
            best = int(np.argmin(cost))
            picks.append(part["seq"].iloc[best])
            taken.update(part["names"].iloc[best])
        return pd.DataFrame({"movie_id": pdf["movie_id"].iloc[0], "seqs": [picks]})

    return ranked.groupBy("movie_id").applyInPandas(walk, "movie_id long, seqs array<long>")


def film_map(vectors: DataFrame) -> DataFrame:
    """(movie_id, x, y) in [0, 1]: the first two principal components, a documented stand-in for a neighbour embedding."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    made = vectors.select("movie_id", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("v"))
    flat = PCA(k=2, inputCol="v", outputCol="p").fit(made).transform(made).select("movie_id", vector_to_array("p").alias("p"))
    xy = flat.select("movie_id", F.col("p")[0].alias("x0"), F.col("p")[1].alias("y0"))
    return min_max(min_max(xy, "x0", "x"), "y0", "y").select("movie_id", "x", "y")
