"""Per-film transcript quality, and the worst decile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import has_terminal, ocr_hits, small_words


def half_up(c, digits: int = 0):
    """Rounded half up at so many digits."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def common_words(lines: DataFrame, n: int = 1000, text: str = "text") -> DataFrame:
    """The n words found in most lines; ties by word. A stand-in for a fixed dictionary."""
    words = F.array_distinct(small_words(F.col(text)))
    return lines.select(F.explode(words).alias("word")).groupBy("word").count().orderBy(F.desc("count"), "word").limit(n).select("word")


def score_films(cues: DataFrame, dictionary: DataFrame, film: str = "movie_id", text: str = "text") -> DataFrame:
    """One row per film: score 0-100, its four parts, cues, and whether it is likely not English.

    dictionary (word): Spark broadcasts it if it turns out small; then words are counted where their lines are read.
    """
    c = F.col(text)
    parts = cues.groupBy(film).agg(
        F.count("*").alias("cues"), F.avg(has_terminal(c).cast("double")).alias("p"), F.sum(ocr_hits(c)).alias("ocr"), F.avg(F.length(c).cast("double")).alias("mean")
    )
    words = cues.select(film, F.explode(small_words(c)).alias("word"))
    known = words.join(dictionary.distinct().withColumn("known", F.lit(1)), "word", "left")
    rate = known.groupBy(film).agg(F.count("*").alias("tokens"), F.count("known").alias("hits"))
    both = parts.join(rate, film, "left").na.fill(0, ["tokens", "hits"])
    d = F.when(F.col("tokens") > 0, F.col("hits") / F.col("tokens")).otherwise(F.lit(0.0))
    per = F.col("ocr") / F.col("cues") * 1000
    shape = F.when(F.col("mean").between(12, 80), 1.0).otherwise(0.5)
    score = 100 * (0.3 * F.least(F.col("p") / 0.6, F.lit(1.0)) + 0.3 * F.least(d / 0.55, F.lit(1.0)) + 0.3 * F.greatest(F.lit(0.0), 1 - per / 200) + 0.1 * shape)
    return both.select(
        film, half_up(score, 1).alias("score"), half_up(F.col("p"), 3).alias("punctuation_density"), half_up(d, 3).alias("dictionary_rate"),
        half_up(per, 1).alias("ocr_per_thousand"), half_up(F.col("mean"), 1).alias("mean_cue_length"), "cues",
        ((F.col("tokens") > 200) & (d < 0.2)).alias("non_english"),
    )


def worst_decile(scored: DataFrame, film: str = "movie_id") -> DataFrame:
    """Films with downrank: the floor(n/10) lowest scores, ties by film. A distributed sort with a limit, no global window."""
    n = scored.count()
    low = scored.orderBy("score", film).limit(n // 10).select(film, F.lit(True).alias("downrank"))
    return scored.join(low, film, "left").na.fill(False, ["downrank"])


def nearest_rank(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The value at floor((n-1)*p) of each sorted group."""
    w = W.partitionBy(*keys)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count("*").over(w))
    return ranked.where(F.col("__r") == F.floor((F.col("__n") - 1) * F.lit(p))).select(*keys, value)


def length_report(lines: DataFrame, film: str = "movie_id", text: str = "text") -> DataFrame:
    """One row: films, utterances, length buckets, mean per film."""
    n = F.length(text)
    return lines.agg(
        F.count_distinct(film).alias("films"), F.count("*").alias("utterances"), F.count_if(n < 20).alias("under_20"), F.count_if((n >= 20) & (n < 60)).alias("under_60"),
        F.count_if((n >= 60) & (n < 120)).alias("under_120"), F.count_if((n >= 120) & (n < 200)).alias("under_200"), F.count_if(n >= 200).alias("longer"),
    ).withColumn("mean_per_film", half_up(F.col("utterances") / F.col("films")).cast("long"))


def worst_films(scored: DataFrame, most: int = 20, film: str = "movie_id") -> DataFrame:
    """The lowest scores first."""
    return scored.orderBy("score", film).limit(most)


def corpus_report(lines: DataFrame, film: str = "movie_id", text: str = "text", points: tuple[float, ...] = (0.1, 0.5, 0.9, 0.99)) -> DataFrame:
    """length_report with the nearest-rank percentiles of line lengths as p10, p50 ..., and what cleaning dropped where lines carry it per film.

    Percentiles come from counts per length, as many rows as there are lengths.
    """
    lengths = lines.groupBy(F.length(text).cast("long").alias("n")).agg(F.count("*").alias("k"))
    upto = lengths.withColumn("upto", F.sum("k").over(W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    total = F.sum("k")
    marks = upto.agg(F.array_sort(F.collect_list(F.struct("n", "upto"))).alias("e"), total.alias("t"))
    at = lambda p: F.get(F.filter("e", lambda x: x["upto"] > F.floor((F.col("t") - 1) * F.lit(p))), F.lit(0))["n"]
    out = length_report(lines, film, text).join(F.broadcast(marks.select(*(at(p).alias(f"p{round(100 * p)}") for p in points))))  # one row
    own = [c for c in ("lyrics", "empty", "short", "credits") if c in lines.columns]
    if own:
        per = lines.groupBy(film).agg(*(F.max(c).cast("long").alias(c) for c in own))
        out = out.join(F.broadcast(per.agg(*(F.sum(c).alias(c) for c in own))))  # one row
    return out
