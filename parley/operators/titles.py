"""Titles against an index of titles, and layers of small maps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_key


def year_tolerant(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """wanted (id, title, year) and index (slug, title, year or null) by title key, years at most one apart; the first slug wins."""
    keyed = index.select(title_key(F.col("title")).alias("key"), "slug", F.col("year").alias("index_year"))
    both = wanted.withColumn("key", title_key(F.col("title"))).join(keyed, "key").where(F.col("index_year").isNull() | (F.abs(F.col("index_year") - F.col("year")) <= 1))
    return both.groupBy("id").agg(F.min("slug").alias("slug"))


#: What the index puts before titles of one franchise.
FRANCHISE = ("starwars", "starwarsthe")
LONG_KEY = 10
#: What a score must be above the means of both its windows, for the older bridge.
CONTRAST = 0.16


def resolve(wanted: DataFrame, index: DataFrame, aliases: DataFrame) -> DataFrame:
    """wanted (id, title) to (id, way, slug): the first way that finds any, and of its slugs the smallest.

    Ways: 0 the same key, 1 that of an alias, 2 and 3 the key behind a
    franchise's name, 4 an index key that begins or ends with a key of LONG_KEY
    characters or more. The last one meets on that many first or last
    characters, so it is an equi join and never compares all with all.
    """
    own = wanted.select("id", title_key(F.col("title")).alias("key"))
    keyed = index.select(title_key(F.col("title")).alias("other"), "slug")
    named = own.join(aliases.select(title_key(F.col("alias")).alias("key"), title_key(F.col("title")).alias("other")), "key").select("id", "other", F.lit(1).alias("way"))
    tried = own.select("id", F.col("key").alias("other"), F.lit(0).alias("way")).unionByName(named)
    for k, prefix in enumerate(FRANCHISE):
        tried = tried.unionByName(own.select("id", F.concat(F.lit(prefix), "key").alias("other"), F.lit(2 + k).alias("way")))
    equal = tried.where("other <> ''").join(keyed, "other").select("id", "way", "slug")
    long_own, long_other = own.where(F.length("key") >= LONG_KEY), keyed.where(F.length("other") >= LONG_KEY)
    head = lambda d, c: d.withColumn("p", F.substring(c, 1, LONG_KEY))
    tail = lambda d, c: d.withColumn("p", F.right(F.col(c), F.lit(LONG_KEY)))
    begins = head(long_own, "key").join(head(long_other, "other"), "p").where(F.col("other").startswith(F.col("key")))
    ends = tail(long_own, "key").join(tail(long_other, "other"), "p").where(F.col("other").endswith(F.col("key")))
    held = begins.unionByName(ends).select("id", F.lit(4).alias("way"), "slug")
    best = equal.unionByName(held).groupBy("id").agg(F.min(F.struct("way", "slug")).alias("b"))
    return best.select("id", "b.way", "b.slug")


def overridden(base: DataFrame, curated: DataFrame, key: str, value: str) -> DataFrame:
    """Curated values replace those of the base, unless empty; keys of either."""
    c = curated.where(F.size(value) > 0).select(key, F.col(value).alias("__c"))
    return base.select(key, value).join(c, key, "full_outer").select(key, F.coalesce("__c", value).alias(value))


def targets(layers: list[DataFrame], movies: DataFrame) -> DataFrame:
    """Distinct ids of all layers that are films, in order."""
    every = layers[0].select("movie_id")
    for layer in layers[1:]:
        every = every.union(layer.select("movie_id"))
    return every.distinct().join(movies.select(F.col("id").alias("movie_id")), "movie_id", "left_semi").orderBy("movie_id")


def missing(movies: DataFrame, scripts: DataFrame, most: int | None = None) -> DataFrame:
    """Films without a script, most voted first."""
    gaps = movies.join(scripts.select(F.col("movie_id").alias("id")), "id", "left_anti").orderBy(F.desc("votes"), "id")
    return gaps if most is None else gaps.limit(most)


def slice_of(movies: DataFrame, scripts: DataFrame, most: int | None = 300, rescued: DataFrame | None = None) -> DataFrame:
    """Films with a script, most voted first; where `most` is None all of them, and those that were rescued (movie_id)."""
    have = scripts.select(F.col("movie_id").alias("id"))
    if most is None and rescued is not None:
        have = have.union(rescued.select("movie_id")).distinct()
    able = movies.join(have, "id", "left_semi").orderBy(F.desc("votes"), "id")
    return able if most is None else able.limit(most)


def within(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen films (movie_id)."""
    return rows.join(chosen.select("movie_id"), "movie_id", "left_semi")


def imdb_numbers(movies: DataFrame, lookup: DataFrame) -> DataFrame:
    """movies (id) with the number of their entry in lookup (movie_id, imdb_id such as tt0012345); null where it is unknown."""
    number = lookup.select(F.col("movie_id").alias("id"), F.regexp_replace("imdb_id", "^tt0*", "").alias("imdb"))
    return movies.join(number, "id", "left")


def due(queue: DataFrame, budget: int, attempts: int = 3) -> DataFrame:
    """Pending entries that may be tried, as many as the budget lets."""
    return queue.where((F.col("status") == "pending") & (F.col("attempts") < attempts)).orderBy("attempts", "movie_id").limit(budget)


def after_run(queue: DataFrame, outcomes: DataFrame, attempts: int = 3) -> DataFrame:
    """The queue (movie_id, title, status, attempts) after outcomes (movie_id, outcome: found, no-match or failed).

    Found entries are done and unmatched ones no-match; a failure counts an
    attempt, and with the last one the entry is parked. Entries without an
    outcome stay, so a run that stops at its budget loses nothing.
    """
    both = queue.join(outcomes, "movie_id", "left")
    tries = F.col("attempts") + F.col("outcome").isNotNull().cast("int")
    status = (
        F.when(F.col("outcome") == "found", "done").when(F.col("outcome") == "no-match", "no-match")
        .when((F.col("outcome") == "failed") & (tries >= attempts), "parked").otherwise(F.col("status"))
    )
    return both.select("movie_id", "title", status.alias("status"), tries.alias("attempts"))


def better_layer(old: DataFrame, new: DataFrame, always: list[str] | None = None) -> DataFrame:
    """Films whose new cues replace the old ones: always for some source kinds, else where the score is higher."""
    both = new.select("movie_id", "kind", F.col("score").alias("new_score")).join(old.select("movie_id", F.col("score").alias("old_score")), "movie_id", "left")
    take = F.col("kind").isin(*(always or [])) | F.col("old_score").isNull() | (F.col("new_score") > F.col("old_score"))
    return both.withColumn("replace", take)


def beat_bridge(cross: DataFrame, least: float = CONTRAST, most: int = 5) -> DataFrame:
    """The older bridge: cross scores (a, b, ia, ib, score, mean_a, mean_b) whose contrast is high enough, strongest first, each window once, `most` at most; one alone counts as none.

    The choice walks the candidates of one pair of films, as each depends on the
    ones before.
    """
    contrast = F.col("score") - (F.col("mean_a") + F.col("mean_b")) / 2
    candidates = cross.withColumn("contrast", contrast).where(F.col("contrast") >= least).select("a", "b", "ia", "ib", "score", "contrast")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, kept = set(), set(), []
        for k, (ia, ib) in enumerate(zip(pdf["ia"], pdf["ib"])):
            if len(kept) < most and ia not in left and ib not in right:
                left.add(ia), right.add(ib), kept.append(k)
        return pdf.iloc[kept if len(kept) > 1 else []]

    ordered = lambda pdf: choose(pdf.assign(strong=pdf["score"].round(9)).sort_values(["strong", "ia", "ib"], ascending=[False, True, True]).drop(columns="strong"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.schema)
    return candidates.groupBy("a", "b").applyInPandas(ordered, types)
