"""The validated generation store: what to run, how replies are held against the text, what to reuse."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import capital_share, input_hash, quote_key, tokenize, words_of
from ..functions.vectors import cosine_distance

SNAP = 0.55


def needs_run(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """wanted (key, input_hash, prompt_version) that are missing or changed in stored."""
    old = stored.select("key", F.col("input_hash").alias("__h"), F.col("prompt_version").alias("__v"))
    both = wanted.join(old, "key", "left")
    return both.where(F.col("__h").isNull() | (F.col("__h") != F.col("input_hash")) | (F.col("__v") != F.col("prompt_version"))).drop("__h", "__v")


def window_inputs(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (movie_id, start_seq, end_seq) with their texts and input_hash; empty spans go."""
    inside = spans.select("movie_id", "start_seq", "end_seq", F.explode(F.sequence("start_seq", "end_seq")).alias("seq")).join(lines.select("movie_id", "seq", "text"), ["movie_id", "seq"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return inside.groupBy("movie_id", "start_seq", "end_seq").agg(texts.alias("texts")).withColumn("input_hash", input_hash(F.col("texts")))


def repair_set(stored: DataFrame) -> DataFrame:
    """Invalid rows that weren't refused, with the details of their issues as feedback."""
    wrong = stored.where(~F.coalesce("valid", F.lit(False)) & ~F.coalesce("refused", F.lit(False)))
    return wrong.withColumn("feedback", F.transform(F.coalesce("issues", F.array().cast(stored.schema["issues"].dataType)), lambda x: x["detail"]))


def match_quotes(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """quotes (movie_id, quote_id, text, hint or null) and lines (movie_id, seq, text) to the line that each quote is.

    The hinted line if it says the same, else the first that does, else the one
    of highest tf-idf cosine, the earlier of equals; without tokens none. The
    cosine is a token join with partial sums: lines of films without quotes are
    left out first, and only tokens that a quote of the film holds meet lines.
    """
    own = quotes.select("movie_id", "quote_id", "hint", quote_key(F.col("text")).alias("key"), tokenize(F.col("text")).alias("tokens"))
    near = lines.join(quotes.select("movie_id").distinct(), "movie_id", "left_semi")
    stored = near.select("movie_id", "seq", quote_key(F.col("text")).alias("key"), tokenize(F.col("text")).alias("tokens"))
    films = near.groupBy("movie_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    same = own.join(stored.drop("tokens"), ["movie_id", "key"])
    exact = same.groupBy("movie_id", "quote_id").agg(F.coalesce(F.min(F.when(F.col("seq") == F.col("hint"), F.col("seq"))), F.min("seq")).alias("exact_seq"))
    # tokens of lines and quotes in one table: a film's token meets its document frequency, and a text its length, without a join
    side = lambda d, c, quote: d.select("movie_id", F.col(c).alias("id"), F.lit(quote).alias("quote"), F.explode("tokens").alias("token"))
    said = side(stored, "seq", False).unionByName(side(own, "quote_id", True)).groupBy("movie_id", "token", "quote", "id").agg(F.count("*").cast("double").alias("tf"))
    df = F.count_if(~F.col("quote")).over(W.partitionBy("movie_id", "token"))
    known = said.withColumn("df", df).join(films.select("movie_id", "n"), "movie_id")
    weighed = known.withColumn("w", F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    sized = weighed.withColumn("size", F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("movie_id", "quote", "id"))))
    asked = sized.where("quote").select("movie_id", "token", F.col("id").alias("quote_id"), F.col("w").alias("v"), F.col("size").alias("asked_size"))
    met = asked.join(sized.where("NOT quote").select("movie_id", "token", F.col("id").alias("seq"), "w", "size"), ["movie_id", "token"])
    dots = met.groupBy("movie_id", "quote_id", "seq").agg((F.sum(F.col("v") * F.col("w")) / (F.first("size") * F.first("asked_size"))).alias("cosine"))
    best = dots.groupBy("movie_id", "quote_id").agg(F.max(F.struct(F.round("cosine", 12).alias("score"), (-F.col("seq")).alias("neg"))).alias("b"))
    out = own.join(exact, ["movie_id", "quote_id"], "left").join(best, ["movie_id", "quote_id"], "left").join(films, "movie_id", "left")
    verbatim, any_token = F.col("exact_seq").isNotNull(), F.size("tokens") > 0
    seq = F.coalesce("exact_seq", -F.col("b.neg"), F.when(any_token, F.col("first_seq")))
    return out.select("movie_id", "quote_id", seq.alias("seq"), F.when(verbatim, 1.0).when(seq.isNotNull(), F.coalesce("b.score", F.lit(0.0))).alias("score"), verbatim.alias("verbatim"))


#: Words that are no names, though a capital opens them.
NOT_NAMES = (
    "he she it we they you i who what when where why how the a an and but or nor so yet "
    "his her its our their your this that these those there then now no yes not"
).split()


def lint(summaries: DataFrame) -> DataFrame:
    """summaries (window_id, headline, summary, evidence array<struct<start,end>>, start_seq, end_seq, texts, title) to issues and valid.

    Kinds: no-evidence; bad-range (outside the window, reversed, or a headline of
    over 90 characters); invented-noun (a capitalised word that opens no
    sentence and no quotation, follows none, and that neither the window nor the
    title says).
    """
    known = F.array_union(tokenize(F.array_join("texts", " ")), tokenize(F.coalesce("title", F.lit(""))))
    said = F.concat(F.coalesce("headline", F.lit("")), F.lit(". "), F.coalesce("summary", F.lit("")))
    after = lambda words: F.transform(words, lambda w, k: F.struct(w.alias("word"), F.when(k > 0, F.get(words, k - 1)).alias("before")))
    placed = F.flatten(F.transform(F.split(said, r"(?<=[.!?])(?U)\s+"), lambda sentence: after(words_of(sentence))))
    quoted = lambda p: p["word"].rlike("^[\"'“]") | p["before"].rlike("[\"'”’]$")
    inner = F.filter(placed, lambda p: p["before"].isNotNull() & ~quoted(p))
    nouns = F.filter(F.transform(inner, lambda p: F.regexp_extract(p["word"], r"^\(?([A-Z][a-z]+)", 1)), lambda w: w != "")
    new = F.filter(nouns, lambda w: ~F.lower(w).isin(*NOT_NAMES) & ~F.array_contains(known, F.lower(w)))
    issue = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    none = F.array().cast("array<struct<kind:string,detail:string>>")
    outside = lambda e: (e["start"] < F.col("start_seq")) | (e["end"] > F.col("end_seq")) | (e["start"] > e["end"])
    ranges = F.transform(F.filter("evidence", outside), lambda e: issue("bad-range", F.concat(e["start"].cast("string"), F.lit("-"), e["end"].cast("string"))))
    issues = F.concat(
        F.when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, F.array(issue("no-evidence", F.lit("")))).otherwise(none), F.coalesce(ranges, none),
        F.transform(new, lambda w: issue("invented-noun", w)), F.when(F.length("headline") > 90, F.array(issue("bad-range", F.lit("headline")))).otherwise(none),
    )
    return summaries.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


def revalidate(stored: DataFrame, lines: DataFrame) -> DataFrame:
    """Invalid rows linted again against their window's text; those now valid come back for appending."""
    texts = window_inputs(lines, stored.select("movie_id", "start_seq", "end_seq").distinct())
    again = lint(repair_set(stored).drop("issues", "valid", "feedback").join(texts.drop("input_hash"), ["movie_id", "start_seq", "end_seq"]))
    return again.where("valid")


def reconcile(new: DataFrame, old: DataFrame) -> DataFrame:
    """new (row, text) with the vector of the first old row (row, text, vec) of equal text; fresh where there is none."""
    first = old.groupBy("text").agg(F.min_by("vec", "row").alias("vec"))
    return new.join(first, "text", "left").withColumn("fresh", F.col("vec").isNull())


def to_embed(summaries: DataFrame) -> DataFrame:
    """Valid summaries that weren't refused, as the text to embed, in order."""
    kept = summaries.where(F.coalesce("valid", F.lit(False)) & ~F.coalesce("refused", F.lit(False)))
    return kept.select("movie_id", "start_seq", "end_seq", F.concat_ws(". ", "headline", "summary").alias("text")).orderBy("movie_id", "start_seq")


def sampled_lines(lines: DataFrame, bins: int = 12, most: int = 10) -> DataFrame:
    """Lines shaped as dialogue, per film and bin of arc every so many-th, `most` at most.

    15-160 characters, four tokens or more, no digit, at most 40 % of the later
    words capitalised; a line at arc 1 is in no bin.
    """
    text = F.col("text")
    shaped = F.length(text).between(15, 160) & (F.size(tokenize(text)) >= 4) & ~text.rlike("[0-9]") & (capital_share(words_of(text)) <= 0.4)
    binned = lines.where(shaped).withColumn("bin", F.floor(F.col("arc") * bins).cast("int")).where((F.col("bin") >= 0) & (F.col("bin") < bins))
    w = W.partitionBy("movie_id", "bin")
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / most))
    picked = binned.withColumn("at", F.row_number().over(w.orderBy("seq")) - 1).withColumn("step", step).where("at % step = 0")
    return picked.where(F.col("at") / F.col("step") < most).drop("at", "step")


def _cost(texts) -> F.Column:
    return F.aggregate(F.transform(texts, lambda t: F.length(t) + 24), F.lit(0), lambda a, x: a + x)


def trimmed(windows: DataFrame, budget: int = 60_000) -> DataFrame:
    """windows (texts) cut to the budget where one alone exceeds it: 70 % of the lines that fit from its head, the rest from its tail."""
    size, n = _cost(F.col("texts")), F.size("texts")
    keep = F.floor(n * budget / size)
    head = F.greatest(F.lit(1), F.floor(keep * 0.7)).cast("int")
    tail = F.least(n, F.greatest(F.lit(1), keep - head)).cast("int")
    return windows.withColumn("texts", F.when(size <= budget, F.col("texts")).otherwise(F.concat(F.slice("texts", 1, head), F.slice("texts", -tail, tail))))


def batches(windows: DataFrame, most: int = 12, budget: int = 60_000, order: tuple[str, ...] = ("movie_id", "idx")) -> DataFrame:
    """windows (movie_id, idx, texts) in order to batch numbers over all of them: at most so many windows and characters (24 more a line) in one.

    Windows over the budget are trimmed first. A batch begins where the last one
    ended, so the walk is one task; it sees ids and sizes only, and keeps none.
    """
    rows = trimmed(windows, budget).select(*order, _cost(F.col("texts")).alias("cost"))

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, n, size = 0, 0, 0
        for pdf in parts:
            numbers = []
            for c in pdf["cost"]:
                if n == most or (n and size + c > budget):
                    batch, n, size = batch + 1, 0, 0
                n, size = n + 1, size + c
                numbers.append(batch)
            yield pdf.drop(columns="cost").assign(batch=numbers)

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in order)
    return rows.repartition(1).sortWithinPartitions(*order).mapInPandas(deal, f"{types}, batch long")


def row_cosines(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows compared, and the least cosine, of vectors (row, vec) that should be the same ones."""
    both = left.select("row", F.col("vec").alias("__a")).join(right.select("row", F.col("vec").alias("__b")), "row", "full_outer")
    cosine = F.coalesce(1 - cosine_distance(F.col("__a"), F.col("__b")), F.lit(-1.0))  # a row that one side lacks
    return both.agg(F.count("*").alias("rows"), F.min(cosine).alias("least"))


def validated(left: DataFrame, right: DataFrame, least: float = 0.999) -> DataFrame:
    """row_cosines with ok: whether every row agrees."""
    return row_cosines(left, right).withColumn("ok", F.coalesce(F.col("least") >= least, F.lit(True)))


def queue_merge(saved: DataFrame, targets: DataFrame) -> DataFrame:
    """Saved entries untouched, and targets that aren't among them as pending."""
    fresh = targets.join(saved, "movie_id", "left_anti").select("movie_id", "title", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
    return saved.select("movie_id", "title", "status", "attempts").unionByName(fresh)


def best_candidates(candidates: DataFrame) -> DataFrame:
    """One subtitle file per film: year within one or unknown; not for the hearing impaired, trusted, most downloads."""
    able = candidates.where(F.col("year").isNull() | (F.abs(F.col("year") - F.col("film_year")) <= 1))
    order = ["hearing_impaired", F.desc("from_trusted"), F.desc("download_count"), "file_id"]
    return able.withColumn("n", F.row_number().over(W.partitionBy("movie_id").orderBy(*order))).where("n = 1").drop("n")
