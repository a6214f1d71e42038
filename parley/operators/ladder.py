"""The context ladder: lines, overlapping windows (beats), similarity-cut segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import dot, mean_vectors

SIZE, STRIDE = 12, 6
LEAST, MOST = 2, 12


def window_spans(n: Column, size: int = SIZE, stride: int = STRIDE) -> Column:
    """array<struct<start, end>> of windows over n rows; the last one ends at n - 1."""
    starts = F.sequence(F.lit(0), F.greatest(n - stride - 1, F.lit(0)), F.lit(stride))
    needed = F.filter(starts, lambda s: (s == 0) | (s - stride + size < n))
    many = F.transform(needed, lambda s: F.struct(s.cast("int").alias("start"), (F.least(s + size, n) - 1).cast("int").alias("end")))
    one = F.array(F.struct(F.lit(0).alias("start"), (n - 1).cast("int").alias("end")))
    return F.when(n <= 0, F.array().cast("array<struct<start:int,end:int>>")).when(n <= size, one).otherwise(many)


def beats(lines: DataFrame, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """lines (movie_id, seq from 0, text) to beats (movie_id, idx, start_seq, end_seq, arc, text).

    A line knows the windows that hold it, so it is sent to those (two at most
    here) and no row meets all lines of its film.
    """
    count = lines.groupBy("movie_id").agg(F.count("*").cast("int").alias("n"))
    spans = count.select("movie_id", "n", F.posexplode(window_spans(F.col("n"), size, stride)).alias("idx", "w"))
    placed = spans.select("movie_id", "n", "idx", F.col("w.start").alias("start_seq"), F.col("w.end").alias("end_seq"), F.explode(F.sequence("w.start", "w.end")).alias("seq"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    middle = (F.col("start_seq") + F.col("end_seq")) / 2
    arc = F.when(F.col("n") <= size, F.lit(0.5)).otherwise(middle / (F.col("n") - 1))
    return placed.join(lines, ["movie_id", "seq"]).groupBy("movie_id", "idx", "start_seq", "end_seq", "n").agg(text.alias("text")).select("movie_id", "idx", "start_seq", "end_seq", arc.alias("arc"), "text")


def neighbour_similarity(windows: DataFrame) -> DataFrame:
    """windows (movie_id, idx, vec) with sim: the dot product with the next one, null on the last."""
    after = F.lead("vec").over(W.partitionBy("movie_id").orderBy("idx"))
    return windows.withColumn("sim", F.when(after.isNotNull(), dot(F.col("vec"), after)))


def cut_points(sims: Column, n: Column, low: Column) -> Column:
    """array<struct<start, end>> of segments over n windows, in one pass over their similarities.

    A cut falls where similarity drops below `low` (the film's mean less one
    population deviation) and the segment has two windows or more, or where it
    has twelve; a last stub of one joins its neighbour. A fold, since a cut
    depends on the last one; each step takes constant time but for the append.
    """
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("from"), none.alias("cut"))

    def step(a: Column, sim: Column) -> Column:
        length = a["i"] + 1 - a["from"]
        cut = ((sim < low) & (length >= LEAST)) | (length >= MOST)
        return F.struct(
            (a["i"] + 1).alias("i"), F.when(cut, a["i"] + 1).otherwise(a["from"]).alias("from"),
            F.when(cut, F.array_append(a["cut"], span(a["from"], a["i"]))).otherwise(a["cut"]).alias("cut"),
        )

    def closed(a: Column) -> Column:
        made = F.size(a["cut"])
        joined = F.concat(F.slice(a["cut"], F.lit(1), F.greatest(made - 1, F.lit(0))), F.array(span(F.get(a["cut"], F.greatest(made - 1, F.lit(0)))["start"], n - 1)))
        stub = (n - a["from"] < LEAST) & (made > 0)
        return F.when(stub, joined).otherwise(F.array_append(a["cut"], span(a["from"], n - 1)))

    return F.aggregate(sims, start, step, closed)


def segment_spans(windows: DataFrame) -> DataFrame:
    """windows (movie_id, idx, vec) to (movie_id, idx, start_beat, end_beat); beats count from 0 in idx order."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("sim").isNotNull(), F.struct("idx", "sim"))))
    rows = neighbour_similarity(windows).groupBy("movie_id").agg(
        F.transform(ordered, lambda x: x["sim"]).alias("sims"), F.count("*").cast("int").alias("n"), (F.avg("sim") - F.stddev_pop("sim")).alias("low")
    )
    return rows.select("movie_id", F.posexplode(cut_points(F.col("sims"), F.col("n"), F.col("low"))).alias("idx", "s")).select("movie_id", "idx", F.col("s.start").alias("start_beat"), F.col("s.end").alias("end_beat"))


def segments(windows: DataFrame) -> DataFrame:
    """windows (movie_id, idx from 0, start_seq, end_seq, arc, vec) to segments with span, arc and unit mean vector."""
    spans = segment_spans(windows).withColumnRenamed("idx", "segment")
    inside = spans.select("movie_id", "segment", "start_beat", "end_beat", F.explode(F.sequence("start_beat", "end_beat")).alias("idx")).join(windows, ["movie_id", "idx"])
    ends = inside.groupBy("movie_id", "segment", "start_beat", "end_beat").agg(
        F.min_by("start_seq", "idx").alias("start_seq"), F.max_by("end_seq", "idx").alias("end_seq"), ((F.min_by("arc", "idx") + F.max_by("arc", "idx")) / 2).alias("arc")
    )
    return ends.join(mean_vectors(inside, ["movie_id", "segment"]), ["movie_id", "segment"]).withColumnRenamed("segment", "idx")
