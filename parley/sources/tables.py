"""Readers and writers of the corpus artifacts."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON value a line; blank lines are skipped, a broken one fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def read_store(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Append-only store: torn or invalid lines go, the last row of a key (windowId, else movieId) wins.

    The order of appends is the file's name and the line's place in it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    numbered = lines.withColumn("n", F.monotonically_increasing_id())
    parsed = numbered.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"})).where(F.col("row").isNotNull())
    return last_wins(parsed.select("row.*", F.struct("file", "block", "n").alias("__order")), "__order").drop("__order")


def last_wins(rows: DataFrame, order: str) -> DataFrame:
    """The latest row of each key; rows with neither key are torn lines and go."""
    keys = [F.col(k).cast("string") for k in ("windowId", "movieId") if k in rows.columns]
    keyed = rows.withColumn("__key", F.coalesce(*keys)).where(F.col("__key").isNotNull())
    latest = keyed.groupBy("__key").agg(F.max_by(F.struct(*rows.columns), order).alias("row"))
    return latest.select("row.*")


def _files(spark: SparkSession, path: str):
    """Statuses of a file, or of all files of a folder that aren't hidden, by name."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return sorted((f for f in found if f.isFile() and not f.getPath().getName().startswith(("_", "."))), key=lambda f: f.getPath().getName())


def read_matrix(spark: SparkSession, path: str, dim: int, count: int | None = None) -> DataFrame:
    """Row-aligned little-endian float32 files as (file, row, vec); the row number is the place in the file.

    A file is cut at row borders into splits like any other, so no task holds it
    whole. Lengths are checked before anything is read: every file must hold
    whole rows, and all together `count` of them where that is given.
    """
    width, files, total = 4 * dim, _files(spark, path), 0
    for f in files:
        if f.getLen() % width:
            raise ValueError(f"{f.getPath().getName()}: {f.getLen()} bytes are no rows of {dim} float32 numbers")
        total += f.getLen() // width
    if count is not None and total != count:
        raise ValueError(f"{path}: {total} rows, where {count} are said to be")
    form = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    out = None
    for f in files:
        name = f.getPath().toString()
        records = spark.sparkContext.newAPIHadoopFile(
            name, form, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{form}.recordLength": str(width)}
        )
        rows = spark.createDataFrame(records, "row long, bytes binary").mapInPandas(_floats, "row long, vec array<float>")
        rows = rows.select(F.lit(name).alias("file"), "row", "vec")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "file string, row long, vec array<float>") if out is None else out


def _floats(batches):
    for pdf in batches:
        yield pd.DataFrame({"row": pdf["row"], "vec": [np.frombuffer(b, "<f4") for b in pdf["bytes"]]})


def write_matrix(df: DataFrame, path: str, vec: str = "vec", mode: str = "error") -> None:
    """Vectors stay beside their key; dim and count are in the data and need no side file."""
    df.withColumn(vec, F.col(vec).cast("array<float>")).write.mode(mode).parquet(path)


def aligned_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """rows (with row) and their score; if the counts differ the scores aren't trusted and all are 0."""
    counts = rows.agg(F.count("*").alias("n")).crossJoin(scores.agg(F.count("*").alias("m")))  # one row each
    same = counts.select((F.col("n") == F.col("m")).alias("same")).first()["same"]
    if not same:
        return rows.withColumn("generic", F.lit(0.0))
    return rows.join(scores, "row", "left").withColumn("generic", F.coalesce("generic", F.lit(0.0)))


def srt_cues(files: DataFrame, text: str = "value") -> DataFrame:
    """SubRip files, one a row, to cues: blocks between empty lines, without a leading number, the time line after it, {\\...} and tags.

    A block without a time line is a cue too.
    """
    body = F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")
    time = r"^\s*\d{1,2}:\d{2}:\d{2}[,.]\d{1,3}\s*-->"
    lines = lambda b: F.filter(F.split(b, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) != "")
    from_ = lambda x, skip: F.slice(x, F.lit(1) + skip.cast("int"), F.greatest(F.size(x), F.lit(1)))
    first = lambda x, pattern: F.coalesce(F.get(x, F.lit(0)).rlike(pattern), F.lit(False))
    numbered = lambda x: from_(x, first(x, r"^\s*\d+\s*$"))
    spoken = lambda x: from_(x, first(x, time))
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.array_join(x, " "), r"\{\\[^}]*\}|<[^>]+>", ""), r"(?U)\s+", " "))
    cues = F.filter(F.transform(F.split(body, r"\n{2,}"), lambda b: clean(spoken(numbered(lines(b))))), lambda x: x != "")
    others = [c for c in files.columns if c != text]
    return files.select(*others, F.posexplode(cues).alias("idx", "text"))


VERSION = "v-"


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Names of the published versions, oldest first."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(n for f in fs.listStatus(target) if (n := f.getPath().getName()).startswith(VERSION)) if fs.exists(target) else []


def publish(df: DataFrame, base: str, name: str, allow_empty: bool = False, keep: int = 2) -> str:
    """Stage a new version, refuse an empty one, and then make it the current one by renaming its folder.

    Readers take the last version there is, so they see the old one or the new
    one and never none, wherever a crash falls. The `keep` latest versions stay
    for readers that have begun; older ones go.
    """
    spark, folder = df.sparkSession, f"{base.rstrip('/')}/{name}"
    staged = f"{folder}/_staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(staged)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(conf)
    if not allow_empty and spark.read.parquet(staged).isEmpty():
        fs.delete(path(staged), True)
        raise ValueError(f"{name}: the staged version has no rows; the old one stays")
    before = _versions(spark, folder)
    number = int(before[-1].split("-")[1]) + 1 if before else 1
    final = f"{folder}/{VERSION}{number:09d}-{staged[-32:]}"
    if not fs.rename(path(staged), path(final)):
        raise OSError(f"{staged} could not be renamed")
    for old in before[: max(0, len(before) + 1 - keep)]:
        fs.delete(path(f"{folder}/{old}"), True)
    return final


def current(spark: SparkSession, base: str, name: str) -> DataFrame:
    folder = f"{base.rstrip('/')}/{name}"
    found = _versions(spark, folder)
    if not found:
        raise FileNotFoundError(f"{folder}: nothing is published")
    return spark.read.parquet(f"{folder}/{found[-1]}")


def page_key(url: Column) -> Column:
    """Name of a page in a cache: SHA-1 of its address."""
    return F.sha1(url.cast("binary"))


def cached_pages(wanted: DataFrame, cache: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """wanted (url) with html from cache (key, status, html): null where the page is missing, answered 404, or isn't cached (no network is used).

    Where one address was cached several times, own names the columns of both
    tables that tell the captures apart.
    """
    stored = cache.where("status = 200").select(F.col("key").alias("__key"), "html", *own)
    return wanted.withColumn("__key", page_key(F.col("url"))).join(stored, ["__key", *own], "left").select(*wanted.columns, "html")


def backoff_ms(retry_after: Column, attempt: Column) -> Column:
    """Milliseconds to wait: what Retry-After says in seconds, else a second doubled with each attempt."""
    said = F.when(F.trim(retry_after).rlike(r"^\d+([.]\d+)?$"), F.trim(retry_after).cast("double"))
    return F.coalesce(F.when(said > 0, said * 1000), F.pow(F.lit(2.0), attempt) * 1000).cast("long")


def token_index(lines: DataFrame) -> DataFrame:
    """(token, movie_id, seq) sorted by token: row groups that hold no needle are skipped on read."""
    from ..functions.text import index_tokens

    rows = lines.select(F.explode(index_tokens(F.col("text_norm"))).alias("token"), "movie_id", "seq")
    return rows.repartitionByRange("token", "movie_id", "seq").sortWithinPartitions("token", "movie_id", "seq")
