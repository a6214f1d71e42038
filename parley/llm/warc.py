"""Not-modified revisits of an archive, resolved to the response they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

#: Headers that a not-modified answer must not change in the stored response.
FORBIDDEN = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url) -> F.Column:
    """One spelling of a URL: lower-case scheme and host, https as http; without www., the scheme's own default port, fragment, a final slash and an empty query.

    User names, paths and queries keep their case and their escapes.
    """
    u = F.trim(url)
    head = F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    rest = F.regexp_replace(F.substring(u, F.length(head) + 1, F.length(u)), "#.*$", "")
    user = F.regexp_extract(head, "://(.*@)", 1)
    scheme, host = F.lower(F.regexp_extract(head, "^(.*?)://", 1)), F.lower(F.regexp_replace(head, "^.*?://(.*@)?", ""))
    host = F.regexp_replace(host, F.when(scheme == "https", ":443$").when(scheme == "http", ":80$").otherwise("^$"), "")
    web = scheme.isin("http", "https")
    host = F.when(web & (user == ""), F.regexp_replace(host, "^www[.](.*[.].*)$", "$1")).otherwise(host)
    named = F.when(head == "", head).otherwise(F.concat(F.when(web, "http").otherwise(scheme), F.lit("://"), user, host))
    return F.concat(named, F.regexp_replace(F.regexp_replace(rest, "[?]$", ""), "/$", ""))


def _lower_names(headers: str) -> F.Column:
    """A map's entries by lower-case name, of alike names the smallest by code point; a null map is empty."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.transform(F.array_sort(F.coalesce(F.map_entries(headers), none)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, k: F.array_position(names, e["key"]) == k + 1))


def resolve(records: DataFrame) -> DataFrame:
    """Not-modified revisits joined as-of to the latest earlier full response of their canonical URL.

    records: record_id long, url string, ts long, kind string ('response' or
    'revisit'), etag string, last_modified string, headers map<string,string>.
    Returns per revisit: record_id, uri, refers_to, verdict, headers.
    verdict: 'resolved' (a validator that both carry agrees and none differs),
    'unverified' (no validator in common), 'mismatch', or 'orphan' (no earlier
    response). Responses and revisits of one moment are ordered by record_id.
    Headers of the revisit replace those of the response by lower-case name,
    but for the forbidden ones; only resolved revisits get merged headers.
    Null urls or times are orphans; repeated rows come back each.

    Header names that differ by case only count as one, the smallest by code point.

    A URL with a third of all captures is no hot group: all captures are dealt
    into even ranges of (URL, time, id), each range is searched alone, and a
    range's last response to a URL is carried into later ones over one row each.
    """
    scratch = Scratch(records.sparkSession, "warc")
    keyed = records.select(
        "record_id", canonical_url(F.col("url")).alias("uri"), "ts", F.col("kind"), "etag", "last_modified", "headers"
    )
    usable = F.col("uri").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    times = keyed.where(usable).select("uri", "ts", "record_id", "kind")
    # ranges of the whole order are of even size however the captures of a URL or a moment pile up
    cut = scratch.keep(times.repartitionByRange("uri", "ts", "record_id").withColumn("slice", F.spark_partition_id()), "cut")
    response = F.when(F.col("kind") == "response", F.struct("ts", "record_id"))
    carried = (
        cut.groupBy("uri", "slice").agg(F.max(response).alias("last"))
        .withColumn("carry", F.max("last").over(W.partitionBy("uri").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)))
        .select("uri", "slice", "carry")
    )
    earlier = F.max(response).over(W.partitionBy("uri", "slice").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1))
    within = cut.withColumn("near", earlier).where("kind = 'revisit'").join(carried, ["uri", "slice"])
    found = within.select("record_id", F.coalesce("near", "carry")["record_id"].alias("refers_to")).dropDuplicates(["record_id"])
    revisits = keyed.where("kind = 'revisit'").join(found.withColumnRenamed("record_id", "rid"), F.col("record_id") == F.col("rid"), "left").drop("rid")
    full = keyed.where("kind = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("etag").alias("f_etag"), F.col("last_modified").alias("f_modified"), F.col("headers").alias("f_headers")
    ).dropDuplicates(["refers_to"])
    both = revisits.join(full, "refers_to", "left")
    strong = lambda c: F.regexp_replace(F.col(c), "^W/", "")  # noqa: E731  not-modified answers compare weakly
    agrees = (strong("etag") == strong("f_etag")), (F.col("last_modified") == F.col("f_modified"))
    differs = F.coalesce(~agrees[0], F.lit(False)) | (agrees[0].isNull() & F.coalesce(~agrees[1], F.lit(False)))
    verdict = (
        F.when(F.col("refers_to").isNull(), "orphan").when(differs, "mismatch").when(agrees[0].isNull() & agrees[1].isNull(), "unverified").otherwise("resolved")
    )
    fresh = F.map_filter(_lower_names("headers"), lambda k, v: ~k.isin(*FORBIDDEN))
    old = F.map_filter(_lower_names("f_headers"), lambda k, v: ~F.map_contains_key(fresh, k))
    return both.select(
        "record_id", "uri", "refers_to", verdict.alias("verdict"), F.when(verdict == "resolved", F.map_concat(old, fresh)).alias("headers")
    )


#: What stands between two records; the first one follows the version line alone.
BETWEEN = "\r\n\r\nWARC/1.0\r\n"
FIRST = "^WARC/1[.]0\r\n"


def _field(block: F.Column, name: str) -> F.Column:
    """The value of a header in a block of them, null if it isn't there; of several the first."""
    found = F.regexp_extract(block, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """WARC files as records for `resolve`: responses and not-modified revisits, other records left out.

    Files are cut at the lines between records, so plain ones are read in splits
    and no task holds a file; compressed ones are a split each. record_id is a
    hash of the record's own id, ts its date in microseconds; validators and
    headers are those of the HTTP answer in it, a repeated header by its first
    value. A record without id, URL or date has nulls there and resolves to
    nothing. A folder without files gives an empty table.
    """
    split = spark.read.option("lineSep", BETWEEN).text(path).select(F.regexp_replace("value", FIRST, "").alias("value")).where(F.trim("value") != "")
    head, block = F.substring_index("value", "\r\n\r\n", 1), F.regexp_extract("value", r"(?s)\A.*?\r\n\r\n(.*)\z", 1)
    parts = split.select(head.alias("head"), F.substring_index(block, "\r\n\r\n", 1).alias("http"))
    kind = F.lower(_field(F.col("head"), "WARC-Type"))
    lines = F.filter(F.split("http", "\r?\n"), lambda x: x.rlike(r"^[^\s:]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([^\s:]+):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^[^\s:]+:[ \t]*(.*?)\s*$", 1)).alias("value")))
    names = F.transform(pairs, lambda p: p["key"])
    headers = F.map_from_entries(F.filter(pairs, lambda p, k: F.array_position(names, p["key"]) == k + 1))
    named = parts.select("head", headers.alias("headers"), kind.alias("kind")).where(F.col("kind").isin("response", "revisit"))
    uri = F.regexp_replace(_field(F.col("head"), "WARC-Target-URI"), "^<|>$", "")
    when = F.try_to_timestamp(_field(F.col("head"), "WARC-Date"))
    return named.select(
        F.when(_field(F.col("head"), "WARC-Record-ID").isNotNull(), F.xxhash64(_field(F.col("head"), "WARC-Record-ID"))).alias("record_id"), uri.alias("url"), F.unix_micros(when).alias("ts"), "kind",
        F.try_element_at("headers", F.lit("etag")).alias("etag"), F.try_element_at("headers", F.lit("last-modified")).alias("last_modified"), "headers",
    )


def captures(pages: DataFrame) -> DataFrame:
    """An archive made of the pages table: each page's full response, and a later not-modified revisit of its URL.

    Times, validators and headers follow from page_id, so that SQL can state them.
    """
    pid = F.col("page_id")
    empty = F.lit(None).cast("string")
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    full = pages.select(
        (pid * 2).alias("record_id"), "url", (pid * 10).alias("ts"), F.lit("response").alias("kind"), etag.alias("etag"),
        F.concat(F.lit("day "), (pid % 7).cast("string")).alias("last_modified"),
        F.create_map(F.lit("Content-Length"), F.length("html").cast("string"), F.lit("Date"), (pid * 10).cast("string"), F.lit("Server"), F.lit("s")).alias("headers"),
    )
    later = pages.select(
        (pid * 2 + 1).alias("record_id"), F.concat(F.col("url"), F.lit("#again")).alias("url"), (pid * 10 + 25).alias("ts"), F.lit("revisit").alias("kind"),
        F.when(pid % 3 == 0, F.concat(F.lit("W/"), etag)).when(pid % 3 == 1, F.lit('"other"')).otherwise(empty).alias("etag"),
        F.when(pid % 2 == 0, F.concat(F.lit("day "), (pid % 7).cast("string"))).alias("last_modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("DATE"), (pid * 10 + 25).cast("string")).alias("headers"),
    )
    return full.unionByName(later)
