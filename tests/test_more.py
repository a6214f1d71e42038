"""Registered queries on rows that the given small tables lack."""

import os

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import quality, retrieval
from parley.plans import catalog, more  # noqa: F401  (registers the queries)
from parley.plans.bindings import Corpus
from parley.sources import stored, tables

SF = "/root/testdata/sf0.001"


def test_captures_of_one_address(spark, tmp_path):
    rows = [(1, "u", "one"), (2, "u", "two"), (4, "u", "four"), (3, "v", "three"), (7, "w", "seven"), (8, "x", "eight")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.html_hash for r in catalog.QUERIES["page_cache"](spark, str(tmp_path)).collect()}
    hashes = {r.page_id: r.h for r in Corpus(spark, str(tmp_path)).table("pages").selectExpr("page_id", "sha2(html, 256) AS h").collect()}
    assert got == {1: hashes[1], 4: hashes[4], 7: hashes[7], 2: None, 3: None, 8: None}


def nodes(plan):
    """All nodes of a logical plan."""
    yield plan
    below = plan.children()
    for k in range(below.size()):
        yield from nodes(below.apply(k))


def names(node):
    out = node.output()
    return {out.apply(k).name() for k in range(out.size())}


def test_lines_are_made_where_texts_are_read(spark, sf):
    stored.forget(spark)
    assert catalog.QUERIES["slice_films"](spark, sf).count() == 300 and not [k for k in stored._written if k[1].startswith("lines of")]
    many = spark.read.parquet(f"{sf}/documents.parquet").repartition(16)
    corpus = Corpus(spark, sf)
    corpus.table = lambda name: many
    plan = corpus.spoken._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the test's own
    assert set(corpus.lines.columns) == {"movie_id", "seq", "arc", "text", "text_norm"}


def test_only_keys_of_matches_meet_votes_and_vectors(spark, sf):
    for name in ("exact_arm", "keyword_arm", "search_misquote"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan()
        joins = [n for n in nodes(plan) if n.nodeName() == "Join" and {"votes", "size"} <= names(n)]
        assert joins or name == "search_misquote"
        assert not any("text" in names(n) or "text_norm" in names(n) for n in joins), name
        assert not any({"vec", "seq", "text"} <= names(n) for n in nodes(plan) if n.nodeName() == "Join"), name


def test_texts_join_what_is_shown(spark, sf):
    for name in ("search_misquote", "moment_hits", "nearest_per_film"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan()
        assert not any({"vec", "text"} <= names(n) for n in nodes(plan)), name


def test_lines_saying(spark):
    said = ["in the end we go", "the end", "begin the ending now", "in the  end", "x in the en", "in the end", "at the end of the", "", "the the the end", "we"]
    asked = [(0, "the end"), (1, "in the end"), (2, "in the en"), (3, "n the e"), (4, ""), (5, "we"), (6, "the the end"), (7, "zz"), (8, "end of the"), (9, "gin the ending n")]
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "movie_id long, text_norm string")
    got = retrieval.lines_saying(lines, spark.createDataFrame(asked, "item_id long, q string"))
    want = sorted((k, i) for k, t in enumerate(said) for i, q in asked if q and q in t)
    assert sorted((r.movie_id, r.item_id) for r in got.collect()) == want
    plan = catalog.QUERIES["benchmark_lookup"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "__word" in plan


def test_words_are_counted_where_lines_are_read(spark):
    odd = ["It's Él l'été – a\x00b’s 3x", "", "  ", "'a'--b''", "İI ſK Straße", "l l'll lI aIbIc a\"b l_ _l l"]
    lines = spark.createDataFrame([(k % 2, k, t) for k, t in enumerate(odd)], "movie_id long, seq long, text string")
    by = lambda c: [list(r.w) for r in lines.orderBy("seq").select(c.alias("w")).collect()]
    assert by(T.small_words(F.col("text"))) == by(F.filter(F.split(F.lower("text"), "[^a-z']+"), lambda w: w != ""))
    marks = [r.n for r in lines.orderBy("seq").select(T.ocr_hits(F.col("text")).alias("n")).collect()]
    plain = ("[a-z]I[a-z]", T.EDGE + "l" + T.EDGE, '[a-z]"[a-z]', T.EDGE + "l'(?:m|ll|ve|d|re|s)" + T.EDGE)
    assert marks == [r.n for r in lines.orderBy("seq").select(sum((F.regexp_count("text", F.lit(p)) for p in plain[1:]), F.regexp_count("text", F.lit(plain[0]))).alias("n")).collect()]
    dictionary = spark.createDataFrame([("it's",), ("l",), ("l",)], "word string")
    scored = quality.score_films(lines, dictionary)
    assert "hashpartitioning(movie_id#" in scored._jdf.queryExecution().executedPlan().toString() and ", word#" not in scored._jdf.queryExecution().executedPlan().toString()
    want = [sum(words.count(w) for w in ("it's", "l")) / len(words) for words in (sum(by(T.small_words(F.col("text")))[k::2], []) for k in (0, 1))]
    assert [r.dictionary_rate for r in scored.orderBy("movie_id").collect()] == [round(w, 3) for w in want]


def test_picks_score_only_lines_with_vectors(spark, sf):
    plan = catalog.QUERIES["quintile_picks"](spark, sf)._jdf.queryExecution().optimizedPlan()
    judged = [n for n in nodes(plan) if "__fit" in names(n)]
    assert judged and all(any(m.nodeName() == "Join" and "LeftSemi" in m.toString().split("\n")[0] for m in nodes(n)) for n in judged)


def test_store_is_appended_in_files(spark, tmp_path, monkeypatch):
    rows = [(k, k % 50, f"v{k}") for k in range(3_000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    read, seen = tables.read_store, []
    monkeypatch.setattr(tables, "read_store", lambda s, path, schema: seen.append(path) or read(s, path, schema))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.windowId: (r.at, r.value) for r in catalog.QUERIES["append_store"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {str(u): (2_950 + u, f"v{2_950 + u}") for u in range(50)}
    assert len([f for f in os.listdir(seen[0].removeprefix("file:")) if f.startswith("part-")]) > 1
