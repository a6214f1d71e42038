"""Registered queries: each a DataFrame plan over the bound tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions import misquotes
from ..operators import analytics, corpus, cues, film, genstore, ladder, quality, retrieval, titles
from ..sources import pages
from ..sources.stored import stored
from .bindings import CUES, LINES, LOG, MOVIES, PAIRED, QUALITY, QUERY, WINDOWS, Corpus, normal_sql, sql

PHRASE = "the"
WORDS = ["the", "and"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f: Callable[[Corpus], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def r(c, digits: int = 6):
    return F.round(c, digits)


# --- text -------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({normal_sql('text')}) AS norm_hash, length({normal_sql('text')})::INT AS n FROM documents")
def normalize_text(c: Corpus) -> DataFrame:
    norm = T.normalize(F.col("text"))
    return c.table("documents").select("doc_id", F.sha2(norm, 256).alias("norm_hash"), F.length(norm).alias("n"))


@query(f"""SELECT item_id, len(t)::INT AS n_tokens, array_to_string(t, '|') AS tokens FROM (
  SELECT item_id, list_filter(string_split({normal_sql('text')}, ' '), lambda x: x <> '') AS t FROM benchmark)""")
def tokenize(c: Corpus) -> DataFrame:
    return c.table("benchmark").withColumn("t", T.tokenize(F.col("text"))).select("item_id", F.size("t").alias("n_tokens"), F.array_join("t", "|").alias("tokens"))


@query(f"""SELECT item_id, array_to_string(list_filter(regexp_split_to_array({normal_sql('text')}, '['' ]'), lambda x: length(x) >= 2), '|') AS needles FROM benchmark""")
def token_needles(c: Corpus) -> DataFrame:
    return c.table("benchmark").select("item_id", F.array_join(T.needles(T.normalize(F.col("text"))), "|").alias("needles"))


@query(sql([MOVIES], r"""SELECT id, replace(regexp_replace(trim(regexp_replace(regexp_replace(replace(trim(lower(title)), '&', ' and '), '^(.*),\s*(the|a|an)$', '\2 \1'),
  '[^a-z0-9]+', ' ', 'g')), '^(the|a|an) ', ''), ' ', '') AS title_key FROM movies"""))
def title_keys(c: Corpus) -> DataFrame:
    return c.movies.select("id", T.title_key(F.col("title")).alias("title_key"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 220 THEN text WHEN instr(left(text, 220), ' ') > 0
  THEN regexp_extract(left(text, 220), '(?s)^(.*) ', 1) || '...' ELSE left(text, 219) || '...' END AS clipped FROM documents""")
def clip_excerpts(c: Corpus) -> DataFrame:
    return c.table("documents").select("doc_id", T.clip(F.col("text")).alias("clipped"))


@query("""SELECT doc_id, CASE WHEN len(t) > 4 THEN array_to_string(t[1:3], chr(10)) || chr(10) || '…' ELSE array_to_string(t, chr(10)) END AS shown
  FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS t FROM documents)""")
def moment_texts(c: Corpus) -> DataFrame:
    return c.table("documents").select("doc_id", T.moment_text(F.col("text")).alias("shown"))


@query(sql([f"t AS (SELECT item_id, list_distinct(list_filter(string_split({normal_sql('text')}, ' '), lambda x: x <> '')) AS t FROM benchmark)"],
  """SELECT a.item_id AS a, b.item_id AS b, round(CASE WHEN len(a.t) = 0 AND len(b.t) = 0 THEN 1 ELSE
  len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) END, 6) AS jaccard FROM t a JOIN t b ON b.item_id = a.item_id + 1"""))
def jaccard(c: Corpus) -> DataFrame:
    t = c.table("benchmark").select("item_id", T.tokenize(F.col("text")).alias("t"))
    other = t.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("t").alias("u"))
    return t.join(other, "item_id").select(F.col("item_id").alias("a"), "b", r(T.jaccard(F.col("t"), F.col("u"), 1.0)).alias("jaccard"))


@query(sql([LINES], """SELECT movie_id, left(sha256(string_agg(text, chr(10) ORDER BY seq) || chr(10)), 16) AS input_hash FROM lines GROUP BY movie_id"""))
def input_hash(c: Corpus) -> DataFrame:
    texts = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return c.table("documents").select(F.col("doc_id").alias("movie_id"), texts.alias("t")).where(F.size("t") > 0).select("movie_id", T.input_hash(F.col("t")).alias("input_hash"))


# --- sources ----------------------------------------------------------------


@query(r"""SELECT page_id, len(c)::INT AS n_cues, sha256(array_to_string(c, chr(10))) AS cues_hash FROM (
  SELECT page_id, list_filter(list_transform(string_split(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(1), 'g'), '<[^>\x01]+>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&mdash;', '-'), '&ndash;', '-'), '&hellip;', '...'), '&amp;', '&'),
    '<[^>\x01]+>', ' ', 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS c FROM pages)""")
def html_br_cues(c: Corpus) -> DataFrame:
    found = pages.break_cues(F.col("html"))
    return c.table("pages").select("page_id", found.alias("c")).select("page_id", F.size("c").alias("n_cues"), F.sha2(F.array_join("c", "\n"), 256).alias("cues_hash"))


NAMED_SQL = """replace(replace(replace(replace(replace(replace(replace(replace(replace({t}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&mdash;', '-'),
    '&ndash;', '-'), '&hellip;', '...'), '&amp;', '&')"""
PLAIN_PAGE = NAMED_SQL.format(t=r"regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', ' ', 'g'), '<[^>]+>', ' ', 'g')")


@query(sql([f"plain AS (SELECT page_id, {PLAIN_PAGE} AS t FROM pages)",
  r"""named AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS whole,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '(?i)\b(?:\d+\s+)?Part\s+\d+\b', ' ', 'g'),
      '\b[A-Z][A-Z''.]{2,}(?:\s+[A-Z][A-Z''.]{2,}){0,2}\b', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM plain)""",
  r"""cut AS (SELECT page_id, whole, list_filter(list_transform(string_split(regexp_replace(t, '([.?!…]["''”’]?)\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda x: trim(regexp_replace(x, '^\d+\s+', ''))), lambda x: length(x) > 1) AS c FROM named)""",
  """chosen AS (SELECT page_id, CASE WHEN len(c) > CASE WHEN whole = '' THEN 0 ELSE 1 END THEN c WHEN whole = '' THEN [] ELSE [whole] END AS c FROM cut)"""],
  "SELECT page_id, (i - 1)::INT AS idx, c[i] AS text FROM (SELECT page_id, c, unnest(range(1, len(c) + 1)) AS i FROM chosen)"))
def html_sentence_cues(c: Corpus) -> DataFrame:
    """Pages whose breaks are taken out: their sentences are the cues."""
    unbroken = F.regexp_replace("html", r"(?i)<br\s*/?>", " ")
    return c.table("pages").select("page_id", F.posexplode(pages.page_cues(unbroken)).alias("idx", "text"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', 1))::INT AS n_links,
  array_to_string(regexp_extract_all(html, '(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', 1), '|') AS hrefs FROM pages""")
def page_links(c: Corpus) -> DataFrame:
    found = pages.links(F.col("html"))
    return c.table("pages").select("page_id", F.size(found).alias("n_links"), F.array_join(found["href"], "|").alias("hrefs"))


@query(sql([r"""found AS (SELECT page_id, regexp_extract(html, '(?is)^.*?<div[^>]*class="[^"]*\bad\b[^"]*"[^>]*>(.*)$', 1) AS rest, regexp_matches(html, '(?i)<div[^>]*class="[^"]*\bad\b[^"]*"[^>]*>') AS any_div FROM pages)""",
  r"""parts AS (SELECT *, regexp_extract_all(rest, '(?i)</?div\b[^>]*>') AS tags, regexp_split_to_array(rest, '(?i)</?div\b[^>]*>') AS texts FROM found)""",
  """ended AS (SELECT *, list_filter(range(1, len(tags) + 1), lambda k: list_sum(list_transform(tags[1:k], lambda t: CASE WHEN t LIKE '</%' THEN -1 ELSE 1 END)) = -1)[1] AS k FROM parts)"""],
  """SELECT page_id, CASE WHEN NOT any_div THEN NULL WHEN k IS NULL THEN rest
    ELSE array_to_string(list_transform(range(1, k + 1), lambda i: CASE WHEN i > 1 THEN tags[i - 1] ELSE '' END || texts[i]), '') END AS inner_html FROM ended"""))
def page_ad_blocks(c: Corpus) -> DataFrame:
    return c.table("pages").select("page_id", pages.div_by_class(F.col("html"), "ad").alias("inner_html"))


@query(sql([LINES], "SELECT movie_id, count(*) AS n_lines, max(seq) AS last_seq, round(max(arc), 6) AS last_arc FROM lines GROUP BY movie_id"))
def line_positions(c: Corpus) -> DataFrame:
    return c.spoken.groupBy("movie_id").agg(F.count("*").alias("n_lines"), F.max("seq").alias("last_seq"), r(F.max("arc")).alias("last_arc"))


# --- retrieval --------------------------------------------------------------


@query(sql([MOVIES], f"SELECT id, title, year, votes FROM movies WHERE {normal_sql('title')} = (SELECT {normal_sql('title')} FROM movies ORDER BY id LIMIT 1) ORDER BY votes DESC, id LIMIT 1"))
def title_match(c: Corpus) -> DataFrame:
    asked = c.movies.orderBy("id").limit(1).select(T.normalize(F.col("title")).alias("n")).first()["n"]
    return retrieval.title_arm(c.movies, F.lit(asked)).select("id", "title", "year", "votes")


EXACT_SQL = f"""SELECT l.movie_id, l.seq, l.arc, l.text, row_number() OVER (ORDER BY votes DESC, length(text_norm), movie_id, seq)::INT AS rank, 'exact' AS arm
  FROM lines l JOIN movies m ON m.id = l.movie_id WHERE contains(text_norm, '{PHRASE}') ORDER BY rank LIMIT 50"""
KEYWORD_SQL = f"""SELECT l.movie_id, l.seq, l.arc, l.text, row_number() OVER (ORDER BY votes DESC, length(text_norm), movie_id, seq)::INT AS rank, 'keyword' AS arm
  FROM lines l JOIN movies m ON m.id = l.movie_id
  WHERE {' AND '.join(f"list_contains(regexp_split_to_array(text_norm, '[^a-z0-9]+'), '{w}')" for w in WORDS)} ORDER BY rank LIMIT 100"""
ARMS = [MOVIES, LINES, f"exact AS ({EXACT_SQL})", f"keyword AS ({KEYWORD_SQL})"]
FUSED = [*ARMS, """fused AS (SELECT movie_id, seq, sum(1.0::DOUBLE / (60 + rank)) AS fused, any_value(arc) AS arc, any_value(text) AS text,
  list_sort(list_distinct(list(arm))) AS arms FROM (FROM exact UNION ALL FROM keyword) GROUP BY movie_id, seq)"""]
HITS = [*FUSED, f"""scored AS (SELECT f.*, title, year, votes, list_contains(arms, 'exact') AS is_exact,
    fused + CASE WHEN list_contains(arms, 'exact') THEN 1 ELSE 0 END + log10(1.0::DOUBLE + votes) / 1e5 AS score, {normal_sql('f.text')} AS same FROM fused f JOIN movies m ON m.id = f.movie_id),
  numbered AS (SELECT *, count(*) OVER (PARTITION BY movie_id, same) AS occurrences, row_number() OVER (PARTITION BY movie_id, same
    ORDER BY is_exact DESC, CASE WHEN is_exact THEN votes ELSE 0 END DESC, round(score, 12) DESC, movie_id, seq) AS n FROM scored),
  hits AS (SELECT *, row_number() OVER (ORDER BY is_exact DESC, CASE WHEN is_exact THEN votes ELSE 0 END DESC, round(score, 12) DESC, movie_id, seq) AS position
    FROM numbered WHERE n = 1 ORDER BY position LIMIT 50)"""]


def _arms(c: Corpus) -> list[DataFrame]:
    return [retrieval.exact_arm(c.lines, c.movies, PHRASE), retrieval.keyword_arm(c.lines, c.movies, WORDS)]


def _hits(c: Corpus) -> DataFrame:
    return retrieval.ranked_hits(retrieval.fuse(_arms(c)), c.movies)


@query(sql(ARMS[:3], "SELECT movie_id, seq, round(arc, 6) AS arc, text, rank FROM exact"))
def exact_arm(c: Corpus) -> DataFrame:
    return _arms(c)[0].select("movie_id", "seq", r("arc").alias("arc"), "text", "rank")


@query(sql(ARMS, "SELECT movie_id, seq, round(arc, 6) AS arc, text, rank FROM keyword"))
def keyword_arm(c: Corpus) -> DataFrame:
    return _arms(c)[1].select("movie_id", "seq", r("arc").alias("arc"), "text", "rank")


@query(sql(FUSED, "SELECT movie_id, seq, round(fused, 9) AS fused, array_to_string(arms, '+') AS arms FROM fused"))
def rrf_fusion(c: Corpus) -> DataFrame:
    return retrieval.fuse(_arms(c)).select("movie_id", "seq", r("fused", 9).alias("fused"), F.array_join("arms", "+").alias("arms"))


@query(sql(HITS, "SELECT movie_id, title, year, seq, text, round(score, 9) AS score FROM hits"))
def search_topk(c: Corpus) -> DataFrame:
    return _hits(c).select("movie_id", "title", "year", "seq", "text", r("score", 9).alias("score"))


@query(sql(HITS, "SELECT movie_id, seq, occurrences FROM hits"))
def dedup_occurrences(c: Corpus) -> DataFrame:
    return _hits(c).select("movie_id", "seq", "occurrences")


@query(sql([*HITS, """drops AS (SELECT position AS p, round(score / greatest(lead(score) OVER (ORDER BY position), 1e-9), 12) AS ratio FROM hits)"""],
  """SELECT CASE WHEN (SELECT count(*) FROM drops) >= 4 AND (SELECT max(ratio) FROM drops WHERE p <= 20) >= 1.5
  THEN (SELECT p FROM drops WHERE p <= 20 ORDER BY ratio DESC, p LIMIT 1) ELSE (SELECT count(*) FROM drops) END AS strong"""))
def score_cliff(c: Corpus) -> DataFrame:
    return retrieval.score_cliff(retrieval.positioned(_hits(c)))


@query(sql([MOVIES, LINES], f"""SELECT * FROM (SELECT count(DISTINCT movie_id) AS films, count(*) AS occurrences, min(year) AS first_year, arg_min(title, (year, movie_id)) AS first_title
  FROM lines l JOIN movies m ON m.id = l.movie_id WHERE contains(text_norm, '{PHRASE}')) WHERE films >= 8"""))
def phrase_stats(c: Corpus) -> DataFrame:
    return retrieval.phrase_totals(c.lines, c.movies, PHRASE)


@query(sql([LINES], f"""SELECT b::INT AS bucket, coalesce(n, 0) AS n FROM range(10) x(b) LEFT JOIN (
  SELECT least(floor(arc * 10), 9)::INT AS k, count(*) AS n FROM lines WHERE contains(text_norm, '{PHRASE}') GROUP BY 1) ON k = b"""))
def phrase_arc_histogram(c: Corpus) -> DataFrame:
    return retrieval.phrase_arc(c.lines, PHRASE)


@query(sql([MOVIES, LINES], f"""SELECT c.decade, coalesce(films, 0) AS films, corpus_films, round(coalesce(films, 0)::DOUBLE / corpus_films, 6) AS share
  FROM (SELECT decade, count(*) AS corpus_films FROM movies GROUP BY 1) c LEFT JOIN (
    SELECT decade, count(DISTINCT movie_id) AS films FROM lines l JOIN movies m ON m.id = l.movie_id WHERE contains(text_norm, '{PHRASE}') GROUP BY 1) USING (decade)"""))
def phrase_decade_share(c: Corpus) -> DataFrame:
    return retrieval.phrase_decades(c.lines, c.movies, PHRASE).select("decade", "films", "corpus_films", r("share").alias("share"))


KNN = "1 - list_dot_product(vec, v) / sqrt(list_dot_product(vec, vec) * list_dot_product(v, v))"


@query(sql([WINDOWS, QUERY], f"SELECT vec_id, round({KNN}, 6) AS dist FROM windows, q ORDER BY {KNN}, vec_id LIMIT 24"))
def knn_cosine(c: Corpus) -> DataFrame:
    return retrieval.nearest(c.windows, V.literal(c.query_vector), 24, "vec_id").select("vec_id", r("dist").alias("dist"))


@query(sql([WINDOWS, QUERY, QUALITY], f"""SELECT vec_id, movie_id, round({KNN}, 6) AS dist FROM windows, q
  WHERE movie_id NOT IN (SELECT movie_id FROM quality WHERE non_english OR downrank) ORDER BY {KNN}, vec_id LIMIT 24"""))
def knn_exclude_flagged(c: Corpus) -> DataFrame:
    rows = c.windows.join(retrieval.flagged(c.quality), "movie_id", "left_anti")
    return retrieval.nearest(rows, V.literal(c.query_vector), 24, "vec_id").select("vec_id", "movie_id", r("dist").alias("dist"))


CLIPPED = """CASE WHEN length({t}) <= 220 THEN {t} WHEN instr(left({t}, 220), ' ') > 0 THEN regexp_extract(left({t}, 220), '(?s)^(.*) ', 1) || '...' ELSE left({t}, 219) || '...' END"""


@query(sql([WINDOWS, QUERY, QUALITY, MOVIES, f"""near AS (SELECT movie_id, idx, arc, start_seq, {KNN} AS dist FROM windows, q
    WHERE movie_id <> 0 AND movie_id NOT IN (SELECT movie_id FROM quality WHERE non_english OR downrank) ORDER BY dist, movie_id, idx LIMIT 16)""",
  """one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY dist, idx) AS n FROM near) WHERE n = 1 ORDER BY dist, movie_id LIMIT 8)""",
  f"""cut AS (SELECT one.*, title, year, {CLIPPED.format(t='text')} AS clipped FROM one JOIN movies m ON m.id = one.movie_id JOIN documents d ON d.doc_id = one.movie_id)"""],
  f"""SELECT movie_id, title, year, round(arc, 6) AS arc, start_seq, round(1 - dist, 6) AS score, {CLIPPED.format(t="array_to_string(string_split(clipped, chr(10))[1:3], chr(10))")} AS excerpt,
    array_to_string(list_filter(string_split(clipped, chr(10)), lambda x: x <> '')[1:25], chr(10)) AS expanded FROM cut"""))
def nearest_per_film(c: Corpus) -> DataFrame:
    near = film.nearest_beats(c.beats, c.quality, c.movies, 0, V.literal(c.query_vector), texts=c.texts)
    return near.select("movie_id", "title", "year", r("arc").alias("arc"), "start_seq", r("score").alias("score"), "excerpt", F.array_join("expanded_lines", "\n").alias("expanded"))


MOMENTS = [WINDOWS, QUERY, QUALITY, MOVIES, f"""far AS (SELECT w.*, d.text, {KNN} AS dist FROM windows w JOIN documents d ON d.doc_id = w.movie_id, q)""",
  """span24 AS (SELECT movie_id, start_seq, end_seq, dist FROM (SELECT w.*, """ + KNN + """ AS dist FROM windows w, q) WHERE movie_id NOT IN (SELECT movie_id FROM quality WHERE non_english OR downrank)
    ORDER BY dist, movie_id, start_seq LIMIT 24)""",
  """span12 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY dist, start_seq) AS n FROM span24) WHERE n = 1 ORDER BY dist, movie_id LIMIT 12)""",
  """shown12 AS (SELECT s.movie_id, s.dist, min(struct_pack(idx := f.idx, start_seq := f.start_seq, arc := f.arc, text := f.text)) AS x FROM span12 s JOIN far f ON f.movie_id = s.movie_id AND f.end_seq >= s.start_seq AND f.start_seq <= s.end_seq GROUP BY ALL)""",
  """merged AS (SELECT movie_id, x.start_seq AS start_seq, x.arc AS arc, x.text AS text, dist, 0 AS kind FROM shown12
    UNION ALL SELECT * FROM (SELECT movie_id, start_seq, arc, text, dist, 1 FROM far ORDER BY dist, movie_id, idx LIMIT 24))""",
  """placed AS (SELECT *, row_number() OVER (ORDER BY round(dist, 12), kind, movie_id, start_seq) AS rank FROM merged)""",
  """moments AS (SELECT p.movie_id, title, year, start_seq AS seq, arc, CASE WHEN len(t) > 4 THEN array_to_string(t[1:3], chr(10)) || chr(10) || '…' ELSE array_to_string(t, chr(10)) END AS text, 1.8::DOUBLE / (60 + rank) AS score
    FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS t, row_number() OVER (PARTITION BY movie_id ORDER BY rank) AS n FROM placed) p JOIN movies m ON m.id = p.movie_id WHERE n = 1)"""]


@query(sql(MOMENTS, "SELECT movie_id, title, seq, text, round(score, 6) AS score FROM moments"))
def moment_hits(c: Corpus) -> DataFrame:
    return retrieval.moments(c.beats, c.windows, c.quality, c.movies, V.literal(c.query_vector), texts=c.texts).select("movie_id", "title", "seq", "text", r("score").alias("score"))


def _search(c: Corpus, asked: str) -> DataFrame:
    """All arms and the moments over the bound vectors; a window's vector stands for its first line's."""
    vectors = c.windows.select("movie_id", F.col("start_seq").alias("seq"), "vec").join(c.lines.select("movie_id", "seq"), ["movie_id", "seq"], "left_semi")
    found = retrieval.search(
        c.lines, c.movies, asked, V.literal(c.query_vector), vectors=vectors, beats=c.beats, summaries=c.windows, quality=c.quality, misquotes=misquotes.table(c.spark), texts=c.texts
    )
    return found.withColumn("score", r("score", 9)).withColumn("arc", r("arc"))


def _search_sql(norm: str, words: list[str], misquote: str = "SELECT '' AS film, 0 AS year, '' AS actual WHERE false") -> str:
    """The whole search in one statement. A near miss needs a word difference, which is null here if one ever has to be judged."""
    has = " AND ".join(f"list_contains(regexp_split_to_array(text_norm, '[^a-z0-9]+'), '{w}')" for w in words) or "false"
    fame = "row_number() OVER (ORDER BY votes DESC, length(text_norm), movie_id, seq)"
    arm = "SELECT l.movie_id, l.seq, l.arc, l.text, {rank}::INT AS rank, '{name}' AS arm FROM lines l {join} WHERE {where} ORDER BY rank LIMIT {n}"
    votes = "JOIN movies m ON m.id = l.movie_id"
    order = "is_exact DESC, CASE WHEN is_exact THEN votes ELSE 0 END DESC, round(score, 12) DESC, movie_id, seq"
    return sql([*MOMENTS, LINES,
      "exact AS (" + arm.format(rank=fame, name="exact", join=votes, where=f"contains(text_norm, '{norm}')", n=50) + ")",
      "keyword AS (" + arm.format(rank=fame, name="keyword", join=votes, where=has, n=100) + ")",
      "semantic AS (" + arm.format(rank=f"row_number() OVER (ORDER BY {KNN}, l.movie_id, l.seq)", name="semantic", join="JOIN windows w ON w.movie_id = l.movie_id AND w.start_seq = l.seq, q", where="true", n=100) + ")",
      """fused AS (SELECT movie_id, seq, sum(1.0::DOUBLE / (60 + rank)) AS fused, any_value(arc) AS arc, any_value(text) AS text,
        array_to_string(list_sort(list_distinct(list(arm))), '+') AS arms FROM (FROM exact UNION ALL FROM keyword UNION ALL FROM semantic) GROUP BY movie_id, seq)""",
      f"""scored AS (SELECT f.*, title, year, votes, contains(arms, 'exact') AS is_exact,
        fused + CASE WHEN contains(arms, 'exact') THEN 1 ELSE 0 END + log10(1.0::DOUBLE + votes) / 1e5 AS score, {normal_sql('f.text')} AS same FROM fused f JOIN movies m ON m.id = f.movie_id)""",
      f"""hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY movie_id, same ORDER BY {order}) AS n FROM scored) WHERE n = 1 ORDER BY {order} LIMIT 50)""",
      f"""found AS (SELECT 'line' AS kind, movie_id, title, year, seq, arc, text, score, arms, row_number() OVER (ORDER BY {order}) AS position FROM hits WHERE EXISTS (FROM exact)
        UNION ALL SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, movie_id, seq) FROM (
          SELECT * FROM (SELECT 'line', movie_id, title, year, seq, arc, text, score, arms FROM hits
            UNION ALL SELECT 'moment', movie_id, title, year, seq, arc, text, score, 'moment' FROM moments WHERE (movie_id, seq) NOT IN (SELECT (movie_id, seq) FROM hits))
          WHERE NOT EXISTS (FROM exact) ORDER BY round(score, 12) DESC, movie_id, seq LIMIT 50))""",
      """drops AS (SELECT position AS p, round(score / greatest(lead(score) OVER (ORDER BY position), 1e-9), 12) AS ratio FROM found)""",
      """cliff AS (SELECT CASE WHEN count(*) >= 4 AND max(ratio) FILTER (WHERE p <= 20) >= 1.5 THEN (SELECT p FROM drops WHERE p <= 20 ORDER BY ratio DESC, p LIMIT 1) ELSE count(*) END AS strong FROM drops)""",
      f"misquote AS ({misquote})"],
      f"""SELECT kind, movie_id, title, year, seq, round(arc, 6) AS arc, text, round(score, 9) AS score, position::INT AS position, position <= strong AS strong,
        CASE WHEN position = 1 AND arms = 'semantic' AND NOT EXISTS (FROM misquote) THEN NULL ELSE false END AS near_miss FROM found, cliff
      UNION ALL SELECT * FROM (SELECT 'title', id, title, year, NULL, NULL, NULL, NULL, 0, NULL, NULL FROM movies WHERE {normal_sql('title')} = '{norm}' ORDER BY votes DESC, id LIMIT 1)
      UNION ALL SELECT 'misquote', NULL, film, year, NULL, NULL, actual, NULL, NULL, NULL, NULL FROM misquote
      UNION ALL SELECT 'phrase', NULL, first_title, first_year, occurrences, NULL, NULL, films, NULL, NULL, NULL FROM (
        SELECT count(DISTINCT movie_id) AS films, count(*) AS occurrences, min(year) AS first_year, arg_min(title, (year, movie_id)) AS first_title
        FROM lines l JOIN movies m ON m.id = l.movie_id WHERE contains(text_norm, '{norm}')) WHERE films >= 8 AND (SELECT count(*) FROM exact) >= 8 AND NOT EXISTS (FROM misquote)""")


@query(_search_sql(PHRASE, [PHRASE]))
def search_full(c: Corpus) -> DataFrame:
    """The whole search of a phrase that many lines hold."""
    return _search(c, PHRASE)


@query(_search_sql(f"{PHRASE} xyzzy", [PHRASE, "xyzzy"]))
def search_no_exact(c: Corpus) -> DataFrame:
    """The whole search of what no line says: moments join."""
    return _search(c, f"{PHRASE} xyzzy")


@query(_search_sql("play it again sam", ["play", "it", "again", "sam"], "SELECT 'Casablanca' AS film, 1942 AS year, 'Play it, Sam. Play ''As Time Goes By.''' AS actual"))
def search_misquote(c: Corpus) -> DataFrame:
    """The whole search of a saying that is really another one."""
    return _search(c, "Play it again, Sam!")


@query("SELECT 1::BIGINT AS hits, true AS by_title")
def search_title(c: Corpus) -> DataFrame:
    """The film whose title is asked comes first."""
    film = c.movies.orderBy("id").limit(1)
    asked = film.first()["title"]
    found = retrieval.search(c.lines, c.movies, asked).where("kind = 'title'")
    return found.join(film.select("id"), F.col("movie_id") == F.col("id")).agg(F.count("*").alias("hits"), (F.max("position") == 0).alias("by_title"))


DIFF = [f"""w AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(trim(text), '\\s+'), lambda x: {normal_sql('x')}), lambda x: x <> '') AS t FROM benchmark)""",
  """p AS (SELECT a.item_id, a.t AS x, b.t AS y FROM w a JOIN w b ON b.item_id = a.item_id + 1)""",
  # one row of the table of common subsequences a step: its running maxima over j of above[j] and above[j - 1] + (words agree)
  """lcs AS (SELECT item_id, x, y, 0 AS i, list_transform(range(0, len(y) + 1), lambda j: 0) AS above FROM p
    UNION ALL SELECT item_id, x, y, i + 1, list_transform(range(1, len(y) + 2), lambda j: list_max(c[1:j])) FROM (
      SELECT item_id, x, y, i, list_transform(range(1, len(y) + 2), lambda j: CASE WHEN j = 1 THEN 0 ELSE greatest(above[j], above[j - 1] + (x[i + 1] = y[j - 1])::INT) END) AS c FROM lcs WHERE i < len(x)))""",
  """shared AS (SELECT item_id, len(x) AS n, len(y) AS m, list_max(above) AS s FROM lcs WHERE i = len(x))"""]


@query(sql(DIFF, """SELECT item_id, s::INT AS shared, (least(n, m) - s)::INT AS substitutions, abs(n - m)::INT AS extras, round(CASE WHEN greatest(n, m) = 0 THEN 1 ELSE s::DOUBLE / greatest(n, m) END, 6) AS shared_ratio,
  least(n, m) - s BETWEEN 1 AND 3 AND abs(n - m) <= 2 AND CASE WHEN greatest(n, m) = 0 THEN 1 ELSE s::DOUBLE / greatest(n, m) END >= 0.6 AS near_miss FROM shared""").replace("WITH ", "WITH RECURSIVE ", 1))
def near_miss_diff(c: Corpus) -> DataFrame:
    from ..functions.diff import diff_stats, near_miss

    a = c.table("benchmark").select("item_id", "text")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    d = a.join(b, "item_id").select("item_id", diff_stats("text", "other").alias("d"))
    return d.select("item_id", "d.shared", "d.substitutions", "d.extras", r("d.shared_ratio").alias("shared_ratio"), near_miss(F.col("d")).alias("near_miss"))


# --- film -------------------------------------------------------------------


@query(sql([MOVIES, LINES], "SELECT id, title, year, votes, (SELECT count(*) FROM lines WHERE movie_id = id) AS line_count FROM movies"))
def film_header(c: Corpus) -> DataFrame:
    return film.headers(c.movies, c.spoken).select("id", "title", "year", "votes", "line_count")


@query(sql([LINES], """SELECT movie_id, seq, round(arc, 6) AS arc, text FROM lines WHERE (movie_id, seq) IN (SELECT movie_id, unnest([0, 2, 4]) FROM lines)"""))
def five_lines_lookup(c: Corpus) -> DataFrame:
    picks = c.table("documents").select(F.col("doc_id").alias("movie_id"), F.array(F.lit(0), F.lit(2), F.lit(4)).alias("seqs"))
    return film.five_lines(picks, c.spoken).select("movie_id", "seq", r("arc").alias("arc"), "text")


@query(sql([WINDOWS], """SELECT movie_id, seq, idx, start_seq, end_seq FROM (
  SELECT w.movie_id, a.seq, idx, start_seq, end_seq, row_number() OVER (PARTITION BY w.movie_id, a.seq ORDER BY abs(start_seq + end_seq - 2 * a.seq), idx) AS n
  FROM (SELECT DISTINCT movie_id, start_seq + 4 AS seq FROM windows) a JOIN windows w ON w.movie_id = a.movie_id AND start_seq <= a.seq AND end_seq >= a.seq) WHERE n = 1"""))
def span_nearest_midpoint(c: Corpus) -> DataFrame:
    asked = c.windows.select("movie_id", (F.col("start_seq") + 4).alias("seq")).distinct()
    return film.span_at(c.windows, asked)


@query(sql([WINDOWS], """SELECT a.movie_id, a.s, a.e, min(idx) AS idx, arg_min(w.start_seq, idx) AS start_seq, arg_min(w.end_seq, idx) AS end_seq
  FROM (SELECT DISTINCT movie_id, start_seq + 14 AS s, start_seq + 20 AS e FROM windows) a JOIN windows w ON w.movie_id = a.movie_id AND end_seq >= s AND start_seq <= e GROUP BY ALL"""))
def span_overlap_first(c: Corpus) -> DataFrame:
    asked = c.windows.select("movie_id", (F.col("start_seq") + 14).alias("s"), (F.col("start_seq") + 20).alias("e")).distinct()
    return film.first_overlap(c.windows, asked)


# --- ladder -----------------------------------------------------------------

BEATS = ["""counted AS (SELECT movie_id, count(*) AS n FROM lines GROUP BY 1)""",
  """spans AS (SELECT movie_id, n, k AS idx, 6 * k AS start_seq, least(6 * k + 12, n) - 1 AS end_seq FROM counted, range(0, (SELECT max(n) FROM counted)) t(k)
    WHERE CASE WHEN n <= 12 THEN k = 0 ELSE 6 * k < n - 6 AND (k = 0 OR 6 * k + 6 < n) END)"""]


@query(sql([LINES, *BEATS], """SELECT s.movie_id, idx::INT AS idx, start_seq::INT AS start_seq, end_seq::INT AS end_seq,
  round(CASE WHEN n <= 12 THEN 0.5 ELSE (start_seq + end_seq)::DOUBLE / 2 / (n - 1) END, 6) AS arc, string_agg(l.text, chr(10) ORDER BY l.seq) AS text
  FROM spans s JOIN lines l ON l.movie_id = s.movie_id AND l.seq BETWEEN start_seq AND end_seq GROUP BY ALL"""))
def beat_windows(c: Corpus) -> DataFrame:
    return ladder.beats(c.spoken).withColumn("arc", r("arc"))


@query(sql([WINDOWS], """SELECT movie_id, idx, round(list_dot_product(vec, lead(vec) OVER (PARTITION BY movie_id ORDER BY idx)), 6) AS sim FROM windows"""))
def beat_similarity(c: Corpus) -> DataFrame:
    return ladder.neighbour_similarity(c.windows).select("movie_id", "idx", r("sim").alias("sim"))


CUTS = [WINDOWS, """sims AS (SELECT movie_id, idx, list_dot_product(vec, lead(vec) OVER (PARTITION BY movie_id ORDER BY idx)) AS sim FROM windows)""",
  """films AS (SELECT movie_id, count(*) AS n, avg(sim) - stddev_pop(sim) AS low FROM sims GROUP BY 1)""",
  """walk AS (SELECT movie_id, -1::BIGINT AS i, 0::BIGINT AS began, false AS cut FROM films
    UNION ALL SELECT w.movie_id, s.idx, CASE WHEN w.cut THEN w.i + 1 ELSE w.began END,
      (s.sim < f.low AND s.idx + 1 - CASE WHEN w.cut THEN w.i + 1 ELSE w.began END >= 2) OR s.idx + 1 - CASE WHEN w.cut THEN w.i + 1 ELSE w.began END >= 12
    FROM walk w JOIN films f USING (movie_id) JOIN sims s ON s.movie_id = w.movie_id AND s.idx = w.i + 1 AND s.sim IS NOT NULL)""",
  """cuts AS (SELECT movie_id, i AS e, f.n, row_number() OVER (PARTITION BY movie_id ORDER BY i) AS k, count(*) OVER (PARTITION BY movie_id) AS m,
      max(i) OVER (PARTITION BY movie_id) AS last FROM walk JOIN films f USING (movie_id) WHERE cut)""",
  """ends AS (SELECT movie_id, CASE WHEN k = m AND n - last - 1 < 2 THEN n - 1 ELSE e END AS e FROM cuts
    UNION SELECT movie_id, n - 1 FROM films)""",
  """segs AS (SELECT movie_id, row_number() OVER w - 1 AS idx, coalesce(lag(e) OVER w + 1, 0) AS start_beat, e AS end_beat FROM ends WINDOW w AS (PARTITION BY movie_id ORDER BY e))"""]


def _recursive(ctes: list[str], body: str) -> str:
    return sql(ctes, body).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(CUTS, "SELECT movie_id, idx::INT AS idx, start_beat::INT AS start_beat, end_beat::INT AS end_beat FROM segs"))
def segment_cut(c: Corpus) -> DataFrame:
    return ladder.segment_spans(c.windows)


@query(_recursive(CUTS, """SELECT s.movie_id, s.idx::INT AS idx, a.start_seq, b.end_seq, round((a.arc + b.arc) / 2, 6) AS arc,
  round(sqrt((SELECT sum(p * p) FROM (SELECT sum(x) AS p FROM (SELECT unnest(vec) AS x, unnest(range(64)) AS d FROM windows w WHERE w.movie_id = s.movie_id AND w.idx BETWEEN s.start_beat AND s.end_beat) GROUP BY d))) , 5) AS length
  FROM segs s JOIN windows a ON a.movie_id = s.movie_id AND a.idx = s.start_beat JOIN windows b ON b.movie_id = s.movie_id AND b.idx = s.end_beat"""))
def segment_rollup(c: Corpus) -> DataFrame:
    made = ladder.segments(c.windows)
    spans = made.select("movie_id", F.col("idx").alias("segment"), "vec", "start_seq", "end_seq", "arc", F.explode(F.sequence("start_beat", "end_beat")).alias("idx"))
    # the unit mean against the sum of its members gives the sum's length
    joined = spans.join(c.windows.select("movie_id", "idx", F.col("vec").alias("x")), ["movie_id", "idx"])
    return joined.groupBy("movie_id", F.col("segment").alias("idx"), "start_seq", "end_seq", r("arc").alias("arc")).agg(r(F.sum(V.dot(F.col("vec"), F.col("x"))), 5).alias("length"))


@query(sql([WINDOWS], """SELECT movie_id, d::INT AS pos, round(s / sqrt(sum(s * s) OVER (PARTITION BY movie_id)), 6) AS x FROM (
  SELECT movie_id, d, sum(x) AS s FROM (SELECT movie_id, unnest(vec) AS x, unnest(range(64)) AS d FROM windows) GROUP BY 1, 2)"""))
def centroid(c: Corpus) -> DataFrame:
    return corpus.film_vectors(c.windows).select("movie_id", F.posexplode("vec").alias("pos", "x")).withColumn("x", r("x"))


# --- corpus -----------------------------------------------------------------

RAW = [WINDOWS, """near AS (SELECT a.movie_id, a.idx, CASE WHEN a.movie_id = b.movie_id THEN -1 ELSE list_dot_product(a.vec, b.vec) END AS sim FROM windows a, windows b)""",
  """raw AS (SELECT movie_id, idx, avg(sim) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY movie_id, idx ORDER BY sim DESC) AS n FROM near) WHERE n <= 32 GROUP BY 1, 2)""",
  """generic AS (SELECT *, (raw - min(raw) OVER ()) / greatest(max(raw) OVER () - min(raw) OVER (), 1e-9) AS generic FROM raw)"""]


def _generic(c: Corpus) -> DataFrame:
    return stored(c.spark, f"generic of {c.dir}", lambda: corpus.genericness(c.windows))


@query(sql(RAW, "SELECT movie_id, idx, round(raw, 6) AS raw, round(generic, 6) AS generic FROM generic"))
def genericness_topk_mean(c: Corpus) -> DataFrame:
    return _generic(c).select("movie_id", "idx", r("raw").alias("raw"), r("generic").alias("generic"))


@query(sql([MOVIES], "SELECT id, round((votes - min(votes) OVER ())::DOUBLE / greatest(max(votes) OVER () - min(votes) OVER (), 1e-9), 6) AS scaled FROM movies"))
def minmax_norm(c: Corpus) -> DataFrame:
    return corpus.min_max(c.movies, "votes", "scaled").select("id", r("scaled").alias("scaled"))


BEST = [WINDOWS, """best AS (SELECT a.movie_id, a.idx, b.movie_id AS other, max(list_dot_product(a.vec, b.vec)) AS best FROM windows a JOIN windows b ON a.movie_id <> b.movie_id GROUP BY ALL)""",
  """one AS (SELECT movie_id, other, avg(c) AS c FROM (SELECT *, best - avg(best) OVER (PARTITION BY movie_id, idx) AS c FROM best) GROUP BY 1, 2)""",
  """sym AS (SELECT a.movie_id, a.other, (a.c + b.c) / 2 AS raw FROM one a JOIN one b ON a.movie_id = b.other AND a.other = b.movie_id)""",
  """seg AS (SELECT *, least(1, greatest(0, (raw - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END)) AS seg FROM sym, (SELECT quantile_cont(raw::DOUBLE, 0.01) AS lo, quantile_cont(raw::DOUBLE, 0.99) AS hi FROM sym))"""]
META = """0.5 * len(list_intersect(list_distinct({a}.genre_ids), list_distinct({b}.genre_ids)))::DOUBLE / len(list_distinct(list_concat({a}.genre_ids, {b}.genre_ids)))
  + 0.2 * greatest(0, 1 - abs({a}.decade - {b}.decade)::DOUBLE / 40)
  + 0.3 * len(list_intersect({a}.keyword_ids, {b}.keyword_ids))::DOUBLE / len(list_distinct(list_concat({a}.keyword_ids, {b}.keyword_ids)))"""


@query(sql(BEST, "SELECT movie_id, other, round(raw, 6) AS raw, round(seg, 6) AS seg FROM seg"))
def film_pair_score(c: Corpus) -> DataFrame:
    scored = corpus.clipped(corpus.film_scores(corpus.best_matches(c.windows)))
    return scored.select("movie_id", "other", r("raw").alias("raw"), r("seg").alias("seg"))


@query(sql([MOVIES, *BEST], f"""SELECT movie_id, n::INT AS rank, other AS similar_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY round(score, 12) DESC, other DESC) AS n FROM (
  SELECT s.movie_id, s.other, 0.7 * seg + 0.3 * ({META.format(a='a', b='b')}) AS score FROM seg s JOIN movies a ON a.id = s.movie_id JOIN movies b ON b.id = s.other)) WHERE n <= 12"""))
def pair_topk(c: Corpus) -> DataFrame:
    scored = corpus.clipped(corpus.film_scores(corpus.best_matches(c.windows)))
    return corpus.similar_films(scored, c.movies)


@query(sql([MOVIES], f"SELECT a.id AS a, b.id AS b, round({META.format(a='a', b='b')}, 6) AS similarity FROM movies a JOIN movies b ON b.id = a.id + 1"))
def metadata_similarity(c: Corpus) -> DataFrame:
    a = c.movies.select("id", "decade", "genre_ids", "keyword_ids")
    b = c.movies.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), *(F.col(k).alias(f"b_{k}") for k in ("decade", "genre_ids", "keyword_ids")))
    cols = lambda p: {k: F.col(p + k) for k in ("decade", "genre_ids", "keyword_ids")}
    return a.join(b, "id").select(F.col("id").alias("a"), "b", r(corpus.metadata_similarity(cols(""), cols("b_"))).alias("similarity"))


SEGMENTS = """segments AS (SELECT s.movie_id, s.idx, s.start_beat, s.end_beat, a.start_seq, b.end_seq FROM segs s
  JOIN windows a ON a.movie_id = s.movie_id AND a.idx = s.start_beat JOIN windows b ON b.movie_id = s.movie_id AND b.idx = s.end_beat)"""
RANKED = [*CUTS, *RAW[1:], SEGMENTS, """means AS (SELECT s.movie_id, s.idx, avg(generic) AS score FROM segments s JOIN generic g ON g.movie_id = s.movie_id AND g.idx BETWEEN start_beat AND end_beat GROUP BY ALL)""",
  """ranked AS (SELECT s.*, score, row_number() OVER (PARTITION BY s.movie_id ORDER BY round(score, 12), s.idx) - 1 AS rank FROM segments s JOIN means USING (movie_id, idx))"""]


def _ranked(c: Corpus) -> DataFrame:
    return corpus.ranked_windows(ladder.segments(c.windows), _generic(c))


@query(_recursive(RANKED, "SELECT movie_id, idx::INT AS idx, round(score, 6) AS score, rank::INT AS rank FROM ranked"))
def rank_windows(c: Corpus) -> DataFrame:
    return _ranked(c).select("movie_id", "idx", r("score").alias("score"), "rank")


@query(_recursive(RANKED, "SELECT movie_id, start_seq, end_seq FROM ranked WHERE rank < 10"))
def tier_windows(c: Corpus) -> DataFrame:
    return corpus.tier(_ranked(c), "1").select("movie_id", "start_seq", "end_seq")


DF = [LINES, """df AS (SELECT token, count(DISTINCT movie_id) AS df FROM (SELECT movie_id, unnest(string_split(text_norm, ' ')) AS token FROM lines) WHERE token <> '' GROUP BY 1)""",
  """idf AS (SELECT *, ln((SELECT count(*) FROM documents)::DOUBLE / (1 + df)) AS idf FROM df)"""]


def _idf(c: Corpus) -> DataFrame:
    return corpus.inverse_frequency(corpus.document_frequency(c.lines), c.movies)


@query(sql(DF, "SELECT token, df, round(idf, 6) AS idf FROM idf"))
def df_idf(c: Corpus) -> DataFrame:
    return _idf(c).select("token", "df", r("idf").alias("idf"))


CAPITALS = r"len(list_filter(regexp_split_to_array({t}, '\s+')[2:], lambda x: regexp_matches(x, '^[A-Z]')))::DOUBLE / greatest(len(regexp_split_to_array({t}, '\s+')) - 1, 1)"
DISTINCT = [*DF, """sums AS (SELECT movie_id, seq, count(*) AS n, sum(idf) / sqrt(count(*)) AS d, count(*) FILTER (WHERE df > 0.2::DOUBLE * (SELECT count(*) FROM documents))::DOUBLE / count(*) AS common
    FROM (SELECT movie_id, seq, unnest(string_split(text_norm, ' ')) AS token FROM lines) JOIN idf USING (token) GROUP BY 1, 2)""",
  rf"""judged AS (SELECT l.movie_id, l.seq, l.arc, l.text, CASE WHEN length(text) BETWEEN 25 AND 120 AND n >= 4
    AND NOT regexp_matches(text, '(?i)\b(dedicated to|in (loving )?memory|subtitles? by|directed by|produced by|screenplay by|based (up)?on the)\b')
    AND NOT ((arc > 0.98 OR arc < 0.02) AND length(regexp_replace(text, '[^A-Z]', '', 'g')) > 0.5 * length(regexp_replace(text, '[^a-zA-Z]', '', 'g')))
    AND NOT regexp_matches(trim(text), '^["''”’“]') AND NOT regexp_matches(text_norm, '[0-9]') AND {CAPITALS.format(t='text')} <= 0.4 AND common >= 0.4
    THEN d ELSE -1 END AS "distinct" FROM lines l LEFT JOIN sums USING (movie_id, seq))"""]


@query(sql(DISTINCT, 'SELECT movie_id, seq, round("distinct", 6) AS "distinct" FROM judged'))
def distinctiveness(c: Corpus) -> DataFrame:
    return corpus.distinctiveness(c.lines, _idf(c)).select("movie_id", "seq", r("distinct").alias("distinct"))


@query(sql(DISTINCT, """SELECT movie_id, q, seq FROM (SELECT movie_id, least(floor(arc * 5), 4)::INT AS q, seq,
  row_number() OVER (PARTITION BY movie_id, least(floor(arc * 5), 4) ORDER BY round("distinct", 9) DESC, seq) AS n FROM judged WHERE "distinct" >= 0) WHERE n = 1"""))
def quintile_best(c: Corpus) -> DataFrame:
    d = corpus.distinctiveness(c.lines, _idf(c)).where("distinct >= 0").withColumn("q", F.least(F.floor(F.col("arc") * 5), F.lit(4)).cast("int"))
    n = F.row_number().over(W.partitionBy("movie_id", "q").orderBy(F.desc(F.round("distinct", 9)), "seq"))
    return d.withColumn("n", n).where("n = 1").select("movie_id", "q", "seq")


PICKS = [*DISTINCT, WINDOWS, """middle AS (SELECT movie_id, list(s ORDER BY d) AS mid FROM (SELECT movie_id, d, sum(x) AS s FROM (SELECT movie_id, unnest(vec) AS x, unnest(range(64)) AS d FROM windows) GROUP BY 1, 2) GROUP BY 1)""",
  r"""words AS (SELECT j.movie_id, j.seq, least(floor(arc * 5), 4)::INT AS q, "distinct", round(list_dot_product(vec, mid) / sqrt(list_dot_product(mid, mid)), 9) AS central, regexp_split_to_array(text, '\s+') AS w
    FROM judged j JOIN (SELECT movie_id, start_seq AS seq, vec FROM windows) USING (movie_id, seq) JOIN middle USING (movie_id) WHERE "distinct" >= 0)""",
  """ranks AS (SELECT movie_id, seq, q, count(*) OVER (PARTITION BY movie_id, q) AS n,
      0.6::DOUBLE * (row_number() OVER (PARTITION BY movie_id, q ORDER BY central DESC, seq) - 1) + 0.4::DOUBLE * (row_number() OVER (PARTITION BY movie_id, q ORDER BY round("distinct", 9) DESC, seq) - 1) AS blend,
      list_distinct(list_filter(list_transform(range(1, len(w) + 1), lambda k: CASE WHEN k > 1 OR regexp_full_match(w[k], '[A-Z][a-z]{2,},') THEN lower(regexp_extract(w[k], '^[A-Z][a-z]{2,}')) ELSE '' END), lambda x: x <> '')) AS names
    FROM words)""",
  """fifths AS (SELECT movie_id, dense_rank() OVER (PARTITION BY movie_id ORDER BY q) AS k, list(struct_pack(seq := seq, n := n, blend := blend, names := names) ORDER BY seq) AS c FROM ranks GROUP BY movie_id, q)""",
  """walk2 AS (SELECT DISTINCT movie_id, 0::BIGINT AS k, []::BIGINT[] AS seqs, []::VARCHAR[] AS taken FROM fifths
    UNION ALL SELECT movie_id, k, list_append(seqs, best.seq), list_concat(taken, best.names) FROM (
      SELECT w.movie_id, f.k, w.seqs, w.taken, list_sort(list_transform(f.c, lambda x: struct_pack(cost := x.blend + CASE WHEN len(list_intersect(x.names, w.taken)) > 0 THEN 0.5::DOUBLE * x.n ELSE 0 END, seq := x.seq, names := x.names)))[1] AS best
      FROM walk2 w JOIN fifths f ON f.movie_id = w.movie_id AND f.k = w.k + 1))"""]


@query(_recursive(PICKS, "SELECT movie_id, array_to_string(arg_max(seqs, k), ',') AS seqs FROM walk2 GROUP BY 1 HAVING max(k) > 0"))
def quintile_picks(c: Corpus) -> DataFrame:
    """Five lines of each film that has vectors; a window's vector stands for its first line's."""
    keys = c.windows.select("movie_id", F.col("start_seq").alias("seq"))
    d = corpus.distinctiveness(c.lines.join(keys, ["movie_id", "seq"], "left_semi"), _idf(c)).where("distinct >= 0")
    own = c.windows.select("movie_id", F.col("start_seq").alias("seq"), "vec").join(corpus.film_vectors(c.windows).withColumnRenamed("vec", "mid"), "movie_id")
    central = F.round(V.dot(F.col("vec"), F.col("mid")), 9)
    rows = d.join(own, ["movie_id", "seq"]).select("movie_id", "seq", "arc", central.alias("central"), F.round("distinct", 9).alias("distinct"), corpus.names_in(F.col("text")).alias("names"))
    return corpus.quintile_picks(rows).select("movie_id", F.array_join(F.transform("seqs", lambda x: x.cast("string")), ",").alias("seqs"))


@query()
def film_map(c: Corpus) -> DataFrame:
    return corpus.film_map(corpus.film_vectors(c.windows)).select("movie_id", r("x", 4).alias("x"), r("y", 4).alias("y"))


# --- bridge -----------------------------------------------------------------

CROSS = [*RAW, "g AS (SELECT w.movie_id, w.idx, vec, generic FROM windows w JOIN generic USING (movie_id, idx))",
  """crossed AS (SELECT a.movie_id AS a, b.movie_id AS b, a.idx AS ia, b.idx AS ib, list_dot_product(a.vec, b.vec) - 0.75 * (a.generic + b.generic) / 2 AS score
    FROM g a JOIN g b ON b.movie_id = a.movie_id + 1)"""]


def _bridge_sides(c: Corpus) -> tuple[DataFrame, DataFrame]:
    scored = c.windows.select("movie_id", "idx", "vec").join(_generic(c).select("movie_id", "idx", "generic"), ["movie_id", "idx"])
    left = scored.select(F.col("movie_id").alias("a"), (F.col("movie_id") + 1).alias("b"), "idx", "vec", "generic")
    right = scored.select((F.col("movie_id") - 1).alias("a"), F.col("movie_id").alias("b"), "idx", "vec", "generic")
    return left, right


@query(sql(CROSS, """SELECT a, b, count(*) AS n, round(max(score), 5) AS best, round(avg(score), 6) AS ambient FROM crossed GROUP BY 1, 2"""))
def bridge_cross(c: Corpus) -> DataFrame:
    return film.ambience(*_bridge_sides(c), ["a", "b"]).select("a", "b", "n", r("best", 5).alias("best"), r("ambient").alias("ambient"))


#: Windows of which some films share parallels, under the name that other tables read.
DRAWN = [WINDOWS.replace("windows AS", "plain AS", 1), PAIRED.replace("paired AS", "windows AS", 1).replace("FROM windows w LEFT JOIN windows o", "FROM plain w LEFT JOIN plain o")]
ALIKE = [*DRAWN, *CROSS[1:], """contrasted AS (SELECT *, score - (avg(score) OVER (PARTITION BY a, b, ia) + avg(score) OVER (PARTITION BY a, b, ib)) / 2 AS contrast FROM crossed)"""]


def _drawn(c: Corpus) -> DataFrame:
    """The paired windows with their genericness, which is worked out once and stored."""

    def made() -> DataFrame:
        return c.paired.join(corpus.genericness(c.paired).select("movie_id", "idx", "generic"), ["movie_id", "idx"])

    return stored(c.spark, f"drawn of {c.dir}", made)


def _film_pairs(c: Corpus) -> DataFrame:
    """Each film and the next one, where both have windows."""
    films = c.windows.select(F.col("movie_id").alias("a")).distinct()
    return films.join(films.select((F.col("a") - 1).alias("a")), "a", "left_semi").select("a", (F.col("a") + 1).alias("b"))


@query(sql(ALIKE, """SELECT a, b, ia, ib, round(score, 5) AS score FROM contrasted WHERE contrast >= 0.05 AND score >= 0.25"""))
def bridge_candidates(c: Corpus) -> DataFrame:
    return film.bridge_candidates(*film.both_sides(_drawn(c), _film_pairs(c)), ["a", "b"]).select("a", "b", "ia", "ib", r("score", 5).alias("score"))


BRIDGED = [*ALIKE, QUALITY, f"""spoken AS (SELECT w.movie_id, w.idx, w.arc, w.start_seq, {CLIPPED.format(t="array_to_string(string_split(d.text, chr(10))[1:3], ' ')")} AS excerpt FROM windows w JOIN documents d ON d.doc_id = w.movie_id)""",
  """cand AS (SELECT a, b, ia, ib, score FROM contrasted WHERE contrast >= 0.05 AND score >= 0.25
    AND a NOT IN (SELECT movie_id FROM quality WHERE non_english) AND b NOT IN (SELECT movie_id FROM quality WHERE non_english))""",
  """options AS (SELECT c.a, c.b, c.ia, c.ib, c.score, list(struct_pack(ba := f.ia, bb := f.ib) ORDER BY f.score DESC, f.ia, f.ib) AS o FROM cand c
    JOIN windows wa ON wa.movie_id = c.a AND wa.idx = c.ia JOIN windows wb ON wb.movie_id = c.b AND wb.idx = c.ib
    JOIN crossed f ON f.a = c.a AND f.b = c.b AND f.score >= 0.28 JOIN windows xa ON xa.movie_id = c.a AND xa.idx = f.ia AND xa.start_seq BETWEEN wa.start_seq AND wa.end_seq
    JOIN windows xb ON xb.movie_id = c.b AND xb.idx = f.ib AND xb.start_seq BETWEEN wb.start_seq AND wb.end_seq GROUP BY ALL)""",
  """ordered AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, ia, ib) AS k FROM options)""",
  """greedy AS (SELECT DISTINCT a, b, 0::BIGINT AS k, []::BIGINT[] AS ua, []::BIGINT[] AS ub, []::BIGINT[] AS va, []::BIGINT[] AS vb, []::DOUBLE[] AS scores FROM ordered
    UNION ALL SELECT a, b, k, CASE WHEN p IS NULL THEN ua ELSE list_append(ua, ia) END, CASE WHEN p IS NULL THEN ub ELSE list_append(ub, ib) END,
      CASE WHEN p IS NULL THEN va ELSE list_append(va, p.ba) END, CASE WHEN p IS NULL THEN vb ELSE list_append(vb, p.bb) END, CASE WHEN p IS NULL THEN scores ELSE list_append(scores, score) END
    FROM (SELECT g.a, g.b, o.k, o.ia, o.ib, o.score, ua, ub, va, vb, scores,
        CASE WHEN len(ua) < 5 AND NOT list_contains(ua, o.ia) AND NOT list_contains(ub, o.ib) THEN list_filter(o.o, lambda x: NOT list_contains(va, x.ba) AND NOT list_contains(vb, x.bb))[1] END AS p
      FROM greedy g JOIN ordered o ON o.a = g.a AND o.b = g.b AND o.k = g.k + 1))""",
  """chosen AS (SELECT a, b, arg_max(struct_pack(ua, ub, va, vb, scores), k) AS x FROM greedy GROUP BY 1, 2 HAVING len(arg_max(ua, k)) >= 2)""",
  """picked AS (SELECT a, b, n, x.ua[n] AS ia, x.ub[n] AS ib, x.va[n] AS beat_a, x.vb[n] AS beat_b, x.scores[n] AS score FROM (SELECT *, unnest(range(1, len(x.ua) + 1)) AS n FROM chosen))"""]


@query(_recursive(BRIDGED, """SELECT p.a, p.b, p.n::INT AS n, p.ia, p.ib, beat_a, beat_b, sa.start_seq AS start_a, sb.start_seq AS start_b, round(sa.arc, 6) AS arc_a, round(sb.arc, 6) AS arc_b,
  sa.excerpt AS excerpt_a, sb.excerpt AS excerpt_b, CASE WHEN p.ia % 2 = 0 THEN 'scene ' || p.ia END AS headline_a, CASE WHEN p.ib % 2 = 0 THEN 'scene ' || p.ib END AS headline_b, round(p.score, 4) AS score
  FROM picked p JOIN spoken sa ON sa.movie_id = p.a AND sa.idx = beat_a JOIN spoken sb ON sb.movie_id = p.b AND sb.idx = beat_b"""))
def bridge_pairs(c: Corpus) -> DataFrame:
    scored = _drawn(c)
    beats = scored.join(c.table("documents").select(F.col("doc_id").alias("movie_id"), "text"), "movie_id")
    told = c.windows.select("movie_id", "start_seq", "end_seq", F.when(F.col("idx") % 2 == 0, F.concat(F.lit("scene "), "idx")).otherwise("").alias("headline"))
    out = film.bridge(scored, beats, _film_pairs(c), c.quality, told)
    return out.withColumn("score", r("score", 4)).withColumn("arc_a", r("arc_a")).withColumn("arc_b", r("arc_b"))


@query(sql([WINDOWS], """SELECT movie_id, start_seq, end_seq, CASE WHEN idx % 2 = 0 THEN 'b' || idx END AS headline FROM windows"""))
def window_headlines(c: Corpus) -> DataFrame:
    """Spans with their headline: the summary table holds some twice, some empty and some of other spans."""
    told = c.windows.select("movie_id", "start_seq", "end_seq", F.when(F.col("idx") % 2 == 0, F.concat(F.lit("b"), "idx")).otherwise("").alias("headline"))
    other = told.withColumn("end_seq", F.col("end_seq") + 1).withColumn("headline", F.lit("a"))
    return film.headlines(c.windows.select("movie_id", "start_seq", "end_seq"), told.unionByName(told).unionByName(other))


OLDER = [*ALIKE, """strong AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(score, 9) DESC, ia, ib) AS k FROM contrasted WHERE contrast >= 0.16)""",
  """taken AS (SELECT DISTINCT a, b, 0::BIGINT AS k, []::BIGINT[] AS ua, []::BIGINT[] AS ub FROM strong
    UNION ALL SELECT t.a, t.b, s.k, CASE WHEN free THEN list_append(ua, s.ia) ELSE ua END, CASE WHEN free THEN list_append(ub, s.ib) ELSE ub END
    FROM (SELECT t.*, len(ua) < 5 AND NOT list_contains(ua, s.ia) AND NOT list_contains(ub, s.ib) AS free, s.k AS sk FROM taken t JOIN strong s ON s.a = t.a AND s.b = t.b AND s.k = t.k + 1) t
      JOIN strong s ON s.a = t.a AND s.b = t.b AND s.k = t.sk)""",
  """last AS (SELECT a, b, arg_max(ua, k) AS ua, arg_max(ub, k) AS ub FROM taken GROUP BY 1, 2 HAVING len(arg_max(ua, k)) >= 2)""",
  """ones AS (SELECT a, b, ua[n] AS ia, ub[n] AS ib FROM (SELECT *, unnest(range(1, len(ua) + 1)) AS n FROM last))"""]


@query(_recursive(OLDER, "SELECT a, b, ia, ib, round(contrast, 3) AS contrast FROM ones JOIN strong USING (a, b, ia, ib)"))
def beat_bridge(c: Corpus) -> DataFrame:
    return film.older_bridge(_drawn(c), _film_pairs(c)).select("a", "b", "ia", "ib", r("contrast", 3).alias("contrast"))


@query(_recursive([*OLDER, *BRIDGED[len(ALIKE):]], """SELECT a, b, 'beats' AS way, count(*) AS n FROM ones GROUP BY 1, 2 UNION ALL SELECT a, b, 'consensus', count(*) FROM picked GROUP BY 1, 2"""))
def bridge_compare(c: Corpus) -> DataFrame:
    """Both bridges side by side: how many pairs of moments each finds."""
    scored = _drawn(c)
    return film.compared_bridges(scored, scored, _film_pairs(c), c.quality).groupBy("a", "b", "way").agg(F.count("*").alias("n"))


# --- cues -------------------------------------------------------------------


@query(sql([CUES], """SELECT movie_id, idx, layer, text FROM (SELECT *, max(level) OVER (PARTITION BY movie_id) AS top FROM (
  SELECT *, 'base' AS layer, 0 AS level FROM cues UNION ALL SELECT movie_id, idx, '+' || text, 'upgrade', 1 FROM cues WHERE movie_id % 3 = 0)) WHERE level = top"""))
def layer_override(c: Corpus) -> DataFrame:
    better = c.cues.where("movie_id % 3 = 0").withColumn("text", F.concat(F.lit("+"), "text"))
    return cues.layered([("base", c.cues), ("upgrade", better)]).select("movie_id", "idx", "layer", "text")


@query()
def utterances(c: Corpus) -> DataFrame:
    lines = c.cues.select("movie_id", "idx", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("movie_id", (F.col("idx") * 1000 + F.col("p")).alias("idx"), F.col("line").alias("text"))
    return cues.utterances(lines).select("movie_id", "seq", r("arc").alias("arc"), "text", "lyrics", "empty", "short", "credits")


SUNG = """CASE WHEN seq % 17 = 3 THEN '♪ ' || text WHEN seq % 11 IN (5, 6) THEN '"' || translate(text, '"“”', '') || '"' WHEN seq % 13 = 7 THEN '"' || translate(text, '"“”', '') || '"' ELSE text END"""


@query(sql([LINES, f"sung AS (SELECT movie_id, seq, {SUNG} AS t FROM lines)",
  r"""quoted AS (SELECT *, regexp_matches(trim(t), '^["“][^"”]+["”]$') AS q, regexp_matches(trim(t), '[.?!…]["''”’]?\s*$') AS p FROM sung)""",
  """marks AS (SELECT *, regexp_matches(t, '[♪#]') OR (q AND (coalesce(lag(q) OVER w, false) OR coalesce(lead(q) OVER w, false))) AS a FROM quoted WINDOW w AS (PARTITION BY movie_id ORDER BY seq))""",
  """near AS (SELECT *, max(CASE WHEN a THEN seq END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
    min(CASE WHEN a THEN seq END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f,
    max(CASE WHEN p THEN seq END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb,
    min(CASE WHEN p THEN seq END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS pf FROM marks WINDOW w AS (PARTITION BY movie_id ORDER BY seq))"""],
  """SELECT movie_id, seq AS idx, a OR coalesce(f - b <= 3, false) OR coalesce(b IS NOT NULL AND NOT p AND coalesce(pb, -1) <= b, false)
    OR coalesce(f IS NOT NULL AND NOT p AND coalesce(pf, 1 << 30) >= f, false) AS lyric FROM near"""))
def lyric_islands(c: Corpus) -> DataFrame:
    """Notes, number signs and quoted neighbours are anchors; some lines get notes or quotes, which the tables lack."""
    seq, bare = F.col("seq"), F.translate("text", '"“”', "")
    wrapped = F.concat(F.lit('"'), bare, F.lit('"'))
    sung = F.when(seq % 17 == 3, F.concat(F.lit("♪ "), "text")).when((seq % 11).isin(5, 6), wrapped).when(seq % 13 == 7, wrapped).otherwise(F.col("text"))
    return cues.lyric_islands(c.spoken.select("movie_id", seq.alias("idx"), sung.alias("text"))).select("movie_id", "idx", "lyric")


SCORED = [LINES, """words AS (SELECT movie_id, seq, list_filter(regexp_split_to_array(lower(text), '[^a-z'']+'), lambda w: w <> '') AS w FROM lines)""",
  """dict AS (SELECT word FROM (SELECT unnest(list_distinct(w)) AS word FROM words) GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 1000)""",
  """rate AS (SELECT movie_id, count(*) AS tokens, count(d.word) AS hits FROM (SELECT movie_id, unnest(w) AS word FROM words) LEFT JOIN dict d USING (word) GROUP BY 1)""",
  r"""parts AS (SELECT movie_id, count(*) AS cues, avg(regexp_matches(text, '[.?!…]["''”’]?\s*$')::INT) AS p, avg(length(text)) AS mean,
    sum(len(regexp_extract_all(text, '[a-z]I[a-z]')) + len(regexp_extract_all(text, '\bl\b')) + len(regexp_extract_all(text, '[a-z]"[a-z]')) + len(regexp_extract_all(text, '\bl''(?:m|ll|ve|d|re|s)\b'))) AS ocr
    FROM lines GROUP BY 1)""",
  """both_ AS (SELECT *, CASE WHEN coalesce(tokens, 0) > 0 THEN hits::DOUBLE / tokens ELSE 0 END AS d, ocr::DOUBLE / cues * 1000 AS per FROM parts LEFT JOIN rate USING (movie_id))""",
  """scored AS (SELECT movie_id, floor(100 * (0.3 * least(p / 0.6, 1) + 0.3 * least(d / 0.55, 1) + 0.3 * greatest(0, 1 - per / 200) + 0.1 * CASE WHEN mean BETWEEN 12 AND 80 THEN 1 ELSE 0.5 END) * 10 + 0.5) / 10 AS score,
    floor(p * 1000 + 0.5) / 1000 AS punctuation_density, floor(d * 1000 + 0.5) / 1000 AS dictionary_rate, floor(per * 10 + 0.5) / 10 AS ocr_per_thousand, floor(mean * 10 + 0.5) / 10 AS mean_cue_length, cues, coalesce(tokens, 0) > 200 AND d < 0.2 AS non_english FROM both_)"""]


def _scored(c: Corpus) -> DataFrame:
    return quality.score_films(c.spoken, quality.common_words(c.spoken))


@query(sql(SCORED, "SELECT movie_id, score, punctuation_density, dictionary_rate, ocr_per_thousand, mean_cue_length, cues, non_english FROM scored"))
def quality_score(c: Corpus) -> DataFrame:
    return _scored(c)


@query(sql(SCORED, "SELECT movie_id, dictionary_rate, cues, non_english FROM scored"))
def dictionary_rate(c: Corpus) -> DataFrame:
    return _scored(c).select("movie_id", "dictionary_rate", "cues", "non_english")


@query(sql([MOVIES], """SELECT id AS movie_id, votes % 97 AS score, row_number() OVER (ORDER BY votes % 97, id) <= (SELECT count(*) // 10 FROM movies) AS downrank FROM movies"""))
def decile_downrank(c: Corpus) -> DataFrame:
    return quality.worst_decile(c.movies.select(F.col("id").alias("movie_id"), (F.col("votes") % 97).alias("score")))


@query(sql([LINES], """SELECT movie_id, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY length(text)) - 1 AS k, count(*) OVER (PARTITION BY movie_id) AS m FROM lines)
  WHERE k = floor((m - 1) * 0.9)"""))
def length_percentiles(c: Corpus) -> DataFrame:
    return quality.nearest_rank(c.spoken.select("movie_id", F.length("text").cast("long").alias("n")), ["movie_id"], "n", 0.9)


@query(sql([LINES], """SELECT count(DISTINCT movie_id) AS films, count(*) AS utterances, count(*) FILTER (WHERE length(text) < 20) AS under_20, count(*) FILTER (WHERE length(text) BETWEEN 20 AND 59) AS under_60,
  count(*) FILTER (WHERE length(text) BETWEEN 60 AND 119) AS under_120, count(*) FILTER (WHERE length(text) BETWEEN 120 AND 199) AS under_200, count(*) FILTER (WHERE length(text) >= 200) AS longer,
  floor(count(*)::DOUBLE / count(DISTINCT movie_id) + 0.5)::BIGINT AS mean_per_film FROM lines"""))
def length_report(c: Corpus) -> DataFrame:
    return quality.length_report(c.spoken)


# --- generation store -------------------------------------------------------


@query("""SELECT user_id AS key, event_id AS n, event_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""".replace("event_id AS n,", "event_id AS at,"))
def last_wins_store(c: Corpus) -> DataFrame:
    from ..sources.tables import last_wins

    rows = c.table("events").select(F.col("user_id").alias("movieId"), F.col("event_id").alias("at"), F.col("event_type").alias("value"))
    return last_wins(rows, "at").select(F.col("movieId").alias("key"), "at", "value")


HASHES = """hashed AS (SELECT doc_id AS key, left(sha256(text || chr(10)), 16) AS h FROM documents)"""
@query(sql([HASHES], """SELECT n.key, n.h AS input_hash FROM hashed n LEFT JOIN (SELECT key, CASE WHEN key % 4 = 0 THEN 'old' ELSE h END AS h, CASE WHEN key % 5 = 0 THEN 1 ELSE 2 END AS v FROM hashed WHERE key % 7 <> 0) o USING (key)
  WHERE o.key IS NULL OR o.h <> n.h OR o.v <> 2"""))
def needs_run(c: Corpus) -> DataFrame:
    wanted = c.table("documents").select(F.col("doc_id").alias("key"), T.input_hash(F.array("text")).alias("input_hash"), F.lit(2).alias("prompt_version"))
    k = F.col("key")
    stored = wanted.where(k % 7 != 0).select("key", F.when(k % 4 == 0, "old").otherwise(F.col("input_hash")).alias("input_hash"), F.when(k % 5 == 0, 1).otherwise(2).alias("prompt_version"))
    return genstore.needs_run(wanted, stored).select("key", "input_hash")


@query("""SELECT n.row, o.vec_id, o.vec_id IS NULL AS fresh FROM (SELECT doc_id AS row, text FROM documents) n LEFT JOIN (
  SELECT text, arg_min(doc_id, doc_id) AS vec_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) o USING (text)""")
def reconcile_vectors(c: Corpus) -> DataFrame:
    docs = c.table("documents")
    old = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("row"), "text", F.col("doc_id").alias("vec"))
    return genstore.reconcile(docs.select(F.col("doc_id").alias("row"), "text"), old).select("row", F.col("vec").alias("vec_id"), "fresh")


QUOTED = """list_filter(string_split({t}, ' '), lambda x: x <> '')"""
KEYED = """trim(regexp_replace(regexp_replace(translate(lower({t}), '‘’', ''''''), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g'))"""
TFIDF = [LINES, f"""stored AS (SELECT movie_id, seq, {KEYED.format(t='text')} AS key, {QUOTED.format(t='text_norm')} AS tokens FROM lines WHERE movie_id % 50 = 0)""",
  f"""said AS (SELECT movie_id, seq AS quote_id, CASE WHEN seq % 4 = 0 THEN seq END AS hint, CASE WHEN seq % 4 IN (0, 1) THEN text WHEN seq % 4 = 2 THEN regexp_replace(text, '^\\S*\\s', '') ELSE 'zzyx' END AS text FROM lines WHERE movie_id % 50 = 0)""",
  f"""quotes AS (SELECT movie_id, quote_id, hint, {KEYED.format(t='text')} AS key, {QUOTED.format(t=normal_sql('text'))} AS tokens FROM said)""",
  """nn AS (SELECT movie_id, count(*) AS n, min(seq) AS first_seq FROM stored GROUP BY 1)""",
  """lw AS (SELECT movie_id, seq, token, count(*)::DOUBLE AS tf FROM (SELECT movie_id, seq, unnest(tokens) AS token FROM stored) GROUP BY ALL)""",
  """qw AS (SELECT movie_id, quote_id, token, count(*)::DOUBLE AS tf FROM (SELECT movie_id, quote_id, unnest(tokens) AS token FROM quotes) GROUP BY ALL)""",
  """idf AS (SELECT movie_id, token, ln((n + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM lw JOIN nn USING (movie_id) GROUP BY movie_id, token, n)""",
  """wl AS (SELECT lw.*, tf * idf AS w FROM lw JOIN idf USING (movie_id, token))""", """wq AS (SELECT qw.*, tf * coalesce(idf, ln(n + 1.0::DOUBLE) + 1) AS w FROM qw JOIN nn USING (movie_id) LEFT JOIN idf USING (movie_id, token))""",
  """sl AS (SELECT movie_id, seq, sqrt(sum(w * w)) AS s FROM wl GROUP BY 1, 2)""", """sq AS (SELECT movie_id, quote_id, sqrt(sum(w * w)) AS s FROM wq GROUP BY 1, 2)""",
  """sc AS (SELECT movie_id, quote_id, seq, round(d / (sl.s * sq.s), 12) AS score FROM (SELECT wq.movie_id, quote_id, seq, sum(wq.w * wl.w) AS d FROM wq JOIN wl USING (movie_id, token) GROUP BY ALL) JOIN sl USING (movie_id, seq) JOIN sq USING (movie_id, quote_id))""",
  """ex AS (SELECT q.movie_id, quote_id, coalesce(min(seq) FILTER (WHERE seq = hint), min(seq)) AS seq FROM quotes q JOIN stored l ON l.movie_id = q.movie_id AND l.key = q.key GROUP BY ALL)""",
  """bs AS (SELECT movie_id, quote_id, max(score) AS score, arg_min(seq, (-score, seq)) AS seq FROM sc GROUP BY ALL)"""]


@query(sql(TFIDF, """SELECT q.movie_id, q.quote_id, coalesce(ex.seq, bs.seq, CASE WHEN len(tokens) > 0 THEN first_seq END) AS seq, ex.seq IS NOT NULL AS verbatim,
  round(CASE WHEN ex.seq IS NOT NULL THEN 1 WHEN len(tokens) > 0 THEN coalesce(bs.score, 0) END, 6) AS score
  FROM quotes q JOIN nn USING (movie_id) LEFT JOIN ex USING (movie_id, quote_id) LEFT JOIN bs USING (movie_id, quote_id)"""))
def tfidf_match(c: Corpus) -> DataFrame:
    """Quotes of the films whose id is divisible by 50 against all their lines: whole lines with and without a hint, lines without their first word, and one unknown word."""
    k = F.col("seq") % 4
    text = F.when(k.isin(0, 1), F.col("text")).when(k == 2, F.regexp_replace("text", r"^\S*\s", "")).otherwise("zzyx")
    quotes = c.spoken.where("movie_id % 50 = 0").select("movie_id", F.col("seq").alias("quote_id"), F.when(k == 0, F.col("seq")).alias("hint"), text.alias("text"))
    return genstore.match_quotes(quotes, c.spoken).select("movie_id", "quote_id", "seq", "verbatim", r("score").alias("score"))


@query(sql([LINES, f"""shaped AS (SELECT movie_id, seq, floor(arc * 12)::INT AS bin FROM lines WHERE length(text) BETWEEN 15 AND 160 AND len({QUOTED.format(t='text_norm')}) >= 4
    AND NOT regexp_matches(text, '[0-9]') AND {CAPITALS.format(t='text')} <= 0.4)"""],
  """SELECT movie_id, seq FROM (SELECT *, row_number() OVER w - 1 AS k, greatest(1, floor(count(*) OVER (PARTITION BY movie_id, bin) / 10)) AS step FROM shaped WHERE bin < 12
  WINDOW w AS (PARTITION BY movie_id, bin ORDER BY seq)) WHERE k % step = 0 AND k / step < 10"""))
def stratified_sample(c: Corpus) -> DataFrame:
    return genstore.sampled_lines(c.lines).select("movie_id", "seq")


# --- logs -------------------------------------------------------------------


@query(sql([LOG], "SELECT query_norm, count(*) AS misses FROM log WHERE hits = 0 GROUP BY 1"))
def zero_result_queries(c: Corpus) -> DataFrame:
    return analytics.missed_queries(analytics.search_log(c.log))


@query(sql([LOG], "SELECT ts::DATE AS day, count(DISTINCT visitor) AS visitors FROM log GROUP BY 1"))
def daily_visitors(c: Corpus) -> DataFrame:
    return analytics.daily_visitors(c.log)


@query(sql([LOG], "SELECT query_norm, count(*) AS n, max(least(floor(took_ms + 0.5), 65535))::INT AS slowest FROM log WHERE ts >= (SELECT max(ts) FROM log) - INTERVAL 10 DAY GROUP BY 1"))
def ttl_retention(c: Corpus) -> DataFrame:
    now = c.log.agg(F.max("ts").alias("m")).first()["m"]
    kept = analytics.retained(analytics.search_log(c.log), F.lit(now), 10)
    return kept.groupBy("query_norm").agg(F.count("*").alias("n"), F.max("took_ms").alias("slowest"))


@query(sql([LOG], "SELECT query_norm, n, round(greatest(n::DOUBLE / max(n) OVER () * 100, 3), 6) AS height FROM (SELECT query_norm, count(*) AS n FROM log GROUP BY 1)"))
def bar_heights(c: Corpus) -> DataFrame:
    return analytics.bar_heights(c.log.groupBy("query_norm").agg(F.count("*").alias("n"))).withColumn("height", r("height"))


# --- titles, layers and reports -----------------------------------------------

KEY = """replace(regexp_replace(trim(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g')), '^(the|a|an) ', ''), ' ', '')"""


@query(sql([MOVIES], f"""SELECT w.id, min('s' || i.id) AS slug FROM movies w JOIN movies i ON {KEY.format(t="'The ' || w.title")} = {KEY.format(t='i.title')}
  AND (CASE WHEN i.id % 3 = 0 THEN NULL ELSE i.year + i.id % 4 END IS NULL OR abs(i.year + i.id % 4 - w.year) <= 1) GROUP BY w.id"""))
def title_year_join(c: Corpus) -> DataFrame:
    wanted = c.movies.select("id", F.concat(F.lit("The "), "title").alias("title"), "year")
    index = c.movies.select(F.concat(F.lit("s"), "id").alias("slug"), "title", F.when(F.col("id") % 3 != 0, F.col("year") + F.col("id") % 4).cast("int").alias("year"))
    return titles.year_tolerant(wanted, index)


TITLED = [MOVIES, f"""own AS (SELECT id, id % 7 AS k, {KEY.format(t="title || ' long name'")} AS key FROM movies)""",
  """ix AS (SELECT 's' || id AS slug, CASE k WHEN 0 THEN key WHEN 1 THEN 'old' || key WHEN 2 THEN 'starwars' || key WHEN 3 THEN 'starwarsthe' || key WHEN 4 THEN key || 'andmore' WHEN 5 THEN 'moreof' || key ELSE left(key, 12) END AS other FROM own)""",
  """tried AS (SELECT id, key AS other, 0 AS way FROM own UNION ALL SELECT id, 'old' || key, 1 FROM own WHERE k = 1 UNION ALL SELECT id, 'starwars' || key, 2 FROM own UNION ALL SELECT id, 'starwarsthe' || key, 3 FROM own)""",
  """ways AS (SELECT id, way, slug FROM tried JOIN ix USING (other) UNION ALL SELECT id, 4, slug FROM own JOIN ix ON length(key) >= 10 AND (starts_with(other, key) OR ends_with(other, key)))"""]


@query(sql(TITLED, "SELECT id, min(way)::INT AS way, arg_min(slug, (way, slug)) AS slug FROM ways GROUP BY id"))
def title_resolve(c: Corpus) -> DataFrame:
    """Each way of finding a title: the same, by an alias, behind a franchise's name, at the beginning or end of a longer one; some are not found."""
    named, k = F.concat("title", F.lit(" long name")), F.col("id") % 7
    listed = (
        F.when(k == 0, named).when(k == 1, F.concat(F.lit("Old "), named)).when(k == 2, F.concat(F.lit("Star Wars: "), named)).when(k == 3, F.concat(F.lit("Star Wars the "), named))
        .when(k == 4, F.concat(named, F.lit(" & More"))).when(k == 5, F.concat(F.lit("More of "), named)).otherwise(F.left(T.title_key(named), F.lit(12)))
    )
    aliases = c.movies.where(k == 1).select(named.alias("alias"), F.concat(F.lit("Old "), named).alias("title"))
    index = c.movies.select(F.concat(F.lit("s"), "id").alias("slug"), listed.alias("title"))
    return titles.resolve(c.movies.select("id", named.alias("title")), index, aliases)


@query(sql([MOVIES], """SELECT coalesce(a.id, b.id) AS movie_id, array_to_string(coalesce(CASE WHEN b.id % 4 <> 0 THEN [b.id * 2] END, a.seqs), ',') AS seqs
  FROM (SELECT id, [id, id + 1] AS seqs FROM movies WHERE id % 3 <> 0) a FULL JOIN (SELECT id FROM movies WHERE id % 2 = 0 AND id % 4 <> 0) b ON a.id = b.id"""))
def map_override(c: Corpus) -> DataFrame:
    i = F.col("id")
    base = c.movies.where(i % 3 != 0).select(i.alias("movie_id"), F.array(i, i + 1).alias("seqs"))
    curated = c.movies.where(i % 2 == 0).select(i.alias("movie_id"), F.when(i % 4 != 0, F.array(i * 2)).otherwise(F.array().cast("array<bigint>")).alias("seqs"))
    return titles.overridden(base, curated, "movie_id", "seqs").select("movie_id", F.array_join(F.col("seqs").cast("array<string>"), ",").alias("seqs"))


@query(sql([MOVIES], "SELECT id, votes FROM movies WHERE id NOT IN (SELECT doc_id FROM labels) ORDER BY votes DESC, id LIMIT 100"))
def missing_films(c: Corpus) -> DataFrame:
    return titles.missing(c.movies, c.table("labels").select(F.col("doc_id").alias("movie_id")), 100).select("id", "votes")


@query(sql([MOVIES], "SELECT DISTINCT l.doc_id AS movie_id FROM (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0) l JOIN movies m ON m.id = l.doc_id"))
def layer_targets(c: Corpus) -> DataFrame:
    labels = c.table("labels").withColumnRenamed("doc_id", "movie_id")
    return titles.targets([labels.where("toxic = 1"), labels.where("quality = 0")], c.movies)


@query(sql([MOVIES], """SELECT id AS movie_id, CASE WHEN doc_id IS NULL THEN 'pending' ELSE 'done' END AS status, CASE WHEN doc_id IS NULL THEN 0 ELSE 1 END AS attempts FROM movies LEFT JOIN labels ON doc_id = id"""))
def queue_merge(c: Corpus) -> DataFrame:
    saved = c.table("labels").select(F.col("doc_id").alias("movie_id"), F.lit("t").alias("title"), F.lit("done").alias("status"), F.lit(1).alias("attempts"))
    merged = genstore.queue_merge(saved, c.movies.select(F.col("id").alias("movie_id"), "title"))
    return merged.select("movie_id", "status", "attempts")


@query("""SELECT doc_id AS movie_id, 'toxic;low' AS feedback FROM labels WHERE toxic = 1 AND quality = 0 UNION ALL SELECT doc_id, 'low' FROM labels WHERE toxic = 0 AND quality = 0""")
def repair_set(c: Corpus) -> DataFrame:
    issue = lambda name: F.struct(F.lit("label").alias("kind"), F.lit(name).alias("detail"))
    labels = c.table("labels")
    stored = labels.select(
        F.col("doc_id").alias("movie_id"), (F.col("quality") == 1).alias("valid"), F.lit(False).alias("refused"),
        F.when(F.col("toxic") == 1, F.array(issue("toxic"), issue("low"))).otherwise(F.array(issue("low"))).alias("issues"),
    )
    return genstore.repair_set(stored).select("movie_id", F.array_join("feedback", ";").alias("feedback"))


@query(sql([WINDOWS, LINES], """SELECT movie_id, start_seq, end_seq, left(sha256(string_agg(text, chr(10) ORDER BY seq) || chr(10)), 16) AS input_hash, count(*)::INT AS n
  FROM windows JOIN lines USING (movie_id) WHERE seq BETWEEN start_seq AND end_seq GROUP BY ALL"""))
def window_inputs(c: Corpus) -> DataFrame:
    made = genstore.window_inputs(c.spoken, c.windows.select("movie_id", "start_seq", "end_seq"))
    return made.select("movie_id", "start_seq", "end_seq", "input_hash", F.size("texts").alias("n"))


@query(sql([WINDOWS, LINES], """SELECT movie_id, start_seq, end_seq, string_agg(text, chr(10) ORDER BY seq) AS shown, end_seq - start_seq + 1 AS total_lines
  FROM windows JOIN lines USING (movie_id) WHERE seq BETWEEN start_seq AND least(end_seq, start_seq + 24) GROUP BY ALL"""))
def source_lines(c: Corpus) -> DataFrame:
    return film.source_lines(c.spoken, c.windows).select("movie_id", "start_seq", "end_seq", F.array_join("lines", "\n").alias("shown"), "total_lines")


@query(sql([LINES], r"""SELECT movie_id, sum(len(regexp_extract_all(text, '[a-z]I[a-z]')) + len(regexp_extract_all(text, '\bl\b')) + len(regexp_extract_all(text, '[a-z]"[a-z]')) + len(regexp_extract_all(text, '\bl''(?:m|ll|ve|d|re|s)\b')))::BIGINT AS marks,
  count(*) FILTER (WHERE regexp_matches(text, '[.?!…]["\'\'”’]?\s*$')) AS terminal FROM lines GROUP BY 1""".replace("\\'", "'")))
def damage_counters(c: Corpus) -> DataFrame:
    return c.spoken.groupBy("movie_id").agg(F.sum(T.ocr_hits(F.col("text"))).alias("marks"), F.count_if(T.has_terminal(F.col("text"))).alias("terminal"))


@query(sql([MOVIES, LINES, f"asked AS (SELECT item_id, {normal_sql('text')} AS q FROM benchmark)"],
  """SELECT item_id, coalesce(min(movie_id), -1) AS first_film, count(movie_id) AS n FROM asked LEFT JOIN lines ON contains(text_norm, q) AND q <> '' GROUP BY 1"""))
def benchmark_lookup(c: Corpus) -> DataFrame:
    """The stated query set in one pass over the lines: a bounded set of phrases against all rows, in blocks of lines."""
    asked = c.table("benchmark").select("item_id", T.normalize(F.col("text")).alias("q"))
    if asked.count() > 10_000:  # checked; the set is broadcast
        raise ValueError("state at most 10,000 queries at once")
    hits = retrieval.lines_saying(c.lines.select("movie_id", "text_norm"), asked).groupBy("item_id").agg(F.min("movie_id").alias("f"), F.count("*").alias("k"))
    return asked.join(hits, "item_id", "left").select("item_id", F.coalesce("f", F.lit(-1)).alias("first_film"), F.coalesce("k", F.lit(0)).alias("n"))


@query(sql([LOG], "SELECT date_trunc('day', ts) AS day, query_norm, count(*) AS n, count(DISTINCT visitor) AS visitors FROM log GROUP BY 1, 2"))
def daily_log(c: Corpus) -> DataFrame:
    log = analytics.search_log(c.log)
    return log.groupBy(F.date_trunc("day", "ts").alias("day"), "query_norm").agg(F.count("*").alias("n"), F.count_distinct("visitor").alias("visitors"))

