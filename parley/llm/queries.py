"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, html_text, licenses, line_dedup, mixing, packing, quality, simhash, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.captures(_table(spark, sf_dir, "pages")))
    listed = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return found.select("record_id", "uri", "refers_to", "verdict", F.when(F.col("headers").isNotNull(), F.array_join(listed, ";")).alias("headers"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (
        op1_simhash, op2_line_dedup, op3_embedding_dedup, op4_warc_revisits, op5_quality_rules, op6_toxicity, op7_html_text, op8_mixing,
        op9_license_scan, op10_packing, pipeline,
    )
    return {f.__name__: f for f in found}


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, pos, line, s.key IS NOT NULL AND k.doc_id <> s.holder AS dropped FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

WARC_SQL = r"""
WITH pages2 AS (
  SELECT page_id, url, html, '"' || md5(coalesce(html, '')) || '"' AS tag,
    regexp_extract(trim(url), '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)', 1) AS head,
    regexp_replace(substr(trim(url), length(regexp_extract(trim(url), '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)', 1)) + 1), '#.*$', '') AS rest
  FROM pages),
parts AS (
  SELECT *, lower(regexp_extract(head, '^(.*?)://', 1)) AS scheme, regexp_extract(head, '://(.*@)', 1) AS who,
    lower(regexp_replace(head, '^.*?://(.*@)?', '')) AS host0 FROM pages2),
hosts AS (
  SELECT *, CASE scheme WHEN 'https' THEN regexp_replace(host0, ':443$', '') WHEN 'http' THEN regexp_replace(host0, ':80$', '') ELSE host0 END AS host
  FROM parts),
named AS (
  SELECT *, CASE WHEN head = '' THEN '' WHEN scheme NOT IN ('http', 'https') THEN scheme || '://' || who || host
      WHEN who = '' THEN 'http://' || regexp_replace(host, '^www[.](.*[.].*)$', '\1') ELSE 'http://' || who || host END
    || regexp_replace(regexp_replace(rest, '[?]$', ''), '/$', '') AS uri FROM hosts),
records AS (
  SELECT page_id * 2 AS record_id, uri, page_id * 10 AS ts, true AS full_one, tag AS etag, 'day ' || (page_id % 7) AS modified,
    page_id, length(html) AS n FROM named
  UNION ALL
  SELECT page_id * 2 + 1, uri, page_id * 10 + 25, false, CASE WHEN page_id % 3 = 0 THEN tag WHEN page_id % 3 = 1 THEN '"other"' END,
    CASE WHEN page_id % 2 = 0 THEN 'day ' || (page_id % 7) END, page_id, NULL FROM named),
asof_ AS (
  SELECT *, max(CASE WHEN full_one THEN struct_pack(ts := ts, id := record_id) END)
    OVER (PARTITION BY uri ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM records),
both_ AS (
  SELECT a.record_id, a.uri, near.id AS refers_to, a.etag, a.modified, f.etag AS f_etag, f.modified AS f_modified, a.ts, f.ts AS f_ts, f.n
  FROM asof_ a LEFT JOIN records f ON f.record_id = near.id WHERE NOT a.full_one),
judged AS (
  SELECT *, CASE WHEN refers_to IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL AND etag <> f_etag OR etag IS NULL AND modified IS NOT NULL AND modified <> f_modified THEN 'mismatch'
    WHEN etag IS NULL AND modified IS NULL THEN 'unverified' ELSE 'resolved' END AS verdict FROM both_)
SELECT record_id, uri, refers_to, verdict,
  CASE WHEN verdict = 'resolved' THEN 'content-length=' || n || ';date=' || ts || ';server=s' END AS headers
FROM judged
"""

QUALITY_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda k: [w[k], w[k + 1], w[k + 2]])) AS g,
    unnest(range(1, len(w) - 1)) AS p0 FROM words WHERE len(w) >= 3),
often AS (SELECT doc_id, p0, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([p0, p0 + 1, p0 + 2]) AS p FROM often WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words),
dups AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, w.source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM words w LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id)),
ruled AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
failed AS (
  SELECT source, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > word_chars AS f3, 10 * n_dup_lines > 3 * n_lines AS f4
  FROM ruled),
fails AS (
  SELECT source, r, count(*)::DOUBLE AS n, sum(f::INT)::DOUBLE AS k FROM (
    SELECT source, unnest([1, 2, 3, 4, 5]) AS r, unnest([f1, f2, f3, f4, f1 OR f2 OR f3 OR f4]) AS f FROM failed) GROUP BY source, r),
moments AS (SELECT r, avg(k / n) AS mean, var_samp(k / n) AS var, avg(1 / n) AS inverse FROM fails GROUP BY r),
spreads AS (SELECT *, coalesce(var, 0) - mean * (1 - mean) * inverse AS spread FROM moments),
priors AS (
  SELECT r, CASE WHEN mean <= 0 OR mean >= 1 THEN mean + 0.01 ELSE mean * weight END AS a,
    CASE WHEN mean <= 0 OR mean >= 1 THEN 1 - mean + 0.01 ELSE (1 - mean) * weight END AS b
  FROM (SELECT *, CASE WHEN spread > 0 THEN least(1e6, greatest(1, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS weight FROM spreads)),
limits AS (
  SELECT r, a, b, least(0.9, greatest(0.5, a / (a + b) + 2 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)))) AS most FROM priors),
shrunk AS (SELECT source, n + a + b AS weight, (k + a) / (n + a + b) AS rate, most FROM fails JOIN limits USING (r)),
hosts AS (SELECT source, bool_and(rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) <= most) AS host_ok FROM shrunk GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM ruled JOIN hosts ON ruled.source IS NOT DISTINCT FROM hosts.source
"""


MIXING_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[^w]', '', 'g'))::BIGINT AS size
  FROM documents),
per AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM per),
shared AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total,
    (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level,
    row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS fill
  FROM weighed WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, fill) AS level FROM shared WHERE level * w <= cap),
targets AS (
  SELECT s.source, n, source_size, total, coalesce(least(cap, final.level * w), cap) AS target, (2 * total + 128) // 256 AS blocks
  FROM shared s, final),
source_seats AS (
  SELECT source, target / (2 * k + 1) AS q, blocks FROM targets, LATERAL (SELECT unnest(range(0, blocks)) AS k) WHERE target > 0),
source_won AS (
  SELECT source, count(*) AS won FROM (SELECT *, row_number() OVER (ORDER BY q DESC, source NULLS LAST) AS r FROM source_seats) WHERE r <= blocks GROUP BY source),
dealt AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, coalesce(sw.won, 0) AS blocks,
    ('0x' || substr(md5('18:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size), 1, 15))::BIGINT % ceil(t.n / 4000.0)::BIGINT AS shard,
    ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size), 1, 15))::BIGINT AS turn
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN source_won sw ON d.source IS NOT DISTINCT FROM sw.source),
bundles AS (SELECT source, shard // 1000 AS bundle, sum(size)::BIGINT AS size, any_value(blocks) AS blocks FROM dealt GROUP BY ALL),
bundle_seats AS (SELECT *, size / (2 * k + 1) AS q FROM bundles, LATERAL (SELECT unnest(range(0, blocks)) AS k) WHERE size > 0),
bundle_won AS (
  SELECT source, bundle, count(*) AS won FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY q DESC, bundle) AS r FROM bundle_seats) WHERE r <= blocks GROUP BY source, bundle),
shards AS (SELECT source, shard, shard // 1000 AS bundle, sum(size)::BIGINT AS size FROM dealt GROUP BY ALL),
shard_seats AS (
  SELECT s.source, s.shard, s.bundle, b.won, s.size / (2 * k + 1) AS q
  FROM shards s JOIN bundle_won b ON s.source IS NOT DISTINCT FROM b.source AND s.bundle = b.bundle, LATERAL (SELECT unnest(range(0, b.won)) AS k) WHERE s.size > 0),
shard_won AS (
  SELECT source, shard, count(*) AS won FROM (
    SELECT *, row_number() OVER (PARTITION BY source, bundle ORDER BY q DESC, shard) AS r FROM shard_seats) WHERE r <= won GROUP BY source, shard),
quotas AS (
  SELECT s.source, s.shard, s.size, coalesce(won, 0) * 128 AS words,
    CASE WHEN s.size > 0 THEN least(3, coalesce(won, 0) * 128 // s.size) ELSE 0 END AS rounds
  FROM shards s LEFT JOIN shard_won w ON s.source IS NOT DISTINCT FROM w.source AND s.shard = w.shard),
ordered AS (
  SELECT d.*, q.rounds, CASE WHEN q.rounds < 3 THEN q.words - q.rounds * q.size ELSE 0 END AS missing,
    row_number() OVER (PARTITION BY d.source, d.shard ORDER BY turn, doc_id NULLS FIRST, d.size) AS pos
  FROM dealt d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source AND d.shard = q.shard),
walk AS (
  SELECT source, shard, 0::BIGINT AS pos, missing AS gap, false AS fits FROM ordered WHERE pos = 1
  UNION ALL
  SELECT o.source, o.shard, o.pos, w.gap - CASE WHEN o.size > 0 AND o.size <= w.gap THEN o.size ELSE 0 END, o.size > 0 AND o.size <= w.gap
  FROM walk w JOIN ordered o ON w.source IS NOT DISTINCT FROM o.source AND w.shard = o.shard AND o.pos = w.pos + 1),
left_over AS (SELECT source, shard, arg_max(gap, pos) AS gap FROM walk GROUP BY source, shard),
tried AS (
  SELECT o.*, w.fits, row_number() OVER (PARTITION BY o.source, o.shard ORDER BY
    CASE WHEN NOT w.fits AND o.size > 0 AND abs(l.gap - o.size) < l.gap THEN abs(l.gap - o.size) END NULLS LAST, o.pos) = 1
    AND NOT w.fits AND o.size > 0 AND abs(l.gap - o.size) < l.gap AS nearest
  FROM ordered o JOIN walk w ON o.source IS NOT DISTINCT FROM w.source AND o.shard = w.shard AND o.pos = w.pos
  JOIN left_over l ON o.source IS NOT DISTINCT FROM l.source AND o.shard = l.shard)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN rounds + (fits OR nearest)::BIGINT ELSE 0 END AS copies, source, copies * size AS taken
FROM tried
"""


EMBEDDINGS_SQL = """
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.v) = len(b.v)
    AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.95),
reached AS (SELECT r AS a, r AS b FROM good UNION SELECT x.a, l.b FROM reached x JOIN links l ON l.a = x.b),
found AS (
  SELECT g.vec_id, (SELECT count(*) FROM links l WHERE l.a = g.r) AS n_links, min(o.vec_id) AS component_id
  FROM good g JOIN reached x ON x.a = g.r JOIN good o ON o.r = x.b GROUP BY g.r, g.vec_id)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
UNION ALL
SELECT vec_id, 0, vec_id, vec_id IS NOT NULL FROM embeddings WHERE vec_id IS NULL OR embedding IS NULL OR len(embedding) = 0
  OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0
"""


def _licence_sql() -> str:
    """Every template at every place of every text: what the index finds, without it."""
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    templates = ", ".join(f"({k}, '{label}', {quoted(t.split())}, {quoted(keys)})" for k, (label, t, keys) in enumerate(licenses.TEMPLATES))
    base = ", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in licenses.BASE.items())
    return rf"""
WITH templates(number, label, words, keys) AS (VALUES {templates}),
phrases(phrase, label, n) AS (VALUES {base}),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
known AS (SELECT number, label, words, keys, unnest(words) AS word, unnest(range(0, len(words))) AS k FROM templates),
places AS (SELECT r, word, pos FROM (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM docs) WHERE word IN (SELECT word FROM known) OR word IN (SELECT split_part(phrase, ' ', 1) FROM phrases)),
based AS (
  SELECT p.r, p.pos, label FROM places p JOIN phrases b ON p.word = split_part(b.phrase, ' ', 1) JOIN docs d ON d.r = p.r
  WHERE array_to_string(w[p.pos + 1:p.pos + n], ' ') = phrase),
votes AS (SELECT r, number, pos - k AS start, count(*) AS n FROM places JOIN known USING (word) GROUP BY ALL),
tried AS (SELECT v.r, v.start, v.n::DOUBLE / len(words) AS share, t.label, words, keys FROM votes v JOIN templates t USING (number) WHERE n >= 2 AND n::DOUBLE / len(words) >= 0.4),
aligned AS (
  SELECT t.r, label, max(share) AS share FROM tried t JOIN docs d USING (r)
  WHERE len(list_filter(keys, lambda key: NOT contains(' ' || array_to_string(w[greatest(0, start) + 1:start + len(words)], ' ') || ' ', ' ' || key || ' '))) = 0 GROUP BY t.r, label),
base_of AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM based GROUP BY r),
own_of AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM aligned GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(o.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0) END AS score
FROM docs d LEFT JOIN base_of b USING (r) LEFT JOIN own_of o USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": LINES_SQL, "op3_embedding_dedup": EMBEDDINGS_SQL, "op4_warc_revisits": WARC_SQL, "op5_quality_rules": QUALITY_SQL,
        "op8_mixing": MIXING_SQL, "op9_license_scan": _licence_sql(),
    }
