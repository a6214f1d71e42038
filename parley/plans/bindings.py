"""The provided tables as the corpus tables, once in Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.stored import stored


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def movies(self) -> DataFrame:
        d = F.col("doc_id")
        year = (1950 + d % 75).cast("int")
        return self.table("documents").select(
            d.alias("id"), F.concat_ws("-", "source", d.cast("string")).alias("title"), year.alias("year"), (F.floor(year / 10) * 10).cast("int").alias("decade"),
            F.col("n_chars").alias("votes"), F.array((d % 7).cast("int"), (d % 5).cast("int")).alias("genre_ids"), F.array((d % 11).cast("int")).alias("keyword_ids"),
        )

    @property
    def lines(self) -> DataFrame:
        """Lines with their normal form, which is worked out once and stored. Each is made where its text is read; nothing is shuffled."""

        def made() -> DataFrame:
            return self.spoken.withColumn("text_norm", normalize(F.col("text")))

        return stored(self.spark, f"lines of {self.dir}", made)

    @property
    def spoken(self) -> DataFrame:
        """Lines as they stand, read from the texts; for what needs no normal form."""
        docs, tasks = self.table("documents").select("doc_id", "text"), self.spark.sparkContext.defaultParallelism
        if docs.rdd.getNumPartitions() < tasks:  # few splits, so few bytes
            docs = docs.repartition(tasks)
        texts = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
        rows = docs.select(F.col("doc_id").alias("movie_id"), texts.alias("t")).select("movie_id", F.size("t").alias("n"), F.posexplode("t").alias("seq", "text"))
        arc = F.when(F.col("n") > 1, F.col("seq") / (F.col("n") - 1)).otherwise(F.lit(0.0))
        return rows.select("movie_id", F.col("seq").cast("long").alias("seq"), arc.alias("arc"), "text")

    @property
    def quality(self) -> DataFrame:
        labels = self.table("labels").select(F.col("doc_id").alias("movie_id"), (F.col("quality") == 0).alias("downrank"))
        docs = self.table("documents").select(F.col("doc_id").alias("movie_id"), (F.col("lang") != "en").alias("non_english"))
        return docs.join(labels, "movie_id", "left").na.fill(False, ["downrank"])

    @property
    def windows(self) -> DataFrame:
        """Vectors as windows of the film that their label names."""
        w = W.partitionBy("movie_id").orderBy("vec_id")
        rows = self.table("embeddings").select(F.col("label").cast("long").alias("movie_id"), "vec_id", F.col("embedding").alias("vec")).withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
        n = F.count("*").over(W.partitionBy("movie_id"))
        return rows.select("movie_id", "idx", "vec_id", (6 * F.col("idx")).alias("start_seq"), (6 * F.col("idx") + 11).alias("end_seq"), (F.col("idx") / n).alias("arc"), "vec")

    @property
    def texts(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("movie_id"), "text")

    @property
    def beats(self) -> DataFrame:
        """The windows with the text of their film."""
        return self.windows.join(self.texts, "movie_id")

    @property
    def paired(self) -> DataFrame:
        """Windows of which every fifth of an odd film is drawn to the one at its place in the film before, so that films have parallels."""
        own = self.windows
        before = own.where("movie_id % 2 = 0 AND idx % 5 = 0").select((F.col("movie_id") + 1).alias("movie_id"), "idx", F.col("vec").alias("other"))
        mixed = F.zip_with("vec", "other", lambda x, y: x.cast("double") + 1.2 * y.cast("double"))
        both = own.join(before, ["movie_id", "idx"], "left").withColumn("mixed", mixed)
        length = F.sqrt(F.aggregate("mixed", F.lit(0.0), lambda a, x: a + x * x))
        drawn = F.when(F.col("other").isNotNull(), F.transform("mixed", lambda x: x / length)).otherwise(F.col("vec").cast("array<double>"))
        return both.withColumn("vec", drawn).drop("other", "mixed")

    @property
    def cues(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("movie_id"), F.col("turn").alias("idx"), "text")

    @property
    def log(self) -> DataFrame:
        return self.table("events").select(
            "ts", F.col("event_type").alias("query"), F.col("event_type").alias("query_norm"), F.get_json_object("props", "$.k").cast("int").alias("hits"),
            F.lit(0).alias("strong"), F.lit(False).alias("had_movie"), F.col("value").alias("took_ms"), F.col("user_id").alias("visitor"),
        )

    @property
    def query_vector(self) -> list[float]:
        """The vector of the lowest vec_id stands for an encoded query."""
        return self.table("embeddings").orderBy("vec_id").limit(1).first()["embedding"]


def normal_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower(strip_accents({c})), '‘’', ''''''), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g'))"


MOVIES = """movies AS (
  SELECT doc_id AS id, source || '-' || doc_id AS title, (1950 + doc_id % 75)::INT AS year, ((1950 + doc_id % 75) // 10 * 10)::INT AS decade,
    n_chars AS votes, [(doc_id % 7)::INT, (doc_id % 5)::INT] AS genre_ids, [(doc_id % 11)::INT] AS keyword_ids FROM documents)"""
LINES = f"""line_lists AS (
  SELECT doc_id AS movie_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS t FROM documents),
lines AS (
  SELECT movie_id, s - 1 AS seq, CASE WHEN len(t) > 1 THEN (s - 1)::DOUBLE / (len(t) - 1) ELSE 0 END AS arc, t[s] AS text, {normal_sql('t[s]')} AS text_norm
  FROM (SELECT movie_id, t, unnest(range(1, len(t) + 1)) AS s FROM line_lists))"""
QUALITY = """quality AS (
  SELECT d.doc_id AS movie_id, lang <> 'en' AS non_english, coalesce(l.quality = 0, false) AS downrank FROM documents d LEFT JOIN labels l USING (doc_id))"""
WINDOWS = """windows AS (
  SELECT movie_id, idx, vec_id, 6 * idx AS start_seq, 6 * idx + 11 AS end_seq, idx::DOUBLE / n AS arc, vec FROM (
    SELECT label::BIGINT AS movie_id, vec_id, embedding::DOUBLE[] AS vec, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx,
      count(*) OVER (PARTITION BY label) AS n FROM embeddings))"""
PAIRED = """paired AS (
  SELECT movie_id, idx, vec_id, start_seq, end_seq, arc, CASE WHEN drawn THEN list_transform(mixed, lambda x: x / sqrt(list_dot_product(mixed, mixed))) ELSE vec END AS vec
  FROM (SELECT w.*, o.vec IS NOT NULL AS drawn, list_transform(list_zip(w.vec, coalesce(o.vec, w.vec)), lambda p: p[1] + 1.2::DOUBLE * p[2]) AS mixed
    FROM windows w LEFT JOIN windows o ON w.movie_id % 2 = 1 AND o.movie_id = w.movie_id - 1 AND o.idx = w.idx AND w.idx % 5 = 0))"""
CUES = "cues AS (SELECT conv_id AS movie_id, turn AS idx, text FROM conversations)"
LOG = "log AS (SELECT ts, event_type AS query_norm, (props::JSON->>'k')::INT AS hits, value AS took_ms, user_id AS visitor FROM events)"
QUERY = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1)"


def sql(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
