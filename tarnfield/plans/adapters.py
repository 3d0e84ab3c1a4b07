"""Views of the given tables under the engine's names, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.functions import text as T
from tarnfield.operators.lexical import Index, held_index

EXTENSIONS = ("md", "pdf", "png", "mp3", "py", "txt")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with path, trust (from labels), asset and times (from ids)."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", F.col("source").alias("source_id"), "n_chars",
        F.when(F.col("quality") == 1, "primary").when(F.col("quality") == 0, "secondary").otherwise("generated").alias("trust_level"),
        F.concat(F.lit("notes/"), "source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("workspace_path"),
        (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval((F.col("doc_id") % 60).cast("int"))).alias("updated_at"),
        F.col("doc_id").alias("n"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read(spark, sf_dir, "labels")
    return lab.where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("toxic").alias("tag"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "text")


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of all documents, made once for each folder of tables and session."""
    return held_index(chunks(spark, sf_dir), sf_dir)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's whole text."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


def word_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of each benchmark item as a query of its own."""
    words = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", T.SPACE_CLASS)).alias("k", "text"))
    return words.select(F.concat_ws(":", "item_id", "k").alias("query_id"), "text")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").cast("string").alias("doc_id"), "embedding", "label", F.when(F.col("vec_id") % 7 == 0, "pending").otherwise("committed").alias("status"), F.col("vec_id").alias("n"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50."""
    return embeddings(spark, sf_dir).where("n % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", "label")


def ocr_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    page = F.get_json_object("props", "$.k")
    return e.select("event_id", F.col("user_id").alias("run_id"), "ts", (F.col("event_type") != "error").alias("success"), F.floor("value").cast("bigint").alias("ms"), F.col("event_type").alias("engine"), page.alias("doc_id"))


# the same for DuckDB, with all constants written out -------------------------------------------
def sql_tokens(text: str) -> str:
    return rf"regexp_extract_all(translate(lower(coalesce({text}, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '([\p{{L}}\p{{N}}]+)', 1)"


SQL_SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SQL_ITEMS = "SELECT CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark"
SQL_WORDS = f"SELECT item_id || ':' || (generate_subscripts(w, 1) - 1) AS query_id, unnest(w) AS text FROM (SELECT item_id, regexp_split_to_array(text, '{SQL_SPACE}') AS w FROM benchmark)"


SQL_DOCS = """docs AS (SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, text, lang, source AS source_id, n_chars,
  CASE WHEN quality = 1 THEN 'primary' WHEN quality = 0 THEN 'secondary' ELSE 'generated' END AS trust_level,
  'notes/' || source || '/' || lang || '/doc' || d.doc_id || '.' || (['md','pdf','png','mp3','py','txt'])[d.doc_id % 6 + 1] AS workspace_path,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(d.doc_id % 60 AS INTEGER)) AS updated_at, d.doc_id AS n
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
SQL_EVENTS = """ocr AS (SELECT event_id, user_id AS run_id, ts, event_type <> 'error' AS success, CAST(floor(value) AS BIGINT) AS ms,
  event_type AS engine, json_extract_string(props, '$.k') AS doc_id FROM events)"""
