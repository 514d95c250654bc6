"""How the given tables stand for logs, documents, questions and sessions.

Each Spark view has a SQL twin (a list of common table expressions) used by the
check SQL.  Everything is a deterministic function of the tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.functions.metadata import PARAGRAPH_SOURCES, WINDOW_SOURCES
from loglattice.operators.indexing import enrich, split_chunks
from loglattice.functions.text import not_blank, strip
from loglattice.sources.tables import read_table, spread

NOW = datetime(2024, 1, 20)
NOW_SQL = "TIMESTAMP '2024-01-20 00:00:00'"
EPOCH = "timestamp'2024-01-01 00:00:00'"


def now_column() -> Column:
    return F.lit(NOW).cast("timestamp")


def day(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


# ------------------------------------------------------------------------- logs


def logs(spark: SparkSession, folder: str) -> DataFrame:
    """Events in log shape: flat dotted keys, a JSON payload, a message."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read_table(spark, folder, "events").select(
        "event_id",
        F.col("ts").alias("@timestamp"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("service.name"),
        F.col("event_type").alias("log.level"),
        F.col("value").alias("took"),
        F.when(k % 10 != 0, k).alias("k"),
        F.concat_ws(
            " ",
            F.initcap("event_type"), F.lit("by user"), F.col("user_id").cast("string"),
            F.lit("key"), k.cast("string"),
        ).alias("message"),
    )


LOGS = """logs AS (
  SELECT event_id, ts, 'user-' || user_id AS service, event_type AS level, value AS took,
         CASE WHEN kk % 10 <> 0 THEN kk END AS k,
         upper(event_type[1]) || event_type[2:] || ' by user ' || user_id || ' key ' || kk AS message
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS kk FROM events))"""

# ------------------------------------------------------------------------- documents

SOURCE_TYPES = ["runbook", "jira", "slack", "github"]


def raw_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(read_table(spark, folder, "documents"), "doc_id")
    return as_raw(docs, read_table(spark, folder, "labels"))


def as_raw(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents in raw form; status, acceptance and merge flags come from the labels."""
    source = F.element_at(
        F.array(*[F.lit(s) for s in SOURCE_TYPES]), (F.substring("source", 4, 9).cast("int") % 4) + 1
    )
    status = (
        F.when(F.col("toxic") == 1, " Deprecated")
        .when(F.col("quality") == 1, "Done ")
        .when(F.col("quality") == 0, "in progress")
    )
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        "source",
        source.alias("source_type"),
        F.concat(F.lit("doc://"), F.col("source"), F.lit("/"), F.col("doc_id")).alias("source_uri"),
        F.col("text").alias("raw_text"),
        (F.expr(EPOCH) + F.make_dt_interval((F.col("doc_id") % 365).cast("int"))).alias("created_at"),
        (F.expr(EPOCH) + F.make_dt_interval((F.col("doc_id") * 7 % 365).cast("int"))).alias("updated_at"),
        F.map_from_arrays(F.array(F.lit("jira_status")), F.array(status)).alias("metadata"),
        (F.col("quality") == 1).alias("accepted_flag"),
        (F.col("doc_id") % 2 == 0).alias("merged_flag"),
    )


# Fixed value: the whitespace class in the check SQL's regex dialect.
SQL_WS = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

DOCS = f"""docs AS (
  SELECT d.doc_id, d.source, d.text,
         CASE CAST(substr(d.source, 4) AS INTEGER) % 4
           WHEN 0 THEN 'runbook' WHEN 1 THEN 'jira' WHEN 2 THEN 'slack' ELSE 'github' END AS source_type,
         'doc://' || d.source || '/' || d.doc_id AS source_uri,
         regexp_replace(d.text, '^{SQL_WS}+|{SQL_WS}+$', '', 'g') AS raw_text,
         TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 365 AS INTEGER)) AS created_at,
         TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id * 7 % 365 AS INTEGER)) AS updated_at,
         CASE WHEN l.toxic = 1 THEN 'deprecated' WHEN l.quality = 1 THEN 'resolved'
              WHEN l.quality = 0 THEN 'open' ELSE 'unknown' END AS resolution_status,
         coalesce(l.quality = 1, FALSE) AS accepted
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
tiered AS (
  SELECT *, CASE WHEN source_type = 'runbook' THEN 'A'
                 WHEN source_type = 'github' AND doc_id % 2 = 0 THEN 'A'
                 WHEN source_type = 'jira' AND resolution_status = 'resolved' AND accepted THEN 'A'
                 ELSE 'B' END AS tier
  FROM docs)"""


def chunk_sql(source_cte: str = "tiered", out: str = "chunks") -> str:
    """CTEs cutting ``source_cte.raw_text`` into ``out`` by the source's rule."""
    windows = ", ".join(f"'{s}'" for s in WINDOW_SOURCES)
    parts = ", ".join(f"'{s}'" for s in PARAGRAPH_SOURCES)
    return f"""{out}_sections AS (
  SELECT *, unnest(secs) AS sec, generate_subscripts(secs, 1) AS sec_no FROM (
    SELECT *, CASE WHEN source_type IN ({parts}) AND len(paras) > 0 THEN paras ELSE [raw_text] END AS secs
    FROM (SELECT *, list_filter(list_transform(
              regexp_split_to_array(raw_text, '\\n{SQL_WS}*\\n'),
              lambda x: regexp_replace(x, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')), lambda x: x <> '') AS paras
          FROM {source_cte} WHERE raw_text <> ''))),
{out}_words AS (
  SELECT *, list_filter(regexp_split_to_array(sec, '{SQL_WS}+'), lambda x: x <> '') AS w,
         CASE WHEN source_type IN ({windows}) THEN 512 ELSE 256 END AS size,
         CASE WHEN source_type IN ({windows}) THEN 448 ELSE 256 END AS step
  FROM {out}_sections),
{out}_cut AS (
  SELECT *, unnest(range(0, CASE WHEN len(w) <= size THEN 1
           ELSE CAST(ceil((len(w) - size) / step) AS BIGINT) + 1 END)) AS win
  FROM {out}_words),
{out} AS (
  SELECT doc_id, source_type, source_uri, created_at, resolution_status, accepted, tier,
         row_number() OVER (PARTITION BY doc_id ORDER BY sec_no, win) - 1 AS ordinal,
         doc_id || '-chunk-' || (row_number() OVER (PARTITION BY doc_id ORDER BY sec_no, win) - 1) AS chunk_id,
         array_to_string(w[win * step + 1 : win * step + size], ' ') AS content
  FROM {out}_cut)"""


CHUNKS = f"{DOCS},\n{chunk_sql()}"


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk rows with metadata, cut from the trimmed text without tagging."""
    docs = raw_documents(spark, folder).where(not_blank(F.col("raw_text")))
    return split_chunks(enrich(docs.withColumn("raw_text", strip(F.col("raw_text")))))


# ------------------------------------------------------------------------- questions


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)"

# ------------------------------------------------------------------------- sessions


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "conversations"), "conv_id")
