"""Log search: every predicate, hit shape, caps, totals, multi-table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions import predicates as p
from loglattice.functions.masking import mask_rows
from loglattice.functions.text import let, split_words
from loglattice.operators import logs as hits
from loglattice.plans.registry import query
from loglattice.plans.views import (
    DOCS, LOGS, NOW, SQL_WS, logs, messages, now_column, questions, raw_documents,
)
from loglattice.sources.tables import read_table, scan_indices


def _filter_sql(condition: str) -> str:
    return f"WITH {LOGS} SELECT event_id, service, level FROM logs WHERE {condition}"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", F.col("`service.name`").alias("service"), F.col("`log.level`").alias("level")
    )


def _register(name: str, condition: str, spec: dict) -> None:
    @query(f"predicate_{name}", _filter_sql(condition))
    def run(spark, folder):
        return _shown(p.search(logs(spark, folder), spec, now=NOW))


ERROR = {"term": {"log.level": "error"}}

_register("match_all", "TRUE", {})
_register("term", "service = 'user-7'", {"term": {"service.name": "user-7"}})
_register("terms", "level IN ('error', 'signup')", {"terms": {"log.level": ["error", "signup"]}})
_register(
    "match",
    "list_has_any(regexp_extract_all(lower(message), '[\\p{L}\\p{N}_]+'), ['purchase', '17'])",
    {"match": {"message": "Purchase 17"}},
)
_register(
    "multi_match",
    "list_has_any(regexp_extract_all(lower(message), '[\\p{L}\\p{N}_]+'), ['error', '42'])"
    " OR list_has_any(regexp_extract_all(lower(service), '[\\p{L}\\p{N}_]+'), ['error', '42'])"
    " OR list_has_any(regexp_extract_all(lower(level), '[\\p{L}\\p{N}_]+'), ['error', '42'])",
    {"multi_match": "ERROR 42"},
)
_register("exists", "k IS NOT NULL", {"exists": "k"})
_register("wildcard", "service LIKE 'user-1%9'", {"wildcard": {"service.name": "user-1*9"}})
_register("range", "took >= 100 AND took < 200", {"range": {"took": {"gte": 100.0, "lt": 200.0}}})
_register(
    "relative_time",
    "ts >= TIMESTAMP '2024-01-19 22:30:00' AND ts < TIMESTAMP '2024-01-20'",
    {"range": {"@timestamp": {"gte": "now-90m", "lt": "now/d"}}},
)
_register("all_of", "level = 'error' AND took > 50", {"all": [ERROR, {"range": {"took": {"gt": 50.0}}}]})
_register(
    "any_of", "level = 'error' OR took > 150", {"any": [ERROR, {"range": {"took": {"gt": 150.0}}}]}
)
_register("none_of", "NOT coalesce(k > 40, FALSE)", {"none": [{"range": {"k": {"gt": 40}}}]})
_register(
    "mixed",
    "(level IN ('error', 'view') AND NOT coalesce(k >= 20, FALSE)) OR service LIKE 'user-9%'",
    {
        "any": [
            {"all": [{"terms": {"log.level": ["error", "view"]}}, {"none": [{"range": {"k": {"gte": 20}}}]}]},
            {"wildcard": {"service.name": "user-9*"}},
        ]
    },
)
_register(
    "time_range",
    "ts >= TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-20'",
    {"range": {"@timestamp": {"gte": "now-7d", "lte": "now"}}},
)


@query(
    "predicate_array_term",
    f"""SELECT conv_id, turn FROM conversations
        WHERE list_contains(regexp_split_to_array(text, '{SQL_WS}+'), 'die')
           OR list_contains(regexp_split_to_array(text, '{SQL_WS}+'), 'the')""",
)
def array_term(spark, folder):
    words = split_words(F.col("text"))
    return (
        messages(spark, folder)
        .where(p.any_of(p.array_term(words, "die"), p.array_term(words, "the")))
        .select("conv_id", "turn")
    )


@query(
    "predicate_nested_same_element",
    f"""WITH {DOCS}, pairs AS (
          SELECT doc_id, list_filter(regexp_split_to_array(text, '{SQL_WS}+'), lambda x: x <> '') AS w FROM docs)
        SELECT doc_id FROM pairs
        WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0""",
)
def nested_same_element(spark, folder):
    """Documents holding the word pair "of the" as one (first, last) element."""
    pairs = let(
        split_words(F.col("raw_text")),
        lambda w: F.zip_with(
            w, F.slice(w, 2, F.size(w)), lambda a, b: F.struct(a.alias("first"), b.alias("last"))
        ),
    )
    docs = raw_documents(spark, folder)
    spec = {"nested": {"pairs": {"all": [{"term": {"first": "of"}}, {"term": {"last": "the"}}]}}}
    return p.search(docs.select("doc_id", pairs.alias("pairs")), spec).select("doc_id")


@query(
    "predicate_as_of",
    f"""WITH {DOCS}, asked AS (
          SELECT c_custkey AS query_id, 'src' || (c_custkey % 20) AS source,
                 TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS not_after FROM customer)
        SELECT query_id, count(*) AS n_docs, CAST(sum(doc_id) AS BIGINT) AS id_sum
        FROM asked JOIN docs USING (source) WHERE created_at <= not_after GROUP BY query_id""",
)
def as_of(spark, folder):
    """Documents visible to each question under its own bound.

    Documents are summed per (source, moment) and accumulated over the days that occur, so a
    question meets one total of the days before its bound and the moments of the bound's own
    day, not all documents before it.  A source's window holds a row per day at most.
    """
    start = F.expr("date'2024-01-01'")
    moments = (
        raw_documents(spark, folder)
        .groupBy("source", "created_at")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("s"))
        .withColumn("day", F.to_date("created_at"))
    )
    asked = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("query_id"),
        F.concat(F.lit("src"), F.col("c_custkey") % 20).alias("source"),
        F.date_add(start, (F.col("c_custkey") % 365).cast("int")).cast("timestamp").alias("not_after"),
    )
    bounds = asked.select("source", "not_after").distinct().withColumn("day", F.to_date("not_after"))
    per_day = moments.groupBy("source", "day").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    before = Window.partitionBy("source").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_day.join(bounds.select("source", "day").distinct(), ["source", "day"], "full_outer").select(
        "source", "day", F.sum("n").over(before).alias("n"), F.sum("s").over(before).alias("s")
    )
    same = moments.join(bounds, ["source", "day"]).where(p.as_of(F.col("created_at"), F.col("not_after")))
    visible = (
        bounds.join(earlier, ["source", "day"])
        .select("source", "not_after", "n", "s")
        .unionByName(same.select("source", "not_after", "n", "s"))
        .groupBy("source", "not_after")
        .agg(F.sum("n").alias("n_docs"), F.sum("s").alias("id_sum"))
        .where("n_docs > 0")
    )
    return asked.join(visible, ["source", "not_after"]).select("query_id", "n_docs", "id_sum")


@query(
    "predicate_as_of_rows",
    f"""WITH {DOCS} SELECT doc_id FROM docs WHERE created_at <= TIMESTAMP '2024-05-01 12:00:00'""",
)
def as_of_rows(spark, folder):
    """One bound for the whole scan."""
    bound = F.expr("timestamp'2024-05-01 12:00:00'")
    return raw_documents(spark, folder).where(p.as_of(F.col("created_at"), bound)).select("doc_id")


@query(
    "predicate_sources",
    f"WITH {DOCS} SELECT doc_id, source_type FROM docs WHERE source_type IN ('runbook', 'jira')",
)
def sources(spark, folder):
    return (
        raw_documents(spark, folder)
        .where(p.in_sources(F.col("source_type"), ["runbook", "jira"]))
        .select("doc_id", "source_type")
    )


@query(
    "predicate_threshold",
    "SELECT o_orderkey, round(o_totalprice / 500000, 6) AS score FROM orders WHERE o_totalprice / 500000 >= 0.7",
)
def threshold(spark, folder):
    score = F.col("o_totalprice") / 500000
    return (
        read_table(spark, folder, "orders")
        .where(p.at_least(score, 0.7))
        .select("o_orderkey", F.round(score, 6).alias("score"))
    )


@query(
    "relative_time_bounds",
    f"""WITH asked AS (SELECT item_id AS query_id, item_id % 4 AS kind FROM benchmark), bound AS (
          SELECT query_id, CASE kind WHEN 0 THEN TIMESTAMP '2024-01-19 23:00:00'
                   WHEN 1 THEN TIMESTAMP '2024-01-19 23:30:00' WHEN 2 THEN TIMESTAMP '2024-01-20'
                   ELSE TIMESTAMP '2024-01-13' END AS b FROM asked)
        SELECT query_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS lower_bound FROM bound""",
)
def relative_time_bounds(spark, folder):
    """Per-question relative bounds resolved against one explicit now."""
    kinds = F.array(*[F.lit(x) for x in ("now-1h", "now-30m", "now/d", "now-1w")])
    expression = F.element_at(kinds, (F.col("query_id") % 4 + 1).cast("int"))
    return questions(spark, folder).select(
        "query_id",
        F.date_format(p.relative_time_column(expression, now_column()), "yyyy-MM-dd HH:mm:ss").alias(
            "lower_bound"
        ),
    )


@query(
    "hit_normalisation",
    f"""WITH {LOGS} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, service, level, message,
          CAST(NULL AS VARCHAR) AS trace_id, event_id FROM logs""",
)
def hit_normalisation(spark, folder):
    shaped = hits.normalise_hits(logs(spark, folder), extras=["event_id"])
    return shaped.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query(
    "result_status",
    """SELECT event_id, CASE WHEN value > 200 OR user_id % 10 > 7 THEN 'partial' ELSE 'success' END AS status
       FROM events""",
)
def result_status(spark, folder):
    failed = F.greatest(F.col("user_id") % 10 - 7, F.lit(0))
    return read_table(spark, folder, "events").select(
        "event_id", hits.result_status(F.col("value") > 200, failed).alias("status")
    )


@query(
    "capped_results",
    f"""WITH {LOGS} SELECT event_id, took FROM logs WHERE level = 'error'
        ORDER BY ts DESC, event_id LIMIT 500""",
)
def capped_results(spark, folder):
    found = p.search(logs(spark, folder), ERROR)
    return hits.capped(found, [F.desc("@timestamp"), F.asc("event_id")]).select("event_id", "took")


@query(
    "hit_totals",
    f"WITH {LOGS} SELECT count(*) AS total, least(count(*), 500) AS returned FROM logs WHERE level = 'error'",
)
def hit_totals(spark, folder):
    return hits.hit_totals(p.search(logs(spark, folder), ERROR))


@query(
    "multi_index_scan",
    """SELECT 'customer' AS _index, c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment
       FROM customer WHERE c_acctbal > 5000
       UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier WHERE s_acctbal > 5000
       UNION ALL SELECT 'part', p_partkey, p_name, p_retailprice * 1.0, NULL FROM part WHERE p_retailprice > 5000""",
)
def multi_index_scan(spark, folder):
    """One filter over three differently shaped tables; each scan gets its own pushdown."""
    tables = {
        "customer": read_table(spark, folder, "customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
            F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
        ),
        "supplier": read_table(spark, folder, "supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
        ),
        "part": read_table(spark, folder, "part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
            F.col("p_retailprice").alias("balance"),
        ),
    }
    return scan_indices(tables).where(p.between(F.col("balance"), gt=5000.0))


def log_search(spark, folder) -> DataFrame:
    """Slow failing events of one week, newest first: filter, normalise, cap, then mask."""
    spec = {
        "all": [
            ERROR,
            {"range": {"took": {"gte": 20.0}}},
            {"range": {"@timestamp": {"gte": "now-7d", "lt": "now"}}},
        ]
    }
    found = p.search(logs(spark, folder), spec, now=NOW)
    shaped = hits.normalise_hits(found, extras=["event_id", "took"])
    top = hits.capped(shaped, [F.desc("timestamp"), F.asc("event_id")])
    return mask_rows(top, keep=["trace_id"]).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


query(
    "log_search",
    f"""WITH {LOGS} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, service, level, message,
          CAST(NULL AS VARCHAR) AS trace_id, event_id, took FROM logs
        WHERE level = 'error' AND took >= 20 AND ts >= TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-20'
        ORDER BY ts DESC, event_id LIMIT 500""",
)(log_search)
