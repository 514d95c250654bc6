"""Run-log metrics and lint of saved filter strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.operators import quality
from loglattice.plans.registry import query
from loglattice.plans.views import NOW_SQL, now_column
from loglattice.sources.tables import read_table

RUNS = """runs AS (SELECT event_id, event_type AS stage, value / 20 AS seconds, event_type <> 'error' AS ok,
    user_id % 4 AS attempts, user_id % 3 = 0 AS exact, event_id % 5 AS fields, CASE WHEN user_id % 50 = 0 THEN event_id % 2 ELSE 0 END AS unknown_fields,
    FALSE AS leaked, ts FROM events)"""


def _runs(spark, folder):
    """Events as a run log: latency, outcome, repair attempts, field use."""
    user, n = F.col("user_id"), F.col("event_id")
    return read_table(spark, folder, "events").select(
        "event_id",
        F.col("event_type").alias("stage"),
        (F.col("value") / 20).alias("seconds"),
        (F.col("event_type") != "error").alias("ok"),
        (user % 4).alias("attempts"),
        (user % 3 == 0).alias("exact"),
        (n % 5).alias("fields"),
        F.when(user % 50 == 0, n % 2).otherwise(0).alias("unknown_fields"),
        F.lit(False).alias("leaked"),
        "ts",
    )


_BUCKETS = " UNION ALL ".join(
    f"SELECT stage, CAST({b} AS DOUBLE) AS le, count(*) FILTER (WHERE seconds <= {b}) AS n FROM runs GROUP BY stage"
    for b in quality.BUCKETS
)


@query("latency_histogram", f"WITH {RUNS} {_BUCKETS} UNION ALL SELECT stage, NULL, count(seconds) FROM runs GROUP BY stage")
def latency_histogram(spark, folder):
    return quality.latency_histogram(_runs(spark, folder), "seconds", ["stage"])


@query("refinement_total", f"WITH {RUNS} SELECT stage, CAST(sum(attempts) AS BIGINT) AS attempts FROM runs GROUP BY stage")
def refinement_total(spark, folder):
    return _runs(spark, folder).groupBy("stage").agg(F.sum("attempts").alias("attempts"))


@query("catalog_age", f"SELECT CAST(epoch_us({NOW_SQL}) - epoch_us(max(ts)) AS DOUBLE) / 1000000 AS age_seconds FROM events")
def catalog_age(spark, folder):
    """Seconds since the last refresh event, negative when the clock given is earlier."""
    return quality.catalog_age(_runs(spark, folder), "ts", now_column())


@query(
    "run_rates",
    f"""WITH {RUNS} SELECT stage, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 6) AS execution_success_rate,
          round(avg(CASE WHEN attempts > 0 THEN 1.0 ELSE 0 END), 6) AS refinement_rate, round(avg(attempts), 6) AS mean_attempts,
          CAST(sum(attempts) AS BIGINT) AS total_attempts, round(avg(CASE WHEN exact THEN 1.0 ELSE 0 END), 6) AS exact_match,
          round(sum(unknown_fields) / sum(fields), 6) AS hallucination_rate,
          round(avg(CASE WHEN leaked THEN 1.0 ELSE 0 END), 6) AS leak_rate FROM runs GROUP BY stage""",
)
def run_rates(spark, folder):
    rates = quality.run_rates(_runs(spark, folder), ["stage"])
    return rates.select(
        *[c if c in ("stage", "total_attempts") else F.round(c, 6).alias(c) for c in rates.columns]
    )


@query("p95_latency", f"WITH {RUNS} SELECT stage, round(quantile_cont(seconds, 0.95), 6) AS p95 FROM runs GROUP BY stage")
def p95_latency(spark, folder):
    """Exact 95th percentile per stage."""
    return quality.p95(_runs(spark, folder), ["stage"], "seconds").select("stage", F.round("p95", 6).alias("p95"))


@query(
    "count_questions",
    """SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean
       FROM events WHERE event_type = 'purchase' GROUP BY user_id""",
)
def count_questions(spark, folder):
    """Count, sum and average by field over the matching events."""
    found = read_table(spark, folder, "events").where(F.col("event_type") == "purchase")
    return found.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 4).alias("total"),
        F.round(F.avg("value"), 6).alias("mean"),
    )


# ------------------------------------------------------------------------- lint

# Saved filter strings, sound and broken, one per order.
_TEMPLATES = [
    'service.name: "s{0}" AND log.level: "ERROR"',
    "",
    'status: {0} AND AND level: "x"',
    "AND took >= {0}",
    'service.name: "s{0}" OR',
    "service.name: AND bogus_{0}: 5",
    "(status: {0} AND (level: warn)",
    "user:{ first: a{0} )",
    "took >= {0} and not or OR status: 5",
    'message: "timeout {0}" AND @timestamp >= now-1h',
    "missing.field < {0} OR missing.field > 9",
    "  NOT (status: 2{0} OR level: debug) ",
]
_KNOWN = ["service.name", "log.level", "status", "level", "took", "@timestamp", "message", "user", "first"]


def _saved_sql() -> str:
    cases = " ".join(
        f"WHEN {i} THEN '" + t.replace("{0}", "' || (o_custkey % 100) || '") + "'" for i, t in enumerate(_TEMPLATES)
    )
    return f"saved AS (SELECT o_orderkey AS query_id, trim(CASE o_orderkey % {len(_TEMPLATES)} {cases} END) AS kql FROM orders)"


SAVED = _saved_sql()


def _saved(spark, folder):
    number = (F.col("o_custkey") % 100).cast("string")
    made = [F.replace(F.lit(t), F.lit("{0}"), number) for t in _TEMPLATES]
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("query_id"),
        F.element_at(F.array(*made), (F.col("o_orderkey") % len(_TEMPLATES) + 1).cast("int")).alias("kql"),
    )


def _catalog(spark, folder):
    """Known fields per saved query; every fifth query has an empty catalog."""
    names = F.explode(F.array(*[F.lit(k) for k in _KNOWN]))
    return _saved(spark, folder).where(F.col("query_id") % 5 != 0).select("query_id", names.alias("field"))


_FIELD_SQL = "regexp_extract_all(kql, '([\\w.@]+)\\s*[:<>!=]', 1)"
_KNOWN_SQL = ", ".join(f"'{k}'" for k in _KNOWN)


@query(
    "unknown_fields",
    f"""WITH {SAVED} SELECT DISTINCT query_id, field FROM (SELECT query_id, unnest({_FIELD_SQL}) AS field FROM saved)
        WHERE upper(field) NOT IN ('AND', 'OR', 'NOT', 'NOW') AND query_id % 5 <> 0 AND field NOT IN ({_KNOWN_SQL})""",
)
def unknown_fields(spark, folder):
    """Fields used by a saved filter but absent from its catalog."""
    return quality.unknown_fields(_saved(spark, folder), _catalog(spark, folder))


_INNER = "regexp_replace(kql, '[^(){}]', '', 'g')"
for _ in range(4):
    _INNER = f"replace(replace({_INNER}, '()', ''), '{{}}', '')"


@query(
    "lint_rules",
    f"""WITH {SAVED} SELECT query_id, kql = '' AS is_empty, {_INNER} = '' AS balanced,
          array_to_string(regexp_extract_all(kql, '{quality.DOUBLED}', 1), ',') AS doubled,
          regexp_matches(kql, '{quality.STARTS}') OR regexp_matches(kql, '{quality.ENDS}') AS dangling,
          array_to_string(list_filter(regexp_extract_all(kql, '(?i)([\\w.@]+)\\s*:\\s*(?:AND\\b|OR\\b|NOT\\b|$)', 1),
            lambda x: upper(x) NOT IN ('AND', 'OR', 'NOT')), ',') AS no_value FROM saved""",
)
def lint_rules(spark, folder):
    """Each lint rule on its own over every saved filter string."""
    saved = _saved(spark, folder).withColumn("kql", F.trim("kql"))
    kql = F.col("kql")
    return saved.select(
        "query_id",
        (kql == "").alias("is_empty"),
        quality.bracket_error(kql).isNull().alias("balanced"),
        F.array_join(quality.doubled_operators(kql), ",").alias("doubled"),
        quality.dangling_operator(kql).isNotNull().alias("dangling"),
        F.array_join(quality.fields_without_value(kql), ",").alias("no_value"),
    )


@query(
    "lint_saved_filters",
    f"""WITH {SAVED}, bad AS (SELECT DISTINCT query_id FROM (SELECT query_id, unnest({_FIELD_SQL}) AS field FROM saved)
          WHERE upper(field) NOT IN ('AND', 'OR', 'NOT', 'NOW') AND query_id % 5 <> 0 AND field NOT IN ({_KNOWN_SQL}))
        SELECT query_id, kql <> '' AND {_INNER} = '' AND NOT regexp_matches(kql, '{quality.DOUBLED}')
          AND NOT regexp_matches(kql, '{quality.STARTS}') AND NOT regexp_matches(kql, '{quality.ENDS}')
          AND NOT regexp_matches(kql, '(?i)[\\w.@]+\\s*:\\s*(?:AND\\b|OR\\b|NOT\\b|$)')
          AND query_id NOT IN (SELECT query_id FROM bad) AS valid FROM saved""",
)
def lint_saved_filters(spark, folder):
    """All rules together, with the list of errors kept beside the verdict."""
    return quality.lint(_saved(spark, folder), _catalog(spark, folder)).select("query_id", "valid")
