"""Dependency graph checks and hypothesis ranking.

The graph is two-level: suppliers depend on their nation, nations on their region.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.functions import scoring
from loglattice.operators import topology
from loglattice.plans.registry import query
from loglattice.sources.tables import read_table

EDGES = """edges AS (SELECT DISTINCT s_name AS src, n_name AS dst FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey)"""


def _edges(spark, folder):
    nation, region = read_table(spark, folder, "nation"), read_table(spark, folder, "region")
    upper = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_name").alias("src"), F.col("r_name").alias("dst")
    )
    supplier = read_table(spark, folder, "supplier")
    lower = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_name").alias("src"), F.col("n_name").alias("dst")
    )
    return lower.unionByName(upper)


@query(
    "expand_hints",
    f"""WITH {EDGES}, hints AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 7 = 0 THEN 'unknown-*'
            ELSE n_name || '-*' END AS hint FROM customer JOIN nation ON n_nationkey = c_nationkey
          UNION ALL SELECT l_orderkey + 1000000, s_name || '-*' FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
        SELECT request_id, hint FROM hints
        UNION SELECT request_id, dst || '-*' FROM hints JOIN edges ON src = replace(hint, '-*', '')""",
)
def expand_hints(spark, folder):
    """Hinted services plus the services they depend on."""
    nation = read_table(spark, folder, "nation")
    named = read_table(spark, folder, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    by_customer = named.select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_custkey") % 7 == 0, "unknown-*")
        .otherwise(F.concat("n_name", F.lit("-*")))
        .alias("hint"),
    )
    lines = read_table(spark, folder, "lineitem").join(
        read_table(spark, folder, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")
    )
    by_line = lines.select(
        (F.col("l_orderkey") + 1000000).alias("request_id"), F.concat("s_name", F.lit("-*")).alias("hint")
    )
    return topology.expand_hints(by_customer.unionByName(by_line), _edges(spark, folder))


@query(
    "check_edges",
    f"""WITH {EDGES}, claims AS (SELECT c_custkey AS claim_id, CASE WHEN c_custkey % 9 = 0 THEN 'svc-' || c_custkey ELSE n_name END AS src,
            r_name AS dst FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = c_custkey % 5)
        SELECT claim_id, c.src, c.dst, CASE WHEN c.src NOT IN (SELECT src FROM edges) THEN 'E008: unknown source'
          WHEN e.src IS NULL THEN 'E008: no such edge' END AS reason
        FROM claims c LEFT JOIN edges e ON e.src = c.src AND e.dst = c.dst""",
)
def check_edges(spark, folder):
    """Claimed dependencies against the graph."""
    nation, region = read_table(spark, folder, "nation"), read_table(spark, folder, "region")
    claims = (
        read_table(spark, folder, "customer")
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(region, F.col("r_regionkey") == F.col("c_custkey") % 5)
        .select(
            F.col("c_custkey").alias("claim_id"),
            F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("svc-"), F.col("c_custkey")))
            .otherwise(F.col("n_name"))
            .alias("src"),
            F.col("r_name").alias("dst"),
        )
    )
    return topology.check_edges(claims, _edges(spark, folder))


@query(
    "check_time_order",
    """WITH claims AS (SELECT c_custkey AS claim_id, c_custkey % 100 AS query_id,
            CASE c_mktsegment WHEN 'BUILDING' THEN 'error' WHEN 'AUTOMOBILE' THEN 'view' WHEN 'MACHINERY' THEN 'click'
              WHEN 'HOUSEHOLD' THEN 'purchase' ELSE 'absent' END AS service,
            TIMESTAMP '2024-01-01' + to_hours(c_custkey % 48) AS claimed_at FROM customer),
        first AS (SELECT user_id % 100 AS query_id, event_type AS service, min(ts) AS first_symptom FROM events GROUP BY ALL)
        SELECT claim_id, query_id, service, coalesce(claimed_at > first_symptom, FALSE) AS violates
        FROM claims LEFT JOIN first USING (query_id, service)""",
)
def check_time_order(spark, folder):
    """Claimed failures later than the first symptom of their service."""
    segments = {"BUILDING": "error", "AUTOMOBILE": "view", "MACHINERY": "click", "HOUSEHOLD": "purchase"}
    services = F.create_map(*[F.lit(x) for pair in segments.items() for x in pair])
    n = F.col("c_custkey")
    claims = read_table(spark, folder, "customer").select(
        n.alias("claim_id"),
        (n % 100).alias("query_id"),
        F.coalesce(F.try_element_at(services, F.col("c_mktsegment")), F.lit("absent")).alias("service"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(hours=(n % 48).cast("int"))).alias(
            "claimed_at"
        ),
    )
    evidence = read_table(spark, folder, "events").select(
        (F.col("user_id") % 100).alias("query_id"), F.col("event_type").alias("service"), "ts"
    )
    return topology.check_time_order(claims, evidence).select("claim_id", "query_id", "service", "violates")


@query(
    "rank_hypotheses",
    """SELECT query_id, id, contradictions, rank FROM (SELECT p_size AS query_id, p_partkey AS id, p_partkey % 4 AS contradictions,
         row_number() OVER (PARTITION BY p_size ORDER BY p_partkey % 4, CAST(floor(p_retailprice) AS BIGINT) % 10 DESC, p_partkey) AS rank
       FROM part WHERE p_partkey % 4 < 2) WHERE rank <= 3""",
)
def rank_hypotheses(spark, folder):
    hypotheses = read_table(spark, folder, "part").select(
        F.col("p_size").alias("query_id"),
        F.col("p_partkey").alias("id"),
        (F.col("p_partkey") % 4).alias("contradictions"),
        (F.floor("p_retailprice") % 10).alias("supporting_evidence_count"),
    )
    return topology.rank_hypotheses(hypotheses).select("query_id", "id", "contradictions", "rank")


@query(
    "clamp_confidence",
    """SELECT event_id, CASE user_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 WHEN 4 THEN NULL
         ELSE least(1.0, greatest(0.0, CASE user_id % 5 WHEN 2 THEN value / 32 ELSE -value END)) END AS confidence
       FROM events""",
)
def clamp_confidence(spark, folder):
    """Numbers into [0, 1]; quoted numbers and words give 0.5; an absent key stays null."""
    v = F.col("value")
    reports = F.element_at(
        F.array(
            F.lit('{"confidence": "high"}'),
            F.concat(F.lit('{"confidence": "'), v, F.lit('"}')),
            F.concat(F.lit('{"confidence": '), v / 32, F.lit("}")),
            F.concat(F.lit('{"confidence": '), -v, F.lit("}")),
            F.lit('{"summary": "none"}'),
        ),
        (F.col("user_id") % 5 + 1).cast("int"),
    )
    return read_table(spark, folder, "events").select(
        "event_id", scoring.clamp_confidence(reports).alias("confidence")
    )


@query(
    "confidence_scores",
    """WITH n AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS supporting,
            count(*) FILTER (WHERE event_type IN ('error', 'view')) AS hits,
            least(count(*) FILTER (WHERE event_type = 'click'), 5) AS chunks FROM events GROUP BY user_id)
        SELECT user_id, round(CASE WHEN hits > 0 THEN supporting / hits ELSE 0 END * 0.6 + chunks / 5 * 0.3
          + CASE WHEN user_id % 2 = 0 THEN 0.1 ELSE 0 END, 6) AS confidence FROM n""",
)
def confidence_scores(spark, folder):
    kind = F.col("event_type")
    counts = read_table(spark, folder, "events").groupBy("user_id").agg(
        F.count_if(kind == "error").alias("supporting"),
        F.count_if(kind.isin("error", "view")).alias("hits"),
        F.least(F.count_if(kind == "click"), F.lit(5)).alias("chunks"),
    )
    score = scoring.confidence(
        F.col("supporting"), F.col("hits"), F.col("chunks"), F.lit(5), F.col("user_id") % 2 == 0
    )
    return counts.select("user_id", F.round(score, 6).alias("confidence"))
