"""Conversations and evidence under token budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.functions import metadata as meta
from loglattice.functions import text as tx
from loglattice.operators import context as ctx
from loglattice.operators.scale import latest_wins
from loglattice.plans.registry import query
from loglattice.plans.views import DOCS, LOGS, logs, messages, raw_documents
from loglattice.sources.tables import read_table

LAST = """lastn AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations)"""


def _position(rank: str, group: str) -> str:
    return f"""CASE WHEN ({rank} - 1) % 2 = 0 THEN ({rank} - 1) // 2
        ELSE count(*) OVER (PARTITION BY {group}) - 1 - ({rank} - 1) // 2 END"""


@query(
    "last_messages",
    f"WITH {LAST} SELECT conv_id, turn, role, rank FROM lastn WHERE rank <= 20",
)
def last_messages(spark, folder):
    return ctx.last_messages(messages(spark, folder)).select("conv_id", "turn", "role", "rank")


@query("last_five_messages", f"WITH {LAST} SELECT conv_id, turn, role, rank FROM lastn WHERE rank <= 5")
def last_five_messages(spark, folder):
    return ctx.last_messages(messages(spark, folder), 5).select("conv_id", "turn", "role", "rank")


@query(
    "session_context",
    f"""WITH {LAST}, cut AS (SELECT * FROM lastn WHERE rank <= 20)
        SELECT conv_id, turn, {_position("rank", "conv_id")} AS position FROM cut""",
)
def session_context(spark, folder):
    """Last messages with the newest at both edges and the oldest in the middle."""
    kept = ctx.last_messages(messages(spark, folder))
    return ctx.reorder(kept, ["conv_id"]).select("conv_id", "turn", "position")


_BUDGET = """summed AS (SELECT conv_id, turn, length(text) // 4 AS tokens,
    sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations)"""


@query(
    "budget_cut",
    f"WITH {_BUDGET} SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM summed WHERE used <= 150",
)
def budget_cut(spark, folder):
    """Messages in order until the token budget would be passed."""
    kept = ctx.within_budget(
        messages(spark, folder), ["conv_id"], F.floor(F.col("turn") / ctx.TURNS_PER_SEGMENT),
        [F.asc("turn")], tx.token_estimate(F.col("text")), 150,
    )
    return kept.select("conv_id", "turn", "used")


_EVIDENCE = f"""{LOGS}, lines AS (SELECT event_id, service, ts, message,
    length(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || service || ' ' || level || ' ' || message) // 4 AS tokens FROM logs),
cut AS (SELECT *, sum(tokens) OVER (PARTITION BY service ORDER BY ts, event_id) AS used FROM lines)"""


def _evidence_cut(spark, folder, budget):
    line = F.concat_ws(
        " ", F.date_format("`@timestamp`", "yyyy-MM-dd HH:mm:ss"), "`service.name`", "`log.level`", "message"
    )
    hits = logs(spark, folder).select(
        "event_id", F.col("`service.name`").alias("service"), F.col("`@timestamp`").alias("ts"),
        tx.token_estimate(line).alias("tokens"),
    )
    return ctx.within_budget(
        hits, ["service"], F.to_date("ts"), [F.asc("ts"), F.asc("event_id")], F.col("tokens"), budget
    )


@query(
    "evidence_context",
    f"""WITH {_EVIDENCE}, kept AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts, event_id) AS rank
          FROM cut WHERE used <= 400)
        SELECT service, event_id, {_position("rank", "service")} AS position FROM kept""",
)
def evidence_context(spark, folder):
    """Log hits per service cut to a budget, then the best moved to both edges."""
    from pyspark.sql import Window

    kept = _evidence_cut(spark, folder, 400)
    order = Window.partitionBy("service").orderBy("ts", "event_id")
    ranked = kept.withColumn("rank", F.row_number().over(order))  # at most one row per budget token
    return ctx.reorder(ranked, ["service"]).select("service", "event_id", "position")


@query(
    "repeated_messages",
    """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (
         PARTITION BY event_type, props ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
)
def repeated_messages(spark, folder):
    """First of every repeated message within a group."""
    events = read_table(spark, folder, "events")
    return latest_wins(events, ["event_type", "props"], [F.asc("ts"), F.asc("event_id")]).select(
        "event_type", "event_id"
    )


_TIERED = f"""{DOCS}, evidence AS (
  SELECT doc_id % 50 AS query_id, 'chunk' AS kind, doc_id AS item_id, tier, created_at AS ts, NULL AS message,
         doc_id // 50 AS rank, length(text) // 4 % 900 AS tokens FROM tiered
  UNION ALL
  SELECT user_id % 50, 'log', event_id, NULL, date_trunc('second', ts), props, 0, length(props) * 2 FROM events),
waves AS (SELECT *, CASE WHEN kind = 'chunk' AND tier = 'B' THEN 1
    WHEN kind = 'log' AND row_number() OVER (PARTITION BY query_id, kind, message ORDER BY ts, item_id) > 1 THEN 2
    WHEN kind = 'chunk' AND row_number() OVER (PARTITION BY query_id, kind, tier ORDER BY rank, item_id) > 3 THEN 3
    ELSE 4 END AS wave FROM evidence),
kept AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY wave DESC, ts DESC, kind, item_id) AS used FROM waves)"""


@query(
    "tiered_pruning",
    f"""WITH {_TIERED} SELECT query_id, kind, item_id, wave, CAST(used AS BIGINT) AS used FROM kept
        WHERE used <= 6000 OR wave = 4""",
)
def tiered_pruning(spark, folder):
    """Weak chunks, repeated logs, then surplus strong chunks leave until the rest fits."""
    from loglattice.operators.indexing import enrich

    docs = enrich(raw_documents(spark, folder)).select(
        (F.col("doc_id") % 50).alias("query_id"),
        F.lit("chunk").alias("kind"),
        F.col("doc_id").alias("item_id"),
        F.col("authority_tier").alias("tier"),
        F.col("created_at").alias("ts"),
        F.lit(None).cast("string").alias("message"),
        F.floor(F.col("doc_id") / 50).alias("rank"),
        (tx.token_estimate(F.col("raw_text")) % 900).alias("tokens"),
    )
    hits = read_table(spark, folder, "events").select(
        (F.col("user_id") % 50).alias("query_id"),
        F.lit("log").alias("kind"),
        F.col("event_id").alias("item_id"),
        F.lit(None).cast("string").alias("tier"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"),
        F.col("props").alias("message"),
        F.lit(0).cast("bigint").alias("rank"),
        (F.length("props") * 2).cast("bigint").alias("tokens"),
    )
    return ctx.prune_tiered(docs.unionByName(hits), 6000).select(
        "query_id", "kind", "item_id", "wave", "used"
    )


BURSTS_SQL = """SELECT user_id, burst, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS burst_start,
    strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event, count(*) AS n_events
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst
        FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 5 MINUTE
                THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, burst"""


@query("bursts", BURSTS_SQL)
def bursts(spark, folder):
    """Five-minute bursts per user."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return ctx.bursts(read_table(spark, folder, "events"), ["user_id"], "ts").select(
        "user_id", "burst", stamp("burst_start"), stamp("last_event"), "n_events"
    )


@query(
    "region_totals",
    """WITH r AS (SELECT conv_id, CASE role WHEN 'system' THEN 'memory' WHEN 'user' THEN 'conversation'
            WHEN 'assistant' THEN CASE WHEN turn % 4 = 1 THEN 'fetched' ELSE 'output' END END AS region,
          length(text) // 4 AS t FROM conversations),
        s AS (SELECT conv_id, CAST(coalesce(sum(t) FILTER (WHERE region = 'memory'), 0) AS BIGINT) AS t_memory,
          CAST(coalesce(sum(t) FILTER (WHERE region = 'fetched'), 0) AS BIGINT) AS t_fetched,
          CAST(coalesce(sum(t) FILTER (WHERE region = 'conversation'), 0) AS BIGINT) AS t_conversation,
          CAST(coalesce(sum(t) FILTER (WHERE region = 'output'), 0) AS BIGINT) AS t_output FROM r GROUP BY conv_id)
        SELECT *, t_memory + t_fetched + t_conversation + t_output AS total,
          4000 - (t_memory + t_fetched + t_conversation + t_output) AS remaining FROM s""",
)
def region_totals(spark, folder):
    region = (
        F.when(F.col("role") == "system", "memory")
        .when(F.col("role") == "user", "conversation")
        .when(F.col("turn") % 4 == 1, "fetched")
        .otherwise("output")
    )
    return ctx.region_totals(messages(spark, folder).withColumn("region", region), ["conv_id"], 4000)


@query(
    "token_truncation",
    """SELECT conv_id, turn, length(text) // 4 AS tokens,
         CASE WHEN turn * 7 - 3 <= 0 THEN '' ELSE left(text, CAST((turn * 7 - 3) * 4 + 3 AS BIGINT)) END AS head,
         CASE WHEN turn * 7 - 3 <= 0 THEN '' ELSE right(text, CAST((turn * 7 - 3) * 4 + 3 AS BIGINT)) END AS tail
       FROM conversations""",
)
def token_truncation(spark, folder):
    """Longest prefix and suffix fitting a budget."""
    budget, text = F.col("turn") * 7 - 3, F.col("text")
    return messages(spark, folder).select(
        "conv_id",
        "turn",
        tx.token_estimate(text).alias("tokens"),
        tx.truncate_back(text, budget).alias("head"),
        tx.truncate_front(text, budget).alias("tail"),
    )


_REGIONS = """said AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS conversation FROM conversations GROUP BY conv_id),
firsts AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS memory,
    max(CASE WHEN turn = 1 THEN text END) AS fetched FROM conversations GROUP BY conv_id),
parts AS (SELECT conv_id, coalesce(memory, '') AS memory, coalesce(fetched, '') AS fetched, conversation,
    'answer:' AS output, conv_id % 200 * 5 AS budget FROM firsts JOIN said USING (conv_id)),
room AS (SELECT *, budget - length(memory) // 4 - length(output) // 4 AS room FROM parts),
f AS (SELECT *, CASE WHEN length(fetched) // 4 > room THEN
    CASE WHEN floor(room / 2) <= 0 THEN '' ELSE left(fetched, CAST(floor(room / 2) * 4 + 3 AS BIGINT)) END ELSE fetched END AS cut FROM room),
c AS (SELECT *, room - length(cut) // 4 AS rest FROM f),
v AS (SELECT *, CASE WHEN length(conversation) // 4 > rest THEN
    CASE WHEN rest <= 0 THEN '' ELSE right(conversation, CAST(rest * 4 + 3 AS BIGINT)) END ELSE conversation END AS convo FROM c)"""


@query(
    "assembled_context",
    f"""WITH {_REGIONS} SELECT conv_id, CASE WHEN budget > 0 AND room >= 0 THEN
          CASE WHEN memory <> '' THEN memory || chr(10) ELSE '' END || CASE WHEN cut <> '' THEN cut || chr(10) ELSE '' END
          || CASE WHEN convo <> '' THEN convo || chr(10) ELSE '' END || output END AS context,
          CASE WHEN budget <= 0 THEN 'budget is not positive'
               WHEN room < 0 THEN 'budget exceeded by required regions' END AS error FROM v""",
)
def assembled_context(spark, folder):
    """Memory, fetched text, conversation and output fitted into one budget per conversation."""
    said, budget = messages(spark, folder), F.col("conv_id") % 200 * 5
    tail = ctx.conversation_tail(said, budget)
    firsts = said.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("memory"),
        F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("fetched"),
    )
    rows = firsts.join(tail, "conv_id").withColumn("output", F.lit("answer:"))
    return ctx.assemble(rows, budget).select("conv_id", "context", "error")


@query(
    "context_sufficiency",
    """SELECT c_custkey, NOT (c_mktsegment IN ('BUILDING', 'MACHINERY') AND n = 0) AS sufficient,
         NOT (c_mktsegment IN ('BUILDING', 'MACHINERY') AND n = 0) AND NOT (c_nationkey % 2 = 0 AND n < 5)
           AND NOT (c_acctbal < 0 AND n = 0) AS strictly_sufficient
       FROM (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, count(o_orderkey) AS n
             FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)""",
)
def context_sufficiency(spark, folder):
    """Evidence counts against what each question needs."""
    counts = read_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n")
    )
    asked = read_table(spark, folder, "customer").join(counts, "c_custkey", "left")
    needs_logs = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    n = F.coalesce(F.col("n"), F.lit(0))
    failed = (F.col("c_acctbal") < 0) & (n == 0)
    return asked.select(
        "c_custkey",
        meta.context_sufficient(needs_logs, F.col("n")).alias("sufficient"),
        meta.context_sufficient(
            needs_logs, F.col("n"), F.col("c_nationkey") % 2 == 0, F.floor(n / 5), failed, failed
        ).alias("strictly_sufficient"),
    )
