"""The keyed memory table: saves, fetches, prefixes, removal, listing, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.operators import keyed
from loglattice.plans.registry import query
from loglattice.sources.tables import read_table

# Orders as saves: one key per (priority, customer), the latest order wins.
SAVES = """saves AS (SELECT 'session_' || left(o_orderpriority, 1) || '/' || o_custkey AS key,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'total ' || CAST(round(o_totalprice) AS BIGINT) END AS value,
    o_orderdate AS saved_at, o_orderkey AS seq FROM orders),
memories AS (SELECT * FROM saves QUALIFY row_number() OVER (PARTITION BY key ORDER BY saved_at DESC, seq DESC) = 1),
wanted AS (SELECT c_nationkey AS request_id, 'session_' || (c_custkey % 5 + 1) || '/' || c_custkey AS key,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ask FROM customer)"""


def _saves(spark, folder):
    return read_table(spark, folder, "orders").select(
        F.concat(F.lit("session_"), F.left("o_orderpriority", F.lit(1)), F.lit("/"), F.col("o_custkey")).alias("key"),
        F.when(F.col("o_orderkey") % 11 == 0, "")
        .otherwise(F.concat(F.lit("total "), F.round("o_totalprice").cast("bigint")))
        .alias("value"),
        F.col("o_orderdate").alias("saved_at"),
        F.col("o_orderkey").alias("seq"),
    )


def _memories(spark, folder):
    return keyed.save(_saves(spark, folder))


def _wanted(spark, folder):
    return read_table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("request_id"),
        F.concat(F.lit("session_"), F.col("c_custkey") % 5 + 1, F.lit("/"), F.col("c_custkey")).alias("key"),
        F.col("c_custkey").alias("ask"),
    )


@query("save_latest", f"WITH {SAVES} SELECT key, value, strftime(saved_at, '%Y-%m-%d') AS saved_at FROM memories")
def save_latest(spark, folder):
    return _memories(spark, folder).select("key", "value", F.date_format("saved_at", "yyyy-MM-dd").alias("saved_at"))


@query(
    "fetch_one",
    f"WITH {SAVES} SELECT w.key, coalesce(m.value, '') AS value FROM wanted w LEFT JOIN memories m USING (key)",
)
def fetch_one(spark, folder):
    return keyed.fetch_one(_memories(spark, folder), _wanted(spark, folder)).select("key", "value")


@query(
    "fetch_many",
    f"""WITH {SAVES} SELECT request_id, key, value FROM wanted JOIN memories USING (key) WHERE value <> ''""",
)
def fetch_many(spark, folder):
    return keyed.fetch_many(_memories(spark, folder), _wanted(spark, folder)).select(
        "request_id", "key", "value"
    )


@query(
    "fetch_prefix",
    f"WITH {SAVES} SELECT key, value FROM memories WHERE starts_with(key, 'session_2/1')",
)
def fetch_prefix(spark, folder):
    """A literal prefix: the underscore matches only itself."""
    return keyed.fetch_prefix(_memories(spark, folder), "session_2/1").select("key", "value")


_DOOMED = """doomed AS (SELECT 'session_' || (c_custkey % 5 + 1) || '/' || c_custkey AS key FROM customer
    WHERE c_custkey % 2 = 0)"""


def _doomed(spark, folder):
    return _wanted(spark, folder).where(F.col("ask") % 2 == 0).select("key")


@query(
    "remove_keys",
    f"""WITH {SAVES}, {_DOOMED} SELECT key, value FROM memories WHERE key NOT IN (SELECT key FROM doomed)""",
)
def remove_keys(spark, folder):
    remaining, _ = keyed.remove(_memories(spark, folder), _doomed(spark, folder))
    return remaining.select("key", "value")


@query(
    "remove_report",
    f"WITH {SAVES}, {_DOOMED} SELECT key, key IN (SELECT key FROM memories) AS found FROM doomed",
)
def remove_report(spark, folder):
    """Per requested key, whether it existed."""
    _, report = keyed.remove(_memories(spark, folder), _doomed(spark, folder))
    return report


@query("list_keys", f"WITH {SAVES} SELECT key, strftime(saved_at, '%Y-%m-%d') AS saved_at FROM memories ORDER BY memories.saved_at, key")
def list_keys(spark, folder):
    listed = keyed.list_keys(_memories(spark, folder))
    return listed.select("key", F.date_format("saved_at", "yyyy-MM-dd").alias("saved_at"))


@query(
    "render_memories",
    f"""WITH {SAVES}, found AS (SELECT request_id, key, value, row_number() OVER (PARTITION BY request_id ORDER BY ask) AS pos
          FROM wanted JOIN memories USING (key) WHERE value <> '')
        SELECT request_id, (pos - 1) // 1000 AS part, CASE WHEN pos <= 1000 THEN '<memories>' || chr(10) ELSE '' END
          || body || CASE WHEN last THEN '</memories>' ELSE '' END AS xml
        FROM (SELECT request_id, max(pos) AS pos, max(pos) = max(max(pos)) OVER (PARTITION BY request_id) AS last,
            string_agg('  <memory key="' || key || '">' || value || '</memory>' || chr(10), '' ORDER BY pos) AS body
          FROM found GROUP BY request_id, (pos - 1) // 1000)""",
)
def render_memories(spark, folder):
    """One text block per request, elements in the order asked for."""
    found = keyed.fetch_many(_memories(spark, folder), _wanted(spark, folder))
    return keyed.render_xml(keyed.number(found, "request_id", "ask"), "request_id")
