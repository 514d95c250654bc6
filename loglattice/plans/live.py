"""Streaming jobs drained over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.operators import catalog
from loglattice.operators.quality import BUCKETS
from loglattice.plans.catalogs import _CELLS
from loglattice.plans.measures import RUNS
from loglattice.plans.preparation import _INGEST_SQL, scratch
from loglattice.plans.privacy import _text_with_ids, mask_sql
from loglattice.plans.registry import query
from loglattice.plans.views import NOW_SQL, as_raw, now_column
from loglattice.operators.indexing import prepare_chunks
from loglattice.sources import connector, versions
from loglattice.sources.tables import read_table
from loglattice.streaming import jobs


def _stream(spark, folder, name):
    """A table as a stream, be it one file or a folder of part files.

    Braces make the path a pattern: a plain path of a stream has to be a folder.
    """
    schema = read_table(spark, folder, name).schema
    return jobs.read_stream(spark, f"{folder}/{{{name}.parquet}}", "*", schema)


def _drained(spark, frame, name):
    """Drain a streaming frame to parquet in the shared folder and read it back."""
    root = scratch(spark, name)
    jobs.drain(frame.writeStream.format("parquet").option("path", f"{root}/rows"), f"{root}/checkpoint")
    return spark.read.schema(frame.schema).parquet(f"{root}/rows")


@query("stream_masking", f"SELECT page_id, {mask_sql('url')} AS url, {mask_sql('html')} AS html FROM pages")
def stream_masking(spark, folder):
    return _drained(spark, jobs.mask_stream(_stream(spark, folder, "pages")), "masked")


@query(
    "stream_ingest",
    f"""{_INGEST_SQL} SELECT chunk_id, content, authority_tier FROM (SELECT chunk_id, content, tier AS authority_tier FROM chunks)""",
)
def stream_ingest(spark, folder):
    """Arriving documents become the same chunk table as the batch ingest."""
    docs = as_raw(_stream(spark, folder, "documents"), read_table(spark, folder, "labels"))
    root = scratch(spark, "ingest")
    tailed = docs.withColumn("raw_text", _text_with_ids(F.col("raw_text")))
    jobs.drain(jobs.ingest_stream(tailed, f"{root}/rows"), f"{root}/checkpoint")
    return versions.read_current(spark, f"{root}/rows", ["chunk_id"]).select(
        "chunk_id", "content", "authority_tier"
    )


def _connect(spark):
    connector.register(spark, "document_store", lambda o: connector.ParquetClient(o["path"], "doc_id"))


_CHUNK_SQL = f"{_INGEST_SQL} SELECT chunk_id, content, tier AS authority_tier FROM chunks"


def _connected_chunks(spark, folder, docs):
    raw = as_raw(docs, read_table(spark, folder, "labels"))
    return prepare_chunks(raw.withColumn("raw_text", _text_with_ids(F.col("raw_text"))))


@query("connector_batch", _CHUNK_SQL)
def connector_batch(spark, folder):
    """The documents through a connected source, read whole."""
    _connect(spark)
    docs = spark.read.format("document_store").option("path", f"{folder}/documents.parquet").load()
    return _connected_chunks(spark, folder, docs).select("chunk_id", "content", "authority_tier")


@query("connector_by_mark", _CHUNK_SQL)
def connector_by_mark(spark, folder):
    """The same source in two fetches: up to a mark, then past it by a filter."""
    _connect(spark)
    reader = spark.read.format("document_store").option("path", f"{folder}/documents.parquet")
    mark = read_table(spark, folder, "documents").agg(F.floor(F.avg("doc_id"))).first()[0]
    earlier = reader.option("upto", str(mark)).load()
    later = spark.read.format("document_store").option("path", f"{folder}/documents.parquet").load().where(F.col("doc_id") > mark)
    found = _connected_chunks(spark, folder, earlier).unionByName(_connected_chunks(spark, folder, later))
    return found.select("chunk_id", "content", "authority_tier")


@query("connector_stream", _CHUNK_SQL)
def connector_stream(spark, folder):
    """The same source as a stream, whose offset is the mark."""
    _connect(spark)
    docs = spark.readStream.format("document_store").option("path", f"{folder}/documents.parquet").load()
    tailed = as_raw(docs, read_table(spark, folder, "labels")).withColumn("raw_text", _text_with_ids(F.col("raw_text")))
    root = scratch(spark, "connected")
    jobs.drain(jobs.ingest_stream(tailed, f"{root}/rows"), f"{root}/checkpoint")
    return versions.read_current(spark, f"{root}/rows", ["chunk_id"]).select("chunk_id", "content", "authority_tier")


def _sessions_sql(gap: str) -> str:
    return f"""sessions AS (SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started,
      strftime(max(ts) + {gap}, '%Y-%m-%d %H:%M:%S') AS expires, count(*) AS n_events, max(ts) + {gap} AS ends
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
          FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < {gap} THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY user_id, s)
    SELECT user_id, started, expires, n_events FROM sessions
    WHERE ends <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""


def _shown(frame):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return frame.select("user_id", stamp("started"), stamp("expires"), "n_events")


@query("stream_bursts", f"WITH {_sessions_sql('INTERVAL 5 MINUTE')}")
def stream_bursts(spark, folder):
    """Five-minute bursts whose end the watermark has passed."""
    found = jobs.burst_stream(_stream(spark, folder, "events"), ["user_id"], "ts")
    return _shown(_drained(spark, found, "bursts"))


@query("stream_session_expiry", f"WITH {_sessions_sql('INTERVAL 7200 SECOND')}")
def stream_session_expiry(spark, folder):
    """Sessions that ended after two silent hours."""
    found = jobs.burst_stream(
        _stream(spark, folder, "events"), ["user_id"], "ts", jobs.SESSION_TTL_SECONDS
    )
    return _shown(_drained(spark, found, "expired"))


@query("stream_session_timers", f"WITH {_sessions_sql('INTERVAL 7200 SECOND')}")
def stream_session_timers(spark, folder):
    """The same sessions, ended by timers on their state."""
    found = jobs.expiry_stream(_stream(spark, folder, "events"), ["user_id"], "ts")
    return _shown(_drained(spark, found, "timers"))


@query(
    "active_sessions",
    f"""SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_activity, count(*) AS n_events
        FROM events WHERE ts <= {NOW_SQL} GROUP BY user_id HAVING epoch_us({NOW_SQL}) - epoch_us(max(ts)) < 7200000000""",
)
def active_sessions(spark, folder):
    events = read_table(spark, folder, "events").where(F.col("ts") <= now_column().cast("timestamp_ntz"))
    live = jobs.active_sessions(events, "user_id", "ts", now_column())
    return live.withColumn("last_activity", F.date_format("last_activity", "yyyy-MM-dd HH:mm:ss"))


_LE = ", ".join(
    f"count(*) FILTER (WHERE seconds <= {b}) AS le_{str(b).replace('.', '_')}" for b in BUCKETS
)


@query(
    "stream_metrics",
    f"""WITH {RUNS} SELECT strftime(time_bucket(INTERVAL 1 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests,
          CAST(sum(attempts) AS BIGINT) AS attempts, {_LE} FROM runs GROUP BY time_bucket(INTERVAL 1 MINUTE, ts)
        HAVING time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def stream_metrics(spark, folder):
    """Request counts, attempts and latency buckets per closed minute."""
    runs = _stream(spark, folder, "events").select(
        "ts", (F.col("value") / 20).alias("seconds"), (F.col("user_id") % 4).alias("attempts")
    )
    found = _drained(spark, jobs.metric_stream(runs, "ts", "seconds"), "metrics")
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "stream_p95",
    f"""WITH {RUNS}, closed AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS w, seconds FROM runs
          WHERE time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events))
        SELECT strftime(time_bucket(INTERVAL 1 HOUR, w), '%Y-%m-%d %H:%M:%S') AS window_start, count(seconds) AS n, TRUE AS within
        FROM closed WHERE seconds IS NOT NULL GROUP BY time_bucket(INTERVAL 1 HOUR, w)""",
)
def stream_p95(spark, folder):
    """P95 per hour from the sketches of closed minutes, held against the exact rank of its value."""
    seconds = (F.col("value") / 20).alias("seconds")
    runs = _stream(spark, folder, "events").select("ts", seconds)
    sketches = _drained(spark, jobs.sketch_stream(runs, "ts", "seconds"), "sketches")
    found = jobs.merged_quantile(sketches, 0.95, "p95")
    minutes = sketches.select(F.col("window_start").alias("minute"))
    exact = read_table(spark, folder, "events").select(F.date_trunc("minute", "ts").cast("timestamp").alias("minute"), seconds).join(minutes, "minute")
    ranked = found.join(exact, F.date_trunc("hour", "minute") == F.col("window_start")).groupBy("window_start", "n").agg(
        F.avg((F.col("seconds") <= F.col("p95")).cast("double")).alias("upto"), F.avg((F.col("seconds") < F.col("p95")).cast("double")).alias("below")
    )
    slack = 3 * jobs.rank_error()
    within = (F.col("upto") >= 0.95 - slack) & (F.col("below") <= 0.95 + slack)
    return ranked.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", within.alias("within"))


@query(
    "stream_catalog_refresh",
    f"""SELECT field, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank
          FROM (SELECT field, value, count(*) AS n FROM ({_CELLS}) WHERE value IS NOT NULL GROUP BY field, value)) WHERE rank <= 5""",
)
def stream_catalog_refresh(spark, folder):
    """Each trigger rebuilds the sample-value catalog; readers take the newest version."""
    root = scratch(spark, "catalog")
    writer = jobs.refresh_stream(
        _stream(spark, folder, "labels"),
        lambda session: catalog.sample_values(read_table(session, folder, "customer")),
        f"{root}/rows",
    )
    jobs.drain(writer, f"{root}/checkpoint")
    return jobs.newest_version(spark, f"{root}/rows")


@query(
    "stream_catalog_join",
    """WITH old AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey),
    new AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey)
    SELECT 'customer' AS part, c_custkey AS id, n FROM customer LEFT JOIN old ON k = c_nationkey
    UNION ALL SELECT 'supplier', s_suppkey, n FROM supplier LEFT JOIN new ON k = s_nationkey""",
)
def stream_catalog_join(spark, folder):
    """Rows before a refresh meet the first catalog, rows after it the second."""
    root = scratch(spark, "catalog-join")
    customers = read_table(spark, folder, "customer")
    parts = []
    for version, (name, key, nation) in enumerate([("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey")]):
        known = customers.where("c_acctbal > 0") if version == 0 else customers
        versions.upsert(known.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n")), f"{root}/catalog", version)
        rows = _stream(spark, folder, name).select(F.lit(name).alias("part"), F.col(key).alias("id"), F.col(nation).alias("k"))
        jobs.drain(jobs.lookup_stream(rows, f"{root}/catalog", ["k"], f"{root}/{name}"), f"{root}/{name}-checkpoint")
        parts.append(spark.read.parquet(f"{root}/{name}").select("part", "id", "n"))
    return parts[0].unionByName(parts[1])
