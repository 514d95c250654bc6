"""Streaming forms of ingest, masking, bursts, expiry, metrics and catalog refresh."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from loglattice.functions.masking import mask_rows
from loglattice.operators.indexing import prepare_chunks
from loglattice.operators.quality import BUCKETS
from loglattice.operators.scale import small_side
from loglattice.sources import versions

LOG = logging.getLogger(__name__)
SESSION_TTL_SECONDS, BURST_SECONDS = 7200, 300  # fixed values
SKETCH_K = 4096  # 0.13 % rank error, some 30 KB at most


def read_stream(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """Parquet files of ``folder`` matching ``pattern``, as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def drain(writer, checkpoint: str) -> StreamingQuery:
    """Run a stream over everything available now and stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def mask_stream(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Stateless masking: the batch operator works on a stream unchanged."""
    return mask_rows(rows, keep)


def ingest_stream(docs: DataFrame, root: str):
    """Writer turning arriving documents into chunk versions.

    The batch number is the version, so a replayed batch replaces its own rows; the
    stream's checkpoint takes the place of a high-water mark.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        versions.upsert(prepare_chunks(batch), root, batch_id)

    return docs.writeStream.foreachBatch(store)


def burst_stream(
    events: DataFrame, group: Sequence[str], ts: str, gap_seconds: int = BURST_SECONDS,
    late: str = "10 minutes",
) -> DataFrame:
    """Gap-separated sessions, emitted once the watermark has passed their end.

    With the two-hour gap this is session expiry: activity extends a session, silence
    ends it.  Sessions merge inside each input partition before the shuffle, so a hot
    key moves few rows.
    """
    events.sparkSession.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    window = F.session_window("_t", f"{gap_seconds} seconds")
    return (
        timed.groupBy(*group, window.alias("_w"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(*group, F.col("_w.start").alias("started"), F.col("_w.end").alias("expires"), "n_events")
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _merged(spans: pd.DataFrame, group: Sequence[str], gap: pd.Timedelta) -> pd.DataFrame:
    """Spans (group, first, last, n) with those less than the gap apart made one."""
    spans = spans.sort_values([*group, "first", "last"], kind="stable").reset_index(drop=True)
    same = pd.Series(len(spans) * [True])
    for column in group:
        values = spans[column]
        same &= (values == values.shift()) | (values.isna() & values.shift().isna())
    block = (~same).cumsum()
    reached = spans.groupby(block)["last"].cummax().groupby(block).shift()
    start = reached.isna() | (spans["first"] - reached >= gap)
    found = spans.assign(_s=start.cumsum()).groupby("_s", sort=True)
    return found.agg({**{c: "first" for c in group}, "first": "min", "last": "max", "n": "sum"}).reset_index(drop=True)


def expiry_stream(
    events: DataFrame, group: Sequence[str], ts: str, ttl_seconds: int = SESSION_TTL_SECONDS,
    late: str = "10 minutes", by_clock: bool = False,
) -> DataFrame:
    """Sessions that ended after ``ttl_seconds`` of silence, by state and timers.

    Open sessions are state; each sets a timer for its end, so it ends although nothing more
    arrives for its group.  By event time the timer fires once the watermark has passed the end.
    With ``by_clock`` it fires that many seconds after the last arrival, also in a stream that has
    gone quiet as a whole.  Late rows that bridge two open sessions join them.

    Rows collapse to spans in every task before the shuffle, so a hot group moves few rows.  A group
    has one timer, for its next end; when it fires, all ends that have passed are given out at once.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    gap = pd.Timedelta(seconds=ttl_seconds)
    gap_us = ttl_seconds * 1_000_000
    named = events.select(*group, F.col(ts).cast("timestamp").alias("first")).where("first IS NOT NULL")
    kinds = [f"`{c}` {named.schema[c].dataType.simpleString()}" for c in group]

    def collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield _merged(rows.assign(last=rows["first"], n=1), group, gap)

    ended_row = Row(*group, "started", "expires", "n_events")

    class Sessions(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.open = handle.getValueState("open", "spans binary")  # int64: first, last, n, due of each

        def _held(self) -> list[tuple[int, ...]]:
            spans = self.open.get()
            return [] if spans is None else [tuple(x) for x in np.frombuffer(spans[0], np.int64).reshape(-1, 4).tolist()]

        def _hold(self, spans: list[tuple[int, ...]]) -> None:
            self.open.update((np.array(spans, np.int64).tobytes(),))

        def _due(self, last: int, now_ms: int) -> int:
            return now_ms + ttl_seconds * 1000 if by_clock else -(-last // 1000) + ttl_seconds * 1000

        def handleInputRows(self, key, rows, timerValues):
            held = self._held()
            spans = sorted([x[:3] for x in held] + [(r["first_us"], r["last_us"], r["n"]) for r in rows])
            kept = []
            for first, last, n in spans:
                if kept and first - kept[-1][1] < gap_us:
                    kept[-1] = (kept[-1][0], max(kept[-1][1], last), kept[-1][2] + n)
                else:
                    kept.append((first, last, n))
            now = timerValues.getCurrentProcessingTimeInMs()
            listed = [(*x, self._due(x[1], now)) for x in kept]
            self._hold(listed)
            self._wait(min(x[3] for x in listed), min((x[3] for x in held), default=None))
            return iter([])

        def _wait(self, due: int, before: int | None) -> None:
            """The group's one timer."""
            if before is not None and before != due:
                self.handle.deleteTimer(before)
            if before != due:
                self.handle.registerTimer(due)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            fired = expiredTimerInfo.getExpiryTimeInMs()
            passed = timerValues.getCurrentProcessingTimeInMs() if by_clock else timerValues.getCurrentWatermarkInMs()
            held = self._held()
            over = [x for x in held if x[3] <= max(fired, passed)]
            left = [x for x in held if x[3] > max(fired, passed)]
            if left:
                self._hold(left)
                self.handle.registerTimer(min(x[3] for x in left))
            else:
                self.open.clear()
            for first, last, n, _ in over:
                yield ended_row(*key, first, last + gap_us, n)

        def close(self) -> None:
            pass

    spans = named.mapInPandas(collapse, ", ".join([*kinds, "first timestamp", "last timestamp", "n bigint"]))
    micros = [F.unix_micros(c).alias(f"{c}_us") for c in ("first", "last")]
    timed = spans if by_clock else spans.withWatermark("first", late)
    ended = timed.select("first", *group, *micros, "n").groupBy(*group).transformWithState(
        Sessions(), ", ".join([*kinds, "started bigint", "expires bigint", "n_events bigint"]),
        "Append", "ProcessingTime" if by_clock else "EventTime",
    )
    moment = lambda c: F.timestamp_micros(c).alias(c)
    return ended.select(*group, moment("started"), moment("expires"), "n_events")


def active_sessions(events: DataFrame, key: str, ts: str, now, ttl_seconds: int = SESSION_TTL_SECONDS) -> DataFrame:
    """Sessions whose last activity is younger than the time to live (batch form)."""
    last = events.groupBy(key).agg(F.max(ts).alias("last_activity"), F.count(F.lit(1)).alias("n_events"))
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_activity").cast("timestamp"))
    return last.where(idle < ttl_seconds * 1_000_000)


def metric_stream(runs: DataFrame, ts: str, seconds: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests, attempts and cumulative latency buckets per time window."""
    timed = runs.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    s = F.col(seconds)
    buckets = [F.count(F.when(s <= b, 1)).alias(f"le_{str(b).replace('.', '_')}") for b in BUCKETS]
    counted = timed.groupBy(F.window("_t", width).alias("_w")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("attempts").alias("attempts"), *buckets
    )
    return counted.select(F.col("_w.start").alias("window_start"), *counted.columns[1:])


def rank_error(k: int = SKETCH_K) -> float:
    """Largest distance between the asked and the true rank of a sketch's quantile, as a share of
    all values, in 99 of 100 cases (the published bound of KLL sketches); merging keeps it."""
    return 2.296 / k**0.9021


def sketch_stream(runs: DataFrame, ts: str, value: str, group: Sequence[str] = (), width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Per closed window and group the number of values and a quantile sketch of them.

    Tasks sketch what they read and only sketches are shuffled, so a hot group costs no more.
    """
    timed = runs.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    v = F.col(value).cast("double")
    counted = timed.where(v.isNotNull() & ~F.isnan(v)).groupBy(*group, F.window("_t", width).alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, SKETCH_K).alias("sketch")
    )
    return counted.select(*group, F.col("_w.start").alias("window_start"), "n", "sketch")


def merged_quantile(sketches: DataFrame, q: float, out: str, group: Sequence[str] = (), width: str = "1 hour") -> DataFrame:
    """A quantile over longer windows, from the stored sketches alone: within ``rank_error``."""
    merged = sketches.groupBy(*group, F.window("window_start", width).alias("_w")).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    quantile = F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    return merged.select(*group, F.col("_w.start").alias("window_start"), "n", quantile.alias(out))


def refresh_stream(ticks: DataFrame, build: Callable[[SparkSession], DataFrame], root: str):
    """Writer rebuilding a catalog once per trigger; a failed rebuild keeps the old version."""

    def rebuild(batch: DataFrame, batch_id: int) -> None:
        try:
            versions.upsert(build(batch.sparkSession), root, batch_id)
        except Exception as error:  # the previous version stays readable
            LOG.warning("catalog refresh failed: %s", error)

    return ticks.writeStream.foreachBatch(rebuild)


def newest_version(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the highest committed version only; its number is read off the file names."""
    rows = spark.read.parquet(root)
    found = (re.search(r"/version=(\d+)/", f) for f in rows.inputFiles())
    newest = max((int(m[1]) for m in found if m), default=-1)
    return rows.where(F.col("version") == newest).drop("version")


def lookup_stream(rows: DataFrame, root: str, keys: Sequence[str], out: str):
    """Writer joining every trigger's rows with the catalog version that is newest then.

    A stream-static join reads files listed when it starts; here each trigger lists them anew, so
    rows that arrive after a refresh meet the new version, and a failed refresh leaves the old
    one in use.  A row without a match stays, with nulls.  Replayed triggers replace their rows.
    """

    def join(batch: DataFrame, batch_id: int) -> None:
        catalog = newest_version(batch.sparkSession, root)
        versions.upsert(batch.join(small_side(catalog), list(keys), "left"), out, batch_id)

    return rows.writeStream.foreachBatch(join)
