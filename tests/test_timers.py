"""Sessions ended by timers, and rows joined with the catalog of their time."""

import random
import time
from datetime import datetime, timedelta

import pytest
from helpers import values
from pyspark.sql import functions as F

from loglattice.sources import versions
from loglattice.streaming import jobs

T0 = datetime(2026, 1, 1)
SCHEMA = "user string, at timestamp, other int"


def sessions(events, gap):
    out, by_user = [], {}
    for user, at in sorted(events, key=lambda e: (str(e[0]), e[1])):
        own = by_user.setdefault(user, [])
        if own and at - own[-1][1] < gap:
            own[-1][1], own[-1][2] = at, own[-1][2] + 1
        else:
            own.append([at, at, 1])
    for user, own in by_user.items():
        out += [(user, a, b + gap, n) for a, b, n in own]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_timers_end_sessions_like_the_batch(spark, tmp_path, seed):
    """Rows out of order over several triggers, a hot user, bridges between open sessions."""
    rng = random.Random(seed)
    events = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), T0 + timedelta(minutes=rng.randint(0, 3000))) for _ in range(500)]
    events.sort(key=lambda e: e[1] + timedelta(minutes=rng.randint(0, 100)))  # up to 100 minutes late
    closing = ("end", T0 + timedelta(days=30))
    for i, part in enumerate([events[:200], events[200:350], events[350:], [closing]]):
        spark.createDataFrame([(u, t, 1) for u, t in part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        found = jobs.expiry_stream(stream, ["user"], "at", 7200, late="3 hours")
        jobs.drain(found.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sessions(events, timedelta(hours=2))


def test_many_sessions_of_one_user_end_at_once(spark, tmp_path):
    """The work of a trigger follows its sessions; one timer each took time with their square."""
    rows = [("a", T0 + timedelta(hours=3 * i), 1) for i in range(4000)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = jobs.expiry_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["user"], "at", 7200)
    began = time.time()
    jobs.drain(found.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
    assert time.time() - began < 60
    assert values(spark.read.parquet(str(tmp_path / "out")), "user", "started", "n_events") == [("a", r[1], 1) for r in rows[:-1]]


def test_rows_without_a_user_leave_the_other_users_alone(spark, tmp_path):
    events = [(None if i % 3 == 0 else i % 7, T0 + timedelta(minutes=50 * i)) for i in range(300)]
    closing = (99, T0 + timedelta(days=30))
    rows = spark.createDataFrame([*events, closing], "user bigint, at timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = jobs.expiry_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["user"], "at", 7200)
    jobs.drain(found.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sessions(events, timedelta(hours=2))


def test_a_quiet_stream_still_ends_its_sessions(spark, tmp_path):
    rows = [("a", T0, 1), ("a", T0 + timedelta(seconds=1), 1), ("b", T0, 1)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    found = jobs.expiry_stream(stream, ["user"], "at", 3, by_clock=True)
    writer = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    running = writer.trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until:  # nothing more arrives
            time.sleep(1)
            try:
                if spark.read.parquet(str(tmp_path / "out")).count() == 2:
                    break
            except Exception:  # no file yet
                pass
    finally:
        running.stop()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [("a", T0, T0 + timedelta(seconds=4), 2), ("b", T0, T0 + timedelta(seconds=3), 1)]


def test_lookup_takes_the_newest_committed_version(spark, tmp_path):
    root, out = str(tmp_path / "catalog"), str(tmp_path / "out")
    catalog = lambda word: spark.createDataFrame([("k1", word)], "k string, sample string")

    def arrive(key):
        spark.createDataFrame([(key,)], "k string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema("k string").parquet(str(tmp_path / "in"))
        jobs.drain(jobs.lookup_stream(rows, root, ["k"], out), str(tmp_path / "cp"))
        return values(spark.read.parquet(out), "version", "k", "sample")

    versions.upsert(catalog("old"), root, 9)
    assert arrive("k1") == [(0, "k1", "old")]
    versions.upsert(catalog("new"), root, 10)
    assert arrive("k1") == [(0, "k1", "old"), (1, "k1", "new")]
    with pytest.raises(Exception, match="no such"):  # a refresh that fails while it writes
        versions.upsert(catalog("bad").withColumn("sample", F.raise_error(F.lit("no such value"))), root, 11)
    assert arrive("k2") == [(0, "k1", "old"), (1, "k1", "new"), (2, "k2", None)]
    assert arrive("k1")[-1] == (3, "k1", "new")
