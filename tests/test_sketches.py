"""Quantile sketches per window, merged: within the stated rank error."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loglattice.streaming import jobs


def test_merged_quantiles_are_within_the_error(spark, tmp_path):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 5}", datetime(2026, 1, 1) + timedelta(seconds=i % 7200), rng.lognormvariate(0, 2)) for i in range(60_000)]
    rows += [("none", datetime(2026, 1, 1), None), ("none", datetime(2026, 1, 1), float("nan")), ("end", datetime(2026, 1, 2), 1.0)]
    spark.createDataFrame(rows, "g string, ts timestamp, v double").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    sketched = jobs.sketch_stream(stream, "ts", "v", ["g"])
    jobs.drain(sketched.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
    stored = spark.read.schema(sketched.schema).parquet(str(tmp_path / "out"))
    for q in (0.5, 0.95):
        for r in jobs.merged_quantile(stored, q, "p", ["g"]).collect():
            own = [v for g, t, v in rows if g == r.g and t.replace(minute=0, second=0) == r.window_start]
            assert r.n == len(own)
            below, upto = sum(v < r.p for v in own) / len(own), sum(v <= r.p for v in own) / len(own)
            assert below - 3 * jobs.rank_error() <= q <= upto + 3 * jobs.rank_error()
    assert stored.where("g = 'none'").count() == 0 and stored.agg(F.sum("n")).first()[0] == 60_000
