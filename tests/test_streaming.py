"""Streams against batches: results don't depend on how the events are cut."""

import uuid
from collections import Counter

from pyspark.sql import functions as F

from nomena.streaming import events

SF = "/root/testdata/sf0.001"


def parts(spark, tmp_path, n):
    """The events in n files, in order of id; the stream reads them by their times."""
    import os

    d = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values("event_id")
    (tmp_path / "in").mkdir()
    for i in range(n):
        f = tmp_path / "in" / f"{i}.parquet"
        d.iloc[i * len(d) // n : (i + 1) * len(d) // n].to_parquet(f, coerce_timestamps="us")
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(tmp_path / "in"), d


def test_occurrences_over_batches(spark, tmp_path):
    path, d = parts(spark, tmp_path, 4)
    name = uuid.uuid4().hex
    stream = events.occurrences(events.read_events(spark, path), ["event_type"], "event_id")
    got = {r["event_id"]: r["occ"] for r in events.collected(stream, name).collect()}
    seen, want = Counter(), {}
    for i, t in zip(d["event_id"], d["event_type"], strict=True):
        want[i] = seen[t]
        seen[t] += 1
    assert got == want
    again = events.occurrences(events.read_events(spark, path), ["event_type"], "event_id")
    assert events.collected(again, name).count() == len(want)  # nothing new: nothing is added


def test_votes_by_windows(spark, tmp_path):
    path, d = parts(spark, tmp_path, 3)
    got = {(r["start"], r["event_type"]): r["n"] for r in events.collected(events.votes(events.read_events(spark, path), "event_type", length="1 day", late="3650 days"), uuid.uuid4().hex).collect()}
    assert got == {}  # no window is past the watermark
    closed = events.collected(events.votes(events.read_events(spark, path, files_at_once=100), "event_type", length="1 hour", late="0 seconds"), uuid.uuid4().hex)
    batch = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")
    last = spark.read.parquet(path).agg(F.max("ts")).first()[0]
    want = {tuple(r) for r in batch.filter(F.col("end") <= F.lit(last)).select("start", "event_type", "n").collect()}
    assert {tuple(r) for r in closed.collect()} == want and want
