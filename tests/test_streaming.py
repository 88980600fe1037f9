"""Streams against the same work done on the whole table."""

import shutil
import time

from pyspark.sql import functions as F

from skeinwork.sources import tables as T
from skeinwork.streaming import ingest


def _arrived(spark, sf_dir, tmp_path):
    """A folder with the events table and one file of rows that are not valid."""
    folder = tmp_path / "in"
    folder.mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", folder / "a.parquet")
    bad = T.table(spark, sf_dir, "events").limit(3).withColumn("props", F.lit("no json"))
    bad.coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def test_ingest_appends_valid_rows_once(spark, sf_dir, tmp_path):
    folder, out, at = _arrived(spark, sf_dir, tmp_path), str(tmp_path / "out"), str(tmp_path / "at")
    for _ in range(2):
        ingest.append(ingest.telemetry_stream(spark, folder), out, at).awaitTermination(120)
    want = {r.event_id for r in T.table(spark, sf_dir, "events").select("event_id").collect()}
    got = [r.event_id for r in spark.read.parquet(out).select("event_id").collect()]
    assert len(got) == len(want) and set(got) == want


def test_streaks(spark, sf_dir, tmp_path):
    folder = _arrived(spark, sf_dir, tmp_path)
    q = ingest.streaks(ingest.telemetry_stream(spark, folder)).writeStream.format("memory").queryName("streaks").outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {}
    for r in sorted(T.table(spark, sf_dir, "events").collect(), key=lambda r: (r.ts, r.event_id)):
        last, n = want.get(r.user_id, ("", 0))
        want[r.user_id] = (r.event_type, n + 1 if r.event_type == last else 1)
    assert {r.user_id: (r.event_type, r.repeats) for r in spark.table("streaks").collect()} == want


def test_debounce_counts_a_burst_once(spark, sf_dir, tmp_path):
    folder = _arrived(spark, sf_dir, tmp_path)
    q = ingest.debounced(ingest.telemetry_stream(spark, folder), "event_type", 200).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="300 milliseconds").start()
    want = {r.event_type: r["count"] for r in T.table(spark, sf_dir, "events").groupBy("event_type").count().collect()}
    until = time.time() + 60
    while time.time() < until and spark.table("bursts").count() < len(want):
        time.sleep(1)
    q.stop()
    assert {r.key: r.n for r in spark.table("bursts").collect()} == want
