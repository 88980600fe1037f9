"""Streams of telemetry: validated ingest and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def telemetry_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the Parquet files that arrive in a folder; rows without an id, a type or JSON attributes are left out."""
    rows = spark.readStream.schema(EVENTS).parquet(folder)
    return rows.filter(F.col("event_id").isNotNull() & F.col("event_type").isNotNull() & F.get_json_object("props", "$").isNotNull())


def append(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet files; a restart with the same checkpoint writes no row twice."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def debounced(events: DataFrame, key: str, delay_ms: int = 250) -> DataFrame:
    """(key, n): how many events a key had from its first one until `delay_ms` later; later events do not push the end back.

    Processing time decides, as for a watcher that gathers a burst. State is one count and one deadline per key.
    """

    def step(found: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ends = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [found[0]], "n": [n]})
            return
        new, now = sum(len(b) for b in batches), state.getCurrentProcessingTimeMs()
        if ends and now >= ends:  # the burst was over before these came
            yield pd.DataFrame({"key": [found[0]], "n": [n]})
            n, ends = 0, 0
        ends = ends or now + delay_ms
        state.update((n + new, ends))
        state.setTimeoutDuration(max(1, ends - now))

    grouped = events.select(F.col(key).cast("string").alias("key")).groupBy("key")
    return grouped.applyInPandasWithState(step, "key string, n long", "n long, ends long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def streaks(events: DataFrame) -> DataFrame:
    """(user_id, event_type, repeats) after each batch: how often a user's last event type has come in a row.

    A batch's rows of one user are ordered by ts and event_id; state is the last type and its count.
    """

    def step(found: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else ("", 0)
        for kind in pd.concat(list(batches)).sort_values(["ts", "event_id"])["event_type"]:
            last, n = kind, n + 1 if kind == last else 1
        state.update((last, n))
        yield pd.DataFrame({"user_id": [found[0]], "event_type": [last], "repeats": [n]})

    rows = events.select("user_id", "event_type", "ts", "event_id")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_type string, repeats long", "last string, n long", "update", GroupStateTimeout.NoTimeout)
