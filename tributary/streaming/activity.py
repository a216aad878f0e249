"""Streaming forms of the activity operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_activity(events: DataFrame, ts: str, user: str, width: str, slide: str, late: str) -> DataFrame:
    """(start, events, users) per sliding window; events later than ``late`` behind the newest are dropped."""
    e = events.withWatermark(ts, late)
    return e.groupBy(F.window(ts, width, slide)).agg(F.count("*").alias("events"), F.approx_count_distinct(user).alias("users")).select(F.col("window.start").alias("start"), "events", "users")


def first_last(events: DataFrame, ts: str, user: str) -> DataFrame:
    """(user, first_ts, last_ts, events) in update or complete mode."""
    return events.groupBy(user).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events"))


def sessions(events: DataFrame, ts: str, user: str, gap: str, late: str) -> DataFrame:
    """(user, start, end, events) per session: a user has left after ``gap`` without an event."""
    e = events.withWatermark(ts, late)
    s = e.groupBy(F.col(user), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def departures(events: DataFrame, ts: str, user: str, idle_ms: int, late: str) -> DataFrame:
    """(user, last_ts, events): each time a user stayed away for more than ``idle_ms``, the last event before and the events of that stay.

    Gaps inside a batch are read off the sorted events; gaps at its end by a timer on event time, once the watermark has passed them.
    """
    kind = events.schema[user].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (0, 0)
        gone: list[tuple[int, int]] = []
        if state.hasTimedOut:
            gone.append((last, n))
            state.remove()
        else:
            for t in sorted(int(x.timestamp() * 1000) for b in batches for x in b[ts]):
                if n and t - last > idle_ms:
                    gone.append((last, n))
                    last, n = 0, 0
                last, n = max(last, t), n + 1
            state.update((last, n))
            state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        if gone:
            yield pd.DataFrame({user: [key[0]] * len(gone), "last_ts": [pd.Timestamp(x, unit="ms") for x, _ in gone], "events": [k for _, k in gone]})

    e = events.withWatermark(ts, late)
    return e.groupBy(user).applyInPandasWithState(run, f"{user} {kind}, last_ts timestamp, events long", "last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Take a stream of finite input to its end into a table in the shared folder and give that table.

    In complete mode each batch replaces the table. ``late_rows`` of the result counts the rows (after combining within a task) that came behind the watermark and
    were dropped. No row passes through the driver.
    """
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").start(path)
    else:
        q = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    out = stream.sparkSession.read.schema(stream.schema).parquet(path)
    out.late_rows = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    return out
