"""Structured Streaming forms of the stateful rules: two numbers of state for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmark.operators.history import LIMIT, WINDOW_MS

DECISION = "key long, id long, at long, allowed boolean, remaining long, reset_at long"


def limited(requests: DataFrame, limit: int = LIMIT, window_ms: int = WINDOW_MS, late_ms: int = WINDOW_MS) -> DataFrame:
    """Decisions on a stream of (key, id, at) requests; ``at`` in milliseconds.

    The state of a key is its window's end and count. Requests of one micro-batch are
    taken in order of time and id. Time is the requests' own: a key's state is dropped
    once the watermark, ``late_ms`` behind the latest request, has passed its window's
    end, and requests older than the watermark are left out.
    """
    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        reset, count = state.get if state.exists else (0, 0)
        for batch in batches:
            batch = batch.sort_values(["at", "id"])
            out = []
            for id_, at in zip(batch["id"].tolist(), batch["at"].tolist(), strict=True):
                if reset <= at:
                    reset, count = at + window_ms, 0
                count += 1
                out.append((key[0], id_, at, count <= limit, max(0, limit - count), reset))
            yield pd.DataFrame(out, columns=["key", "id", "at", "allowed", "remaining", "reset_at"])
        state.update((reset, count))
        state.setTimeoutTimestamp(max(reset, state.getCurrentWatermarkMs()) + 1)

    # One millisecond on, so that a request at the very start of time is not behind the first watermark.
    timed = requests.withColumn("ts", F.timestamp_millis(F.col("at") + 1)).withWatermark("ts", f"{late_ms} milliseconds")
    return timed.groupBy("key").applyInPandasWithState(decide, DECISION, "reset long, count long", "append", GroupStateTimeout.EventTimeTimeout)


def counted(requests: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Requests of each key by tumbling window of ``ts``; those later than the watermark are left out."""
    return requests.withWatermark("ts", late).groupBy(F.window("ts", width), "key").agg(F.count("*").alias("n")).select("key", F.col("window.start").alias("opened"), "n")


def fresh(results: DataFrame, documents: DataFrame) -> DataFrame:
    """Results of a stream whose revision is that of the static ``documents`` (id, revision)."""
    return results.join(documents, ["id", "revision"], "left_semi")


def last_of_session(events: DataFrame, gap: str, late: str) -> DataFrame:
    """The last event time of each session of a key's events, once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "key").agg(F.max("ts").alias("last"), F.count("*").alias("n")).select("key", "last", "n")
