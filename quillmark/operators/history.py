"""Rules over logs: rate limits, retention, stale results, debounce."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed values ------------------------------------------------------------------------------
WINDOW_MS, LIMIT = 3_600_000, 10
TTL_HOURS, RECORDS, BYTES = 24, 10, 50_000_000
DEBOUNCE_MS = 250
# -------------------------------------------------------------------------------------------


def limited(events: DataFrame, limit: int = LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """(key, id, at, allowed, remaining, reset_at) of (key, id, at) requests.

    A window opens with the first request at or after the last one's end, so it
    depends on all requests before: one pass over each key's requests in order of
    time and id, which keeps the window's end and count between batches and jumps
    from one window's opening to the next.
    """
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reset, count = None, 0, 0
        for batch in batches:
            key, at = batch["key"].to_numpy(zero_copy_only=False), batch["at"].to_numpy()
            resets, counts = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)) if len(key) else []
            i = 0
            for end in ends:
                if last is None or key[i] != last:
                    last, reset, count = key[i], at[i], 0
                while i < end:
                    if reset <= at[i]:
                        reset, count = at[i] + window_ms, 0
                    to = i + int(np.searchsorted(at[i:end], reset))
                    resets[i:to], counts[i:to] = reset, np.arange(count + 1, count + 1 + to - i)
                    count += to - i
                    i = to
            left = pa.array(np.maximum(0, limit - counts))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["id"], batch["at"], pa.array(counts <= limit), left, pa.array(resets)], decision.names)

    decision = StructType([*events.select("key", "id", "at").schema.fields]).add("allowed", "boolean").add("remaining", "long").add("reset_at", "long")
    rows = events.select("key", "id", "at").where("key is not null and at is not null").repartition("key").sortWithinPartitions("key", "at", "id")
    return rows.mapInArrow(decide, decision)


def combined(a: DataFrame, b: DataFrame) -> DataFrame:
    """The joint decision on each request id of two limits: both must allow; a refusal lasts as long as the refusing limits."""
    def named(df: DataFrame, p: str) -> DataFrame:
        return df.select("id", *[F.col(c).alias(f"{p}_{c}") for c in ("allowed", "remaining", "reset_at")])

    rows = named(a, "a").join(named(b, "b"), "id")
    both = F.col("a_allowed") & F.col("b_allowed")
    late = F.when(both | (~F.col("a_allowed") & ~F.col("b_allowed")), F.greatest("a_reset_at", "b_reset_at")).when(~F.col("a_allowed"), F.col("a_reset_at")).otherwise(F.col("b_reset_at"))
    return rows.select("id", both.alias("allowed"), F.least("a_remaining", "b_remaining").alias("remaining"), late.alias("reset_at"))


def retained(records: DataFrame, now: Column, most_bytes: int = BYTES, most: int = RECORDS) -> DataFrame:
    """What an owner's history keeps: (owner, id, action, bytes) of (owner, id, updated, expires, body, renders, pdf).

    Expired records go, then all but the latest ten. While the rest is too large,
    renders are dropped from the oldest on, then PDFs, then whole records. Each
    phase takes as many of the oldest as it needs, by a running sum of what they free.
    """
    latest = Window.partitionBy("owner").orderBy(F.desc("updated"), F.desc("id"))
    rows = records.where(F.col("expires") > now).withColumn("place", F.row_number().over(latest)).where(F.col("place") <= most)
    oldest = Window.partitionBy("owner").orderBy("updated", "id").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("owner")

    def freed(rows: DataFrame, column: str, flag: str) -> DataFrame:
        total = F.sum(F.col("body") + F.col("renders") + F.col("pdf")).over(every)
        rows = rows.withColumn("over", total - most_bytes).withColumn("so_far", F.coalesce(F.sum(column).over(oldest), F.lit(0)))
        rows = rows.withColumn(flag, (F.col("over") > F.col("so_far")) & (F.col(column) > 0))
        return rows.withColumn(column, F.when(F.col(flag), F.lit(0).cast("long")).otherwise(F.col(column)))

    rows = freed(freed(rows, "renders", "no_renders"), "pdf", "no_pdf")
    rows = rows.withColumn("left", F.col("body") + F.col("renders") + F.col("pdf"))
    rows = rows.withColumn("over", F.sum("left").over(every) - most_bytes).withColumn("so_far", F.coalesce(F.sum("left").over(oldest), F.lit(0)))
    rows = rows.where(F.col("over") <= F.col("so_far"))
    action = F.concat_ws("+", F.when(F.col("no_renders"), "renders"), F.when(F.col("no_pdf"), "pdf"))
    return rows.select("owner", "id", F.when(action == "", "kept").otherwise(action).alias("dropped"), F.col("left").alias("bytes"))


def current_only(results: DataFrame, documents: DataFrame) -> DataFrame:
    """Results whose revision is still the document's, and why others are not used."""
    rows = results.join(documents.select("id", F.col("revision").alias("current")), "id", "left")
    return rows.withColumn("state", F.when(F.col("current").isNull(), "unknown").when(F.col("revision") == F.col("current"), "fresh").when(F.col("revision") < F.col("current"), "stale").otherwise("ahead"))


def debounced(events: DataFrame, gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """The last event of each run of a key's events that follow each other within the gap."""
    after = F.lead("at").over(Window.partitionBy("key").orderBy("at", "id"))
    return events.withColumn("next", after).where(F.col("next").isNull() | (F.col("next") - F.col("at") > gap_ms)).drop("next")


def merged(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by id: incoming rows replace stored ones that are not accepted, others are appended."""
    rows = stored.alias("s").join(incoming.alias("i"), "id", "full")
    keep = F.col("s.status").eqNullSafe("accepted") | F.col("i.status").isNull()
    return rows.select("id", F.when(keep, F.col("s.status")).otherwise(F.col("i.status")).alias("status"), F.when(keep, F.col("s.body")).otherwise(F.col("i.body")).alias("body"))
