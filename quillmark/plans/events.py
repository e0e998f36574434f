"""Queries over the event log: limits, retention, revisions, debounce, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import history
from quillmark.plans.catalog import query
from quillmark.sources.tables import table

_MS = "epoch_us(ts) // 1000"


def _ms() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


def _decision(key: str, limit: int, window: int) -> str:
    return f"""(WITH RECURSIVE e AS (SELECT {key} AS key, event_id AS id, {_MS} AS ms, row_number() OVER (PARTITION BY {key} ORDER BY {_MS}, event_id) AS n FROM events),
  r AS (SELECT key, id, ms, n, ms + {window} AS reset_at, 1::BIGINT AS c FROM e WHERE n = 1
    UNION ALL SELECT e.key, e.id, e.ms, e.n, CASE WHEN r.reset_at <= e.ms THEN e.ms + {window} ELSE r.reset_at END, CASE WHEN r.reset_at <= e.ms THEN 1 ELSE r.c + 1 END FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
  SELECT key, id, ms AS "at", c <= {limit} AS allowed, greatest(0, {limit} - c) AS remaining, reset_at FROM r)"""


@query(f"SELECT * FROM {_decision('user_id', 3, 86_400_000)}")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests a day for each user, the day opening with its first request."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), _ms().alias("at"))
    return history.limited(events, 3, 86_400_000)


@query(f"""
WITH a AS {_decision('user_id', 3, 86_400_000)}, b AS {_decision('(user_id % 50)', 9, 86_400_000)}
SELECT id, a.allowed AND b.allowed AS allowed, least(a.remaining, b.remaining) AS remaining, CASE WHEN a.allowed = b.allowed THEN greatest(a.reset_at, b.reset_at) WHEN NOT a.allowed THEN a.reset_at ELSE b.reset_at END AS reset_at FROM a JOIN b USING (id)
""")
def rate_limit_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's limit and that of a group of users together."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), _ms().alias("at"))
    return history.combined(history.limited(events, 3, 86_400_000), history.limited(events.withColumn("key", F.col("key") % 50), 9, 86_400_000))


@query()
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's history keeps, events read as records; tests hold the phases against a plain loop."""
    q = F.col
    rows = table(spark, sf_dir, "events").select(
        q("user_id").alias("owner"), q("event_id").alias("id"), _ms().alias("updated"), (_ms() + (1 + q("event_id") % 9) * 86_400_000 * 4).alias("expires"),
        (1000 + q("event_id") % 700).alias("body"), (q("event_id") % 3 * 400).alias("renders"), (q("event_id") % 4 * 900).alias("pdf"),
    )
    return history.retained(rows, F.lit(1_706_000_000_000), 9_000)


@query("""
SELECT r.event_id AS result_id, CASE WHEN o.o_orderkey IS NULL THEN 'unknown' WHEN r.event_id % 5 = o.o_custkey % 5 THEN 'fresh' WHEN r.event_id % 5 < o.o_custkey % 5 THEN 'stale' ELSE 'ahead' END AS state
FROM events r LEFT JOIN orders o ON o.o_orderkey = r.user_id * 3
""")
def late_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results (events) checked against the current revision of their document (an order)."""
    results = table(spark, sf_dir, "events").select((F.col("user_id") * 3).alias("id"), F.col("event_id").alias("result_id"), (F.col("event_id") % 5).alias("revision"))
    current = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("revision"))
    return history.current_only(results, current).select("result_id", "state")


@query(f"""SELECT key, id, ms AS "at" FROM (SELECT user_id AS key, event_id AS id, {_MS} AS ms, lead({_MS}) OVER (PARTITION BY user_id ORDER BY {_MS}, event_id) AS next FROM events) WHERE next IS NULL OR next - ms > 3600000""")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each run of a user's events within an hour of each other."""
    return history.debounced(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), _ms().alias("at")), 3_600_000)


@query("""
SELECT coalesce(s.id, i.id) AS id, CASE WHEN s.status = 'accepted' OR i.status IS NULL THEN s.status ELSE i.status END AS status, CASE WHEN s.status = 'accepted' OR i.status IS NULL THEN s.body ELSE i.body END AS body
FROM (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'pending' END AS status, o_custkey AS body FROM orders WHERE o_orderkey % 3 < 2) s
FULL JOIN (SELECT o_orderkey AS id, 'new' AS status, o_custkey + 1 AS body FROM orders WHERE o_orderkey % 3 > 0) i ON s.id = i.id
""")
def suggestion_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows merged with incoming ones; accepted rows stay."""
    q, orders = F.col, table(spark, sf_dir, "orders")
    stored = orders.where("o_orderkey % 3 < 2").select(q("o_orderkey").alias("id"), F.when(q("o_orderstatus") == "F", "accepted").otherwise("pending").alias("status"), q("o_custkey").alias("body"))
    return history.merged(stored, orders.where("o_orderkey % 3 > 0").select(q("o_orderkey").alias("id"), F.lit("new").alias("status"), (q("o_custkey") + 1).alias("body")))
