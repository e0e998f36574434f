"""The batch rate limit against a plain loop: long keys, times before 1970, states carried over batches."""

import random

from quillmark.operators import history


def _loop(rows, limit, window):
    state, out = {}, {}
    for key, id_, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        reset, count = state.get(key, (at, 0))
        if reset <= at:
            reset, count = at + window, 0
        state[key] = reset, count + 1
        out[id_] = key, at, count < limit, max(0, limit - count - 1), reset
    return out


def _got(df):
    return {r["id"]: (r["key"], r["at"], r["allowed"], r["remaining"], r["reset_at"]) for r in df.collect()}


def test_limits_of_long_keys(spark):
    """One key with 100 000 times of its own, which a fold over an array copies again and again."""
    rng = random.Random(3)
    rows = [(7, i, i * 1000 + rng.randrange(1000)) for i in range(100_000)] + [(k, 100_000 + 50 * k + i, rng.randrange(-9_000, 9_000)) for k in range(-9, 30) for i in range(50)]
    df = spark.createDataFrame(rows, "key long, id long, at long")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in (kept, "37"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            assert _got(history.limited(df, 3, 2_000)) == _loop(rows, 3, 2_000)
            assert _got(history.limited(df, 9, 3_600_000)) == _loop(rows, 9, 3_600_000)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_limits_of_names_and_of_none(spark):
    rows = [("a", 1, -5), ("a", 2, -1), ("b", 3, 4), ("a", 4, 5)]
    assert _got(history.limited(spark.createDataFrame(rows, "key string, id int, at long"), 1, 10)) == _loop(rows, 1, 10)
    assert history.limited(spark.createDataFrame([], "key string, id int, at long")).count() == 0
