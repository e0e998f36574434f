"""The streaming rate limit gives the batch one's decisions."""


from quillmark.operators import history
from quillmark.streaming import limits


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(k, i, 1000 * i + k) for k in range(3) for i in range(12)]
    schema = "key long, id long, at long"
    spark.createDataFrame(rows, schema).repartition(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    found = limits.limited(stream, 3, 5_000).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert found.awaitTermination(120)
    got = sorted((r["key"], r["id"], r["allowed"], r["remaining"], r["reset_at"]) for r in spark.table("limited").collect())
    want = sorted((r["key"], r["id"], r["allowed"], r["remaining"], r["reset_at"]) for r in history.limited(spark.createDataFrame(rows, schema), 3, 5_000).collect())
    assert got == want


def test_late_results_are_left_out(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "id long, revision long").write.json(str(tmp_path / "in"))
    docs = spark.createDataFrame([(1, 2), (2, 4)], "id long, revision long")
    stream = spark.readStream.schema("id long, revision long").json(str(tmp_path / "in"))
    q = limits.fresh(stream, docs).writeStream.format("memory").queryName("fresh").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert q.awaitTermination(120)
    assert [(r["id"], r["revision"]) for r in spark.table("fresh").collect()] == [(1, 2)]
