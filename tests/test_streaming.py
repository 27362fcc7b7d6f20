"""Streams give what the same declarations give on a batch."""

from pyspark.sql import functions as F

from redpen.streaming import runs


def test_messages_are_replaced_by_id(spark):
    rows = spark.createDataFrame([("t", "m1", 1, "user", "a"), ("t", "m2", 2, "user", "b"), ("t", "m1", 3, "user", "c")], "thread_id string, message_id string, seq long, role string, content string")
    got = [(r["message_id"], r["content"]) for r in runs.latest_messages(rows).orderBy("position").collect()]
    assert got == [("m1", "c"), ("m2", "b")]


def test_run_states_as_stream_and_batch(spark, tmp_path):
    rows = [("a", 0, "start"), ("a", 10, "finished"), ("b", 0, "start"), ("b", 901, "step"), ("c", 0, "start"), ("d", 0, "start"), ("d", 5, "cancelled")]
    df = spark.createDataFrame(rows, "run_id string, s long, event string").select("run_id", F.timestamp_seconds("s").alias("ts"), "event")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    want = {(r["run_id"], r["status"]) for r in runs.run_states(df).collect()}
    assert want == {("a", "finished"), ("b", "timeout"), ("c", "running"), ("d", "cancelled")}
    stream = runs.events(spark, str(tmp_path / "in"), "run_id string, ts timestamp, event string", 1)
    q = runs.run_states(stream).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["run_id"], r["status"]) for r in spark.table("states").collect()} == want
    ask = spark.createDataFrame([("a",), ("c",), ("z",)], "run_id string")
    assert {(r["run_id"], r["answer"]) for r in runs.commands(ask, runs.run_states(df)).collect()} == {("a", "already_completed"), ("c", "cancelling"), ("z", "not_found")}
    log = runs.write_log(stream, str(tmp_path / "log"), str(tmp_path / "cp"))
    log.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "log")).count() == len(rows)
