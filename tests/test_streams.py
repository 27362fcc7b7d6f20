"""Keyed state, stream joins, the log and publishing: restarts, late rows, timers, damage."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from redpen.operators import report as P
from redpen.plans import registry, streams
from redpen.sources import store
from redpen.streaming import state as S

EVENTS = "key long, event_id long, ts timestamp, kind string"


def _events(spark, rows):
    return spark.createDataFrame(rows, "key long, event_id long, s long, kind string").select("key", "event_id", F.timestamp_seconds("s").alias("ts"), "kind")


def _add(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_runs_end_by_event_or_timer_and_resume(few, tmp_path):
    """Rows out of order within the delay, a restart between batches, one late row, a run that only a timer ends."""
    spark = few
    log = store.BatchLog(spark, str(tmp_path / "log"), S.RUN)

    def run():
        store.drained(S.runs_of(S.source(spark, str(tmp_path / "in"), EVENTS, 1), 100_000, 900_000, 2), log, str(tmp_path / "checkpoint"))

    # 7: two events arrive in the wrong order; 8: no further event, its limit passes
    _add(_events(spark, [(7, 2, 50, "view"), (7, 1, 10, "view"), (8, 3, 20, "view"), (9, 9, 30, "cancelled")]), tmp_path / "in")
    _add(_events(spark, [(7, 4, 120, "finished"), (7, 5, 400, "view")]), tmp_path / "in")
    run()
    assert {(r["key"], r["run_id"], r["status"], r["steps"]) for r in log.read().collect()} == {(7, 1, "finished", "view>view>finished"), (9, 9, "cancelled", "cancelled")}
    # resumed: the watermark is at 300 s, so an event at 60 s is late and belongs to no run
    _add(_events(spark, [(8, 6, 60, "finished"), (7, 7, 1300, "view"), (None, None, 3000, None)]), tmp_path / "in")
    run()
    got = {tuple(r[c] for c in ("key", "run_id", "started_ms", "ended_ms", "n_events", "status", "over_cap")) for r in log.read().collect()}
    assert got == {
        (7, 1, 10_000, 120_000, 3, "finished", True), (9, 9, 30_000, 30_000, 1, "cancelled", False), (8, 3, 20_000, 920_000, 1, "timeout", False),
        (7, 5, 400_000, 1_300_000, 2, "timeout", False),
    }


def _in_many_files(spark, data, tmp_path, change, monkeypatch):
    """The given tables with events and orders in 24 files, each read as a partition of its own, and the list that takes the numbers of the batches written."""
    conf, batches, wrote = spark.conf, [], store.BatchLog.__call__
    for name, df in change.items():
        df.repartition(24).write.parquet(str(tmp_path / f"{name}.parquet"))
    before = conf.get("spark.sql.files.maxPartitionBytes")
    conf.set("spark.sql.files.maxPartitionBytes", "1k")
    monkeypatch.setattr(store.BatchLog, "__call__", lambda self, rows, batch: (batches.append(batch), wrote(self, rows, batch))[1])
    con = duckdb.connect()
    for name in change:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return con, batches, lambda: conf.set("spark.sql.files.maxPartitionBytes", before)


def _same(query, spark, con, folder, name):
    got = query(spark, str(folder))
    return sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.SQL[name]})").fetchall()))


def test_replayed_runs_take_few_batches_whatever_the_files(few, data, tmp_path, monkeypatch):
    """Every batch goes through the keys' state, so the number of batches must not grow with the table's files; events without a kind are steps without a name."""
    spark = few
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("event_type", F.when(F.col("event_id") % 50 != 0, F.col("event_type")))
    con, batches, restore = _in_many_files(spark, data, tmp_path, {"events": events}, monkeypatch)
    try:
        assert _same(streams.run_sessions, spark, con, tmp_path, "run_sessions")
    finally:
        restore()
    assert len(set(batches)) < 15


def test_messages_are_replaced_across_batches(few, tmp_path):
    spark, schema = few, "thread_id long, message_id string, seq long, role string, content string"
    log = store.BatchLog(spark, str(tmp_path / "log"), S.MESSAGE, "parquet")
    for part in ([(1, "a", 1, "user", "x"), (1, "b", 2, "assistant", "y")], [(1, "a", 3, "user", "z"), (2, "a", 1, "user", None), (None, "a", 1, "user", "q")]):
        _add(spark.createDataFrame(part, schema), tmp_path / "in")
        store.drained(S.threads_of(S.source(spark, str(tmp_path / "in"), schema)), log, str(tmp_path / "checkpoint"), "update", idle=False)
    got = {tuple(r[c] for c in ("batch", "thread_id", "message_id", "position", "seq", "content")) for r in log.read().collect()}
    assert got == {(0, 1, "a", 1, 1, "x"), (0, 1, "b", 2, 2, "y"), (1, 1, "a", 1, 3, "z"), (1, 2, "a", 1, 1, None)}


def test_cancel_requests_meet_runs(few, tmp_path):
    """Missing, not yet started and ended runs, and a request behind the watermark."""
    spark = few
    asked = spark.createDataFrame([(1, 10, 100), (2, 11, 100), (3, 99, 100), (4, 12, 100), (5, 12, 700_000)], "request_id long, run_id long, s long").select("request_id", "run_id", F.timestamp_seconds("s").alias("asked_at"))
    runs = spark.createDataFrame([(10, 50, "finished"), (11, 60, "view"), (12, 150, "view")], "run_id long, s long, status string").select("run_id", F.timestamp_seconds("s").alias("ts"), "status")
    folder, delay = S.replayed(asked, "asked_at", 8 * 86_400_000, closing={"run_id": -1})
    right, right_delay = S.replayed(runs, "ts", 9 * 86_400_000, closing={"run_id": -2})
    log = store.BatchLog(spark, str(tmp_path / "log"), "request_id long, run_id long, answer string", "parquet")

    def run():
        store.drained(S.cancel_answers(S.source(spark, folder, asked.schema), S.source(spark, right, runs.schema), delay, right_delay), log, str(tmp_path / "checkpoint"))

    run()
    want = {(1, "already_completed"), (2, "cancelling"), (3, "not_found"), (4, "not_found"), (5, "not_found")}
    assert {(r["request_id"], r["answer"]) for r in log.read().collect()} == want  # 5: asked after the horizon of seven days
    late = spark.createDataFrame([(6, 10, 120)], "request_id long, run_id long, s long").select("request_id", "run_id", F.timestamp_seconds("s").alias("asked_at"))
    _add(late, folder.removeprefix("file://"))
    run()
    assert {(r["request_id"], r["answer"]) for r in log.read().collect()} == want  # a late request has no answer


def test_replayed_requests_take_few_batches_whatever_the_files(few, data, tmp_path, monkeypatch):
    spark = few
    change = {name: spark.read.parquet(f"{data}/{name}.parquet") for name in ("events", "orders")}
    con, batches, restore = _in_many_files(spark, data, tmp_path, change, monkeypatch)
    try:
        assert _same(streams.cancel_stream, spark, con, tmp_path, "cancel_stream")
    finally:
        restore()
    assert len(set(batches)) < 15


def test_answers_equal_a_join(spark):
    """Several states of a run, each at or beyond the horizon's ends, and requests without an id or a run."""
    deal, seven = random.Random(5), 7 * 86_400_000_000
    known = [(deal.randrange(6), deal.choice((0, 1, seven, seven + 1, deal.randrange(2 * seven))), 0, deal.randrange(3)) for _ in range(60)]
    due = [(deal.randrange(8), deal.choice((0, seven, seven + 1, deal.randrange(2 * seven))), k, deal.choice((-1, -1, -2, -3, -4))) for k in range(60)]
    want = []
    for run, at, k, code in due:
        met = [c for r, t, _, c in known if r == run and 0 <= at - t <= seven and code in (-1, -3)]
        want += [(None if code in (-3, -4) else k, None if code in (-2, -4) else run, S.ANSWERS[c]) for c in met or [0]]
    got = S.Answers("7 days").answered(np.array(due), np.array(known))
    assert sorted(map(repr, want)) == sorted(repr((None if pd.isna(a) else int(a), None if pd.isna(b) else int(b), c)) for a, b, c in got.itertuples(index=False))


def test_log_of_a_killed_run_holds_every_row_once(spark, tmp_path):
    schema = "event_id long, event_type string"
    for k in range(3):
        _add(spark.createDataFrame([(10 * k + i, "view") for i in range(5)], schema), tmp_path / "in")
    log = store.BatchLog(spark, str(tmp_path / "log"), schema)

    def killed(rows, batch):
        if batch == 1:
            log(rows, batch)
            raise RuntimeError("killed after writing, before the batch is noted")
        log(rows, batch)

    stream = S.source(spark, str(tmp_path / "in"), schema, 1)
    with pytest.raises(Exception, match="killed after writing"):
        store.drained(stream, killed, str(tmp_path / "checkpoint"))
    assert log.read().count() == 10
    (tmp_path / "log" / "batch=2").mkdir()  # what a writer leaves that is killed while it writes
    (tmp_path / "log" / "batch=2" / "part-0.json").write_text('{"event_id": 20, "event_type": "view"}\n')
    assert log.read().count() == 10
    store.drained(stream, log, str(tmp_path / "checkpoint"))
    assert sorted(r["event_id"] for r in log.read().collect()) == [10 * k + i for k in range(3) for i in range(5)]
    assert store.BatchLog(spark, str(tmp_path / "none"), schema).read().count() == 0


def _issues(spark):
    return spark.createDataFrame([(1, 1, "x-1", "a < b", "too long"), (1, 2, "x-2", "", "& more"), (2, 1, "x-3", "c", "d")], "doc_id long, seq long, id string, excerpt string, problem string")


def test_publishing_whole_and_damaged_parts(spark, tmp_path):
    parts, target = P.document_parts(_issues(spark)), tmp_path / "out" / "parts"
    (tmp_path / "out").mkdir()
    there = store.publish(parts, str(target), {"balance": P.broken_parts})
    assert {(r["doc_id"], r["name"]) for r in there.collect()} == {(d, n) for d in (1, 2) for n in P.PART_MARKS}
    assert "&lt;" in there.filter("doc_id = 1 and name = 'document'").first()["body"]
    with pytest.raises(store.PublishError, match="taken"):
        store.publish(parts, str(target), {})
    assert there.count() == 6
    lost = F.when((F.col("doc_id") == 2) & (F.col("name") == "document"), F.replace("body", F.lit("<end "), F.lit("<"))).otherwise(F.col("body"))
    for bad in (parts.withColumn("body", lost), parts.filter("not (doc_id = 2 and name = 'extended')"), parts.union(parts.filter("doc_id = 1 and name = 'comments'"))):
        with pytest.raises(store.PublishError, match="balance"):
            store.publish(bad, str(tmp_path / "out" / "bad"), {"balance": P.broken_parts})
    with pytest.raises(store.PublishError, match="bodies"):
        store.publish(parts, str(tmp_path / "out" / "bad"), {"bodies": F.bool_and(F.col("body").isNull())})
    with pytest.raises(Exception, match="broken row"):
        store.publish(parts.withColumn("body", F.raise_error(F.lit("broken row")).cast("string")), str(tmp_path / "out" / "bad"), {})
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["parts"]
    assert store.publish(parts.limit(0), str(tmp_path / "out" / "empty"), {"balance": P.broken_parts}).count() == 0
