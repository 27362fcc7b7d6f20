"""Queries that replay tables as streams, and publishing with a readback; each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.functions import text as T
from redpen.operators import report as P
from redpen.plans.registry import ALL, _issues, query
from redpen.sources import store
from redpen.sources.tables import table
from redpen.streaming import state as S

#: The time limit of a run. The rule's 900 s are the operator's default; users of the given events act hours apart.
LIMIT_MS, STEPS = 6 * 3_600_000, 3
_KINDS = {"purchase": "finished", "error": "cancelled"}


def _events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce(T.mapped(F.col("event_type"), _KINDS, None), F.col("event_type"))
    return table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))


_RUNS = f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'cancelled' ELSE event_type END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events),
s AS (SELECT key, rn, kind, ms, event_id AS run_id, ms AS started_ms FROM e WHERE rn = 1
  UNION ALL SELECT e.key, e.rn, e.kind, e.ms, CASE WHEN fresh THEN e.event_id ELSE e.run_id END, CASE WHEN fresh THEN e.ms ELSE e.started_ms END
  FROM (SELECT e.*, s.run_id, s.started_ms, s.kind IN ('finished', 'cancelled') OR e.ms > s.started_ms + {LIMIT_MS} AS fresh FROM s JOIN e ON e.key = s.key AND e.rn = s.rn + 1) e),
runs AS (SELECT key, run_id, started_ms, count(*) AS n_events, string_agg(kind, '>' ORDER BY rn) AS steps, arg_max(kind, rn) AS kind, max(ms) AS ms FROM s GROUP BY key, run_id, started_ms)
SELECT key, run_id, started_ms, CASE WHEN kind IN ('finished', 'cancelled') THEN ms ELSE started_ms + {LIMIT_MS} END AS ended_ms, n_events,
  CASE WHEN kind IN ('finished', 'cancelled') THEN kind ELSE 'timeout' END AS status, steps, n_events > {STEPS} AS over_cap FROM runs"""


@query(_RUNS)
def run_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each user, from a replay of the events: how each ended, timeouts by timers, its steps and whether they went over the cap."""
    folder, delay = S.replayed(_events(spark, d), "ts", LIMIT_MS)
    stream = S.replay(spark, folder, _events(spark, d).schema)
    log = store.BatchLog(spark, store.new_path(spark, "runs"), S.RUN)
    store.drained(S.runs_of(stream, delay, LIMIT_MS, STEPS), log, store.new_path(spark, "checkpoint"))
    return log.read().drop("batch")


@query("SELECT conv_id AS thread_id, role AS message_id, min(turn) AS position, max(turn) AS seq, role, md5(arg_max(text, turn)) AS content_md5 FROM conversations GROUP BY conv_id, role")
def message_stream(spark: SparkSession, d: str) -> DataFrame:
    """Messages by id (here: the role) from a replay of the conversations; of the changes that the state gave, the last one of each message."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("role").alias("message_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), F.timestamp_seconds("turn").alias("ts"))
    folder, _ = S.replayed(rows, "ts")
    log = store.BatchLog(spark, store.new_path(spark, "messages"), S.MESSAGE, "parquet")
    store.drained(S.threads_of(S.source(spark, folder, rows.schema)), log, store.new_path(spark, "checkpoint"), "update", idle=False)
    last = log.read().groupBy("thread_id", "message_id").agg(F.max_by(F.struct("position", "seq", "role", "content"), F.struct("seq", "batch")).alias("m"))
    return last.select("thread_id", "message_id", "m.position", "m.seq", "m.role", F.md5("m.content").alias("content_md5"))


_ASKED = "TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 7919 % 2592000)"


@query(
    f"""SELECT o_orderkey AS request_id, o_orderkey AS run_id, CASE WHEN event_id IS NULL THEN 'not_found' WHEN event_type IN ('purchase', 'error') THEN 'already_completed' ELSE 'cancelling' END AS answer
  FROM orders LEFT JOIN events ON event_id = o_orderkey AND ts <= {_ASKED} AND ts >= {_ASKED} - INTERVAL 7 DAY"""
)
def cancel_stream(spark: SparkSession, d: str) -> DataFrame:
    """Cancel requests (order keys, at times derived from them) answered as a stream by the stream of runs (events): each is answered once, when no run can turn up any more."""
    asked = F.timestamp_millis(F.lit(1_704_067_200_000) + (F.col("o_orderkey") * 7919 % 2_592_000) * 1000)
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("run_id"), asked.alias("asked_at"))
    runs = _events(spark, d).select(F.col("event_id").alias("run_id"), "ts", F.col("kind").alias("status"))
    (left, left_delay), (right, right_delay) = (S.replayed(r, t, 8 * 86_400_000, closing={"run_id": k}) for r, t, k in ((requests, "asked_at", -1), (runs, "ts", -2)))
    answers = S.cancel_answers(S.replay(spark, left, requests.schema), S.replay(spark, right, runs.schema), left_delay, right_delay)
    log = store.BatchLog(spark, store.new_path(spark, "answers"), S.ANSWER, "parquet")
    store.drained(answers, log, store.new_path(spark, "checkpoint"))
    return log.read().drop("batch")


@query("SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY ALL")
def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Progress events by hour and kind, read from the JSON Lines log that a stream of them has left; every event is in it once."""
    rows = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    folder, _ = S.replayed(rows, "ts")
    log = store.BatchLog(spark, store.new_path(spark, "log"), "event_id long, event_type string, ts timestamp")
    store.drained(S.source(spark, folder, rows.schema).filter("event_id is not null"), log, store.new_path(spark, "checkpoint"))
    hour = F.unix_micros(F.date_trunc("hour", "ts")).alias("hour_us")
    return log.read().groupBy(hour, "event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))


def _escaped(column: str) -> str:
    return f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_PARA = "upper(substr(md5('para:' || id), 1, 8))"
_DOCUMENT = f"""'<start id="' || (seq - 1) || '"/>' || {_escaped('excerpt')} || '<end id="' || (seq - 1) || '"/><ref id="' || (seq - 1) || '"/>'"""
_COMMENTS = f"""'<comment id="' || (seq - 1) || '" paraId="' || {_PARA} || '">' || {_escaped('problem')} || '</comment>'"""
_EXTENDED = f"""'<ex paraId="' || {_PARA} || '" done="0"/>'"""


@query(
    ALL
    + " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS name, count(*) AS n, md5('<{name}>' || string_agg({piece}, '' ORDER BY seq) || '</{name}>') AS body_md5 FROM grouped GROUP BY doc_id"
        for name, piece in (("document", _DOCUMENT), ("comments", _COMMENTS), ("extended", _EXTENDED))
    )
)
def published_parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every commented document, from the table that was published after its readback."""
    parts = P.document_parts(_issues(spark, d))
    known = F.coalesce(F.bool_and(F.col("name").isin(*P.PART_MARKS) & F.col("body").isNotNull()), F.lit(True))
    there = store.publish(parts, store.new_path(spark, "parts"), {"names and bodies": known, "balance": P.broken_parts})
    mark = F.regexp_count("body", T.mapped(F.col("name"), P.PART_MARKS, ""))
    return there.select("doc_id", "name", mark.cast("long").alias("n"), F.md5("body").alias("body_md5"))
