"""Keyed state of streams: runs with a time limit, threads of messages, cancel requests against runs.

Rows are settled when the watermark passes them, so the order in which they arrive within the allowed delay makes no
difference; rows at or before the watermark are late and dropped. `replayed` turns a table into files in order of time with
a last row far ahead, which moves the watermark past everything: the stream then gives what a batch would.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from redpen.sources.store import names, new_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event kinds that end a run, and what it is called then.
ENDS = {"finished": "finished", "cancelled": "cancelled"}
#: Buckets of the keys of runs. They are the keys of the state, so a stream that is resumed has to have as many.
BUCKETS = 512
#: Answers to cancel requests, by number.
ANSWERS, NOT_FOUND = ("not_found", "already_completed", "cancelling"), 0
ANSWER = "request_id long, run_id long, answer string"
RUN = "key long, run_id long, started_ms long, ended_ms long, n_events long, status string, steps string, over_cap boolean"
MESSAGE = "thread_id long, message_id string, position long, seq long, role string, content string"


def _table(rows: list[tuple], columns: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in columns.split(",")])


class Runs:
    """Runs of a key: one begins with an event while none is open; an end event or the time limit closes it.

    Keys are dealt into buckets, whose rows and state travel in Arrow batches; a call has a cost of its own that many keys share. Events
    wait in the state until the watermark passes them, then they are taken in order of time. The bucket's one timeout stands at the
    earliest waiting event or open run's limit; a run without a further event is closed by the latter."""

    STATE = "open array<long>, run_id array<long>, started_ms array<long>, steps array<array<string>>, key array<long>, ms array<long>, event_id array<long>, kind array<string>"

    def __init__(self, limit_ms: int, steps: int):
        self.limit_ms, self.cap = limit_ms, steps

    def __call__(self, bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        came = [r for p in rows for r in zip(*(p[c].tolist() for c in ("key", "ms", "event_id", "kind")), strict=True)]
        if pd.isna(bucket[0]):
            return
        now, limit, runs, closed = state.getCurrentWatermarkMs(), self.limit_ms, {}, []
        if state.exists:
            open_keys, run_ids, starts, steps, *old = state.get
            runs = {k: (i, s, list(kinds)) for k, i, s, kinds in zip(open_keys, run_ids, starts, steps, strict=True)}
            came += zip(*old, strict=True)

        def close(key: int, ended_ms: int, status: str) -> None:
            run_id, started_ms, steps = runs.pop(key)
            kinds = [k for k in steps if k is not None]
            closed.append((key, run_id, started_ms, ended_ms, len(steps), status, ">".join(kinds) if kinds else None, len(steps) > self.cap))

        for key, ms, event_id, kind in sorted((r for r in came if r[1] <= now), key=lambda r: (r[1], r[2], r[3] or "")):
            if key in runs and ms > runs[key][1] + limit:
                close(key, runs[key][1] + limit, "timeout")
            runs.setdefault(key, (event_id, ms, []))[2].append(kind)
            if kind in ENDS:
                close(key, ms, ENDS[kind])
        for key, ended_ms in [(k, r[1] + limit) for k, r in runs.items() if r[1] + limit <= now]:
            close(key, ended_ms, "timeout")
        later = [r for r in came if r[1] > now]
        if runs or later:
            state.update((list(runs), *([r[c] for r in runs.values()] for c in range(3)), *([r[c] for r in later] for c in range(4))))
            # a timeout passes when the watermark is beyond it
            state.setTimeoutTimestamp(max(min([r[1] for r in later] + [r[1] + limit for r in runs.values()]), now, 1))
        elif state.exists:
            state.remove()
        if closed:
            yield _table(closed, RUN)


class Answers:
    """Answers to the requests of a bucket of runs, once the watermark has passed them.

    Rows of both streams are (run, at in microseconds, id, code): a request's code is below 0 and tells what is null in it, a run's is
    the number of its answer. Those that wait, and the runs within the horizon, are one array of numbers in the state: a row of it
    costs 32 bytes, where a join's state keeps two entries with their keys."""

    STATE = "rows binary"

    def __init__(self, horizon: str):
        self.horizon = pd.Timedelta(horizon) // pd.Timedelta(microseconds=1)

    def __call__(self, bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [p[["run", "at", "id", "code"]].to_numpy("int64") for p in rows]
        if state.exists:
            parts.append(np.frombuffer(state.get[0], "int64").reshape(-1, 4))
        both, now = np.concatenate(parts), state.getCurrentWatermarkMs() * 1000
        asks = both[:, 3] < 0
        due = both[asks & (both[:, 1] <= now)]
        if len(due):
            yield self.answered(due, both[~asks])
        left = both[np.where(asks, both[:, 1] > now, both[:, 1] > now - self.horizon)]
        if len(left):
            waiting = left[left[:, 3] < 0, 1]
            until = waiting.min() if len(waiting) else left[:, 1].max() + self.horizon
            state.update((left.tobytes(),))
            state.setTimeoutTimestamp(max(int(until) // 1000, now // 1000, 1))
        elif state.exists:
            state.remove()

    def answered(self, due: np.ndarray, known: np.ndarray) -> pd.DataFrame:
        known = known[np.argsort(known[:, 0], kind="stable")]
        first, last = (np.searchsorted(known[:, 0], due[:, 0], side) for side in ("left", "right"))
        gaps = -1 - due[:, 3]
        n = np.where(gaps & 1, 0, last - first)  # a request without a run meets none
        ask = np.repeat(np.arange(len(due)), n)
        run = np.arange(len(ask)) - np.repeat(np.cumsum(n) - n, n) + first[ask]
        ago = due[ask, 1] - known[run, 1]
        met = (ago >= 0) & (ago <= self.horizon)
        ask, run = ask[met], run[met]
        alone = np.setdiff1d(np.arange(len(due)), ask)
        ask, code = np.concatenate([ask, alone]), np.concatenate([known[run, 3], np.full(len(alone), NOT_FOUND)])
        ids = [pd.array(due[ask, c], "Int64") for c in (2, 0)]
        for values, bit in zip(ids, (2, 1), strict=True):
            values[(gaps[ask] & bit) > 0] = pd.NA
        return pd.DataFrame({"request_id": ids[0], "run_id": ids[1], "answer": np.array(ANSWERS, object)[code]})


class Threads(StatefulProcessor):
    """Messages of a thread by id: the last one (by seq) counts, at the place of the first. A message that isn't written for ttl_ms is forgotten."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getMapState("messages", "message_id string", "position long, seq long, role string, content string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[str, tuple] = {}
        for page in rows:
            for message, seq, role, content in page[["message_id", "seq", "role", "content"]].itertuples(index=False):
                old = changed.get(message)
                if old is None and self.messages.containsKey((message,)):
                    old = tuple(self.messages.getValue((message,)))
                seq = int(seq)
                if old is None:
                    changed[message] = (seq, seq, role, content)
                else:
                    changed[message] = (min(old[0], seq), *((seq, role, content) if seq >= old[1] else old[1:]))
        for message, value in changed.items():
            self.messages.updateValue((message,), value)
        if changed:
            yield _table([(int(key[0]), m, *v) for m, v in changed.items()], MESSAGE)

    def close(self) -> None:
        pass


def replayed(rows: DataFrame, ts: str, after_ms: int = 0, slices: int = 4, closing: dict | None = None) -> tuple[str, int]:
    """(folder, delay in ms): rows with a timestamp column as files, slice after slice of time, and a last row, null but for its time and `closing`.

    Slices are written one after another, because files are read in the order of their times. With the delay as watermark no row is
    late, however files fall into batches; the last row's time moves the watermark to `after_ms` past the last event. It has to get past
    the filters in front of the watermark, so a join needs a key in it that no row has. Rows without a time are left out."""
    spark = rows.sparkSession
    ms = F.unix_millis(ts)
    first, last = rows.agg(F.min(ms), F.max(ms)).first()
    first, last = (0, 0) if first is None else (first, last)
    width, folder = (last - first) // slices + 1, new_path(spark, "replay")
    for k in range(slices):
        rows.filter(((ms - first) / width).cast("long") == k).write.mode("append").parquet(folder)
    values = [F.timestamp_millis(F.lit(last + width + after_ms + 1)) if c == ts else F.lit((closing or {}).get(c)).cast(t) for c, t in rows.dtypes]
    spark.range(1).select(*[v.alias(c) for v, c in zip(values, rows.columns, strict=True)]).coalesce(1).write.mode("append").parquet(folder)
    return folder, width


def replay(spark: SparkSession, folder: str, schema, batches: int = 5) -> DataFrame:
    """The stream of a replayed folder in about so many batches, two files each at least. Every batch goes through the keys' state, so
    their number must not grow with the table."""
    files = sum(n.startswith("part-") for n in names(spark, folder))
    return source(spark, folder, schema, max(2, -(-files // batches)))


def source(spark: SparkSession, folder: str, schema, files_at_once: int = 2) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def runs_of(events: DataFrame, delay_ms: int, limit_ms: int = 900_000, steps: int = 100) -> DataFrame:
    """Closed runs of a stream (key, event_id, ts, kind), each once. Rows without a key only move the watermark."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    bucket = F.when(F.col("key").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    timed = events.withWatermark("ts", f"{delay_ms} milliseconds").withColumns({"ms": F.unix_millis("ts"), "bucket": bucket})
    return timed.groupBy("bucket").applyInPandasWithState(Runs(limit_ms, steps), RUN, Runs.STATE, "append", "EventTimeTimeout")


def threads_of(messages: DataFrame, ttl_ms: int = 7 * 86_400_000) -> DataFrame:
    """Changes of a stream of messages (thread_id, message_id, seq, role, content): every batch gives the messages that it wrote."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return messages.filter("thread_id is not null").groupBy("thread_id").transformWithStateInPandas(Threads(ttl_ms), MESSAGE, "Update", "ProcessingTime")


def cancel_answers(requests: DataFrame, runs: DataFrame, requests_delay_ms: int, runs_delay_ms: int, horizon: str = "7 days") -> DataFrame:
    """Answers to a stream of cancel requests (request_id, run_id, asked_at) by a stream of run states (run_id, ts, status).

    A run is known from its ts on, for as long as the horizon. An answer comes when the watermark, the earlier of both streams',
    has passed its request; a request that arrives behind the watermark is late and gets none, and so does a run's state.
    A run with several states in the horizon answers once for each. Rows without a time have no place in either stream."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    asked = requests.withWatermark("asked_at", f"{requests_delay_ms} milliseconds")
    known = runs.withWatermark("ts", f"{runs_delay_ms} milliseconds")
    # nulls are told by the code, so the other columns are whole numbers in pandas too
    gaps = F.when(F.col("request_id").isNull(), F.lit(2)).otherwise(0) + F.when(F.col("run_id").isNull(), F.lit(1)).otherwise(0)
    code = F.when(F.col("status").isNull(), NOT_FOUND).when(F.col("status").isin(*ENDS), ANSWERS.index("already_completed")).otherwise(ANSWERS.index("cancelling"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    left = asked.filter("asked_at is not null").select(F.col("asked_at").alias("ts"), number("run_id").alias("run"), number("request_id").alias("id"), (-1 - gaps).cast("long").alias("code"))
    right = known.filter("ts is not null and run_id is not null").select("ts", F.col("run_id").cast("long").alias("run"), F.lit(0).cast("long").alias("id"), code.cast("long").alias("code"))
    both = left.unionByName(right).withColumns({"at": F.unix_micros("ts"), "bucket": F.pmod(F.xxhash64("run"), F.lit(BUCKETS))})
    return both.groupBy("bucket").applyInPandasWithState(Answers(horizon), ANSWER, Answers.STATE, "append", "EventTimeTimeout")
