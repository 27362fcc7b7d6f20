"""Suffix-array dedup: remove every byte that a repeated string of LENGTH bytes covers.

Windows of LENGTH bytes are dealt to tasks so that equal ones meet: each has a minimizer (see
windows.py), and consecutive windows with one minimizer travel as a run. Runs whose minimizer occurs
once hold no repeat. Equal runs travel as one, with their number as weight. All others are decided by
a Burrows-Wheeler transform over the distinct runs of many minimizers, expanded breadth-first up to
LENGTH (see bwt.py). Consecutive runs of a text whose minimizers have no other run overlap by a window;
they go through the transform as one piece.

Where many different runs share a minimizer (the edges of a passage in very many documents), they are
dealt again, window by window, by a finer key: a hash of the whole window. What stands once under
that key holds no repeat; of the rest one copy, with its weight, goes through the same transform.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.base import PIECE_BYTES, small_batches, written
from redpen.llm.bwt import repeated_starts
from redpen.llm.textvec import U64, Prefix, mix
from redpen.llm.windows import Runs

LENGTH, GRAM = 400, 160
#: Different runs of one minimizer beyond which they are dealt again by a finer key, so that no task gets more of them.
DEALT = 2_000
#: Bytes up to which consecutive runs of a text that no different run can equal are transformed as one piece.
_JOINED = 64 << 10
#: Bytes of runs that are transformed at once.
_COMPARED_BYTES = 640 << 10
#: Longer texts are looked through in parts that overlap by a window.
_PART = 8 << 20


def _parts(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(rows, offsets, texts) of about PIECE_BYTES each."""
    rows, offsets, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), _PART):
            part = t if len(t) <= _PART else t[at : at + _PART + length - 1]
            if held and size + len(part) > PIECE_BYTES:
                yield rows, offsets, held
                rows, offsets, held, size = [], [], [], 0
            rows.append(i)
            offsets.append(at)
            held.append(part)
            size += len(part)
    if held:
        yield rows, offsets, held


def runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, first, count, at, key, body): every window of every text is in one run."""
    small_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row")
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for rows, offsets, part in _parts(texts, length):
                r = Runs(part, length, gram)
                body = mix(r.body + mix((r.at * 4096 + r.count).astype(U64)))
                first = r.first + np.array(offsets, np.int64)[r.doc]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.array(rows, np.int64)[r.doc])), pa.array(first), pa.array(r.count.astype(np.int32)), pa.array(r.at.astype(np.int32)), pa.array(r.key.view(np.int64)), pa.array(body.view(np.int64))],
                    ["row", "first", "count", "at", "key", "body"],
                )

    return docs.select("row", "text").mapInArrow(find, "row string, first long, count int, at int, key long, body long")


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _span_column(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in spans] for spans in found], _SPANS)


_PIECE = "key long, weight long, bytes binary, parts array<struct<key:long,body:long,at:int,count:int>>"
_PARTS = pa.list_(pa.struct([("key", pa.int64()), ("body", pa.int64()), ("at", pa.int32()), ("count", pa.int32())]))


def _piece_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), _PARTS)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["key", "weight", "bytes", "parts"])


def compared(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, body, spans) of the runs with repeated windows. Pieces are texts with their weight and the runs that they consist of."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weight, text, parts, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            flags = repeated_starts(text, np.array(weight, np.float64), length)
            hit = [(p["key"], p["body"], f[p["at"] : p["at"] + p["count"]]) for f, own in zip(flags, parts, strict=True) for p in own]
            hit = [h for h in hit if h[2].any()]
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in hit], pa.int64()), pa.array([h[1] for h in hit], pa.int64()), _span_column([_spans(h[2]) for h in hit])], ["key", "body", "spans"])

        for batch in batches:
            for k, w, t, own in zip(*(batch.column(c).to_pylist() for c in ("key", "weight", "bytes", "parts")), strict=True):
                if size > _COMPARED_BYTES and k != keys[-1]:  # runs of one minimizer stay together
                    yield flush()
                    keys, weight, text, parts, size = [], [], [], [], 0
                keys.append(k)
                weight.append(w)
                text.append(t)
                parts.append(own)
                size += len(t)
        if keys:
            yield flush()

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(expand, "key long, body long, spans array<struct<a:int,b:int>>")


def _fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Pieces of the wanted runs (row, first, count, at, key, body, weight, alone); a text's runs go to it as one list."""
    lists = wanted.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "count", "key", "body", "weight", "alone"))).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, want in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                groups: list[list[dict]] = []
                for w in want:
                    last = groups[-1] if groups else None
                    if last and w["alone"] and last[0]["alone"] and last[-1]["first"] + last[-1]["count"] == w["first"] and w["first"] - last[0]["first"] < _JOINED:
                        last.append(w)
                    else:
                        groups.append([w])
                for g in groups:
                    first = g[0]["first"]
                    own = [{"key": w["key"], "body": w["body"], "at": w["first"] - first, "count": w["count"]} for w in g]
                    out.append((g[0]["key"], min(w["weight"] for w in g), text[first : g[-1]["first"] + g[-1]["count"] + length - 1], own))
            yield _piece_rows(out)

    return docs.select("row", "text").join(lists, "row").select("text", "wanted").mapInArrow(cut, _PIECE)


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One row for each window of each piece (of one run): the run, the window's start in it and its hash as a pair."""
    for batch in batches:
        for w, t, own in zip(*(batch.column(c).to_pylist() for c in ("weight", "bytes", "parts")), strict=True):
            raw = np.frombuffer(t, np.uint8)
            at = np.arange(len(raw) - length + 1)
            one, two = Prefix(raw).of(at, at + length), Prefix(raw[::-1]).of(len(raw) - at - length, len(raw) - at)
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, own[0]["key"])), pa.array(np.full(n, own[0]["body"])), pa.array(np.full(n, w)), pa.array(at.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["key", "body", "weight", "a", "one", "two"])


def _cut_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The windows that are asked for (a run's `wanted`), as pieces under their finer keys."""
    for batch in batches:
        yield _piece_rows([(w["one"], w["n"], t[w["a"] : w["a"] + length], [{"key": w["one"], "body": w["two"], "at": 0, "count": 1}]) for t, want in zip(batch.column("bytes").to_pylist(), batch.column("wanted").to_pylist(), strict=True) for w in want])


def compared_finer(pieces: DataFrame, length: int) -> DataFrame:
    """(key, body, spans) as compared() gives, for runs of minimizers with too many different ones (pieces of one run each)."""
    windows = written(pieces.mapInArrow(lambda x: _windows(x, length), "key long, body long, weight long, a int, one long, two long"), "windows")
    stands = windows.groupBy("one", "two").agg(F.sum("weight").alias("n"), F.min(F.struct("key", "body", "a")).alias("where")).filter("n > 1")
    wanted = stands.groupBy("where.key", "where.body").agg(F.collect_list(F.struct("one", "two", "n", "where.a")).alias("wanted"))  # a run has few windows
    copies = pieces.select("key", F.col("parts")[0]["body"].alias("body"), "bytes").join(wanted, ["key", "body"]).select("bytes", "wanted").mapInArrow(lambda x: _cut_windows(x, length), _PIECE)
    found = compared(copies, length).select(F.col("key").alias("one"), F.col("body").alias("two"))
    return windows.join(found, ["one", "two"], "left_semi").groupBy("key", "body").agg(F.transform(F.collect_list("a"), lambda a: F.struct(a.alias("a"), (a + 1).alias("b"))).alias("spans"))


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = DEALT) -> DataFrame:
    """(row, first, spans): runs with repeated windows; spans are [a, b) window starts after the run's first."""
    every = written(runs(docs, length, gram), "runs")
    # as a table of its own, so that the join deals both sides itself and can split a frequent key
    twice = written(every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "twice")
    shared = written(every.join(twice, "key", "left_semi"), "shared")

    one = F.min(F.struct("row", "first", "count", "at")).alias("one")
    contexts = shared.groupBy("key", "body").agg(F.count("*").alias("weight"), one)
    contexts = written(contexts.select("key", "body", "weight", "one.*"), "contexts")
    kinds = written(contexts.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "kinds")
    known = contexts.join(kinds, "key", "left").withColumn("alone", F.col("kinds").isNull())
    verdict = compared(_fetch(docs, known.filter(F.coalesce("kinds", F.lit(1)) <= most), length), length)
    if kinds.filter(F.col("kinds") > most).limit(1).count():
        verdict = verdict.unionByName(compared_finer(written(_fetch(docs, known.filter(F.col("kinds") > most), length), "many-texts"), length))
    return shared.join(written(verdict, "verdict"), ["key", "body"]).select("row", "first", "spans")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = DEALT, keep: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs, and its columns named in carry.

    With keep also kept (binary), kept_text (without the bytes of characters that were cut) and spans.
    Matches are judged on the input as it is and never cross texts. Null text is empty; texts shorter than
    `length` keep everything; repeated rows are texts of their own, so they remove each other; other columns
    are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    named = docs.select("doc_id", "text", *carry)
    repeats = named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if repeats.limit(1).count():
        named = written(named.withColumn("row", F.expr("uuid()")), "named")
    else:
        named = named.withColumn("row", F.col("doc_id").cast("string"))
    found = repeated_runs(named.select("row", "text"), length, gram, most)
    bounds = F.transform("spans", lambda s: F.struct((F.col("first") + s["a"]).alias("a"), (F.col("first") + s["b"] + length - 1).alias("b")))
    lists = found.select("row", F.explode(bounds).alias("s")).groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    passed = ["doc_id", *carry]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.list_(pa.list_(pa.int64()))][: 7 if keep else 4]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_kept(t or b"", s or []) for t, s in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], [*passed, *_COLUMNS[: len(kinds)]])

    types = dict(docs.dtypes)
    schema = ", ".join([f"doc_id {kind}", *(f"{c} {types[c]}" for c in carry), "n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    rows = named.join(lists, "row", "left").select(*passed, "text", "spans")
    return rows.mapInArrow(finish, schema + (", kept binary, kept_text string, spans array<array<long>>" if keep else ""))


_COLUMNS = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text", "spans"]


def _kept(text: bytes, spans: list[dict]) -> tuple:
    merged: list[list[int]] = []
    for s in spans:
        if merged and s["a"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["b"])
        else:
            merged.append([s["a"], s["b"]])
    parts, at = [], 0
    for a, b in merged:
        parts.append(text[at:a])
        at = b
    kept = b"".join([*parts, text[at:]])
    return (len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "ignore"), merged)
