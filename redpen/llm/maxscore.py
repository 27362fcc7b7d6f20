"""Exact top-k by inner product: MaxScore over shards of term lists.

A term is a component. A shard has one list for each term (the values of its vectors, in their order) and the
least and largest value in it, so a query knows how much a term can add to a score at most: its bound. With a
threshold (the k-th best score of the shards before) a query's terms, least bound first, are non-essential as long
as their bounds together stay under it; the others are essential. Essential lists are traversed for a block of
queries at once, in one product in which non-essential weights are 0. Vectors that still can reach the threshold
are probed in the non-essential lists, largest bound first, and dropped as soon as they can't; what remains has
its exact score. Scores equal to the threshold stay, so ties are decided by vec_id.

Shards are searched in rounds, each GROWTH times as many as before; a shard's best are merged by a ranking that
Spark cuts down before the shuffle. Equal vectors are one candidate with their k + 1 least ids, of which no more can
be among the k best of any query, and equal queries are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redpen.llm.base import written
from redpen.llm.drift import LONGEST, finite, packed_ints, scaled

#: Vectors of a shard, queries of a block, and terms probed between two checks.
SHARD, BLOCK, PROBED = 16_384, 256, 4
GROWTH = 16
NO_SCORE = -LONGEST - 1


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of long; shorter ones are filled up with 0, which adds nothing to any score."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy()
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _shards(vectors: DataFrame, count: int) -> DataFrame:
    """(shard, ids, lists, width, terms): one row for each of `count` shards that has vectors; lists is term after term."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            table = pa.Table.from_batches(got).combine_chunks()
            x = _matrix(table.column("v").combine_chunks())
            ids = np.array(table.column("vec_id").to_numpy())
            lists, width = packed_ints(np.ascontiguousarray(x.T))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([lists], pa.binary()), pa.array([width], pa.int32()), pa.array([x.shape[1]], pa.int32())], ["shard", "ids", "lists", "width", "terms"])

    return vectors.select("vec_id", "v").repartition(count).mapInArrow(pack, "shard int, ids binary, lists binary, width int, terms int")


def _query_blocks(queries: DataFrame) -> DataFrame:
    """(block, qnos, least, weights, width, terms): queries (qno, least, v) in blocks; least is the score that a candidate has to reach."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                some = batch.slice(lo, BLOCK)
                qnos = some.column("qno").to_numpy()
                x = _matrix(some.column("v"))
                weights, width = packed_ints(x)
                yield pa.RecordBatch.from_arrays([pa.array(qnos[:1]), pa.array([qnos.astype("<i8").tobytes()], pa.binary()), pa.array([some.column("least").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([weights], pa.binary()), pa.array([width], pa.int32()), pa.array([x.shape[1]], pa.int32())], ["block", "qnos", "least", "weights", "width", "terms"])

    return queries.select("qno", "least", "v").mapInArrow(pack, "block long, qnos binary, least binary, weights binary, width int, terms int")


def _exact_kind(weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> type:
    """A number type in which every partial score is exact: single or double precision, or Python's integers."""
    if not weights.size:
        return np.float32
    largest = np.maximum(np.abs(low.astype(object)), np.abs(high.astype(object)))
    most = int((np.abs(weights.astype(object)) * largest).sum(1).max())
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def search(weights: np.ndarray, least: np.ndarray, lists: np.ndarray, ids: np.ndarray, k: int, counted: dict | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores): for each query of a block its best k of a shard that reach its least score.

    weights has a row for each query, lists a row for each term. `counted` gets how many values were probed and how many a
    full scan has."""
    terms = min(weights.shape[1], len(lists))
    weights, lists = weights[:, :terms], lists[:terms]
    low, high = (lists.min(1), lists.max(1)) if lists.size else (np.zeros(terms, np.int64),) * 2
    kind = _exact_kind(weights, low, high)
    weights, lists, low, high = (x.astype(kind) for x in (weights, lists, low, high))
    # what a term adds at most
    bounds = np.maximum(weights * low[None], weights * high[None])
    order = np.argsort(bounds.astype(np.float64), axis=1, kind="stable")
    together = np.cumsum(np.take_along_axis(bounds, order, 1).astype(object if kind is object else np.float64), axis=1)
    limits = np.where(least == NO_SCORE, -np.inf, least.astype(object if kind is object else np.float64))  # a score at a long's limit may stand for less
    essential = np.zeros(weights.shape, bool)
    np.put_along_axis(essential, order, together >= limits[:, None], 1)
    scores = np.where(essential, weights, kind(0) if kind is not object else 0) @ lists
    for q in range(len(weights)):
        spare = [t for t in order[q][::-1] if not essential[q, t]]
        rest = sum(bounds[q, t] for t in spare)
        known = scores[q]
        at = np.flatnonzero(known + rest >= limits[q])
        known = known[at]
        probed = 0
        for lo in range(0, len(spare), PROBED):
            if not len(at):
                break
            now = spare[lo : lo + PROBED]
            known = known + weights[q, now] @ lists[np.ix_(now, at)]
            probed += len(now) * len(at)
            rest -= sum(bounds[q, t] for t in now)
            stays = known + rest >= limits[q]
            at, known = at[stays], known[stays]
        if counted is not None:
            counted["probed"] = counted.get("probed", 0) + probed
            counted["traversed"] = counted.get("traversed", 0) + int(essential[q].sum()) * lists.shape[1]
            counted["all"] = counted.get("all", 0) + terms * lists.shape[1]
        if kind is object:
            known = np.array([min(max(int(s), NO_SCORE), LONGEST) for s in known], object)
        if len(at) > k:
            floor = np.sort(known)[-k] if kind is object else np.partition(known, len(at) - k)[len(at) - k]
            at, known = at[known >= floor], known[known >= floor]
            best = np.lexsort((ids[at], -known))[:k] if kind is not object else sorted(range(len(at)), key=lambda i: (-known[i], ids[at[i]]))[:k]
            at, known = at[best], known[best]
        yield q, ids[at], known.astype(np.int64)


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """(qno, vec_id, score) of pairs of a query block and a shard."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                lists = np.frombuffer(row["lists"], f"<i{row['width']}").reshape(row["terms"], len(ids))
                qnos, least = np.frombuffer(row["qnos"], "<i8"), np.frombuffer(row["least"], "<i8")
                weights = np.frombuffer(row["weights"], f"<i{row['q_width']}").reshape(len(qnos), row["q_terms"])
                found = list(search(weights, least, lists, ids, k))
                counts = [len(f[1]) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qnos, counts)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["qno", "vec_id", "score"])

    return pairs.mapInArrow(find, "qno long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qno").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, shard: int = SHARD, growth: int = GROWTH) -> DataFrame:
    """The operator: (query_id, rank, vec_id, score), the k best vectors for every query, a row whose vec_id is divisible by `every`.

    A vector that is null or holds a null or non-finite component takes no part, nor does a row without vec_id. Vectors may
    have different lengths (a missing component is 0, so an empty vector scores 0). Rows with equal vec_id and vector are one
    row; rows that share only their vec_id are all candidates and all queries, but not for each other. A component beyond a
    long is a long's limit, and so is a score. Further columns are ignored; without vectors, or without queries, no rows.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    valid = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite(F.col("embedding")))
    rows = valid.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v"))
    queries = written(rows.filter(F.col("vec_id") % every == 0).distinct(), "queries")
    different = written(queries.select("v").distinct().withColumn("qno", F.monotonically_increasing_id()), "different")
    same = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    candidates = written(rows.distinct().withColumn("nth", same).filter(F.col("nth") <= k + 1).drop("nth"), "candidates")
    shards = max(1, -(-candidates.count() // shard))
    index = written(_shards(candidates, shards), "shards")
    blocks = max(1, -(-different.count() // BLOCK))

    best, lo, hi = None, 0, 1
    while lo < shards:
        hi = min(hi, shards)
        # below k + 1 results everything may still be among the best
        reached = different.withColumn("least", F.lit(NO_SCORE)) if best is None else different.join(best.groupBy("qno").agg(F.when(F.count("*") > k, F.min("score")).alias("least")), "qno", "left").withColumn("least", F.coalesce("least", F.lit(NO_SCORE)))
        todo = _query_blocks(reached.coalesce(blocks)).withColumnsRenamed({"width": "q_width", "terms": "q_terms"})
        # each block begins at another shard
        todo = todo.withColumn("shard", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))).withColumn("shard", F.pmod(F.col("shard") + F.xxhash64("block"), F.lit(shards)).cast("int"))
        found = _searched(todo.join(index, "shard"), k + 1)
        best = written(_best(found if best is None else found.unionByName(best), k + 1), "best")
        lo, hi = hi, hi * growth

    lists = best.groupBy("qno").agg(F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("under"), "vec_id", "score"))).alias("best"))
    answers = different.join(lists, "qno").select("v", "best")
    named = queries.select(F.col("vec_id").alias("query_id"), "v").join(answers, "v")
    # the query's own row is the candidate with its id and its own product; of two such rows either may go
    product = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda a, x: a + x.cast("decimal(19,0)") * x.cast("decimal(19,0)"))
    itself = F.least(F.coalesce(product, F.lit(LONGEST)), F.lit(LONGEST)).cast("long")
    at = F.array_position(F.transform("best", lambda b: (b["vec_id"] == F.col("query_id")) & (b["score"] == F.col("itself"))), True)
    others = F.slice(F.filter("best", lambda b, i: i + 1 != F.col("own")), 1, k)
    return named.withColumn("itself", itself).withColumn("own", at).select("query_id", F.posexplode(others).alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
