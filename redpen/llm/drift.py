"""Exact Lloyd clustering with bounds that are loosened by geometry.

A vector carries an upper bound of the distance to its centroid and a lower bound for every centroid. When a
centroid moves from c to d, a lower bound falls by |c - d| at most. Points x with |x - c| - |x - d| >= 2a lie inside one
branch of a hyperbola with foci c and d, hence inside its asymptotes' cone: seen from the middle of c and d, the angle
from the move to x obeys cos(angle) >= 2a / |c - d|. What is known of a vector bounds that angle in the plane of its own
centroid, c and d: it lies in the sphere about its own centroid as wide as its upper bound, on its own side of the
plane half-way to c, and the farther from it the larger its lower bound for c is. So bounds fall by less than the
move. Vectors whose bounds overlap are measured against all centroids in whole numbers.

Vectors lie in blocks of BLOCK, a row each. Every pass over the blocks is written to the shared folder with the
change of each centroid's sum, of which Spark adds up one number for each centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.llm.base import new_path, remove, written

BLOCK = 4096
LONGEST = (1 << 63) - 1
#: Bounds are kept in single precision, widened by this share, far more than any rounding.
SLACK = 1e-6
STATE = "ids array<bigint>, x binary, width int, cluster binary, upper binary, lower binary, delta array<decimal(38,0)>, scanned long, measured long"


def finite(v: Column) -> Column:
    """No component is null or not finite."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))


def scaled(v: Column, by: int) -> Column:
    """floor(by * x) of every component, x as double; beyond a long, a long's limits."""
    return F.transform(v, lambda x: F.floor(F.lit(float(by)) * x.cast("double")))


def packed_ints(x: np.ndarray) -> tuple[bytes, int]:
    """The narrowest of 2, 4 and 8 byte integers that hold x, and their width."""
    most = int(max(-int(x.min()), int(x.max()))) if x.size else 0
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return x.astype(f"<i{width}").tobytes(), width


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c: in doubles or longs while they hold them, else in Python's integers."""
    most = int(max([np.abs(x.astype(object)).max() if x.size and x.dtype == np.int64 else np.abs(x.astype(np.int64)).max() if x.size else 0, *(abs(int(v)) for v in c.ravel())]))
    room = 4 * most * most * max(1, x.shape[1])
    if room < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    x, c = x.astype(object), c.astype(object)
    return np.array([[int(((row - mid) ** 2).sum()) for mid in c] for row in x], object).reshape(len(x), len(c))


def loosening(old: np.ndarray, new: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """[x, j]: by how much the distance of vector x to centroid j can shrink at most when j moves from old to new.

    cluster, upper and lower are those of the vectors before the move. In the plane of i (a vector's own centroid), j and the
    new j, with i at the origin and j at (far, 0), the vector lies in the disk of radius upper, and, being nearer to i than
    to j, at most `side` along the line to j. Seen from the middle of the move that region begins at the corner (side, reach)."""
    move = new - old
    drift = np.sqrt((move * move).sum(1))
    full = np.broadcast_to(drift, lower.shape)
    way = old[None] - old[:, None]
    far = np.sqrt((way * way).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        along = (way * move[None]).sum(2) / far
        aside = np.sqrt(np.maximum(0, drift[None] ** 2 - along**2))
        far, along, aside = (x[cluster] for x in (far, along, aside))
        u = upper[:, None]
        middle = (far + along / 2, aside / 2)
        # the sphere as a whole: the angle to its middle less the angle that it fills
        gap = np.sqrt(middle[0] ** 2 + middle[1] ** 2)
        angle = np.arccos(np.clip(-(middle[0] * along + middle[1] * aside) / (gap * drift), -1, 1))
        whole = np.where(u < gap, np.cos(np.maximum(0, angle - np.arcsin(np.clip(u / gap, 0, 1)))), 1)
        # the part of it on this side of the line between both centroids
        side = np.minimum(far / 2, (far**2 + u**2 - lower**2) / (2 * far))
        reach = np.where(side < 0, np.sqrt(np.maximum(0, u**2 - side**2)), u)
        corner = (side - middle[0], reach - middle[1])
        size = np.sqrt(corner[0] ** 2 + corner[1] ** 2)
        beside = (corner[0] < 0) & (corner[1] > 0) & (along * size > corner[0] * drift)
        cut = np.where(beside, (corner[0] * along + corner[1] * aside) / (size * drift), 1)
        share = np.minimum(whole, cut) + SLACK
        return np.where(np.isfinite(share) & (far > 0) & (drift > 0), full * np.clip(share, 0, 1), full)


def _assigned(x: np.ndarray, centroids: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, before: np.ndarray | None, geometric: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(cluster, upper, lower, vectors measured against all centroids, against their own) of a block."""
    k, n = len(centroids), len(x)
    mids = centroids.astype(np.float64)
    if state is None:
        cluster, upper, lower = np.zeros(n, np.int64), np.zeros(n), np.zeros((n, k))
        unsure, tried = np.arange(n), 0
    else:
        cluster, upper, lower = state
        old = before.astype(np.float64)
        drift = np.sqrt(((mids - old) ** 2).sum(1))
        less = loosening(old, mids, cluster, upper, lower) if geometric else np.broadcast_to(drift, (n, k))
        upper = (upper + drift[cluster]) * (1 + SLACK)
        lower = np.maximum(0, lower * (1 - SLACK) - less * (1 + SLACK))
        rest = lower.copy()
        rest[np.arange(n), cluster] = np.inf
        rest = rest.min(1)
        unsure = np.flatnonzero(upper >= rest)
        tried = len(unsure)
        for c in range(k):
            at = unsure[cluster[unsure] == c]
            if len(at):
                upper[at] = np.sqrt(_squares(x[at], centroids[c : c + 1])[:, 0].astype(np.float64)) * (1 + SLACK)
        unsure = unsure[upper[unsure] >= rest[unsure]]
    if len(unsure):
        exact = _squares(x[unsure], centroids)
        best = np.argmin(exact, 1)
        roots = np.sqrt(exact.astype(np.float64))
        cluster = cluster.copy()
        cluster[unsure] = best
        upper[unsure] = roots[np.arange(len(unsure)), best] * (1 + SLACK)
        lower[unsure] = roots * (1 - SLACK)
    return cluster, upper, lower, len(unsure), tried


def _sums(x: np.ndarray, cluster: np.ndarray, was: np.ndarray | None, k: int) -> list[int]:
    """For each centroid the change of its components' sums and of its count."""
    found = []
    moved = np.arange(len(x)) if was is None else np.flatnonzero(cluster != was)
    rows = x[moved].astype(object if x.dtype == np.int64 else np.int64)
    for c in range(k):
        now = cluster[moved] == c
        came, went = rows[now], rows[was[moved] == c] if was is not None else rows[:0]
        found += [int(v) for v in came.sum(0) - went.sum(0)] if len(rows) else [0] * x.shape[1]
        found.append(len(came) - len(went))
    return found


def _x(row: dict, dims: int) -> np.ndarray:
    return np.frombuffer(row["x"], f"<i{row['width']}").reshape(-1, dims)


def _blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """Vectors (vec_id, v) in blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                some = batch.slice(lo, BLOCK)
                x, width = packed_ints(some.column("v").flatten().to_numpy().reshape(-1, dims))
                yield pa.RecordBatch.from_arrays([pa.array([some.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([x], pa.binary()), pa.array([width], pa.int32())], ["ids", "x", "width"])

    return vectors.mapInArrow(pack, "ids array<bigint>, x binary, width int")


def _passed(blocks: DataFrame, centroids: np.ndarray, before: np.ndarray | None, geometric: bool) -> DataFrame:
    """Every block assigned to the centroids, with the change of sums since the pass before."""
    k, dims = centroids.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _x(row, dims)
                state = None
                if before is not None:
                    state = (np.frombuffer(row["cluster"], "u1").astype(np.int64), np.frombuffer(row["upper"], "<f4").astype(np.float64), np.frombuffer(row["lower"], "<f4").reshape(-1, k).astype(np.float64))
                cluster, upper, lower, scanned, tried = _assigned(x, centroids, state, before, geometric)
                delta = _sums(x, cluster, None if state is None else state[0], k)
                # rounding to single precision goes outwards
                wide, low = (upper * (1 + SLACK)).astype("<f4"), (lower * (1 - SLACK)).astype("<f4")
                values = [row["ids"], row["x"], row["width"], cluster.astype("u1").tobytes(), wide.tobytes(), low.tobytes(), delta, scanned, tried]
                kinds = [pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.decimal128(38, 0)), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["ids", "x", "width", "cluster", "upper", "lower", "delta", "scanned", "measured"])

    return blocks.mapInArrow(step, STATE)


def _distances(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector of assigned blocks."""
    dims = centroids.shape[1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["ids", "x", "width", "cluster"]).to_pylist():
                x, cluster = _x(row, dims), np.frombuffer(row["cluster"], "u1")
                found = np.zeros(len(x), np.int64)
                for c in np.unique(cluster):
                    at = np.flatnonzero(cluster == c)
                    found[at] = [min(int(v), LONGEST) for v in _squares(x[at], centroids[c : c + 1])[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(found)], ["vec_id", "cluster", "distance"])

    return blocks.select("ids", "x", "width", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: int = 3, geometric: bool = True, seen: list | None = None) -> DataFrame:
    """The operator: vectors (vec_id, embedding) after `rounds` rounds of Lloyd's algorithm from k centroids.

    Vectors that are null, have another length than dims, or hold a null or non-finite component are left out. A component
    is floor(scale * x); beyond a long it is a long's limit, as are distances and their sums. Rows that repeat a vec_id are
    vectors of their own (a null vec_id too, which is hashed as empty); equal hashes are ordered by the vector. With fewer
    than k vectors there are as many centroids as vectors, without any no rows. Further columns are ignored. k is at most
    256. `seen` collects (vectors, measured against all centroids, against their own) of every pass, for reports; with
    geometric=False bounds are loosened by the full drift.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).filter(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [r["v"] for r in rows.orderBy(name, "v").limit(k).collect()]
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, before = np.array(first, np.int64), None
    totals = [0] * (len(first) * (dims + 1))
    blocks, path = written(_blocks(rows, dims), "vectors"), None
    for turn in range(rounds + 1):
        here = new_path(spark, "assigned")
        _passed(blocks, centroids, before, geometric).write.parquet(here)
        if path:
            remove(spark, path)
        blocks, path = spark.read.schema(STATE).parquet(here), here
        if seen is not None:
            seen.append(tuple(blocks.agg(F.sum(F.size("ids")), F.sum("scanned"), F.sum("measured")).first()))
        if turn == rounds:
            break
        for r in blocks.select(F.posexplode("delta").alias("at", "by")).groupBy("at").agg(F.sum("by").alias("by")).collect():
            totals[r["at"]] += int(r["by"])
        sums = np.array(totals, object).reshape(len(first), dims + 1)
        moved = np.array([[int(s) // int(row[-1]) for s in row[:-1]] if row[-1] else mid.tolist() for row, mid in zip(sums, centroids, strict=True)], np.int64)
        if (moved == centroids).all():  # every further round would find the same
            break
        before, centroids = centroids, moved
    found = written(_distances(blocks, centroids), "clustered")
    remove(spark, path)
    exact = F.col("distance").cast("decimal(38,0)")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(exact).alias("s")).collect()}
    of = [(c, min(inertia.get(c, 0), LONGEST), hashlib.sha256(",".join(map(str, mid.tolist())).encode()).hexdigest()) for c, mid in enumerate(centroids)]
    about = F.broadcast(spark.createDataFrame(of, "cluster int, cluster_inertia long, centroid_sha256 string"))  # k rows
    return found.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(min(sum(inertia.values()), LONGEST)).cast("long").alias("inertia"), "centroid_sha256")
