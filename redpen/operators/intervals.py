"""Links between intervals: the one that covers another, the one that overlaps it.

All intervals of a part (a document) are sorted by start, longer ones first, and cut into blocks by a range partitioning
that may cut inside a part, so a part with a third of all intervals is spread over many tasks. A block is swept in one
pass that keeps, for each end seen, the last interval with it. What is open at a block's border, one interval for each end
beyond it, is carried into the later blocks of the part. So no pairs are built, however many intervals share a place.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.sources.store import written


class _LastByEnd:
    """The last number put at an end, asked for over ranges of ends: a tree of maxima over the ends that occur."""

    def __init__(self, ends: list[int]):
        self.size = len(ends)
        self.tree = [-1] * (2 * self.size)

    def put(self, at: int, number: int) -> None:
        at += self.size
        while at:
            self.tree[at] = max(self.tree[at], number)
            at >>= 1

    def last(self, lo: int, hi: int) -> int:
        """Of the ends at places lo to hi - 1; -1 if there is none."""
        found, lo, hi = -1, lo + self.size, hi + self.size
        while lo < hi:
            if lo & 1:
                found, lo = max(found, self.tree[lo]), lo + 1
            if hi & 1:
                hi -= 1
                found = max(found, self.tree[hi])
            lo, hi = lo >> 1, hi >> 1
        return found


def _swept(rows: list[dict], carried: list[dict]) -> Iterator[tuple]:
    """Links of the rows of one part in one block, in order; carried intervals come before them."""
    all_rows = carried + rows
    ends = sorted({r["span_end"] for r in all_rows})
    known = _LastByEnd(ends)
    for number, r in enumerate(all_rows):
        at = bisect_left(ends, r["span_end"])
        if number >= len(carried):
            cover = known.last(at, len(ends))
            overlap = known.last(bisect_right(ends, r["span_start"]), at)
            yield r, *(all_rows[n]["id"] if n >= 0 else None for n in (cover, overlap))
        known.put(at, number)


def linked(spans: DataFrame, blocks: int | None = None) -> DataFrame:
    """spans (part, id, span_start, span_end) with cover_id and overlap_id, null where there is none.

    Intervals of a part are ordered by start, then end (longer first), then id. cover_id is the last interval before in which this
    one lies (an equal one too), overlap_id the last one before that reaches into it but ends earlier than it does. Ids have
    to differ within a part. Rows with a null part, id, start or end are no intervals and are left out. `blocks`: how many tasks
    sort and sweep (by default the session's shuffle partitions)."""
    spark = spans.sparkSession
    kept = spans.select("part", "id", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end")).dropna()
    order = ["part", "span_start", F.desc("span_end"), "id"]
    count = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(kept.repartitionByRange(count, *order).withColumn("block", F.spark_partition_id()), "blocks")
    borders = rows.groupBy("block").agg(F.min(F.struct("part", "span_start")).alias("first"), F.max(F.struct("part", "span_start")).alias("last"))
    newest = F.max_by(F.struct("id", "span_start"), F.struct("span_start", "id")).alias("n")
    ends = rows.join(borders.select("block", "last"), "block").filter((F.col("part") == F.col("last.part")) & (F.col("span_end") >= F.col("last.span_start")))
    still = ends.groupBy("part", "block", "span_end").agg(newest).select("part", F.col("block").alias("from_block"), "span_end", "n.*")
    begins = borders.select("block", F.col("first.part").alias("part"), F.col("first.span_start").alias("begin"))
    into = still.join(begins, "part").filter((F.col("from_block") < F.col("block")) & (F.col("span_end") >= F.col("begin")))
    carried = written(into.groupBy("part", "block", "span_end").agg(newest).select("part", "block", "span_end", "n.*"), "carried")
    columns = ["part", "id", "span_start", "span_end"]

    def sweep(here: pa.Table, before: pa.Table) -> pa.Table:
        parts: dict = {}
        for side, t in ((0, before), (1, here)):
            for r in t.select(columns).to_pylist():
                parts.setdefault(r["part"], ([], []))[side].append(r)
        out = []
        for old, new in parts.values():
            for some in (old, new):
                some.sort(key=lambda r: (r["span_start"], -r["span_end"], r["id"]))
            out += [(*(r[c] for c in columns), cover, overlap) for r, cover, overlap in _swept(new, old)]
        cols = list(zip(*out, strict=True)) or [[]] * (len(columns) + 2)
        kinds = [here.schema.field(c).type for c in columns]
        return pa.table([pa.array(c, k) for c, k in zip(cols, [*kinds, kinds[1], kinds[1]], strict=True)], [*columns, "cover_id", "overlap_id"])

    kinds = dict(kept.dtypes)
    schema = f"part {kinds['part']}, id {kinds['id']}, span_start long, span_end long, cover_id {kinds['id']}, overlap_id {kinds['id']}"
    return rows.groupBy("block").cogroup(carried.groupBy("block")).applyInArrow(sweep, schema)
