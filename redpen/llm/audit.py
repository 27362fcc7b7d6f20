"""Filter interaction audit: what each of five filters removes at each step of all 120 orders.

Every document has a mask of the filters that it fails. A mask (with the two label bits) stands for one wide
integer: MEASURES times 120 orders times 5 steps fields of FIELD bits, each 0 or 1. The integers of a part are
summed, so one addition counts all 600 step outcomes; a field holds any count below 2^63, so no field runs over
into the next one. Tasks send one integer for each part, those are added in two levels, then unpacked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bits of a field: a count of rows is a long.
FIELD = 64
FIELDS = len(MEASURES) * len(ORDERS) * STEPS
BYTES = FIELDS * FIELD // 8
#: A task keeps at most this many parts' integers before it sends them on; integers of a part are added in SLOTS groups first.
HELD, SLOTS = 256, 256

#: Words and symbols of the filters (fixed by the contract).
BLANKS, SYMBOLS = r"[\x20\x09-\x0D]+", "[#$%&*|]"


def mask_of_text(text: Column) -> Column:
    """Bits 0 to 3: fails A (words), B (distinct words), C (capitals), D (symbols); null text counts as empty."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    chars, capitals = F.length(text), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (n < 200, 100 * distinct.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 3 * chars.cast("long"), text.rlike(SYMBOLS))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) for each row of docs.

    Equal texts are told by their SHA-256. The first doc_id of each text is found with partial minima, and a row is joined to
    it by (doc_id, digest), a key that no group of copies makes hot. Rows that share a doc_id and text are no copies of each
    other; a null doc_id is neither smaller nor larger than another. A document is good (toxic) if any of its labels says so.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), mask_of_text(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("quality = 1 or toxic = 1").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    found = rows.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    return found.select("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


@cache
def wide(mask: int, good: bool, toxic: bool) -> int:
    """The integer of a mask: fields in the order of MEASURES, orders, steps, the first in the lowest bits."""
    ones = np.zeros((len(MEASURES), len(ORDERS), STEPS), np.int64)
    for o, order in enumerate(ORDERS):
        gone = False
        for s, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            fails = bool(mask & bit)
            here = fails and not gone
            gone = gone or here
            ones[:, o, s] = (not gone, here, fails and not here, mask == bit, here and good, here and toxic)
    return int.from_bytes(ones.astype("<i8").tobytes(), "little")


def _unpacked(total: int) -> np.ndarray:
    return np.frombuffer(total.to_bytes(BYTES, "little"), "<i8").reshape(len(MEASURES), len(ORDERS), STEPS)


def _totals(rows: DataFrame) -> DataFrame:
    """(part, total): each task's sum of integers for each part it met."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.to_bytes(BYTES, "little") for x in sums.values()], pa.binary())], ["part", "total"])

        for batch in batches:
            for (part, *bits), n in Counter(zip(*(c.to_pylist() for c in batch.columns), strict=True)).items():
                sums[part] = sums.get(part, 0) + n * wide(*bits)
                if len(sums) == HELD:
                    yield out()
                    sums.clear()
        yield out()

    return rows.select("part", "mask", "good", "toxic").mapInArrow(add, "part string, total binary")


def _added(table: pa.Table) -> int:
    return sum(int.from_bytes(x, "little") for x in table.column("total").to_pylist())


def _summed(table: pa.Table) -> pa.Table:
    return pa.table({"part": table.column("part")[:1], "total": pa.array([_added(table).to_bytes(BYTES, "little")], pa.binary())})


def _report(table: pa.Table) -> pa.Table:
    """The 600 rows of a part."""
    counts = _unpacked(_added(table))
    removed = counts[MEASURES.index("removed")]
    letters = np.array([list(o) for o in ORDERS])
    shapley = {f: int(removed[letters == f].sum()) for f in FILTERS}
    cells = len(ORDERS) * STEPS
    columns = {"part": pa.array([table.column("part")[0].as_py()] * cells, pa.string()), "filter_order": pa.array(np.repeat(ORDERS, STEPS).tolist(), pa.string()), "step": pa.array(np.tile(np.arange(1, STEPS + 1), len(ORDERS)), pa.int32())}
    columns |= {m: pa.array(counts[k].ravel()) for k, m in enumerate(MEASURES)}
    return pa.table(columns | {"shapley": pa.array([shapley[f] for f in letters.ravel()], pa.int64())})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The operator: 600 rows for each part (lang; null is the empty string), as the module says.

    Null text counts as empty. Repeated rows count each. Labels without a document, nulls in labels and further columns of
    either table are ignored. An empty table of documents has no part and gives no row; very long texts need memory for
    one text and its words.
    """
    totals = _totals(masks(docs, labels)).withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(SLOTS)))
    some = totals.groupBy("part", "slot").applyInArrow(_summed, "part string, total binary")
    return some.groupBy("part").applyInArrow(_report, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in (*MEASURES, "shapley")))
