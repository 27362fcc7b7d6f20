"""Lookups in dated tables: what was in force at a time.

`as_of` takes the last row of the dimension at or before a time: both tables in one, sorted, the last dimension row carried
forward. `in_force` is for intervals [from, to), which may overlap: they are dealt into bins of time. Neither leaves a key
that holds a third of all rows to one task: keys are cut into stretches of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(facts: DataFrame, terms: DataFrame, key: str, time: str, since: str, values: list[str], stretch_s: int = 30 * 86_400) -> DataFrame:
    """facts with the values of the key's last term whose `since` is at or before the fact's time; null where there is none.

    Terms with equal key and since are decided by the greatest values. Within a stretch of time the last term is carried
    forward; what an earlier stretch leaves is carried over one row for each stretch. A fact without key or time gets nulls; terms
    without key or since are never in force. Every fact is returned once, repeated ones as often as they stand."""
    stamp, columns = F.unix_micros(F.col("_t").cast("timestamp")), facts.columns
    term = terms.select(F.col(key).alias("_k"), F.col(since).alias("_t"), F.struct(*values).alias("_v")).filter("_k is not null and _t is not null")
    rows = facts.select(F.struct(*columns).alias("_f"), F.col(key).alias("_k"), F.col(time).alias("_t"))
    both = rows.unionByName(term, allowMissingColumns=True).withColumn("_at", stamp).withColumn("_stretch", F.floor(F.col("_at") / (stretch_s * 1_000_000)))
    # a term stands before the facts of its time: structs sort nulls first, and a term has no fact
    order = [F.col("_at"), F.col("_f").isNotNull(), F.col("_v")]
    inside = Window.partitionBy("_k", "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_near", F.last("_v", ignorenulls=True).over(inside))
    left = both.groupBy("_k", "_stretch").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_at", "_v"))).alias("_last"))
    earlier = Window.partitionBy("_k").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = left.select(F.col("_k").alias("_bk"), F.col("_stretch").alias("_bs"), F.last("_last", ignorenulls=True).over(earlier).alias("_far"))
    found = carried.filter("_f is not null").join(base, (F.col("_k") == F.col("_bk")) & (F.col("_stretch") == F.col("_bs")), "left")
    value = F.when(F.col("_k").isNotNull() & F.col("_at").isNotNull(), F.coalesce("_near", "_far"))
    return found.select("_f.*", *[value[v].alias(v) for v in values])


def in_force(facts: DataFrame, terms: DataFrame, key: str, time: str, since: str, until: str, values: list[str], bin_s: int = 30 * 86_400) -> DataFrame:
    """One row for each fact and term of its key with since <= time < until, the fact's columns and the term's values.

    A term stands in every bin of time that it touches, a fact in one, so a pair meets once; an open end (null until) has to be
    closed by the caller. Facts without a term have no row. bin_s should be about the length of a usual term: then each stands in two bins."""
    bins = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bin_s * 1_000_000))
    dealt = terms.filter(F.col(since) < F.col(until)).select(F.col(key).alias("_k"), F.col(since).alias("_from"), F.col(until).alias("_to"), F.struct(*values).alias("_v"), F.explode(F.sequence(bins(since), bins(until))).alias("_b"))
    rows = facts.withColumn("_fb", bins(time))
    there = (F.col(key) == F.col("_k")) & (F.col("_fb") == F.col("_b")) & (F.col("_from") <= F.col(time)) & (F.col(time) < F.col("_to"))
    return rows.join(dealt, there).select(*facts.columns, *[F.col("_v")[v].alias(v) for v in values])
