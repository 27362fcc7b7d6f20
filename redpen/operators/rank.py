"""Counting, gates, ranking and routing of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redpen.functions.text import mapped
from redpen.schema import SEVERITY_RANK, SEVERITY_WEIGHT, SUBSTANTIVE


#: Width of the key ranges that running sums are cut into.
RANGE = 65_536


def running_sum(rows: DataFrame, part: str, key: Column, value: Column, order: list, name: str, width: int = RANGE) -> DataFrame:
    """Rows with the sum of value over those at or before them in their part; order has to begin with the integer key.

    Two levels: sums within ranges of the key, and, over one row for each range, what lies before it. So a part that holds
    a third of all rows is no single task. Null parts and keys are groups of their own."""
    cut = rows.withColumns({"_range": F.floor(key / width), "_value": value})
    sums = cut.groupBy(F.col(part).alias("_part"), F.col("_range").alias("_of")).agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_part").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("_part", "_of", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.sum("_value").over(Window.partitionBy(part, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = cut.withColumn("_inside", inside).join(base, F.col(part).eqNullSafe(F.col("_part")) & F.col("_range").eqNullSafe(F.col("_of")))
    return joined.withColumn(name, (F.col("_base") + F.col("_inside")).cast("long")).select(*rows.columns, name)


def severity_counts(rows: DataFrame) -> DataFrame:
    """One row for each document with all three counts, zeros included."""
    return rows.groupBy("doc_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY_RANK], F.count("*").alias("n_all"))


def quality_gate(rows: DataFrame, least: int = 8, least_grave: int = 5) -> DataFrame:
    grave = F.count_if(F.col("severity").isin("fatal", "major"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_all"), grave.alias("n_grave"), ((F.count("*") >= least) & (grave >= least_grave)).alias("passed"))


def substantive_ratio(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    hit = F.col("category").isin(*SUBSTANTIVE) & F.col("severity").isin("fatal", "major")
    share = F.count_if(hit) / F.count("*")
    return rows.groupBy("doc_id").agg(F.count_if(hit).alias("n_substantive"), F.count("*").alias("n_all"), (share >= threshold).alias("reached"))


def top_n(rows: DataFrame, n: int = 500) -> DataFrame:
    """rank and selected: order by severity, paragraph (table cells, -1, first), id, seq; the overflow is returned too."""
    order = Window.partitionBy("doc_id").orderBy(mapped(F.col("severity"), SEVERITY_RANK, 99), F.coalesce("para_idx", F.lit(1_000_000_000)), "id", "seq")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("selected", F.col("rank") <= n)


#: The tag of evidence that was checked online, which raises a score. The value is fixed by the format.
CHECKED = "[联网核实]"


def scored(rows: DataFrame) -> DataFrame:
    """score: weight of the severity, 0.5 for two or more issues in the group, 0.5 for a chapter hit by three or more categories,
    0.3 for a problem with evidence that was checked online. Summed in tenths, so that equal scores are equal numbers."""
    group = F.count("*").over(Window.partitionBy("doc_id", "group_id"))
    kinds = F.size(F.collect_set("category").over(Window.partitionBy("doc_id", "chapter")))  # the categories are few and fixed
    joined = rows.withColumns({"in_group": group, "kinds": kinds})
    tenths = mapped(F.col("severity"), {k: round(10 * v) for k, v in SEVERITY_WEIGHT.items()}, 0)
    for holds, more in ((F.col("in_group") >= 2, 5), (F.col("kinds") >= 3, 5), (F.coalesce(F.contains("problem", F.lit(CHECKED)), F.lit(False)), 3)):
        tenths = tenths + F.when(holds, more).otherwise(0)
    return joined.withColumn("score", tenths / 10)


def priority_top(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n issues of greatest score; ties by severity, chapter and id, then document and position, which make ids of several documents differ."""
    order = [F.desc("score"), mapped(F.col("severity"), SEVERITY_RANK, 99), "chapter", "id", "doc_id", "seq"]
    return scored(rows).orderBy(*order).limit(n)


def routed(rows: DataFrame) -> DataFrame:
    """(doc_id, seq, part): the report parts that an issue goes to; one to three rows for each issue."""
    parts = F.array(
        F.when(F.col("severity") == "fatal", F.lit("fatal problems")),
        F.when(F.col("category").isin(*SUBSTANTIVE), F.lit("substance")).otherwise(F.lit("form")),
        F.when(F.col("scope").isin("sentence", "span"), F.lit("wording")),
    )
    return rows.select("doc_id", "seq", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("part"))
