"""Cross-references between two sides, sequence audits, sums against totals, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redpen.functions.text import key_of

# Fixed value: the form of a Western name that both sides of a cross-reference have to agree on.
AUTHOR = r"([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+)"


def authors(rows: DataFrame, key: str) -> DataFrame:
    """(key, author) of every name-shaped match in text, repeats included."""
    return rows.select(key, F.explode(F.regexp_extract_all("text", F.lit(AUTHOR), 1)).alias("author"))


def crossref(left: DataFrame, right: DataFrame) -> DataFrame:
    """(author, status, text_count, refs_count) by full outer join of the counted names of both sides."""
    a = left.groupBy("author").agg(F.count("*").alias("text_count"))
    b = right.groupBy("author").agg(F.count("*").alias("refs_count"))
    status = F.when(F.col("refs_count").isNull(), "text_only").when(F.col("text_count").isNull(), "refs_only").otherwise("matched")
    return a.join(b, "author", "full_outer").select("author", status.alias("status"), F.coalesce("text_count", F.lit(0)).alias("text_count"), F.coalesce("refs_count", F.lit(0)).alias("refs_count"))


def citation_gaps(cited: DataFrame, refs: DataFrame, numbers: DataFrame) -> DataFrame:
    """(doc_id, nr, author, year, kind, severity) of citations without a reference and references without a citation.

    cited and refs: (doc_id, nr, author, year), met by the normal form of the author and the year, of which a missing one meets a
    missing one. A reference whose nr is not among numbers (nr) is not cited by number: if a citation has its key, the format is
    inconsistent, else it is not cited at all. Only distinct keys stand on the other side of a join, so rows are never multiplied."""
    keyed = lambda df: df.select("doc_id", "nr", "author", "year", key_of(F.col("author")).alias("form"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("of"))
    cited, refs, key = keyed(cited), keyed(refs), ["form", "of"]
    told = lambda df, kind, severity: df.select("doc_id", "nr", "author", "year", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    known, named = refs.select(*key).distinct(), cited.select(*key).distinct()
    unnumbered = refs.join(numbers.select("nr").distinct(), "nr", "left_anti")
    missing = told(cited.join(known, key, "left_anti"), "footnote_missing_reference", "major")
    return missing.unionByName(told(unnumbered.join(named, key, "left_semi"), "citation_format_inconsistent", "major")).unionByName(told(unnumbered.join(named, key, "left_anti"), "reference_not_cited", "minor"))


def sequence_audit(rows: DataFrame, group: str, number: str, tie: str) -> DataFrame:
    """(group, number, expected, kind, missing): gaps and repeats of numbers that should run 1, 2, 3, ...

    missing lists a gap's numbers, joined by commas."""
    before = F.lag(number, 1, 0).over(Window.partitionBy(group).orderBy(number, tie))
    seen = rows.select(group, number, tie).withColumn("expected", before + 1)
    kind = F.when(F.col(number) > F.col("expected"), "gap").when(F.col(number) < F.col("expected"), "repeat")
    missing = F.when(F.col("kind") == "gap", F.array_join(F.sequence("expected", F.col(number) - 1).cast("array<string>"), ","))
    return seen.withColumn("kind", kind).filter("kind is not null").withColumn("missing", F.coalesce(missing, F.lit("")))


def sum_against_total(parts: DataFrame, totals: DataFrame, key: str, part: str, total: str, tolerance: float = 0.02) -> DataFrame:
    """Groups whose parts don't add up to the stated total within the tolerance."""
    sums = parts.groupBy(key).agg(F.round(F.sum(part), 2).alias("parts_sum"))
    return totals.join(sums, key).filter(F.abs(F.col("parts_sum") - F.col(total)) > tolerance).select(key, "parts_sum", F.col(total).alias("stated"))


def last_of(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each group; rank 1 is the last."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])).cast("long")
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def latest(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """For each key, the columns of its last row (replace by key)."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last")).select(key, "last.*")


def idle_gaps(rows: DataFrame, key: str, time: str, tie: str, seconds: int = 900) -> DataFrame:
    """Rows that follow the one before in their group after more than so many seconds."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(time, tie))
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    return rows.select(key, time, tie).withColumn("before", before).withColumn("gap_us", gap).filter(F.col("gap_us") > seconds * 1_000_000).drop("before")
