"""The issue contract: repairing rows so that they satisfy it, and validating rows against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redpen.functions.text import clamp
from redpen.schema import CATEGORIES, SCOPES, SEVERITIES, SOURCES


def normalise(rows: DataFrame) -> DataFrame:
    """Enum values outside the contract get their default, lengths are clamped, a wide scope has no excerpt, and
    ids are given by position (seq). A blank problem gets a placeholder; an empty excerpt is filled from the anchor."""
    source = F.when(F.col("source").isin(*SOURCES), F.col("source")).otherwise("thesis")
    category = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("argumentation")
    severity = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("minor")
    scope = F.when(F.col("scope").isin(*SCOPES), F.col("scope")).otherwise("paragraph")
    filled = F.when(F.coalesce("excerpt", F.lit("")) == "", F.substring("anchor_text", 1, 60)).otherwise(F.col("excerpt"))
    out = rows.withColumns({"source": source, "category": category, "severity": severity, "scope": scope})
    out = out.withColumns({
        "excerpt": F.when(F.col("scope").isin("document", "chapter"), "").otherwise(F.coalesce(clamp(filled, 60, "..."), F.lit(""))),
        "anchor_text": F.coalesce(F.substring("anchor_text", 1, 60), F.lit("")),
        "problem": F.when(F.trim(F.coalesce("problem", F.lit(""))) == "", "(no description)").otherwise(F.substring("problem", 1, 200)),
        "chapter": F.when(F.coalesce("chapter", F.lit("")) == "", "(none)").otherwise(F.col("chapter")),
        "para_idx": F.greatest(F.coalesce("para_idx", F.lit(0)), F.lit(-1)).cast("long"),
    })
    return out.withColumn("id", F.format_string("%s-%s-%03d", "source", "category", "seq"))


def _rules() -> list[tuple[Column, str]]:
    """(is violated, message) in the order in which messages are given for a row."""
    length = F.length
    return [
        (~F.col("source").isin(*SOURCES), "source"),
        (~F.col("category").isin(*CATEGORIES), "category"),
        (~F.col("severity").isin(*SEVERITIES), "severity"),
        (~F.col("scope").isin(*SCOPES), "scope"),
        (~F.col("id").rlike(rf"^({'|'.join(SOURCES)})-({'|'.join(CATEGORIES)})-\d{{3}}$"), "id pattern"),
        (F.split("id", "-")[0] != F.col("source"), "id source"),
        (~F.startswith(F.substring_index("id", "-", 99), F.concat("source", F.lit("-"), "category", F.lit("-"))), "id category"),
        (F.col("scope").isin("document", "chapter") & (F.col("excerpt") != ""), "excerpt scope"),
        (length("excerpt") > 60, "excerpt length"),
        (length("anchor_text") > 60, "anchor length"),
        ((length("problem") < 1) | (length("problem") > 200), "problem length"),
        (F.col("chapter") == "", "chapter"),
        (F.col("para_idx") < -1, "paragraph index"),
        (~F.col("group_id").rlike(r"^g-\d{3,}$"), "group pattern"),
    ]


def violations(rows: DataFrame) -> DataFrame:
    """(doc_id, seq, rule_no, message): one row for each violated rule, numbered in rule order; nulls violate nothing."""
    told = F.array(*[F.when(bad, F.struct(F.lit(k).alias("rule_no"), F.lit(m).alias("message"))) for k, (bad, m) in enumerate(_rules())])
    return rows.select("doc_id", "seq", F.explode(F.filter(told, lambda x: x.isNotNull())).alias("v")).select("doc_id", "seq", "v.*")


CELL = ("table_index", "row", "col", "paragraph_index_in_cell")
REQUIRED = ("id", "source", "category", "severity", "scope", "excerpt", "problem", "suggestion", "group_id", "anchor_text")


def _place_rules(pdf: bool) -> list[tuple[Column, str]]:
    """Rules on required fields, suggestions and places, in the order in which messages are given."""
    present = sum((F.col(k).isNotNull().cast("int") for k in CELL), F.lit(0))
    cell = present == len(CELL)
    sizes = F.transform("suggestion", lambda s: F.length(s))
    return [
        *[(F.col(k).isNull(), f"missing {k}") for k in REQUIRED],
        (~F.size("suggestion").between(1, 5) & F.col("suggestion").isNotNull(), "suggestion count"),
        (F.exists(sizes, lambda n: n > 500), "suggestion length"),
        (F.exists(sizes, lambda n: n == 0), "suggestion empty"),
        (present.between(1, len(CELL) - 1), "cell keys together"),
        (cell & (F.coalesce("para_idx", F.lit(0)) != -1), "cell paragraph index"),
        *[(cell & (F.col(k) < 0), f"cell {k}") for k in CELL],
        (F.lit(pdf) & F.col("page_number").isNull(), "page number missing"),
        (F.col("page_number") < 1, "page number"),
        (F.col("bbox").isNotNull() & (F.size("bbox") != 4), "box"),
        (F.col("sentence_index") < 0, "sentence index"),
        (F.col("char_offset_in_paragraph") < 0, "character offset"),
    ]


def place_violations(rows: DataFrame, pdf: bool = True) -> DataFrame:
    """(doc_id, seq, rule_no, message) for the rules on required fields, suggestions and places; nulls violate only where a value is required."""
    told = F.array(*[F.when(bad, F.struct(F.lit(k).alias("rule_no"), F.lit(m).alias("message"))) for k, (bad, m) in enumerate(_place_rules(pdf))])
    return rows.select("doc_id", "seq", F.explode(F.filter(told, lambda x: x.isNotNull())).alias("v")).select("doc_id", "seq", "v.*")


def duplicate_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    """Second and later rows of an id in a document."""
    k = F.row_number().over(Window.partitionBy("doc_id", key).orderBy("seq"))
    return rows.withColumn("k", k).filter("k > 1").drop("k")


def group_conflicts(rows: DataFrame) -> DataFrame:
    """Rows whose group differs from that of the first row with their key (functional dependency)."""
    first = F.first("group_id").over(Window.partitionBy("doc_id", "source", "category", "chapter", "para_idx").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("first_group", first).filter("group_id <> first_group")


def downgraded(rows: DataFrame, has_evidence: Column) -> DataFrame:
    """Fatal issues without evidence become major."""
    return rows.withColumn("severity", F.when((F.col("severity") == "fatal") & ~has_evidence, "major").otherwise(F.col("severity")))
