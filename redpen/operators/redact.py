"""Replacing personal values by placeholders: what a document says of a person, everywhere in that document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redpen.functions.spans import match_spans

#: Placeholders are built of signs that no value holds, so that a shorter value can't change one, and spelled out at the end.
DIGITS, OPEN, CLOSE, FIRST_KIND = "".join(chr(0xE000 + k) for k in range(10)), chr(0xE010), chr(0xE011), 0xE020


def found_values(docs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(doc_id, value, kind, first): every different value that a pattern finds in a document, with its first place.

    A value of several kinds is of the first of them by name. Patterns match no empty text."""
    of = lambda k: F.transform(match_spans(F.col("text"), kinds[k]), lambda m: F.struct(F.lit(k).alias("kind"), m["hit"].alias("value"), m["span_start"].alias("at")))
    hits = docs.select("doc_id", F.explode(F.flatten(F.array(*[F.coalesce(of(k), F.array().cast("array<struct<kind:string,value:string,at:bigint>>")) for k in kinds]))).alias("h")).select("doc_id", "h.*")
    return hits.groupBy("doc_id", "value").agg(F.min("kind").alias("kind"), F.min("at").alias("first"))


def public_values(values: DataFrame, kind: str, least: int) -> DataFrame:
    """(kind, value): values of a kind that stand in at least so many documents; such names are no one's secret."""
    return values.filter(F.col("kind") == kind).groupBy("kind", "value").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("kind", "value")


def _spelled(text: Column, kinds: list[str]) -> Column:
    for k, name in enumerate(kinds):
        text = F.replace(text, F.lit(OPEN + chr(FIRST_KIND + k)), F.lit(f"<{name}-"))
    return F.replace(F.translate(text, DIGITS, "0123456789"), F.lit(CLOSE), F.lit(">"))


def redacted(docs: DataFrame, kinds: dict[str, str], public: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_values, text) of every document with a value that isn't public.

    Values are numbered for each document and kind by first place, so equal values get equal placeholders, such as <name-2>. Longer
    values are replaced first, each wherever it stands, also inside words. public: (kind, value). Texts may not hold characters of the
    private area from U+E000 to U+E0FF. Null texts have no values; rows of one doc_id share their values."""
    names = sorted(kinds)
    secret = found_values(docs, kinds) if values is None else values
    if public is not None:
        secret = secret.join(public, ["kind", "value"], "left_anti")
    number = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("first", "value")).cast("string")
    mark = F.element_at(F.array(*[F.lit(OPEN + chr(FIRST_KIND + k)) for k in range(len(names))]), F.array_position(F.array(*[F.lit(n) for n in names]), F.col("kind")).cast("int"))
    marked = secret.withColumn("mark", F.concat(mark, F.translate(number, "0123456789", DIGITS), F.lit(CLOSE)))
    listed = marked.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.length("value")).alias("size"), "value", "mark"))).alias("values"))
    text = F.aggregate("values", F.col("text"), lambda t, v: F.replace(t, v["value"], v["mark"]))
    return docs.select("doc_id", "text").join(listed, "doc_id").select("doc_id", F.size("values").cast("long").alias("n_values"), _spelled(text, names).alias("text"))
