"""Rule findings over paragraphs, and the issues made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redpen.functions import text as T
from redpen.sources.tables import paragraphs

LONG_PARAGRAPH, LONG_SENTENCE = 800, 80


def long_paragraphs(paras: DataFrame, most: int = LONG_PARAGRAPH) -> DataFrame:
    return paras.filter(F.length("text") > most).select("doc_id", "para_idx", F.length("text").cast("long").alias("n_chars"))


def long_sentences(paras: DataFrame, most: int = LONG_SENTENCE) -> DataFrame:
    """(doc_id, para_idx, sent_idx, n_chars, sentence) of sentences over `most` characters."""
    rows = paras.select("doc_id", "para_idx", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "sentence"))
    return rows.filter(F.length("sentence") > most).select("doc_id", "para_idx", F.col("sent_idx").cast("long").alias("sent_idx"), F.length("sentence").cast("long").alias("n_chars"), "sentence")


def sentence_spans(paras: DataFrame) -> DataFrame:
    """(doc_id, para_idx, span_start, span_end): [start, end) of every sentence with its ender. The spans of a paragraph tile it; a
    second ender in a row is a span of its own. Lengths are summed in a window, so a long paragraph costs no more than its sentences."""
    sents = paras.select("doc_id", "para_idx", F.length("text").alias("whole"), F.posexplode(T.sentences(F.col("text"))).alias("k", "sentence"))
    sizes = sents.select("doc_id", "para_idx", "whole", "k", (F.length("sentence") + 1).alias("size"))
    upto = F.sum("size").over(Window.partitionBy("doc_id", "para_idx").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = sizes.withColumn("upto", upto).select("doc_id", "para_idx", (F.col("upto") - F.col("size")).alias("span_start"), F.least("upto", F.col("whole").cast("long")).alias("span_end"))
    return spans.filter("span_start < span_end")


def repeated_paragraphs(paras: DataFrame) -> DataFrame:
    """(doc_id, text_md5, n, first_para) of texts that a document has more than once; blank lines don't count."""
    full = paras.filter(F.trim("text") != "")
    return full.groupBy("doc_id", F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"), F.min("para_idx").alias("first_para")).filter("n > 1")


def duplicate_signatures(docs: DataFrame) -> DataFrame:
    """(signature, n, first_id) of equal texts: grouped count with having."""
    rows = docs.filter("text is not null").groupBy(F.md5("text").alias("signature")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return rows.filter("n > 1")


def duplicate_members(docs: DataFrame) -> DataFrame:
    """(signature, doc_id, first_id): a row for each text that another equals, so no group is collected into one row."""
    rows = docs.select("doc_id", F.md5("text").alias("signature"))
    return rows.join(duplicate_signatures(docs).drop("n"), "signature")


def issues(docs: DataFrame) -> DataFrame:
    """Issues in document order (seq) from the three rules, one row each.

    Each paragraph gives the array of its findings, so texts are exploded once. Documents are dealt by doc_id before;
    the windows here and those of with_groups() need no other exchange."""
    chapter = F.concat_ws("/", "lang", "source").alias("chapter")
    paras = paragraphs(docs.select("doc_id", "text", chapter).repartition("doc_id"), "chapter")
    again = F.row_number().over(Window.partitionBy("doc_id", F.md5("text")).orderBy("para_idx")) > 1

    def finding(text, sub, category: str, severity: str, scope: str):
        return F.struct(F.lit(category).alias("category"), sub.cast("long").alias("sub"), F.lit(severity).alias("severity"), F.lit(scope).alias("scope"), text.alias("text"))

    whole = F.array(
        F.when(F.length("text") > LONG_PARAGRAPH, finding(F.col("text"), F.lit(0), "structure", "major", "paragraph")),
        F.when((F.trim("text") != "") & F.col("again"), finding(F.col("text"), F.lit(0), "academic-integrity", "fatal", "paragraph")),
    )
    said = F.transform(T.sentences(F.col("text")), lambda s, i: F.when(F.length(s) > LONG_SENTENCE, finding(s, i, "language", "minor", "sentence")))
    found = paras.withColumn("again", again).select("doc_id", "chapter", "para_idx", F.explode(F.filter(F.concat(whole, said), lambda f: f.isNotNull())).alias("f")).select("doc_id", "chapter", "para_idx", "f.*")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("para_idx", "category", "sub")).cast("long")
    excerpt = F.when(F.length("text") > 60, F.concat(F.substring("text", 1, 57), F.lit("..."))).otherwise(F.col("text"))
    return found.select(
        "doc_id", seq.alias("seq"), F.lit("thesis").alias("source"), "category", "severity", "scope", "chapter", "para_idx",
        excerpt.alias("excerpt"), F.substring(F.trim("text"), 1, 60).alias("anchor_text"),
        F.concat(F.col("category"), F.lit(": "), F.length("text").cast("string"), F.lit(" characters")).alias("problem"),
    )


def with_groups(rows: DataFrame) -> DataFrame:
    """group_id g-001, g-002, ... in order of first appearance of (source, category, chapter, para_idx) in a document; id by position."""
    key = ["doc_id", "source", "category", "chapter", "para_idx"]
    first = F.min("seq").over(Window.partitionBy(*key))
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first_seq"))
    grouped = rows.withColumn("first_seq", first).withColumn("group_id", F.format_string("g-%03d", rank)).drop("first_seq")
    return grouped.withColumn("id", F.format_string("%s-%s-%03d", "source", "category", "seq"))
