"""Reports and document structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redpen.functions.text import escaped, mapped, stable_id, table_cell
from redpen.schema import CATEGORIES, CATEGORY_LABEL, COMMENT_LABEL, ENTRY_LABEL, SEVERITY_LABEL, SEVERITY_RANK


def reports(rows: DataFrame) -> DataFrame:
    """(doc_id, report): one line for each issue, by severity, then position."""
    line = F.concat_ws(" | ", mapped(F.col("severity"), SEVERITY_LABEL, "轻微"), "id", table_cell(F.col("excerpt")))
    ordered = F.sort_array(F.collect_list(F.struct(mapped(F.col("severity"), SEVERITY_RANK, 99).alias("rank"), "seq", line.alias("line"))))
    return rows.groupBy("doc_id").agg(ordered.alias("lines")).select("doc_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("report"))


def sectioned_reports(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, n_filled, report): a section for each category of the contract, also where nothing was found, for every document.

    Lines are ordered by severity, then position. The categories are a fixed list inside the row, so no join multiplies rows."""
    line = F.struct(mapped(F.col("severity"), SEVERITY_RANK, 99).alias("rank"), "seq", F.concat(F.lit("- "), "id", F.lit(": "), "excerpt").alias("line"))
    lines = rows.groupBy("doc_id", "category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("lines"))
    filled = lines.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "lines"))).alias("of"))
    section = lambda c: F.concat(F.lit("## "), c, F.lit("\n"), F.coalesce(F.try_element_at("of", c), F.lit("(nothing found)")))
    sections = F.transform(F.array(*[F.lit(c) for c in CATEGORIES]), section)
    report = F.concat(F.lit("# "), F.col("doc_id").cast("string"), F.lit("\n"), F.array_join(sections, "\n"))
    return docs.select("doc_id").join(filled, "doc_id", "left").select("doc_id", F.coalesce(F.size("of"), F.lit(0)).cast("long").alias("n_filled"), report.alias("report"))


def attach_headings(paras: DataFrame, is_heading: Column) -> DataFrame:
    """(doc_id, para_idx, heading): the last heading at or before each paragraph; null before the first."""
    before = Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return paras.select("doc_id", "para_idx", F.last(F.when(is_heading, F.col("text")), ignorenulls=True).over(before).alias("heading"))


def islands(paras: DataFrame) -> DataFrame:
    """(doc_id, first_para, last_para, n): runs of consecutive indexes."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("para_idx"))
    return paras.select("doc_id", "para_idx", (F.col("para_idx") - number).alias("island")).groupBy("doc_id", "island").agg(F.min("para_idx").alias("first_para"), F.max("para_idx").alias("last_para"), F.count("*").alias("n")).drop("island")


#: Parts that a commented document has to have, and the mark of a comment in each.
PART_MARKS = {"document": "<start ", "comments": "<comment ", "extended": "<ex "}


def document_parts(rows: DataFrame) -> DataFrame:
    """(doc_id, name, body): the three parts of each commented document, comments in order: marked excerpts, comments, states of threads."""
    number, para = (F.col("seq") - 1).cast("string"), stable_id("para:", F.col("id"))
    of = lambda mark: F.concat(F.lit(f'<{mark} id="'), number, F.lit('"/>'))
    document = F.concat(of("start"), escaped(F.col("excerpt")), of("end"), of("ref"))
    comments = F.concat(F.lit('<comment id="'), number, F.lit('" paraId="'), para, F.lit('">'), escaped(F.col("problem")), F.lit("</comment>"))
    extended = F.concat(F.lit('<ex paraId="'), para, F.lit('" done="0"/>'))
    pieces = rows.select("doc_id", F.struct("seq", document.alias("document"), comments.alias("comments"), extended.alias("extended")).alias("c"))
    ordered = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    part = lambda name: F.struct(F.lit(name).alias("name"), F.concat(F.lit(f"<{name}>"), F.array_join(F.transform("c", lambda c: c[name]), ""), F.lit(f"</{name}>")).alias("body"))
    return ordered.select("doc_id", F.explode(F.array(*[part(n) for n in PART_MARKS])).alias("p")).select("doc_id", "p.name", "p.body")


def broken_parts(parts: DataFrame) -> DataFrame:
    """Documents (doc_id) that lack a part or hold one twice, or whose starts, ends, references, comments and threads differ in number."""
    count = lambda mark: F.sum(F.regexp_count("body", F.lit(mark)))
    marks = [*PART_MARKS.values(), "<end ", "<ref ", "</comment>"]
    found = parts.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("name").alias("kinds"), F.array_distinct(F.array(*[count(m) for m in marks])).alias("counts"))
    whole = (F.col("n") == len(PART_MARKS)) & (F.col("kinds") == len(PART_MARKS)) & (F.size("counts") == 1)
    return found.filter(~F.coalesce(whole, F.lit(False))).select("doc_id")


def _one_line(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def entry_reports(rows: DataFrame) -> DataFrame:
    """(doc_id, report): a head with the counts of all issues and of each severity, then an entry for each issue, by severity, then position.

    An entry has its number, labels, problem, at most 80 characters of its excerpt if there is one, and at most three suggestions
    or a general one. Missing problems and unknown severities get the format's defaults; unknown categories are named as they are."""
    problem = _one_line(F.replace(F.coalesce("problem", F.lit("（未描述）")), F.lit("|"), F.lit("｜")))
    said = F.when(F.size("suggestion") > 0, _one_line(F.array_join(F.slice("suggestion", 1, 3), "；"))).otherwise("请根据上下文修改")
    excerpt = _one_line(F.substring(F.coalesce("excerpt", F.lit("")), 1, 80))
    head = F.concat(mapped(F.col("severity"), ENTRY_LABEL, ENTRY_LABEL["minor"]), F.lit(" 【"), F.coalesce(*[F.when(F.col("category") == k, v) for k, v in CATEGORY_LABEL.items()], F.col("category"), F.lit("unknown")), F.lit("】\n\n"))
    quoted = F.when(excerpt != "", F.concat(F.lit("**原文**：…"), excerpt, F.lit("…\n\n"))).otherwise("")
    body = F.concat(head, F.lit("**问题**："), problem, F.lit("\n\n"), quoted, F.lit("**建议**："), said, F.lit("\n\n---\n\n"))
    ordered = F.sort_array(F.collect_list(F.struct(mapped(F.col("severity"), SEVERITY_RANK, 2).alias("rank"), "seq", body.alias("body"))))
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY_RANK]
    grouped = rows.groupBy("doc_id").agg(ordered.alias("entries"), *counts)
    number = lambda c: c.cast("string")
    top = F.concat(F.lit("共 **"), number(F.size("entries")), F.lit("** 项问题：致命 "), number(F.col("n_fatal")), F.lit(" 项 / 严重 "), number(F.col("n_major")), F.lit(" 项 / 轻微 "), number(F.col("n_minor")), F.lit(" 项\n\n"))
    entries = F.transform("entries", lambda e, i: F.concat(F.lit("### "), number(i + 1), F.lit(". "), e["body"]))
    return grouped.select("doc_id", F.concat(top, F.array_join(entries, "")).alias("report"))


def comment_text(warning: Column) -> Column:
    """A comment's lines: labels, problem and first suggestion, after the warning if there is one; further suggestions; the id."""
    label = F.coalesce(*[F.when(F.col("category") == k, v) for k, v in COMMENT_LABEL.items()], F.col("category"), F.lit(""))
    first = F.concat(F.lit("【"), label, F.lit("】【"), F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in SEVERITY_LABEL.items()], F.col("severity"), F.lit("")), F.lit("】"), F.coalesce("problem", F.lit("")), F.lit(" → "), F.coalesce(F.get("suggestion", F.lit(0)), F.lit("")))
    more = F.when(F.size("suggestion") > 1, F.concat(F.array(F.lit("其他建议：")), F.transform(F.slice("suggestion", 2, F.greatest(F.size("suggestion"), F.lit(1))), lambda s: F.concat(F.lit("  · "), s)))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(F.concat(F.coalesce(F.concat(warning, F.lit(": ")), F.lit("")), first)), more, F.array(F.concat(F.lit("[id: "), F.coalesce("id", F.lit("")), F.lit("]"))))
    return F.array_join(lines, "\n")
