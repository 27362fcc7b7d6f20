"""Anonymised texts, the priority score and the rules of the contract."""

import pytest
from pyspark.sql import functions as F

from redpen.operators import crossref, locate, rank, redact, report
from redpen.plans.joins import PERSONAL
from redpen.plans.registry import QUERIES
from redpen.sources.tables import paragraphs, table

DOCS = [
    (1, "Ada Cole wrote to eve@x.org and Ada Cole-Smith; 1234567 is not 123456789. xAda Coley, EVE@x.org.uk"),
    (2, "eve@x.org then Ada Cole again, eve@x.org"), (3, "Max Public said <name-1>"), (4, "Max Public met Bob Hill"), (5, None), (6, ""), (7, "nothing here"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_equal_values_get_equal_placeholders_and_none_is_left(docs):
    values = redact.found_values(docs, PERSONAL)
    public = redact.public_values(values, "name", 2).filter("value <> 'Ada Cole'")
    assert [r["value"] for r in public.collect()] == ["Max Public"]
    got = {r["doc_id"]: (r["n_values"], r["text"]) for r in redact.redacted(docs, PERSONAL, public).collect()}
    assert got[1] == (6, "<name-1> wrote to <mail-1> and <name-1>-Smith; <number-1> is not <number-2>. x<name-2>, <mail-2>")
    assert got[2] == (2, "<mail-1> then <name-1> again, <mail-1>")
    assert got[4] == (1, "Max Public met <name-1>") and set(got) == {1, 2, 4}  # 3 holds a public name only
    for r in values.join(public, ["kind", "value"], "left_anti").collect():
        assert r["value"] not in got[r["doc_id"]][1]


def test_values_of_the_given_texts_are_gone(spark, data):
    docs = table(spark, data.replace("sf0.001", "sf0.01"), "documents").select("doc_id", "text")
    left = redact.redacted(docs, PERSONAL).join(redact.found_values(docs, PERSONAL), "doc_id").filter(F.contains("text", "value"))
    assert redact.redacted(docs, PERSONAL).count() > 10 and left.count() == 0


def test_score_and_ties(spark):
    rows = [
        (1, 1, "g-1", "c2", "language", "fatal", "b", f"{rank.CHECKED} p"), (1, 2, "g-2", "c1", "language", "major", "a", "p"), (1, 3, "g-2", "c1", "structure", "major", "b", None),
        (1, 4, "g-3", "c1", "policy", "minor", "c", "p"), (2, 1, "g-1", "c1", "policy", "major", "a", "p"), (2, 2, "g-1", "c0", "policy", "major", "z", "p"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, seq long, group_id string, chapter string, category string, severity string, id string, problem string")
    got = [(r["doc_id"], r["seq"], r["score"]) for r in rank.priority_top(df, 5).collect()]
    assert got == [(1, 1, 3.3), (1, 2, 3.0), (1, 3, 3.0), (2, 2, 2.5), (2, 1, 2.5)]


def test_every_rule_fires(spark, data):
    assert {r["rule_no"] for r in QUERIES["issues_validated"](spark, data.replace("sf0.001", "sf0.01")).select("rule_no").distinct().collect()} == set(range(14))


def test_spans_inside_a_paragraph(spark):
    rows = [("A.b 3.5。好?!", None, "", 1), ("A.b 3.5。好?!", None, "", 2), ("A.b 3.5。好?!", None, None, 7), ("12345678", 5, "x", 0), ("12345678", 99, None, None), ("xyz" + "a" * 47, None, "a" * 40, None), ("ab", -1, "zz", -1), ("", 3, "a", 0), ("one. two", None, "none", 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, text string, off long, anchor string, sentence long")
    span = locate.offset_span(F.col("text"), F.col("off"), F.col("anchor"), F.col("sentence"))
    assert [tuple(r["s"]) for r in df.select("i", span.alias("s")).orderBy("i").collect()] == [(8, 10), (10, 11), (0, 11), (5, 8), (8, 8), (3, 33), (0, 2), (0, 0), (4, 8)]


def test_every_arm_of_the_cascade(spark):
    paras = spark.createDataFrame([(1, 0, "start"), (1, 1, "Chapter Two ... 12"), (1, 2, "the alpha beta text"), (2, 0, "only line")], "doc_id long, para_idx long, text string")
    cells = spark.createDataFrame([(1, 0, 1, 2, 0, 2)], "doc_id long, table_index long, row long, col long, cell_para long, para_idx long")
    none = (None,) * 4
    rows = [(1, 1, "alpha beta", 0, "", 0, 1, 2, 0), (1, 2, "alpha beta", 0, "Chapter Two", 0, 1, 2, 9), (1, 3, "alpha beta", 0, "", *none), (1, 4, "missing", 2, "Chapter Two", *none), (1, 5, "missing", 2, " start ", *none),
            (1, 6, "", 2, None, *none), (1, 7, None, 9, None, *none), (1, 8, "  ", -1, "nowhere", *none), (2, 1, "alpha beta", 0, "Chapter Two", 0, None, 2, 0), (3, 1, "", 0, "", *none)]
    issues = spark.createDataFrame(rows, "doc_id long, seq long, anchor_text string, para_idx long, chapter string, table_index long, row long, col long, cell_para long")
    got = {(r["doc_id"], r["seq"]): (r["place"], r["how"], {None: None, locate.TO_CHAPTER: "c", locate.TO_DOCUMENT: "d"}[r["warning"]]) for r in locate.mounted(issues, paras, cells).collect()}
    assert got == {
        (1, 1): (2, "cell", None), (1, 2): (1, "chapter", "c"), (1, 3): (2, "anchor", None), (1, 4): (1, "chapter", "c"), (1, 5): (0, "document", "d"),
        (1, 6): (2, "index", None), (1, 7): (0, "document", "d"), (1, 8): (0, "document", "d"), (2, 1): (0, "document", "d"),
    }


def test_entries_and_comments(spark):
    rows = [(1, 1, "x-1", "language", "minor", "p|q\nr", "", ["a", "b", "c", "d"]), (1, 2, "x-2", "odd", "fatal", None, "e" * 90, []), (2, 1, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, seq long, id string, category string, severity string, problem string, excerpt string, suggestion array<string>")
    got = {r["doc_id"]: r["report"] for r in report.entry_reports(df).collect()}
    assert got[1] == (
        "共 **2** 项问题：致命 1 项 / 严重 0 项 / 轻微 1 项\n\n### 1. ❌ 致命 【odd】\n\n**问题**：（未描述）\n\n**原文**：…" + "e" * 80 + "…\n\n**建议**：请根据上下文修改\n\n---\n\n"
        "### 2. 💡 轻微 【语言表达】\n\n**问题**：p｜q r\n\n**建议**：a；b；c\n\n---\n\n"
    )
    assert "【unknown】" in got[2]
    said = [r["t"] for r in df.orderBy("doc_id", "seq").select(report.comment_text(F.when(F.col("seq") == 1, "!")).alias("t")).collect()]
    assert said[0] == "!: 【语言】【轻微】p|q\nr → a\n其他建议：\n  · b\n  · c\n  · d\n[id: x-1]" and said[1] == "【odd】【致命】 → \n[id: x-2]" and said[2] == "!: 【】【】 → \n[id: ]"


def test_citations_against_references(spark):
    schema = "doc_id long, nr long, author string, year string"
    cited = spark.createDataFrame([(2, 0, "Ada Cole", "1999"), (2, 1, "Bob Hill", None), (4, 0, "Max Ray", "2001"), (4, 1, "Max Ray", "2001")], schema)
    refs = spark.createDataFrame([(1, 1, "ada  cole.", "1999"), (1, 2, "Bob Hill", "1990"), (3, 7, "BOB HILL", None), (3, 8, "Eve Dunn", "2000")], schema)
    got = {(r["doc_id"], r["nr"], r["kind"], r["severity"]) for r in crossref.citation_gaps(cited, refs, spark.createDataFrame([(1,), (1,), (None,)], "nr long")).collect()}
    assert got == {
        (4, 0, "footnote_missing_reference", "major"), (4, 1, "footnote_missing_reference", "major"), (1, 2, "reference_not_cited", "minor"),
        (3, 7, "citation_format_inconsistent", "major"), (3, 8, "reference_not_cited", "minor"),
    }


def test_few_candidates_for_each_needle(spark):
    """The rarest gram of a needle leaves under twenty paragraphs for each on average, of 95,000."""
    d = "/root/testdata/sf0.1"
    items = table(spark, d, "benchmark")
    assert locate.hit_candidates(items, paragraphs(table(spark, d, "documents"))).count() < 20 * items.count()
