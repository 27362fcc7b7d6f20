"""Worked examples of single operators."""

import random
import re

from pyspark.sql import functions as F

from redpen.functions import text as T
from redpen.operators import crossref, issues, locate, rank
from redpen.operators import findings as N
from redpen.operators.findings import with_groups


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def test_sentences_and_ranges(spark):
    assert one(spark, "A.b 3.5。好?!", T.sentences) == ["A.b 3.5", "好", "", ""]
    spans = N.sentence_spans(spark.createDataFrame([(1, 0, "A.b 3.5。好?!")], "doc_id long, para_idx long, text string"))
    assert [tuple(r)[2:] for r in spans.orderBy("span_start").collect()] == [(0, 8), (8, 10), (10, 11)]
    assert one(spark, "a.b.c", T.sentences) == ["a.b.c"]


def test_contents_lines(spark):
    for text, want in (("x" * 78 + "7", True), ("x" * 79 + "7", False), (" " * 30 + "x" * 70 + "7", False), ("no number", False)):
        assert one(spark, text, T.is_contents_line) is want


def test_scanned(spark):
    assert one(spark, "", T.looks_scanned) and one(spark, "#" * 20, T.looks_scanned) and one(spark, "abc.....", T.looks_scanned)
    assert not one(spark, "plain words", T.looks_scanned)


def test_small_functions(spark):
    assert one(spark, " A. B　", T.key_of) == "ab" and one(spark, None, T.key_of) == ""
    assert one(spark, "abcdefghij", T.masked) == "abcd**ghij" and one(spark, "abc", T.masked) == "***"
    assert one(spark, "a/b.txt", T.valid_object_name) and not one(spark, "/a", T.valid_object_name) and not one(spark, "a//b", T.valid_object_name)
    assert one(spark, "a" * 61, lambda c: T.clamp(c, 60, "...")) == "a" * 57 + "..."
    assert one(spark, "aaaa", lambda c: T.occurrences(c, F.lit("aa"))) == 2
    assert one(spark, "x" * 100 + "ab" + "y" * 100, lambda c: T.context(c, F.lit("ab"))) == "x" * 40 + "ab" + "y" * 40


def test_sequence_audit(spark):
    rows = spark.createDataFrame([("a", n, k) for k, n in enumerate([1, 2, 2, 5])], "g string, n long, k long")
    got = [(r["n"], r["kind"], r["missing"]) for r in crossref.sequence_audit(rows, "g", "n", "k").orderBy("n").collect()]
    assert got == [(2, "repeat", ""), (5, "gap", "3,4")]


SCHEMA = "doc_id long, seq long, source string, category string, severity string, scope string, chapter string, para_idx long, excerpt string, anchor_text string, problem string"


def issue(seq, **k):
    base = {"doc_id": 1, "source": "thesis", "category": "language", "severity": "minor", "scope": "paragraph", "chapter": "c", "para_idx": 0, "excerpt": "e", "anchor_text": "a", "problem": "p"}
    x = base | k
    return (x["doc_id"], seq, *(x[c] for c in ("source", "category", "severity", "scope", "chapter", "para_idx", "excerpt", "anchor_text", "problem")))


def test_groups_in_order_of_appearance(spark):
    rows = spark.createDataFrame([issue(1, chapter="A"), issue(2, chapter="B"), issue(3, chapter="A"), issue(4, chapter="C")], SCHEMA)
    assert [r["group_id"] for r in with_groups(rows).orderBy("seq").collect()] == ["g-001", "g-002", "g-001", "g-003"]
    assert issues.group_conflicts(with_groups(rows)).count() == 0


def test_repaired_issues_are_valid(spark):
    bad = [issue(1, source="x", category=None, severity="info", scope=None, excerpt=None, problem=None, chapter="", para_idx=-7), issue(2, excerpt="z" * 61), issue(3, scope="chapter"), issue(4, para_idx=None, anchor_text=None)]
    fixed = with_groups(issues.normalise(spark.createDataFrame(bad, SCHEMA)))
    assert issues.violations(fixed).count() == 0
    rows = {r["seq"]: r for r in fixed.collect()}
    assert rows[2]["excerpt"] == "z" * 57 + "..." and rows[3]["excerpt"] == ""


def test_top_n_order_and_overflow(spark):
    rows = with_groups(spark.createDataFrame([issue(1, severity="major", para_idx=5), issue(2, severity="minor", para_idx=-1), issue(3, severity="major", para_idx=-1), issue(4, severity="fatal", para_idx=7)], SCHEMA))
    got = [(r["seq"], r["selected"]) for r in rank.top_n(rows, 3).orderBy("rank").collect()]
    assert got == [(4, True), (3, True), (1, True), (2, False)]


def test_quality_gate(spark):
    rows = [issue(k, severity="major" if k <= 5 else "minor") for k in range(1, 9)] + [issue(k, doc_id=2, severity="major" if k <= 4 else "minor") for k in range(1, 9)]
    got = {r["doc_id"]: r["passed"] for r in rank.quality_gate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: True, 2: False}


def test_anchor_prefers_body_and_never_falls_to_index(spark):
    paras = spark.createDataFrame([(1, 0, "intro"), (1, 2, "alpha beta 12"), (1, 9, "the alpha beta text")], "doc_id long, para_idx long, text string")
    anchors = spark.createDataFrame([(1, 1, "alpha beta", 0), (1, 2, "missing", 9), (1, 3, "", 9), (1, 4, "beta 12", 0)], "doc_id long, seq long, anchor_text string, para_idx long")
    got = {r["seq"]: (r["place"], r["how"]) for r in locate.cascade(anchors, paras).collect()}
    assert got == {1: (9, "anchor"), 2: (0, "fallback"), 3: (9, "index"), 4: (2, "anchor")}


def test_anchors_are_found_in_one_deal_of_the_texts(spark):
    """Against brute force: repeated and cut words, contents lines, needles without an inner word, documents without paragraphs; and words are never shuffled."""
    deal = random.Random(3)
    say = lambda n: " ".join(deal.choice(("a", "ab", "abc", "b", "", "ba 12", "文字")) for _ in range(n))
    paras = [(d, 2 * k, say(deal.randrange(9))) for d in range(40) for k in range(deal.randrange(1, 15))]
    told = [(d, k, deal.choice((say(deal.randrange(6)), deal.choice(paras)[2][deal.randrange(4):][:50]))) for d in range(42) for k in range(12)] + [(None, 1, "a"), (3, 99, None)]
    want = set()
    for d, seq, anchor in told:
        needle = (anchor or "").strip(" ")[:30]
        hit = [(bool(re.search(r"\d{1,4}\s*$", t.strip(" "))) and len(t) <= 100 and len(t.strip(" ")) < 80, p, t) for e, p, t in paras if d == e and needle and needle in t]
        if hit:
            _, p, t = min(hit)
            want.add((d, seq, p, t.index(needle), len(t)))
    lines = spark.createDataFrame(paras, "doc_id long, para_idx long, text string").repartition(5)
    hits = locate.anchor_hits(spark.createDataFrame(told, "doc_id long, seq long, anchor_text string"), lines)
    assert {tuple(r) for r in hits.collect()} == want and len(want) > 50
    assert len(re.findall(r"Exchange hashpartitioning|BroadcastExchange", hits._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])) <= 1


def test_first_hits_without_an_inner_word(spark):
    paras = spark.createDataFrame([(1, 0, "nothing"), (1, 1, "前文目标文字后文"), (2, 0, "see http://a.example/long/path here"), (3, 0, "one two three four")], "doc_id long, para_idx long, text string")
    items = spark.createDataFrame([(1, "目标文字"), (2, "http://a.example/long"), (3, "one two three"), (4, "absent"), (5, "  "), (6, None)], "item_id long, text string")
    assert {tuple(r) for r in locate.first_hits(items, paras).collect()} == {(1, 1, 1), (2, 2, 0), (3, 3, 0)}
