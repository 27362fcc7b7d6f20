"""Values that the review's functions give on small inputs, nulls and empty texts included."""

from pyspark.sql import functions as F

from redpen.functions import text as T
from redpen.operators import anchors as A
from redpen.operators import issues as I
from redpen.operators import rank as R


def _all(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["x"] for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_numerals(spark):
    assert _all(spark, ["十", "二十三", "一百零五", "12", "", "九百九十"], T.numeral) == [10, 23, 105, 0, 0, 990]


def test_file_names_are_cut_by_bytes(spark):
    names = ["", None, "a.docx", "x" * 200 + ".docx", "é" * 72 + "x" + "é.docx", "é" * 100 + ".docx", ".hidden", "a..docx"]
    got = _all(spark, names, T.cut_file_name)
    # 145 bytes are left for a stem with this suffix; a cut that ends just after a character of two bytes loses it
    assert got == ["document", "document", "a.docx", "x" * 145 + ".docx", "é" * 72 + "x.docx", "é" * 72 + ".docx", ".hidden", "a..docx"]
    assert _all(spark, ["x" + "é" * 100 + ".docx"], T.cut_file_name) == ["x" + "é" * 71 + ".docx"]


def test_json_is_repaired(spark):
    cases = {
        '{"k":1}': '{"k":1}', '[{"k":1},{"k":2},{"k"': '[{"k":1},{"k":2}]', '{"a":["x","y"],"b":"cut o': '{"a":["x","y"]}', '{"a": "whole"': '{"a": "whole"}', '{"a': "{}", "[1, 23": "[1]", "[1,[2,{": "[1,[2]]",
        '["a, [b", "c\\"d", "e': '["a, [b", "c\\"d"]', '{"a":[1,2]} and more': '{"a":[1,2]} and more', '[1,{"a":2]': "[1]", "": "", None: None, "no json": "no json", '{"a":1,"b":[true,nul': '{"a":1,"b":[true]}',
    }
    assert _all(spark, list(cases), T.repaired_json) == list(cases.values())  # Spark reads a whole value and leaves what follows, so that stays


def test_json_cut_anywhere_can_be_read(spark):
    """Every cut after the first bracket gives JSON, which holds only what the whole has."""
    import json

    whole = '{"n": null, "l": [{"k": "a\\\\", "m": [1.5, -2e3, "x"]}, {"k": "[}\\"", "t": true}], "é": {"z": {}}}'
    texts = [whole[:n] for n in range(1, len(whole) + 1)]
    got = [json.loads(t) for t in _all(spark, texts, T.repaired_json)]
    assert got[-1] == json.loads(whole)

    def inside(part, of):
        if isinstance(part, dict):
            return isinstance(of, dict) and all(k in of and inside(v, of[k]) for k, v in part.items())
        if isinstance(part, list):
            return isinstance(of, list) and len(part) <= len(of) and all(inside(a, b) for a, b in zip(part, of, strict=False))
        return part == of

    assert all(inside(g, got[-1]) for g in got)


def test_suggestions_are_held_to_five(spark):
    split = lambda c: F.array_join(T.suggestions(F.when(c != "", F.split(c, ","))), ",")
    assert _all(spark, ["a,b", "a,b,c,d,e,f", "", None, "x" * 600], split) == ["a,b", "a,b,c,d,e", "(no suggestion)", "(no suggestion)", "x" * 500]


def test_anchors_by_level(spark):
    body = "Some head words here. The cat sat, on the mat today. And then nothing else."
    problems = [(1, 'see "cat sat, on" there'), (1, 'see "cat-sat-on" there'), (1, "about nothing"), (1, "x"), (1, None), (2, "about nothing"), (3, "lone")]
    rows = spark.createDataFrame([(d, k, p) for k, (d, p) in enumerate(problems)], "doc_id long, seq int, problem string")
    bodies = spark.createDataFrame([(1, body), (2, ""), (4, None)], "doc_id long, body string")
    got = {r["seq"]: (r["level"], r["anchor"]) for r in A.found_anchors(rows, bodies).collect()}
    assert got[0] == (1, "cat sat, on")
    assert got[1][0] == 1 and got[1][1] in body
    assert got[2][0] == 2 and "nothing" in got[2][1]
    assert got[3] == (3, "The cat sat, on the mat today")
    assert got[4] == (3, "The cat sat, on the mat today")
    assert got[5] == (4, "about nothing") and got[6] == (4, "lone")


def test_body_starts(spark):
    start = lambda c: A.body_start(c, ("Chapter [0-9]", "Intro"))
    assert _all(spark, ["Intro x\nChapter 1", "no marker", "y" * 3000, "Chapter 1" + "z" * 2991], start) == [8, 0, 450, 450]


def test_running_sum_over_ranges(spark):
    rows = spark.createDataFrame([(k, "a" if k % 3 else None, k) for k in range(50)], "k long, part string, v long")
    got = {r["k"]: r["s"] for r in R.running_sum(rows, "part", F.col("k"), F.col("v"), ["k"], "s", width=7).collect()}
    assert got == {k: sum(j for j in range(k + 1) if (j % 3 == 0) == (k % 3 == 0)) for k in range(50)}


def test_every_place_rule_fires(spark):
    schema = "doc_id long, seq int, id string, source string, category string, severity string, scope string, excerpt string, problem string, suggestion array<string>, group_id string, anchor_text string, para_idx long, table_index int, row int, col int, paragraph_index_in_cell int, page_number int, bbox array<double>, sentence_index int, char_offset_in_paragraph int"
    empty = (1, 0, *[None] * 19)
    bad = (1, 1, *["x"] * 7, ["", "y" * 501, "a", "b", "c", "d"], "g", "t", 3, -1, -1, -1, -1, 0, [1.0], -1, -1)
    partly = (1, 2, *["x"] * 7, ["a"], "g", "t", -1, 1, None, None, None, 1, [1.0] * 4, 0, 0)
    rows = spark.createDataFrame([empty, bad, partly], schema)
    rules = {r["rule_no"] for r in I.place_violations(rows).collect()}
    assert rules == set(range(len(I._place_rules(True))))
    assert [r["message"] for r in I.place_violations(rows).filter("seq = 2").collect()] == ["cell keys together"]
