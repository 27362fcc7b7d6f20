"""Queries of the review of issues: anchors found from problem texts, further contract rules, reports, names, numerals and JSON, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redpen.functions import text as T
from redpen.operators import anchors as A
from redpen.operators import crossref as X
from redpen.operators import findings as N
from redpen.operators import issues as I
from redpen.operators import report as P
from redpen.plans.registry import ALL, PARAS, RANK, SENTS, _issues, query
from redpen.schema import CATEGORIES, EVIDENCE
from redpen.sources.tables import listing_page, paragraphs, table

# Anchors

#: What opens a body, in the order in which it is looked for. The first five are fixed by the format of theses; two words of the given tables follow.
MARKERS = ("第[一二三四五六七八九十0-9]+章", "绪\\s*论", "引\\s*言", "一、", "摘要", "And ", "En ")
_AT = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(text, '{m}') THEN length(regexp_extract(text, '(?s)^(.*?)(?:{m})', 1)) END" for m in MARKERS) + ", 0)"
_BODIES = f"bodies AS (SELECT doc_id, text, start, substr(text, start + 1) AS body, regexp_replace(substr(text, start + 1), '{A.SIGNS}', '', 'g') AS bare FROM (SELECT doc_id, text, CASE WHEN pos = 0 AND length(text) > 2000 THEN CAST(floor(length(text) * CAST(0.15 AS DOUBLE)) AS BIGINT) ELSE pos END AS start FROM (SELECT doc_id, text, {_AT} AS pos FROM documents)))"
_PROBLEMS = """problems AS (SELECT doc_id, seq, CASE seq % 5 WHEN 0 THEN 'see "' || substr(anchor_text, 5, 30) || '" again' WHEN 1 THEN anchor_text WHEN 2 THEN 'Is it ok?' WHEN 3 THEN '"' || replace(substr(anchor_text, 1, 30), ' ', '-') || '"' ELSE substr(anchor_text, 20) END AS problem FROM grouped)"""
_QUOTED = A.QUOTED.replace("'", "''")
_LEVELS = rf"""quoted AS (SELECT doc_id, seq, unnest(range(len(l))) AS k, trim(unnest(l), ' ') AS q FROM (SELECT doc_id, seq, regexp_extract_all(problem, '{_QUOTED}', 1) AS l FROM problems)),
  by_quote AS (SELECT doc_id, seq, k, CASE WHEN contains(body, q) THEN substr(q, 1, 60) WHEN pos > 0 THEN substr(body, greatest(pos - 6, 0) + 1, least(pos - 1 + length(raw) + 5 - greatest(pos - 6, 0), 60)) END AS a
    FROM (SELECT *, strpos(bare, raw) AS pos FROM (SELECT *, regexp_replace(q, '{A.SIGNS}', '', 'g') AS raw FROM quoted JOIN bodies USING (doc_id)) WHERE raw <> '')),
  said AS (SELECT doc_id, seq, unnest(range(len(l))) AS k, unnest(l) AS w FROM (SELECT doc_id, seq, regexp_extract_all(problem, '{A.WORD}') AS l FROM problems)),
  words AS (SELECT doc_id, seq, w, row_number() OVER (PARTITION BY doc_id, seq ORDER BY count(*) * length(w) DESC, length(w) DESC, min(k)) AS r FROM said WHERE len(list_distinct(string_split(w, ''))) >= 2 GROUP BY doc_id, seq, w),
  near AS (SELECT doc_id, seq, r, w, regexp_extract_all(substr(body, greatest(pos - 21, 0) + 1, pos - 1 + length(w) + 20 - greatest(pos - 21, 0)), '{A.WINDOW_PIECE}') AS l FROM (SELECT *, strpos(body, w) AS pos FROM words JOIN bodies USING (doc_id) WHERE r <= 10) WHERE pos > 0),
  pieces AS (SELECT doc_id, seq, r, piece, row_number() OVER (PARTITION BY doc_id, seq, r ORDER BY length(regexp_replace(piece, '\s', '', 'g')) DESC, CASE WHEN contains(piece, w) THEN 0 ELSE 1 END, k) AS best FROM (SELECT doc_id, seq, r, w, unnest(range(len(l))) AS k, unnest(l) AS piece FROM near)),
  heads AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY length(piece) DESC, k) AS best FROM (SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS piece FROM (SELECT doc_id, regexp_extract_all(substr(body, 1, 200), '{A.HEAD_PIECE}') AS l FROM bodies))),
  levels AS (SELECT doc_id, seq, 1 AS level, k AS r, a AS anchor FROM by_quote WHERE a IS NOT NULL
    UNION ALL SELECT doc_id, seq, 2, r, trim(piece, ' ') FROM pieces WHERE best = 1 AND trim(piece, ' ') <> ''
    UNION ALL SELECT doc_id, seq, 3, 0, trim(piece, ' ') FROM problems JOIN heads USING (doc_id) WHERE best = 1 AND trim(piece, ' ') <> ''
    UNION ALL SELECT doc_id, seq, 4, 0, substr(trim(problem, ' '), 1, 40) FROM problems),
  chosen AS (SELECT doc_id, seq, CAST(level AS BIGINT) AS level, anchor FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY level, r) AS n FROM levels) WHERE n = 1)"""


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    at = table(spark, d, "documents").select("doc_id", "text", A.body_start(text, MARKERS).alias("start"))
    return at.withColumn("body", F.substring(text, F.col("start").cast("int") + 1, F.length(text)))


def _problem() -> Column:
    """Problem texts of five shapes: a quotation, the words themselves, none that fit, a quotation with other signs, a part."""
    anchor, s = F.col("anchor_text"), F.col("seq") % 5
    return (
        F.when(s == 0, F.concat(F.lit('see "'), F.substring(anchor, 5, 30), F.lit('" again')))
        .when(s == 1, anchor)
        .when(s == 2, "Is it ok?")
        .when(s == 3, F.concat(F.lit('"'), F.replace(F.substring(anchor, 1, 30), F.lit(" "), F.lit("-")), F.lit('"')))
        .otherwise(F.substring(anchor, 20, 60))
    )


@query(f"WITH {_BODIES} SELECT doc_id, CAST(start AS BIGINT) AS start FROM bodies")
def body_starts(spark: SparkSession, d: str) -> DataFrame:
    """Where the body of each text begins."""
    return _bodies(spark, d).select("doc_id", "start")


@query(ALL + f", {_BODIES}, {_PROBLEMS}, {_LEVELS} SELECT doc_id, seq, level, anchor FROM chosen")
def problem_anchors(spark: SparkSession, d: str) -> DataFrame:
    """An anchor for each issue, found from its problem text, and the level that it was found on."""
    problems = _issues(spark, d).select("doc_id", "seq", _problem().alias("problem"))
    return A.found_anchors(problems, _bodies(spark, d)).select("doc_id", "seq", F.col("level").cast("long").alias("level"), "anchor")


@query(
    ALL
    + f""", {_BODIES}, {_PROBLEMS}, {_LEVELS}, given AS (SELECT doc_id, seq, CASE seq % 3 WHEN 0 THEN 'no such text' WHEN 1 THEN anchor_text ELSE '' END AS given FROM grouped)
  SELECT doc_id, seq, given <> '' AND contains(text, given) AS kept, CASE WHEN given <> '' AND contains(text, given) THEN given ELSE anchor END AS anchor FROM given JOIN bodies USING (doc_id) JOIN chosen USING (doc_id, seq)"""
)
def anchors_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Anchors that stand in their text stay; the others are found again from the problem. Some are damaged on purpose."""
    s = F.col("seq") % 3
    given = F.when(s == 0, "no such text").when(s == 1, F.col("anchor_text")).otherwise("")
    rows = _issues(spark, d).select("doc_id", "seq", given.alias("given"), _problem().alias("problem"))
    told = rows.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").withColumn("kept", (F.col("given") != "") & F.contains("text", "given")).drop("text")
    found = A.found_anchors(told.withColumn("problem", F.when(~F.col("kept"), F.col("problem"))), _bodies(spark, d))
    return found.select("doc_id", "seq", "kept", F.when(F.col("kept"), F.col("given")).otherwise(F.col("anchor")).alias("anchor"))


_SPELT = "CASE event_id % 5 WHEN 0 THEN event_type || ' ' || event_id || ' ' || event_type WHEN 1 THEN event_type || event_id || ' ' || event_type WHEN 2 THEN event_type || ' ' || event_id || event_type WHEN 3 THEN event_type || event_id || event_type ELSE 'no such text' END"


@query(
    rf"""WITH v AS (SELECT event_id, text, a, regexp_replace(a, '(\p{{L}})([0-9])', '\1 \2', 'g') AS b FROM (SELECT event_id, event_type || ' ' || event_id || ' ' || event_type || ' ' || user_id AS text, {_SPELT} AS a FROM events))
  SELECT event_id AS doc_id, event_id AS seq, CASE WHEN contains(text, a) THEN 1 WHEN contains(text, b) THEN 2 WHEN contains(text, regexp_replace(a, '([0-9])(\p{{L}})', '\1 \2', 'g')) THEN 3 WHEN contains(text, regexp_replace(b, '([0-9])(\p{{L}})', '\1 \2', 'g')) THEN 4 END AS variant FROM v"""
)
def anchor_spellings(spark: SparkSession, d: str) -> DataFrame:
    """The first of four spellings of each anchor that its text holds; spaces beside numbers were lost in some anchors."""
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    space = F.lit(" ")
    s = F.col("event_id") % 5
    anchor = (
        F.when(s == 0, F.concat(kind, space, number, space, kind))
        .when(s == 1, F.concat(kind, number, space, kind))
        .when(s == 2, F.concat(kind, space, number, kind))
        .when(s == 3, F.concat(kind, number, kind))
        .otherwise("no such text")
    )
    events = table(spark, d, "events").withColumn("doc_id", F.col("event_id"))
    texts = events.select("doc_id", F.concat(kind, space, number, space, kind, space, F.col("user_id").cast("string")).alias("text"))
    return A.first_spelling(events.select("doc_id", F.col("event_id").alias("seq"), anchor.alias("anchor_text")), texts)


@query(
    ALL
    + rf""", given AS (SELECT doc_id, seq, CASE seq % 4 WHEN 0 THEN '' WHEN 1 THEN anchor_text WHEN 2 THEN replace(anchor_text, ' ', '-') ELSE 'no such text' END AS a, CASE WHEN seq % 8 = 3 THEN left(anchor_text, 5) ELSE 'no such chapter' END AS chapter FROM grouped)
  SELECT doc_id, seq, CASE WHEN a = '' THEN 'none' WHEN contains(text, a) THEN 'exact' WHEN raw <> '' AND contains(bare, raw) THEN 'stripped' WHEN contains(text, chapter) THEN 'chapter' ELSE 'none' END AS how
  FROM (SELECT *, regexp_replace(a, '{A.SIGNS}', '', 'g') AS raw FROM given) JOIN (SELECT doc_id, text, regexp_replace(text, '{A.SIGNS}', '', 'g') AS bare FROM documents) USING (doc_id)"""
)
def text_lookup(spark: SparkSession, d: str) -> DataFrame:
    """How each text is found: as it is, without signs, by its chapter, or not at all."""
    s = F.col("seq") % 4
    anchor = F.when(s == 0, "").when(s == 1, F.col("anchor_text")).when(s == 2, F.replace("anchor_text", F.lit(" "), F.lit("-"))).otherwise("no such text")
    chapter = F.when(F.col("seq") % 8 == 3, F.left("anchor_text", F.lit(5))).otherwise("no such chapter")
    return A.looked_up(_issues(spark, d).select("doc_id", "seq", anchor.alias("anchor_text"), chapter.alias("chapter")), table(spark, d, "documents"))


@query(
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, quantity FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber + l_orderkey % 2 AS l_linenumber FROM lineitem) "
    "LEFT JOIN (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, min(l_quantity) AS quantity FROM lineitem GROUP BY ALL) USING (l_orderkey, l_partkey, l_suppkey, l_linenumber)"
)
def cell_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Cells by their four keys together, null where there is none; the line of every odd order is off by one."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    lines = table(spark, d, "lineitem")
    wanted = lines.select(*keys[:3], (F.col("l_linenumber") + F.col("l_orderkey") % 2).alias("l_linenumber")).distinct()
    return wanted.join(lines.groupBy(*keys).agg(F.min("l_quantity").alias("quantity")), keys, "left")


# The contract

_PLACED = """placed AS (SELECT doc_id, seq, source, category, severity, scope, excerpt, anchor_text, id, CASE WHEN seq % 13 = 0 THEN NULL ELSE problem END AS problem, CASE WHEN seq % 9 = 0 THEN -1 ELSE para_idx END AS para_idx, CASE WHEN seq % 8 = 7 THEN NULL ELSE group_id END AS group_id,
  CASE seq % 5 WHEN 0 THEN [] WHEN 1 THEN [problem, ''] WHEN 2 THEN [repeat('x', 501)] WHEN 3 THEN [problem, problem, problem, problem, problem, problem] ELSE NULL END AS suggestion,
  CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 4 = 0 THEN -1 ELSE 1 END END AS table_index, CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 2 = 0 THEN -1 ELSE 2 END END AS row, CASE WHEN seq % 3 = 0 AND seq % 5 <> 0 THEN CASE WHEN seq % 7 = 0 THEN -1 ELSE 3 END END AS col, CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 11 = 0 THEN -1 ELSE 0 END END AS cell_para,
  CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 7 = 0 THEN 0 ELSE 1 END AS page_number, CASE WHEN seq % 4 = 0 THEN 3 ELSE 4 END AS n_box, CASE WHEN seq % 10 = 0 THEN -1 END AS sentence_index, CASE WHEN seq % 6 = 0 THEN -1 ELSE 0 END AS char_offset FROM grouped)"""
_CELL = "table_index IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL AND cell_para IS NOT NULL"
_ANY_CELL = "(table_index IS NOT NULL OR row IS NOT NULL OR col IS NOT NULL OR cell_para IS NOT NULL)"
_RULES = [
    *[(f"{k} IS NULL", f"missing {k}") for k in I.REQUIRED],
    ("len(suggestion) NOT BETWEEN 1 AND 5", "suggestion count"),
    ("len(list_filter(suggestion, lambda s: length(s) > 500)) > 0", "suggestion length"),
    ("list_contains(suggestion, '')", "suggestion empty"),
    (f"{_ANY_CELL} AND NOT ({_CELL})", "cell keys together"),
    (f"{_CELL} AND para_idx <> -1", "cell paragraph index"),
    *[(f"{_CELL} AND {c} < 0", f"cell {k}") for k, c in zip(I.CELL, ("table_index", "row", "col", "cell_para"), strict=True)],
    ("page_number IS NULL", "page number missing"),
    ("page_number < 1", "page number"),
    ("n_box <> 4", "box"),
    ("sentence_index < 0", "sentence index"),
    ("char_offset < 0", "character offset"),
]


@query(ALL + f", {_PLACED} " + " UNION ALL ".join(f"SELECT doc_id, seq, {n} AS rule_no, '{m}' AS message FROM placed WHERE {bad}" for n, (bad, m) in enumerate(_RULES)))
def places_validated(spark: SparkSession, d: str) -> DataFrame:
    """One row for each rule on required fields, suggestions, table cells, pages and boxes that a damaged issue violates."""
    s, problem = F.col("seq"), F.col("problem")
    in_cell = lambda bad, good: F.when(s % 3 == 0, F.when(bad, -1).otherwise(good))
    suggestion = F.when(s % 5 == 0, F.array().cast("array<string>")).when(s % 5 == 1, F.array(problem, F.lit(""))).when(s % 5 == 2, F.array(F.repeat(F.lit("x"), 501))).when(s % 5 == 3, F.array_repeat(problem, 6))
    rows = _issues(spark, d).withColumns({
        "suggestion": suggestion, "problem": F.when(s % 13 != 0, problem), "group_id": F.when(s % 8 != 7, F.col("group_id")), "para_idx": F.when(s % 9 == 0, -1).otherwise(F.col("para_idx")),
        "table_index": in_cell(s % 4 == 0, 1), "row": in_cell(s % 2 == 0, 2), "col": F.when(s % 5 != 0, in_cell(s % 7 == 0, 3)), "paragraph_index_in_cell": in_cell(s % 11 == 0, 0),
        "page_number": F.when(s % 5 == 0, None).when(s % 7 == 0, 0).otherwise(1), "bbox": F.array_repeat(F.lit(1.0), F.when(s % 4 == 0, 3).otherwise(4)),
        "sentence_index": F.when(s % 10 == 0, -1), "char_offset_in_paragraph": F.when(s % 6 == 0, -1).otherwise(0),
    })
    return I.place_violations(rows)


@query(
    "SELECT doc_id, len(l) AS n, md5(array_to_string(l, '|')) AS suggestions_md5 FROM (SELECT doc_id, list_transform(CASE WHEN doc_id % 3 = 2 OR text IS NULL THEN ['(no suggestion)'] WHEN doc_id % 3 = 1 THEN [text] ELSE string_split(text, chr(10)) END, lambda s: substr(s, 1, 500))[1:5] AS l FROM documents)"
)
def suggestions_clamped(spark: SparkSession, d: str) -> DataFrame:
    """Lists of suggestions held to five of 500 characters; a single one becomes a list, an empty list a placeholder."""
    s = F.col("doc_id") % 3
    given = F.when(s == 0, F.split("text", "\n", -1)).when((s == 1) & F.col("text").isNotNull(), F.array("text")).otherwise(F.array().cast("array<string>"))
    kept = table(spark, d, "documents").select("doc_id", T.suggestions(given).alias("l"))
    return kept.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "|")).alias("suggestions_md5"))


_TAGS = "[" + ", ".join(f"'{t}'" for t in (*EVIDENCE, "?")) + "]"


@query(f"SELECT event_id, tag, list_contains({_TAGS}[1:7], tag) AS known FROM (SELECT event_id, regexp_extract('[' || {_TAGS}[event_id % 8 + 1] || '] ' || event_type, '^\\[([^\\]]+)\\]', 1) AS tag FROM events)")
def evidence_tags(spark: SparkSession, d: str) -> DataFrame:
    """The evidence tag at the head of each problem, held against the closed list of tags."""
    tags = F.array(*[F.lit(t) for t in (*EVIDENCE, "?")])
    problem = F.concat(F.lit("["), F.element_at(tags, (F.col("event_id") % 8 + 1).cast("int")), F.lit("] "), "event_type")
    tagged = table(spark, d, "events").select("event_id", F.regexp_extract(problem, r"^\[([^\]]+)\]", 1).alias("tag"))
    return tagged.select("event_id", "tag", F.col("tag").isin(*EVIDENCE).alias("known"))


@query(
    "SELECT doc_id, coalesce(CASE WHEN toxic = 1 THEN 'fatal' WHEN quality = 0 THEN 'major' END, 'minor') AS severity, coalesce(CASE WHEN quality = 0 THEN 'quality' END, 'general') AS type, coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, '') AS description, coalesce(source, '') AS location, "
    "coalesce(CASE WHEN quality = 0 THEN 'drop' END, '') AS suggestion, coalesce(left(text, 20), '') AS highlight_text, coalesce(CAST(n_chars AS VARCHAR), '') AS evidence FROM documents LEFT JOIN labels USING (doc_id)"
)
def annotation_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of seven fields, each with its default where there is no value."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    toxic, poor = F.col("toxic") == 1, F.col("quality") == 0
    given = {
        "severity": (F.when(toxic, "fatal").when(poor, "major"), "minor"), "type": (F.when(poor, "quality"), "general"), "description": (F.when(toxic, "toxic"), ""), "location": (F.col("source"), ""),
        "suggestion": (F.when(poor, "drop"), ""), "highlight_text": (F.left("text", F.lit(20)), ""), "evidence": (F.col("n_chars").cast("string"), ""),
    }
    return rows.select("doc_id", *[F.coalesce(c, F.lit(default)).alias(k) for k, (c, default) in given.items()])


# Reports and parts

_DIMS = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"


@query(
    ALL
    + f""", sections AS (SELECT d.doc_id, k, '## ' || d.category || chr(10) || coalesce(string_agg('- ' || id || ': ' || excerpt, chr(10) ORDER BY {RANK}, seq), '(nothing found)') AS section, count(id) > 0 AS filled
  FROM (SELECT doc_id, unnest(range(10)) AS k, unnest({_DIMS}) AS category FROM documents) d LEFT JOIN grouped g ON g.doc_id = d.doc_id AND g.category = d.category GROUP BY d.doc_id, k, d.category)
  SELECT doc_id, count(*) FILTER (filled) AS n_filled, md5('# ' || doc_id || chr(10) || string_agg(section, chr(10) ORDER BY k)) AS report_md5 FROM sections GROUP BY doc_id"""
)
def sectioned_reports(spark: SparkSession, d: str) -> DataFrame:
    """A report of ten sections for each document."""
    reports = P.sectioned_reports(table(spark, d, "documents"), _issues(spark, d))
    return reports.select("doc_id", "n_filled", F.md5("report").alias("report_md5"))


_XML = "replace(replace(replace(excerpt || ' <' || problem || '> & more', '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(ALL + f"SELECT doc_id, count(*) AS n, md5('<comments>' || string_agg('<comment id=\"' || (seq - 1) || '\" paraId=\"' || upper(substr(md5('para:' || id), 1, 8)) || '\">' || {_XML} || '</comment>', '' ORDER BY seq) || '</comments>') AS part_md5 FROM grouped GROUP BY doc_id")
def comment_parts(spark: SparkSession, d: str) -> DataFrame:
    """The comments part of each document: its issues in order, escaped, in one text."""
    said = T.escaped(F.concat("excerpt", F.lit(" <"), "problem", F.lit("> & more")))
    comment = F.concat(F.lit('<comment id="'), (F.col("seq") - 1).cast("string"), F.lit('" paraId="'), T.stable_id("para:", F.col("id")), F.lit('">'), said, F.lit("</comment>"))
    rows = _issues(spark, d).select("doc_id", F.struct("seq", comment.alias("comment")).alias("c")).groupBy("doc_id").agg(F.sort_array(F.collect_list("c")).alias("c"), F.count("*").alias("n"))
    return rows.select("doc_id", "n", F.md5(F.concat(F.lit("<comments>"), F.array_join(F.transform("c", lambda c: c["comment"]), ""), F.lit("</comments>"))).alias("part_md5"))


# Sources

_JSON = "CASE event_id % 3 WHEN 0 THEN '[' || props || ',' || props || ']' WHEN 1 THEN '{\"issues\":[' || props || ']}' ELSE props END"


def _payload() -> Column:
    s = F.col("event_id") % 3
    return F.when(s == 0, F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))).when(s == 1, F.concat(F.lit('{"issues":['), "props", F.lit("]}"))).otherwise(F.col("props"))


@query(f"SELECT event_id, CASE WHEN j LIKE '[%' THEN json_array_length(j) ELSE coalesce(json_array_length(j, '$.issues'), 0) END AS n, coalesce(json_extract_string(j, '$[0].k'), json_extract_string(j, '$.issues[0].k')) AS k FROM (SELECT event_id, {_JSON} AS j FROM events)")
def issue_lists(spark: SparkSession, d: str) -> DataFrame:
    """Issue lists that are bare or the field of an object; any other JSON is an empty list."""
    j, item = F.col("j"), "array<struct<k:string>>"
    listed = F.when(j.startswith("["), F.from_json(j, item)).otherwise(F.from_json(j, f"struct<issues:{item}>")["issues"])
    rows = table(spark, d, "events").select("event_id", _payload().alias("j")).select("event_id", F.coalesce(listed, F.array().cast(item)).alias("l"))
    return rows.select("event_id", F.size("l").cast("long").alias("n"), F.try_element_at("l", F.lit(1))["k"].alias("k"))


_SHAPES = """CASE event_id % 6 WHEN 0 THEN '{"n":null,"issues":[' || props || ',' || props || ']}' WHEN 1 THEN '["' || event_type || '","' || event_type || '","x"]' WHEN 2 THEN '[[' || event_id || '],[' || user_id || '],[1]]'
  WHEN 3 THEN '{"p":' || props || ',"flag":true,"name":"' || event_type || '"}' WHEN 4 THEN '[true,false,null,' || user_id || ']' ELSE '{"k":' || event_id || '}' END"""
_STRING = r'^"[^"\\]*(?:\\[\s\S][^"\\]*)*"$'
_FIXED_JSON = f"""cuts AS (SELECT event_id, left(j, length(j) - event_id % 7) AS j FROM (SELECT event_id, {_SHAPES} AS j FROM events)),
  pieces AS (SELECT event_id, unnest(range(1, len(l) + 1)) AS nr, unnest(l) AS piece FROM (SELECT event_id, regexp_extract_all(j, '{T.JSON_PIECE}') AS l FROM cuts WHERE NOT json_valid(j))),
  read AS (SELECT event_id, 0 AS nr, 0 AS pos, '' AS open, '' AS before, 0 AS keep, '' AS stack FROM cuts
    UNION ALL SELECT event_id, nr, pos + length(piece), CASE WHEN blank OR wrong THEN open ELSE now END, CASE WHEN blank THEN before WHEN wrong THEN '!' ELSE k END,
      CASE WHEN blank OR wrong THEN keep WHEN ends THEN pos + length(piece) WHEN comma THEN pos ELSE keep END, CASE WHEN blank OR wrong THEN stack WHEN ends THEN now WHEN comma THEN open ELSE stack END
    FROM (SELECT *, regexp_matches(piece, '^\\s') AS blank, before = '!' OR (k IN (']', '}}') AND NOT fits) OR (open = '' AND (before <> '' OR k NOT IN ('[', '{{'))) AS wrong,
        CASE WHEN k IN ('[', '{{') THEN open || k WHEN k IN (']', '}}') THEN left(open, length(open) - 1) ELSE open END AS now, k = ',' AND before NOT IN (',', '[', '{{', ':') AS comma,
        (k IN ('[', '{{') AND open = '') OR k IN (']', '}}') OR ((before = ':' OR (top = '[' AND before IN ('[', ','))) AND regexp_matches(piece, '{_STRING}')) AS ends
      FROM (SELECT r.* EXCLUDE (nr), p.nr, piece, left(piece, 1) AS k, right(open, 1) AS top, (left(piece, 1) = ']' AND right(open, 1) = '[') OR (left(piece, 1) = '}}' AND right(open, 1) = '{{') AS fits
        FROM read r JOIN pieces p ON p.event_id = r.event_id AND p.nr = r.nr + 1))),
  mended AS (SELECT event_id, CASE WHEN keep > 0 THEN left(j, keep) || translate(reverse(stack), '[{{', ']}}') ELSE j END AS repaired FROM cuts JOIN (SELECT event_id, arg_max(keep, nr) AS keep, arg_max(stack, nr) AS stack FROM read GROUP BY event_id) USING (event_id))"""


@query(f"WITH RECURSIVE {_FIXED_JSON} SELECT event_id, repaired, json_valid(repaired) AND NOT regexp_matches(repaired, ',\\s*[\\]}}]') AS valid FROM mended")
def json_repaired(spark: SparkSession, d: str) -> DataFrame:
    """JSON texts of six shapes cut off at different places, mended, and whether they can be read then."""
    s = F.col("event_id") % 6
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    shapes = {
        0: F.concat(F.lit('{"n":null,"issues":['), "props", F.lit(","), "props", F.lit("]}")),
        1: F.concat(F.lit('["'), "event_type", F.lit('","'), "event_type", F.lit('","x"]')),
        2: F.concat(F.lit("[["), e, F.lit("],["), u, F.lit("],[1]]")),
        3: F.concat(F.lit('{"p":'), "props", F.lit(',"flag":true,"name":"'), "event_type", F.lit('"}')),
        4: F.concat(F.lit("[true,false,null,"), u, F.lit("]")),
        5: F.concat(F.lit('{"k":'), e, F.lit("}")),
    }
    whole = F.coalesce(*[F.when(s == k, c) for k, c in shapes.items()])
    rows = table(spark, d, "events").select("event_id", whole.alias("j")).select("event_id", F.left("j", (F.length("j") - F.col("event_id") % 7).cast("int")).alias("j"))
    mended = rows.select("event_id", T.repaired_json(F.col("j")).alias("repaired"))
    return mended.select("event_id", "repaired", F.try_parse_json("repaired").isNotNull().alias("valid"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def keys_present(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a listing that exist in another."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


ALLOWED = ("docx", "pdf", "txt", "md", "html")


@query("SELECT page_id, suffix, suffix IN ('docx', 'pdf', 'txt', 'md', 'html') AS accepted FROM (SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(?:\\?.*)?$', 1)) AS suffix FROM pages)")
def allowed_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Whether the suffix of each address is on the list of allowed ones."""
    suffix = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)(?:\?.*)?$", 1))
    return table(spark, d, "pages").select("page_id", suffix.alias("suffix"), suffix.isin(*ALLOWED).alias("accepted"))


# Texts, names and numerals

_HEADER = "(?i)license|copyright|rights reserved"


@query(
    f"""WITH l AS (SELECT doc_id, len(a) AS n, unnest(range(len(a))) AS k, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)), s AS (SELECT doc_id, min(k) AS split_at FROM l WHERE k * 2 >= n AND regexp_matches(left(line, 200), '{_HEADER}') GROUP BY doc_id)
  SELECT doc_id, any_value(split_at) AS split_at, CAST(sum(length(line)) FILTER (split_at IS NULL OR k < split_at) AS BIGINT) AS n_before, CAST(coalesce(sum(length(line)) FILTER (k >= split_at), 0) AS BIGINT) AS n_after FROM l LEFT JOIN s USING (doc_id) GROUP BY doc_id"""
)
def reference_section(spark: SparkSession, d: str) -> DataFrame:
    """Where the closing section begins: the first line of a text's second half with its header; characters before and from there."""
    a = F.split("text", "\n", -1)
    at = F.array_min(F.transform("a", lambda line, k: F.when((k * 2 >= F.size("a")) & F.left(line, F.lit(200)).rlike(_HEADER), k)))
    chars = lambda lines: F.aggregate(lines, F.lit(0), lambda n, line: n + F.length(line)).cast("long")
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", a.alias("a")).withColumn("at", at)
    before = F.when(F.col("at").isNull(), chars(F.col("a"))).when(F.col("at") > 0, chars(F.slice("a", 1, F.col("at")))).otherwise(F.when(F.lit(False), 0).cast("long"))
    after = F.when(F.col("at").isNull(), 0).otherwise(chars(F.slice("a", F.col("at") + 1, F.size("a")))).cast("long")
    return rows.select("doc_id", F.col("at").cast("long").alias("split_at"), before.alias("n_before"), after.alias("n_after"))


@query(
    f"""SELECT doc_id, author, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{X.AUTHOR}', 1)) AS author FROM documents) WHERE lower(regexp_extract(author, '^[A-Za-z]+')) NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM benchmark) GROUP BY doc_id, author"""
)
def authors_stopped(spark: SparkSession, d: str) -> DataFrame:
    """Names whose first word is on no stop list (here: the words of the benchmark)."""
    stop = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    named = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(X.AUTHOR), F.lit(1))).alias("author"))
    kept = named.withColumn("word", F.lower(F.regexp_extract("author", "^[A-Za-z]+", 0))).join(stop, "word", "left_anti")
    return kept.groupBy("doc_id", "author").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, author, row_number() OVER (PARTITION BY doc_id ORDER BY author) AS place FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{X.AUTHOR}', 1)) AS author FROM documents)")
def author_order(spark: SparkSession, d: str) -> DataFrame:
    """The names of each text in the order of their code points."""
    named = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(X.AUTHOR), F.lit(1)))).alias("author"))
    return named.distinct().withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("author")).cast("long"))


_NOTE = "CASE event_id % 4 WHEN 0 THEN '[' || event_id || '] ' || event_type WHEN 1 THEN event_id || '、' || event_type WHEN 2 THEN 'a' || event_id || ' ' || event_type ELSE event_type END"


@query(
    f"""SELECT user_id, event_id, note FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM (SELECT user_id, event_id, left(coalesce(nullif(regexp_extract(l, '^\\[\\d+\\]\\s*([^\\n]+)', 1), ''), nullif(regexp_extract(l, '^\\d+、([^\\n]+)', 1), ''), nullif(regexp_extract(l, '^[a-zA-Z]\\d*\\s+([^\\n]+)', 1), '')), 200) AS note
  FROM (SELECT user_id, event_id, {_NOTE} AS l FROM events)) WHERE note IS NOT NULL) WHERE k <= 100"""
)
def note_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are notes by the first of three patterns, at most 200 characters; the first hundred of each source, as the report wants."""
    e = F.col("event_id").cast("string")
    s = F.col("event_id") % 4
    line = F.when(s == 0, F.concat(F.lit("["), e, F.lit("] "), "event_type")).when(s == 1, F.concat(e, F.lit("、"), "event_type")).when(s == 2, F.concat(F.lit("a"), e, F.lit(" "), "event_type")).otherwise(F.col("event_type"))
    patterns = (r"^\[\d+\]\s*([^\n]+)", r"^\d+、([^\n]+)", r"^[a-zA-Z]\d*\s+([^\n]+)")
    rows = table(spark, d, "events").select("user_id", "event_id", line.alias("line"))
    notes = rows.select("user_id", "event_id", F.left(T.first_filled(*[F.regexp_extract("line", p, 1) for p in patterns]), F.lit(200)).alias("note")).filter("note is not null")
    return notes.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).filter("k <= 100").drop("k")


@query(
    """WITH f AS (SELECT doc_id, left(replace(text, chr(10), '_'), CAST(doc_id % 200 AS INTEGER)) AS stem FROM documents), c AS (SELECT doc_id, stem, unnest(range(0, length(stem) + 1)) AS k FROM f),
  s AS (SELECT doc_id, max(k) AS k FROM c WHERE k = 0 OR strlen(left(stem, k)) + CASE WHEN strlen(substr(stem, k, 1)) > 1 THEN 1 ELSE 0 END <= 145 GROUP BY doc_id)
  SELECT doc_id, CASE WHEN strlen(stem) <= 145 THEN stem ELSE left(stem, k) END || '.docx' AS name FROM f JOIN s USING (doc_id) WHERE stem <> ''"""
)
def file_names_cut(spark: SparkSession, d: str) -> DataFrame:
    """File names made of the heads of texts, cut by bytes with their suffix kept."""
    stem = F.left(F.replace("text", F.lit("\n"), F.lit("_")), (F.col("doc_id") % 200).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", stem.alias("stem")).filter("stem <> ''")
    return rows.select("doc_id", T.cut_file_name(F.concat("stem", F.lit(".docx"))).alias("name"))


@query("SELECT c_custkey, c_custkey % 1000 AS value FROM customer")
def numerals_read(spark: SparkSession, d: str) -> DataFrame:
    """Keys written out as Chinese numerals and read again; the SQL gives the numbers themselves."""
    n = (F.col("c_custkey") % 1000).cast("int")
    h, t, o = F.floor(n / 100).cast("int"), F.floor(n / 10).cast("int") % 10, n % 10
    digit = lambda k: F.substring(F.lit(T.DIGITS), k + 1, F.lit(1))
    hundreds = F.when(h > 0, F.concat(digit(h), F.lit("百"))).otherwise("")
    tens = F.when((t == 1) & (h == 0), "十").when(t > 0, F.concat(digit(t), F.lit("十"))).when((h > 0) & (o > 0), "零").otherwise("")
    written = F.concat(hundreds, tens, F.when(o > 0, digit(o)).otherwise(""))
    return table(spark, d, "customer").select("c_custkey", T.numeral(written).alias("value"))


@query(
    f"WITH said AS (SELECT item_id, unnest(range(len(l))) AS k, unnest(l) AS w FROM (SELECT item_id, regexp_extract_all(text, '{A.WORD}') AS l FROM benchmark)) "
    "SELECT item_id, word, place FROM (SELECT item_id, w AS word, row_number() OVER (PARTITION BY item_id ORDER BY count(*) * length(w) DESC, length(w) DESC, min(k)) AS place FROM said WHERE len(list_distinct(string_split(w, ''))) >= 2 GROUP BY item_id, w) WHERE place <= 10"
)
def problem_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The ten keywords of each problem text, in the order in which they are tried."""
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(A.keywords(F.col("text"))).alias("k", "word"))
    return rows.select("item_id", "word", (F.col("k") + 1).cast("long").alias("place"))


@query(
    """WITH p AS (SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
  s AS (SELECT doc_id, section, count(*) - 1 AS n FROM (SELECT doc_id, sum(CASE WHEN length(line) BETWEEN 1 AND 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS section FROM p) WHERE section > 0 GROUP BY doc_id, section)
  SELECT doc_id, count(*) AS n_sections, count(*) FILTER (n = 1) AS n_single, count(*) FILTER (n = 1) >= 3 AS many FROM s GROUP BY doc_id"""
)
def single_paragraph_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of one paragraph in each text, and whether there are three or more; a short line begins a section."""
    heads = F.sum(F.length("text").between(1, 40).cast("int")).over(Window.partitionBy("doc_id").orderBy("para_idx"))
    sections = paragraphs(table(spark, d, "documents")).select("doc_id", heads.alias("section")).filter("section > 0").groupBy("doc_id", "section").agg((F.count("*") - 1).alias("n"))
    single = F.count_if(F.col("n") == 1)
    return sections.groupBy("doc_id").agg(F.count("*").alias("n_sections"), single.alias("n_single"), (single >= 3).alias("many"))


_LANG_SHARES = {"en": 0.85, "de": 0.85, "fr": 0.9, "es": 0.9}


@query(
    "SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS n_good, avg(quality) >= CASE WHEN lang IN ('en', 'de') THEN 0.85 WHEN lang IN ('fr', 'es') THEN 0.9 ELSE 1.0 END AS reached FROM documents JOIN labels USING (doc_id) GROUP BY lang HAVING count(*) >= 5"
)
def share_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Share of good texts against the threshold of their kind, for kinds with five texts or more."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    shares = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), F.avg("quality").alias("share")).filter("n >= 5")
    return shares.select("lang", "n", "n_good", (F.col("share") >= T.mapped(F.col("lang"), _LANG_SHARES, 1.0)).alias("reached"))


@query("SELECT doc_id, CASE WHEN contains(left(text, 500), 'The') THEN 'journal' WHEN contains(text, 'License') THEN 'license' WHEN contains(text, 'The') THEN 'thesis' ELSE 'course' END AS kind FROM documents WHERE text IS NOT NULL")
def paper_kind(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rules, of which the first reads the first 500 characters only."""
    text = F.col("text")
    kind = F.when(F.substring(text, 1, 500).contains("The"), "journal").when(text.contains("License"), "license").when(text.contains("The"), "thesis").otherwise("course")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", kind.alias("kind"))


@query(f"WITH {PARAS}, {SENTS} SELECT doc_id, para_idx, sent_idx, trim(sentence) = '' OR length(regexp_replace(sentence, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / greatest(length(sentence), 1) < 0.1 OR regexp_matches(sentence, '\\.{{5,}}|[□■▯]|�') AS scanned FROM sents")
def scanned_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of text that look like a failed scan: blank, hardly letters or digits, runs of dots, blocks or replacement characters."""
    pieces = paragraphs(table(spark, d, "documents")).select("doc_id", "para_idx", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "sentence"))
    return pieces.select("doc_id", "para_idx", F.col("sent_idx").cast("long").alias("sent_idx"), T.looks_scanned(F.col("sentence")).alias("scanned"))


@query(
    f"""WITH {PARAS}, {SENTS}, w AS (SELECT doc_id, para_idx, length(sentence) AS n, sum(length(sentence) + 1) OVER (PARTITION BY doc_id, para_idx ORDER BY sent_idx) AS upto, sum(length(sentence) + 1) OVER (PARTITION BY doc_id, para_idx) AS whole FROM sents)
  SELECT * FROM (SELECT doc_id, para_idx, CAST(upto - n - 1 AS BIGINT) AS span_start, CAST(least(upto, whole - 1) AS BIGINT) AS span_end FROM w) WHERE span_start < span_end"""
)
def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    """[span_start, span_end) of every sentence; the spans of a line tile it."""
    return N.sentence_spans(paragraphs(table(spark, d, "documents")))


@query("SELECT page_id, array_to_string(list_filter(['<title', '<nav', '<article', '<footer', '<aside'], lambda t: NOT contains(html, t)), ',') AS missing FROM pages WHERE html IS NOT NULL")
def required_parts(spark: SparkSession, d: str) -> DataFrame:
    """Required parts that a page lacks, in the order of the list."""
    lacks = F.filter(F.array(*[F.lit(t) for t in ("<title", "<nav", "<article", "<footer", "<aside")]), lambda t: ~F.contains("html", t))
    return table(spark, d, "pages").filter("html is not null").select("page_id", F.array_join(lacks, ",").alias("missing"))


@query("WITH k AS (SELECT DISTINCT url AS key FROM pages WHERE starts_with(url, 'https://')), p AS (SELECT key FROM k ORDER BY key LIMIT 5 OFFSET 5) SELECT key, (SELECT count(*) FROM k) > 10 AS is_truncated, CASE WHEN (SELECT count(*) FROM k) > 10 THEN (SELECT max(key) FROM p) END AS next_token FROM p")
def listing_next_page(spark: SparkSession, d: str) -> DataFrame:
    """The page after the first one, by the token that the first gives."""
    pages = table(spark, d, "pages")
    token = listing_page(pages, "url", "https://", 5).first()["next_token"]  # one row
    return listing_page(pages, "url", "https://", 5, token)


@query("SELECT page_id, html FROM pages WHERE strlen(html) <= 4096")
def payloads_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Payloads within the reader's bound."""
    return table(spark, d, "pages").select("page_id", "html").filter(F.octet_length("html") <= 4096)
