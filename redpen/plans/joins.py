"""Joins that need more than an equal key: places of matches, covering and overlapping spans, dated terms, near-identical headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.functions import spans as M
from redpen.operators import asof, intervals, near
from redpen.operators import crossref as C
from redpen.operators import locate as L
from redpen.operators import redact as X
from redpen.operators import report as P
from redpen.operators.crossref import AUTHOR
from redpen.plans.registry import _HITS, ALL, PARAS, RANK, _issues, query
from redpen.schema import CATEGORY_LABEL, COMMENT_LABEL, ENTRY_LABEL
from redpen.sources import store
from redpen.sources.tables import paragraphs, table, with_offsets

# Match spans

#: Names, years and mail addresses: three patterns whose places are looked for.
PATTERNS = {"name": AUTHOR, "number": r"[0-9]{2,4}", "mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}


def _spans_sql(kind: str, pattern: str = "") -> str:
    """Places of matches of a pattern in DuckDB: gaps and matches, their lengths summed up."""
    p = pattern or PATTERNS[kind]
    return f"""SELECT doc_id, '{kind}' AS kind, k - 1 AS nr, CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0) AS BIGINT) AS span_start, hits[k] AS hit
  FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM documents))"""


_ALL_SPANS = " UNION ALL ".join(_spans_sql(k) for k in PATTERNS)
_CONTEXT = "trim(replace(substr(text, greatest(span_start - 40, 0) + 1, span_start + length(hit) + 40 - greatest(span_start - 40, 0)), chr(10), ' '), ' ')"


def _matches(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """(doc_id, kind, nr, span_start, span_end, hit, context) of every match."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    of = lambda k: F.transform(M.match_spans(F.col("text"), PATTERNS[k]), lambda m, i: F.struct(F.lit(k).alias("kind"), i.cast("long").alias("nr"), m["span_start"].alias("span_start"), m["span_end"].alias("span_end"), m["hit"].alias("hit")))
    found = F.flatten(F.array(*[of(k) for k in kinds]))
    context = lambda m: m.withField("context", M.around(F.col("text"), m["span_start"], m["span_end"]))
    return docs.select("doc_id", F.explode(F.transform(found, context)).alias("m")).select("doc_id", "m.*")


@query(f"SELECT doc_id, kind, nr, span_start, span_start + length(hit) AS span_end, hit, md5({_CONTEXT}) AS context_md5 FROM ({_ALL_SPANS}) JOIN documents USING (doc_id)")
def match_spans(spark: SparkSession, d: str) -> DataFrame:
    """Place, text and context of every match of three patterns."""
    return _matches(spark, d, *PATTERNS).select("doc_id", "kind", "nr", "span_start", "span_end", "hit", F.md5("context").alias("context_md5"))


@query(f"""SELECT doc_id, nr, regexp_extract(hit, '^([A-Z][a-z]+)', 1) AS given, regexp_extract(hit, '\\s([A-Z])\\.?\\s', 1) AS initial, regexp_extract(hit, '([A-Z][a-z]+)$', 1) AS family FROM ({_spans_sql("name")})""")
def named_fields(spark: SparkSession, d: str) -> DataFrame:
    """Given name, initial and family name of every name, with its number in the text."""
    part = lambda p: F.regexp_extract("hit", p, 1)
    return _matches(spark, d, "name").select("doc_id", "nr", part("^([A-Z][a-z]+)").alias("given"), part(r"\s([A-Z])\.?\s").alias("initial"), part("([A-Z][a-z]+)$").alias("family"))


# Author counts on both sides with the first place of each


def _side(of: int) -> str:
    return f"SELECT hit AS author, count(*) AS n, arg_min(struct_pack(d := doc_id, c := {_CONTEXT}), (doc_id, nr)) AS f FROM ({_spans_sql('name')}) JOIN documents USING (doc_id) WHERE doc_id % 2 = {of} GROUP BY hit"


@query(f"""SELECT coalesce(a.author, b.author) AS author, coalesce(a.n, 0) AS text_count, coalesce(b.n, 0) AS refs_count, a.f.d AS text_doc, md5(a.f.c) AS text_context_md5, b.f.d AS refs_doc, md5(b.f.c) AS refs_context_md5,
  CASE WHEN b.n IS NULL THEN 'text_only' WHEN a.n IS NULL THEN 'refs_only' ELSE 'matched' END AS status FROM ({_side(0)}) a FULL JOIN ({_side(1)}) b ON a.author = b.author""")
def authors_in_context(spark: SparkSession, d: str) -> DataFrame:
    """Names of both sides (documents of even and of odd number) with counts, status, and where and in what context each side has them first."""
    rows = _matches(spark, d, "name").select("doc_id", "nr", F.col("hit").alias("author"), "context")
    first = F.min_by(F.struct("doc_id", "context"), F.struct("doc_id", "nr"))
    a, b = (rows.filter(F.col("doc_id") % 2 == k).groupBy("author").agg(F.count("*").alias(f"{side}_count"), first.alias(side)) for k, side in enumerate(("text", "refs")))
    status = F.when(F.col("refs").isNull(), "text_only").when(F.col("text").isNull(), "refs_only").otherwise("matched")
    places = [c for s in ("text", "refs") for c in (F.col(f"{s}.doc_id").alias(f"{s}_doc"), F.md5(f"{s}.context").alias(f"{s}_context_md5"))]
    return a.join(b, "author", "full_outer").select("author", *[F.coalesce(f"{s}_count", F.lit(0)).alias(f"{s}_count") for s in ("text", "refs")], *places, status.alias("status"))


# Spans that cover or overlap one another

_PLACED = f"""placed AS (SELECT doc_id, para_idx, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM paras),
spans AS (SELECT doc_id AS part, 'p' || para_idx AS id, position AS span_start, position + length(text) AS span_end FROM placed WHERE length(text) > 0
  UNION ALL SELECT doc_id, kind || nr, greatest(span_start - 40, 0), span_start + length(hit) + 40 FROM ({_spans_sql("number")} UNION ALL {_spans_sql("name")}))"""
_BEFORE = "(j.span_start < i.span_start OR (j.span_start = i.span_start AND (j.span_end > i.span_end OR (j.span_end = i.span_end AND j.id < i.id))))"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines that aren't empty, and the surroundings of names and numbers, as intervals of each document."""
    lines = with_offsets(paragraphs(table(spark, d, "documents")), 1).filter("length > 0")
    lines = lines.select(F.col("doc_id").alias("part"), F.concat(F.lit("p"), "para_idx").alias("id"), F.col("position").alias("span_start"), (F.col("position") + F.col("length")).alias("span_end"))
    near_by = _matches(spark, d, "name", "number").select(F.col("doc_id").alias("part"), F.concat("kind", F.col("nr").cast("string")).alias("id"), F.greatest(F.col("span_start") - 40, F.lit(0)).alias("span_start"), (F.col("span_end") + 40).alias("span_end"))
    return lines.unionByName(near_by)


@query(
    f"""WITH {PARAS}, {_PLACED}
SELECT i.part AS doc_id, i.id, i.span_start, i.span_end, arg_max(j.id, (j.span_start, -j.span_end, j.id)) FILTER (j.span_end >= i.span_end) AS cover_id,
  arg_max(j.id, (j.span_start, -j.span_end, j.id)) FILTER (j.span_end > i.span_start AND j.span_end < i.span_end) AS overlap_id
FROM spans i LEFT JOIN spans j ON i.part = j.part AND {_BEFORE} AND j.span_end > i.span_start GROUP BY ALL"""
)
def covering_spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines and surroundings of matches, each linked to the last one before that contains it and the last one that reaches into it."""
    return intervals.linked(_spans(spark, d)).withColumnRenamed("part", "doc_id")


# Dated terms

_TERMS = "terms AS (SELECT l_suppkey, CAST(l_shipdate AS TIMESTAMP) AS since, max(l_discount) AS discount FROM lineitem GROUP BY ALL)"
_LINES = "facts AS (SELECT DISTINCT o_orderkey, l_suppkey, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's discount from each day on which it shipped."""
    return table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_shipdate").cast("timestamp").alias("since")).agg(F.max("l_discount").alias("discount"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate")).join(lines, "o_orderkey").distinct().select("o_orderkey", "l_suppkey", "o_orderdate")


@query(f"WITH {_TERMS}, {_LINES} SELECT o_orderkey, f.l_suppkey, epoch_us(o_orderdate) AS ordered_us, epoch_us(since) AS since_us, discount FROM facts f ASOF LEFT JOIN terms t ON f.l_suppkey = t.l_suppkey AND f.o_orderdate >= t.since")
def terms_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each order line's supplier terms as they were on the day of the order."""
    found = asof.as_of(_facts(spark, d), _terms(spark, d), "l_suppkey", "o_orderdate", "since", ["since", "discount"])
    return found.select("o_orderkey", "l_suppkey", F.unix_micros("o_orderdate").alias("ordered_us"), F.unix_micros("since").alias("since_us"), "discount")


@query(
    f"WITH {_TERMS}, {_LINES} SELECT o_orderkey, f.l_suppkey, epoch_us(since) AS since_us, discount FROM facts f JOIN terms t ON f.l_suppkey = t.l_suppkey AND since <= o_orderdate AND o_orderdate < since + to_days(CAST(10 + epoch_us(since) // 86400000000 % 20 AS INTEGER))"
)
def terms_in_force(spark: SparkSession, d: str) -> DataFrame:
    """Each order line with all its supplier's terms that held on that day; a term holds for 10 to 29 days, and terms overlap."""
    days = 10 + F.expr("unix_micros(since) div 86400000000") % 20
    terms = _terms(spark, d).withColumn("until", F.timestamp_micros(F.unix_micros("since") + days * 86_400_000_000))
    found = asof.in_force(_facts(spark, d), terms, "l_suppkey", "o_orderdate", "since", "until", ["since", "discount"])
    return found.select("o_orderkey", "l_suppkey", F.unix_micros("since").alias("since_us"), "discount")


# Near-identical headings

#: DuckDB measures bytes, so the letters of several bytes that headings have are replaced by control characters on its side.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüáúÁÚ"
_CODES = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 32)][: len(_LETTERS)])
_HEADS = f"heads AS (SELECT DISTINCT text, translate(text, '{_LETTERS}', {_CODES}) AS plain FROM paras WHERE length(text) BETWEEN 1 AND 40)"


@query(
    f"WITH {PARAS}, {_HEADS} SELECT a.text AS a, b.text AS b, CAST(levenshtein(a.plain, b.plain) AS INTEGER) AS distance FROM heads a JOIN heads b ON length(b.text) BETWEEN length(a.text) AND length(a.text) + 2 AND (length(a.text) < length(b.text) OR a.text < b.text) WHERE levenshtein(a.plain, b.plain) <= 2"
)
def near_headings(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different headings (short lines) within two edits, over the whole corpus; equal ones are `repeated_paragraphs`."""
    heads = paragraphs(table(spark, d, "documents")).filter(F.length("text").between(1, 40)).select("text")
    return near.near_pairs(heads, "text", 2)


# Anonymised texts

#: What is taken for a personal value, and in how many documents a name has to stand to be public.
PERSONAL = {"mail": PATTERNS["mail"], "name": AUTHOR, "number": r"[0-9]{6,}"}
PUBLIC = 10


@query(
    f"""WITH RECURSIVE hits AS ({" UNION ALL ".join(_spans_sql(k, p) for k, p in PERSONAL.items())}),
found AS (SELECT doc_id, hit AS value, min(kind) AS kind, min(span_start) AS first FROM hits GROUP BY doc_id, hit),
secret AS (SELECT *, '{X.OPEN}' || chr({X.FIRST_KIND} + list_position({sorted(PERSONAL)}, kind) - 1) || translate(CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY first, value) AS VARCHAR), '0123456789', '{X.DIGITS}') || '{X.CLOSE}' AS mark,
  row_number() OVER (PARTITION BY doc_id ORDER BY length(value) DESC, value) AS nr, count(*) OVER (PARTITION BY doc_id) AS n
  FROM found WHERE (kind, value) NOT IN (SELECT (kind, value) FROM found WHERE kind = 'name' GROUP BY kind, value HAVING count(*) >= {PUBLIC})),
r AS (SELECT doc_id, 0 AS nr, text FROM documents UNION ALL SELECT r.doc_id, s.nr, replace(r.text, s.value, s.mark) FROM r JOIN secret s ON s.doc_id = r.doc_id AND s.nr = r.nr + 1)
SELECT r.doc_id, n AS n_values, md5({"".join("replace(" for _ in PERSONAL)}replace(translate(text, '{X.DIGITS}', '0123456789'), '{X.CLOSE}', '>'){"".join(f", '{X.OPEN}' || chr({X.FIRST_KIND + k}), '<{name}-')" for k, name in enumerate(sorted(PERSONAL)))}) AS redacted_md5
FROM r JOIN (SELECT DISTINCT doc_id, n FROM secret) m ON m.doc_id = r.doc_id AND m.n = r.nr"""
)
def redacted_by_value(spark: SparkSession, d: str) -> DataFrame:
    """Texts in which every personal value found anywhere in the document is a numbered placeholder; public names stay."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    values = store.written(X.found_values(docs, PERSONAL), "values")
    found = X.redacted(docs, PERSONAL, X.public_values(values, "name", PUBLIC), values)
    return found.select("doc_id", "n_values", F.md5("text").alias("redacted_md5"))


# Where comments go


_MOUNTED = f""", damaged AS (SELECT doc_id, seq, para_idx AS own, CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 5 = 0 THEN 'no such text here' ELSE anchor_text END AS anchor_text, CASE WHEN seq % 2 = 0 THEN para_idx ELSE 999999 END AS para_idx, CASE WHEN seq % 4 = 1 THEN left(anchor_text, 5) ELSE 'no such chapter' END AS chapter,
  seq % 6 = 0 AS cell, seq % 12 = 0 AS in_cell, CASE WHEN seq % 7 = 0 THEN seq END AS char_offset, CASE WHEN seq % 4 = 2 THEN seq % 3 END AS sentence_index FROM grouped),
anchors AS (SELECT doc_id, seq, anchor_text FROM damaged WHERE NOT cell){_HITS.split("FROM grouped)", 1)[1]},
placed AS (SELECT a.*, CASE WHEN cell THEN CASE WHEN in_cell AND own % 4 = 0 THEN own END WHEN a.anchor_text <> '' THEN hit_para ELSE p.para_idx END AS place, CASE WHEN cell THEN 'cell' WHEN a.anchor_text <> '' THEN 'anchor' ELSE 'index' END AS arm
  FROM damaged a LEFT JOIN hits h ON a.doc_id = h.doc_id AND a.seq = h.seq LEFT JOIN paras p ON p.doc_id = a.doc_id AND p.para_idx = a.para_idx),
heads AS (SELECT c.doc_id, chapter, min(para_idx) AS head FROM (SELECT DISTINCT doc_id, trim(chapter) AS chapter FROM placed WHERE place IS NULL AND trim(chapter) <> '') c JOIN paras p ON p.doc_id = c.doc_id AND contains(text, chapter) GROUP BY ALL),
mounted AS (SELECT p.*, coalesce(place, head, 0) AS spot, CASE WHEN place IS NOT NULL THEN arm WHEN coalesce(head, 0) = 0 THEN 'document' ELSE 'chapter' END AS how FROM placed p LEFT JOIN heads h ON h.doc_id = p.doc_id AND h.chapter = trim(p.chapter)),
sized AS (SELECT doc_id, para_idx, sent_idx, sum(length(sentence) + 1) OVER (PARTITION BY doc_id, para_idx ORDER BY sent_idx) AS upto, length(sentence) + 1 AS n FROM sents),
spots AS (SELECT m.*, length(text) AS size, strpos(text, substr(trim(m.anchor_text), 1, 30)) - 1 AS hit, length(substr(trim(m.anchor_text), 1, 30)) AS n_needle, upto - n AS begins, upto FROM mounted m JOIN paras p ON p.doc_id = m.doc_id AND p.para_idx = spot LEFT JOIN sized s ON s.doc_id = m.doc_id AND s.para_idx = spot AND s.sent_idx = sentence_index AND upto - n < length(text))
SELECT doc_id, seq, spot AS place, how, CASE how WHEN 'document' THEN '{L.TO_DOCUMENT}' WHEN 'chapter' THEN '{L.TO_CHAPTER}' END AS warning,
  CAST(CASE WHEN char_offset IS NOT NULL THEN least(char_offset, size) WHEN n_needle > 0 AND hit >= 0 THEN hit WHEN begins IS NOT NULL THEN begins ELSE 0 END AS BIGINT) AS span_start,
  CAST(CASE WHEN char_offset IS NOT NULL THEN least(least(char_offset, size) + 10, size) WHEN n_needle > 0 AND hit >= 0 THEN least(hit + n_needle, size) WHEN begins IS NOT NULL THEN least(upto, size) ELSE size END AS BIGINT) AS span_end FROM spots"""


@query(ALL + _MOUNTED)
def mounted_issues(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph and span of every comment by all arms: cell, anchor, index, chapter, document; offset, anchor, sentence, paragraph. Issues are
    damaged by rules on their number; every fourth line counts as a table cell."""
    s, para = F.col("seq"), F.col("para_idx")
    cell = {"table_index": F.floor(para / 10), "row": para % 10, "col": F.lit(0), "cell_para": F.when(s % 12 == 0, 0).otherwise(1)}
    issues = _issues(spark, d).select(
        "doc_id", "seq", F.when(s % 3 == 0, "").when(s % 5 == 0, "no such text here").otherwise(F.col("anchor_text")).alias("anchor_text"), F.when(s % 2 == 0, para).otherwise(999999).alias("para_idx"),
        F.when(s % 4 == 1, F.left("anchor_text", F.lit(5))).otherwise("no such chapter").alias("chapter"), *[F.when(s % 6 == 0, v).cast("long").alias(c) for c, v in cell.items()],
        F.when(s % 7 == 0, s).alias("char_offset"), F.when(s % 4 == 2, s % 3).alias("sentence_index"),
    )
    issues = store.written(issues, "issues")
    paras = paragraphs(table(spark, d, "documents"))
    p = F.col("para_idx")
    cells = paras.filter(p % 4 == 0).select("doc_id", F.floor(p / 10).alias("table_index"), (p % 10).alias("row"), F.lit(0).cast("long").alias("col"), F.lit(0).cast("long").alias("cell_para"), "para_idx")
    places = L.mounted(issues, paras, cells).join(issues.select("doc_id", "seq", "anchor_text", "char_offset", "sentence_index"), ["doc_id", "seq"]).join(paras.withColumnRenamed("para_idx", "place"), ["doc_id", "place"])
    span = L.offset_span(F.col("text"), F.col("char_offset"), F.col("anchor_text"), F.col("sentence_index"))
    return places.withColumn("span", span).select("doc_id", "seq", "place", "how", "warning", "span.*")


# Citations against references, by key and by number

_YEAR = "nullif(regexp_extract(context, '(19|20)[0-9]{2}', 0), '')"
_CITES = f"""named AS (SELECT doc_id, nr, hit AS author, {_CONTEXT} AS context FROM ({_spans_sql("name")}) JOIN documents USING (doc_id)),
keyed AS (SELECT doc_id, nr, author, {_YEAR} AS year, lower(regexp_replace(author, '[\\s.,;:''"\\[\\]()]', '', 'g')) AS form, coalesce({_YEAR}, '') AS y FROM named),
cited AS (SELECT * FROM keyed WHERE doc_id % 2 = 0), refs AS (SELECT * FROM keyed WHERE doc_id % 2 = 1),
numbers AS (SELECT DISTINCT CAST(hit AS BIGINT) - 10 AS nr FROM ({_spans_sql("number")}) WHERE doc_id % 2 = 0),
unnumbered AS (SELECT * FROM refs WHERE nr NOT IN (SELECT nr FROM numbers))"""


@query(
    f"""WITH {_CITES} SELECT doc_id, nr, author, year, 'footnote_missing_reference' AS kind, 'major' AS severity FROM cited WHERE (form, y) NOT IN (SELECT (form, y) FROM refs)
  UNION ALL SELECT doc_id, nr, author, year, 'citation_format_inconsistent', 'major' FROM unnumbered WHERE (form, y) IN (SELECT (form, y) FROM cited)
  UNION ALL SELECT doc_id, nr, author, year, 'reference_not_cited', 'minor' FROM unnumbered WHERE (form, y) NOT IN (SELECT (form, y) FROM cited)"""
)
def citation_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Names with a year near them: citations (documents of even number) against references (odd), and references against the numbers that the former hold."""
    year = F.nullif(F.regexp_extract("context", "(19|20)[0-9]{2}", 0), F.lit(""))
    named = _matches(spark, d, "name").select("doc_id", "nr", F.col("hit").alias("author"), year.alias("year"))
    even = F.col("doc_id") % 2 == 0
    numbers = _matches(spark, d, "number").filter(even).select((F.col("hit").cast("long") - 10).alias("nr"))
    return C.citation_gaps(named.filter(even), named.filter(~even), numbers)


# Reports and comments with suggestions


def _suggested(spark: SparkSession, d: str) -> DataFrame:
    given = F.slice(F.array("problem", "anchor_text", "excerpt"), F.lit(1), (F.col("seq") % 4).cast("int"))
    return _issues(spark, d).withColumn("suggestion", given)


_LABELS = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_LABEL.items()) + " ELSE category END"
_COMMENTED = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COMMENT_LABEL.items()) + " ELSE category END"
_SEVERITIES = "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ENTRY_LABEL.items()) + " END"
_GIVEN = "[problem, anchor_text, excerpt][1:CAST(seq % 4 AS INTEGER)]"


@query(
    ALL
    + f""", s AS (SELECT *, {_GIVEN} AS given, row_number() OVER (PARTITION BY doc_id ORDER BY {RANK}, seq) AS nr FROM grouped)
SELECT doc_id, md5('共 **' || count(*) || '** 项问题：致命 ' || count(*) FILTER (severity = 'fatal') || ' 项 / 严重 ' || count(*) FILTER (severity = 'major') || ' 项 / 轻微 ' || count(*) FILTER (severity = 'minor') || ' 项' || chr(10) || chr(10)
  || string_agg('### ' || nr || '. ' || {_SEVERITIES} || ' 【' || {_LABELS} || '】' || chr(10) || chr(10) || '**问题**：' || replace(replace(problem, '|', '｜'), chr(10), ' ') || chr(10) || chr(10)
    || CASE WHEN excerpt <> '' THEN '**原文**：…' || replace(left(excerpt, 80), chr(10), ' ') || '…' || chr(10) || chr(10) ELSE '' END
    || '**建议**：' || CASE WHEN len(given) > 0 THEN replace(array_to_string(given, '；'), chr(10), ' ') ELSE '请根据上下文修改' END || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY nr)) AS report_md5 FROM s GROUP BY doc_id"""
)
def entry_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports with counts at their head and suggestions in their entries."""
    return P.entry_reports(_suggested(spark, d)).select("doc_id", F.md5("report").alias("report_md5"))


@query(
    ALL
    + f""", s AS (SELECT *, {_GIVEN} AS given FROM grouped)
SELECT doc_id, seq, CASE WHEN seq % 5 = 0 THEN '{L.TO_CHAPTER}: ' ELSE '' END || '【' || {_COMMENTED} || '】【' || CASE severity WHEN 'fatal' THEN '致命' WHEN 'major' THEN '重要' ELSE '轻微' END || '】' || problem || ' → ' || coalesce(given[1], '')
  || CASE WHEN len(given) > 1 THEN chr(10) || '其他建议：' || array_to_string(list_transform(given[2:], lambda g: chr(10) || '  · ' || g), '') ELSE '' END || chr(10) || '[id: ' || id || ']' AS body FROM s"""
)
def suggested_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments with all suggestions; every fifth carries the warning of a place that wasn't found."""
    warning = F.when(F.col("seq") % 5 == 0, L.TO_CHAPTER)
    return _suggested(spark, d).select("doc_id", "seq", P.comment_text(warning).alias("body"))
