"""Every registered query of the engine's own operators, each with SQL for DuckDB on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.functions import text as T
from redpen.operators import crossref as X
from redpen.operators import findings as N
from redpen.operators import issues as I
from redpen.operators import locate as L
from redpen.operators import rank as R
from redpen.operators import report as P
from redpen.schema import EVIDENCE
from redpen.sources.tables import listing_page, paragraphs, table, with_offsets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Common tables of the SQL side, spliced in front of each query that uses them.
PARAS = "paras AS (SELECT doc_id, unnest(range(len(l))) AS para_idx, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_DOTS = "regexp_replace(regexp_replace(text, '([A-Za-z0-9])\\.([A-Za-z0-9])', '\\1' || chr(57344) || '\\2', 'g'), '([A-Za-z0-9])\\.([A-Za-z0-9])', '\\1' || chr(57344) || '\\2', 'g')"
SENTS = f"sents AS (SELECT doc_id, para_idx, unnest(range(len(l))) AS sent_idx, replace(unnest(l), chr(57344), '.') AS sentence FROM (SELECT doc_id, para_idx, string_split_regex({_DOTS}, '[.!?;。！？；]') AS l FROM paras))"
FOUND = """found AS (
  SELECT doc_id, para_idx, 0 AS sub, text, length(text) AS n_chars, 'structure' AS category, 'major' AS severity, 'paragraph' AS scope FROM paras WHERE length(text) > 800
  UNION ALL SELECT doc_id, para_idx, 0, text, length(text), 'academic-integrity', 'fatal', 'paragraph' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY para_idx) AS k FROM paras WHERE trim(text, ' ') <> '') WHERE k > 1
  UNION ALL SELECT doc_id, para_idx, sent_idx, sentence, length(sentence), 'language', 'minor', 'sentence' FROM sents WHERE length(sentence) > 80)"""
ISSUES = """issues AS (SELECT f.doc_id, row_number() OVER (PARTITION BY f.doc_id ORDER BY para_idx, category, sub) AS seq, 'thesis' AS source, category, severity, scope, d.lang || '/' || d.source AS chapter, para_idx,
  CASE WHEN length(f.text) > 60 THEN substr(f.text, 1, 57) || '...' ELSE f.text END AS excerpt, substr(trim(f.text, ' '), 1, 60) AS anchor_text, category || ': ' || f.n_chars || ' characters' AS problem
  FROM found f JOIN documents d ON f.doc_id = d.doc_id)"""
GROUPED = """grouped AS (SELECT * EXCLUDE (first_seq), printf('g-%03d', dense_rank() OVER (PARTITION BY doc_id ORDER BY first_seq)) AS group_id, printf('%s-%s-%03d', source, category, seq) AS id
  FROM (SELECT *, min(seq) OVER (PARTITION BY doc_id, source, category, chapter, para_idx) AS first_seq FROM issues))"""
ALL = f"WITH {PARAS}, {SENTS}, {FOUND}, {ISSUES}, {GROUPED} "
RANK = "CASE severity WHEN 'fatal' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 99 END"
_CONTENTS = "(length(text) <= 100 AND length(trim(text, chr(9) || ' ')) < 80 AND regexp_matches(text, '[0-9]{1,4}\\s*$'))"


def _paras(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs(table(spark, d, "documents"))


def _issues(spark: SparkSession, d: str) -> DataFrame:
    return N.with_groups(N.issues(table(spark, d, "documents")))


@query(f"WITH {PARAS} SELECT doc_id, para_idx, length(text) AS length, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM paras")
def paragraph_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs with the running offset that each begins at."""
    return with_offsets(_paras(spark, d)).select("doc_id", "para_idx", "length", "position")


@query(f"WITH {PARAS} SELECT doc_id, para_idx, length(text) AS n_chars FROM paras WHERE length(text) > 800")
def long_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return N.long_paragraphs(_paras(spark, d))


@query(f"WITH {PARAS}, {SENTS} SELECT doc_id, para_idx, sent_idx, length(sentence) AS n_chars FROM sents WHERE length(sentence) > 80")
def long_sentences(spark: SparkSession, d: str) -> DataFrame:
    return N.long_sentences(_paras(spark, d)).drop("sentence")


@query(f"WITH {PARAS} SELECT doc_id, md5(text) AS text_md5, count(*) AS n, min(para_idx) AS first_para FROM paras WHERE trim(text, ' ') <> '' GROUP BY doc_id, text HAVING count(*) > 1")
def repeated_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return N.repeated_paragraphs(_paras(spark, d))


_SIGNATURES = "SELECT md5(text) AS signature, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1"


@query(_SIGNATURES)
def duplicate_signature(spark: SparkSession, d: str) -> DataFrame:
    return N.duplicate_signatures(table(spark, d, "documents"))


@query(f"SELECT signature, doc_id, first_id FROM documents JOIN ({_SIGNATURES}) ON md5(text) = signature")
def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    return N.duplicate_members(table(spark, d, "documents"))


@query(ALL + "SELECT doc_id, seq, id, category, severity, scope, chapter, para_idx, excerpt, anchor_text, problem, group_id FROM grouped")
def issues_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Findings as issues, with group ids in order of first appearance."""
    return _issues(spark, d).select("doc_id", "seq", "id", "category", "severity", "scope", "chapter", "para_idx", "excerpt", "anchor_text", "problem", "group_id")


_BROKEN = """broken AS (SELECT doc_id, seq, source, CASE WHEN seq % 5 = 0 THEN 'odd' ELSE category END AS category, CASE WHEN seq % 7 = 0 THEN 'info' ELSE severity END AS severity, CASE WHEN seq % 3 = 0 THEN 'chapter' ELSE scope END AS scope,
  chapter, CASE WHEN seq % 11 = 0 THEN -5 ELSE para_idx END AS para_idx, CASE WHEN seq % 4 = 0 THEN '' ELSE excerpt || excerpt END AS excerpt, anchor_text, CASE WHEN seq % 6 = 0 THEN ' ' ELSE problem END AS problem, group_id, id FROM grouped)"""


def _broken(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq")
    return _issues(spark, d).select(
        "doc_id", "seq", "source", F.when(s % 5 == 0, "odd").otherwise(F.col("category")).alias("category"), F.when(s % 7 == 0, "info").otherwise(F.col("severity")).alias("severity"),
        F.when(s % 3 == 0, "chapter").otherwise(F.col("scope")).alias("scope"), "chapter", F.when(s % 11 == 0, -5).otherwise(F.col("para_idx")).cast("long").alias("para_idx"),
        F.when(s % 4 == 0, "").otherwise(F.concat("excerpt", "excerpt")).alias("excerpt"), "anchor_text", F.when(s % 6 == 0, " ").otherwise(F.col("problem")).alias("problem"), "group_id", "id",
    )


_FIXED = """fixed AS (SELECT doc_id, seq, source, category, severity, scope, para_idx, CASE WHEN scope IN ('document', 'chapter') THEN '' WHEN length(e) > 60 THEN substr(e, 1, 57) || '...' ELSE e END AS excerpt, problem, printf('%s-%s-%03d', source, category, seq) AS id
  FROM (SELECT doc_id, seq, source, CASE WHEN category = 'odd' THEN 'argumentation' ELSE category END AS category, CASE WHEN severity = 'info' THEN 'minor' ELSE severity END AS severity, scope, greatest(para_idx, -1) AS para_idx,
    CASE WHEN excerpt = '' THEN substr(anchor_text, 1, 60) ELSE excerpt END AS e, CASE WHEN trim(problem) = '' THEN '(no description)' ELSE substr(problem, 1, 200) END AS problem FROM broken))"""


@query(ALL + f", {_BROKEN}, {_FIXED} SELECT * FROM fixed")
def issues_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Damaged issues repaired to the contract."""
    return I.normalise(_broken(spark, d)).select("doc_id", "seq", "source", "category", "severity", "scope", "para_idx", "excerpt", "problem", "id")


_WORSE = """worse AS (SELECT * REPLACE (CASE WHEN seq % 13 = 0 THEN 'web' ELSE source END AS source, CASE WHEN seq % 17 = 0 THEN 'page' ELSE scope END AS scope, CASE WHEN seq % 19 = 0 THEN 'x' || id ELSE id END AS id, CASE WHEN seq % 10 = 0 THEN anchor_text || anchor_text ELSE anchor_text END AS anchor_text,
  CASE WHEN seq % 9 = 0 THEN repeat('p', 201) ELSE problem END AS problem, CASE WHEN seq % 14 = 0 THEN '' ELSE chapter END AS chapter, CASE WHEN seq % 15 = 0 THEN 'g-1' ELSE group_id END AS group_id) FROM broken)"""
_RULES = (
    ("source", "source = 'web'"), ("category", "category = 'odd'"), ("severity", "severity = 'info'"), ("scope", "scope = 'page'"),
    ("id pattern", "NOT regexp_matches(id, '^thesis-(structure|academic-integrity|language)-[0-9]{3}$')"), ("id source", "string_split(id, '-')[1] <> source"),
    ("id category", "NOT starts_with(id, source || '-' || category || '-')"), ("excerpt scope", "scope = 'chapter' AND excerpt <> ''"), ("excerpt length", "length(excerpt) > 60"), ("anchor length", "length(anchor_text) > 60"),
    ("problem length", "length(problem) NOT BETWEEN 1 AND 200"), ("chapter", "chapter = ''"), ("paragraph index", "para_idx < -1"), ("group pattern", "NOT regexp_matches(group_id, '^g-[0-9]{3,}$')"),
)


@query(ALL + f", {_BROKEN}, {_WORSE} " + " UNION ALL ".join(f"SELECT doc_id, seq, {k} AS rule_no, '{m}' AS message FROM worse WHERE {bad}" for k, (m, bad) in enumerate(_RULES)))
def issues_validated(spark: SparkSession, d: str) -> DataFrame:
    """One row for each of the fourteen rules that a damaged issue violates."""
    s = F.col("seq")
    damage = {"source": (13, F.lit("web")), "scope": (17, F.lit("page")), "id": (19, F.concat(F.lit("x"), "id")), "anchor_text": (10, F.concat("anchor_text", "anchor_text")), "problem": (9, F.lit("p" * 201)), "chapter": (14, F.lit("")), "group_id": (15, F.lit("g-1"))}
    return I.violations(_broken(spark, d).withColumns({c: F.when(s % k == 0, bad).otherwise(F.col(c)) for c, (k, bad) in damage.items()}))


@query(ALL + "SELECT doc_id, seq, excerpt FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, excerpt ORDER BY seq) AS k FROM grouped) WHERE k > 1")
def excerpt_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Second and later issues of a document with one excerpt."""
    return I.duplicate_ids(_issues(spark, d), "excerpt").select("doc_id", "seq", "excerpt")


@query(
    ALL
    + """SELECT doc_id, seq, group_id, first_group FROM (SELECT *, first_value(group_id) OVER (PARTITION BY doc_id, source, category, chapter, para_idx ORDER BY seq) AS first_group
  FROM (SELECT * REPLACE (CASE WHEN seq % 4 = 0 THEN 'g-999' ELSE group_id END AS group_id) FROM grouped)) WHERE group_id <> first_group"""
)
def group_dependency(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose group contradicts the first row of their key, among groups damaged on purpose."""
    damaged = _issues(spark, d).withColumn("group_id", F.when(F.col("seq") % 4 == 0, "g-999").otherwise(F.col("group_id")))
    return I.group_conflicts(damaged).select("doc_id", "seq", "group_id", "first_group")


@query(ALL + "SELECT doc_id, count(*) FILTER (severity = 'fatal') AS n_fatal, count(*) FILTER (severity = 'major') AS n_major, count(*) FILTER (severity = 'minor') AS n_minor, count(*) AS n_all FROM grouped GROUP BY doc_id")
def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.severity_counts(_issues(spark, d))


@query(ALL + "SELECT doc_id, count(*) AS n_all, count(*) FILTER (severity IN ('fatal', 'major')) AS n_grave, count(*) >= 8 AND count(*) FILTER (severity IN ('fatal', 'major')) >= 5 AS passed FROM grouped GROUP BY doc_id")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return R.quality_gate(_issues(spark, d))


_SUBSTANCE = "category IN ('argumentation', 'empirical', 'literature-review', 'legal-norms', 'academic-integrity')"


@query(ALL + f"SELECT doc_id, count(*) FILTER ({_SUBSTANCE} AND severity IN ('fatal', 'major')) AS n_substantive, count(*) AS n_all, count(*) FILTER ({_SUBSTANCE} AND severity IN ('fatal', 'major')) / count(*) >= 0.5 AS reached FROM grouped GROUP BY doc_id")
def substantive_ratio(spark: SparkSession, d: str) -> DataFrame:
    return R.substantive_ratio(_issues(spark, d))


@query(
    "SELECT lang, avg(quality) >= CASE lang WHEN 'en' THEN 0.85 WHEN 'de' THEN 0.85 ELSE 0.9 END AS reached, count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_good FROM documents JOIN labels USING (doc_id) GROUP BY lang"
)
def quality_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Share of good labels against a threshold by language (dimension join)."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    threshold = F.when(F.col("lang").isin("en", "de"), 0.85).otherwise(0.9)
    return rows.groupBy("lang").agg(F.avg("quality").alias("share"), F.count("*").alias("n"), F.sum("quality").alias("n_good")).select("lang", (F.col("share") >= threshold).alias("reached"), "n", "n_good")


@query(ALL + f"SELECT doc_id, seq, rank, rank <= 5 AS selected FROM (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY {RANK}, para_idx, id, seq) AS rank FROM grouped)")
def top_n_with_overflow(spark: SparkSession, d: str) -> DataFrame:
    """Every issue with its rank in the document and whether it is among the first five."""
    return R.top_n(_issues(spark, d), 5).select("doc_id", "seq", "rank", "selected")


_TAGS = "[" + ", ".join(f"'{t}'" for t in EVIDENCE) + "]"
_SCORED = f""", tagged AS (SELECT *, '[' || {_TAGS}[doc_id % {len(EVIDENCE)} + 1] || '] ' || problem AS said FROM grouped),
  scored AS (SELECT g.*, CASE severity WHEN 'fatal' THEN 30 WHEN 'major' THEN 20 ELSE 10 END + CASE WHEN count(*) OVER (PARTITION BY g.doc_id, group_id) >= 2 THEN 5 ELSE 0 END + CASE WHEN kinds >= 3 THEN 5 ELSE 0 END + CASE WHEN contains(said, '{R.CHECKED}') THEN 3 ELSE 0 END AS tenths
  FROM tagged g JOIN (SELECT doc_id, chapter, count(DISTINCT category) AS kinds FROM grouped GROUP BY doc_id, chapter) USING (doc_id, chapter))
  SELECT doc_id, seq, id, severity, chapter, para_idx, CAST(tenths AS DOUBLE) / 10 AS score FROM scored ORDER BY tenths DESC, {RANK}, chapter, id, doc_id, seq LIMIT 10"""


@query(ALL + _SCORED)
def flagship_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten issues of highest priority in the corpus; problems carry a tag of evidence, dealt by document."""
    tag = F.element_at(F.array(*[F.lit(t) for t in EVIDENCE]), (F.col("doc_id") % len(EVIDENCE) + 1).cast("int"))
    tagged = _issues(spark, d).withColumn("problem", F.concat(F.lit("["), tag, F.lit("] "), "problem"))
    return R.priority_top(tagged).select("doc_id", "seq", "id", "severity", "chapter", "para_idx", "score")


@query(
    ALL
    + f"""SELECT doc_id, seq, unnest(list_filter([CASE WHEN severity = 'fatal' THEN 'fatal problems' END, CASE WHEN {_SUBSTANCE} THEN 'substance' ELSE 'form' END, CASE WHEN scope IN ('sentence', 'span') THEN 'wording' END], lambda x: x IS NOT NULL)) AS part FROM grouped"""
)
def issue_routing(spark: SparkSession, d: str) -> DataFrame:
    return R.routed(_issues(spark, d))


@query(ALL + "SELECT doc_id, seq, CASE WHEN severity = 'fatal' AND NOT contains(anchor_text, 'the') THEN 'major' ELSE severity END AS severity FROM grouped")
def fatal_downgrade(spark: SparkSession, d: str) -> DataFrame:
    """Fatal issues without evidence (here: a word in the anchor) become major."""
    return I.downgraded(_issues(spark, d), F.contains("anchor_text", F.lit("the"))).select("doc_id", "seq", "severity")


@query(ALL + "SELECT doc_id, string_agg(CASE severity WHEN 'fatal' THEN '致命' WHEN 'major' THEN '重要' ELSE '轻微' END || ' | ' || id || ' | ' || replace(excerpt, '|', '｜'), chr(10) ORDER BY " + RANK + ", seq) AS report FROM grouped GROUP BY doc_id")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """One Markdown report body for each document, issues by severity, then position."""
    return P.reports(_issues(spark, d))


@query("WITH p AS (SELECT doc_id, unnest(range(len(l))) AS para_idx, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), "
       "w AS (SELECT item_id, substr(trim(text, ' ' || chr(10)), 1, 30) AS needle FROM benchmark) "
       "SELECT item_id, doc_id, para_idx FROM (SELECT w.item_id, p.doc_id, p.para_idx, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN length(text) <= 100 AND length(trim(text)) < 80 AND regexp_matches(text, '[0-9]{1,4}\\s*$') THEN 1 ELSE 0 END, doc_id, para_idx) AS k FROM p JOIN w ON contains(p.text, w.needle) WHERE needle <> '') WHERE k = 1")  # fmt: skip
def anchor_first_hit(spark: SparkSession, d: str) -> DataFrame:
    """First place in the corpus of each benchmark item's beginning."""
    return L.first_hits(table(spark, d, "benchmark"), _paras(spark, d))


_HITS = f""", anchors AS (SELECT doc_id, seq, anchor_text, para_idx FROM grouped), hits AS (SELECT doc_id, seq, hit_para, start, para_chars FROM (
  SELECT a.doc_id, a.seq, p.para_idx AS hit_para, strpos(p.text, needle) - 1 AS start, length(p.text) AS para_chars, row_number() OVER (PARTITION BY a.doc_id, a.seq ORDER BY CASE WHEN {_CONTENTS} THEN 1 ELSE 0 END, p.para_idx) AS k
  FROM (SELECT *, substr(trim(anchor_text, ' '), 1, 30) AS needle FROM anchors) a JOIN paras p ON a.doc_id = p.doc_id AND contains(p.text, needle) WHERE needle <> '') WHERE k = 1)"""


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d).select("doc_id", "seq", "anchor_text")


@query(ALL + _HITS + " SELECT doc_id, seq, hit_para, start, start AS span_start, least(start + 30, para_chars) AS span_end FROM hits")
def anchor_span(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph and character span of each issue's anchor."""
    hits = L.anchor_hits(_anchors(spark, d), _paras(spark, d))
    return L.anchor_spans(hits).select("doc_id", "seq", "hit_para", "start", "span_start", "span_end")


@query(
    ALL
    + """, anchors AS (SELECT doc_id, seq, CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 5 = 0 THEN 'no such text' ELSE anchor_text END AS anchor_text, CASE WHEN seq % 2 = 0 THEN para_idx ELSE 999999 END AS para_idx FROM grouped)"""
    + _HITS.split("FROM grouped)", 1)[1].replace(", hits", ", hits", 1)
    + """ SELECT a.doc_id, a.seq, coalesce(CASE WHEN a.anchor_text <> '' THEN hit_para ELSE p.para_idx END, first_para) AS place, CASE WHEN a.anchor_text <> '' AND hit_para IS NOT NULL THEN 'anchor' WHEN a.anchor_text = '' AND p.para_idx IS NOT NULL THEN 'index' ELSE 'fallback' END AS how
  FROM anchors a LEFT JOIN hits h ON a.doc_id = h.doc_id AND a.seq = h.seq LEFT JOIN paras p ON p.doc_id = a.doc_id AND p.para_idx = a.para_idx LEFT JOIN (SELECT doc_id, min(para_idx) AS first_para FROM paras GROUP BY doc_id) f ON f.doc_id = a.doc_id"""
)
def anchor_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Anchor, else index, else first paragraph; some anchors and indexes are damaged on purpose."""
    s = F.col("seq")
    anchors = _issues(spark, d).select("doc_id", "seq", F.when(s % 3 == 0, "").when(s % 5 == 0, "no such text").otherwise(F.col("anchor_text")).alias("anchor_text"), F.when(s % 2 == 0, F.col("para_idx")).otherwise(999999).cast("long").alias("para_idx"))
    return L.cascade(anchors, _paras(spark, d))


@query(ALL + _HITS + " SELECT doc_id, seq, hit_para, comment_id, row_number() OVER (PARTITION BY doc_id, hit_para ORDER BY start DESC, comment_id) AS write_order FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS comment_id FROM hits)")
def annotation_plan(spark: SparkSession, d: str) -> DataFrame:
    hits = L.anchor_hits(_anchors(spark, d), _paras(spark, d))
    return L.annotation_plan(L.anchor_spans(hits)).select("doc_id", "seq", "hit_para", "comment_id", "write_order")


_AUTHORS = "a AS (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]+(?:\\s+[A-Z]\\.?)?\\s+[A-Z][a-z]+)', 1)) AS author FROM documents WHERE doc_id % 2 = 0), b AS (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]+(?:\\s+[A-Z]\\.?)?\\s+[A-Z][a-z]+)', 1)) AS author FROM documents WHERE doc_id % 2 = 1)"


def _authors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Names in documents of even and of odd number: both sides of a cross-reference."""
    docs = table(spark, d, "documents")
    return X.authors(docs.filter("doc_id % 2 = 0"), "doc_id"), X.authors(docs.filter("doc_id % 2 = 1"), "doc_id")


@query(f"WITH {_AUTHORS} SELECT coalesce(x.author, y.author) AS author, CASE WHEN y.n IS NULL THEN 'text_only' WHEN x.n IS NULL THEN 'refs_only' ELSE 'matched' END AS status, coalesce(x.n, 0) AS text_count, coalesce(y.n, 0) AS refs_count FROM (SELECT author, count(*) AS n FROM a GROUP BY author) x FULL JOIN (SELECT author, count(*) AS n FROM b GROUP BY author) y ON x.author = y.author")
def authors_full(spark: SparkSession, d: str) -> DataFrame:
    return X.crossref(*_authors(spark, d))


@query(f"WITH {_AUTHORS} SELECT author FROM a EXCEPT SELECT author FROM b")
def authors_missing(spark: SparkSession, d: str) -> DataFrame:
    a, b = _authors(spark, d)
    return a.select("author").subtract(b.select("author"))


@query(f"WITH {_AUTHORS} SELECT author FROM a INTERSECT SELECT author FROM b")
def authors_matched(spark: SparkSession, d: str) -> DataFrame:
    a, b = _authors(spark, d)
    return a.select("author").intersect(b.select("author"))


@query(f"WITH {_AUTHORS} SELECT author FROM a UNION SELECT author FROM b")
def authors_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _authors(spark, d)
    return a.select("author").union(b.select("author")).distinct()


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def uncited_parent(spark: SparkSession, d: str) -> DataFrame:
    """References that nothing cites (left anti join)."""
    orders = table(spark, d, "orders").select("o_orderkey")
    return orders.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


_AUDIT = "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), 0) + 1 AS expected FROM lineitem"


def _audit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.struct("l_partkey", "l_suppkey").alias("tie"))
    return X.sequence_audit(rows, "l_orderkey", "l_linenumber", "tie")


@query(f"SELECT l_orderkey, l_linenumber, expected, array_to_string(range(expected, l_linenumber), ',') AS missing FROM (SELECT * REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(expected AS BIGINT) AS expected) FROM ({_AUDIT})) WHERE l_linenumber > expected")
def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).filter("kind = 'gap'").select("l_orderkey", "l_linenumber", "expected", "missing")


@query(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(expected AS BIGINT) AS expected FROM ({_AUDIT}) WHERE l_linenumber < expected")
def sequence_errors(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).filter("kind = 'repeat'").select("l_orderkey", "l_linenumber", "expected")


@query("SELECT o_orderkey, abs(s - o_totalprice) > 0.02 AS differs FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE abs(s - o_totalprice) > 0.02")
def table_sums(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines don't add up to the stated total."""
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    found = X.sum_against_total(parts, table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "l_extendedprice", "o_totalprice")
    return found.select("o_orderkey", F.lit(True).alias("differs"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS n_open, CAST(len(regexp_extract_all(html, '</p>')) AS BIGINT) AS n_close FROM pages WHERE len(regexp_extract_all(html, '<p[ >]')) <> len(regexp_extract_all(html, '</p>'))")
def markup_balance(spark: SparkSession, d: str) -> DataFrame:
    """Pages with unequal numbers of paragraph starts and ends."""
    rows = table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("n_open"), F.regexp_count("html", F.lit("</p>")).cast("long").alias("n_close"))
    return rows.filter("n_open <> n_close")


@query("SELECT conv_id, turn, role, rank FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank <= 4")
def last_turns(spark: SparkSession, d: str) -> DataFrame:
    return X.last_of(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"], 4)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    return X.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("SELECT user_id, event_id, gap_us FROM (SELECT user_id, event_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS BIGINT) AS gap_us FROM events) WHERE gap_us > 900000000")
def idle_gaps(spark: SparkSession, d: str) -> DataFrame:
    return X.idle_gaps(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "gap_us")


@query("SELECT user_id, count(*) AS n, count(*) > 100 AS over_cap, CASE WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN 'already_completed' WHEN epoch_us(max(ts)) - epoch_us(min(ts)) > 900000000 THEN 'timeout' ELSE 'running' END AS status FROM events GROUP BY user_id")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    """State of each run (here: a user's events): finished, over its time limit or running; and whether it went over its step cap."""
    span = F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), span.alias("span"))
    status = F.when(F.col("last") == "purchase", "already_completed").when(F.col("span") > 900_000_000, "timeout").otherwise("running")
    return rows.select("user_id", "n", (F.col("n") > 100).alias("over_cap"), status.alias("status"))


@query("WITH k AS (SELECT DISTINCT url AS key FROM pages WHERE starts_with(url, 'https://') ORDER BY key LIMIT 51), p AS (SELECT * FROM k ORDER BY key LIMIT 50) SELECT key, (SELECT count(*) FROM k) > 50 AS is_truncated, CASE WHEN (SELECT count(*) FROM k) > 50 THEN (SELECT max(key) FROM p) END AS next_token FROM p")
def listing_first_page(spark: SparkSession, d: str) -> DataFrame:
    """First page of a listing by prefix."""
    return listing_page(table(spark, d, "pages"), "url", "https://", 50)


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '\\.([A-Za-z0-9]+)$', 1)) AS suffix, contains(url, '?') AS has_query FROM pages")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", path.alias("path"), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), F.contains("url", F.lit("?")).alias("has_query"))


@query("SELECT doc_id, upper(substr(md5('para:' || doc_id), 1, 8)) AS para_id, upper(substr(md5('durable:' || doc_id), 1, 8)) AS durable_id FROM documents")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", T.stable_id("para:", name).alias("para_id"), T.stable_id("durable:", name).alias("durable_id"))


@query("SELECT doc_id, CASE WHEN contains(text, 'MIT License') THEN 'MIT' WHEN contains(text, 'Apache License') THEN 'Apache' WHEN contains(text, 'General Public License') THEN 'GPL' WHEN contains(text, 'CC BY') THEN 'CC' ELSE 'none' END AS kind FROM documents")
def license_kind(spark: SparkSession, d: str) -> DataFrame:
    """Ordered keyword rules: the first that holds gives the kind."""
    text = F.col("text")
    kind = F.when(text.contains("MIT License"), "MIT").when(text.contains("Apache License"), "Apache").when(text.contains("General Public License"), "GPL").when(text.contains("CC BY"), "CC").otherwise("none")
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"))


@query("SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<email>', 'g')) AS redacted_md5 FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')")
def redacted_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts with mail addresses replaced by a placeholder."""
    mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    return table(spark, d, "documents").filter(F.col("text").rlike(mail)).select("doc_id", F.md5(F.regexp_replace("text", mail, "<email>")).alias("redacted_md5"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AND json_valid(props) AS valid FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """A field of each row's JSON; invalid JSON gives null and false."""
    parsed = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(parsed.isNotNull(), F.lit(False)).alias("valid"))


@query(f"WITH {PARAS} SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) AS n_pages, count(*) FILTER (length(text) <= 50) AS n_short, count(*) FILTER (length(text) <= 50) > 0.5 * count(*) AS suspect FROM paras GROUP BY doc_id")
def scan_report(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs as pages: characters, short pages, and whether over half of them are short."""
    short = F.count_if(F.length("text") <= 50)
    return _paras(spark, d).groupBy("doc_id").agg(F.sum(F.length("text")).alias("n_chars"), F.count("*").alias("n_pages"), short.alias("n_short"), (short > 0.5 * F.count("*")).alias("suspect"))


@query(f"WITH {PARAS} SELECT doc_id, para_idx, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM (SELECT doc_id, para_idx, CASE WHEN length(text) BETWEEN 1 AND 40 THEN text END AS head FROM paras)")
def heading_attachment(spark: SparkSession, d: str) -> DataFrame:
    """Each paragraph with the last short line (a heading) at or before it."""
    return P.attach_headings(_paras(spark, d), F.length("text").between(1, 40))


@query(f"WITH {PARAS} SELECT doc_id, min(para_idx) AS first_para, max(para_idx) AS last_para, count(*) AS n FROM (SELECT doc_id, para_idx, para_idx - row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS island FROM paras WHERE length(text) > 100) GROUP BY doc_id, island")
def paragraph_islands(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous blocks of long paragraphs (gaps and islands)."""
    return P.islands(_paras(spark, d).filter(F.length("text") > 100))


@query(f"WITH {PARAS} SELECT doc_id, para_idx, (length(text) - length(replace(text, 'the', ''))) // 3 AS n_the FROM paras WHERE (length(text) - length(replace(text, 'the', ''))) // 3 >= 3")
def term_overuse(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs with a term three times or more."""
    n = T.occurrences(F.col("text"), F.lit("the"))
    return _paras(spark, d).select("doc_id", "para_idx", n.alias("n_the")).filter("n_the >= 3")


@query("SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN trim(replace(substr(text, greatest(strpos(text, 'the') - 40, 1), strpos(text, 'the') - greatest(strpos(text, 'the') - 40, 1) + 43), chr(10), ' '), ' ') ELSE '' END AS context FROM documents")
def term_context(spark: SparkSession, d: str) -> DataFrame:
    """The first occurrence of a term with 40 characters on both sides."""
    return table(spark, d, "documents").select("doc_id", T.context(F.col("text"), F.lit("the")).alias("context"))
