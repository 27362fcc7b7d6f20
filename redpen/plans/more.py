"""Further registered queries: sources and sinks, lookups, counts, windows, names and states, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redpen.functions import text as T
from redpen.operators import crossref as X
from redpen.operators import rank as R
from redpen.plans.registry import _BROKEN, ALL, PARAS, _broken, _issues, _paras, query
from redpen.schema import SEVERITY_LABEL
from redpen.sources.tables import paragraphs, table
from redpen.streaming import runs as S

# Sources and sinks


@query("SELECT l_orderkey, md5(string_agg(l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag)) AS rows_md5, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def table_row_lines(spark: SparkSession, d: str) -> DataFrame:
    """The rows of each table (here: an order's lines) as text, cells between bars."""
    cells = F.struct("l_linenumber", "l_partkey", "l_returnflag")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(cells)).alias("r"), F.count("*").alias("n"))
    line = F.transform("r", lambda r: F.concat_ws(" | ", r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"), r["l_returnflag"]))
    return rows.select("l_orderkey", F.md5(F.array_join(line, "\n")).alias("rows_md5"), "n")


@query("SELECT page_id, CAST(strlen(html) AS BIGINT) AS n_bytes, strlen(html) <= 4096 AS accepted FROM pages")
def bounded_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Size of each payload in bytes, and whether the reader's bound accepts it."""
    size = F.octet_length("html").cast("long")
    return table(spark, d, "pages").select("page_id", size.alias("n_bytes"), (size <= 4096).alias("accepted"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type <> 'error' GROUP BY user_id")
def latest_usable(spark: SparkSession, d: str) -> DataFrame:
    """The newest entry of each key that can be used (recovery from a cache)."""
    return X.latest(table(spark, d, "events").filter("event_type <> 'error'"), "user_id", ["ts", "event_id"], ["event_id"])


@query(
    "SELECT c_nationkey, c_custkey, highest + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS new_id FROM customer "
    "JOIN (SELECT s_nationkey, max(s_suppkey) AS highest FROM supplier GROUP BY s_nationkey) ON s_nationkey = c_nationkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"
)
def relationship_ids(spark: SparkSession, d: str) -> DataFrame:
    """Entries that are missing get the ids after the highest one of their list (here: customers without an urgent order, by nation)."""
    missing = table(spark, d, "customer").select("c_nationkey", "c_custkey").join(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    highest = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_suppkey").alias("highest"))
    numbered = R.running_sum(missing.select("c_nationkey", "c_custkey"), "c_nationkey", F.col("c_custkey"), F.lit(1), ["c_custkey"], "k")
    return numbered.join(highest, "c_nationkey").select("c_nationkey", "c_custkey", (F.col("highest") + F.col("k")).alias("new_id"))


@query(
    ALL
    + """, dims AS (SELECT lang, unnest(['fatal', 'major', 'minor', 'info']) AS severity FROM (SELECT DISTINCT lang FROM documents))
  SELECT lang, severity, coalesce(n, 0) AS n FROM dims LEFT JOIN (SELECT lang, severity, count(*) AS n FROM grouped JOIN documents USING (doc_id) GROUP BY lang, severity) USING (lang, severity)"""
)
def severity_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Issues by language and severity, every bucket of the dimension kept."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    dims = docs.select("lang").distinct().select("lang", F.explode(F.array(*[F.lit(s) for s in ("fatal", "major", "minor", "info")])).alias("severity"))
    counts = _issues(spark, d).select("doc_id", "severity").join(docs, "doc_id").groupBy("lang", "severity").agg(F.count("*").alias("n"))
    return dims.join(counts, ["lang", "severity"], "left").select("lang", "severity", F.coalesce("n", F.lit(0)).alias("n"))


@query(ALL + "SELECT doc_id, seq, id FROM grouped WHERE seq <= 10")
def first_ten(spark: SparkSession, d: str) -> DataFrame:
    """The first ten issues of each document as they came, unsorted."""
    return _issues(spark, d).filter("seq <= 10").select("doc_id", "seq", "id")


@query(ALL + "SELECT doc_id, seq, CAST(to_json({'id': id, 'severity': severity, 'para_idx': para_idx, 'group_id': group_id}) AS VARCHAR) AS line FROM grouped")
def issue_json(spark: SparkSession, d: str) -> DataFrame:
    """Each issue as one JSON line."""
    return _issues(spark, d).select("doc_id", "seq", F.to_json(F.struct("id", "severity", "para_idx", "group_id")).alias("line"))


@query(ALL + "SELECT doc_id, seq, '[' || CASE severity WHEN 'fatal' THEN '致命' WHEN 'major' THEN '重要' ELSE '轻微' END || '/' || category || '] ' || problem || chr(10) || '→ ' || anchor_text || chr(10) || 'id: ' || id AS body FROM grouped")
def comment_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Text of the comment for each issue: label, problem, anchor, id."""
    label = T.mapped(F.col("severity"), SEVERITY_LABEL, "轻微")
    body = F.concat(F.lit("["), label, F.lit("/"), "category", F.lit("] "), "problem", F.lit("\n→ "), "anchor_text", F.lit("\nid: "), "id")
    return _issues(spark, d).select("doc_id", "seq", body.alias("body"))


# Predicates and projections


@query(ALL + f", {_BROKEN} SELECT doc_id, seq, coalesce(nullif(excerpt, ''), nullif(anchor_text, ''), problem) AS label FROM broken")
def field_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The first field that is filled; an empty one falls through."""
    return _broken(spark, d).select("doc_id", "seq", T.first_filled(F.col("excerpt"), F.col("anchor_text"), F.col("problem")).alias("label"))


@query(f"WITH {PARAS} SELECT doc_id, para_idx, CAST(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS BIGINT) AS n_plain FROM paras WHERE trim(text, ' ') = '' OR length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) < 0.7 * length(text)")
def noise_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that are blank or hold few plain letters and digits."""
    plain = F.length(F.regexp_replace("text", "[^A-Za-z0-9]", "")).cast("long")
    return _paras(spark, d).filter((F.trim("text") == "") | (plain < 0.7 * F.length("text"))).select("doc_id", "para_idx", plain.alias("n_plain"))


@query("SELECT page_id, coalesce(CASE regexp_extract(host, '\\.([a-z]+)$', 1) WHEN 'com' THEN 'commerce' WHEN 'net' THEN 'network' WHEN 'org' THEN 'organisation' END, 'other') AS category FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages)")
def suffix_category(spark: SparkSession, d: str) -> DataFrame:
    """Suffix looked up in a fixed dimension."""
    suffix = F.regexp_extract(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1), r"\.([a-z]+)$", 1)
    return table(spark, d, "pages").select("page_id", T.mapped(suffix, {"com": "commerce", "net": "network", "org": "organisation"}, "other").alias("category"))


@query("SELECT page_id, name, strlen(name) <= 1024 AND regexp_matches(name, '^[A-Za-z0-9._\\-/]+$') AND NOT regexp_matches(name, '^/|/$|//') AS valid FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1) AS name FROM pages)")
def object_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that an object store accepts."""
    name = F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1)
    return table(spark, d, "pages").select("page_id", name.alias("name"), T.valid_object_name(name).alias("valid"))


@query("SELECT c_custkey, CASE WHEN length(c_name) > 8 THEN left(c_name, 4) || repeat('*', length(c_name) - 8) || right(c_name, 4) ELSE repeat('*', length(c_name)) END AS masked FROM customer")
def masked_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.masked(F.col("c_name")).alias("masked"))


@query("SELECT doc_id, md5(neutral) AS neutral_md5 FROM (SELECT doc_id, text, replace(replace(replace(text, ' est ', ' paraît '), ' is ', ' seems '), ' ist ', ' scheint ') AS neutral FROM documents) WHERE neutral <> text")
def neutral_wording(spark: SparkSession, d: str) -> DataFrame:
    """Texts changed by a list of wordings and their replacements."""
    out = F.col("text")
    for said, meant in ((" est ", " paraît "), (" is ", " seems "), (" ist ", " scheint ")):
        out = F.replace(out, F.lit(said), F.lit(meant))
    return table(spark, d, "documents").select("doc_id", "text", out.alias("neutral")).filter("neutral <> text").select("doc_id", F.md5("neutral").alias("neutral_md5"))


@query("SELECT p_partkey, lower(regexp_replace(p_name, '[\\s.,;:''\"\\[\\]()]', '', 'g')) AS key, regexp_replace(p_type, '[^a-zA-Z0-9_\\-.]', '_', 'g') AS safe FROM part")
def matching_keys(spark: SparkSession, d: str) -> DataFrame:
    """Matching form of names, and names safe for files."""
    return table(spark, d, "part").select("p_partkey", T.key_of(F.col("p_name")).alias("key"), T.safe_name(F.col("p_type")).alias("safe"))


@query("SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]')), ' ')) AS collapsed_md5 FROM documents WHERE text IS NOT NULL")
def collapsed_text(spark: SparkSession, d: str) -> DataFrame:
    """White space collapsed, tokens without a letter or digit dropped."""
    kept = F.filter(F.split("text", "[ \t\n]+"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(F.array_join(kept, " ")).alias("collapsed_md5"))


@query("SELECT page_id, page - 1 AS page0, line, (page - 1) * 40 + line - 1 AS para_idx FROM (SELECT page_id, coalesce(TRY_CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS BIGINT), 1) AS page, TRY_CAST(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1) AS BIGINT) AS line FROM pages)")
def place_parts(spark: SparkSession, d: str) -> DataFrame:
    """Page and line read from text, and the paragraph that they stand for at 40 lines a page."""
    page, line = (F.regexp_extract("url", p, 1).try_cast("bigint") for p in ("[?&]page=([0-9]+)", "/([0-9]+)(?:[?#]|$)"))
    rows = table(spark, d, "pages").select("page_id", F.coalesce(page, F.lit(1)).alias("page"), line.alias("line"))
    return rows.select("page_id", (F.col("page") - 1).alias("page0"), "line", ((F.col("page") - 1) * 40 + F.col("line") - 1).alias("para_idx"))


@query("SELECT item_id, k AS entry, substr(part, 1, 100) AS preview FROM (SELECT item_id, unnest(range(len(l))) AS k, unnest(l) AS part FROM (SELECT item_id, string_split_regex(text, '[.!?]') AS l FROM benchmark)) WHERE k > 0")
def entry_previews(spark: SparkSession, d: str) -> DataFrame:
    """Entries split at a pattern, what stands before the first left out, with previews of 100 characters."""
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "[.!?]", -1)).alias("entry", "part"))
    return rows.filter("entry > 0").select("item_id", F.col("entry").cast("long").alias("entry"), F.substring("part", 1, 100).alias("preview"))


# Lookups between sides


@query(
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS order_year, CAST(year(shipped) AS INTEGER) AS line_year FROM orders JOIN (SELECT l_orderkey, arg_min(l_shipdate, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS shipped FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE year(o_orderdate) <> year(shipped)"
)
def year_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of a key whose years differ; of the second side the first row counts."""
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by("l_shipdate", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")).alias("shipped"))
    rows = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("order_year")).join(first.select("o_orderkey", F.year("shipped").alias("line_year")), "o_orderkey")
    return rows.filter("order_year <> line_year")


@query("SELECT event_id, since FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM events) WHERE event_type <> 'purchase'")
def as_of_lookup(spark: SparkSession, d: str) -> DataFrame:
    """What was in force at each row's time: the user's last purchase before it."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(before)
    return table(spark, d, "events").withColumn("since", since).filter("event_type <> 'purchase'").select("event_id", "since")


@query("SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN b.k IS NULL THEN 'problem only' ELSE 'measure only' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def one_sided(spark: SparkSession, d: str) -> DataFrame:
    """Keys that only one of two lists has (problems and measures): full outer join."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    a, b = (rows.filter(F.col("o_orderpriority") == p).select("o_custkey").distinct().withColumn(c, F.lit(True)) for p, c in (("1-URGENT", "a"), ("5-LOW", "b")))
    return a.join(b, "o_custkey", "full_outer").filter("a is null or b is null").select("o_custkey", F.when(F.col("b").isNull(), "problem only").otherwise("measure only").alias("side"))


@query(ALL + "SELECT doc_id, seq, before, n FROM (SELECT doc_id, seq, lag(seq) OVER (PARTITION BY doc_id, para_idx ORDER BY seq) AS before, count(*) OVER (PARTITION BY doc_id, para_idx) AS n FROM grouped) WHERE before IS NOT NULL")
def same_position(spark: SparkSession, d: str) -> DataFrame:
    """Issues that stand where another one does: linked to the one before them, not to every other."""
    place = Window.partitionBy("doc_id", "para_idx")
    rows = _issues(spark, d).select("doc_id", "seq", F.lag("seq").over(place.orderBy("seq")).alias("before"), F.count("*").over(place).alias("n"))
    return rows.filter("before is not null")


@query(f"WITH {PARAS} SELECT p.doc_id, p.para_idx, CAST(len(list_distinct(list_intersect(string_split(t.text, ' '), string_split(p.text, ' ')))) AS BIGINT) AS n_common FROM paras p JOIN paras t ON t.doc_id = p.doc_id AND t.para_idx = 0 WHERE p.para_idx > 0")
def heading_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Words that the first line of a text (its title) shares with each other line."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.split(F.substring_index("text", "\n", 1), " ", -1).alias("title"))
    lines = paragraphs(docs, "title").filter("para_idx > 0")
    return lines.select("doc_id", "para_idx", F.size(F.array_intersect("title", F.split("text", " ", -1))).cast("long").alias("n_common"))


@query("SELECT page_id, ref FROM (SELECT page_id, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS ref FROM pages) p WHERE ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id = p.ref)")
def dangling_references(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that texts refer to and nothing has."""
    pages = table(spark, d, "pages")
    refs = pages.select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).try_cast("bigint").alias("ref")).filter("ref is not null")
    return refs.join(pages.select(F.col("page_id").alias("ref")), "ref", "left_anti").select("page_id", "ref")


@query("SELECT o_custkey, array_to_string(list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], lambda x: NOT list_contains(l, x)), ',') AS missing FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) AS l FROM orders GROUP BY o_custkey)")
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    """Required values that a group lacks."""
    required = F.array(*[F.lit(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("l")).select("o_custkey", F.array_join(F.array_except(required, F.col("l")), ",").alias("missing"))


@query(ALL + "SELECT doc_id, 'rules' AS producer, seq, severity FROM grouped UNION ALL SELECT doc_id, 'labels', NULL, CASE quality WHEN 0 THEN 'major' ELSE 'minor' END FROM labels")
def merged_producers(spark: SparkSession, d: str) -> DataFrame:
    """Lists of two producers as one; nothing is dropped, columns that one lacks are null."""
    labels = table(spark, d, "labels").select("doc_id", F.lit("labels").alias("producer"), F.when(F.col("quality") == 0, "major").otherwise("minor").alias("severity"))
    return _issues(spark, d).select("doc_id", F.lit("rules").alias("producer"), "seq", "severity").unionByName(labels, allowMissingColumns=True)


# Counts


@query("SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS n_styles FROM orders GROUP BY o_custkey HAVING count(*) > 2 AND count(DISTINCT o_orderpriority) > 1")
def style_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Groups of more than two rows that mix styles."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("n_styles")).filter("n > 2 and n_styles > 1")


@query("SELECT doc_id, CASE WHEN en > de AND en > es THEN 'en' WHEN de > 3 THEN 'de' WHEN es > 3 THEN 'es' ELSE 'both' END AS style FROM (SELECT doc_id, " + ", ".join(f"(length(text) - length(replace(text, ' {w} ', ''))) // {len(w) + 2} AS {n}" for n, w in (("en", "the"), ("de", "der"), ("es", "que"))) + " FROM documents)")
def indicator_style(spark: SparkSession, d: str) -> DataFrame:
    """Indicator words counted for each style, and ordered rules over the counts."""
    rows = table(spark, d, "documents").select("doc_id", *[T.occurrences(F.col("text"), F.lit(f" {w} ")).alias(n) for n, w in (("en", "the"), ("de", "der"), ("es", "que"))])
    style = F.when((F.col("en") > F.col("de")) & (F.col("en") > F.col("es")), "en").when(F.col("de") > 3, "de").when(F.col("es") > 3, "es").otherwise("both")
    return rows.select("doc_id", style.alias("style"))


@query(
    "SELECT item_id, word, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, length(word) DESC, first) AS rank FROM (SELECT item_id, word, CAST(count(*) * length(word) AS BIGINT) AS score, min(k) AS first "
    "FROM (SELECT item_id, unnest(range(len(l))) AS k, unnest(l) AS word FROM (SELECT item_id, string_split(text, ' ') AS l FROM benchmark)) WHERE length(word) > 1 GROUP BY item_id, word)) WHERE rank <= 10"
)
def keyword_scores(spark: SparkSession, d: str) -> DataFrame:
    """The ten words of each text of greatest occurrences times length; ties by length, then first place."""
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ", -1)).alias("k", "word")).filter(F.length("word") > 1)
    scored = words.groupBy("item_id", "word").agg((F.count("*") * F.length("word")).alias("score"), F.min("k").alias("first"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.desc(F.length("word")), "first")).cast("long")
    return scored.withColumn("rank", rank).filter("rank <= 10").select("item_id", "word", "score", "rank")


@query(f"WITH {PARAS} SELECT doc_id, count(*) AS n_headings, arg_min(text, para_idx) AS title FROM paras WHERE length(text) BETWEEN 1 AND 40 GROUP BY doc_id")
def heading_totals(spark: SparkSession, d: str) -> DataFrame:
    """Headings of each document; the first one is its title."""
    return _paras(spark, d).filter(F.length("text").between(1, 40)).groupBy("doc_id").agg(F.count("*").alias("n_headings"), F.min_by("text", "para_idx").alias("title"))


_KINDS = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in _KINDS) + " FROM events GROUP BY user_id")
def kind_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of each kind side by side."""
    return table(spark, d, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in _KINDS])


@query("SELECT user_id, CAST(sum(CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 3 WHEN 'error' THEN -1 ELSE 1 END) AS BIGINT) AS weight FROM events GROUP BY user_id")
def weighted_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences weighted by a fixed dimension."""
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(T.mapped(F.col("event_type"), {"purchase": 5, "signup": 3, "error": -1}, 1)).alias("weight"))


@query("SELECT o_custkey, CASE WHEN count(*) >= 20 THEN 'high' WHEN count(*) >= 10 THEN 'middle' ELSE 'low' END AS volume, bool_or(o_orderdate >= TIMESTAMP '1998-01-01') AS recent FROM orders GROUP BY o_custkey")
def volume_levels(spark: SparkSession, d: str) -> DataFrame:
    """Level of a group by its rows, and whether it has a recent one."""
    n = F.count("*")
    level = F.when(n >= 20, "high").when(n >= 10, "middle").otherwise("low")
    return table(spark, d, "orders").groupBy("o_custkey").agg(level.alias("volume"), F.bool_or(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).alias("recent"))


@query("SELECT o_orderkey, CAST(max(l_shipdate) AS DATE) - CAST(any_value(o_orderdate) AS DATE) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def latest_date(spark: SparkSession, d: str) -> DataFrame:
    """Days from a document's date to the latest date in it."""
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").join(last, "o_orderkey").select("o_orderkey", F.date_diff("last", "o_orderdate").cast("long").alias("days"))


@query(ALL + "SELECT doc_id, count(DISTINCT category) AS n_clues FROM grouped GROUP BY doc_id HAVING count(DISTINCT category) >= 2")
def integrity_clues(spark: SparkSession, d: str) -> DataFrame:
    """Documents with two or more kinds of clues."""
    return _issues(spark, d).groupBy("doc_id").agg(F.countDistinct("category").alias("n_clues")).filter("n_clues >= 2")


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS n_done, count(*) FILTER (event_type = 'error') AS n_failed, min(event_id) FILTER (event_type = 'error') AS first_failed FROM events GROUP BY user_id")
def tallies(spark: SparkSession, d: str) -> DataFrame:
    """Successes and failures of each run, and the first failure."""
    failed = F.col("event_type") == "error"
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(~failed).alias("n_done"), F.count_if(failed).alias("n_failed"), F.min(F.when(failed, F.col("event_id"))).alias("first_failed"))


@query(f"WITH {PARAS} SELECT doc_id, count(*) FILTER (regexp_matches(text, '^[A-Z]')) AS n_capital, count(*) FILTER (regexp_matches(text, '^[a-z]')) AS n_small, count(*) FILTER (regexp_matches(text, '^[A-Z]')) > 0 AND count(*) FILTER (regexp_matches(text, '^[a-z]')) > 0 AS mixed FROM paras GROUP BY doc_id")
def style_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of two styles counted for each document, and whether it mixes them."""
    capital, small = F.count_if(F.col("text").rlike("^[A-Z]")), F.count_if(F.col("text").rlike("^[a-z]"))
    return _paras(spark, d).groupBy("doc_id").agg(capital.alias("n_capital"), small.alias("n_small"), ((capital > 0) & (small > 0)).alias("mixed"))


# Windows and ranks


@query(f"WITH {PARAS} SELECT doc_id, para_idx, n_chars FROM (SELECT doc_id, para_idx, length(text) AS n_chars, sum(length(text)) OVER (PARTITION BY doc_id) AS total FROM paras) WHERE n_chars > 0.15 * total")
def paragraph_share(spark: SparkSession, d: str) -> DataFrame:
    """Parts that hold over 15 % of their document."""
    rows = _paras(spark, d).select("doc_id", "para_idx", F.length("text").cast("long").alias("n_chars"))
    return rows.withColumn("total", F.sum("n_chars").over(Window.partitionBy("doc_id"))).filter("n_chars > 0.15 * total").drop("total")


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before = event_type")
def consecutive_same(spark: SparkSession, d: str) -> DataFrame:
    """Rows that repeat the one before them in their group."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("before", before).filter("before = event_type").select("event_id", "event_type")


@query(f"WITH {PARAS} SELECT doc_id, para_idx, n_chars FROM (SELECT doc_id, para_idx, length(text) AS n_chars, avg(length(text)) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS usual FROM paras) WHERE abs(n_chars - usual) > 300")
def density_shift(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that differ much from the two before them."""
    usual = F.avg("n_chars").over(Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(-2, -1))
    rows = _paras(spark, d).select("doc_id", "para_idx", F.length("text").cast("long").alias("n_chars"))
    return rows.withColumn("usual", usual).filter("abs(n_chars - usual) > 300").drop("usual")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(TRY_CAST(regexp_extract(c_name, '#([0-9]+)$', 1) AS BIGINT), 1000000000), c_custkey) AS place FROM customer")
def numeric_order(spark: SparkSession, d: str) -> DataFrame:
    """Order by the number in a name; names without one come last."""
    number = F.coalesce(F.regexp_extract("c_name", "#([0-9]+)$", 1).try_cast("bigint"), F.lit(1_000_000_000))
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", number.alias("number"))
    return R.running_sum(rows, "c_nationkey", F.col("number"), F.lit(1), ["number", "c_custkey"], "place").select("c_custkey", "place")


_PATTERNS = ("[A-Z][a-z]+ License", "[A-Z][A-Za-z]+ [A-Z][a-z]+")


@query(
    "WITH m AS (" + " UNION ALL ".join(f"SELECT doc_id, {k} AS pattern, unnest(range(len(l))) AS pos, unnest(l) AS hit FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS l FROM documents)" for k, p in enumerate(_PATTERNS)) + ") "
    "SELECT doc_id, CAST(pattern AS INTEGER) AS pattern, hit, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pattern, pos) AS k FROM m) WHERE k <= 50"
)
def capped_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches of overlapping patterns, listed pattern by pattern without removing doubles; the first fifty of each document."""
    docs = table(spark, d, "documents")
    first, second = (docs.select("doc_id", F.lit(k).alias("pattern"), F.posexplode(F.regexp_extract_all("text", F.lit(p), 0)).alias("pos", "hit")) for k, p in enumerate(_PATTERNS))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("pattern", "pos")).cast("long")
    return first.unionByName(second).withColumn("k", k).filter("k <= 50").select("doc_id", "pattern", "hit", "k")


# State


@query("SELECT conv_id AS thread_id, role AS message_id, min(turn) AS position, arg_max(role, turn) AS role, md5(arg_max(text, turn)) AS content_md5 FROM conversations GROUP BY conv_id, role")
def message_state(spark: SparkSession, d: str) -> DataFrame:
    """Messages by id (here: the role); a later one replaces an earlier and keeps its place. The same declaration serves a stream."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("role").alias("message_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    return S.latest_messages(rows).select("thread_id", "message_id", "position", "role", F.md5("content").alias("content_md5"))


@query("SELECT o_orderkey AS run_id, CASE WHEN event_id IS NULL THEN 'not_found' WHEN event_type IN ('purchase', 'error') THEN 'already_completed' ELSE 'cancelling' END AS answer FROM orders LEFT JOIN events ON event_id = o_orderkey")
def cancel_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers to requests that would end runs (here: order keys as requests, events as runs)."""
    status = T.mapped(F.col("event_type"), {"purchase": "finished", "error": "cancelled"}, "running")
    states = table(spark, d, "events").select(F.col("event_id").alias("run_id"), status.alias("status"))
    return S.commands(table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id")), states)


@query("SELECT doc_id, CAST(sum(coalesce(strlen(text), 0)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) // 65536 AS BIGINT) AS part FROM documents")
def part_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Upload part that each text's last byte falls into, by running sums of bytes within a source."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.coalesce(F.octet_length("text").cast("long"), F.lit(0)).alias("size"))
    return R.running_sum(rows, "source", F.col("doc_id"), F.col("size"), ["doc_id"], "n").select("doc_id", F.expr("n div 65536").alias("part"))


@query("SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def stage_events(spark: SparkSession, d: str) -> DataFrame:
    """Progress events by hour and kind."""
    hour = F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("hour_us")
    return table(spark, d, "events").groupBy(hour, "event_type").agg(F.count("*").alias("n"))


# Excerpts


@query(f"WITH {PARAS} SELECT doc_id, para_idx, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS excerpt FROM paras WHERE length(text) > 60")
def clamped_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs cut to an excerpt's length."""
    return _paras(spark, d).filter(F.length("text") > 60).select("doc_id", "para_idx", T.clamp(F.col("text"), 60, "...").alias("excerpt"))
