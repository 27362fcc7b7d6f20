"""Choosing an anchor for an issue from its problem text, and checking or respelling the anchors it has.

Problems and texts meet by doc_id; what follows is columns of one row, so no candidates are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.functions.spans import let

#: Fixed values of the method: characters of an anchor, keywords tried, characters around a keyword, head that the last level reads.
LONGEST, KEYWORDS, AROUND, HEAD = 60, 10, 20, 200
#: Signs that the second comparison leaves out.
SIGNS = r"[\s，。、：；！？,.:;!?\-—]"
QUOTED = r"""[“”‘’"']([\p{L}\p{N} ,.:;\-]{4,60}?)[“”‘’"']"""
WORD = r"\p{L}{4,}"
WINDOW_PIECE = r"[\p{L} ,:;]{5,60}"
HEAD_PIECE = r"[\p{L} ,:;\-]{10,60}"


def body_start(text: Column, markers: tuple[str, ...]) -> Column:
    """Characters before the body: where the first marker that occurs begins; without one (or at 0) 15 % of a text of over 2000 characters."""
    at = F.coalesce(*[F.when(text.rlike(m), F.length(F.regexp_extract(text, rf"(?s)^(.*?)(?:{m})", 1))) for m in markers], F.lit(0))
    return F.when((at == 0) & (F.length(text) > 2000), F.floor(F.length(text) * 0.15)).otherwise(at).cast("long")


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, SIGNS, "")


def _first(found: Column) -> Column:
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))


def _first_of(values: Column, body: Callable[[Column], Column]) -> Column:
    """The first body of an element that isn't null; later elements aren't computed."""
    return F.aggregate(values, F.lit(None).cast("string"), lambda found, v: F.coalesce(found, body(v)))


def _by_quote(problem: Column, body: Column, bare_body: Column) -> Column:
    """The first quotation that stands in the body as it is or without signs; in the second case the body's characters about there."""

    def near(bare: Column) -> Column:
        at = F.instr(bare_body, bare)
        start = F.greatest(at - 6, F.lit(0))
        return F.when(at > 0, F.substring(body, start + 1, F.least(at - 1 + F.length(bare) + 5 - start, F.lit(LONGEST))))

    place = lambda q: F.when(F.contains(body, q), F.substring(q, 1, LONGEST)).otherwise(let(_bare(q), near))
    quotes = F.filter(F.regexp_extract_all(problem, F.lit(QUOTED), F.lit(1)), lambda q: _bare(q) != "")
    return _first_of(F.transform(quotes, lambda q: F.trim(q)), place)


def keywords(problem: Column) -> Column:
    """At most ten different words by occurrences times length, then length, then first appearance; words of one letter only are left out."""
    said = F.filter(F.regexp_extract_all(problem, F.lit(WORD), F.lit(0)), lambda w: F.size(F.array_distinct(F.split(w, ""))) >= 2)
    scored = lambda words: F.transform(
        F.array_distinct(words), lambda w, k: F.struct((-F.size(F.filter(words, lambda x: x == w)) * F.length(w)).alias("score"), (-F.length(w)).alias("size"), k.alias("k"), w.alias("word"))
    )
    return F.transform(F.slice(F.array_sort(let(said, scored)), 1, KEYWORDS), lambda s: s["word"])


def _by_keyword(problem: Column, body: Column) -> Column:
    """Around the first place of the first keyword that has any: the piece with most characters, then with the keyword, then the first."""

    def around(w: Column, at: Column) -> Column:
        start = F.greatest(at - 1 - AROUND, F.lit(0))
        window = F.substring(body, start + 1, at - 1 + F.length(w) + AROUND - start)
        pieces = F.regexp_extract_all(window, F.lit(WINDOW_PIECE), F.lit(0))
        ranked = F.transform(pieces, lambda p, k: F.struct(F.length(F.regexp_replace(p, r"\s", "")).alias("n"), F.contains(p, w).alias("has"), (-k).alias("k"), p.alias("piece")))
        return F.when(at > 0, F.nullif(F.trim(F.array_max(ranked)["piece"]), F.lit("")))

    return _first_of(keywords(problem), lambda w: let(F.instr(body, w), lambda at: around(w, at)))


def _longest_in_head(body: Column) -> Column:
    pieces = F.regexp_extract_all(F.substring(body, 1, HEAD), F.lit(HEAD_PIECE), F.lit(0))
    longest = F.array_max(F.transform(pieces, lambda p, k: F.struct(F.length(p).alias("n"), (-k).alias("k"), p.alias("piece"))))["piece"]
    return F.nullif(F.trim(longest), F.lit(""))


def found_anchors(problems: DataFrame, bodies: DataFrame) -> DataFrame:
    """Each row of problems (doc_id, problem, ...) with level and anchor: 1 a quotation, 2 a piece around a keyword, 3 the longest
    piece of the body's head, 4 the problem's own first 40 characters. A document without text gives level 4.

    bodies: (doc_id, body), one row each; level 3 and the text without signs are made once for each document, before the join."""
    texts = bodies.select("doc_id", "body", _bare(F.col("body")).alias("bare"), _longest_in_head(F.col("body")).alias("head_piece"))
    problem, body = F.col("problem"), F.col("body")
    levels = (_by_quote(problem, body, F.col("bare")), _by_keyword(problem, body), F.col("head_piece"), F.substring(F.trim(F.coalesce(problem, F.lit(""))), 1, 40))
    # one level after another: a later one is computed only where the earlier ones give nothing
    marked = lambda k: lambda x: F.when(x.isNotNull(), F.struct(F.lit(k).alias("level"), x.alias("anchor")))
    best = F.coalesce(*[let(a, marked(k)) for k, a in enumerate(levels, 1)])
    return problems.join(texts, "doc_id", "left").withColumn("best", best).select(*problems.columns, "best.*")


def spellings(anchor: Column) -> Column:
    """The four spellings that are tried: as it is, a space after a letter before a digit, one after a digit before a letter, both."""
    after = lambda c: F.regexp_replace(c, r"(\p{L})([0-9])", "$1 $2")
    before = lambda c: F.regexp_replace(c, r"([0-9])(\p{L})", "$1 $2")
    return F.array(anchor, after(anchor), before(anchor), before(after(anchor)))


def first_spelling(anchors: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, seq, variant): number of the first spelling of the anchor that stands in its text, null if none does."""
    hit = F.transform(spellings(F.col("anchor_text")), lambda v, k: F.when(F.contains("text", v), k + 1))
    return anchors.join(texts.select("doc_id", "text"), "doc_id").select("doc_id", "seq", _first(hit).alias("variant"))


def looked_up(anchors: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, seq, how): 'exact' if the text holds the anchor, else 'stripped' if it does without signs, else 'chapter' if it holds the chapter, else 'none'."""
    docs = texts.select("doc_id", "text", _bare(F.col("text")).alias("bare"))
    raw = _bare(F.col("anchor_text"))
    how = (
        F.when(F.coalesce(F.col("anchor_text"), F.lit("")) == "", "none")
        .when(F.contains("text", "anchor_text"), "exact")
        .when((raw != "") & F.contains("bare", raw), "stripped")
        .when(F.contains("text", "chapter"), "chapter")
        .otherwise("none")
    )
    return anchors.join(docs, "doc_id").select("doc_id", "seq", how.alias("how"))
