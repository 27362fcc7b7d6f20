"""Finding the place of an anchor in a document's paragraphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redpen.functions import text as T
from redpen.sources.store import written

NEEDLE, SPAN = 30, 30


#: Keys of the needles are broadcast only up to this many rows, counted; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000


def _inner_words(needle: Column) -> Column:
    """Whole words inside the needle: all pieces between spaces but the first and the last, which may be cut."""
    parts = F.split(needle, " ")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))


def _places(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(doc, seq, para_idx, start, chars) of hits among rows (doc, kind, number, text) that are sorted: a document's paragraphs as they
    are preferred (kinds 0 and 1), then its needles (2). A needle is looked for in the paragraphs with the rarest word inside it only."""
    for doc, group in groupby(rows, key=itemgetter(0)):
        paras, needles = [], []
        for _, kind, number, text in group:
            (needles if kind == 2 else paras).append((number, text))
        if not needles or not paras:
            continue
        inner = {needle: needle.split(" ")[1:-1] for _, needle in needles}
        wanted, having = {w for words in inner.values() for w in words}, {}
        for k, (_, text) in enumerate(paras):
            for w in wanted.intersection(text.split(" ")):
                having.setdefault(w, []).append(k)

        def first(words: list[str], needle: str) -> int | None:
            near = min((having.get(w, []) for w in words), key=len) if words else range(len(paras))
            return next((k for k in near if needle in paras[k][1]), None)

        at = {needle: first(words, needle) for needle, words in inner.items()}
        best: dict = {}
        for seq, needle in needles:
            if (k := at[needle]) is not None and k < best.get(seq, (len(paras),))[0]:
                best[seq] = (k, needle)
        for seq, (k, needle) in best.items():
            number, text = paras[k]
            yield doc, seq, number, text.index(needle), len(text)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def anchor_hits(anchors: DataFrame, paras: DataFrame) -> DataFrame:
    """First paragraph of the anchor's document that contains the first characters of the anchor, lines of a table of contents last.

    anchors: (doc_id, seq, anchor_text). Paragraphs and needles are dealt together by document, once, and a task goes through its
    documents one after another, so words are counted where their text is and never travel. Anchors without a word inside are
    looked for in every paragraph of their document."""
    kinds = {**dict(paras.dtypes), "seq": dict(anchors.dtypes)["seq"]}
    needle = F.substring(T.strip(F.col("anchor_text")), 1, NEEDLE)
    wanted = anchors.select(F.col("doc_id").cast(kinds["doc_id"]).alias("doc_id"), F.lit(2).alias("kind"), F.col("seq").cast("long").alias("number"), needle.alias("text")).filter("text <> ''")
    lines = paras.select("doc_id", F.coalesce(T.is_contents_line(F.col("text")).cast("int"), F.lit(0)).alias("kind"), F.col("para_idx").cast("long").alias("number"), "text")
    dealt = lines.unionByName(wanted).filter("doc_id is not null and text is not null").repartition("doc_id").sortWithinPartitions("doc_id", "kind", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _places(_rows_of(batches))
        while some := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some, strict=True)], names=["doc_id", "seq", "hit_para", "start", "para_chars"])

    hits = dealt.mapInArrow(run, f"doc_id {kinds['doc_id']}, seq long, hit_para long, start long, para_chars long")
    return hits.select("doc_id", F.col("seq").cast(kinds["seq"]).alias("seq"), F.col("hit_para").cast(kinds["para_idx"]).alias("hit_para"), "start", "para_chars")


def anchor_spans(hits: DataFrame) -> DataFrame:
    """[span_start, span_end) of at most SPAN characters inside the paragraph, never empty where there is room."""
    end = F.least(F.col("start") + SPAN, F.col("para_chars"))
    return hits.withColumn("span_start", F.col("start")).withColumn("span_end", F.when(F.col("start") >= end, F.least(F.col("start") + 1, F.col("para_chars"))).otherwise(end))


def cascade(anchors: DataFrame, paras: DataFrame) -> DataFrame:
    """Where each issue goes: its anchor's paragraph; without an anchor its own index; else the document's first paragraph.

    An anchor that isn't found does not fall back to the index. anchors: (doc_id, seq, anchor_text, para_idx)."""
    anchors = written(anchors, "anchors")  # the plan behind them runs once
    hits = anchor_hits(anchors, paras)
    there = paras.select("doc_id", "para_idx", F.col("para_idx").alias("by_index"))
    first = paras.groupBy("doc_id").agg(F.min("para_idx").alias("first_para"))
    joined = anchors.join(hits.select("doc_id", "seq", "hit_para"), ["doc_id", "seq"], "left").join(there, ["doc_id", "para_idx"], "left").join(first, "doc_id", "left")
    anchored = T.strip(F.coalesce("anchor_text", F.lit(""))) != ""
    place = F.when(anchored, F.col("hit_para")).otherwise(F.col("by_index"))
    how = F.when(anchored & F.col("hit_para").isNotNull(), "anchor").when(~anchored & F.col("by_index").isNotNull(), "index").otherwise("fallback")
    return joined.select("doc_id", "seq", F.coalesce(place, "first_para").alias("place"), how.alias("how"))


#: The keys of a table cell's paragraph, and what a comment says that could not be put where it belongs (the wording is fixed by the format).
CELL = ("table_index", "row", "col", "cell_para")
TO_DOCUMENT, TO_CHAPTER = "⚠️ 精确定位失败, 挂到文档开头", "⚠️ 精确定位失败, 挂到本章开头"


def mounted(issues: DataFrame, paras: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, seq, place, how, warning): the paragraph of every issue whose document has one, and which arm found it.

    issues: (doc_id, seq, anchor_text, para_idx, chapter, cell keys), cells: (doc_id, cell keys, para_idx). An issue with all
    cell keys is looked for there only, one with an anchor by that only, others by their index. What isn't found goes to the
    first paragraph that holds its chapter, contents lines included, else to the document's first, with a warning. Chapters are
    looked for once for each document and chapter, and only for issues that nothing else found."""
    rows = written(issues.select("doc_id", "seq", "anchor_text", "para_idx", "chapter", *CELL), "issues")  # the plan behind them runs once
    whole = F.lit(True)
    for c in CELL:
        whole = whole & F.col(c).isNotNull()
    anchored = T.strip(F.coalesce("anchor_text", F.lit(""))) != ""
    rows = rows.withColumn("arm", F.when(whole, "cell").when(anchored, "anchor").otherwise("index"))
    keys = ["doc_id", "seq"]
    by_cell = rows.filter("arm = 'cell'").select(*keys, *CELL).join(cells.groupBy("doc_id", *CELL).agg(F.min("para_idx").alias("place")), ["doc_id", *CELL])
    by_anchor = anchor_hits(rows.filter("arm = 'anchor'").select(*keys, "anchor_text"), paras).withColumnRenamed("hit_para", "place")
    by_index = rows.filter("arm = 'index'").select(*keys, "para_idx").join(paras.select("doc_id", "para_idx"), ["doc_id", "para_idx"]).withColumnRenamed("para_idx", "place")
    found = by_cell.select(*keys, "place").unionByName(by_anchor.select(*keys, "place")).unionByName(by_index.select(*keys, "place"))
    placed = written(rows.select(*keys, "arm", T.strip(F.coalesce("chapter", F.lit(""))).alias("chapter")).join(found, keys, "left"), "placed")
    chapters = placed.filter("place is null and chapter <> ''").select("doc_id", "chapter").distinct()
    heads = chapters.join(paras.select("doc_id", "para_idx", "text"), "doc_id").filter(F.contains("text", "chapter")).groupBy("doc_id", "chapter").agg(F.min("para_idx").alias("head"))
    first = paras.groupBy("doc_id").agg(F.min("para_idx").alias("first"))
    to = F.coalesce("place", "head", "first")
    warning = F.when(F.col("place").isNull(), F.when(F.coalesce("head", "first") == F.col("first"), TO_DOCUMENT).otherwise(TO_CHAPTER))
    how = F.when(F.col("place").isNotNull(), F.col("arm")).when(F.coalesce("head", "first") == F.col("first"), "document").otherwise("chapter")
    return placed.join(heads, ["doc_id", "chapter"], "left").join(first, "doc_id").select(*keys, to.alias("place"), how.alias("how"), warning.alias("warning"))


def offset_span(text: Column, char_offset: Column, anchor: Column, sentence: Column) -> Column:
    """(span_start, span_end) inside a paragraph: ten characters from a given offset, else the first of the anchor's 30 characters, else the
    sentence of that number, with its ender, else the paragraph. Negative numbers and nulls are not given."""
    size, needle = F.length(text), F.substring(T.strip(F.coalesce(anchor, F.lit(""))), 1, NEEDLE)
    span = lambda a, b: F.struct(a.cast("long").alias("span_start"), b.cast("long").alias("span_end"))
    at = F.instr(text, needle) - 1
    sizes = F.transform(T.sentences(text), lambda s: F.length(s) + 1)
    begin = F.aggregate(F.slice(sizes, F.lit(1), F.greatest(sentence.cast("int"), F.lit(0))), F.lit(0), lambda a, n: a + n)
    offset = F.least(char_offset, size)
    return (
        F.when(char_offset >= 0, span(offset, F.least(offset + 10, size)))
        .when((needle != "") & (at >= 0), span(at, F.least(at + F.length(needle), size)))
        .when((sentence >= 0) & (sentence < F.size(sizes)) & (begin < size), span(begin, F.least(begin + F.get(sizes, F.greatest(sentence.cast("int"), F.lit(0))), size)))
        .otherwise(span(F.lit(0), size))
    )


def _piece(n: int) -> Callable[[Column], Column]:
    return lambda i: F.substring(F.col("text"), i, F.lit(n))


def hit_candidates(items: DataFrame, paras: DataFrame) -> DataFrame:
    """(item_id, needle, doc_id, para_idx): the paragraphs that may hold the first characters of each item.

    A needle's grams are the pairs of neighbouring words inside it, or its one inner word, known by hashes. The paragraphs with any of
    them are found by joins that carry no text; a needle's candidates are those of the gram which stands in the fewest, so common
    words bring none. Needles without an inner word are joined to the paragraphs' pieces of as many characters."""
    needle = F.substring(T.strip(F.col("text")), 1, NEEDLE)
    inner = _inner_words(F.col("needle"))
    wanted = written(items.select("item_id", needle.alias("needle")).filter("needle <> ''").withColumns({"w": inner, "n": F.size(inner)}), "needles")
    found = wanted.agg(F.count("*").alias("rows"), F.count_if(F.col("n") == 1).alias("single"), F.collect_set(F.when(F.col("n") == 0, F.length("needle"))).alias("sizes")).first()  # at most NEEDLE sizes
    hint = F.broadcast if found["rows"] * NEEDLE <= BROADCAST_ROWS else (lambda df: df)
    # (word, next word) of a row's words; the last word has none
    twos = lambda df, *carry: df.select(*carry, F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("p")).select(*carry, "p.*")
    pair, one = F.xxhash64("a", "b").alias("gram"), F.xxhash64("a").alias("gram")
    grams = twos(wanted.filter("n > 1"), "item_id", "needle").filter("b is not null").select("item_id", "needle", pair)
    words = twos(paras.select("doc_id", "para_idx", F.split("text", " ").alias("w")), "doc_id", "para_idx")
    met = words.filter("b is not null").select("doc_id", "para_idx", pair)
    if found["single"]:
        grams = grams.unionByName(wanted.filter("n = 1").select("item_id", "needle", F.col("w")[0].alias("a")).select("item_id", "needle", one))
        met = met.unionByName(words.select("doc_id", "para_idx", one))
    met = written(met.join(hint(grams.select("gram").distinct()), "gram").distinct(), "met")
    often = grams.join(met.groupBy("gram").agg(F.count("*").alias("often")), "gram", "left")
    # a gram that stands nowhere settles it: there is no hit
    keyed = often.groupBy("item_id", "needle").agg(F.min(F.struct("often", "gram")).alias("r"), F.count_if(F.col("often").isNull()).alias("lacking")).filter("lacking = 0").select("item_id", "needle", "r.gram")
    near = met.join(hint(keyed), "gram").select("item_id", "needle", "doc_id", "para_idx")
    if found["sizes"]:
        bare = wanted.filter("n = 0").select("item_id", "needle")
        starts = lambda n: F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1)))
        pieces = F.flatten(F.array(*[F.transform(starts(n), _piece(n)) for n in sorted(found["sizes"])]))
        near = near.unionByName(paras.select("doc_id", "para_idx", F.explode(F.array_distinct(pieces)).alias("needle")).join(bare, "needle").select("item_id", "needle", "doc_id", "para_idx"))
    return near


def first_hits(items: DataFrame, paras: DataFrame) -> DataFrame:
    """(item_id, doc_id, para_idx): first place in the corpus of the first characters of each item, lines of a table of contents last.

    Texts are fetched for the candidates only."""
    hit = hit_candidates(items, paras).join(paras.select("doc_id", "para_idx", "text"), ["doc_id", "para_idx"]).filter(F.contains("text", "needle"))
    order = F.struct(T.is_contents_line(F.col("text")).cast("int"), "doc_id", "para_idx")
    return hit.groupBy("item_id").agg(F.min_by(F.struct("doc_id", "para_idx"), order).alias("p")).select("item_id", "p.*")


def annotation_plan(spans: DataFrame) -> DataFrame:
    """Order in which comments are written into a paragraph: from its end to its begin; ids in the order of the issues."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    numbered = spans.withColumn("comment_id", number.cast("long"))
    order = Window.partitionBy("doc_id", "hit_para").orderBy(F.desc("span_start"), "comment_id")
    return numbered.withColumn("write_order", F.row_number().over(order).cast("long"))
