"""String columns to columns. Every function keeps null as null unless its docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENDERS = "[.!?;。！？；]"
_DOT = "\ue000"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def key_of(c: Column) -> Column:
    """Matching form: no white space or punctuation, lower case; null becomes '' so that missing values match each other."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s.,;:'\"\[\]()]", ""))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def clamp(c: Column, most: int, tail: str = "") -> Column:
    """At most `most` characters; a longer text is cut and ends in tail."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(tail)), F.lit(tail))).otherwise(c)


def sentences(c: Column) -> Column:
    """Array of sentences without their enders. A dot between two letters or digits ends none."""
    kept = c
    for _ in range(2):  # neighbours share characters, so one pass leaves every second dot
        kept = F.regexp_replace(kept, r"([A-Za-z0-9])\.([A-Za-z0-9])", f"$1{_DOT}$2")
    return F.transform(F.split(kept, _ENDERS, -1), lambda s: F.replace(s, F.lit(_DOT), F.lit(".")))


def is_contents_line(c: Column) -> Column:
    """A line of a table of contents: at most 100 characters, under 80 when trimmed, ending in a page number."""
    trimmed = strip(c)
    return (F.length(c) <= 100) & (F.length(trimmed) < 80) & trimmed.rlike(r"\d{1,4}\s*$")


def looks_scanned(c: Column) -> Column:
    """A page whose text is blank or hardly letters and digits, or has runs of dots, blocks or replacement characters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return (strip(c) == "") | (letters / F.greatest(F.length(c), F.lit(1)) < 0.1) | c.rlike(r"\.{5,}|[□■▯]|�")


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences; 0 for an empty word."""
    left = F.length(text) - F.length(F.replace(text, word, F.lit("")))
    return F.when(F.length(word) > 0, left / F.length(word)).otherwise(0).cast("long")


def context(text: Column, word: Column, around: int = 40) -> Column:
    """The first occurrence with so many characters on both sides, newlines as spaces, trimmed; '' if there is none."""
    at = F.instr(text, word)
    start = F.greatest(at - around, F.lit(1))
    piece = F.substring(text, start, at - start + F.length(word) + around)
    return F.when(at > 0, F.trim(F.regexp_replace(piece, "\n", " "))).otherwise("")


def stable_id(prefix: str, c: Column) -> Column:
    """Eight upper-case hex digits of the MD5 of prefix and text."""
    return F.upper(F.substring(F.md5(F.concat(F.lit(prefix), c)), 1, 8))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_\-.]", "_")


def masked(c: Column) -> Column:
    """First and last four characters of a longer secret, stars between; short ones are all stars."""
    return F.when(F.length(c) > 8, F.concat(F.left(c, F.lit(4)), F.repeat(F.lit("*"), F.length(c) - 8), F.right(c, F.lit(4)))).otherwise(F.repeat(F.lit("*"), F.length(c)))


def valid_object_name(c: Column) -> Column:
    """At most 1024 bytes, letters, digits and ._-/ only, no slash at an end or twice in a row."""
    return (F.octet_length(c) <= 1024) & c.rlike(r"^[A-Za-z0-9._\-/]+$") & ~c.rlike(r"^/|/$|//")


def table_cell(c: Column) -> Column:
    """Text for a Markdown table cell."""
    return F.regexp_replace(F.replace(c, F.lit("|"), F.lit("｜")), "\n", " ")


def mapped(c: Column, values: dict, default) -> Column:
    """Lookup in a fixed dimension."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def cut_file_name(name: Column, most: int = 180, reserve: int = 30) -> Column:
    """A file name whose stem has at most `most` - reserve bytes of UTF-8 less its suffix (ten at least): whole characters only, suffix kept.

    A cut that ends just after a character of several bytes loses that character too. An empty name is 'document'."""
    suffix = F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    room = F.greatest(F.lit(most - reserve) - F.octet_length(suffix), F.lit(10))
    fits = lambda k: F.octet_length(F.left(stem, k)) + F.when(F.octet_length(F.substring(stem, k, F.lit(1))) > 1, 1).otherwise(0) <= room
    size = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(stem), room)), lambda k: (k == 0) | fits(k)))
    cut = F.when(F.octet_length(stem) <= room, name).otherwise(F.concat(F.left(stem, size), suffix))
    return F.when(F.coalesce(name, F.lit("")) == "", "document").otherwise(cut)


#: Chinese digits by value, and the two powers of ten. The values are fixed by the script.
DIGITS = "零一二三四五六七八九"
POWERS = {"十": 10, "百": 100}


def numeral(c: Column) -> Column:
    """Value of a Chinese numeral below 1000; other characters count as the digit 0, so a text without numerals gives 0."""
    digit = lambda ch: F.greatest(F.instr(F.lit(DIGITS), ch) - 1, F.lit(0))
    power = lambda ch: mapped(ch, POWERS, 0)

    def step(acc: Column, ch: Column) -> Column:
        closed = acc["total"] + F.when(acc["open"] == 0, 1).otherwise(acc["open"]) * power(ch)
        return F.when(power(ch) > 0, F.struct(closed.alias("total"), F.lit(0).alias("open"))).otherwise(F.struct(acc["total"].alias("total"), (acc["open"] * 10 + digit(ch)).alias("open")))

    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("open"))
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), zero, step, lambda acc: acc["total"] + acc["open"]).cast("long")


#: Pieces of a JSON text, which they tile: whole strings, a string without end, blanks, signs, anything else.
JSON_PIECE = r'"[^"\\]*(?:\\[\s\S][^"\\]*)*"|"[\s\S]*|\s+|[\[\]{},:]|[^\[\]{},:"\s]+'


def repaired_json(c: Column) -> Column:
    """A JSON text that was cut off, up to its last complete member, with the brackets closed that are open there.

    The pieces are read once with the open brackets as a stack. A text may end after a bracket that closes, before a comma that
    follows a value, after a whole string that is a value, and after the bracket it begins with; a number or word at the very
    end may be a part of one and goes. What follows a wrong bracket, or the whole value, goes too. Valid JSON stays, and so
    does a text that begins with no bracket; the result may still be invalid where the text was wrong before its cut."""

    def step(s: Column, piece: Column) -> Column:
        k, end, top = F.left(piece, F.lit(1)), s["pos"] + F.length(piece), F.right(s["open"], F.lit(1))
        opens, closes = k.isin("[", "{"), k.isin("]", "}")
        fits = ((k == "]") & (top == "[")) | ((k == "}") & (top == "{"))
        wrong = (s["before"] == "!") | (closes & ~fits) | ((s["open"] == "") & ((s["before"] != "") | ~opens))
        now = F.when(opens, F.concat(s["open"], k)).when(closes, F.left(s["open"], F.length(s["open"]) - 1)).otherwise(s["open"])
        value = (s["before"] == ":") | ((top == "[") & s["before"].isin("[", ","))
        ends = (opens & (s["open"] == "")) | closes | (value & piece.rlike(r'^"[^"\\]*(?:\\[\s\S][^"\\]*)*"$'))
        comma = (k == ",") & ~s["before"].isin(",", "[", "{", ":")
        state = lambda before, keep, stack, open_: F.struct(end.alias("pos"), open_.alias("open"), before.alias("before"), keep.alias("keep"), stack.alias("stack"))
        keep, stack = F.when(ends, end).when(comma, s["pos"]).otherwise(s["keep"]), F.when(ends, now).when(comma, s["open"]).otherwise(s["stack"])
        return F.when(piece.rlike(r"^\s"), state(s["before"], s["keep"], s["stack"], s["open"])).when(wrong, state(F.lit("!"), s["keep"], s["stack"], s["open"])).otherwise(state(k, keep, stack, now))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("open"), F.lit("").alias("before"), F.lit(0).alias("keep"), F.lit("").alias("stack"))
    closed = lambda s: F.when(s["keep"] > 0, F.concat(F.left(c, s["keep"]), F.translate(F.reverse(s["stack"]), "[{", "]}"))).otherwise(c)
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(F.aggregate(F.regexp_extract_all(c, F.lit(JSON_PIECE), F.lit(0)), start, step, closed))


def escaped(c: Column) -> Column:
    """Text for an XML element."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def suggestions(c: Column) -> Column:
    """At most five suggestions of at most 500 characters; an empty or missing list gets a placeholder."""
    filled = F.when(F.coalesce(F.size(c), F.lit(0)) > 0, c).otherwise(F.array(F.lit("(no suggestion)")))
    return F.slice(F.transform(filled, lambda s: F.substring(s, 1, 500)), 1, 5)
