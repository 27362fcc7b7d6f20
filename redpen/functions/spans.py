"""Places of pattern matches, by column expressions inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths are summed in chunks of so many, so the work of a text with n matches grows with n * (n / CHUNK + CHUNK).
CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: lambdas compute what they name outside again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)


def running(values: Column) -> Column:
    """Array of the sums of the elements before each element of an array of longs; null stays null."""
    chunk = lambda i: F.floor(i / CHUNK).cast("int")
    sums = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(chunk(F.size(v) - 1), F.lit(0))), lambda c: _total(F.slice(v, c * CHUNK + 1, CHUNK)))
    before = lambda v, s: F.transform(v, lambda _, i: _total(F.slice(s, F.lit(1), chunk(i))) + _total(F.slice(v, chunk(i) * CHUNK + 1, F.pmod(i, F.lit(CHUNK)))))
    return let(values, lambda v: let(sums(v), lambda s: before(v, s)))


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (span_start, span_end, hit), offsets of characters from 0, of a pattern that matches no empty text; null stays null.

    The gaps between matches are what the pattern splits the text into; a match begins after the gaps and matches before it."""
    long = lambda c: F.length(c).cast("bigint")
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"), F.transform(F.split(text, pattern, -1), long).alias("gaps"))

    def placed(p: Column) -> Column:
        pairs = F.transform(p["hits"], lambda h, i: F.get(p["gaps"], i) + long(h))
        start = lambda before, i: F.get(before, i) + F.get(p["gaps"], i)
        return let(running(pairs), lambda b: F.transform(p["hits"], lambda h, i: F.struct(start(b, i).alias("span_start"), (start(b, i) + long(h)).alias("span_end"), h.alias("hit"))))

    return let(parts, placed)


def around(text: Column, start: Column, end: Column, reach: int = 40) -> Column:
    """The characters from `reach` before start to `reach` after end, newlines as spaces, trimmed."""
    begin = F.greatest(start - reach, F.lit(0))
    return F.trim(F.regexp_replace(F.substring(text, (begin + 1).cast("int"), (end + reach - begin).cast("int")), "\n", " "))
