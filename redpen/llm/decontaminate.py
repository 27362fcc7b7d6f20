"""Benchmark decontamination by template canonicalisation.

Numbers, names and units are replaced by typed placeholders, so that a question with other values has
the same template; a name of several words is one placeholder. A capital at a sentence's beginning may
be a name or not, so windows with one are read both ways. Five-token windows of the templates are
hash-joined with those of the benchmark. Then the values that fill the slots are checked over all
windows of a text and an item: a value of the item has to stand for one value of the text everywhere.

Windows with fewer than two literal tokens, and items of fewer than five tokens, have too little template
to go by: they are compared word by word, with their values.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.base import pieces, small_batches, small_side, written
from redpen.llm.textvec import U64, Prefix, mix

WINDOW = 5
#: Share of an item's windows that a document must hold.
CONTAINED = 0.8
#: Literal (not placeholder) tokens that a window needs to be compared.
LITERALS = 2
#: Bits of the table by which tasks leave out windows that no item has. It grows with nothing: a larger benchmark passes more windows on to the join.
FILTER_BITS = 1 << 22
#: Tokens by which the distance of both texts may change inside one alignment (words put in or left out).
SHIFT = 8
#: Words that are units behind a number (fixed values).
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons lb lbs oz ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "k c f degree degrees percent pct dollar dollars usd eur euro euros gbp pound pounds cent cents "
    "w kw mw v kv a hz khz mhz ghz j kj cal kcal n pa kpa bar mol kb mb gb tb bit bits byte bytes kmh mph rpm"
).split()

NUMBER, NAME, UNIT = 1, 2, 3

_IS = {k: np.zeros(256, bool) for k in ("digit", "token", "upper", "lower", "ender", "point")}
_IS["digit"][48:58] = True
_IS["upper"][65:91] = True
_IS["lower"][97:123] = True
_IS["token"][48:58] = _IS["token"][65:91] = _IS["token"][97:123] = True
_IS["token"][128:] = True
_IS["ender"][list(b".!?:;\n\"(")] = True
_IS["point"][list(b".,")] = True


class Template:
    """Canonical tokens of many texts: doc, start, end, kind (0: a literal) and hash of each."""

    def __init__(self, texts: list[bytes]):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        hi = np.cumsum(lens + 1) - 1
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw = raw
        after = np.append(raw[1:], np.uint8(10))
        before = np.append(np.uint8(10), raw[:-1])
        latin = before == 0xC3  # capitals of Latin-1 are C3 80 to C3 9E, their small letters 0x20 above
        upper = _IS["upper"][raw] | (latin & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97))
        low = raw + (upper * np.uint8(32))
        digit, token = _IS["digit"][raw], _IS["token"][raw]
        quote = (raw == 0xE2) & ((after == 0x80) | (after == 0x81))  # general punctuation: dashes, quotes
        token = token & ~quote & ~np.append(False, quote[:-1]) & ~np.append([False, False], quote[:-2])[: len(raw)]
        point = _IS["point"][raw] & _IS["digit"][before] & _IS["digit"][after]
        kind = np.where(digit | point, 2, token).astype(np.int8)  # 0 outside, 1 letters, 2 number
        edge = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))
        kinds = kind[edge]
        inside = kinds > 0
        self.start, self.end = edge[inside], np.append(edge[1:], len(raw))[inside]
        number = kinds[inside] == 2
        self.doc = np.searchsorted(hi, self.start)
        first = np.flatnonzero(np.diff(self.doc, prepend=-1))

        prefix = Prefix(low)
        literal = prefix.of(self.start, self.end)
        lead = self.start + (raw[self.start] == 0xC3) if len(self.start) else self.start
        lead_end = np.minimum(lead + 1, len(raw) - 1)
        small = _IS["lower"][raw] | ((raw >= 0xC4) & (raw < 0xF8)) | ((raw == 0xC3) & (after >= 0x9F))  # a character that begins here isn't a capital of Latin-1
        capital = upper[lead] & small[lead_end] & (lead_end < self.end)
        # a capital begins a name unless it begins a sentence: then an ender stands between it and the token before
        enders = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_IS["ender"][raw], out=enders[1:])
        behind = np.append(0, self.end[:-1])
        opens = enders[self.start] > enders[behind]
        opens[first] = True
        unit = np.append(False, number[:-1]) & np.isin(literal, _UNIT_HASHES)
        if len(unit):
            unit[first] = False
        self.kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(capital & ~opens, NAME, 0)))
        self.either = capital & opens & (self.kind == 0)  # a name or not
        self.prefix, self.first = prefix, first
        #: stands right behind the token before, with one space between
        self.near = np.append(False, (self.start[1:] - self.end[:-1] == 1) & (raw[self.end[:-1]] == 32)) if len(self.start) else np.zeros(0, bool)

    def reading(self, names: bool) -> tuple[np.ndarray, ...]:
        """(token, kind, value, either) of the sequence with adjacent names as one; names: sentences begin with names where they can."""
        kind = np.where(self.either & names, NAME, self.kind)
        if not len(kind):
            return np.zeros(0, np.int64), kind, np.zeros(0, U64), np.zeros(0, bool)
        goes_on = np.append(False, (kind[1:] == NAME) & (kind[:-1] == NAME)) & self.near
        token = np.flatnonzero(~goes_on)
        last = np.append(token[1:], len(kind)) - 1
        return token, kind[token], self.prefix.of(self.start[token], self.end[last]), np.logical_or.reduceat(self.either, token)

    def windows(self, n: int = WINDOW, names: bool = False, literally: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first token, key, filled, values) of each window of n tokens inside a text; filled marks the slots in the grid of values.

        With names only the windows that read otherwise then. Windows with fewer than LITERALS literal tokens, or all of them
        if literally is given, have keys of their values and no slots."""
        token, kind, value, either = self.reading(names)
        doc = self.doc[token]
        at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
        grid = at[:, None] + np.arange(n)
        if names and len(at):
            grid = grid[either[grid].any(axis=1)]
        slot = kind[grid] > 0
        exact = ((~slot).sum(axis=1) < LITERALS) | literally
        filled = slot & ~exact[:, None]
        seen = np.where(filled, mix(kind[grid].astype(U64)), value[grid])
        key = np.where(exact, U64(n), U64(0)).astype(U64)
        for k in range(n):
            key = mix(key * U64(31) + seen[:, k])
        return token[grid[:, 0]], key, filled, value[grid]


_UNIT_HASHES = np.sort(np.array([Prefix(np.frombuffer(u.encode(), np.uint8)).of(np.array([0]), np.array([len(u)]))[0] for u in UNITS], U64))


def template_windows(rows: DataFrame, id_column: str, short: tuple[int, ...] = (), keep: np.ndarray | None = None) -> DataFrame:
    """(id, at, key, values, n): one row for each window of each text and reading: its first token, its key, what fills its slots, and the
    text's number of windows. A text of fewer than WINDOW tokens is one window.

    short: lengths of windows that are looked for besides (of short items); keep: only windows that this table of bits has.
    """
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for row, texts in pieces(batch, "text"):
                t = Template(texts)
                first = np.searchsorted(t.doc, np.arange(len(texts)))  # first token of each text
                tokens = np.bincount(t.doc, minlength=len(texts))
                total = np.bincount(t.doc[t.windows()[0]], minlength=len(texts))
                total[total == 0] = 1
                found = [t.windows(), t.windows(names=True)]
                for n in short if keep is not None else range(1, WINDOW):
                    w = t.windows(n, literally=True)
                    own = slice(None) if keep is not None else tokens[t.doc[w[0]]] == n  # an item is one window, a document has many
                    found.append(tuple(x[own] for x in w))
                for at, key, filled, values in found:
                    if keep is not None and len(at):
                        maybe = np.flatnonzero(keep[(key % U64(FILTER_BITS)).astype(np.int64)])
                        at, key, filled, values = at[maybe], key[maybe], filled[maybe], values[maybe]
                    if not len(at):
                        continue
                    doc = t.doc[at]
                    offsets = pa.array(np.append(0, np.cumsum(filled.sum(axis=1))).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row + doc)), pa.array((at - first[doc]).astype(np.int64)), pa.array(key.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(values[filled].view(np.int64))), pa.array(total[doc].astype(np.int64))],
                        ["id", "at", "key", "values", "n"],
                    )

    return rows.select(F.col(id_column).alias("id"), "text").mapInArrow(run, f"id {dict(rows.dtypes)[id_column]}, at long, key long, values array<long>, n long")


def _filter_table(items: DataFrame) -> np.ndarray:
    """Flags of the FILTER_BITS remainders that keys of items have; Spark builds the bitmaps, FILTER_BITS / 8 bytes reach the driver at most."""
    place = F.pmod(F.col("key"), F.lit(FILTER_BITS)) + 1
    flags = np.zeros(FILTER_BITS, bool)
    for r in items.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect():
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little").astype(bool)
        flags[(r["k"] - 1) * len(bits) : r["k"] * len(bits)] = bits
    return flags


def consistent(matches: list[tuple[int, int, list[int], list[int]]]) -> tuple[int, int]:
    """(windows found, slot values) of one item in one text, from its matches (item_at, doc_at, item_values, doc_values).

    Matches are put together to alignments by the distance of both texts. From the largest alignment on, each value of the item
    that has no counterpart yet gets the one it meets most often there; windows that contradict don't count."""
    shifted = sorted(matches, key=lambda m: (m[1] - m[0], m[0], m[1]))
    groups: list[list] = []
    for m in shifted:
        if not groups or m[1] - m[0] - (groups[-1][-1][1] - groups[-1][-1][0]) > SHIFT:
            groups.append([])
        groups[-1].append(m)
    groups.sort(key=lambda g: (-len({m[0] for m in g}), g[0][1] - g[0][0]))
    meant: dict[int, int] = {}
    places: set[int] = set()
    for group in groups:
        votes: dict[int, Counter] = {}
        for _, _, item, doc in group:
            for b, d in zip(item, doc, strict=True):
                votes.setdefault(b, Counter())[d] += 1
        for b, seen in votes.items():
            meant.setdefault(b, min(seen, key=lambda d: (-seen[d], d)))
        places |= {at for at, _, item, doc in group if all(meant[b] == d for b, d in zip(item, doc, strict=True))}
    return len(places), len(meant)


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, n_slots) for each document that holds `share` or more of an item's windows with consistent
    slots: values of the document for values of the item.

    Null texts are empty; items without a token are never found, and an item of one word wherever the word stands.
    Repeated rows count once (windows are distinct by id); null ids are left out. Extra columns are ignored; an empty
    table on either side gives no rows. The matches of one item in one text are one row.
    """
    items = written(template_windows(benchmark.filter("item_id is not null"), "item_id").distinct(), "items")
    sizes = tuple(range(1, WINDOW)) if items.filter("n = 1").limit(1).count() else ()
    found = template_windows(docs.filter("doc_id is not null"), "doc_id", sizes, _filter_table(items)).select(F.col("id").alias("doc_id"), F.col("at").alias("doc_at"), "key", F.col("values").alias("doc_values"))
    item = items.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "key", F.col("values").alias("item_values"), F.col("n").alias("n_windows"))
    joined = found.join(small_side(item), "key").groupBy("doc_id", "item_id", "n_windows").agg(F.collect_set(F.struct("item_at", "doc_at", "item_values", "doc_values")).alias("matches"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [consistent([(m["item_at"], m["doc_at"], m["item_values"], m["doc_values"]) for m in matches]) for matches in batch.column("matches").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "item_id", "n_windows")), *(pa.array([r[k] for r in out], pa.int64()) for k in (0, 1))], ["doc_id", "item_id", "n_windows", "n_found", "n_slots"])

    enough = joined.filter(F.size(F.array_distinct(F.transform("matches", lambda m: m["item_at"]))) >= share * F.col("n_windows"))
    kinds = dict(joined.dtypes)
    rows = enough.mapInArrow(check, f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_windows long, n_found long, n_slots long")
    return rows.filter(F.col("n_found") >= share * F.col("n_windows"))
