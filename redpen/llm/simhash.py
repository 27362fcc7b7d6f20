"""SimHash near-dedup with pigeonring filtering (Qin and Xiao, 2018).

A 64-bit fingerprint is a ring of five segments. If two fingerprints differ in at most 2 bits, then
from some segment on, every chain of l consecutive segments differs in at most 2*l/5 bits: 0 bits in
one and two segments, 1 in three and four, 2 in all five. The chains are join keys: fingerprints that share
two neighbouring segments with another are kept, and two of them meet where, from the same segment on, four segments
differ in one bit at most: one side has its four segments as key, the other these and those with one bit of the third
or fourth changed. Whatever differs more in a chain never becomes a pair; the fifth segment is left to the
Hamming check.

Only distinct fingerprints are compared. A key of four segments has at most as many fingerprints as the fifth has
values, so however many fingerprints share two or three segments, no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.base import column_bytes, small_batches, written
from redpen.llm.components import components

SEED, WORDS, MAX_BITS = 42, 3, 2
#: Widths of the ring's segments, lowest bits first.
WIDTHS = (13, 13, 13, 13, 12)
#: Hashes that are turned to bits at once.
_CHUNK = 1 << 15


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 hashes of the text's 3-word shingles."""
    words = text.lower().split()  # bytes: A-Z only, and splits at space and the characters 9 to 13
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    n = min(WORDS, len(words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), len(words) - n + 1
    for k in range(0, total, _CHUNK):
        part = [digest(line[a : b - 1], SEED) for a, b in zip(starts[k : min(k + _CHUNK, total)], ends[k + n - 1 :], strict=False)]
        ones += np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for each row of docs; null and empty texts have 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in column_bytes(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _masks() -> list[int]:
    at, out = 0, []
    for w in WIDTHS:
        out.append(((1 << w) - 1) << at)
        at += w
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ring(distinct: DataFrame) -> DataFrame:
    """(fp, i, key): the two neighbouring segments from each segment i on."""
    masks, m = _masks(), len(WIDTHS)
    rings = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(masks[i] | masks[(i + 1) % m]))).alias("key")) for i in range(m)])
    return distinct.select("fp", F.explode(rings).alias("k")).select("fp", "k.i", "k.key")


def candidates(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: distinct fingerprints (column fp) that keep the budgets of all chains up to four segments from some segment on; a pair comes once for each."""
    masks, m = _masks(), len(WIDTHS)
    rows = _ring(distinct)
    twice = written(rows.groupBy("i", "key").agg(F.count("*").alias("n")).filter("n > 1").select("i", "key"), "ring")
    shared = written(rows.join(twice, ["i", "key"], "left_semi").select("fp", "i"), "shared")
    four = F.array(*[F.lit(_signed(sum(masks[(i + k) % m] for k in range(4)))) for i in range(m)])
    # the value itself, and those with one bit changed in the third or fourth segment
    budget = [[0, *(1 << b for b in range(64) if (masks[(i + 2) % m] | masks[(i + 3) % m]) >> b & 1)] for i in range(m)]
    flips = F.array(*[F.array(*[F.lit(_signed(x)) for x in own]) for own in budget])
    left = shared.select(F.col("fp").alias("a"), "i", F.col("fp").bitwiseAND(four[F.col("i")]).alias("key"))
    right = shared.select(F.col("fp").alias("b"), "i", F.explode(flips[F.col("i")]).alias("flip")).select("b", "i", F.col("b").bitwiseXOR(F.col("flip")).bitwiseAND(four[F.col("i")]).alias("key"))
    # both sides grow with the fingerprints; the small files of the written table must not pass for a small side
    return left.join(right.hint("merge"), ["i", "key"]).filter(F.col("a") < F.col("b")).select("a", "b")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) of all distinct fingerprints (column fp) that differ in at most 2 bits, a < b."""
    return candidates(distinct).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Null and empty texts have fingerprint 0 and are linked like others; repeated rows stay repeated; rows
    whose doc_id is null get the component of their fingerprint. Extra columns are ignored; an empty table
    gives no rows.
    """
    fps = written(fingerprints(docs), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
