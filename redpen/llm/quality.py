"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

N-grams of GRAM bytes are hashed into a fixed number of buckets: characters, not words, because few
trusted texts already hold most of the former, in every language. Two multinomials over the buckets are
estimated with add-one smoothing: one from two thirds of the trusted texts, one from every text of the
corpus. A text's score is the mean log ratio of its n-grams. The other third of the trusted texts, which
the fit hasn't seen, sets the threshold: MARGIN below the score that all but LEAST_SHARE of them reach.
Every trusted text is in one of the two parts, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.base import pieces, small_batches, written
from redpen.llm.textvec import U64, Prefix, Words, mix, per_doc, repeated

BUCKETS = 1 << 14
GRAM = 4
#: Share of the left-out trusted texts that may score lower than what the margin is taken from.
LEAST_SHARE, MARGIN = 0.01, 0.1
#: Threshold where fewer than CALIBRATED trusted texts are left out.
THRESHOLD, CALIBRATED = -0.5, 20
#: Characters counted as symbols (fixed by the contract).
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _buckets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every GRAM bytes in a row inside a text."""
    size = len(words.buf) - GRAM + 1
    if size < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros(size, U64)
    for k in range(GRAM):
        value = value << U64(8) | words.buf[k : size + k]
    counts = np.maximum(words.hi - words.lo - GRAM + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(doc)) + np.repeat(words.lo - (np.cumsum(counts) - counts), counts)
    return (mix(value[at]) % U64(n)).astype(np.int64), doc


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, left_out): every doc_id with quality 1, once; a third, by hash, is left out of the fit and sets the threshold."""
    ids = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return ids.withColumn("left_out", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0)


#: The name that tests know it by, from when it was capped; it takes every trusted doc_id.
trusted_sample = trusted_ids


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, left_out) of every row of docs with a trusted doc_id, as a table. The ids grow with the labels, so they are never broadcast."""
    return written(docs.select("doc_id", "text").join(trusted_ids(labels).hint("shuffle_hash"), "doc_id"), "trusted", "zstd")


def log_ratios(docs: DataFrame, fitted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(p_target / p_raw) of each bucket: the target from the texts of fitted, the rest from those of docs.

    Every task sends one row for each bucket it met; what reaches the driver is one row for each bucket.
    Without trusted texts all ratios are 0.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("text", F.lit(False).alias("trusted")).union(fitted.select("text", F.lit(True).alias("trusted")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = np.array(batch.column("trusted").to_pylist(), bool)
            for at, part in pieces(batch, "text"):
                b, doc = _buckets(Words(part), buckets)
                of = good[at : at + len(part)][doc]
                raw += np.bincount(b[~of], minlength=buckets)
                target += np.bincount(b[of], minlength=buckets)
        met = np.flatnonzero(raw + target)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(raw[met]), pa.array(target[met])], ["bucket", "raw", "target"])

    counts = texts.mapInArrow(count, "bucket long, raw long, target long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def calibrated(left_out: DataFrame, ratios: np.ndarray) -> float:
    """The threshold, from the scores of all texts of left_out (the least score of a repeated doc_id).

    The scores are sorted by Spark; only the number of rows of each sorted part and the score at the rank reach the driver.
    """
    scores = measure(left_out, ratios).filter("not base_failed").groupBy("doc_id").agg(F.min("llr").alias("llr"))
    # a row's place: its part in the upper bits, its number in the part in the lower 33; copies have equal scores, which doc_id deals out
    ranked = written(scores.orderBy("llr", "doc_id").select("llr", F.monotonically_increasing_id().alias("place")), "scores")
    parts = sorted(ranked.groupBy(F.shiftright("place", 33)).count().collect())
    n = sum(rows for _, rows in parts)
    if n < CALIBRATED:
        return THRESHOLD
    rank = int(LEAST_SHARE * n)
    for part, rows in parts:
        if rank < rows:
            break
        rank -= rows
    return ranked.filter(F.col("place") == (part << 33) + rank).first()["llr"] - MARGIN


def measure(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, the columns named in carry, the rule counts, llr, base_failed and kept.

    Null text counts as empty; a text without words has llr 0 and fails the base rule. Other columns of
    docs are ignored, repeated rows are each measured.
    """
    small_batches(docs.sparkSession)
    n = len(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            for _, texts in pieces(batch, "text"):
                parts.append(_measured(texts, ratios, n))
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6
            words, chars, symbols, lines, repeats, llr = cols
            failed = (words < 50) | (100 * repeats > 50 * words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(c) for c in carry), *(pa.array(x.astype(np.int64)) for x in (words, chars, symbols, lines, repeats)), pa.array(llr.astype(np.float64)), pa.array(failed), pa.array(~failed & (llr >= threshold))],
                ["doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"],
            )

    kinds = dict(docs.dtypes)
    passed = "".join(f"{c} {kinds[c]}, " for c in carry)
    return docs.select("doc_id", "text", *(c for c in carry if c != "text")).mapInArrow(score, f"doc_id {kinds['doc_id']}, {passed}n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean")


def _measured(texts: list[bytes], ratios: np.ndarray, n: int) -> list[np.ndarray]:
    words = Words(texts)
    prefix = Prefix(words.buf)
    hashes = prefix.of(words.start, words.end)
    b, doc = _buckets(words, n)
    grams = np.bincount(doc, minlength=len(texts))
    llr = np.bincount(doc, weights=ratios[b], minlength=len(texts)) / np.maximum(grams, 1)

    chars = per_doc(words.is_word & ((words.buf & 0xC0) != 0x80), words.lo, words.hi)
    symbols = per_doc(_IS_SYMBOL[words.buf], words.lo, words.hi)

    three = words.same_doc(3)
    keys = mix(hashes[three] * U64(5) + mix(hashes[three + 1] * U64(3) + hashes[three + 2])) + mix(words.doc[three].astype(U64))
    twice, _ = repeated(keys)
    covered = np.zeros(len(words.doc) + 2, bool)
    for k in range(3):
        covered[three[twice] + k] = True
    repeats = np.bincount(words.doc[covered[: len(words.doc)]], minlength=len(texts))

    newline = words.buf == 10
    newline[words.hi] = True  # the space after each text ends its last line
    stop = np.flatnonzero(newline)
    begin = np.empty_like(stop)
    begin[:1], begin[1:] = 0, stop[:-1] + 1
    full = np.searchsorted(words.start, begin) < np.searchsorted(words.start, stop)
    begin, stop = begin[full], stop[full]
    of = np.searchsorted(words.hi, begin)
    _, later = repeated(prefix.of(begin, stop) + mix(of.astype(U64)))
    lines = np.bincount(of[later], minlength=len(texts))
    return [words.count, chars, symbols, lines, repeats, llr]


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, carry: tuple[str, ...] = ()) -> DataFrame:
    """The operator: fit both multinomials, set the threshold, then measure and decide every row of docs."""
    trusted = trusted_texts(docs, labels)
    ratios = log_ratios(docs, trusted.filter("not left_out"), buckets)
    return measure(docs, ratios, calibrated(trusted.filter("left_out"), ratios), carry)
