"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over every text. Strings that may hide a word (digits or signs
for letters, spaced letters, repeated letters) become lattices of what may have been meant; Viterbi
decoding under the character model restores the likeliest reading, which may be the string itself.
The restored texts are scored by weights of words and word beginnings learned from labelled texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.base import small_batches, written
from redpen.llm.textvec import U64, Prefix, Words, mix

#: Bound on the labelled rows that weights are fitted on; the character model covers all rows.
MAX_LABELLED = 8_000
#: A feature needs so many toxic texts, this ratio of its rates in toxic and clean texts, and this z score.
LEAST_TOXIC, LEAST_RATIO, LEAST_Z = 4, 4.0, 4.0
TOXIC_FROM = 0.7
#: Bytes of a word's beginnings that are features beside the word.
STEMS = (4, 5, 6, 7)
#: Numbers that sum up a text for the logistic function (see Model.summary).
SUMMARY = 6

# Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = ".-_*~'`,:;/\\#%&^="
_SIGNS = re.escape("".join(LEET))
_APART = re.escape(SEPARATORS)
#: Punctuation around a word; what it encloses is decoded.
EDGES = ".,;:!?\"'()[]{}<>…“”‘’«»„-–—"
_NOISY = re.compile(rf"[^\W\d_][{_SIGNS}{_APART}]+[^\W\d_]|[{_SIGNS}][^\W\d_]|[^\W\d_][{_SIGNS}]|([^\W\d_])\1\1")
_SPACED = re.compile(rf"(?<!\S)(?:[^\W_]|[{_SIGNS}])(?:[ \t]+(?:[^\W_]|[{_SIGNS}])){{2,}}(?![^\s.,;:!?])")
_BLANKS = re.compile("[ \t]+")

#: Character classes of the model: 0 no letter, 1 to 26 a to z, 27 any other letter.
CLASSES = 28
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[0xC0:] = 27  # the first byte of another letter; its further bytes are left out


def char_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): character-class trigrams of all texts; runs of non-letters count as one."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for k in range(0, len(texts), 200):
                raw = np.frombuffer(b" ".join(texts[k : k + 200]) + b" ", np.uint8)
                c = _CLASS[raw[(raw & 0xC0) != 0x80]]
                c = c[np.append(True, (c[1:] > 0) | (c[:-1] > 0))]
                if len(c) > 2:
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["gram", "n"])

    return docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame) -> np.ndarray:
    """-log p(third | first two) of each trigram; at most CLASSES^3 rows reach the driver."""
    n = np.zeros((CLASSES, CLASSES, CLASSES))
    for r in char_counts(docs).collect():
        n.reshape(-1)[r["gram"]] = r["n"]
    n[:, 0, :] = n[:, 0, :].sum(axis=0)  # what stands before a word's beginning doesn't matter
    two = n.sum(axis=0)
    two = (two + 0.5) / (two.sum(axis=1, keepdims=True) + 0.5 * CLASSES)
    return -np.log((n + 5 * two[None, :, :]) / (n.sum(axis=2, keepdims=True) + 5))


class Restorer:
    """Viterbi decoding of single strings; costs are negative log probabilities."""

    SIGN, DROP, SKIP, KEEP, EDGE, ONCE, TWICE = 1.0, 8.0, 1.5, 5.0, 0.5, 1.0, 1.5

    def __init__(self, costs: np.ndarray):
        self.costs, self.held = costs.tolist(), {}

    def _edges(self, text: str, i: int) -> list[tuple[int, str, float]]:
        """(next place, what was meant, cost); a space ends a word."""
        ch = text[i]
        if ch.isalpha():
            run = i + 1
            while run < len(text) and text[run] == ch:
                run += 1
            if run - i >= 3:
                return [(run, ch, self.ONCE), (run, ch * 2, self.TWICE), (run, ch * (run - i), 0.0)]
            return [(i + 1, ch, 0.0)]
        out = [(i + 1, x, self.SIGN) for x in LEET.get(ch, "")]
        inner = 0 < i < len(text) - 1
        if ch in LEET:
            out += [(i + 1, "", self.DROP if inner or ch.isdigit() else self.EDGE), (i + 1, " ", self.KEEP)]
        elif ch in SEPARATORS:
            out += [(i + 1, "", self.SKIP if inner else self.EDGE), (i + 1, " ", 0.0)]
        else:
            out.append((i + 1, " ", 0.0))
        return out

    def decode(self, text: str) -> str:
        """The likeliest reading; a string that can be read in one way only comes back as it is."""
        states: list[dict] = [{} for _ in range(len(text) + 1)]
        states[0][(0, 0)] = (0.0, None, None, "")
        for i in range(len(text)):
            if not states[i]:
                continue
            edges = self._edges(text, i)
            for state, (cost, *_) in states[i].items():
                for j, meant, extra in edges:
                    a, b = state
                    now = cost + extra
                    for ch in meant:
                        c = 0 if ch == " " else ord(ch) - 96 if "a" <= ch <= "z" else 27
                        if c or b:
                            now += self.costs[a][b][c]
                            a, b = b, c
                    old = states[j].get((a, b))
                    if old is None or now < old[0]:
                        states[j][(a, b)] = (now, i, state, meant)
        end = min(states[-1], key=lambda s: (states[-1][s][0] + (self.costs[s[0]][s[1]][0] if s[1] else 0.0), s))
        out, i = [], len(text)
        while i:
            _, before, state, meant = states[i][end]
            out.append(meant)
            i, end = before, state
        return "".join(reversed(out))

    def spaced(self, m: re.Match) -> str:
        """Single letters in a row: one word if that is likelier than words of one letter each."""
        letters = _BLANKS.split(m[0])
        if sum(map(str.isalpha, letters)) < 2:
            return m[0]
        word = self.decode("".join(letters))
        return word if self.cost(word) < sum(self.cost(x) for x in letters) else m[0]

    def cost(self, word: str) -> float:
        a = b = 0
        total = 0.0
        for c in [*(0 if ch == " " else ord(ch) - 96 if "a" <= ch <= "z" else 27 for ch in word), 0]:
            if c or b:
                total += self.costs[a][b][c]
                a, b = b, c
        return total

    def inner(self, chunk: str) -> str | None:
        """The chunk with what its edge punctuation encloses decoded; None if nothing there may be hidden. A leading `!` may be a letter."""
        lead = chunk.lstrip(EDGES.replace("!", ""))
        core = lead.rstrip(EDGES)
        if not _NOISY.search(core):
            return None
        return chunk[: len(chunk) - len(lead)] + self.decode(core) + lead[len(core) :]

    def restore(self, text: str) -> str:
        """The text in lower case with every hidden string restored."""
        text = text.lower()
        text = _SPACED.sub(self.spaced, text)
        chunks = text.split()
        held = self.held
        new = {c for c in chunks if c not in held}
        if new:
            if len(held) > 300_000:
                held.clear()
                new = set(chunks)
            for c in new:
                held[c] = self.inner(c)
        changed = [held[c] for c in chunks]
        if any(x is not None for x in changed):
            return " ".join([c if x is None else x for c, x in zip(chunks, changed, strict=True)])
        return text


_PLAIN = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and hash of each word and word beginning; the words of each text."""
    words = Words([t.translate(_PLAIN) for t in texts])
    prefix = Prefix(words.buf)
    doc, key = [words.doc], [prefix.of(words.start, words.end)]
    for n in STEMS:
        long = words.end - words.start >= n
        doc.append(words.doc[long])
        key.append(mix(prefix.of(words.start[long], words.start[long] + n) + U64(n)))
    return np.concatenate(doc), np.concatenate(key), words.count


def _restored(batch: pa.RecordBatch, restorer: Restorer) -> Iterator[tuple[int, list[bytes]]]:
    at, held, size = 0, [], 0
    for i, t in enumerate(batch.column("text").to_pylist()):
        held.append(restorer.restore(t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size > 1 << 21:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def held_out(doc_id) -> F.Column:
    """Whether a row is for testing: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most `bound` labelled rows that aren't held out, by hash order of doc_id; texts with contradictory labels are left out."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    ids = rows.filter("toxic = most").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").cast("int").alias("toxic"))  # a doc_id counts once
    return found.select("text", "toxic")


class Model:
    """Weights of features (sorted keys) and the logistic function over a text's summary of them."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, beta: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights, self.beta = keys[order], weights[order], beta
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys & U64((1 << 20) - 1)).astype(np.int64)] = True

    def summary(self, texts: list[bytes]) -> np.ndarray:
        """Of each text: 1, greatest weight, sum of the weights of its distinct features, that sum for each log of its words,
        sum of the weights of all its features, and that sum for each 100 of its words: many weak signs in a short text tell more."""
        doc, key, n_words = _features(texts)
        out = np.zeros((len(texts), SUMMARY))
        out[:, 0] = 1
        if not len(self.keys):
            return out
        maybe = np.flatnonzero(self.seen[(key & U64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        hit = self.keys[place] == key[maybe]
        doc, place = doc[maybe[hit]], place[hit]
        pairs = np.unique(np.stack([doc, place]), axis=1)
        w = self.weights[pairs[1]]
        np.maximum.at(out[:, 1], pairs[0], w)
        out[:, 2] = np.log1p(np.bincount(pairs[0], weights=w, minlength=len(texts)))
        out[:, 3] = out[:, 2] / np.log1p(n_words + 2.0)
        every = np.bincount(doc, weights=self.weights[place], minlength=len(texts))
        out[:, 4], out[:, 5] = np.log1p(every), np.log1p(100 * every / (n_words + 20.0))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(texts) @ self.beta, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    beta, penalty = np.zeros(x.shape[1]), ridge * len(y) * np.append(0, np.full(x.shape[1] - 1, 0.01))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        beta = beta + np.linalg.solve(h + 1e-9 * np.eye(len(beta)), x.T @ (y - p) - penalty * beta)
    return beta


def fit(docs: DataFrame, labels: DataFrame, costs: np.ndarray, bound: int = MAX_LABELLED) -> Model:
    """Feature weights (smoothed log ratios of document rates) and the logistic weights, from the bounded sample.

    Without toxic or without clean rows every score is the rate of toxic rows, or 0 without any."""
    sample = written(labelled_sample(docs, labels, bound), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for batch in batches:
            toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
            for at, texts in _restored(batch, restorer):
                doc, key, _ = _features(texts)
                order = np.lexsort((doc, key))
                doc, key = doc[order], key[order]
                new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
                doc, key = doc[new], key[new]
                ids, place = np.unique(key, return_inverse=True)
                bad = np.bincount(place, weights=toxic[at + doc], minlength=len(ids)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(bad), pa.array(np.bincount(place, minlength=len(ids)) - bad)], ["feature", "bad", "good"])

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad_n, good_n = totals.get(1, 0), totals.get(0, 0)
    if not bad_n or not good_n:
        rate = bad_n / max(bad_n + good_n, 1)
        return Model(np.zeros(0, U64), np.zeros(0), np.append(np.log((rate + 1e-6) / (1 - rate + 1e-6)), np.zeros(SUMMARY - 1)))
    counts = sample.mapInArrow(count, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = ((F.col("bad") + 0.5) / bad_n) / ((F.col("good") + 0.5) / good_n)
    z = F.log(ratio) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    told = counts.filter((F.col("bad") >= LEAST_TOXIC) & (ratio >= LEAST_RATIO) & (z >= LEAST_Z)).select("feature", F.log(ratio).alias("w"))
    rows = told.orderBy("feature").collect()  # of the words of at most `bound` texts, those that tell
    model = Model(np.array([r["feature"] for r in rows], np.int64).view(U64), np.array([r["w"] for r in rows]), np.zeros(SUMMARY))

    names = [f"x{k}" for k in range(SUMMARY)]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for batch in batches:
            toxic = np.array(batch.column("toxic").to_pylist(), np.float64)
            for at, texts in _restored(batch, restorer):
                x = model.summary(texts)
                yield pa.RecordBatch.from_arrays([pa.array(toxic[at : at + len(texts)]), *(pa.array(x[:, k]) for k in range(SUMMARY))], ["y", *names])

    xy = np.array(sample.mapInArrow(summarise, ", ".join(f"{c} double" for c in ("y", *names))).collect())
    xy = xy[np.lexsort(xy.T)]  # at most `bound` rows; in one order, so that sums don't depend on how they came
    model.beta = _logistic(xy[:, 1:], xy[:, 0])
    return model


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Null and empty texts have no features and so the least score; repeated rows are each scored; a null doc_id
    isn't held out; extra columns are ignored; an empty table gives no rows. Only texts enter a score.
    """
    small_batches(docs.sparkSession)
    costs = char_model(docs)
    model = fit(docs, labels, costs, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for batch in batches:
            scores = [model.score(texts) for _, texts in _restored(batch, restorer)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= TOXIC_FROM).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
