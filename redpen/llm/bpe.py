"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The words that are frequent in the whole corpus are merged once and compiled into a minimal acyclic
automaton whose arcs carry outputs that add up to the word's number (suffixes are shared); a table
by number holds the token ids. The arrays are one file that executors memory-map. Words that the
automaton doesn't accept are merged exactly, so the lexicon's size changes speed only, never results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import struct
import tempfile
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.base import small_batches

#: Most frequent words that are compiled.
LEXICON = 150_000
#: Occurrences in one task from which a word is a candidate for the lexicon.
LEAST = 20
#: Distinct strings between white space whose ids a task keeps at hand.
_HELD = 300_000
#: White space (Unicode White_Space), as the tokenizer's normalizer replaces it.
_CONTROLS = regex.compile("[\x1c-\x1f]")  # str.split() would split at these, which are no white space here
_SPACES = "\t-\r \x85\xa0  -     　"


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """A word-level BPE in the tokenizers library's JSON form (NFC, white space, lower case; end-of-word suffix)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks = {(a, b): k for k, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ", 1) for x in model["merges"])}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACES}"))
        self.spaces = regex.compile(f"[{_SPACES}]+")
        self.letters = _byte_letters()

    def normal(self, text: str) -> str:
        """NFC, then each character lower-cased by itself. White space stays: it only separates words."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # str.lower() alone would treat a final sigma by its neighbours

    def chunks(self, text: str) -> list[str | int]:
        """The normalised strings between white space, and the ids of added tokens that stand in the text."""
        if "<|" not in text or not self.split:
            text = self.normal(text)
            return self.spaces.split(text) if _CONTROLS.search(text) else text.split()
        out: list[str | int] = []
        for k, piece in enumerate(self.split.split(text)):
            if k % 2:
                out.append(self.added[piece])
            else:
                out += self.spaces.split(self.normal(piece))
        return out

    def merge(self, word: str) -> list[int]:
        """Exact BPE of one word: the pair of least rank first, leftmost of equals."""
        sym = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        sym[-1] += self.suffix
        n = len(sym)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := self.ranks.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = nxt[i] if sym[i] == a else -1
            if j < 0 or sym[j] != b:
                continue
            sym[i], sym[j], nxt[i] = a + b, "", nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for left, right in ((prv[i], i), (i, nxt[i])):
                if left >= 0 and right >= 0 and (r := self.ranks.get((sym[left], sym[right]))) is not None:
                    heapq.heappush(queue, (r, left, sym[left], sym[right]))
        return [self.ids[s] for s in sym if s]


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer of distinct words, built by adding them in byte order.

    keys: state * 256 + byte of each arc, sorted; to, add: the arc's target and output; final: accepting
    states; at, ids: the ids of word number k are ids[at[k]:at[k + 1]].
    """
    words = sorted(entries)
    finals, arcs = [False], [{}]  # states under construction; arcs: byte -> state
    register: dict[tuple, int] = {}
    path, last = [0], b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            child = path.pop()
            key = (finals[child], tuple(arcs[child].items()))
            same = register.setdefault(key, child)
            if same != child:
                arcs[path[-1]][last[len(path) - 1]] = same

    for word, _ in words:
        common = len(os.path.commonprefix([word, last]))
        close(common)
        for byte in word[common:]:
            finals.append(False)
            arcs.append({})
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        finals[path[-1]] = True
        last = word
    close(0)

    count: dict[int, int] = {}  # words accepted from a state
    stack = [(0, False)]
    while stack:
        s, done = stack.pop()
        if done:
            count[s] = finals[s] + sum(count[t] for t in arcs[s].values())
        elif s not in count:
            stack.append((s, True))
            stack += [(t, False) for t in arcs[s].values() if t not in count]
    number = {s: k for k, s in enumerate(sorted(count))}
    keys, to, add = [], [], []
    for s in sorted(count):
        skipped = int(finals[s])
        for byte, t in sorted(arcs[s].items()):
            keys.append(number[s] * 256 + byte)
            to.append(number[t])
            add.append(skipped)
            skipped += count[t]
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(i) for _, i in words], out=at[1:])
    return {
        "keys": np.array(keys, np.int64), "to": np.array(to, np.int64), "add": np.array(add, np.int64), "final": np.array([finals[s] for s in sorted(count)], bool),
        "at": at, "ids": np.array([x for _, i in words for x in i], np.uint32),
    }


_PARTS = (("keys", np.int64), ("to", np.int64), ("add", np.int64), ("final", np.bool_), ("at", np.int64), ("ids", np.uint32))


def save_lexicon(arrays: dict[str, np.ndarray], path: str) -> None:
    with open(path, "wb") as f:
        f.write(struct.pack("<6q", *(len(arrays[k]) for k, _ in _PARTS)))
        for k, kind in _PARTS:
            raw = arrays[k].astype(kind).tobytes()
            f.write(raw + b"\0" * (-len(raw) % 8))


class Lexicon:
    """The memory-mapped transducer."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        lens, at = struct.unpack("<6q", raw[:48].tobytes()), 48
        for (k, kind), n in zip(_PARTS, lens, strict=True):
            size = n * np.dtype(kind).itemsize
            setattr(self, k, raw[at : at + size].view(kind))
            at += size + -size % 8

    def look_up(self, words: list[bytes]) -> list[np.ndarray | None]:
        """The ids of each word, None where the automaton doesn't accept it. All words walk in step."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        text, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lens) - lens
        alive = np.flatnonzero(lens > 0) if len(self.keys) else np.zeros(0, np.int64)
        accepted = np.zeros(len(words), bool)
        for step in range(int(lens.max(initial=0))):
            if not len(alive):
                break
            key = state[alive] * 256 + text[start[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.to[arc]
            number[alive] += self.add[arc]
            ended = lens[alive] == step + 1
            done = alive[ended]
            accepted[done] = self.final[state[done]]
            alive = alive[~ended]
        return [self.ids[self.at[k] : self.at[k + 1]] if ok else None for ok, k in zip(accepted.tolist(), number.tolist(), strict=True)]


def frequent_words(docs: DataFrame, tokenizer_json: str, size: int = LEXICON, least: int = LEAST) -> list[str]:
    """The `size` most frequent words of all rows; ties by the word. Each task sends the words it met `least` times or more, which
    may miss words that are rare everywhere: those are merged exactly instead."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        vocabulary, seen = Vocabulary(tokenizer_json), Counter()

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for chunk, n in seen.items():
                for w in vocabulary.words.findall(chunk) if isinstance(chunk, str) else ():
                    words[w] += n
            kept = [(w, n) for w, n in words.items() if n >= least and len(w) <= 64]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(vocabulary.chunks(text or ""))
            if len(seen) > 4 * _HELD:
                yield flush()
        yield flush()

    counts = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def share_lexicon(docs: DataFrame, tokenizer_json: str, size: int = LEXICON) -> str:
    """Compile the corpus's frequent words and hand the file to every executor; its name there is returned."""
    vocabulary = Vocabulary(tokenizer_json)
    entries = [(w.encode(), vocabulary.merge(w)) for w in frequent_words(docs, tokenizer_json, size)]
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="redpen-lexicon-"), name)
    save_lexicon(compile_lexicon(entries), path)
    docs.sparkSession.sparkContext.addFile(path)
    return name


class Coder:
    """Encodes and decodes texts in a task."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon, self.held = vocabulary, lexicon, {}
        self.tokens = [vocabulary.token.get(i, "") for i in range(max(vocabulary.token) + 1)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.vocabulary.chunks(t) for t in texts]
        if len(self.held) > _HELD:
            self.held.clear()
        held = self.held
        new = {c for chunks in split for c in chunks if c not in held}
        parts = {c: self.vocabulary.words.findall(c) for c in new if isinstance(c, str)}
        words = list({w for p in parts.values() for w in p})
        known = {}
        for w, ids in zip(words, self.lexicon.look_up([w.encode("utf-8", "surrogatepass") for w in words]), strict=True):
            known[w] = (np.array(self.vocabulary.merge(w), "<u4") if ids is None else ids.astype("<u4")).tobytes()
        for c in new:
            held[c] = b"".join([known[w] for w in parts[c]]) if isinstance(c, str) else struct.pack("<I", c)
        return [b"".join([held[c] for c in chunks]) for chunks in split]

    def decode(self, ids: bytes) -> str:
        """The token strings joined by spaces (the tokenizer has no decoder of its own)."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_HELD_CODERS: dict[tuple[int, str], Coder] = {}


def _coder(tokenizer_json: str, name: str) -> Coder:
    """The worker's coder: tasks that follow in one worker use its vocabulary and known strings again."""
    key = (hash(tokenizer_json), name)
    if key not in _HELD_CODERS:
        _HELD_CODERS.clear()
        _HELD_CODERS[key] = Coder(Vocabulary(tokenizer_json), Lexicon(SparkFiles.get(name)))
    return _HELD_CODERS[key]


def encode_decode(docs: DataFrame, tokenizer_path: str, size: int = LEXICON, keep: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; with keep also ids (binary) and decoded.

    Null and empty texts have no tokens. Extra columns are ignored; repeated rows are each encoded; an empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    name = share_lexicon(docs, tokenizer_json, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redpen.llm.bpe import _coder  # the module's own, which outlives the task

        coder = _coder(tokenizer_json, name)
        for batch in batches:
            out: list[tuple] = []
            for ids in coder.encode_all([t or "" for t in batch.column("text").to_pylist()]):
                decoded = coder.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                out.append((*row, ids, decoded) if keep else row)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()][: 5 if keep else 3]
            cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols) + 1])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids binary, decoded string" if keep else ""))
