"""Exact top-k, filter audit and clustering against brute force, with the edge cases that their docstrings define."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from redpen.llm import audit, drift, maxscore

VECTORS = "vec_id long, embedding array<float>, label int, v int"


def _floor(row, scale):
    return [max(min(math.floor(scale * float(np.float32(x))), drift.LONGEST), -drift.LONGEST - 1) for x in row]


def _fine(row):
    return row is not None and all(x is not None and math.isfinite(np.float32(x)) for x in row)


def _top(rows, k, every, scale=64):
    kept = sorted({(i, tuple(_floor(v, scale))) for i, v in rows if i is not None and _fine(v)})
    out = []
    for q in kept:
        if q[0] % every == 0:
            scores = [(-max(min(sum(a * b for a, b in zip(q[1], c[1], strict=False)), drift.LONGEST), -drift.LONGEST - 1), c[0]) for c in kept if c != q]
            out += [(q[0], r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], VECTORS)


def _answers(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_top_k_equals_brute_force(spark):
    """Copies in numbers, ties, missing and odd components, lengths that differ, repeated rows and ids, several shards and rounds."""
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(300)]
    hot = [rng.gauss(0, 0.2) for _ in range(16)]
    rows += [(300 + i, hot) for i in range(150)]
    rows += [(500, None), (505, []), (510, [0.1, None]), (515, [float("nan")] * 16), (520, [float("inf")]), (None, hot), (525, [0.5] * 3), (530, [0.0] * 40)]
    rows += rows[:10] + [(0, hot), (5, [-x for x in hot])]
    want = _top(rows, 7, 5)
    for shard, growth in ((16_384, 16), (40, 2), (40, 16)):
        assert _answers(maxscore.top_k(_vectors(spark, rows), 7, 5, shard=shard, growth=growth)) == want


def test_top_k_of_large_numbers_and_little_data(spark):
    big = [(0, [3e30, 1.0]), (5, [-3e30, 2.0]), (10, [3e10, 3e10]), (11, [1e16, -1e16]), (12, [2e6, 2e6])]
    assert _answers(maxscore.top_k(_vectors(spark, big), 3, 5)) == _top(big, 3, 5)
    assert _answers(maxscore.top_k(_vectors(spark, [(0, [1.0])]), 3, 5)) == []
    assert _answers(maxscore.top_k(_vectors(spark, [(1, [1.0]), (2, [1.0])]), 3, 5)) == []
    assert maxscore.top_k(_vectors(spark, [])).count() == 0


def test_threshold_leaves_most_values_untouched():
    """Clusters: with the threshold of earlier shards non-essential terms are probed for few vectors; results stay exact."""
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 8, (20, 64))
    lists = np.floor(middle[rng.integers(0, 20, 3000)] + rng.normal(0, 2, (3000, 64))).astype(np.int64)
    weights, ids, counted = lists[::300], np.arange(3000), {}
    exact = weights @ lists.T
    least = np.sort(exact, 1)[:, -21]
    for q, found, scores in maxscore.search(weights, least, np.ascontiguousarray(lists.T), ids, 21, counted):
        order = np.lexsort((ids, -exact[q]))[:21]
        assert set(found.tolist()) == set(order.tolist()) and scores.tolist() == exact[q][found].tolist()
    spared = counted["all"] - counted["traversed"]
    assert spared > 0.2 * counted["all"] and counted["probed"] < 0.4 * spared


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _audit(docs, labels):
    parts, shapley = {}, {}
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    for d, text, lang in docs:
        text = text or ""
        words = WORD.findall(text)
        copy = d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in docs)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), bool(re.search("[#$%&*|]", text)), copy)
        failing = {f for f, x in zip(audit.FILTERS, fails, strict=True) if x}
        part = parts.setdefault(lang or "", {})
        for order in audit.ORDERS:
            gone = False
            for s, f in enumerate(order):
                row = part.setdefault((order, s + 1), [0] * 6)
                here, redundant = f in failing and not gone, f in failing and gone
                gone = gone or here
                for k, x in enumerate((not gone, here, redundant, failing == {f}, here and d in good, here and d in toxic)):
                    row[k] += x
                shapley[lang or "", f] = shapley.get((lang or "", f), 0) + here
    return {(p, o, s, *row, shapley[p, o[s - 1]]) for p, cells in parts.items() for (o, s), row in cells.items()}


def test_audit_equals_brute_force(spark):
    """Copies, repeated rows and ids, nulls anywhere, empty and long texts, repeated and dangling labels, further columns."""
    rng = random.Random(3)
    texts = ["", None, "A" * 50, " ".join(str(i) for i in range(250)), "x " * 300, "word " * 100 + "#", " ".join(f"Tér{i}" for i in range(5000)), "ONE\x0btwo three"]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(120)] + [(3, texts[3], "en"), (3, texts[4], "en"), (None, texts[3], "en"), (None, texts[3], "fr")]
    docs += docs[:3]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, lang string, mask int, part int")
    w = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, good string")
    got = [tuple(r[c] for c in ("part", "filter_order", "step", *audit.MEASURES, "shapley")) for r in audit.audit(d.repartition(9), w).collect()]
    assert len(got) == len(set(got)) == 600 * 4 and set(got) == _audit(docs, labels)
    assert audit.audit(d.limit(0), w).count() == 0
    assert audit.audit(d, w.limit(0)).count() == 2400


def test_wide_counters_hold_counts_of_any_table():
    total = ((1 << 63) - 1) * audit.wide(0b10001, True, False) + audit.wide(0, False, False) * 0
    counts = audit._unpacked(total)
    assert counts.max() == (1 << 63) - 1 and counts.min() == 0 and counts.shape == (6, 120, 5)


def _lloyd(rows, k, rounds, scale=1024, dims=64):
    kept = [(i, _floor(v, scale)) for i, v in rows if _fine(v) and len(v) == dims]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    mids = [list(v) for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        at = [min(range(len(mids)), key=lambda c: (far(v, mids[c]), c)) for _, v in kept]
        if turn < rounds:
            for c in range(len(mids)):
                mine = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
                if mine:
                    mids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    cap = lambda n: min(n, drift.LONGEST)
    gaps = [cap(far(v, mids[a])) for (_, v), a in zip(kept, at, strict=True)]
    of = lambda c: cap(sum(g for g, a in zip(gaps, at, strict=True) if a == c))
    return sorted(((i, a, g, of(a), cap(sum(gaps)), hashlib.sha256(",".join(map(str, mids[a])).encode()).hexdigest()) for (i, _), a, g in zip(kept, at, gaps, strict=True)), key=repr)


def _clusters(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=repr)


def test_clusters_equal_brute_force(spark):
    """Copies (empty centroids, ties), repeated and null ids, vectors left out, further columns."""
    rng = random.Random(4)
    mids = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.15) for x in rng.choice(mids)]) for i in range(400)] + [(400 + i, mids[0]) for i in range(150)]
    rows += [(600, None), (601, [0.1] * 7), (602, [None] * 8), (603, [float("nan")] * 8), (604, [float("-inf")] * 8), (None, mids[1]), (None, mids[2])] + rows[:5]
    want = _lloyd(rows, 6, 10, dims=8)
    for geometric in (True, False):
        assert _clusters(drift.clustered(_vectors(spark, rows).repartition(5), 6, 10, dims=8, geometric=geometric)) == want


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.5, 0.1])], [(1, [1e30, 0.0]), (2, [-1e30, 5.0]), (3, [1e12, 1e12]), (4, [3e5, 1.0])]])
def test_clusters_of_few_and_large_vectors(spark, rows):
    assert _clusters(drift.clustered(_vectors(spark, rows), 3, 4, dims=2)) == _lloyd(rows, 3, 4, dims=2)


def test_geometry_bounds_the_loss():
    """Vectors near and far, in few and many dimensions, small and large moves; bounds that are exact or loose."""
    rng = np.random.default_rng(5)
    away = lambda x, c: np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
    gained = 0
    for turn in range(300):
        dims = int(rng.choice([2, 3, 9, 40]))
        old = rng.normal(0, 10, (6, dims))
        new = old + rng.normal(0, rng.choice([0.1, 3, 12, 40]), (6, dims)) * rng.integers(0, 2, (6, 1))
        x = rng.normal(0, rng.choice([1, 10, 30]), (200, dims)) + (old[rng.integers(0, 6, 200)] if turn % 2 else 0)
        before = away(x, old)
        cluster = before.argmin(1)
        upper = before.min(1) * rng.uniform(1, rng.choice([1.0001, 1.5]), 200)
        lower = before * rng.uniform(rng.choice([0.5, 0.9999]), 1, before.shape)
        less = drift.loosening(old, new, cluster, upper, lower)
        moved = np.sqrt(((new - old) ** 2).sum(1))[None]
        assert (less <= moved + 1e-9).all() and (before - away(x, new) <= less + 1e-9).all()
        gained += (less < 0.9 * moved).mean()
    assert gained / 300 > 0.1


def test_geometry_spares_measuring_in_clustered_vectors():
    """Blocks assigned round after round: the same clusters as with the full drift, at least a fifth fewer vectors measured against all centroids."""
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 130, (16, 64))[rng.integers(0, 16, 4000)] + rng.normal(0, 60, (4000, 64))).astype(np.int32)
    scans, found = {}, {}
    for geometric in (True, False):
        mids, before, state, scans[geometric] = x[:8].astype(np.int64), None, None, 0
        for turn in range(11):
            *state, scanned, _ = drift._assigned(x, mids, state, before, geometric)
            assert (state[0] == drift._squares(x, mids).argmin(1)).all()
            scans[geometric] += scanned if turn else 0
            before, mids = mids, np.array([x[state[0] == c].sum(0) // (state[0] == c).sum() if (state[0] == c).any() else mids[c] for c in range(8)])
        found[geometric] = mids
    assert (found[True] == found[False]).all() and scans[True] < 0.8 * scans[False]


def test_geometry_measures_fewer_given_vectors(spark):
    """The given vectors have no clusters, so the gain is small, but there is one."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    seen = {g: [] for g in (True, False)}
    for geometric in seen:
        drift.clustered(df, geometric=geometric, seen=seen[geometric]).count()
    assert sum(s[1] for s in seen[True]) < sum(s[1] for s in seen[False])
