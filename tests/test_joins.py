"""Spans, covering spans, dated lookups and near texts against brute force."""

import random
import re

from pyspark.sql import functions as F

from redpen.functions import spans as M
from redpen.operators import asof, intervals, near
from redpen.plans.joins import PATTERNS


def test_match_spans_equal_re(spark):
    texts = ["", None, "no match", "12 and 345 and 6", "7" * 9, "Ada B. Cole met Eve Dunn,\nthen Ada Cole", "a@b.cd" * 3, "x 10 " * 300, "ü 11 é 22"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for kind, pattern in PATTERNS.items():
        got = {r["id"]: r["m"] for r in rows.select("id", M.match_spans(F.col("text"), pattern).alias("m")).collect()}
        for i, t in enumerate(texts):
            want = None if t is None else [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, t)]
            assert (got[i] if got[i] is None else [tuple(m) for m in got[i]]) == want, (kind, t)
    where = rows.filter("id = 3").select(M.around(F.col("text"), F.lit(3), F.lit(6), 4).alias("c")).first()["c"]
    assert where == "12 and 345"


def test_sums_before_each_element(spark):
    for n in (0, 1, 63, 64, 65, 200):
        got = spark.range(1).select(M.running(F.array(*[F.lit(k).cast("long") for k in range(n)]).cast("array<bigint>")).alias("s")).first()["s"]
        assert got == [k * (k - 1) // 2 for k in range(n)]


def _links(rows):
    out = set()
    for part, i, s, e in rows:
        before = sorted(((s2, -e2, i2) for p2, i2, s2, e2 in rows if p2 == part and (s2, -e2, i2) < (s, -e, i)))
        cover = [x[2] for x in before if -x[1] >= e]
        overlap = [x[2] for x in before if s < -x[1] < e]
        out.add((part, i, cover[-1] if cover else None, overlap[-1] if overlap else None))
    return out


def test_links_equal_brute_force_over_block_borders(spark):
    rng = random.Random(5)
    rows = []
    for part, n, room in ((1, 300, 400), (2, 40, 30), (3, 1, 5)):
        for i in range(n):
            s = rng.randrange(room)
            rows.append((part, i, s, s + rng.choice([0, 1, 5, 20, 21, 150])))
    rows += [(4, i, 10, 20) for i in range(200)] + [(4, 1000, 0, 500)]  # a place that everyone shares, under one long span
    df = spark.createDataFrame([*rows, (None, 1, 0, 3), (9, 1, None, 3)], "part long, id long, span_start long, span_end long")
    for blocks in (1, 7, 40):
        got = {(r["part"], r["id"], r["cover_id"], r["overlap_id"]) for r in intervals.linked(df, blocks).collect()}
        assert got == _links(rows), blocks
    assert intervals.linked(df.limit(0)).count() == 0


def _stamp(s):
    return F.timestamp_seconds(s)


def test_as_of_and_in_force(spark):
    rng = random.Random(6)
    day = 86_400
    facts = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(0, 400 * day, 7 * day)])) for i in range(300)] + [(0, 1, 14 * day)] * 2
    terms = [(rng.choice([1, 2, None]), rng.randrange(0, 400) * day, rng.randrange(5)) for _ in range(120)] + [(1, None, 9)]
    f = spark.createDataFrame(facts, "id long, k long, s long").select("id", "k", _stamp("s").alias("t"), "s")
    t = spark.createDataFrame(terms, "k long, s long, v long").select("k", _stamp("s").alias("since"), "v", F.col("s").alias("from_s"), _stamp(F.col("s") + (3 + F.col("v")) * day).alias("until"))
    want = []
    for i, k, s in facts:
        known = [(x[1], x[2]) for x in terms if k is not None and s is not None and x[0] == k and x[1] is not None and x[1] <= s]
        want.append((i, k, s, max(known)[1] if known else None))
    for stretch in (day, 30 * day, 5000 * day):
        got = [(r["id"], r["k"], r["s"], r["v"]) for r in asof.as_of(f, t, "k", "t", "since", ["v"], stretch).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr), stretch
    pairs = sorted((i, x[1], x[2]) for i, k, s in facts for x in terms if None not in (k, s, x[0], x[1]) and x[0] == k and x[1] <= s < x[1] + (3 + x[2]) * day)
    for width in (2 * day, 100 * day):
        assert sorted((r["id"], r["from_s"], r["v"]) for r in asof.in_force(f, t, "k", "t", "since", "until", ["from_s", "v"], width).collect()) == pairs


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abü ") for _ in range(rng.randrange(9))) for _ in range(250)]
    for base in ("The results of the study", "Conclusion and outlook", "aaaaaaaaaa"):
        for _ in range(15):
            t = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = rng.choice(["", "x", "é"])
            texts.append("".join(t))
    df = spark.createDataFrame([(t,) for t in [*texts, *texts[:5], None]], "t string")
    distinct = sorted(set(texts), key=lambda t: (len(t), t))
    for d in (1, 2):
        want = {(a, b, _distance(a, b)) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if len(b) - len(a) <= d and _distance(a, b) <= d}
        got = [tuple(r) for r in near.near_pairs(df, "t", d).collect()]
        assert set(got) == want and len(got) == len(want)
    tried = near.candidates(df, "t", 1).count()
    assert tried < len(distinct) * (len(distinct) - 1) / 2 / 3
