"""The operators for training data against brute force, round trips and held-out labels; odd inputs."""

import collections
import hashlib
import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from redpen.llm import base, bpe, bwt, chat, components, decontaminate, html, licenses, quality, simhash, suffixes, textvec, toxicity, warc
from redpen.llm.queries import QUERIES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=True):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("fp", "key", "row", "kept", "n", "a", "b")}) if extra else df


ODD = [None, "", " \n\t ", "a", "word " * 40, "Ünï çode ‘x’ 中文 🙂 \x0b\x1c ", "same text here again", "same text here again", "x" * 5000, "ab " * 30000]


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_every_query_runs(spark, data):
    for name, f in QUERIES.items():
        assert f(spark, data).count() > 0 or name in ("op7_license_scan", "op8_benchmark_decontamination"), name


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (quality.quality(docs, labels), toxicity.toxicity(docs, labels), licenses.scan(docs), decontaminate.contaminated(docs, bench), bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json")), simhash.near_duplicates(docs), suffixes.dedup(docs), html.main_text(pages), warc.archive(pages), chat.format_chats(chats)):
        assert df.count() == 0


# HTML


def test_html_blocks():
    page = '<html><head><title>t</title></head><body><nav>menu</nav><header>Site</header><div class="cookie-notice">we use</div><article class="post"><header><h1>T &amp; x</h1></header><p>a  b<b>c</b>d<br>e<p>para &lt;two&gt;<ul><li>x<li>y</ul><div class=ad>buy</div><div id="comments"><p>hi</p></div><form>q</form></article><aside>s</aside><footer>f</footer><script>if(a<b){"</p>"}</script></body></html>'
    assert html.Page(page).text(set()) == "T & x\n\na bcd e\n\npara <two>\n\nx\n\ny"
    assert html.Page('plain <b>te</b>xt &nbsp; x<p>y').text(set()) == "plain text x\n\ny"
    for broken in ("<p a='x", "<!-- never closed", "<", "</p></b>", "<script>x", "<b>" * 5000 + "deep"):
        html.Page(broken).text(set())


def test_html_template_subtrees(spark):
    rows = [(i, "http://h.example/" + str(i), f"<body><div class='box'><span>Our paper</span> since 1900</div><div><p>story {i} is told</p></div></body>") for i in range(8)]
    rows += [(100, None, None), (101, "", ""), (102, "http://h.example/1", rows[1][2])]
    got = {r["page_id"]: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "story 3 is told" and got[102]["text"] == "story 1 is told"
    assert got[100]["text"] == "" and got[101]["n_chars"] == 0 and len(got) == 11


def _planted_pages():
    """(rows, article blocks of each page, template blocks): two hosts whose templates have plain names, with copies and near copies of one
    article on a third of the pages; half of the pages mark their article."""
    rnd = random.Random(3)
    said = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    rows, own, planted = [], {}, {}
    for host in ("one.example", "two.example"):
        top, legal, follow, side = said(9), said(14), said(11), [said(3) for _ in range(4)]
        copied = [said(40) for _ in range(6)]
        for k in range(60):
            blocks = [said(rnd.randint(8, 60)) for _ in range(5)]
            if k % 3 == 0:
                blocks = [*copied[:2], said(40) if k % 2 else copied[2], *copied[3:]]
            body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:-1]) + f"<div class='q7'>{follow}</div><p>{blocks[-1]}</p>"
            body = f"<article>{body}</article>" if k % 4 < 2 else f"<div class='z1'>{body}</div>"
            items = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in side)
            page = len(rows)
            rows.append((page, f"https://{host}/{k}", f"<body><div class='x{k % 2}'><b>{top}</b></div><ul>{items}</ul>{body}<div class='y'><p>{legal}</p></div></body>"))
            own[page], planted[page] = blocks, [top, legal, follow, *side]
    return rows, own, planted


def test_html_templates_decide(spark):
    rows, own, planted = _planted_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "template": F.lit("clash"), "text": F.lit("clash")})
    got = {r["page_id"]: r["text"].split("\n\n") for r in html.main_text(pages).collect()}
    without = {r["page_id"]: r["text"].split("\n\n") for r in html.main_text(pages, least=10**6).collect()}
    held = lambda blocks: sum(b in blocks[i] for i in planted for b in planted[i])
    assert held(got) <= 0.1 * held(without) and held(without) > 400  # recall of the templates
    assert [b for i in own for b in own[i] if b not in got[i]] == []  # precision: no block of an article is lost
    assert sum(got[i] == own[i] for i in own) >= 0.9 * len(own)


def test_html_malformed_pages_in_linear_time():
    for shape in ("<p", "<", '<a b="', "<a b='>", '<a b=">" ', "<div><b>", "<td><b><h1>", "<!--", "<script>", "<i><div><b>", '<div class="ad ', '<x"'):
        for tail in ("", ">", "</div></i>" * 1000):
            began = time.perf_counter()
            page = html.Page(shape * ((1 << 18) // len(shape)) + tail)
            page.subtrees(), page.key(), page.text({1})
            assert time.perf_counter() - began < 10, shape


def test_html_class_words():
    for name, gone in (("content ad-free", False), ("text-menu", False), ("social-policy", False), ("cookie-notice", True), ("siteFooter", True), ("ad_slot_3", True), ("post-comments", True)):
        assert html.Page(f"<div class='{name}'>x y</div><p>z</p>").text(set()) == ("z" if gone else "x y\n\nz"), name
    assert html.Page("<form><h1>T</h1><p>x</p><input><button>go</button></form>").text(set()) == "T\n\nx"
    assert html.Page("<p>x</p><form><p>Your name</p><input></form>").text(set()) == "x"


# Chat


def test_chat_round_trip_and_rewriting(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>\n<\\|x"), (1, 0, "user", "a"), (2, 0, "a\n\\n<|", None), (2, 1, "assistant", "<\\|<|<\\\\|<<|"), (None, 0, "assistant", "z"), (3, 0, None, "q"), (3, 0, None, "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_chats(df, keep=True).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256("user\na\nassistant\nb<|im_end|>\n<\\|x\n".encode()).hexdigest()
    assert got[2]["loss_sha256"] == hashlib.sha256("<\\|<|<\\\\|<<|".encode()).hexdigest() and got[2]["loss_chars"] == 12
    assert got[3]["n_turns"] == 2 and got[None]["loss_chars"] == 1
    a, b = got[1]["loss_spans"][0]
    assert chat.unescape(got[1]["formatted"][a:b]) == "b<|im_end|>\n<\\|x"
    rewriting = lambda turns: "".join(t for r, t in turns if r != "system" or len(turns) < 2)
    assert chat.render([("system", "s"), ("user", "u")], rewriting).rewrites_at == 1


# WARC


def test_warc_rejects_magic_in_payloads(spark):
    fake = "x" * 600 + "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nHTTP/1.1 200 OK\r\n\r\nab" + "y" * 600
    rows = [(1, "http://a/é", fake), (2, None, None), (3, "u\r\nWARC-Type: x", fake), (4, "z", "WARC/1.1\r\n"), (5, "z", "WARC/1.1\r\nWARC/1.1\r\n" * 300), (6, "q", "short"), (7, "q", "short")]
    rows += [(100 + i, "u", f"{i} " * 700) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in ("2k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = {r["page_id"]: tuple(r)[1:] for r in warc.archive(pages, file_records=20).collect()}
        for i, _, t in rows:
            b = (t or "").encode()
            to = 3 if i == 1 else None
            assert got[i] == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if to else "response", to)
        assert len(got) == len(rows)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_chain_stops_at_damage():
    assert warc.chain(np.array([0, 10, 15, 30]), np.array([10, 30, 99, 40])).tolist() == [True, True, False, True]
    assert warc.chain(np.array([5, 10]), np.array([10, 20])).tolist() == [False, False]


# Suffix array


def _repeats(texts, n):
    seen = collections.Counter(t[k : k + n] for t in texts for k in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), len(t) - len(kept), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_transform_against_brute_force():
    rnd = random.Random(5)
    for n in (2, 3, 5, 8, 20):
        base = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))).encode() for _ in range(4)]
        texts = [rnd.choice(base)[rnd.randint(0, 5) :] + rnd.choice(base) for _ in range(8)]
        weights = np.array([rnd.choice([1.0, 1.0, 2.0]) for _ in texts])
        count = collections.Counter()
        for t, w in zip(texts, weights, strict=True):
            for k in range(len(t) - n + 1):
                count[t[k : k + n]] += w
        want = [[bool(count[t[k : k + n]] >= 2) for k in range(len(t) - n + 1)] for t in texts]
        assert [f.tolist() for f in bwt.repeated_starts(texts, weights, n)] == want


@pytest.mark.parametrize("most", [suffixes.DEALT, 3, 1])
def test_dedup_against_brute_force(spark, most):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    shared = " ".join(rnd.choice(words) for _ in range(30))
    texts = [*ODD[:8], "x" * 3000, "ab" * 900]
    for _ in range(25):
        own = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 60))) for _ in range(2)]
        texts.append(own[0] + shared[rnd.randint(0, 20) :] + own[1])
    texts += [texts[-1], texts[-2]]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.dedup(docs_of(spark, texts), 60, 24, most).collect()}
    want = _repeats([(t or "").encode() for t in texts], 60)
    assert [got[i] for i in range(len(texts))] == want


def test_dedup_repeated_rows(spark):
    df = docs_of(spark, ["long text number one " * 3])
    got = suffixes.dedup(df.union(df), 20, 8).collect()
    assert len(got) == 2 and all(r["n_removed"] == r["n_bytes"] for r in got)


# Quality


def test_quality_counts(spark):
    texts = [*ODD, "a b c a b c\n\na b c a b c\n#$x|\n \n \n", "é é é é\r\né é é é\r\n"]
    got = {r["doc_id"]: r for r in quality.measure(docs_of(spark, texts), np.zeros(16)).collect()}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeat = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in (t or "").encode().split(b"\n"):
            dup += bool(line.split()) and line in seen
            seen.add(line)
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), dup, len(repeat))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_quality_keeps_clean_documents(spark, folder):
    """On a third of the labels that neither the fit nor the threshold has seen, by language."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 2
    rows = quality.quality(docs, labels.filter(~third), carry=("lang",)).join(labels.filter(third), "doc_id").filter("not base_failed").groupBy("quality", "lang").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    for r in rows:
        assert r["kept"] >= 0.95 if r["quality"] == 1 else r["kept"] <= 0.05, r


def test_quality_verdict_against_brute_force(spark):
    rnd = random.Random(8)
    good = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(90)]
    junk = [" ".join(rnd.choice(("x1|", "$$9", "zz%")) + str(rnd.randint(0, 99)) for _ in range(60)) for _ in range(10)]
    docs = docs_of(spark, good + junk)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    left = {r["doc_id"] for r in quality.trusted_sample(labels).filter("left_out").collect()}
    texts = [t.encode() for t in good + junk]
    bucket = lambda g: int(textvec.mix(np.array([int.from_bytes(g, "big")], np.uint64))[0]) % quality.BUCKETS
    grams = [[bucket(t[k : k + 4]) for k in range(len(t) - 3)] for t in texts]
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, g in enumerate(grams):
        np.add.at(raw, g, 1)
        if i < 90 and i not in left:
            np.add.at(target, g, 1)
    llr = [float(np.mean((np.log(target / target.sum()) - np.log(raw / raw.sum()))[g])) for g in grams]
    threshold = sorted(llr[i] for i in left)[int(0.01 * len(left))] - quality.MARGIN
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert len(left) >= quality.CALIBRATED
    for i, x in enumerate(llr):
        assert abs(got[i]["llr"] - x) < 1e-9 and got[i]["kept"] == (x >= threshold and not got[i]["base_failed"])


def test_quality_takes_every_trusted_text(spark):
    """The fit and the threshold are those of all labelled texts, of which there are more than 20,000 here."""
    n, rnd = 21_500, random.Random(3)
    words = [a + b + c for a in "abcd" for b in "abcd" for c in "xyz"]
    texts = [" ".join(rnd.choices(words, k=50)) for _ in range(n)] + ["zz yy " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    left = {r[0] for r in labels.filter(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0).select("doc_id").collect()}
    counts = [collections.Counter(t[k : k + 4] for k in range(len(t) - 3)) for t in texts]
    every = list(set().union(*counts))
    values = np.array([int.from_bytes(g.encode(), "big") for g in every], np.uint64)
    bucket = dict(zip(every, (textvec.mix(values) % np.uint64(quality.BUCKETS)).tolist(), strict=True))
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, c in enumerate(counts):
        for g, k in c.items():
            raw[bucket[g]] += k
            if i < n and i not in left:
                target[bucket[g]] += k
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    for i, c in enumerate(counts):
        assert abs(got[i]["llr"] - sum(ratio[bucket[g]] * k for g, k in c.items()) / sum(c.values())) < 1e-9
    scores = sorted(got[i]["llr"] for i in left if not got[i]["base_failed"])
    want = scores[int(quality.LEAST_SHARE * len(scores))] - quality.MARGIN if len(scores) >= quality.CALIBRATED else quality.THRESHOLD
    known = quality.trusted_texts(docs, labels)
    assert known.count() == n and quality.calibrated(known.filter("left_out"), ratio) == pytest.approx(want, abs=1e-9)
    assert len(scores) > 6_000
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= want) or abs(r["llr"] - want) < 1e-9 for r in got.values())


def test_pipeline_keeps_what_late_labels_trust(spark, tmp_path):
    """Texts of a kind that only labels beyond the first 20,000 (by hash) trust are kept: the pipeline's fit covers them."""
    import corpus_pipeline as p

    rnd = random.Random(4)
    words = {late: [a + b + c for a in letters for b in letters for c in "xyz"] for late, letters in ((False, "abcd"), (True, "klmn"))}
    ids = [r[0] for r in spark.range(21_500).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, " ".join(rnd.choices(words[k >= 20_000], k=50)), "en", "s", 0) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    spark.range(21_500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    late, measured = set(ids[20_000:]), quality.measure(docs, np.zeros(16))
    want = {r[0] for r in measured.filter("not base_failed").select("doc_id").collect()} & late
    got = {r[0] for r in p.quality_rules(spark, docs, str(tmp_path)).select("doc_id").collect()} & late
    assert len(want) > 1_000 and len(got) >= 0.98 * len(want)


# Toxicity


def test_restoring(spark):
    docs = docs_of(spark, ["you are an idiot and a moron " * 50, "the worthless clown and the stupid loser " * 50])
    r = toxicity.Restorer(toxicity.char_model(docs))
    for said, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("c l o w n", "clown"), ("stuuuupid", "stupid"), ("w0rthl3ss", "worthless"), ("l.o.s.e.r", "loser"), ("plain words", "plain words"), ("m0r0n!", "moron!"), ('"1d10t.', '"idiot.'), ("!diot", "idiot"), ("c  l 0 w   n.", "clown."), ("wow!", "wow!")):
        assert r.restore(said) == meant


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit / max(1, sum(r["predicted"] for r in rows)) > 0.95 and hit / sum(r["toxic"] for r in rows) > 0.9


def test_toxicity_odd_inputs(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs_of(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    again = toxicity.toxicity(docs_of(spark, ODD).union(docs_of(spark, ODD)), labels).collect()
    assert len(again) == 2 * len(ODD)
    sample = toxicity.labelled_sample(docs_of(spark, ODD).union(docs_of(spark, ODD)), labels).count()
    assert sample == labels.filter(~toxicity.held_out("doc_id")).count()


# Licenses


def test_licenses(spark):
    mit = licenses.TEMPLATES[3][1]
    near = mit.replace("granted", "given", 1)
    texts = ["w " * 50 + "Released under the MIT License. " + "z " * 20, "Licensed under the\nApache License, Version 2.0.", "a " * 33 + near + " b" * 40, "a license to released software", None, ""]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert got[(0, "MIT")] == 1.0 and got[(1, "Apache-2.0")] == 1.0 and 0.8 <= got[(2, "MIT")] < 1 and len(got) == 3


# Decontamination


def test_reparameterised_questions(spark):
    bench = spark.createDataFrame([(1, "A train leaves the old town at 9 km per hour and then meets Anna after 9 days on the way home"), (2, "few words"), (3, None)], "item_id long, text string")
    same = "Intro text. A train leaves the old town at 25 km per hour and then meets Boris after 25 days on the way home. End."
    other = "Intro text. A train leaves the old town at 25 km per hour and then meets Boris after 31 days on the way home. End."
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, [same, other, "nothing here at all to see", None, ""]), bench).collect()}
    assert got == {(0, 1)}


def test_reparameterised_items_are_found(spark):
    """Word problems with planted leaks: other names (of one or two words, at a sentence's beginning too), numbers, units and an inserted word."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(3, 8)))
    names = ["Anna", "Boris", "Clara Weiss", "Dmitri", "Eva Maria Stone", "Farid"]
    units = ["km", "kg", "hours", "miles"]
    shapes = [[word() for _ in range(24)] for _ in range(40)]

    def told(shape, name, a, b, unit, extra=False):
        w = [*shape[:6], a, unit, *shape[6:14], *(["really"] if extra else []), b, unit, *shape[14:]]
        return f"{name} {' '.join(w)}. {name} {' '.join(shape[:5])} {a} {unit}"

    bench = spark.createDataFrame([(k, told(s, names[0], "3", "14", "km")) for k, s in enumerate(shapes)], "item_id long, text string")
    texts, want = [], set()
    for k, s in enumerate(shapes):
        around = [" ".join(word() for _ in range(30)) + ". " for _ in range(2)]
        leak = told(s, rnd.choice(names[1:]), str(rnd.randint(20, 99)), str(rnd.randint(100, 999)), rnd.choice(units), k % 4 == 0)
        texts.append(around[0] + leak + ". " + around[1])
        want.add((k, k))
    texts += [" ".join(word() for _ in range(60)) for _ in range(40)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_short_items_and_contradictions(spark):
    bench = spark.createDataFrame([(1, "few words"), (2, "Add 3 and 4"), (3, "7 8 9 10 11 12"), (4, "one two three four five 6 seven eight nine 6 ten eleven twelve 6 more words")], "item_id long, text string")
    texts = ["there are few words here", "Add 5 and 4", "please add 3 and 4 now", "7 8 9 10 11 12", "1 2 3 4 5 6", "one two three four five 8 seven eight nine 8 ten eleven twelve 8 more words", "one two three four five 8 seven eight nine 5 ten eleven twelve 7 more words"] * 2
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {(i + k, j) for i, j in ((0, 1), (2, 2), (3, 3), (5, 4)) for k in (0, 7)}


def test_leaks_against_brute_force(spark):
    """Every pair of sf0.01, from the windows of both texts without Spark, filter or join."""
    folder = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))

    def windows(text):
        t = decontaminate.Template([text.encode()])
        out = collections.defaultdict(list)
        for names in (False, True):
            for at, key, filled, values in zip(*t.windows(names=names), strict=True):
                out[int(key)].append((int(at), values[filled].tolist()))
        return out, max(1, len(t.windows()[0]))

    items = {r["item_id"]: windows(r["text"]) for r in bench.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = set()
    for d, text in texts.items():
        own, _ = windows(text or "")
        for i, (theirs, n) in items.items():
            matches = [(a, b, x, y) for key in own.keys() & theirs.keys() for a, x in theirs[key] for b, y in own[key]]
            if matches and decontaminate.consistent(matches)[0] >= decontaminate.CONTAINED * n:
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and {(d, i) for d, t in texts.items() for i, x in ((r["item_id"], r["text"]) for r in bench.collect()) if x in (t or "")} <= got


# BPE


def test_bpe_equals_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rnd = random.Random(2)
    alphabet = "aAbZéÉßſΣσςİıñ'’\"  \n\t\x0b\x1c\x85\xa0　-–—_09½Ⅷ٣中文あ🙂👍🏽<|endoftext|>startof#$%"
    texts = [*ODD, "<|endoftext|>abc<|startoftext|> it's we'LL", *("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(300))]
    for size in (3, 1000):
        got = {r["doc_id"]: r for r in bpe.encode_decode(docs_of(spark, texts), path, size, keep=True).collect()}
        for i, t in enumerate(texts):
            ids = lib.encode(t or "", add_special_tokens=False).ids
            assert list(np.frombuffer(got[i]["ids"], "<u4")) == ids
            assert got[i]["decoded"] == lib.decode(ids, skip_special_tokens=False) and got[i]["n_tokens"] == len(ids)


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = [b"tap", b"taps", b"top", b"tops", b"stop", b"stops", "é".encode()]
    arrays = bpe.compile_lexicon([(w, [k, k + 1]) for k, w in enumerate(words)])
    assert len(arrays["final"]) <= 9
    bpe.save_lexicon(arrays, str(tmp_path / "x"))
    found = bpe.Lexicon(str(tmp_path / "x")).look_up([*words, b"to", b"", b"stopss"])
    assert [list(x) if x is not None else None for x in found] == [[k, k + 1] for k in range(7)] + [None] * 3


# SimHash


def _fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark):
    rnd = random.Random(4)
    words = [str(k) for k in range(40)]
    base = [rnd.choice(words) for _ in range(300)]
    texts = list(ODD)
    for k in range(120):
        own = list(base)
        own[rnd.randrange(300)] = rnd.choice(words)
        texts.append(" ".join(own))
    for docs in (docs_of(spark, texts), docs_of(spark, texts).union(docs_of(spark, texts))):
        rows = simhash.near_duplicates(docs).collect()
        got = {r["doc_id"]: r for r in rows}
        assert len(rows) in (len(texts), 2 * len(texts))
        fps = [_fingerprint(t or "") for t in texts]
        assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{x:016x}" for x in fps]
        root = list(range(len(texts)))
        for _ in range(len(texts)):
            changed = False
            for i, x in enumerate(fps):
                for j, y in enumerate(fps[:i]):
                    if bin(x ^ y).count("1") <= 2 and root[i] != root[j]:
                        root[i] = root[j] = min(root[i], root[j])
                        changed = True
            if not changed:
                break
        assert [got[i]["component_id"] for i in range(len(texts))] == root


def test_links_in_a_hot_bucket(spark):
    """Fingerprints that all share two segments, and many of them close together."""
    rnd = random.Random(6)
    base = rnd.getrandbits(64)
    fps = {base}
    while len(fps) < 700:
        x = rnd.choice(sorted(fps)[:50]) if rnd.random() < 0.7 else base
        for _ in range(rnd.randint(1, 4)):
            x ^= 1 << rnd.randrange(26, 64)
        fps.add(x)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {tuple(sorted((signed(x), signed(y)))) for k, x in enumerate(fps) for y in fps[:k] if bin(x ^ y).count("1") <= 2}
    got = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want

    # candidates are the pairs that keep the budget of every chain of up to four segments from some segment on; only they meet the full check
    masks = [((1 << w) - 1) << sum(simhash.WIDTHS[:k]) for k, w in enumerate(simhash.WIDTHS)]

    def kept(x, y):
        parts = [bin((x ^ y) & m).count("1") for m in masks]
        return any(all(sum(parts[(i + k) % 5] for k in range(n)) <= 2 * n // 5 for n in range(1, 5)) for i in range(5))

    tried = {(r["a"], r["b"]) for r in simhash.candidates(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    assert tried == {tuple(sorted((signed(x), signed(y)))) for k, x in enumerate(fps) for y in fps[:k] if kept(x, y)}
    assert want < tried and len(tried) < len(fps) * (len(fps) - 1) / 2 / 20


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 1), (3, 1), *((k, k + 1) for k in range(100, 140))], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {k: 100 for k in range(100, 141)}


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in p.STAGES][0] == "quality rules" and len(p.STAGES) == 5
    kept = p.quality_rules(spark, docs, folder)
    assert kept.columns == p.COLUMNS
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in quality.quality(docs, labels).filter("kept").select("doc_id").collect()}
    single = p.simhash_near_dedup(spark, kept, folder)
    assert {r[0] for r in single.select("doc_id").collect()} == {r[0] for r in simhash.near_duplicates(kept).select("component_id").collect()}
    short = p.suffix_array_dedup(spark, single, folder)
    assert short.columns == p.COLUMNS and short.count() == single.count()
    clean = p.benchmark_decontamination(spark, short, folder)
    leaks = {r[0] for r in decontaminate.contaminated(short, bench).select("doc_id").collect()}
    assert {r[0] for r in clean.select("doc_id").collect()} == {r[0] for r in short.select("doc_id").collect()} - leaks
    assert p.bpe_encoding(spark, clean, folder).count() == clean.count()


def test_pipeline_removes_passages_and_spares_the_rest(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.01"
    docs = p.quality_rules(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).cache()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in p.suffix_array_dedup(spark, docs, folder).collect()}
    windows = lambda t: {tuple(w[k : k + 51]) for w in [t.split()] for k in range(len(w) - 50)}
    stands = collections.Counter(w for t in before.values() for w in windows(t))
    shared = {w for w, n in stands.items() if n > 1}
    left = collections.Counter(w for t in after.values() for w in windows(t))
    assert len(shared) > 1000 and not shared & set(left)
    # brute force at the stage's length: what has no repeated string of that length stays as it is
    ids = list(before)
    want = _repeats([before[i].encode() for i in ids], p.PASSAGE_BYTES)
    for i, w in zip(ids, want, strict=True):
        cut = len(before[i].encode()) - len(after[i].encode()) - w[1]  # a character that loses a byte goes as a whole
        assert 0 <= cut <= 6 * w[2] and (w[1] > 0 or before[i] == after[i])


def test_pipeline_stages_on_odd_rows(spark, data):
    import corpus_pipeline as p

    # the labels describe the given documents, so a trusted one keeps its id here and the odd ones get ids without a label
    good = spark.read.parquet(f"{data}/documents.parquet").join(spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1"), "doc_id")
    one, clean = tuple(good.filter(F.size(F.split("text", " ")) > 100).orderBy("doc_id").select("doc_id", "text").first())
    rows = [(1_000_000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, clean, "en", "s", 1), (one, clean, None, "s", None), (one, clean, None, "s", None), (2_000_000, clean + " end", "en", None, 5)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("fp", "row", "kept", "spans", "component_id", "key")})
    ids = lambda df: sorted(r["doc_id"] for r in df.collect() if r["doc_id"] is not None)
    good_rows = p.quality_rules(spark, docs, data)
    assert ids(good_rows) == [one, one, 2_000_000] and good_rows.count() == 4
    single = p.simhash_near_dedup(spark, docs, data)
    # of equal texts the row without doc_id comes first
    assert single.columns == p.COLUMNS and one not in ids(single) and single.filter("doc_id is null").count() == 1 and 1_000_006 in ids(single) and 1_000_007 not in ids(single)
    near = bin(_fingerprint(clean) ^ _fingerprint(clean + " end")).count("1") <= simhash.MAX_BITS
    assert (2_000_000 in ids(single)) == (not near)
    short = p.suffix_array_dedup(spark, docs, data)
    assert short.count() == len(rows) and short.columns == p.COLUMNS
    assert p.benchmark_decontamination(spark, docs, data).count() == len(rows)
    assert p.bpe_encoding(spark, docs, data).count() == len(rows)
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0


def test_the_whole_pipeline(spark):
    """run() gives what its stages give one after another: every row once, nothing that an earlier stage left out."""
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in p.STAGES:
        docs = base.written(stage(spark, docs, folder), "stage")
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    rows = [tuple(r[c] for c in sorted(docs.columns)) for r in p.run(spark, folder).collect()]
    assert sorted(rows) == sorted(tuple(r[c] for c in sorted(docs.columns)) for r in docs.collect())
    assert all(a >= b for a, b in zip(left, left[1:], strict=False)) and len(rows) == len(left[-1]) > 50
