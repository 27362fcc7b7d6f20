"""Main text of web pages by site template removal.

Every element's subtree is hashed; Spark counts on how many different pages of its host it stands. What
stands on LEAST_PAGES of them or more, and on LEAST_SHARE of the host's pages, belongs to the site and is
deleted from articles too. A host's template is no larger than a page's subtrees over that share.

Pages are told apart by a MinHash of their longest block, so copies and near copies of a page count
as one, and what they have in common is not taken for the site's, however many copies there are.

Lists of element kinds and class words assist: they delete what never is article text (menus, forms,
scripts, ...) and differs from page to page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.base import BROADCAST_ROWS, small_batches, written

#: Different pages, and share of the host's pages, from which a subtree belongs to the site.
LEAST_PAGES, LEAST_SHARE = 4, 0.5
#: Elements open at once; deeper ones are taken as flat (their text stays), as browsers do.
DEPTH = 256

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_STOP = re.compile("[\"'>]")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")

# Fixed values of HTML: element kinds.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("script style textarea title xmp iframe noembed noframes noscript head template nav footer aside button select option input svg canvas dialog menu object audio video map".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt li td th tr tbody thead table ul ol dl figure figcaption".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
_LISTS = frozenset("ul ol dl table select".split())

# Words in class, id or role that mark what isn't article text, and words that may stand beside them in a name.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar widget widgets nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription comment comments commentlist respond disqus reply replies "
    "share sharing social related recommended recommendations login signup search searchform pagination pager copyright complementary contentinfo dialog".split()
)
_COMMENT_MARKS = frozenset("comment comments commentlist respond disqus reply replies".split())
_BESIDE = frozenset(
    "box block blocks wrap wrapper container area region section list bar item items inner outer top bottom left right upper lower main site page post posts entry article articles header head "
    "links link button buttons slot unit form panel column col row group holder primary secondary global mobile desktop sticky fixed small large media icons icon by the of js my".split()
)
_PAGE = frozenset("html body article main".split())


def _marked(names: str, marks: frozenset) -> bool:
    """Whether one of the names is made of mark words, and of words beside them (`cookie-notice`, `siteFooter`, but not `ad-free` or `text-menu`)."""
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if parts and any(p in marks for p in parts) and (parts[0] in marks or parts[-1] in marks) and all(p in _MARKS or p in _BESIDE or p.isdigit() for p in parts):
            return True
    return False


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Page:
    """One parsed page: pieces of text (None is a block's end) and its elements in the order of their closing.

    Parsing takes time in proportion to the page, whatever its markup is like: no place is looked at again
    for every tag, and at most DEPTH elements are open."""

    def __init__(self, html: str):
        self.pieces: list[str | None] = []
        #: (first piece, end piece, subtree hash or 0 where it can't belong to a template, tag, is never article text)
        self.elements: list[tuple[int, int, int, str, bool]] = []
        self._longest = ""
        self._open: list[list] = []
        self._named: Counter = Counter()  # open elements by tag
        self._inline: list[Counter] = [Counter()]  # open inline elements by tag, for each open block
        self._deep: Counter = Counter()
        self._articles = self._heads = self._nevers = 0
        self._parse(html)
        while self._open:
            self._close()

    def _parse(self, html: str) -> None:
        at, n, last, quoting = 0, len(html), html.rfind(">"), True
        ends = {q: html.rfind(q) for q in "\"'"}
        while at < n:
            start = html.find("<", at)
            if start < 0:
                start = n
            if start > at:
                self._text(html[at:start])
            if start == n:
                return
            if html.startswith("<!--", start):
                stop = html.find("-->", start + 2)
                at = n if stop < 0 else stop + 3
                continue
            if start > last:  # no tag can end any more
                self._text(html[start:])
                return
            close = html.startswith("/", start + 1)
            name = _TAG_NAME.match(html, start + 1 + close)
            if not (name or html[start + 1 : start + 2] in ("!", "?", "/")):
                self._text("<")  # no tag
                at = start + 1
                continue
            if not name or close:
                at = html.find(">", start) + 1
                if name:
                    self._end(name[0].lower())
                continue
            stop = name.end()
            while quoting:
                m = _TAG_STOP.search(html, stop)
                if not m or (m[0] != ">" and ends[m[0]] <= m.start()):
                    quoting = False  # all that follows stands in quotes: from here on a tag ends at its first bracket
                elif m[0] == ">":
                    stop = m.start()
                    break
                else:
                    stop = m.end() if html[m.start() - 1] not in "= \t\r\n\f" else html.find(m[0], m.end()) + 1
            if not quoting:
                stop = html.find(">", name.end())
            tag, at = name[0].lower(), stop + 1
            self._start(tag, html[name.end() : stop])
            if tag in _RAW and self._open and self._open[-1][0] == tag:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                if tag not in _NEVER:
                    self._text(html[at : end.start() if end else n])
                at = end.start() if end else n

    def _text(self, text: str) -> None:
        if self._open:
            self._open[-1][3].append(" ".join(text.split()))
        self.pieces.append(unescape(text))

    def _start(self, tag: str, attrs: str) -> None:
        if tag in _ENDS_P:
            self._end_within("p", _LISTS | {"td", "th", "li", "article", "section", "div", "body"})
        if tag in _SIBLINGS:
            for other in _SIBLINGS[tag]:
                self._end_within(other, _LISTS)
        if tag not in _INLINE:
            self.pieces.append(None)
        elif tag == "br":
            self.pieces.append(" ")
        if tag in _VOID:
            return
        if len(self._open) >= DEPTH:
            self._deep[tag] += 1
            return
        known = {k.lower(): next((x for x in v if x), "") for k, *v in _ATTR.findall(attrs)} if attrs.strip() else {}
        never = tag in _NEVER or "hidden" in known or known.get("aria-hidden") == "true" or bool(_HIDDEN_STYLE.search(known.get("style", "")))
        if tag == "header" and not self._articles:
            never = True
        # a form and what a name marks go unless they hold the page's article or title
        soft = tag == "form" or (not never and tag not in ("html", "body", "main") and _marked(" ".join(known.get(k, "") for k in ("class", "id", "role")), _COMMENT_MARKS if tag == "article" else _MARKS))
        main = (tag == "article" or tag == "main" or known.get("role") == "main") and not soft
        self._heads += main or tag == "h1"
        self._open.append([tag, len(self.pieces), never, [], main, soft, self._heads - (main or tag == "h1")])
        self._articles += main
        self._nevers += never or (soft and tag != "form")
        self._named[tag] += 1
        if tag in _INLINE:
            self._inline[-1][tag] += 1
        else:
            self._inline.append(Counter())

    def _end(self, tag: str) -> None:
        """Close the innermost open element of this name; an inline one doesn't reach out of its block."""
        if self._deep[tag]:
            self._deep[tag] -= 1
            if tag not in _INLINE:
                self.pieces.append(None)
            return
        if not (self._inline[-1] if tag in _INLINE else self._named)[tag]:
            if tag in ("br", "p"):
                self.pieces.append(None if tag == "p" else " ")
            return
        while self._open[-1][0] != tag:
            self._close()
        self._close()

    def _end_within(self, tag: str, walls: frozenset | set) -> None:
        if not self._named[tag]:
            return
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                while len(self._open) > k:
                    self._close()
                return
            if self._open[k][0] in walls:
                return

    def _close(self) -> None:
        tag, first, never, parts, main, soft, heads = self._open.pop()
        self._named[tag] -= 1
        self._articles -= main
        self._nevers -= never or (soft and tag != "form")
        if tag in _INLINE:
            self._inline[-1][tag] -= 1
        else:
            self._inline.pop()
            self.pieces.append(None)
        never = never or (soft and self._heads == heads)
        value = _digest("\x00".join([tag, *parts])) if any(parts) else 0  # names vary (`active`)
        counts = value and not never and not self._nevers and tag not in _PAGE and tag not in _INLINE
        self.elements.append((first, len(self.pieces), value if counts else 0, "main" if main and tag != "article" else tag, never))
        if self._open and value:
            self._open[-1][3].append(f"\x01{value}")
        if tag not in _INLINE and not never and not self._nevers:
            own = " ".join([p for p in parts if p and p[0] != "\x01"])
            if len(own) > len(self._longest):
                self._longest = own

    def subtrees(self) -> set[int]:
        """Hashes of what can belong to a template: blocks with text, but no page roots and nothing that goes anyway."""
        return {h for _, _, h, _, _ in self.elements if h}

    def key(self) -> int:
        """What tells the page from others: the least hash of three words in a row in its longest block."""
        words = self._longest.split(" ")
        return min((_digest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))), default=0)

    def text(self, template: set[int]) -> str:
        """Text of the articles (else of main, else of the body) without what is never article text and without the template."""
        gone = bytearray(len(self.pieces) + 1)
        for first, end, h, _, never in self.elements:
            if never or h in template:
                gone[first:end] = b"\x01" * (end - first)
        kept = None
        for kind in ("article", "main"):
            spans: list[tuple[int, int]] = []
            for first, end in sorted((first, -end) for first, end, _, tag, _ in self.elements if tag == kind and not gone[first]):
                if not spans or first >= spans[-1][1]:  # the outer ones
                    spans.append((first, -end))
            if any(isinstance(p, str) and p.strip() for a, b in spans for k, p in enumerate(self.pieces[a:b], a) if not gone[k]):
                kept = bytearray(len(self.pieces) + 1)
                for a, b in spans:
                    kept[a:b] = b"\x01" * (b - a)
                break
        blocks, now = [], []
        for k, p in enumerate([*self.pieces, None]):
            if p is None:
                if now and (line := " ".join("".join(now).split())):
                    blocks.append(line)
                now = []
            elif not gone[k] and (kept is None or kept[k]):
                now.append(p)
        return "\n\n".join(blocks)


def _host():
    return F.lower(F.coalesce(F.nullif(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")), F.lit("")))


def template_subtrees(pages: DataFrame, least: int = LEAST_PAGES, share: float = LEAST_SHARE) -> DataFrame:
    """(host, subtree) of the subtrees that belong to the host's template.

    Counted are distinct contexts, so copies of a page count once; rows are combined before they are shuffled.
    """
    small_batches(pages.sparkSession)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, digest, t in zip(batch.column("host").to_pylist(), batch.column("digest").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(t or "")
                key = page.key()
                rows += [(host, 0, digest), *((host, h, key) for h in page.subtrees())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["host", "subtree", "page"])

    rows = pages.select(_host().alias("host"), F.xxhash64("html").alias("digest"), "html").mapInArrow(hashes, "host string, subtree long, page long")
    counts = rows.distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    counts = written(counts.filter((F.col("n") >= least) | (F.col("subtree") == 0)), "subtrees")
    total = counts.filter("subtree = 0").select("host", F.col("n").alias("total"))
    return counts.filter(F.col("subtree") != 0).filter(F.col("n") >= least).join(total, "host").filter(F.col("n") >= share * F.col("total")).select("host", "subtree")


def main_text(pages: DataFrame, least: int = LEAST_PAGES, share: float = LEAST_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    Null or empty html has empty text; null urls form one host; repeated rows stay; extra columns are ignored, whatever
    their names; malformed markup is read as far as it goes, in linear time; no rows, no result. Templates go to the pages by broadcast if their rows are counted to be few, else by a
    join on the host, whose large partitions Spark splits.
    """
    found = written(template_subtrees(pages, least, share), "template")
    lists = found.groupBy("host").agg(F.collect_list("subtree").alias("template"))
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = pages.select("page_id", "url", "html", _host().alias("host")).join(F.broadcast(lists) if few else lists, "host", "left").select("page_id", "url", "html", "template")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h).text(set(t or ())) if h else "" for h, t in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
