"""Main text of HTML pages by site template removal.

Each page is parsed once into elements; every element's subtree (tags and
text) is hashed.  Spark counts, per host, on how many different pages a
subtree occurs; one that recurs on many is part of the site's template and is
deleted.  What a page itself marks as no article (nav, footer, aside, form,
script; classes such as ad, sidebar, comments) goes too, and if it marks an
article or main element, the text is taken from there and that element's
content is never taken for template: a site may repeat a passage in its
articles.

Copies of a whole page count once, so a page that is stored many times does
not become a template.  Hosts are split by subtree and page before counting,
so a hot host is no hot task.

Null html gives an empty text; markup that is cut off or badly nested is read
as far as it goes: from the first tag that never ends (its quotes or bracket
stay open) on, tags end at the next bracket.  Time is linear in the page.
Repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewops.llm.common import row_key, written

#: A subtree is template if it is on MIN_PAGES pages of the host and on MIN_SHARE of them, or on MANY_PAGES whatever the size of the host.
MIN_PAGES, MIN_SHARE, MANY_PAGES = 5, 0.1, 50

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|[^<]+|<", re.S)
#: The same after a tag that never ends: tags hold no brackets, whatever their quotes say.
PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|[^<]+|<", re.S)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z0-9]+")
#: A tag's start, which is text where the tag never ends.
STARTS = re.compile(r"</?[a-zA-Z]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
                  "tfoot th thead title tr ul".split())
#: Elements that end an open element of the same group when they start.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"},
        "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section main body div".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head script style noscript template iframe object svg math canvas audio video nav footer aside form button select "
                    "optgroup option textarea input menu dialog title".split())
MARKED = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies "
                   "consent gdpr notice notices alert sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer "
                   "comment comments respond disqus share sharing social related recommended newsletter subscribe signup popup modal "
                   "overlay pagination pager toolbar complementary contentinfo search login".split())
#: Words that say nothing beside a mark: ``ad-slot`` and ``site-footer`` are marks, ``related-work`` and ``search-results`` are not.
NEUTRAL = frozenset("a an and area article articles aside bar block blocks body bottom box button buttons center column container content "
                    "desktop entry fixed float footer form global group header heading holder icon icons inline inner item items js large layout "
                    "left link links list main media message middle mobile module my outer page panel post posts primary right row "
                    "secondary section sections site slot small social sticky stories story strip text the thread title top unit widget wrap wrapper zone".split())

#: Marks of lists of other texts, which may be articles themselves.
LISTED = frozenset("comment comments respond disqus related recommended sidebar sidebars".split())


def marked_words(attrs: str) -> frozenset:
    """Words of class, id and role values: of a joined name (``ad-slot``) only if each part is a mark, neutral or holds a digit."""
    out: set[str] = set()
    for m in ATTR.finditer(attrs):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = WORDS.findall(name.replace("sign-up", "signup"))
            if all(p in MARKED or p in NEUTRAL or not p.isalpha() for p in parts):
                out.update(parts)
    return frozenset(out)


class Page:
    """Elements (parent, tag, marks, subtree hash) and text pieces of a page in order; without hashes where no template is known."""

    def __init__(self, html: str, hashed: bool = True):
        self.hashed = hashed
        self.parent, self.tag, self.marks = [-1], ["#page"], [frozenset()]
        self.pieces: list[tuple[int, str | None]] = []       # (element, text), or (element, None) where a block begins or ends
        self.inner: list[list[bytes]] = [[]]
        self.hash: list[bytes] = [b""]
        self.stack = [0]
        self.opened: Counter[str] = Counter({"#page": 1})    # open elements by tag
        self._read(html)
        while self.stack:
            self._pop()

    def _open(self, tag: str, attrs: str) -> None:
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        self.marks.append(marked_words(attrs) if attrs else frozenset())
        self.opened[tag] += 1
        self.inner.append([])
        self.hash.append(b"")
        self.stack.append(len(self.tag) - 1)

    def _pop(self) -> None:
        e = self.stack.pop()
        self.opened[self.tag[e]] -= 1
        if not self.hashed:
            return
        self.hash[e] = hashlib.blake2b(b"\0".join([self.tag[e].encode(), *self.inner[e]]), digest_size=8).digest()
        if self.stack and self.inner[e]:
            self.inner[self.stack[-1]].append(b"\1" + self.hash[e])

    def _end(self, tags: set[str], scope: frozenset = frozenset()) -> None:
        """Close the nearest open element among ``tags``, unless one of ``scope`` is nearer."""
        if not any(self.opened[t] for t in tags):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[at]]
            if t in tags:
                while len(self.stack) > at:
                    self._pop()
                return
            if t in scope:
                return

    def _text(self, raw: str) -> None:
        text = htmllib.unescape(raw)
        self.pieces.append((self.stack[-1], text))
        if self.hashed and (flat := " ".join(text.split())):
            self.inner[self.stack[-1]].append(flat.encode("utf-8", "surrogatepass"))

    def _read(self, html: str) -> None:
        at, token = 0, TOKEN
        while m := token.match(html, at):
            if token is TOKEN and m[0] == "<" and STARTS.match(html, at):
                token = PLAIN
                continue
            at = m.end()
            tag = m[2]
            if not tag:
                if m[0][0] != "<" or m[0] == "<":
                    self._text(m[0])
                continue
            tag = tag.lower()
            if m[1]:
                if tag in BLOCK:
                    self.pieces.append((self.stack[-1], None))
                if tag == "br":
                    self._text(" ")
                self._end({tag})
                continue
            if tag in BLOCK:
                self.pieces.append((self.stack[-1], None))
                self._end({"p"}, SCOPE)
            if tag in ENDS:
                self._end(ENDS[tag], SCOPE)
            if tag in VOID:
                if tag == "br":
                    self._text(" ")
                continue
            self._open(tag, m[3])
            if m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
                self._pop()
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^<>]*>?", re.I).search(html, at)
                inside = html[at:close.start() if close else len(html)]
                self._text(inside)
                at = close.end() if close else len(html)
                self._pop()

    def judged(self) -> tuple[list[bool], list[bool], list[bool]]:
        """Per element: dropped by the page's own marks, inside the article, around an article."""
        n = len(self.tag)
        headed = [False] * n
        for e in range(n - 1, 0, -1):
            if self.tag[e] in HEADINGS or headed[e]:
                headed[self.parent[e]] = True
        root = [self.tag[e] in ("article", "main") or (self.tag[e] not in ("body", "html") and "main" in self.marks[e] and "content" in self.marks[e])
                for e in range(n)]
        drop, inside, around = [False] * n, [False] * n, [False] * n
        holds = [False] * n      # a vague mark on what holds the article is no reason to drop the article
        for e in range(n - 1, 0, -1):
            if (holds[e] or root[e]) and not self.marks[e] & LISTED:
                holds[self.parent[e]] = True
        for e in range(1, n):
            up, tag = self.parent[e], self.tag[e]
            own = tag in DROPPED
            if tag == "article":
                own = bool(self.marks[e] & LISTED)
            elif tag == "header" or ("header" in self.marks[e] and tag not in HEADINGS):
                own = not (inside[up] and headed[e]) and not holds[e]
            elif tag not in ("html", "body", "main") and tag not in HEADINGS and not root[e]:
                own = own or bool(self.marks[e] & (LISTED if holds[e] else MARKED))
            drop[e] = drop[up] or own
            inside[e] = not drop[e] and (inside[up] or root[e])
        for e in range(n - 1, 0, -1):
            if (inside[e] and root[e]) or around[e]:
                around[self.parent[e]] = True
        return drop, inside, around

    def text(self, template: frozenset = frozenset()) -> str:
        """Blocks of the main text, one line each."""
        drop, inside, _ = self.judged()
        rooted = any(inside)
        gone = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            gone[e] = gone[self.parent[e]] or drop[e] or (not inside[e] and self.hash[e] in template)
        out, line = [], []
        for e, text in [*self.pieces, (0, None)]:
            if text is None:
                if flat := SPACE.sub(" ", "".join(line)).strip():
                    out.append(flat)
                line = []
            elif not gone[e] and (inside[e] or not rooted):
                line.append(text)
        return "\n".join(out)

    def subtrees(self) -> list[tuple[bytes, bool]]:
        """(hash, whether it decides anything) of the subtrees with text outside the article and not around it."""
        drop, inside, around = self.judged()
        rooted = any(inside)
        return list({self.hash[e]: (self.hash[e], not rooted and not drop[e]) for e in range(1, len(self.tag))
                     if self.inner[e] and not inside[e] and not around[e] and self.tag[e] not in ("html", "body", "head", "title")}.values())


def _subtrees(batches):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for pk, host, html in zip(*(batch.column(c).to_pylist() for c in ("pk", "host", "html")), strict=True):
            page = Page(html or "")
            rows += [(pk, host, page.hash[0], h, o) for h, o in page.subtrees()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.bool_()))],
                                         names=["pk", "host", "page", "subtree", "open"])


def _extracted(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [Page(h or "", bool(t)).text(frozenset(t or ())) for h, t in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^/?#]*?://([^/?#]*)", 1))


def templates(units: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many: int = MANY_PAGES) -> DataFrame:
    """(host, subtree) on many different pages of the host."""
    pages = units.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    seen = units.select("host", "subtree", "page").distinct().groupBy("host", "subtree").agg(F.count("*").alias("on")).filter(F.col("on") >= min_pages)
    return seen.join(pages, "host").filter((F.col("on") >= F.col("pages") * min_share) | (F.col("on") >= many)).select("host", "subtree")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
              min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text for every row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    keyed = rows.withColumn("pk", row_key(F.col("page_id"), F.col("url"), F.col("html")))
    units = written(keyed.select("pk", host_of(F.col("url")).alias("host"), "html")
                    .mapInArrow(_subtrees, "pk binary, host string, page binary, subtree binary, open boolean"), "subtrees")
    site = written(templates(units, min_pages, min_share), "templates")
    hits = written(units.filter("open").join(site, ["host", "subtree"]).groupBy("pk").agg(F.collect_set("subtree").alias("template")), "hits")
    return (keyed.join(hits, "pk", "left").select("page_id", "url", "html", "template")
            .mapInArrow(_extracted, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string"))
