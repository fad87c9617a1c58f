"""Main text of web pages by template deduction from equivalence classes.

A page is a tree of elements, each known by its path (names and first classes from the
root down), and a list of text blocks, each known by its element's path and its words.

1. The occurrence vector of a token, a path or a block, is how often it stands on each
   page of its host; pages with equal texts count once. The vector is kept as a number of
   pages, a number of occurrences and an exclusive-or of page hashes, so it is a partial
   aggregate, and no host's pages meet in a task. Tokens of a host with equal vectors are
   an equivalence class.
2. A class is valid if it holds two tokens at least and stands on ``SHARE`` of the host's
   pages and on ``LEAST`` pages. Valid classes are nested by their paths: an element
   belongs to the template if its path is in a valid class and its parent belongs too.
   The template is the host's frame; its elements that stand once on a page bound the
   slots, and its blocks are boilerplate, inside articles as well.
3. The slot of the main text is sought from the root down: into the element that holds
   most of the text, as measured over all pages of the host where the template knows it,
   else on the page alone. Link text counts for nothing, text in an article or main
   element counts ``FAVOUR`` times. Inside the slot, template blocks go, and so do slots
   that are mostly links over the host; everything else is the text.

Elements that are no text by their purpose (navigation, headers outside articles,
footers, asides, forms, scripts, hidden ones) or by name (:func:`marked`: a class or id
that consists of words such as ad, cookie notice, sidebar, comments) are never in a slot;
a marked element or form around an article is a mere wrapper. A template block stays if
nothing else would be left. Hosts with fewer than ``LEAST`` different pages have no template.

Null html is an empty page, and its text is empty; so is that of a page without text.
url may be null (such pages form a host of their own), page_id may be null or repeated:
every row gives one row. Other columns are ignored, whatever their names. Unclosed
elements end with their parent or the page; time is linear in the length and depth of a
page. An empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ROW, numbered, pinned

#: Share of a host's pages, and number of pages, on which a template token stands at least.
SHARE, LEAST = 0.5, 3
#: Share of the text that an element must hold to be entered, and weight of text in articles.
HOLDS, FAVOUR = 0.7, 3
#: Template tokens that are broadcast at most; beyond, they are joined by host.
BROADCAST_TOKENS = 200_000

# Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea xmp noembed noframes".split())
OUTSIDE = frozenset("head nav header footer aside form button select option label dialog menu menuitem fieldset".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that an opening tag of the same group closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_PARAGRAPH_END = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_PASSED = frozenset("p li dt dd tr td th".split())
# Words that mark an element as no part of the article, and words that may stand beside them in a name.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar "
    "comment comments commentlist disqus replies respond footer header masthead menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login search widget toolbar skip complementary contentinfo".split()
)
BESIDE = frozenset(
    "site page top bottom left right main global box bar block area container wrapper wrap inner outer section list item items slot unit zone panel group link links button buttons icons media form field "
    "post posts entry article articles content text body head title thread count feed latest more reply toggle mobile desktop small large primary secondary user reader form policy".split()
)
OF_ARTICLES = frozenset("article entry post story content".split())

NEVER, PLAIN, ARTICLE = -1, 0, 1

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"[\s ]+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^A-Za-z0-9_-]+")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def marked(name: str, among: frozenset[str] = STRONG) -> bool:
    """Whether one class or id is made of words that mark boilerplate, and of nothing else but words that may stand beside them."""
    words = {x.lower() for x in _NAME.findall(name)}
    found = words & among
    if not found or not words <= STRONG | BESIDE:
        return False
    return found != {"header"} or not words & OF_ARTICLES  # an article's own header holds its title


class Page:
    """Elements in page order (the root is number 0), and blocks as (element, text, characters of it in links)."""

    def __init__(self, page: str):
        self.names, self.parents, self.keys, self.kinds = [""], [-1], [0], [PLAIN]
        self.wrappers: list[int] = []  # elements that are no text unless they are wrapped around an article
        self.blocks: list[tuple[int, str, int]] = []
        self._open = [[0, [], Counter(), 0, 0]]  # element, its open inline elements, their names, how many around are hidden, and links
        self._counts: Counter = Counter()
        self._words: list[str] = []
        self._at, self._linked = 0, 0
        self._read(page)
        self._resolve()

    def _close_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self._words)).strip()
        self._words.clear()
        if text:
            self.blocks.append((self._at, text, min(len(text), self._linked)))
        self._linked = 0

    def _put(self, text: str) -> None:
        element, _, _, hidden, links = self._open[-1]
        if hidden or not text or (not self._words and text.isspace()):
            return
        if not self._words:
            self._at = element
        text = _html.unescape(text)
        self._words.append(text)
        if links:
            self._linked += len(text)

    def _pop(self) -> None:
        self._counts[self.names[self._open.pop()[0]]] -= 1

    def _end(self, name: str) -> None:
        if name in INLINE:
            frame = self._open[-1]
            while frame[2][name]:
                gone, hidden = frame[1].pop()
                frame[2][gone] -= 1
                frame[3] -= hidden
                frame[4] -= gone == "a"
                if gone == name:
                    return
        elif self._counts[name]:
            while self.names[self._open[-1][0]] != name:
                self._pop()
            self._pop()

    def _start(self, name: str, attributes: str) -> None:
        said = {n.lower(): a or b or c for n, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        hidden = "hidden" in said or said.get("aria-hidden") == "true" or "display:none" in said.get("style", "").replace(" ", "").lower()
        classes = said.get("class", "").split()
        among = frozenset(("comment", "comments", "reply", "replies")) if name in ("article", "main") else STRONG
        named = classes + (said.get("role", "").split() + said.get("id", "").split() if name not in HEADINGS else [])
        off = any(marked(x, among) for x in named) if named and name not in ("html", "body") else False
        if name in INLINE:
            frame = self._open[-1]
            frame[1].append((name, hidden or off))
            frame[2][name] += 1
            frame[3] += hidden or off
            frame[4] += name == "a"
            return
        closes = CLOSES.get(name, set()) | ({"p"} if name in _PARAGRAPH_END else set())
        if closes and any(self._counts[x] for x in closes):
            for k in range(len(self._open) - 1, 0, -1):
                own = self.names[self._open[k][0]]
                if own in closes:
                    while len(self._open) > k:
                        self._pop()
                    break
                if own not in _PASSED:
                    break
        parent, _, _, around, links = self._open[-1]
        inside = self.kinds[parent] == ARTICLE
        kind = ARTICLE if name in ("article", "main") and not off or inside else PLAIN
        number = len(self.names)
        if hidden or self.kinds[parent] == NEVER or (name in OUTSIDE and name != "form" and not (name == "header" and inside)) or (off and name in ("article", "main")):
            kind = NEVER
        elif off or name == "form":
            self.wrappers.append(number)
        self.names.append(name)
        self.parents.append(parent)
        self.keys.append(xxhash.xxh3_64_intdigest(f"{name} {''.join(_NAME.findall(classes[0])) if classes else ''}", self.keys[parent]))
        self.kinds.append(kind)
        self._counts[name] += 1
        self._open.append([number, [], Counter(), around, links])

    def _read(self, page: str) -> None:
        at = 0
        while found := _TOKEN.search(page, at):
            self._put(page[at : found.start()])
            at = found.end()
            if not found[2]:
                continue
            name = found[2].lower()
            if name == "br":
                self._put(" ")
                continue
            if name not in INLINE and name not in RAW:  # what is left out as a whole parts no block
                self._close_block()
            if found[1]:
                self._end(name)
            elif name in RAW:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            elif name not in VOID:
                self._start(name, found[3])
        self._put(page[at:])
        self._close_block()

    def _resolve(self) -> None:
        """Take marked elements and forms out of the text, but for those around an article; and note where each element ends."""
        n = len(self.names)
        self.ends = [k + 1 for k in range(n)]
        holds = [self.names[k] in ("article", "main") and self.kinds[k] == ARTICLE for k in range(n)]
        for k in range(n - 1, 0, -1):
            up = self.parents[k]
            self.ends[up] = max(self.ends[up], self.ends[k])
            holds[up] = holds[up] or holds[k]
        for k in self.wrappers:
            if not holds[k]:
                self.kinds[k] = NEVER
        for k in range(1, n):
            if self.kinds[self.parents[k]] == NEVER:
                self.kinds[k] = NEVER

    def sums(self, blocks: list[tuple[int, str, int]]) -> tuple[list[int], list[int]]:
        """Characters of plain text and of links in each element, over blocks that may be text."""
        chars, links = [0] * len(self.names), [0] * len(self.names)
        for e, text, linked in blocks:
            if self.kinds[e] != NEVER:
                chars[e] += (len(text) - linked) * (FAVOUR if self.kinds[e] == ARTICLE else 1)
                links[e] += linked
        for k in range(len(self.names) - 1, 0, -1):
            chars[self.parents[k]] += chars[k]
            links[self.parents[k]] += links[k]
        return chars, links

    def text(self, known: set[int], slots: dict[int, tuple[float, float]]) -> list[str]:
        """Blocks of the main text, given the host's template: keys of its blocks, and of its slots their characters of text and of links."""
        usable = [x for x in self.blocks if self.kinds[x[0]] != NEVER]
        if fresh := [x for x in usable if block_key(self.keys[x[0]], x[1]) not in known]:
            usable = fresh
        chars, links = self.sums(usable)
        frame = [True] + [False] * (len(self.names) - 1)
        children: list[list[int]] = [[] for _ in self.names]
        for k in range(1, len(self.names)):
            frame[k] = frame[self.parents[k]] and self.keys[k] in slots
            children[self.parents[k]].append(k)
        weight = [slots[self.keys[k]][0] if frame[k] and k else chars[k] for k in range(len(self.names))]
        headings = [x[0] for x in usable if self.names[x[0]] in ("h1", "h2")]
        at = 0
        while self.names[at] != "article":
            inner = [k for k in children[at] if self.kinds[k] != NEVER and self.names[k] not in HEADINGS | _PASSED]
            best = max(inner, key=lambda k: weight[k], default=None)
            whole = sum(weight[k] for k in children[at] if self.kinds[k] != NEVER)
            if best is None or not weight[best] or not chars[best] or weight[best] < HOLDS * whole:
                break
            lost = any(at <= h < self.ends[at] and not best <= h < self.ends[best] for h in headings)
            if lost and (self.kinds[at] == ARTICLE or self.kinds[best] != ARTICLE):
                break  # a title stands beside the element
            at = best
        gone = set()
        for k in range(at + 1, self.ends[at]):
            if self.parents[k] in gone or (frame[k] and slots[self.keys[k]][1] > slots[self.keys[k]][0]):
                gone.add(k)
        kept = [text for e, text, _ in usable if at <= e < self.ends[at] and e not in gone]
        return kept or [text for e, text, _ in usable if at <= e < self.ends[at]]


def block_key(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text, path) - (1 << 63)


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


_SEEN = "host string, content long, token long, kind int, times long, chars long, links long"


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens of each page: kind 0 the page itself, 1 its blocks, 2 its elements; content tells pages with different texts apart."""
    for batch in batches:
        out = []
        for host, html in zip(batch["host"], batch["html"]):
            page = Page(html)
            texts = [(e, t) for e, t, _ in page.blocks if page.kinds[e] != NEVER]
            content = xxhash.xxh3_64_intdigest("\n".join(t for _, t in texts)) - (1 << 63)
            out.append((host, content, 0, 0, 1, 0, 0))
            for key, n in Counter(block_key(page.keys[e], t) for e, t in texts).items():
                out.append((host, content, key, 1, n, 0, 0))
            chars, links = page.sums(page.blocks)
            last = {key: k for k, key in enumerate(page.keys)}
            for key, n in Counter(page.keys[1:]).items():
                out.append((host, content, key - (1 << 63), 2, n, chars[last[key]], links[last[key]]))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _SEEN.split(", ")])


def templates(rows: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """host, texts (array of block keys) and slots (array of key, chars, links: means over its pages) from rows(host, html)."""
    seen = rows.select("host", "html").mapInPandas(_occurrences, _SEEN)
    # pages with equal texts count once
    once = seen.groupBy("host", "token", "kind", "content").agg(F.max("times").alias("times"), F.max("chars").alias("chars"), F.max("links").alias("links"))
    vector = F.bit_xor(F.xxhash64("content", "times")).alias("vector")
    totals = once.groupBy("host", "token", "kind").agg(F.count("*").alias("pages"), F.sum("times").alias("times"), vector, F.avg("chars").alias("chars"), F.avg("links").alias("links"))
    totals = pinned(totals.where((F.col("pages") >= least) | (F.col("kind") == 0)), "tokens")
    size = totals.where("kind = 0").select("host", F.col("pages").alias("size"))
    common = totals.where("kind > 0").join(size, "host").where((F.col("pages") >= least) & (F.col("pages") >= share * F.col("size")))
    member = F.struct("token", "kind", F.col("times").alias("times"), "chars", "links")
    classes = common.groupBy("host", "pages", "times", "vector").agg(F.collect_list(member).alias("members")).where(F.size("members") > 1)
    every = classes.select("host", "pages", F.explode("members").alias("m"))
    text = F.collect_list(F.when(F.col("m.kind") == 1, F.col("m.token"))).alias("texts")
    slot = F.collect_list(F.when((F.col("m.kind") == 2) & (F.col("m.times") == F.col("pages")), F.struct(F.col("m.token").alias("key"), F.col("m.chars").alias("chars"), F.col("m.links").alias("links")))).alias("slots")
    return every.groupBy("host").agg(text, slot)


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for html, known, slots in zip(batch["html"], batch["texts"], batch["slots"]):
            own = {x["key"] + (1 << 63): (x["chars"], x["links"]) for x in slots} if slots is not None else {}
            out.append("\n".join(Page(html).text(set(known.tolist()) if known is not None else set(), own)))
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": out})


def extract(pages: DataFrame, share: float = SHARE, least: int = LEAST, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """page_id, url and text (blocks joined by line breaks, empty if there are none) of every row of pages."""
    rows = numbered(pages, "page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("host", host_of(F.col("url"))).drop(ROW)
    found = pinned(templates(rows, share, least), "templates")
    held = found.agg(F.sum(F.size("texts") + F.size("slots") + 1)).first()[0] or 0
    # beyond the bound both sides are shuffled by host, and AQE splits a host with many pages
    joined = rows.join(F.broadcast(found) if held <= broadcast_tokens else found, "host", "left").select("page_id", "url", "html", "texts", "slots")
    return joined.mapInPandas(_extracted, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
