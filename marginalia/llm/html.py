"""Main text of web pages by site template removal (operator 2).

Every page is parsed into a tree.  Element subtrees are hashed (tag, class, id,
text and children), and Spark counts on how many different pages of its host each
hash occurs; subtrees that recur on many pages of a host (``MIN_PAGES`` and a share of
the host's pages) are its template and are deleted.  Paragraphs, headings, list items
and inline elements stay wherever they recur, as prose may; inside the article only
marked-up boxes (with a class or id) can be template.  Elements that are never main
text (menus, footers, forms, scripts, adverts, notices, reader comments) go by their
tag, role, or whole class names; but if that leaves no article, the classes of what
stands around articles are the page's layout, and say nothing.

The main text is that of the page's outermost ``article`` and ``main`` elements, with
all that stands in them, else of all that is left of the body.  Character references are decoded, white space
inside a block becomes one space, blocks are joined by newlines in page order.

Null html counts as empty and gives an empty text.  A null or odd url counts as one
host of its own spelling.  Copies of a page count as one page.  Unclosed and stray
tags, cut-off tags and comments are tolerated; nesting of any depth is.  Repeated
rows give a row each; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: A subtree is template if so many pages of its host have it, and this share of them.
MIN_PAGES, MIN_SHARE = 8, 0.005
#: Template hashes (8 bytes each) that may be broadcast; beyond, they meet the pages by a join.
BROADCAST = 1_000_000
OUT = "page_id long, url string, text string, n_chars long"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption".split()) | INLINE
NEVER = frozenset("head nav footer aside form script style noscript iframe noframes template svg math canvas object embed audio video button select option datalist textarea input dialog menu map title xmp".split())
FRAMES = ("article", "main")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: A class or id marks what is no main text if it is made of these words, and maybe of words that say nothing else.
MARKS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promotions banner cookie cookies consent gdpr notice notices notification notifications alert alerts newsletter subscribe subscription sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist commentform respond disqus reply replies share sharing social related recommended recommendations popup modal overlay login signup signin pagination pager toolbar widget widgets".split())
PLAIN = frozenset("bar box block area section wrapper wrap container content list item items inner outer main page site top bottom left right primary secondary global header links link button buttons icons icon post posts article articles reader readers user users thread form slot unit zone panel message text title group row column col small large by this more us the and media".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@functools.lru_cache(maxsize=4096)
def marked(mark: str) -> bool:
    """Whether a class or id (whole tokens, not parts of them) names something that is no main text."""
    for token in mark.split():
        words = [w.lower() for w in _WORDS.findall(token) if not w.isdigit()]
        if any(w in MARKS for w in words) and all(w in MARKS or w in PLAIN for w in words):
            return True
    return False


#: Tags whose start closes open ones of the listed kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
#: Where the search for an element to close ends.
SCOPES = frozenset("table ul ol dl article section div main body html td th li".split())
CLOSE_P = frozenset("p address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|=)*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?<![^\s\"'])(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Page:
    """A parsed page: nodes in page order, each with its parent, and the pieces of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.mark, self.role, self.hidden = ["#root"], [-1], [""], [""], [False]
        self.texts: list[tuple[int, int, str]] = []  # node, block, text
        self.digest: list[int] = [0]
        self._read(source)

    def _read(self, source: str) -> None:
        hashers = [xxhash.xxh64(b"#root")]
        stack, block, at = [0], 0, 0

        def close_top() -> None:
            node = stack.pop()
            self.digest[node] = d = hashers.pop().intdigest()
            hashers[-1].update(d.to_bytes(8, "little"))

        def text(raw: str) -> None:
            if raw:
                self.texts.append((stack[-1], block, raw))
                if words := " ".join(raw.split()):
                    hashers[-1].update(words.encode("utf-8", "replace"))

        pos = 0
        while m := _TOKEN.search(source, pos):
            text(source[at : m.start()])
            at = pos = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:  # an end tag closes what it names, unless a scope stands between
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] == name:
                        while len(stack) > i:
                            close_top()
                        break
                    if self.tag[stack[i]] in ("article", "main", "body", "table") and name in INLINE | {"p", "li"}:
                        break
            else:
                closes = {"p"} if name in CLOSE_P else CLOSES.get(name)
                if closes:
                    for i in range(len(stack) - 1, 0, -1):
                        t = self.tag[stack[i]]
                        if t in closes:
                            while len(stack) > i:
                                close_top()
                            if name not in ("tr", "tbody", "thead"):
                                break
                        elif t in SCOPES:
                            break
                if name == "br":
                    text(" ")
                    continue
                attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m[3])} if m[3] else {}
                node = len(self.tag)
                self.tag.append(name), self.parent.append(stack[-1])
                self.mark.append(" ".join(x for x in (attrs.get("class"), attrs.get("id")) if x))
                self.role.append((attrs.get("role") or "").lower()), self.hidden.append("hidden" in attrs), self.digest.append(0)
                hashers.append(xxhash.xxh64(f"{name}|{self.mark[node]}".encode("utf-8", "replace")))
                stack.append(node)
                if name in VOID or m[3].rstrip().endswith("/"):
                    close_top()
                elif name in RAW:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(source, pos)
                    stop = end.start() if end else len(source)
                    text(source[pos:stop])
                    at = pos = stop
            if name not in INLINE:
                block += 1
        text(source[at:])
        while len(stack) > 1:
            close_top()

    def excluded(self, template: frozenset | set = frozenset(), host: int = 0, spare: frozenset | set = frozenset()) -> tuple[list[bool], list[int]]:
        """Of each node, whether it is no main text, and its outermost article or main element (0: none).

        Marks of the nodes in ``spare`` don't count.
        """
        out, within = [False], [0]
        for n in range(1, len(self.tag)):
            tag, up = self.tag[n], self.parent[n]
            own = within[up]
            framed = tag in FRAMES or self.role[n] == "main"
            box = framed or tag in ("body", "html")
            gone = out[up] or self.hidden[n] or tag in NEVER or self.role[n] in ROLES or (not box and bool(self.mark[n]) and n not in spare and marked(self.mark[n])) or (tag == "header" and not own)
            if not gone and template and not box and n not in spare and self._can_be_template(n, own):
                gone = key_of(host, self.digest[n]) in template
            if not own and not gone and framed:
                own = n
            out.append(gone), within.append(own)
        return out, within

    def _can_be_template(self, n: int, own: int) -> bool:
        return self.tag[n] not in PROSE and (not own or bool(self.mark[n]))

    def candidates(self) -> list[int]:
        """Digests of the subtrees that may be template."""
        _, within = self.excluded()
        return [self.digest[n] for n in range(1, len(self.tag)) if self.tag[n] not in ("html", "body", *FRAMES) and self._can_be_template(n, within[n])]

    def around_frames(self) -> set[int]:
        """The nodes around articles and main elements."""
        out: set[int] = set()
        for n in range(1, len(self.tag)):
            if self.tag[n] in FRAMES or self.role[n] == "main":
                up = self.parent[n]
                while up > 0 and up not in out:
                    out.add(up)
                    up = self.parent[up]
        return out

    def main_text(self, template: frozenset | set = frozenset(), host: int = 0) -> str:
        gone, within = self.excluded(template, host)
        if not any(within) and (around := self.around_frames()):
            gone, within = self.excluded(template, host, around)  # every frame was in something marked: the marks are of the page's layout
        if any(within):
            return self._joined(n_ok=lambda n: not gone[n] and within[n])  # maybe nothing: the frame is there, and empty
        return self._joined(n_ok=lambda n: not gone[n])

    def _joined(self, n_ok) -> str:
        blocks: list[str] = []
        last, parts = None, []
        for node, block, raw in self.texts:
            if not n_ok(node):
                continue
            if block != last and parts:
                blocks.append("".join(parts))
                parts = []
            last = block
            parts.append(raw)
        blocks.append("".join(parts))
        clean = (" ".join((entities.unescape(b) if "&" in b else b).split()) for b in blocks)
        return "\n".join(b for b in clean if b)


def host_of(url: str | None) -> int:
    """A number for the host of a url."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return xxhash.xxh64_intdigest((m[1] if m else url or "").lower().encode("utf-8", "replace"))


def key_of(host: int, digest: int) -> int:
    """A 63-bit name of a subtree on a host."""
    return ((host * 0x9E3779B97F4A7C15 ^ digest) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 1


def _pages(batch):
    cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "html")]
    return zip(*cols, strict=True)


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, key, body): each page's candidate subtrees, and a hash of the whole page; key 0 is the page itself."""

    def run(batches):
        for batch in batches:
            hosts, keys, bodies = [], [], []
            for _, url, html in _pages(batch):
                host, body = host_of(url), xxhash.xxh64_intdigest((html or "").encode("utf-8", "replace")) >> 1
                own = {0, *(key_of(host, d) for d in Page(html or "").candidates())}
                hosts += [host >> 1] * len(own)
                keys += own
                bodies += [body] * len(own)
            yield pa.record_batch([pa.array(hosts, pa.int64()), pa.array(keys, pa.int64()), pa.array(bodies, pa.int64())], names=["host", "key", "body"])

    return C.map_arrow(pages.select("page_id", "url", "html"), run, "host long, key long, body long")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(key): subtrees found on at least ``min_pages`` different pages of one host, and that share of all its pages."""
    counts = subtrees(pages).distinct().groupBy("host", "key").count().where((F.col("count") >= min_pages))
    counts = C.staged(pages.sparkSession, counts, "html-counts")
    of_host = counts.where("key = 0").select("host", F.col("count").alias("pages"))
    return counts.where("key <> 0").join(of_host, "host").where(F.col("count") >= min_share * F.col("pages")).select("key")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, most: int = BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = C.staged(spark, templates(own, min_pages), "html-templates")
    if found.count() <= most:
        shared = spark.sparkContext.broadcast(np.sort(found.toArrow()["key"].to_numpy()))  # at most ``most`` numbers
        keys_of, rows = (lambda _: shared.value), own
    else:
        marked = own.withColumn("page", F.xxhash64("page_id", "url", "html"))
        rows = marked.join(_own_templates(marked, found), "page", "left").select("page_id", "url", "html", "keys")
        keys_of = lambda batch: None

    def run(batches):
        template: set | None = None
        for batch in batches:
            known = keys_of(batch)
            if known is not None and template is None:
                template = set(known.tolist())
            each = [template] * batch.num_rows if known is not None else [set(k or ()) for k in batch.column("keys").to_pylist()]
            texts = [Page(html or "").main_text(t, host_of(url)) for (_, url, html), t in zip(_pages(batch), each, strict=True)]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return C.map_arrow(rows, run, OUT)


def _own_templates(marked: DataFrame, found: DataFrame) -> DataFrame:
    """(page, keys): the template subtrees that each page holds; no list is longer than its page."""

    def run(batches):
        for batch in batches:
            page, keys = [], []
            for p, url, html in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html")), strict=True):
                own = {key_of(host_of(url), d) for d in Page(html or "").candidates()}
                page += [p] * len(own)
                keys += own
            yield pa.record_batch([pa.array(page, pa.int64()), pa.array(keys, pa.int64())], names=["page", "key"])

    held = C.map_arrow(marked.select("page", "url", "html"), run, "page long, key long").distinct()
    return held.join(found, "key").groupBy("page").agg(F.collect_set("key").alias("keys"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))
