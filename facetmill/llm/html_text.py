"""Main text of web pages by site-template removal.

Every block element with text, inside an article or not, is hashed as a subtree (tag, class, text, children).  Spark counts
on how many differing pages of its host each subtree stands (pages whose body without noise has equal text, such as copies of one
page, count once).  Subtrees on at least MIN_PAGES differing pages that make up MIN_SHARE of the host's are the site's template and are
deleted, in articles as well; a passage that many articles share but not most of the host's pages stays.  What is noise on any site goes too: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments, by element, role and class name.

The text is that of the articles among what is left, else of the main element, else of the whole body: character
references are decoded, white space inside a block becomes one blank, blocks are joined by one line break.

Pages are parsed twice: once for the hashes, which stay with the page as an array, and once for the text.  Markup is read in
time linear in its length, however broken.  A template that stands on every page of a hot host meets its pages under
SALTS keys.

Defined cases: null or empty html and an empty table give an empty text and an empty result; unclosed and crossing tags are read as far as
possible; pages of any length are read whole; pages without a host count as one site; a subtree on exactly MIN_PAGES and MIN_SHARE of the pages is template; rows that repeat a page_id, or have none, are
extracted each, told apart by url and html; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, broadcast_if_small, materialize, with_row_key

MIN_PAGES, MIN_SHARE = 5, 0.5
MAX_BROADCAST = 200_000
SALTS = 16
EXTRACTED = "page_id long, url string, text string, n_chars long"
HASHED = "__id long, __version long, site long, content long, hashes array<long>"

_OPEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/<>]*)")
_STOP = re.compile(r"""=\s*(["'])|>""")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
# Kinds of elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg xmp".split())
DROPPED = frozenset("head script style title textarea noscript iframe template svg nav aside form footer button select input dialog menu object canvas audio video".split())
BLOCKS = frozenset("html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption section article main header footer nav aside form blockquote pre figure figcaption address fieldset details summary hr".split())
ENDS_P = BLOCKS - {"html", "body"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPANS = frozenset("p b i a span".split())
SCOPES = frozenset("ul ol dl table article section main body html div".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended comment comments disqus respond reply replies pagination pager search skip toolbar widget".split()
)
OWN = frozenset("article entry post content story main body text".split())


@lru_cache(maxsize=64)
def _end_of(tag: str):
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


@lru_cache(maxsize=10_000)
def _named_noise(name: str) -> bool:
    """Whether an element's role, class or id says that it is noise."""
    for part in name.split():
        key, _, value = part.partition("=")
        if key == "hidden" or (key == "role" and value in ROLES):
            return True
        words = set(re.split(r"[^a-z0-9]+", value if key in ("class", "id") else part))
        if words & NOISE and not (words & OWN and not words & {"comment", "comments", "ad", "ads"}):
            return True
    return False


class Page:
    """A page's elements in document order; parents stand before their children."""

    def __init__(self, source: str):
        self.tag, self.name, self.parent, self.items = ["#page"], [""], [-1], [[]]  # items: text, or the number of a child
        self.order: list[tuple[int, str]] = []
        self.source, self.last_end, self.quotes = source, source.rfind(">"), True
        # open elements; for each the place of the open paragraph that a block inside it would end; open elements by tag
        self.stack, self.open_p, self.opened = [0], [0], {}
        at, n = 0, len(source)
        while at < n:
            m = _OPEN.search(source, at)
            if not m:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m[0] == "<!--":
                end = source.find("-->", at)
                at = end + 3 if end >= 0 else n
                continue
            end = self._tag_end(at)
            if end < 0:
                self._text(m[0])
                continue
            inner, at = source[m.end() : end], end + 1
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            if tag in ENDS_P and self.open_p[-1]:
                self._cut(self.open_p[-1])
            if tag in CLOSES:
                while self.stack[-1] and (self.tag[self.stack[-1]] in CLOSES[tag] or self.tag[self.stack[-1]] in SPANS):
                    self._cut(len(self.stack) - 1)
            node = len(self.tag)
            self.tag.append(tag)
            self.name.append(" ".join(f"{a.lower()}={v.strip(chr(34) + chr(39)).lower()}" for a, v in _ATTR.findall(inner)) if inner else "")
            self.parent.append(self.stack[-1])
            self.items.append([])
            self.items[self.stack[-1]].append(node)
            self.order.append((node, ""))
            if tag in RAW:
                shut = _end_of(tag).search(source, at)
                end = source.find(">", shut.end()) if shut else -1
                at = end + 1 if end >= 0 else n
            elif tag not in VOID and not inner.endswith("/"):
                self.open_p.append(len(self.stack) if tag == "p" else 0 if tag in SCOPES else self.open_p[-1])
                self.stack.append(node)
                self.opened[tag] = self.opened.get(tag, 0) + 1

    def _tag_end(self, at: int) -> int:
        """Where the tag ends, quoted values skipped; after one value without an end quotes mean nothing on this page."""
        if at > self.last_end:
            return -1
        while self.quotes:
            m = _STOP.search(self.source, at)
            if not m:
                self.quotes = False
            elif not m[1]:
                return m.start()
            else:
                end = self.source.find(m[1], m.end())
                self.quotes, at = end >= 0, end + 1 if end >= 0 else at
        return self.source.find(">", at)

    def _text(self, text: str) -> None:
        self.items[self.stack[-1]].append(text)
        self.order.append((self.stack[-1], text))

    def _cut(self, place: int) -> None:
        """Close the element at this place of the stack and all inside it."""
        for node in self.stack[place:]:
            self.opened[self.tag[node]] -= 1
        del self.stack[place:], self.open_p[place:]

    def _close(self, tag: str) -> None:
        if self.opened.get(tag):
            place = len(self.stack) - 1
            while self.tag[self.stack[place]] != tag:
                place -= 1
            self._cut(place)

    def inside(self, own) -> list[bool]:
        """For each element, whether it or one above it has the property."""
        out = [False] * len(self.tag)
        for i in range(1, len(out)):
            out[i] = out[self.parent[i]] or own(i)
        return out

    def noise(self, i: int, in_article: bool) -> bool:
        tag = self.tag[i]
        if tag in DROPPED or (tag == "header" and not in_article):
            return True
        return bool(self.name[i]) and tag not in ("html", "body") and _named_noise(self.name[i])

    def hashes(self) -> list[int]:
        """Hash of each subtree, from the leaves up."""
        out = [0] * len(self.tag)
        for i in range(len(out) - 1, -1, -1):
            parts = [f"<{self.tag[i]} {self.name[i]}>"]
            parts += [f"[{out[x]:x}]" if isinstance(x, int) else " ".join(x.split()) for x in self.items[i]]
            out[i] = xxhash.xxh64_intdigest("\x1f".join(p for p in parts if p))
        return out

    def blocks(self) -> list[int]:
        """The elements that can be template, in document order."""
        return [i for i in range(1, len(self.tag)) if self.tag[i] in BLOCKS and self.tag[i] not in ("html", "body")]

    def block_hashes(self) -> list[int]:
        """Subtree hashes of blocks(); 0 for a block without text."""
        h, full = self.hashes(), [False] * len(self.tag)
        for i in range(len(full) - 1, -1, -1):
            full[i] = any(full[x] if isinstance(x, int) else x.strip() for x in self.items[i])
        return [h[i] if full[i] else 0 for i in self.blocks()]

    def roots(self, template) -> list[bool]:
        """Whether each element stands in the main part of what the template (places in blocks()) and noise leave: articles, else the main element, else the body."""
        blocks = self.blocks() if len(template) else []
        dropped = {blocks[k] for k in template}
        article = self.inside(lambda i: self.tag[i] == "article")
        gone = self.inside(lambda i: i in dropped or self.noise(i, article[i]))
        for own in (lambda i: self.tag[i] == "article", lambda i: self.tag[i] == "main" or "role=main" in self.name[i]):
            if any(own(i) and not gone[i] for i in range(1, len(gone))):
                return [r and not g for r, g in zip(self.inside(own), gone)]
        return [not g for g in gone]

    def content(self) -> int:
        """Hash of the whole body's text without noise: pages that differ in it differ."""
        article = self.inside(lambda i: self.tag[i] == "article")
        gone = self.inside(lambda i: self.noise(i, article[i]))
        return xxhash.xxh64_intdigest(" ".join("".join(text or " " for node, text in self.order if not gone[node]).split()))

    def text(self, template=()) -> str:
        keep = self.roots(template)
        blocks: list[list[str]] = [[]]
        block_of = [0] * len(self.tag)
        for i in range(1, len(block_of)):
            block_of[i] = i if self.tag[i] in BLOCKS else block_of[self.parent[i]]
        now = -1
        for node, text in self.order:
            if not keep[node]:
                if self.tag[node] in BLOCKS:  # what stands before and after a deleted block is not one line
                    now = -1
                continue
            if block_of[node] != now or (not text and self.tag[node] in BLOCKS):
                now = block_of[node]
                blocks.append([])
            blocks[-1].append(text or (" " if self.tag[node] in ("br", "td", "th") else ""))
        lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
        return "\n".join(line for line in lines if line)


def host_of(url):
    """Host of a url column: after the first ://, up to / ? # or the end, A-Z lower-cased; '' without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def hash_rows(batches):
    """The page's own hash and those of its blocks, all as of its host; 0 for a block without text."""
    for batch in batches:
        sites, contents, lists = [], [], []
        for host, source in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            page, site = Page(source or ""), xxhash.xxh64_intdigest(host)
            sites.append(site)
            contents.append(page.content())
            lists.append(np.array([h and h ^ site for h in page.block_hashes()], np.uint64).view(np.int64))
        words = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sites, contents)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *words, pa.array(lists, pa.list_(pa.int64()))], names=["__id", "__version", "site", "content", "hashes"])


def text_rows(batches):
    for batch in batches:
        texts = [Page(source).text(template or ()) if source else "" for source, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def site_templates(hashed: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """(__id, __version, template): the places, among each page's blocks, of the subtrees that belong to its site's template."""
    own = F.array_distinct(F.concat(F.array(F.col("site")), F.filter("hashes", lambda h: h != 0)))
    seen = hashed.select("site", "content", F.explode(own).alias("hash")).distinct()  # a frequent subtree is spread by content
    seen = materialize(seen.groupBy("site", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages))
    sizes = seen.where("hash = site").select("site", F.col("n").alias("pages"))
    template = seen.where("hash <> site").join(sizes, "site").where(F.col("n") >= min_share * F.col("pages")).select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    template = broadcast_if_small(materialize(template), MAX_BROADCAST)
    blocks = hashed.select("__id", "__version", F.posexplode("hashes").alias("at", "hash")).where("hash <> 0").withColumn("salt", F.pmod(F.xxhash64("__id", "__version"), F.lit(SALTS)).cast("int"))
    return blocks.join(template, ["hash", "salt"]).groupBy("__id", "__version").agg(F.collect_list("at").alias("template"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    keyed = with_row_key(pages, "page_id", F.xxhash64(F.isnull("url"), "url", F.isnull("html"), "html"))
    hashed = keyed.where("html is not null").select("__id", "__version", host_of(F.col("url")).alias("host"), "html").mapInArrow(hash_rows, HASHED)
    template = site_templates(materialize(hashed), min_pages, min_share)
    joined = keyed.join(template, ["__id", "__version"], "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(text_rows, EXTRACTED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
