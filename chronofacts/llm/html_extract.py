"""HTML extraction: site template removal.

Every element's subtree is hashed (tag, class, id, text and inner hashes), and Spark counts, for each host, in how many
different pages it stands. Pages are told apart by the print of their chief article (the one with the most text, else ``main``): the least hash of
its three-word runs, so copies and near copies of an article count once and what they share stays. A subtree is template and is deleted
- outside articles: on ``LEAST`` such pages at least;
- inside one (``article`` or ``main``): on ``INSIDE`` pages and a share of ``SHARE`` of the host's pages at least. Headings, list items, table cells and
  inline elements stay there, as deleting them breaks up sentences, lists and tables, and the chief article itself stays;
- on pages without article and main: on ``LEAST`` different pages and a share of ``SHARE`` at least; equal pages count once.

What counts can't tell (hosts with few pages, parts that differ from page to page) is told by tag, role or class: menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and styles. The text is what remains of all articles, else of ``main``, else of the body.

Text: character references are decoded, white space inside a block (``br`` too) becomes one space, blocks are joined by a line feed.

Nulls: null html is an empty page, a null url has no host; pages without a host have no site template. Tags may be
unclosed, unopened or nested wrongly; a ``<`` that opens no tag is text; a quote that is never closed is no quote; a tag that never ends hides the rest.
Time and memory grow in proportion to a page's length. Repeated rows are extracted each, and count once. An empty table gives an empty result.

The template's rows are broadcast up to ``BROADCAST`` in all; beyond that, the subtrees of each different page are joined with them by host and
digest, salted, and each page gets its own few digests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, slices, stored
from .urls import host

SHARE = 0.2
LEAST = 3
INSIDE = 10
BROADCAST = 100_000
SALTS = 16

#: Element kinds of the public HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes if it is open, up to a boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr"}, {"table"}), "tfoot": ({"thead", "tbody", "tr"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
P_CLOSERS = BLOCK - frozenset("body html caption dd dt legend li optgroup option tbody td tfoot th thead tr".split())
P_BOUNDARY = frozenset("td th table caption button object html body article section aside div".split())

#: Elements that are no main text. Fixed values.
NOISE_TAGS = frozenset("nav aside footer form button select input textarea script style noscript template iframe head dialog menu svg object embed canvas audio video".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark such elements. Fixed values.
NOISE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion banner banners cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall"
    " sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer copyright"
    " comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations outbrain taboola form login".split()
)
#: Words of a class or id that mark a header, outside articles only.
HEADER_WORDS = frozenset(["header"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements inside an article that may be template.
LOOSE = BLOCK - HEADINGS - frozenset("article main html body hgroup caption figcaption legend summary dd dt li option optgroup tbody td tfoot th thead tr".split())
#: Where a subtree stands, and what its digest is mixed with there.
OUTSIDE, WITHIN, BARE = 0, 1, 2
_MIX = (0, 0x5BD1E9955BD1E995, 0x2545F4914F6CDD1D)

# Possessive, so that no position is read twice. Quotes count behind ``=`` only.
_OPEN = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
BREAK, SPACE = None, " "


@dataclass(slots=True)
class Element:
    tag: str
    attributes: dict[str, str]
    parent: int
    begin: int
    end: int = -1
    digest: int = 0
    size: int = 0


class Page:
    """Elements in document order; ``parts`` are texts and block breaks, and each element covers a range of them."""

    def __init__(self, html: str) -> None:
        from xxhash import xxh64

        self.elements: list[Element] = []
        self.parts: list[str | None] = []
        self._hash, self._open, self._inner = xxh64, [], []
        self._at: dict[str, list[int]] = {}
        self._parse(html)
        self.chief = max((k for tag in ("article", "main") for k in self._best(tag)), key=lambda k: (self.elements[k].tag == "article", self.elements[k].size, -k), default=-1)

    def _best(self, tag: str) -> list[int]:
        return [k for k, e in enumerate(self.elements) if e.tag == tag]

    def _enter(self, tag: str, attributes: str) -> None:
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
        if tag in BLOCK:
            self.parts.append(BREAK)
        self.elements.append(Element(tag, found, self._open[-1] if self._open else -1, len(self.parts)))
        self._at.setdefault(tag, []).append(len(self._open))
        self._open.append(len(self.elements) - 1)
        self._inner.append([f"{tag}\0{found.get('class', '')}\0{found.get('id', '')}"])

    def _leave(self) -> None:
        e, inner = self.elements[self._open.pop()], self._inner.pop()
        self._at[e.tag].pop()
        e.end = len(self.parts)
        e.digest = self._hash("\0".join(inner).encode("utf-8", "surrogatepass")).intdigest() - (1 << 63)
        if self._inner:
            self._inner[-1].append(str(e.digest))
            self.elements[self._open[-1]].size += e.size
        if e.tag in BLOCK:
            self.parts.append(BREAK)

    def _text(self, raw: str) -> None:
        if raw:
            text = unescape(raw)
            self.parts.append(text)
            if self._inner and (shown := " ".join(text.split())):
                self._inner[-1].append(shown)
                self.elements[self._open[-1]].size += len(shown)

    def _last(self, tags: set[str] | frozenset[str]) -> int:
        """Where the innermost open element of these tags stands among the open ones, or -1."""
        return max((at[-1] for tag in tags if (at := self._at.get(tag))), default=-1)

    def _close_down_to(self, tags: set[str] | frozenset[str], boundary: set[str] | frozenset[str]) -> None:
        if (k := self._last(tags)) > self._last(boundary):
            while len(self._open) > k:
                self._leave()

    def _start(self, tag: str, attributes: str, html: str, at: int) -> int:
        """Open an element; where to read on."""
        if tag in P_CLOSERS:
            self._close_down_to({"p"}, P_BOUNDARY)
        if tag in CLOSES:
            self._close_down_to(*CLOSES[tag])
        if tag == "br":
            self.parts.append(SPACE)
        elif tag in VOID:
            if tag == "hr":
                self.parts.append(BREAK)
        elif tag in RAW:
            end = _RAW_END[tag].search(html, at)
            close = html.find(">", end.end()) if end else -1
            return close + 1 if close >= 0 else len(html)
        else:
            self._enter(tag, attributes)
        return at

    def _parse(self, html: str) -> None:
        at = begin = 0  # text begins at ``begin``; ``at`` is where the next tag is looked for
        quotes = True
        while (at := html.find("<", at)) >= 0:
            mark = html[at + 1 : at + 2]
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                behind = end + 3 if end >= 0 else len(html)
            elif mark and mark in "!?":
                behind = html.find(">", at) + 1 or len(html)
            elif not (name := _NAME.match(html, at)):
                at += 1
                continue
            else:
                whole = _OPEN.match(html, at) if quotes and mark != "/" else None
                quotes = quotes and (mark == "/" or whole is not None)  # a tag that never ends by its quotes: from here on none count
                behind = whole.end() if whole else html.find(">", at) + 1 or len(html)
            self._text(html[begin:at])
            tag = name[1].lower() if mark != "!" and mark != "?" else ""
            if mark == "/":
                if self._at.get(tag):
                    while self.elements[self._open[-1]].tag != tag:
                        self._leave()
                    self._leave()
            elif tag and html[behind - 1] == ">":
                behind = self._start(tag, html[name.end() : behind - 1], html, behind)
            at = begin = behind
        self._text(html[begin:])
        while self._open:
            self._leave()

    # What is main text

    def _is_noise(self, e: Element, in_article: bool) -> bool:
        a = e.attributes
        if e.tag in NOISE_TAGS or a.get("role", "").lower() in NOISE_ROLES:
            return True
        if not a:
            return e.tag == "header" and not in_article
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return True
        if e.tag in ("html", "body", "article", "main") and not {"comment", "comments", "reply"} & set(_WORD.findall(a.get("class", "").lower())):
            return False
        if e.tag in HEADINGS:
            return False
        named = set(_WORD.findall(f"{a.get('class', '')} {a.get('id', '')}".lower()))
        return bool(named & NOISE_WORDS) or (not in_article and (e.tag == "header" or bool(named & HEADER_WORDS)))

    def kinds(self) -> list[int]:
        """Where each element stands: ``OUTSIDE`` articles, ``WITHIN`` one or ``BARE`` of any on the page; -1 where it is no candidate for the template: what holds the chief article, and what would break up its text."""
        out, inside, holds, up = [], [False] * len(self.elements), set(), self.chief
        while up >= 0:
            holds.add(up)
            up = self.elements[up].parent
        for k, e in enumerate(self.elements):
            above = e.parent >= 0 and inside[e.parent]
            inside[k] = above or e.tag in ("article", "main")
            if k in holds or e.tag in ("html", "body"):
                out.append(-1)
            elif inside[k]:
                out.append(WITHIN if e.tag in LOOSE or e.tag == "article" else -1)
            else:
                out.append(BARE if self.chief < 0 else OUTSIDE)
        return out

    def text(self, template: frozenset[int] | set[int] | tuple = frozenset(), rules: bool = True) -> str:
        """The main text, without subtrees whose mixed digests are in ``template``; ``rules`` off: without those alone."""
        gone, inside = [False] * len(self.elements), [False] * len(self.elements)
        for k, (e, kind) in enumerate(zip(self.elements, self.kinds())):
            up = e.parent
            inside[k] = e.tag in ("article", "main") or (up >= 0 and inside[up])
            gone[k] = (up >= 0 and gone[up]) or (kind >= 0 and e.digest ^ _MIX[kind] in template) or (rules and self._is_noise(e, inside[k]))
        roots: list[tuple[int, int]] = []
        for tag in ("article", "main", "body", "html") if rules else ("body",):
            for k in self._best(tag):
                e = self.elements[k]
                if not gone[k] and not (roots and e.end <= roots[-1][1]):
                    roots.append((e.begin, e.end))
            if roots:
                break
        else:
            roots = [(0, len(self.parts))]
        drop = sorted((e.begin, e.end) for e, out in zip(self.elements, gone) if out)
        blocks, k = [], 0
        for at, end in roots:
            now: list[str] = []
            while at < end:
                while k < len(drop) and drop[k][1] <= at:
                    k += 1
                if k < len(drop) and drop[k][0] <= at < drop[k][1]:
                    at = drop[k][1]
                    continue
                part = self.parts[at]
                if part is BREAK:
                    blocks.append("".join(now))
                    now = []
                else:
                    now.append(part)
                at += 1
            blocks.append("".join(now))
        return "\n".join(x for x in (_SPACE.sub(" ", b).strip() for b in blocks) if x)

    def _print(self, root: int) -> int:
        """The least hash of the three-word runs of an element's text: of the checksums of the words, mixed."""
        e = self.elements[root]
        words = "".join(x or " " for x in self.parts[e.begin : e.end]).encode("utf-8", "surrogatepass").split()
        one = np.zeros(max(3, len(words)), np.uint64)
        one[: len(words)] = np.fromiter(map(crc32, words), np.uint64, len(words))
        mixed = (one[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (one[2:] * np.uint64(0x165667B19E3779F9))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return int((mixed ^ (mixed >> np.uint64(32))).min()) - (1 << 63)

    def digests(self) -> tuple[int, dict[int, int]]:
        """The page's print, and the mixed digests of its subtrees with text, each with the kind of place where it stands."""
        found = {e.digest ^ _MIX[kind]: kind for e, kind in zip(self.elements, self.kinds()) if kind >= 0 and e.size}
        if self.chief >= 0:
            return self._print(self.chief), found
        return self._hash("\0".join(str(e.digest) for e in self.elements if e.parent < 0).encode()).intdigest() - (1 << 63), found


def _strings(batch: pa.RecordBatch, at: int) -> list[str]:
    return [x or "" for x in batch.column(at).to_pylist()]


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, print, digests, kinds) of each page with a host; ``page`` is a digest of the html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                prints, found = zip(*(Page(x).digests() for x in _strings(part, 2)))
                columns = [pa.array(prints, pa.int64()), pa.array([list(f) for f in found], pa.list_(pa.int64())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["host", "page", "print", "digests", "kinds"])

    hosted = pages.select(host(F.col("url")).alias("host"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("page"), F.coalesce("html", F.lit("")).alias("html")).where("host <> ''")
    return hosted.mapInArrow(run, "host string, page string, print long, digests array<long>, kinds array<int>")


def recurring(found: DataFrame, share: float = SHARE, least: int = LEAST, inside: int = INSIDE) -> DataFrame:
    """(host, digest) of each host's template, from ``subtrees``."""
    # A page counts once under a digest of its own, so pages and subtrees are counted in one pass.
    own = F.array(F.struct(F.lit(None).cast("long").alias("digests"), F.lit(None).cast("int").alias("kinds")))
    rows = found.select("host", "print", F.explode(F.concat(own, F.arrays_zip("digests", "kinds"))).alias("x")).select("host", "print", F.col("x.digests").alias("digest"), F.col("x.kinds").alias("kind"))
    by_print = rows.groupBy("host", "digest", "kind", "print").agg(F.count(F.lit(1)).alias("n"))
    counts = by_print.groupBy("host", "digest", "kind").agg(F.sum(F.when(F.col("digest").isNull(), F.col("n")).otherwise(1)).alias("n"))
    # Kept once, so that the pages are not parsed for each side of the join.
    many = stored(counts.where(F.col("digest").isNull() | (F.col("n") >= F.when(F.col("kind") == WITHIN, int(inside)).otherwise(int(least)))))
    sites, often = many.where("digest IS NULL").select("host", F.col("n").alias("pages")), many.where("digest IS NOT NULL")
    shared = often.where(F.col("kind") != OUTSIDE).join(sites, "host").where(F.col("n") >= F.lit(share) * F.col("pages"))
    return often.where(F.col("kind") == OUTSIDE).select("host", "digest").unionByName(shared.select("host", "digest"))


def _known(found: DataFrame, template: DataFrame) -> DataFrame:
    """(host, page, digests): for each different page, those of its digests that are template. A digest that stands on all pages of a hot host is dealt over ``SALTS`` tasks."""
    rows = found.select("host", "page", "digests").dropDuplicates(["host", "page"]).select("host", "page", F.explode("digests").alias("digest")).withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)))
    marks = template.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(marks.hint("shuffle_hash"), ["host", "digest", "salt"], "left_semi").groupBy("host", "page").agg(F.collect_list("digest").alias("digests"))


def extract(pages: DataFrame, broadcast_rows: int = BROADCAST) -> tuple[DataFrame, str]:
    """``pages`` with the main text as one more column, and that column's name."""
    found = stored(subtrees(pages))
    template = stored(recurring(found))
    columns, html_at, name = pages.columns, pages.columns.index("html"), fresh_name(pages, "main_text")
    schema = T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())])
    site, known = fresh_name(pages, "site_host"), fresh_name(pages, "site_digests")
    hosted = pages.withColumn(site, host(F.col("url")))
    shared = None
    if template.limit(broadcast_rows + 1).count() <= broadcast_rows:
        table: dict[str, set[int]] = {}
        for r in template.collect():
            table.setdefault(r.host, set()).add(r.digest)
        shared = pages.sparkSession.sparkContext.broadcast(table)
    else:
        page, salt = fresh_name(pages, "site_page"), fresh_name(pages, "site_salt")
        # Copies of a page are dealt over ``SALTS`` tasks by their other columns.
        marks = _known(found, template).select(F.col("host").alias("_host"), F.col("page").alias("_page"), F.col("digests").alias(known), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
        keyed = hosted.withColumn(page, F.sha2(F.coalesce("html", F.lit("")), 256)).withColumn(salt, F.pmod(F.xxhash64(*(F.col(f.name).cast("string") for f in pages.schema.fields if f.name != "html" and isinstance(f.dataType, T.AtomicType))), F.lit(SALTS)))
        hosted = keyed.join(marks, (F.col(site) == F.col("_host")) & (F.col(page) == F.col("_page")) & (F.col(salt) == F.col("_salt")), "left").select(*columns, site, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html_at):
                sets = [shared.value.get(h, ()) for h in part.column(len(columns)).to_pylist()] if shared else [set(x or ()) for x in part.column(len(columns) + 1).to_pylist()]
                texts = [Page(x).text(t) for x, t in zip(_strings(part, html_at), sets)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(texts, pa.string())], names=[*columns, name])

    return hosted.mapInArrow(run, schema), name


def main_text_report(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    found, c = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col(c).alias("text"), F.length(c).cast("long").alias("n_chars"))
