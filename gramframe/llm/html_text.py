"""HTML extraction by consensus host paths.

Each page is parsed into blocks; every container is scored by the text of its blocks against their links, boilerplate aside, and votes
for its generalised tag-class path (digits collapse), of which a 64-bit digest stands for the whole. The votes are summed by host in
Spark; the path with most wins. Each page is then read again and gives the blocks under elements with its host's path, or under its own
best container if there are none such or they hold much less than that.

Dropped are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, by tag, role and the
words of class and id; an element that has the article or the main element in it is not dropped for its class or id, and a header of
the article keeps its headings. Memory and time are linear in the page, however deep it nests.

Defined results: null html is empty and gives the empty text; a null url has the host ''; broken markup is read as far as it goes:
a tag cut off at the end is dropped, a script or style without an end takes the rest, other elements without text only their tag; repeated rows give repeated results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramframe.llm.common import by_chunk, cut, sized

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/](?:[^>]*>|[^>]*\Z)|<[a-zA-Z][^>]*\Z", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
DIGITS = re.compile(r"\d+")

# Elements of HTML by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video".split())
ENDLESS = frozenset("script style textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = frozenset("article body blockquote center div main section table tbody td tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog button select option fieldset head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside header masthead topbar footer ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall comment comments commentlist disqus respond replies reply share sharing social related recommended pagination pager toolbar widget skip copyright".split()
)
ARTICLE_WORDS = frozenset("article post entry content story main title".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
STATE_WORDS = frozenset("has with no without is not hide show".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply ad ads advert advertisement".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table select body html".split())


@dataclass(frozen=True)
class Html:
    """How much links in a container count against its text, and the least part of the page's own best container that the host's path has to hold."""

    noise: float = 2.0
    least_part: float = 0.25


def class_words(names: str) -> set[str]:
    """Words of class and id names; names such as has-sidebar tell of a state, not of what the element is."""
    words: set[str] = set()
    for name in names.split():
        parts = [w.lower() for w in CAMEL.split(name) if w]
        if parts and parts[0] not in STATE_WORDS:
            words.update(parts)
            if len(parts) > 1 and HEADER_WORDS & set(parts) and ARTICLE_WORDS & set(parts):
                words -= HEADER_WORDS
                words.add("article header")
    return words


CLEAR, DROPPED, DOUBTED, HEADED, CLEAR_SEEN = range(5)


class Page:
    """The elements of a page in order, each with its parent, and its blocks of text.

    An element is clear, dropped for good, dropped unless it turns out to hold the article, or one of which only headings count.
    """

    def __init__(self, source: str):
        # of each element, the page itself first: tag, parent, kind, digest of its path, depth, whether it is in a link or heading
        self.tag, self.parent, self.kind, self.path, self.depth, self.inline = [""], [-1], [CLEAR], [0], [0], [(False, False)]
        self.blocks: list[tuple[str, int, int]] = []  # text, link characters, element
        self.stack: list[int] = [0]
        self.text: list[str] = []
        self.links, self.articles = 0, 0
        at = 0
        while m := TOKEN.search(source, at):
            if m.start() > at:
                self.add(source[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self.end(tag)
            elif tag in RAW:
                if not m[3].rstrip().endswith("/"):
                    close = CLOSE[tag].search(source, at)
                    at = close.end() if close else len(source) if tag in ENDLESS else at
            else:
                self.start(tag, m[3])
        if at < len(source):
            self.add(source[at:])
        self.flush()
        # what parents are holds for their children, which come after them
        self.noise = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            self.noise[k] = self.noise[self.parent[k]] or self.kind[k] in (DROPPED, DOUBTED)
        self.headed = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            self.headed[k] = self.headed[self.parent[k]] or self.kind[k] == HEADED

    def add(self, piece: str) -> None:
        self.text.append(entities.unescape(piece) if "&" in piece else piece)
        if self.inline[self.stack[-1]][0]:
            self.links += len(piece.strip())

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((text, self.links, self.stack[-1]))
            self.text, self.links = [], 0

    def start(self, tag: str, attrs: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag in BLOCK:
                self.flush()
            return
        if tag in BLOCK:
            self.flush()
            self.implied(tag)
        parent = self.stack[-1]
        own = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)} if attrs.strip(" /\n\t") else {}
        classes = own.get("class", "")
        label = tag + "".join("." + DIGITS.sub("#", c) for c in sorted(classes.split()))
        kind = CLEAR
        if tag in BLOCK:
            words = class_words(f"{classes} {own.get('id', '')}") if own else set()
            if tag in NOISE_TAGS or own.get("role", "").lower() in NOISE_ROLES or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", ""):
                kind = DROPPED
            elif tag == "header":
                kind = HEADED if self.articles else DROPPED
            elif tag == "article":
                kind = DROPPED if words & COMMENT_WORDS else CLEAR
            elif "article header" in words:
                kind = HEADED
            elif tag not in ("html", "body", "main") and tag not in HEADINGS and words & NOISE_WORDS:
                kind = DROPPED if words & COMMENT_WORDS else DOUBTED
            if tag in ("article", "main"):
                if kind == CLEAR:
                    k = parent
                    while k > 0 and self.kind[k] != CLEAR_SEEN:  # what holds an article is cleared once, so this is linear
                        if self.kind[k] == DROPPED:
                            break
                        self.kind[k] = CLEAR_SEEN if self.kind[k] in (CLEAR, DOUBTED) else self.kind[k]
                        k = self.parent[k]
                self.articles += 1
        above = self.inline[parent]
        self.tag.append(tag)
        self.parent.append(parent)
        self.kind.append(kind)
        self.path.append(xxhash.xxh3_64_intdigest(label, self.path[parent]))
        self.depth.append(self.depth[parent] + 1)
        self.inline.append((above[0] or tag == "a", above[1] or tag in HEADINGS))
        self.stack.append(len(self.tag) - 1)

    def shut(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        self.articles -= sum(self.tag[e] in ("article", "main") for e in self.stack[k:])
        del self.stack[k:]

    def implied(self, tag: str) -> None:
        """Close what the start of a block ends: an open paragraph, and elements that do not nest in their like."""
        close = CLOSES.get(tag, frozenset())
        for k in range(len(self.stack) - 1, 0, -1):
            open_tag = self.tag[self.stack[k]]
            if open_tag == "p" or open_tag in close:
                self.shut(k)
                if not close:
                    return
            elif open_tag in STOPS or open_tag in CONTAINER and not close:
                return

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[k]] == tag:
                self.shut(k)
                return
            if tag not in BLOCK and self.tag[self.stack[k]] in CONTAINER:
                return

    def kept(self) -> list[tuple[str, int, int]]:
        """Blocks that are not boilerplate."""
        return [x for x in self.blocks if not self.noise[x[2]] and (not self.headed[x[2]] or self.inline[x[2]][1])]

    def masses(self) -> tuple[list[int], list[int]]:
        """Of each element, characters outside and inside links in all that it holds."""
        good, bad = [0] * len(self.tag), [0] * len(self.tag)
        for text, links, k in self.kept():
            waste = min(links, len(text))
            good[k] += len(text) - waste
            bad[k] += waste
        for k in range(len(self.tag) - 1, 0, -1):
            good[self.parent[k]] += good[k]
            bad[self.parent[k]] += bad[k]
        return good, bad

    def scores(self, noise: float) -> dict[int, tuple[float, int]]:
        """Of each path, the best score of its elements (text without links, times its share squared) and its depth. Boilerplate does not count, as read() leaves it out."""
        good, bad = self.masses()
        out: dict[int, tuple[float, int]] = {}
        for k in range(1, len(self.tag)):
            if good[k] and self.tag[k] in CONTAINER:
                score = good[k] * (good[k] / (good[k] + noise * bad[k])) ** 2
                out[self.path[k]] = max(out.get(self.path[k], (0.0, 0)), (score, self.depth[k]))
        return out

    def read(self, path: int) -> list[str]:
        """The blocks under elements with that path."""
        inside = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            inside[k] = inside[self.parent[k]] or self.path[k] == path and self.tag[k] in CONTAINER
        return [text for text, _, k in self.kept() if inside[k]]

    def main(self, path: int | None, p: Html) -> str:
        """The text under the host's path, or the page's own best, or all of it if no container has text."""
        own = best_path(self.scores(p.noise))
        best = self.read(own) if own is not None else [x[0] for x in self.kept()]
        if path is None or path == own:
            return "\n\n".join(best)
        found = self.read(path)
        return "\n\n".join(found if found and sum(map(len, found)) >= p.least_part * sum(map(len, best)) else best)


CLOSE = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}


def best_path(scores: dict[int, tuple[float, int]]) -> int | None:
    return max(scores, key=lambda k: (*scores[k], k), default=None)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame, p: Html) -> DataFrame:
    """(host, path, depth, vote): a page gives each path its score, of the best one's."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        total: dict[tuple[str, int, int], float] = {}
        for host, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            scores = Page(source).scores(p.noise)
            most = max((s for s, _ in scores.values()), default=0.0)
            for path, (s, depth) in scores.items():
                total[host, path, depth] = total.get((host, path, depth), 0.0) + s / most
        digest = np.array([k[1] for k in total], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array(digest), pa.array([k[2] for k in total], pa.int32()), pa.array(list(total.values()), pa.float64())], ["host", "path", "depth", "vote"])

    return pages.select("host", "html").mapInArrow(by_chunk(make, "html"), "host string, path long, depth int, vote double")


def extract(pages: DataFrame, p: Html | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of each row."""
    p = p or Html()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("host", host_of(F.col("url")))
    summed = votes(rows, p).groupBy("host", "path", "depth").agg(F.round(F.sum("vote"), 6).alias("vote"))
    winners = cut(summed.groupBy("host").agg(F.max(F.struct("vote", "depth", "path")).getField("path").alias("path")), "winners")

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        paths = [x if x is None else x & 0xFFFFFFFFFFFFFFFF for x in part.column(3).to_pylist()]
        texts = [Page(source).main(path, p) for source, path in zip(part.column(2).to_pylist(), paths)]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    return rows.join(sized(winners), "host", "left").select("id", "url", "html", "path").mapInArrow(by_chunk(make, "html"), "id long, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
