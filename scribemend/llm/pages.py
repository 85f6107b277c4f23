"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree.  An element node is named by its path: tag, id and class names, and its
place among the like-named children of its parent.  Over the distinct pages of the host each node has style nodes (the
sequences of its children's tags) and contents (digests of its text).  With m pages, the importance of a node is
GAMMA times the entropy of its contents plus 1 - GAMMA times its presentation, the entropy of its styles, both to the
base m; a node of one page has importance 1.  In branches below THRESHOLD the contents that several pages have go
from those pages; a content that one page alone has stays.  Copies of a page say nothing about its template: pages
count once if the same longest blocks make up SAME of their text, so another date or advert makes no other page.

Templates also fill menus or adverts anew on every page, which entropy takes for content.  So the presentation of a
node counts, too: what its tag, role, id or class names declare (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, comments of readers) has importance 0, and in an article or main element presentation is 1.
Text outside a main element has importance 0 if there is text in it; an article alone says nothing of what is around it.

Text: character references are decoded, inline tags join, block tags and <br> part; white space inside a block becomes one
space, and the blocks are joined in page order by one space. Null or empty html, and pages of markup alone, give an
empty text; a null or unreadable url makes a host of its own kind, "". Unclosed, crossed and missing tags are borne.
Rows that repeat a page_id stay rows of their own.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemend.llm.common import KEY_ROWS, attach, matching, ship_package, stored

GAMMA, THRESHOLD, SAME = 0.9, 0.25, 0.9

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "svg", "math", "template", "select")
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp
small span strike strong sub sup time tt u var wbr img""".split())
MENUS = frozenset("nav header footer aside form menu button input select textarea dialog fieldset legend option head".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())
#: Elements that the start of another one closes (the element: those whose start ends it).
BLOCKS = frozenset("""address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav
ol p pre section table ul""".split())
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
             "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
             "head": frozenset(["body"])}

# Words of ids and class names that declare what is no content; the second list not inside an article.
NOT_CONTENT = """nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer sidebar aside widget widgets notice
notices cookie cookies consent gdpr popup modal overlay ad ads advert adverts advertisement advertising adsense adslot
sponsor sponsored promo promoted promotion newsletter subscribe subscription signup login search searchbox form forms
comment comments commentlist respond replies disqus share sharing social related recommended recirc pagination pager
toolbar skip copyright disclaimer hidden"""
NOT_PAGE = "header masthead banner topbar foot colophon side rail alert legal"


def words_pattern(words: str) -> re.Pattern:
    """One of the words in a list of names, unless the name says that something has it or lacks it."""
    return re.compile(rf"(?i)(?<![a-z])(?<!has-)(?<!with-)(?<!no-)(?<!without-)(?:{'|'.join(words.split())})(?![a-z])")


IN_ARTICLE, OUTSIDE = words_pattern(NOT_CONTENT), words_pattern(f"{NOT_CONTENT} {NOT_PAGE}")
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                   r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?i)\b(id|class|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW_END = {name: re.compile(rf"(?i)</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)") for name in RAW}


class Node:
    """An open or closed element while a page is read."""

    __slots__ = ("name", "path", "zero", "flow", "cut", "kinds", "places", "digest", "said")

    def __init__(self, name: str, path: int, zero: bool, flow: int, cut: bool = False):
        self.name, self.path, self.zero, self.flow, self.cut, self.said = name, path, zero, flow, cut, False
        self.kinds: list[str] = []
        self.places: Counter = Counter()
        self.digest = xxhash.xxh3_64()


def declared(name: str, attributes: str, flow: int) -> tuple[bool, str]:
    """Does the element say that it is no content; and its id and class names."""
    zero, names = name in MENUS and not (flow and name == "header"), ""
    if attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("id", "class"):
                names += f" {value}"
            zero = zero or (key == "role" and value.lower() in ROLES) or key == "hidden" or (
                key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower())
        if names and name not in ("body", "html", "main"):
            zero = zero or bool((IN_ARTICLE if flow or name == "article" else OUTSIDE).search(names))
    return zero, names


class Page:
    """Blocks of a page: (flow, in a branch to cut, text); and its nodes with text, if asked for.

    The flow is 1 in a main element, 2 in an article, 3 in both, 0 elsewhere.
    """

    def __init__(self, html: str, site: str = "", nodes: bool = False, cut: frozenset[int] = frozenset()):
        self.blocks: list[tuple[int, bool, str]] = []
        self.nodes: list[tuple[int, bool, int, int]] | None = [] if nodes else None
        self.cut = cut
        self.stack = [Node("", xxhash.xxh3_64_intdigest(site) >> 1, False, 0)]
        self.text: list[str] = []
        self.read(html)
        while len(self.stack) > 1:
            self.close()
        self.end_block()

    def read(self, html: str) -> None:
        at = 0
        while True:
            found = TOKEN.search(html, at)
            self.add(html[at:found.start()] if found else html[at:])
            if not found:
                return
            at = found.end()
            name = (found[2] or found[5] or "").lower()
            if not name:
                if found[0].startswith("<![CDATA["):
                    self.add(references.escape(found[0][9:].removesuffix("]]>")))
            elif found[1] or found[4]:
                self.end(name)
            else:
                self.start(name, found[3] or found[6] or "")
                if name in RAW_END and not found[0].endswith("/>"):
                    end = RAW_END[name].search(html, at)
                    at = end.end() if end else len(html)

    def add(self, text: str) -> None:
        if text and not self.stack[-1].zero:
            self.text.append(references.unescape(text) if "&" in text else text)

    def end_block(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            self.text = []
            if words:
                self.blocks.append((self.stack[-1].flow, self.stack[-1].cut, words))
                if self.nodes is not None:
                    for node in self.stack[1:]:
                        node.digest.update(f"{words}\n")
                        node.said = True

    def start(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self.end_block()
        while len(self.stack) > 1 and name in CLOSED_BY.get(self.stack[-1].name, ()):
            self.close()
        if name in BLOCKS or name in CLOSED_BY:  # inline elements left open inside a paragraph, cell or item end with it
            for depth in range(len(self.stack) - 1, 0, -1):
                inside = self.stack[depth].name
                if name in CLOSED_BY.get(inside, ()):
                    while len(self.stack) > depth:
                        self.close()
                    break
                if inside not in INLINE:
                    break
        above = self.stack[-1]
        above.kinds.append(name)
        if name in VOID or name in RAW_END:
            return
        zero, names = declared(name, attributes, above.flow)
        zero, flow = above.zero or zero, 0 if zero else above.flow | {"article": 2, "main": 1}.get(name, 0)
        path = 0
        if not zero:
            label = name + names
            path = xxhash.xxh3_64_intdigest(f"{above.path} {label} {above.places[label]}") >> 1
            above.places[label] += 1
        self.stack.append(Node(name, path, zero, flow, above.cut or path in self.cut))

    def close(self) -> None:
        node = self.stack[-1]
        if node.name not in INLINE:
            self.end_block()
        self.stack.pop()
        if self.nodes is not None and node.said and not node.zero and node.name not in INLINE:
            style = xxhash.xxh3_64_intdigest(" ".join(node.kinds)) >> 1
            self.nodes.append((node.path, node.flow > 0, style, node.digest.intdigest() >> 1))

    def end(self, name: str) -> None:
        if name in VOID:
            if name == "br":
                self.end_block()
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].name == name:
                while len(self.stack) > depth:
                    self.close()
                return

    def content(self) -> list[tuple[int, bool, str]]:
        """The blocks that presentation leaves: with text in a main element those of it and of articles, or else all."""
        main = any(flow & 1 for flow, _, _ in self.blocks)
        return [block for block in self.blocks if block[0] or not main]

    def kept(self) -> str:
        return " ".join(words for _, cut, words in self.content() if not cut)

    def likeness(self) -> int:
        """Digest of the longest blocks that make up SAME of the text."""
        digest, blocks = xxhash.xxh3_64(), sorted((words for _, _, words in self.content()), key=lambda w: (-len(w), w))
        left = SAME * sum(map(len, blocks))
        for words in blocks:
            if left <= 0:
                break
            digest.update(f"{words}\n")
            left -= len(words)
        return digest.intdigest() >> 1


def host(url: Column) -> Column:
    """The host of a url without www. and port; "" if there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?(?:www\.)?([^/?#:]+)", 1)
    return F.coalesce(found, F.lit(""))


def style_nodes(rows: DataFrame) -> DataFrame:
    """(page, alike, path, flow, style, content) of the nodes with text of which nothing is declared, stored."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for page, site, html in zip(batch["page"], batch["host"], batch["html"], strict=True):
                read = Page(html, site, nodes=True)
                alike = read.likeness()
                found += [(page, alike, *node) for node in read.nodes]
            if found:
                yield pd.DataFrame(found, columns=["page", "alike", "path", "flow", "style", "content"])

    nodes = rows.select("page", "host", "html").mapInPandas(run, "page long, alike long, path long, flow boolean, style long, content long")
    return stored(nodes, "style-nodes")


def entropy(counts: DataFrame, name: str) -> DataFrame:
    """Entropy to the base of the pages of the values of each node, which n pages have; 1 for a node of one page."""
    return counts.groupBy("path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s")).select(
        "path", F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.log("pages"))).otherwise(1.0).alias(name))


def noise(nodes: DataFrame) -> DataFrame:
    """(path, content, n) of the contents to cut, stored; n is the number of their nodes."""
    once = nodes.groupBy("path", "content", "alike").agg(F.count("*").alias("nodes"))
    contents = stored(once.groupBy("path", "content").agg(F.count("*").alias("n"), F.sum("nodes").alias("nodes")), "contents")
    styles = nodes.groupBy("path", "flow", "style", "alike").agg(F.lit(1).alias("one")).groupBy("path", "flow", "style").agg(F.count("*").alias("n"))
    flow = styles.groupBy("path").agg(F.max("flow").alias("flow"))
    # only nodes of low content entropy can be low: few, so that the others are not joined
    low = entropy(contents, "content").filter(F.lit(GAMMA) * F.col("content") < THRESHOLD)
    low = low.join(entropy(styles, "style"), "path").join(flow, "path")
    presentation = F.when(F.col("flow"), 1.0).otherwise(F.col("style"))
    low = low.filter(F.lit(GAMMA) * F.col("content") + F.lit(1 - GAMMA) * presentation < THRESHOLD).select("path")
    repeated = contents.filter(F.col("n") > 1).join(low, "path", "left_semi")
    return stored(repeated.select("path", "content", F.col("nodes").alias("n")), "noise")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""
    ship_package(pages.sparkSession)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [Page(html, site, cut=frozenset(() if cut is None else cut)).kept()
                     for site, html, cut in zip(batch["host"], batch["html"], batch["cut"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    kind, site, html = pages.schema["page_id"].dataType, host(F.col("url")), F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", site.alias("host"), html.alias("html"), F.xxhash64(site, html).alias("page"))
    nodes = style_nodes(rows)
    found = attach(nodes.select("page", "path", "content"), noise(nodes), ["path", "content"], "n", F.col("page")).filter("n IS NOT NULL")
    # the branches to cut of each page
    cut = found.groupBy("page").agg(F.collect_set("path").alias("cut"))
    cut = stored(cut, "cut")
    if (cut.agg(F.sum(F.size("cut"))).first()[0] or 0) <= KEY_ROWS:
        joined = rows.join(F.broadcast(cut), "page", "left")
    else:
        copies = matching(rows.groupBy("page").agg(F.count("*").alias("n")), cut.select("page"), ["page"])
        joined = attach(rows, stored(cut.join(copies, "page"), "cut-copies"), ["page"], "n", F.xxhash64("page_id", "url"))
    out = joined.select("page_id", "url", "host", "html", "cut").mapInPandas(run, "page_id string, url string, text string")
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
