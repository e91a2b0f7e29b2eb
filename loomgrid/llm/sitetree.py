"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: elements with the same path of tags and classes are one style node. Three statistics of
a node give its importance:

* content: the mean, over its occurrences, of 1 - log(pages with this very content) / log(pages of the host). Text that the
  host repeats has high entropy over its pages and low importance;
* presentation: the entropy of its child sequences. A template's fixed parts have one sequence, articles have many;
* mass: its mean share of its pages' text.

Logarithms are of counts with a few pages added, so that hosts of one page and of a million are treated by one rule. The
importance is the logistic function of a weighted sum of the three and of a prior: what the tag and the names say (nav, `ad`,
comments), and whether the page has an article or main element elsewhere. Branches of importance under a half are cut
from each page. Scripts, forms and the like are never text. Paragraphs, headings and list items are cut only where they
stand outside all containers, so a passage that many articles quote stays.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import stored, texts_of

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Never text, whatever the statistics.
_NEVER = {"head", "script", "style", "noscript", "template", "form", "button", "select", "textarea", "iframe", "object", "svg", "canvas", "audio", "video", "map", "dialog", "title", "input", "label", "fieldset"}
#: Elements that a template uses for what is not the article.
_FRAME = {"nav", "header", "footer", "aside", "menu"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
#: Elements that hold running text; statistics never cut these.
_TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "tr", "tbody", "article", "main", "body", "html"} | _INLINE
_NOISE_NAME = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|widget|footer|header|masthead|topbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|trending|copyright|legal|disclaimer|pagination|pager|toolbar|search)(?:$|[-_\s\d])", re.I)
_COMMENT_NAME = re.compile(r"(?:^|[-_\s])(?:comments?|disqus|replies|respond)(?:$|[-_\s\d])", re.I)
#: Weights of the sum that the importance is the logistic function of.
WEIGHTS = {"content": 3.0, "presentation": 2.0, "mass": 2.0, "beside": -1.5, "frame": -3.0, "noise": -2.5, "comment": -4.5, "main": 1.5, "inside": 0.7}
#: Pages that are added to every count of a host's pages.
FEW = 4
_MAIN = {"article", "main"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P_ENDS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class _Element:
    __slots__ = ("tag", "path", "never", "cut", "main", "node", "prior", "children", "text")

    def __init__(self, tag: str, path: str, never: bool, cut: bool, main: bool, node: bool, prior: float):
        self.tag, self.path, self.never, self.cut, self.main, self.node, self.prior, self.children, self.text = tag, path, never, cut, main, node, prior, [], []


def prior(tag: str, named: str, inside: bool) -> float:
    """What the tag and the names of an element say before any statistics."""
    out = WEIGHTS["main"] if tag in _MAIN or "main" in named.split() else 0.0
    if inside:
        out += WEIGHTS["inside"]
    if tag in _FRAME and not (tag == "header" and inside):
        return out + WEIGHTS["frame"]
    if named and _COMMENT_NAME.search(named):
        return out + WEIGHTS["comment"]
    return out + (WEIGHTS["noise"] if named and _NOISE_NAME.search(named) else 0.0)


def walk(page: str, cut: frozenset[int] = frozenset(), nodes: list | None = None) -> list[str]:
    """The text blocks of a page, without what is never text and the style nodes in `cut`.

    `nodes` gets (path, child tags, text, prior, inside main) for each element that statistics may cut.
    """
    stack = [_Element("#", "", False, False, False, False, 0.0)]
    blocks: list[str] = []
    pending: list[str] = []

    def flush() -> None:
        if pending:
            block = " ".join(entities.unescape("".join(pending)).split())
            pending.clear()
            if block:
                blocks.append(block)

    def close() -> None:
        top = stack.pop()
        if nodes is not None:
            if top.node and not top.never:
                nodes.append((top.path, ",".join(top.children), " ".join("".join(top.text).split()), top.prior, top.main))
            stack[-1].text.extend(top.text)

    def put(text: str) -> None:
        if text and not stack[-1].never:
            if nodes is not None:
                stack[-1].text.append(text)
            if not stack[-1].cut:
                pending.append(text)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            rest = page.find("<", at)
            while 0 <= rest and not re.match(r"</?[a-zA-Z]|<[!?]", page[rest : rest + 3]):
                rest = page.find("<", rest + 1)
            put(page[at : rest if rest >= 0 else end])  # a tag that the page cuts short is not text
            break
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if any(x.tag == tag for x in stack[1:]):
                while True:
                    top = stack[-1].tag
                    if top not in _INLINE:
                        flush()
                    close()
                    if top == tag:
                        break
            elif tag == "br":
                put(" ")
            continue
        if tag == "br":
            put(" ")
            continue
        if tag not in _INLINE:
            flush()
        if tag in _P_ENDS and any(x.tag == "p" for x in stack[-4:]):
            while stack[-1].tag == "p" or any(x.tag == "p" for x in stack[-4:]):
                close()
        elif tag in _CLOSES and stack[-1].tag in _CLOSES[tag]:
            close()
        parent = stack[-1]
        parent.children.append(tag)
        if tag in _VOID:
            continue
        attributes = m[3] or m[6] or ""
        named = " ".join(x[1] or x[2] or x[3] for x in _NAMED.findall(attributes)) if "=" in attributes else ""
        path = f"{parent.path}>{tag}" + (f".{re.sub(r'[0-9]+', '#', named)}" if named else "")
        main = parent.main or tag in _MAIN or "role" in attributes and "main" in named.split()
        # containers are nodes of the style tree, and so is what stands outside all of them
        node = tag in _MAIN or tag not in _TEXTUAL or not main and parent.tag in ("#", "html", "body") and tag not in ("html", "body")
        stack.append(_Element(tag, path, parent.never or tag in _NEVER, parent.cut or node and bool(cut) and _digest(path) in cut, main, node, prior(tag, named, parent.main)))
        if tag in _RAW and not attributes.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = stop.start() if stop else end
    flush()
    while len(stack) > 1:
        close()
    if nodes is not None:
        nodes.append(("", "", " ".join("".join(stack[0].text).split()), 0.0, False))
    return blocks


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def importances(pages: DataFrame) -> DataFrame:
    """Style nodes of every host: host, node, content, presentation, mass, importance. `pages` has host and html."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, list] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nodes: list = []
                walk(page or "", nodes=nodes)
                whole = max(1, len(nodes.pop()[2]))
                has_main = any(main and text for _, _, text, _, main in nodes)
                once: dict[tuple, list] = {}
                for path, kids, text, weight, main in nodes:
                    if text:
                        cell = once.setdefault((host, _digest(path), _digest(text), _digest(kids)), [0.0, 0.0, weight])
                        cell[0], cell[1] = cell[0] + len(text) / whole, float(has_main and not main)
                for k, (mass, beside, weight) in once.items():
                    cell = seen.setdefault(k, [0, 0.0, 0.0, weight])
                    cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] + mass, cell[2] + beside
            rows = list(zip(*((*k, *v) for k, v in seen.items()), strict=True)) or [[]] * 8
            types = (pa.string(), *[pa.int64()] * 4, *[pa.float64()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["host", "node", "content", "shape", "n", "mass", "beside", "prior"])

    sizes = pages.groupBy("host").agg(F.count("*").alias("m"))
    found = texts_of(pages.select("host", "html")).mapInArrow(count, "host string, node long, content long, shape long, n long, mass double, beside double, prior double")
    sums = [F.sum(c).alias(c) for c in ("n", "mass", "beside")]
    cells = stored(found.groupBy("host", "node", "content", "shape").agg(*sums, F.max("prior").alias("prior")), "cells")
    contents = cells.groupBy("host", "node", "content").agg(*sums, F.max("prior").alias("prior")).join(sizes, "host")
    rare = 1 - F.log("n") / F.log(F.col("m") + FEW)
    by_content = contents.groupBy("host", "node").agg(
        (F.sum(F.col("n") * F.greatest(F.lit(0.0), rare)) / F.sum("n")).alias("content"), (F.sum("mass") / F.sum("n")).alias("mass"),
        (F.sum("beside") / F.sum("n")).alias("beside"), F.max("prior").alias("prior"),
    )
    shapes = cells.groupBy("host", "node", "shape").agg(F.sum("n").alias("n"))
    by_shape = shapes.groupBy("host", "node").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("nl"))
    # one more unit of entropy of which half is there: a node that is seen once says nothing
    entropy = (F.log("t") - F.col("nl") / F.col("t") + 0.5) / (F.log("t") + 1)
    joined = by_content.join(by_shape.select("host", "node", entropy.alias("presentation")), ["host", "node"])
    w = WEIGHTS
    z = w["content"] * (F.col("content") - 0.5) + w["presentation"] * (F.col("presentation") - 0.5) + w["mass"] * (F.least(F.lit(1.0), F.col("mass")) - 0.25) + w["beside"] * F.col("beside") + F.col("prior")
    return joined.select("host", "node", "content", "presentation", "mass", (1 / (1 + F.exp(-z))).alias("importance"))


def extract(pages: DataFrame, broadcast_rows: int = 50_000) -> DataFrame:
    """Add text and n_chars to pages (page_id, url, html).

    A null or empty html has the empty text. A null url, or one without a host, belongs to the host of the empty name.
    Repeated rows are each extracted, and count as pages of their host. An empty table gives no rows. Other columns are
    ignored. The table of cut branches is broadcast only if it is counted to be small; else the join is salted by page.
    """
    pages = pages.select("page_id", "url", "html").withColumn("host", _host("url"))
    low = stored(importances(pages).where("importance < 0.5").groupBy("host").agg(F.collect_set("node").alias("cut")), "branches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, cut in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                texts.append("\n\n".join(walk(page or "", frozenset(cut or ()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if (low.agg(F.sum(F.size("cut"))).first()[0] or 0) <= broadcast_rows:
        joined = pages.join(F.broadcast(low), "host", "left")
    else:
        spread = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(32)).cast("int")).join(spread, ["host", "salt"], "left")
    return texts_of(joined.select("page_id", "url", "html", "cut")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
