"""Main text of web pages through a site style tree.

The DOMs of a host's pages are merged by node path (tag, class and id from the root, numbers
aside).  For each (host, path) two entropies are computed over the host's distinct pages: of the
*presentation* (the elements below) and of the *content* (the text below).
With c_i pages showing variant i, of m pages in all, the importance is
``-sum(c_i/m * log_m(c_i/m))``: 0 for a node that every page shows alike, 1 for one that is
different on each page.  They decide on every page, inside articles too:

* *The frame.*  From the root down, while exactly one child carries the site's variety (it stands once on
  each page that has it, on half of the pages or more, and its presentation has ``CARRY`` of the
  root's importance or more), the tree goes into that child; what stands beside it has no part in the text.
* *Branches.*  A node whose two importances are below ``LEAST`` is removed with all that is below it,
  if it stands on ``MIN_PAGES`` distinct pages and ``SHARE`` of them or more.

Pages of equal text (menus and the like aside) count as one, so copies of an article are still
articles; a page of which the tree would leave nothing keeps what the priors leave.

*Priors.*  What the task names as no part of an article, whatever its entropy (adverts and comments
differ on each page), goes by tag, role or class name: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments.  Names don't count for an article or
main element and for what holds one (but for comments beside another article), nor where the word only relates
to something else (with-sidebar, long-form).  If an article or main element with text is left, only that is the
text; this is what decides where a host has few pages.

Pages of one host are never gathered: variants are counted (with pre-aggregation) and only a
host's frame and low paths come back to its pages; their number is bounded by the nodes of a page over ``SHARE``.

Defined results: null and empty html give the empty text; pages without a host in
their url use priors alone; repeated rows stay repeated; unclosed and stray
tags are repaired as browsers do; where a quote is never closed, quotes no longer count.  An empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .scratch import written

LEAST, MIN_PAGES, SHARE, CARRY = 0.2, 5, 0.05, 0.8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)", re.S)
_IN_TAG = re.compile("[>\"']")
_IN_BROKEN_TAG = re.compile("[<>]")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_NUMBER = re.compile(r"\d+")
#: fixed values: HTML's element kinds
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i iframe input ins kbd label link map mark meta noembed noframes q rb rp rt ruby s samp script small span strike strong style sub sup textarea time tt u var wbr xmp img br".split())
#: kinds that stand in a line of text but may hold blocks
NESTED = frozenset("button canvas math noscript object select svg template".split())
FOREIGN = frozenset(["svg", "math"])
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
#: fixed values: elements, roles and class words of what is no part of an article
NOISE_TAGS = frozenset("nav footer aside form script style noscript template svg iframe button select option textarea input dialog menu head object canvas title map".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NOISE_WORDS = frozenset(
    "advert adverts advertisement advertising adsense banner promo sponsor sponsored"
    " breadcrumb breadcrumbs menu nav navbar navigation pager pagination footer masthead sidebar"
    " alert consent cookie cookies gdpr modal newsletter notice notices overlay paywall popup"
    " form login signin signup comment comments commentlist disqus respond".split()
)
#: of these, the words of reader comments, which are often articles themselves
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond".split())
#: words that turn such a name into a statement about something else (with-sidebar, no-footer, long-form, comment-on-policy)
RELATING = frozenset("with without has have no non not is long on of in for to about and the".split())
AD_WORDS = frozenset("ad ads slot box unit container wrapper block top bottom left right side label text frame space zone area".split())
MAIN_WORDS = frozenset("article content entry main post story".split())
HIDDEN = "display:none"


def _is_noise(named: str) -> int:
    """3 if one of the class names or ids is of reader comments, 2 if of another kind that is no part of an article, else 0."""
    found = 0
    for token in named.split():
        words = [w.lower() for w in _WORDS.findall(token)]
        if not NOISE_WORDS.isdisjoint(words) and RELATING.isdisjoint(words):
            found = max(found, 2 if COMMENT_WORDS.isdisjoint(words) else 3)
        elif ("ad" in words or "ads" in words) and all(w in AD_WORDS or w.isdigit() for w in words):
            found = max(found, 2)
    return found


class Page:
    """A page's elements, as a tree, and its blocks of text; the work is linear in the source.

    ``nodes`` holds (parent, path, tag) of each block element, the root first, so that a node's subtree is a run
    of them, and ``blocks`` (node, noise, main, text) in page order.
    """

    def __init__(self, source: str):
        self.nodes: list[tuple[int, int, str]] = [(-1, 0, "")]
        # tag, node, noise within its line, main, main of the element that its line is in
        self.stack: list[tuple[str, int, bool, int, int]] = [("", 0, False, 0, 0)]
        self.open_tags: dict[str, int] = {}
        self.noisy = [0]  # for each node: 1 by tag, role or being hidden, 2 by name, 3 by a name of comments
        self.holds = [False]  # whether an article or main element is or lies below it
        self.blocks: list[tuple[int, bool, int, str]] = []
        self.buffer: list[str] = []
        self.broken = False
        at = 0
        lower = None
        while (m := _TOKEN.search(source, at)) is not None:
            if m.group(2) is not None:
                end = self.tag_end(source, m.end())
                if end < 0:  # no tag: its characters are text
                    self.say(_html.unescape(source[at : m.end()]))
                    at = m.end()
                    continue
            if m.start() > at:
                self.say(_html.unescape(source[at : m.start()]))
            at = m.end()
            if m.group(2) is None:
                continue
            at = end
            tag = m.group(2).lower()
            if m.group(1):
                self.close(tag)
                continue
            self.open(tag, source[m.end() : end - 1])
            if tag in RAW:
                lower = lower if lower is not None else source.lower()
                end = lower.find("</" + tag, at)
                at = len(source) if end < 0 else end
        if at < len(source):
            self.say(_html.unescape(source[at:]))
        self.flush()
        self.settle()

    def tag_end(self, source: str, at: int) -> int:
        """The place behind a tag's ``>``, quoted ones aside; -1 if there is none.

        Where quotes swallow the rest of the source, quotes no longer count from there on, and a tag ends before the next one.
        """
        if not self.broken:
            begin = at
            while (m := _IN_TAG.search(source, at)) is not None:
                if m.group() == ">":
                    return m.end()
                at = source.find(m.group(), m.end()) + 1
                if not at:
                    break
            self.broken, at = True, begin
        m = _IN_BROKEN_TAG.search(source, at)
        return m.end() if m is not None and m.group() == ">" else -1

    def say(self, text: str) -> None:
        if not self.stack[-1][2]:  # else a noisy element in a line: the line goes on without it
            self.buffer.append(text)

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer = []
            if text:
                self.blocks.append((self.stack[-1][1], False, self.stack[-1][4], text))

    def push(self, entry: tuple[str, int, bool, int, int]) -> None:
        self.stack.append(entry)
        self.open_tags[entry[0]] = self.open_tags.get(entry[0], 0) + 1

    def cut(self, i: int) -> None:
        """Ends the open elements from the i-th on."""
        for entry in self.stack[i:]:
            self.open_tags[entry[0]] -= 1
        del self.stack[i:]

    def open(self, tag: str, attributes: str) -> None:
        foreign = self.foreign()
        block = not foreign and tag not in INLINE and tag not in NESTED
        if block:
            self.flush()
            self.close_implied(tag)
        if tag == "br":
            self.say(" ")
        _, node, quiet, main, _ = self.stack[-1]
        named, noise, article = "", 0, tag in ("article", "main")
        if tag in NOISE_TAGS or (tag == "header" and not main):
            noise = 1
        if article:
            main = 2
        if attributes and ("=" in attributes or "hidden" in attributes):
            values = {k.lower(): _html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            named = f"{values.get('class', '')} {values.get('id', '')}"
            words = {w.lower() for w in _WORDS.findall(named)}
            role = values.get("role", "").lower()
            inner = tag not in ("html", "body")
            article |= role in ("main", "article")
            if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or HIDDEN in values.get("style", "").replace(" ", "").lower() or role in NOISE_ROLES:
                noise = 1
            elif inner and (kind := max(_is_noise(named), 2 if "header" in words and not main else 0)) and (kind == 3 or not article):
                noise = noise or kind
            elif role in ("main", "article"):
                main = 2
            elif words & MAIN_WORDS and tag in ("div", "section", "td") and not main:
                main = 1
        if tag in VOID or (attributes.endswith("/") and (foreign or tag in FOREIGN)):
            return
        if not block:
            self.push((tag, node, quiet or bool(noise), main, self.stack[-1][4] if tag in INLINE else main))
            return
        path = xxhash.xxh64_intdigest(f"{self.nodes[node][1]:x}/{tag}.{_NUMBER.sub('0', named)}")
        self.nodes.append((node, path, tag))
        self.noisy.append(noise or int(quiet))
        self.holds.append(article and not quiet)
        self.push((tag, len(self.nodes) - 1, False, main, main))

    def foreign(self) -> bool:
        """Whether a drawing or a formula is open: its elements are no blocks and may close themselves."""
        return any(self.open_tags.get(tag) for tag in FOREIGN)

    def close_implied(self, tag: str) -> None:
        ends, stops = _CLOSES.get(tag, ({"p"}, None))
        if not any(self.open_tags.get(t) for t in ends):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if stops is not None and self.stack[i][0] in stops:
                break
            if self.stack[i][0] in ends:
                self.cut(i)
                if tag not in ("tr", "tbody"):
                    break
            elif stops is None and self.stack[i][0] not in INLINE:  # a block ends an open paragraph
                break

    def close(self, tag: str) -> None:
        inline = tag in INLINE
        if not inline and tag not in NESTED and not self.foreign():
            self.flush()
        if not self.open_tags.get(tag):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                if not inline and self.stack[-1][1] != self.stack[i][1]:
                    self.flush()
                self.cut(i)
                return
            if inline and self.stack[i][0] not in INLINE:
                return

    def settle(self) -> None:
        """Noise goes down to all below.  A name is no noise where an article is below it; a name of comments is, if there is an article elsewhere."""
        n = len(self.nodes)
        told = [False] * n  # in comments, or noise whatever its name
        elsewhere = False
        for i in range(1, n):
            told[i] = told[self.nodes[i][0]] or self.noisy[i] in (1, 3)
            elsewhere |= self.holds[i] and not told[i]
        for i in range(n - 1, 0, -1):
            self.holds[self.nodes[i][0]] |= self.holds[i]
        for i in range(1, n):
            own = self.noisy[i] == 1 or (self.noisy[i] == 2 and not self.holds[i]) or (self.noisy[i] == 3 and (elsewhere or not self.holds[i]))
            self.noisy[i] = int(own or bool(self.noisy[self.nodes[i][0]]))
        self.blocks = [(node, bool(self.noisy[node]), main, text) for node, _, main, text in self.blocks]

    def frame(self, carrying: frozenset[int]) -> int:
        """The node that the tree goes down to through paths that carry the site's variety; 0, the root, if none does."""
        below: dict[int, list[int]] = {}
        for i, (parent, path, _) in enumerate(self.nodes):
            if path in carrying:
                below.setdefault(parent, []).append(i)
        at = 0
        while len(below.get(at, ())) == 1:
            at = below[at][0]
        return at

    def text(self, low: frozenset[int] = frozenset(), carrying: frozenset[int] = frozenset()) -> str:
        """The blocks that stay; ``low``: paths without importance, ``carrying``: paths that may hold the frame."""
        good = [b for b in self.blocks if not b[1]]
        if low or carrying:
            frame = self.frame(carrying)
            stays = [False] * len(self.nodes)
            gone = [False] * len(self.nodes)
            for i, (parent, path, _) in enumerate(self.nodes):
                gone[i] = path in low or (parent >= 0 and gone[parent])
                stays[i] = i == frame or (parent >= 0 and stays[parent])
            good = [b for b in good if stays[b[0]] and not gone[b[0]]] or good
        level = 2 if any(b[2] == 2 for b in good) else max((b[2] for b in good), default=0)
        return "\n".join(t for _, _, main, t in good if main >= level)

    def tree(self) -> tuple[int, dict[int, list]]:
        """(hash of the text without noise, {path: [presentation, content, once]}) of all nodes.

        A subtree's elements and its blocks are runs of the page's, so their hashes are differences of running sums.
        """
        own = xxhash.xxh64_intdigest("\n".join(t for _, noise, _, t in self.blocks if not noise))
        n = len(self.nodes)
        depth, size, said = [0] * n, [1] * n, [0] * n
        for i in range(1, n):
            depth[i] = depth[self.nodes[i][0]] + 1
        first = [len(self.blocks)] * n
        for k, (node, *_) in enumerate(self.blocks):
            said[node] += 1
            first[node] = min(first[node], k)
        for i in range(n - 1, 0, -1):
            parent = self.nodes[i][0]
            size[parent] += size[i]
            said[parent] += said[i]
            first[parent] = min(first[parent], first[i])
        style = _sums([xxhash.xxh64_intdigest(f"{depth[i] - depth[i - 1]}{self.nodes[i][2]}") for i in range(n)])
        content = _sums([xxhash.xxh64_intdigest(text) for *_, text in self.blocks])
        found: dict[int, list] = {}
        for i, (_, path, _) in enumerate(self.nodes):
            below = _run(style, i + 1, i + size[i])
            words = _run(content, first[i], first[i] + said[i]) if said[i] else 0
            if path in found:
                have = found[path]
                found[path] = [xxhash.xxh64_intdigest(f"{have[0]}#{below}"), xxhash.xxh64_intdigest(f"{have[1]}#{words}") if words else have[1], False]
            else:
                found[path] = [below, words, True]
        return own, found


_BASE, _PRIME = 0x5851F42D4C957F2D, (1 << 89) - 1


def _sums(hashes: list[int]) -> tuple[list[int], list[int]]:
    """Running polynomial sums of hashes, and the base's powers."""
    sums, powers = [0], [1]
    for h in hashes:
        sums.append((sums[-1] * _BASE + h + 1) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
    return sums, powers


def _run(sums: tuple[list[int], list[int]], a: int, b: int) -> int:
    """The hash of a run of hashes, as 64 bits."""
    return ((sums[0][b] - sums[0][a] * sums[1][b - a]) % _PRIME) & (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


NODE_SCHEMA = "host string, path long, page long, style long, content long, once boolean"


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in B.slices(whole, "html"):
            out: list[tuple] = []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if source and host:
                    page, nodes = Page(source).tree()
                    out += [(host, _signed(path), _signed(page), _signed(style), _signed(content), once) for path, (style, content, once) in nodes.items()]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 4, pa.bool_()), strict=True)], [c.split()[0] for c in NODE_SCHEMA.split(", ")])


def hosts(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host``, null where the url has none."""
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.withColumn("host", F.when(host != "", host))


def importance(pages: DataFrame) -> DataFrame:
    """(host, path, pages, once, presentation, content): the merged trees' nodes; path 0 is a host's root."""
    rows = hosts(pages.select("url", F.col("html").cast("string").alias("html"))).select("host", "html").where("host is not null")
    nodes = rows.mapInArrow(_node_rows, NODE_SCHEMA)
    nodes = nodes.groupBy("host", "path", "page").agg(F.min("style").alias("style"), F.min("content").alias("content"), F.min("once").alias("once"))  # distinct pages
    kinds = nodes.select("host", "path", "once", F.posexplode(F.array("style", "content")).alias("kind", "variant"))
    counts = kinds.groupBy("host", "path", "kind", "variant").agg(F.count("*").alias("c"), F.min("once").alias("once"))
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"), F.min("once").alias("once"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(F.lit(1.0))
    of_kind = lambda k: F.max(F.when(F.col("kind") == k, entropy))
    return sums.groupBy("host", "path").agg(F.max("m").alias("pages"), F.min("once").alias("once"), of_kind(0).alias("presentation"), of_kind(1).alias("content"))


def decisions(tree: DataFrame) -> DataFrame:
    """(host, low, carrying): the paths that :meth:`Page.text` asks for; a row per host."""
    root = tree.where("path = 0").select("host", F.col("pages").alias("all"), F.col("presentation").alias("variety"))
    nodes = tree.where("path != 0").join(root, "host").where(F.col("pages") >= MIN_PAGES)
    low = (F.col("pages") >= SHARE * F.col("all")) & (F.greatest("presentation", "content") < LEAST)
    carrying = F.col("once") & (2 * F.col("pages") >= F.col("all")) & (F.col("variety") >= LEAST) & (F.col("presentation") >= CARRY * F.col("variety"))
    return nodes.where(low | carrying).groupBy("host").agg(F.collect_set(F.when(low, F.col("path"))).alias("low"), F.collect_set(F.when(carrying, F.col("path"))).alias("carrying"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    tree = written(importance(pages), "site-tree")
    found = written(decisions(tree), "site-decisions")  # a row per host; the join can split a hot host
    rows = hosts(pages.select("page_id", "url", F.col("html").cast("string").alias("html"))).join(found, "host", "left").select("page_id", "url", "html", "low", "carrying")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = lambda listed: frozenset(p & (2**64 - 1) for p in listed or ())
        for whole in batches:
            for batch in B.slices(whole, "html"):
                texts = []
                for source, low, carrying in zip(*(batch.column(c).to_pylist() for c in ("html", "low", "carrying")), strict=True):
                    texts.append(Page(source).text(paths(low), paths(carrying)) if source else "")
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
