"""Main text of web pages by consensus of the pages of a host.

Each page scores its containers by the running text of their blocks; Spark counts, per host, how often
each generalised tag-class path wins; every page is then extracted again with the winning paths of
its host, or with its own best container where none of those occurs in it, or whole where no container has running
text. A container without the title (h1) is widened by what stands around it, up to the nearest heading: by the whole
of an ancestor that has one of its own, but of the body only by its own headings, paragraphs and lists.

A path is a hash of the tags and classes from the root, with digits generalised, so numbered classes
agree. Menus, headers of the page, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out by tag and by words of class and id, wherever they stand.

Null html counts as empty: text is empty. A null url, or one without a host, has no consensus: the page's own best
container is used. Pages that are repeated vote and are extracted like any other.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm.common import stored, text_steps

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Elements that can stand inside a line of text without ending it.
IN_LINE = INLINE | frozenset(
    "script style noscript template iframe svg math button select option textarea object embed canvas audio video img "
    "input".split()
)
#: Elements that hold text themselves; what they are part of is scored instead.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead ul ol dl table figcaption summary".split())
DROPPED = frozenset(
    "nav footer aside form script style noscript template iframe svg math button select textarea dialog menu object "
    "embed canvas audio video title head input option".split()
)
#: Words of class and id names that mark what is not the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert comment comments commentlist reply replies respond disqus sidebar "
    "menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer share sharing social related recommended "
    "recommendations newsletter subscribe subscription popup modal overlay toolbar pagination pager widget copyright "
    "login signup searchform".split()
)
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
#: Opening the first ends an open one of the second, within their list or table.
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
SCOPE = frozenset("ul ol dl table div article section main body td th aside form nav header footer blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BONUS = {"article": 1.5, "main": 1.3}
DECAY = 0.7
LEVELS = 4

TAG = re.compile(r"</?([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
DIGITS = re.compile(r"\d+")
PARTS = re.compile(r"[\s_\-:./]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """Blocks of a page and the elements they stand in.

    Elements are numbered in page order: parent, path and tag of each. A block is (text, characters
    inside links, element).
    """

    def __init__(self, source: str):
        self.parent, self.path, self.tag = [-1], [0], [""]
        self.blocks: list[tuple[str, int, int]] = []
        self._skip = [False]
        self._stack = [0]
        self._open: dict[str, int] = {}
        self._buffer: list[str] = []
        self._linked = 0
        self._links = 0
        self._read(source)
        self._flush()

    def _read(self, s: str) -> None:
        i, n = 0, len(s)
        while i < n:
            j = s.find("<", i)
            if j < 0:
                self._text(s[i:])
                return
            if j > i:
                self._text(s[i:j])
            if s.startswith("!--", j + 1):
                end = s.find("-->", j + 4)
                if end < 0:
                    return
                i = end + 3
                continue
            m = TAG.match(s, j)
            if m is None:
                if s[j + 1 : j + 2] in ("!", "?", "/"):
                    end = s.find(">", j)
                    if end < 0:
                        return
                    i = end + 1
                else:
                    if s[j + 1 : j + 2].isalpha() and s.find(">", j) < 0:
                        return  # a tag that never ends
                    self._text("<")
                    i = j + 1
                continue
            i = m.end()
            tag, attributes = (m[1] or m[3]).lower(), m[2] if m[1] else m[4]
            if s[j + 1] == "/":
                self._close(tag)
                continue
            self._start(tag, attributes or "")
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(s, i)
                self._close(tag)
                if end is None:
                    return
                i = s.find(">", end.end()) + 1 or n

    def _text(self, text: str) -> None:
        if not self._skip[self._stack[-1]]:
            self._buffer.append(text)
            if self._links:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join(entities.unescape("".join(self._buffer)).split())
            if text:
                self.blocks.append((text, self._linked, self._owner()))
            self._buffer.clear()
        self._linked = 0

    def _owner(self) -> int:
        at = self._stack[-1]
        while self.tag[at] in INLINE:
            at = self.parent[at]
        return at

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag == "wbr":
            self._text(" " if tag == "br" else "")
            return
        block = tag not in INLINE
        if tag not in IN_LINE:
            self._flush()
            if tag in ENDS_P and self._open.get("p"):
                self._end_in_scope(("p",))
            elif tag in SIBLINGS:
                self._end_in_scope(SIBLINGS[tag])
        if tag in VOID:
            return
        above = self._stack[-1]
        label, noisy = tag, tag in DROPPED
        if attributes and ("class" in attributes or "id" in attributes or "CLASS" in attributes or "ID" in attributes):
            for m in ATTRIBUTE.finditer(attributes):
                value = m[2] or m[3] or m[4] or ""
                words = [w.lower() for w in PARTS.split(CAMEL.sub("-", value)) if w]
                # the page's own body and root are never noise
                noisy |= tag not in ("body", "html", "article", "main") and not NOISE.isdisjoint(words)
                if m[1].lower() == "class":
                    label += "." + ".".join(sorted(DIGITS.sub("0", value.lower()).split()))
        if tag == "header" and not self._open.get("article"):
            noisy = True
        at = len(self.parent)
        self.parent.append(above)
        self.tag.append(tag)
        self._skip.append(self._skip[above] or noisy)
        # inline elements are no containers: they keep the path of what they stand in
        self.path.append(xxhash.xxh64_intdigest(f"{self.path[above]}>{label}") >> 1 if block else self.path[above])
        self._stack.append(at)
        self._open[tag] = self._open.get(tag, 0) + 1
        if tag == "a":
            self._links += 1

    def _close(self, tag: str) -> None:
        if not self._open.get(tag):
            return
        if tag in INLINE:
            # a stray end of a formatting element must not end the blocks inside it
            if self.tag[self._stack[-1]] == tag:
                self._pop()
            elif tag == "a":
                self._links = 0
            return
        if tag not in IN_LINE:
            self._flush()
        while self.tag[self._stack[-1]] != tag:
            self._pop()
        self._pop()

    def _end_in_scope(self, tags: tuple[str, ...]) -> None:
        """End the innermost open element of these tags, unless a scope element stands inside it.

        Formatting elements between them end too, so each is looked at once.
        """
        while True:
            top = self.tag[self._stack[-1]]
            if top in tags:
                self._pop()
                return
            if top in SCOPE or top not in INLINE and top not in ("tr", "td", "th", "p"):
                return
            if not any(self._open.get(t) for t in tags):
                return
            self._pop()

    def _pop(self) -> None:
        at = self._stack.pop()
        self._open[self.tag[at]] -= 1
        if self.tag[at] == "a":
            self._links = max(0, self._links - 1)

    def scores(self) -> dict[int, float]:
        """Score of each path: running text of its blocks, less text in links; nearer blocks count more."""
        out: dict[int, float] = {}
        for text, linked, at in self.blocks:
            value = len(text) - 2 * linked + 20 * text.count(", ")
            while self.tag[at] in LEAF and self.parent[at] >= 0:
                at = self.parent[at]
            for _ in range(LEVELS):
                if at < 0:
                    break
                out[self.path[at]] = out.get(self.path[at], 0) + value * BONUS.get(self.tag[at], 1.0)
                value *= DECAY
                at = self.parent[at]
                while at > 0 and self.tag[at] in INLINE:
                    at = self.parent[at]
        return out

    def holds(self, path: int) -> bool:
        """Whether text stands inside elements of a path; inside the root or html, right under it."""
        inside = [False] * len(self.parent)
        for at in range(1, len(self.parent)):
            inside[at] = inside[self.parent[at]] or self.path[at] == path and self.tag[at] != "html"
        for _, _, at in self.blocks:
            if inside[at]:
                return True
            while self.tag[at] in LEAF and self.parent[at] >= 0:
                at = self.parent[at]
            if self.path[at] == path:
                return True
        return False

    def best(self) -> int | None:
        """Path with the largest score; the smaller number on a tie. None without running text."""
        found = [(-s, p) for p, s in self.scores().items() if s > 0]
        return min(found)[1] if found else None

    def text(self, path: int | None) -> str:
        """Blocks inside elements of a path, widened, in page order; all blocks without a path."""
        inside = [path is None or self.path[0] == path] * len(self.parent)
        if not inside[0]:
            tops = []
            for at in range(1, len(self.parent)):
                above = inside[self.parent[at]]
                inside[at] = above or self.path[at] == path
                if inside[at] and not above:
                    tops.append(at)
            if not any(inside[at] and self.tag[at] == "h1" for _, _, at in self.blocks):
                around = self._around(tops, inside)
                return "\n".join(b[0] for k, b in enumerate(self.blocks) if inside[b[2]] or k in around)
        return "\n".join(text for text, _, at in self.blocks if inside[at])

    def _around(self, tops: list[int], inside: list[bool]) -> set[int]:
        """Numbers of the blocks that belong to the article around the elements `tops`."""
        above = set()
        for at in tops:
            while at >= 0 and at not in above:
                above.add(at)
                at = self.parent[at]
        above.difference_update(tops)
        # units: what stands beside the way from the root to the elements
        unit_of = list(range(len(self.parent)))
        for at in range(1, len(self.parent)):
            if at not in above and self.parent[at] not in above:
                unit_of[at] = unit_of[self.parent[at]]
        units: dict[int, dict[int, list[int]]] = {}
        for k, (_, _, at) in enumerate(self.blocks):
            if not inside[at]:
                unit = unit_of[at]
                units.setdefault(unit if unit in above else self.parent[unit], {}).setdefault(unit, []).append(k)
        out: set[int] = set()
        done = set()
        for at in tops:
            at = self.parent[at]
            while at >= 0 and at not in done:
                done.add(at)
                near, titled = [], False
                for unit, blocks in units.get(at, {}).items():
                    if 2 * sum(self.blocks[k][1] for k in blocks) > sum(len(self.blocks[k][0]) for k in blocks):
                        continue
                    title = self.tag[unit] in HEADINGS or any(self.tag[self.blocks[k][2]] == "h1" for k in blocks)
                    titled |= title
                    near.append((title or unit != at and self.tag[unit] in LEAF, blocks))
                page = self.tag[at] in ("", "html", "body")
                whole = not page and (titled or self.tag[at] in BONUS)
                if titled or not page:
                    out.update(k for leaf, blocks in near if leaf or whole for k in blocks)
                if titled:
                    break
                at = self.parent[at]
        return out


def host_of(url) -> F.Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, least_share: float = 0.1) -> DataFrame:
    """(host, paths): the winning paths of each host, from most to least votes.

    A path wins with least_share of the votes of its host's pages, so a host has 1 / least_share
    of them at most. Votes are counted before they are shuffled, so a host with a third of all pages
    costs no more than another.
    """
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.LongType())])

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_steps(batches, "html"):
            best = [Page(t).best() for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column("host"), pa.array(best, pa.int64())], names=schema.names)

    votes = (
        pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
        .where(F.col("host").isNotNull())
        .mapInArrow(vote, schema)
        .where(F.col("path").isNotNull())
        .groupBy("host", "path")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    return (
        votes.join(total, "host")
        .where(F.col("votes") >= least_share * F.col("total"))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("nth"), "path"))).alias("ranked"))
        .select("host", F.col("ranked.path").alias("paths"))
    )


def extract_main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns of `keep`, text and path (of the container; null if none), one row for each row.

    The table of hosts is written first, so its true size decides whether it is broadcast or joined
    by a shuffle; there is one row per host, so a hot host can be split.
    """
    winners = stored(host_paths(pages), "host-paths")
    schema = T.StructType(
        [pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("path", T.LongType())]
    )

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_steps(batches, "__html"):
            out, used = [], []
            for source, paths in zip(texts, rows.column("paths").to_pylist()):
                page = Page(source)
                there = set(page.path)
                path = next((p for p in paths or () if p in there and page.holds(p)), None)
                path = page.best() if path is None else path
                out.append(page.text(path))
                used.append(path)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in keep), pa.array(out, pa.string()), pa.array(used, pa.int64())], names=schema.names
            )

    return (
        pages.select(*keep, F.col("html").cast("string").alias("__html"), host_of(F.col("url").cast("string")).alias("__host"))
        .join(winners.withColumnRenamed("host", "__host"), "__host", "left")
        .mapInArrow(extract, schema)
    )
