"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is a path of block elements, told apart by tag and first class, and
every element of every page is counted into it. A node has two distributions over its occurrences: the texts that stand
directly in it (content) and the sequences of its children (presentation). The entropy of either, to the base of the
number of occurrences, says how much it varies from page to page. The importance of what stands in a node is SHARE of
its content's and the rest of the presentation's of the element that holds it.

There is a tree of all hosts as well, where the importance is the lesser of two: over all occurrences, and within hosts
(a text that is one for each host is a template however many hosts there are). It judges where a host has seen a node
fewer than SEEN times, and outside the article of pages that name one, where the lesser of both trees' importances
counts. A node that neither has seen SEEN times, the body, and a headline of an article are never judged. A branch of a
page goes if nothing in it reaches LEAST (inside an article or main element: LEAST_INSIDE; outside, on a page that has
one: LEAST_OUTSIDE); what is below and important, or not judged, keeps it.

Besides, elements go that HTML itself defines as no article (NOISE, roles, hidden ones), and reader comments, which vary
like an article and so can't be told by a tree: elements whose class, id or itemprop has the whole word comment or
comments. Of these a form, a dialog or a comments' element that holds the article's element or headline stays.

Pages of one html count once in a host's tree, and once in that of all hosts: copies say nothing about a template.
Trees are tables of counts, aggregated before they are shuffled; no task holds a tree. What goes is sent to the pages
by a checked broadcast, a list a host; where it is larger, each page gets its own branches' list by a join.

Defined results: null html is empty; a page without text has the empty text; a page whose url has no host belongs to
the host of the empty name; rows that repeat a page are rows of their own. An empty table gives an empty result. Only
page_id, url and html are looked at. Raw text of script and style ends only at its own end tag, or the page; an
attribute's quotes may hold any character; where a tag has no end outside quotes, the rest of the page is read without
minding quotes. Pages are read in time linear in their length, however deeply elements nest.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import _shared

SHARE, LEAST, SEEN = 0.9, 0.6, 20
#: Inside an element that says it is the article, a branch goes only below this importance; outside, it must vary almost as prose does.
LEAST_INSIDE, LEAST_OUTSIDE = 0.2, 0.8
#: Removed nodes of all hosts are sent to all tasks up to so many (8 bytes each, and a host's name a host).
SENT = 1_000_000
#: Elements that begin and end a block, those without content, those whose text is none, and those that are no article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset head "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
WITHOUT_TEXT = frozenset("noscript template iframe noembed noframes svg math object select button canvas audio video".split())
NOISE = frozenset("nav aside footer form menu dialog head search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
COMMENTS = frozenset(("comment", "comments"))
#: What an opening tag closes that was left open, up to the element that holds it.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {tag: (gone.split(), holders.split()) for tag, (gone, holders) in CLOSES.items()}

NAME = re.compile(r"/?+[a-zA-Z][^\s/>]*+")
TAG_END = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^<>]*+>?", re.I) for tag in RAW | WITHOUT_TEXT}

#: Where a node is: outside or inside the article of a page that names one, on a page that names none, or never judged.
OUTSIDE, INSIDE, ALONE, NEVER = 0, 1, 2, 3
CONTENT, STYLE = 0, 1


def tokens(page: str) -> Iterator[tuple[str | None, str]]:
    """(None, text) and (tag in lower case, with / before an end tag's; what follows the name), in order."""
    at, end, quotes = 0, len(page), True
    endless: set[str] = set()  # elements without text that no end tag follows any more
    while at < end:
        opens = page.find("<", at)
        if opens < 0:
            opens = end
        if opens > at:
            yield None, page[at:opens]
        if opens == end:
            return
        at = opens + 1
        name = NAME.match(page, at)
        if name is None:
            if page.startswith("!--", at):
                shut = page.find("-->", at + 3)
                at = end if shut < 0 else shut + 3
            elif page.startswith(("!", "?"), at):
                at = page.find(">", at) + 1
                if not at:
                    yield None, page[opens:]
                    return
            else:
                yield None, "<"
            continue
        tag, stop = name[0].lower(), -1
        if quotes:
            found = TAG_END.match(page, name.end())
            quotes, stop = found is not None, found.end() if found else -1
        if not quotes:
            stop = page.find(">", name.end()) + 1
            if not stop:
                yield None, page[opens:]
                return
        at = stop
        if tag in RAW or tag in WITHOUT_TEXT and tag not in endless:
            if shut := _ENDS[tag].search(page, at):
                at = shut.end()
            elif tag in RAW:
                return
            else:
                endless.add(tag)
            continue
        yield tag, page[name.end() : stop - 1]


class Page:
    """The block elements of a page, parents before children, and its texts.

    For each element: tag, path (hash of its names from the root on, and of whether the page names its article), up (its
    parent's number), name, noise and inside; blocks: (number of the element around it, text with its white space joined).
    """

    def __init__(self, page: str):
        self.tags, self.up, self.names, self.inside = [""], [-1], [""], [False]
        self.blocks: list[tuple[int, str]] = []
        self._stack: list[int] = [0]
        self._open: dict[str, list[int]] = {}  # tag -> depths in the stack
        self._own: list[tuple[bool, bool]] = [(False, False)]  # says that it is no article; not if it holds one
        held: list[str] = []
        for tag, more in tokens(page):
            if tag is None:
                held.append(more)
                continue
            name = tag.lstrip("/")
            if name == "br":
                held.append(" ")
            if name not in BLOCKS:
                continue
            self._flush(held)
            if tag[0] == "/":
                if self._open.get(name):
                    self._close(self._open[name][-1])
            elif name not in VOID:
                self._begin(name, more)
        self._flush(held)
        self._settle()

    def _flush(self, held: list[str]) -> None:
        if held and (text := " ".join(entities.unescape("".join(held)).split())):
            self.blocks.append((self._stack[-1], text))
        held.clear()

    def _close(self, depth: int) -> None:
        for node in self._stack[depth:]:
            self._open[self.tags[node]].pop()
        del self._stack[depth:]

    def _deepest(self, tags: list[str]) -> int:
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)

    def _begin(self, tag: str, more: str) -> None:
        if tag in CLOSES:
            gone, holders = CLOSES[tag]
            depth = self._deepest(gone)
            if depth > self._deepest(holders):
                self._close(depth)
        if self.tags[self._stack[-1]] == "p":  # any block ends a paragraph
            self._close(len(self._stack) - 1)
        if tag == "body" and self._open.get("head"):  # what is left open in the head ends here
            self._close(self._open["head"][0])
        up, style = self._stack[-1], ""
        noise, unless = tag in NOISE, tag in ("form", "dialog")
        if tag == "header":  # an article's own header is its headline
            noise = not self.inside[up]
        if more.strip(" /"):
            for m in ATTRIBUTE.finditer(more):
                key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if key in ("class", "id", "itemprop"):
                    words = value.split()
                    if key == "class" and words:
                        style = re.sub(r"\d+", "", words[0])
                    if not noise and not COMMENTS.isdisjoint(words):
                        noise = unless = True
                elif key == "role" and value in NOISE_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                    noise, unless = True, False
        if tag in ("html", "body", "main", "article"):
            noise = False
        name = f"{tag}.{style}" if style else tag
        node = len(self.tags)
        self.tags.append(tag)
        self.up.append(up)
        self.names.append(name)
        self.inside.append(self.inside[up] or tag in ("article", "main"))
        self._own.append((noise, unless))
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(node)

    def _settle(self) -> None:
        """Noise goes down to all that an element holds; a form, dialog or comments' element that holds an article is none."""
        self.named = any(self.inside)
        self.paths = [int(self.named)]
        for k in range(1, len(self.tags)):
            self.paths.append(xxhash.xxh3_64_intdigest(f"{self.paths[self.up[k]]}/{self.names[k]}".encode("utf-8", "surrogatepass")) - (1 << 63))
        holds = [t in ("main", "h1") or t == "article" for t in self.tags]
        main = [t in ("main", "h1") for t in self.tags]
        for k in range(len(self.tags) - 1, 0, -1):
            holds[self.up[k]] |= holds[k]
            main[self.up[k]] |= main[k]
        self.noise = [False] * len(self.tags)
        for k in range(1, len(self.tags)):
            noise, unless = self._own[k]
            # readers' comments are often articles themselves
            article = holds[k] if self.tags[k] in ("form", "dialog") else main[k]
            self.noise[k] = noise and not (unless and article) or self.noise[self.up[k]]

    def text(self, removed: frozenset[int] | set[int]) -> str:
        """The blocks outside noise and outside the branches of which all nodes are among the removed, joined by line ends."""
        kept = [False] * len(self.tags)
        for k, _ in self.blocks:
            kept[k] = kept[k] or not self.noise[k] and self.paths[k] not in removed
        for k in range(len(self.tags) - 1, 0, -1):
            kept[self.up[k]] |= kept[k]
        return "\n".join([text for k, text in self.blocks if kept[k] and not self.noise[k]])

    def occurrences(self) -> dict[tuple[int, int, int, int, int], int]:
        """(path, its parent's path, place, kind, hash of the content or presentation) -> how often, for all nodes."""
        children: list[list[str]] = [[] for _ in self.tags]
        for k in range(1, len(self.tags)):
            children[self.up[k]].append(self.names[k])
        found: dict[tuple[int, int, int, int, int], int] = {}
        values = [(k, CONTENT, t) for k, t in self.blocks] + [(k, STYLE, "\0".join(c)) for k, c in enumerate(children)]
        for k, kind, value in values:
            never = self.tags[k] in ("", "html", "body") or self.inside[k] and self.tags[k] == "h1"
            place = NEVER if never else INSIDE if self.inside[k] else OUTSIDE if self.named else ALONE
            key = self.paths[k], self.paths[self.up[k]] if k else 0, place, kind, xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)
            found[key] = found.get(key, 0) + 1
        return found


def host(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


NODES = "array<struct<path:long,parent:long,place:int,kind:int,value:long,n:int>>"


def styles(pages: DataFrame) -> DataFrame:
    """host, payload (hash of the html) and nodes of every page, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "parent", "place", "kind", "value", "n"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        for batch in batches:
            found, ends = [], [0]
            for page in batch.column(2):
                found += [(*k, n) for k, n in Page(page.as_py() or "").occurrences().items()]
                ends.append(len(found))
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], t) for t in kinds]
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes], ["host", "payload", "nodes"])

    rows = pages.select(host().alias("host"), F.xxhash64("html").alias("payload"), "html")
    return _shared.spilled(rows.mapInArrow(run, f"host string, payload long, nodes {NODES}"), "styles")


def _weighed(rows: DataFrame) -> DataFrame:
    """host, nodes, copies (rows of the host with that payload) and every (rows of the table with it); null: one."""
    own = rows.groupBy("payload", "host").agg(F.count(F.lit(1)).alias("copies"))
    every = own.groupBy("payload").agg(F.sum("copies").alias("every")).where("every > 1")
    many = _shared.stable(own.join(every, "payload").select(F.xxhash64("payload", "host").alias("key"), "copies", "every"))
    keyed = rows.select("host", "nodes", F.xxhash64("payload", "host").alias("key"))
    return keyed.join(F.broadcast(many), "key", "left") if many.count() <= SENT else _shared.attach(keyed, many, "key")


def _spread(m: Column, logs: Column) -> Column:
    """The entropy of counts n to the base of their sum m; logs: the sum of n * log(n). One occurrence varies in full."""
    return F.when(m > 1, (F.log(m) - logs / m) / F.log(m)).otherwise(F.lit(1.0))


def importances(rows: DataFrame, share: float = SHARE, seen: int = SEEN) -> DataFrame:
    """styles() -> host, path, place and importance (null: not judged) of all nodes that a text stands in."""
    node = F.explode("nodes").alias("x")
    n = _weighed(rows).select("host", "copies", "every", node).select("host", "x.*", (F.col("x.n") / F.coalesce("copies", F.lit(1))).alias("own"), (F.col("x.n") / F.coalesce("every", F.lit(1))).alias("of_all"))
    # the shares of a payload's copies add up to one
    values = n.groupBy("path", "parent", "place", "kind", "value", "host").agg(F.round(F.sum("own")).alias("n"), F.sum("of_all").alias("of_all"))
    values = _shared.spilled(values, "values")
    nodes = values.groupBy("host", "path", "parent", "place", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("logs"))
    nodes = _shared.spilled(nodes.withColumn("h", _spread(F.col("m"), F.col("logs"))), "nodes")
    full = F.col("m") * F.log("m")
    several = F.sum(F.when(F.col("m") > 1, F.col("m")))
    within = nodes.groupBy("path", "kind").agg(F.when(several >= seen, F.sum(full - F.col("logs")) / F.sum(full)).alias("within"))
    whole = values.groupBy("path", "kind", "value").agg(F.round(F.sum("of_all")).alias("n")).groupBy("path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("logs"))
    every = whole.where(F.col("m") >= seen).select("path", "kind", _spread(F.col("m"), F.col("logs")).alias("whole"))
    every = every.join(within, ["path", "kind"]).select("path", "kind", F.least("whole", "within").alias("all_h"))
    # common paths are in every host: hot keys of this join
    keyed = nodes.withColumn("key", F.xxhash64("path", "kind"))
    known = _shared.stable(every.select(F.xxhash64("path", "kind").alias("key"), "all_h"))
    judged = keyed.join(F.broadcast(known), "key", "left") if known.count() <= SENT else _shared.attach(keyed, known, "key")
    own = F.when(F.col("m") >= seen, F.col("h"))
    h = F.when(F.col("place") == OUTSIDE, F.least(own, "all_h")).otherwise(F.coalesce(own, "all_h"))
    judged = judged.select("host", "path", "parent", "place", "kind", h.alias("h"))
    # what stands in a node is shown by the element that holds it
    content = judged.where(F.col("kind") == CONTENT).select("host", "path", "parent", "place", F.col("h").alias("content"))
    style = judged.where(F.col("kind") == STYLE).select("host", F.col("path").alias("parent"), F.col("h").alias("style"))
    both = content.join(style, ["host", "parent"], "left")
    return both.select("host", "path", "place", (share * F.col("content") + (1 - share) * F.coalesce("style", F.lit(1.0))).alias("importance"))


def trees(rows: DataFrame, share: float = SHARE, least: float = LEAST, seen: int = SEEN) -> DataFrame:
    """styles() -> host, path: the nodes without importance."""
    bound = F.when(F.col("place") == INSIDE, LEAST_INSIDE).when(F.col("place") == OUTSIDE, LEAST_OUTSIDE).when(F.col("place") == ALONE, least)
    return _shared.stable(importances(rows, share, seen).where(F.col("importance") < bound).select("host", "path"))


def extract(pages: DataFrame, share: float = SHARE, least: float = LEAST, seen: int = SEEN, sent: int = SENT) -> DataFrame:
    """page_id, url, text for every row of pages."""
    _shared.ship(pages.sparkSession)
    stored = styles(pages)
    gone = trees(stored, share, least, seen)
    rows = pages.select("page_id", "url", "html", host().alias("host"))
    listed = F.collect_set("path").alias("removed")
    if gone.count() <= sent:
        rows = rows.join(F.broadcast(gone.groupBy("host").agg(listed)), "host", "left")
    else:
        own = stored.select("host", "payload", F.explode(F.array_distinct(F.transform("nodes", lambda x: x["path"]))).alias("path")).distinct()
        own = own.withColumn("key", F.xxhash64("host", "path"))
        gone = gone.select(F.xxhash64("host", "path").alias("key"), F.lit(True).alias("low"))
        hits = _shared.attach(own, gone, "key").where("low").groupBy(F.xxhash64("host", "payload").alias("page")).agg(listed)
        rows = _shared.attach(rows.withColumn("page", F.xxhash64("host", F.xxhash64("html"))), hits, "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, removed in zip(batch.column(2), batch.column(3), strict=True):
                texts.append(Page(page.as_py() or "").text(set(np.asarray(removed.values).tolist()) if removed.is_valid else set()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    schema = pages.select("page_id", "url").schema.add("text", "string")
    return rows.select("page_id", "url", "html", "removed").mapInArrow(run, schema)
