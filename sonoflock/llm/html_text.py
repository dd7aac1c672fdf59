"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: a node of the tree stands for all elements of the same
place, that is of the same chain of tags (with class and id), menus and footers like articles.
For each node the tree counts the pages that have it, the different presentations (the sequence
of child elements) and the different contents. With m pages the importance of presentation and
of content is their entropy to the base m: 1 where every page differs, 0 where all are the
same. A node with l presentations has the importance (1 - g**l) * presentation + g**l * content,
g = 0.9, or that of its content if that is higher: a template doesn't make an article less
important. A node on one page only has importance 1. Plain text elements (paragraphs, headings,
lists, tables and the like that carry no class or id) stand side by side in one place, so each
content of theirs counts by itself, and is noise if half of the host's pages have it.

From `enough` different pages on the tree decides: what remains of the body once branches of low
importance are cut is the text. What is low follows from the number m of pages that have the
branch: contents that are each on `shared` pages have the entropy 1 - log(shared) / log(m), and
branches below it go. A branch that its tag or class names as layout (nav, header, footer,
sidebar, notice ...) must be nearly as different as the pages themselves to stay
(`named_shared`), not be mostly links, and be on `overruling` pages: fewer of them may well be all
different by chance if there are a thousand variants of a footer. Of fewer pages than that (five) entropies say nothing: there the names decide,
and the article or main element is the text if there is one. What the text must not hold however
different it is from page to page (forms, adverts, comments, hidden parts, scripts) goes by its
name everywhere.

A name is telling if one of its words joined by hyphens is made of such words alone (`comments`,
`ad-box`), and none of them has other uses (`discussion`, `related`, `search`). Any other name
with such a word (`related-work`) counts as layout outside of article and main elements; within
them it counts if the branch is mostly links or holds form controls, else the tree alone decides.
A header within an article is part of it. Attributes are read whole: only `hidden` itself, and a
style that hides, hide an element. Body and html never go.

Each different page of a host counts once: pages of one text (without what names cut) are copies,
and say nothing about what is the same on all pages. On hosts with fewer than five different
pages, branches of low importance over all rows are cut only if they are bare text, without
paragraphs or the like, and together hold less than half of the text around them. Article and
main elements are never cut; a page whose tree would leave no text is treated as on a small host.

The counts are aggregated in two steps, first by (host, node, content), so that a host with a
third of all pages is no hot key. What is sent of a page is the 64-bit hashes of its places and
contents. The table of branches is as large as the number of different places in pages; Spark
joins it to the pages by host, and broadcasts it only if its size, known as it is written to
files, is below the session's threshold. The work on a page follows its length, however deep
its elements are nested.

Text: character references are decoded, white space within a block becomes one space, blocks
are trimmed and joined by two newlines in page order, empty ones are left out.

Defined results: null html is empty and has an empty text; null urls are a host of their own;
each row has its text, copies too; pages may be cut off anywhere; empty tables give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoflock.llm.common import lean, materialise

LEAST_PAGES, ENOUGH, OVERRULING, GAMMA = 5, 5, 50, 0.9
#: Branches whose contents are each on so many pages, by entropy, go; named ones sooner.
SHARED, NAMED_SHARED, SURE_IMPORTANCE = 1.5, 1.1, 0.2

# The kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe object canvas audio video xmp noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li", "summary"} | {"li", "dd", "dt"}
ROOTS = set("article main body html".split())
LAYOUT = set("nav header footer aside menu".split())
LAYOUT_ROLES = set("navigation banner contentinfo complementary menu menubar".split())
LAYOUT_WORDS = set(
    "banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot sidebar side aside widget notice notices"
    " cookie cookies consent gdpr share sharing social pagination pager toolbar copyright legal skip".split()
)
NEVER = set("form head dialog button select label fieldset input".split())
CONTROLS = set("input select textarea button".split())
#: Within these a button or label is part of a sentence.
SENTENCE = set("p h1 h2 h3 h4 h5 h6 dd dt blockquote b i em strong span a u q cite code mark small sub sup kbd".split())
#: Words that say nothing, and words of layout that articles use as well.
GENERIC = set(
    "list area section box wrapper wrap container block item items inner outer content bar panel group row col column title heading"
    " link links post posts article articles page site user users reader readers widget slot unit top bottom left right main global"
    " primary secondary mobile desktop thread message form button text big small js".split()
)
AMBIGUOUS = set("discussion related recommended alert legal foot search form notice notices share social skip reply replies header side banner hidden".split())
NEVER_ROLES = set("search form dialog alert alertdialog".split())
NEVER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion popup modal overlay alert"
    " comment comments respond reply replies disqus discussion related recommended newsletter subscribe signup login search form"
    " hidden".split()
)
PLAIN = set("article main body html p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption".split())

TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.IGNORECASE)
DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"[a-z]+")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


@dataclass(slots=True)
class Node:
    tag: str
    place: int  # a hash of the chain of tags, classes and ids
    plain: bool  # no class, no id
    layout: bool = False  # by its name part of the layout
    cut: bool = False  # goes; at first if its name says that it is never text
    hint: bool = False  # within an article, of a name that what it holds must confirm
    children: list = field(default_factory=list)  # nodes and strings
    content: int = 0  # a hash of what is in it, 0 if nothing
    rich: bool = False  # holds plain text elements

    def leaf(self) -> int:
        """A plain element's place and content."""
        return hash64(self.place.to_bytes(8, "little") + self.content.to_bytes(8, "little"))


def hash64(x: bytes) -> int:
    return xxhash.xxh3_64_intdigest(x)


def names(value: str) -> tuple[bool, bool, bool]:
    """What a class or id says: never text, layout, or perhaps one of them."""
    never = layout = perhaps = False
    for token in value.split():
        words = WORDS.findall(token)
        found = [w for w in words if w in NEVER_WORDS or w in LAYOUT_WORDS]
        if not found:
            continue
        if AMBIGUOUS.isdisjoint(words) and all(w in GENERIC for w in words if w not in found):
            never |= not NEVER_WORDS.isdisjoint(words)
            layout = True
        else:
            perhaps = True
    return never, layout, perhaps


def element(tag: str, attrs: str, parent: Node, inside: bool) -> Node:
    """inside: whether it stands in an article or main element."""
    mark, hint = "", False
    layout, never = tag in LAYOUT and not (inside and tag == "header"), tag in NEVER
    if never and tag in ("button", "label") and parent.tag in SENTENCE:
        never = False
    if attrs:
        for name, *values in ATTR.findall(attrs):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or (name == "style" and HIDES.search(value)):
                never = True
            elif name == "role" and tag not in ROOTS:
                layout |= value in LAYOUT_ROLES
                never |= value in NEVER_ROLES
            elif name in ("class", "id"):
                if tag not in ROOTS:
                    cut, named_so, perhaps = names(value)
                    never |= cut
                    layout |= named_so or (perhaps and not inside)
                    hint |= perhaps and inside
                mark += "." + DIGITS.sub("0", value)
    place = hash64(parent.place.to_bytes(8, "little") + f"{tag}{mark}".encode(errors="replace"))
    return Node(tag, place, not mark, layout, never and tag not in ("body", "html"), hint)


def menus(root: Node) -> tuple[set[int], set[int]]:
    """The elements that are mostly links, and those that hold form controls, by id()."""
    linked, controls = set(), set()
    held: dict[int, tuple[int, int, bool]] = {}  # characters, those in links, controls
    for x in reversed(list(walk(root))):  # children before their parents
        size = in_links = 0
        has = x.tag in CONTROLS
        for c in x.children:
            if isinstance(c, str):
                size += len(c.strip())
            else:
                n, m, controlled = held.pop(id(c))
                size, in_links, has = size + n, in_links + m, has or controlled
        in_links = size if x.tag == "a" else in_links
        if 2 * in_links > size:
            linked.add(id(x))
        if has:
            controls.add(id(x))
        held[id(x)] = (0, 0, has) if x.tag in RAW else (size, in_links, has)
    return linked, controls


def confirm(root: Node) -> None:
    """Cut branches of a hinting name that are mostly links or hold form controls."""
    linked, controls = menus(root)
    for x in walk(root):
        if x.hint and (id(x) in linked or id(x) in controls):
            x.cut = True


def parse(html: str) -> Node:
    """The tree of a page, with what names cut. Tags that HTML lets out are closed where they must end; a tag without
    its end lasts as long as its parent; stray end tags count for nothing."""
    root = Node("", 0, True)
    stack, open_tags = [root], Counter()
    at, n, hints = 0, len(html), False

    def leave(k: int) -> None:
        for x in stack[k:]:
            open_tags[x.tag] -= 1
        del stack[k:]

    def close(tags: set[str], within: set[str]) -> None:
        if not any(open_tags[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                leave(k)
                return
            if stack[k].tag in within:
                return

    while at < n:
        m = TAG.search(html, at)
        if not m:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[k].tag == tag:
                    leave(k)
                    break
                if stack[k].tag in ("article", "main", "body", "td", "table") and tag not in BLOCK:
                    break
            continue
        if tag in CLOSES_P:
            close({"p"}, {"td", "th", "button", "div", "article", "section", "li", "blockquote"})
        if tag == "li":
            close({"li"}, {"ul", "ol", "menu"})
        elif tag in ("dd", "dt"):
            close({"dd", "dt"}, {"dl"})
        elif tag in ("td", "th"):
            close({"td", "th"}, {"tr", "table"})
        elif tag == "tr":
            close({"tr"}, {"table"})
        elif tag in ("body", "html") and open_tags[tag]:
            continue
        elif tag == "body":
            close({"head"}, {"html"})
        node = element(tag, m["attrs"], stack[-1], open_tags["article"] + open_tags["main"] > 0)
        hints |= node.hint
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and not m["attrs"].endswith("/"):
            stack.append(node)
            open_tags[tag] += 1
    if hints:
        confirm(root)
    return root


def walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]


def goes(x: Node) -> bool:
    return x.cut


def named(x: Node) -> bool:
    """Whether a branch goes as far as names say."""
    return x.cut or x.layout


def blocks(node: Node, out_of: Callable[[Node], bool]) -> list[str]:
    """The texts of the blocks of a branch, in page order, without branches that are out."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is None:
            flush()
        elif x is not node and (x.tag in RAW or out_of(x)):
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br" or x.tag == "wbr":
            parts.append(" " if x.tag == "br" else "")
        else:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return out


def settle(root: Node) -> None:
    """Hash the contents of all branches, from the leaves up; scripts and what is never text
    hold nothing."""
    for x in reversed(list(walk(root))):  # children before their parents
        if x.tag in RAW or (x.cut and x.tag not in ROOTS):
            continue
        parts = []
        for c in x.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                if text:
                    parts.append(text.encode(errors="replace"))
            else:
                x.rich |= c.rich or c.tag in PLAIN
                if c.content:
                    parts.append(c.content.to_bytes(8, "little"))
        if parts:
            x.content = hash64(b"\0".join(parts)) | 1


def cut_asides(root: Node, weak: set[int]) -> None:
    """Cut branches of bare text, where they are the smaller part of what is around them."""
    todo: list[tuple[Node, Node]] = [(root, root)]
    found: dict[int, tuple[Node, list[Node]]] = {}
    while todo:
        x, around = todo.pop()
        if named(x) or x.tag in RAW:
            continue
        if x.tag in ("article", "main", "body"):
            around = x
        elif x.place in weak and not x.rich and x.tag not in PLAIN:
            found.setdefault(id(around), (around, []))[1].append(x)
            continue
        todo += [(c, around) for c in x.children if isinstance(c, Node)]
    for around, asides in found.values():
        if 2 * sum(len(t) for x in asides for t in blocks(x, named)) < sum(map(len, blocks(around, named))):
            for x in asides:
                x.cut = True


def outermost(root: Node, tag: str, out_of: Callable[[Node], bool]) -> list[Node]:
    """The elements of a tag that aren't within another or within a branch that is out."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.cut if x.tag in ROOTS else x.tag in RAW or out_of(x):
            continue
        if x.tag == tag:
            found.append(x)
        else:
            todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    return found


@dataclass
class Host:
    """What the tree of a host says: branches that go, named ones that stay, contents of plain
    elements that go, bare branches that may go; and whether it is large enough to decide."""

    low: frozenset[int] = frozenset()
    kept: frozenset[int] = frozenset()
    repeated: frozenset[int] = frozenset()
    weak: frozenset[int] = frozenset()
    enough: bool = False


def main_text(html: str | None, host: Host) -> str:
    root = parse(html or "")
    if host.repeated or host.weak:
        settle(root)
    if host.weak:
        cut_asides(root, set(host.weak))

    linked: list[set[int]] = []

    def menu(x: Node) -> bool:
        if not linked:
            linked.append(menus(root)[0])
        return id(x) in linked[0]

    def out_of(x: Node) -> bool:
        if x.tag in ROOTS or x.cut:
            return x.cut
        if x.place in host.low or (x.layout and not (host.enough and x.place in host.kept and not menu(x))):
            return True
        return bool(host.repeated) and x.plain and x.tag in PLAIN and x.leaf() in host.repeated

    if host.enough:
        text = "\n\n".join(blocks(root, out_of))
        if text:
            return text
    for tag in ("article", "main"):
        found = outermost(root, tag, out_of)
        texts = [t for x in found for t in blocks(x, out_of)] or [t for x in found for t in blocks(x, named)]
        if texts:
            return "\n\n".join(texts)
    return "\n\n".join(blocks(root, out_of))


def same_text(root: Node) -> int:
    """A hash that is the same for copies of a page."""
    return hash64("\n".join(blocks(root, named)).encode(errors="replace"))


BRANCH, CONTENT, LEAF = 0, 1, 2
LISTS = ("low", "kept", "repeated", "weak")


def unsigned(places: list[int] | None) -> frozenset[int]:
    return frozenset(x % (1 << 64) for x in places or ())


def places(root: Node) -> list[tuple[int, int, int]]:
    """(kind, place, value) of a page: hashes of the presentation and of the content of each
    place, of all elements there taken together, and each plain element with its content."""
    settle(root)
    branches: dict[int, tuple[int, int]] = {}
    leaves: set[int] = set()
    for x in walk(root):
        if x.tag not in BLOCK or x.tag in ROOTS or not x.content:
            continue
        if x.plain and x.tag in PLAIN:
            leaves.add(x.leaf())
            continue
        shape, content = branches.get(x.place, (0, 0))
        tags = ",".join(c.tag for c in x.children if isinstance(c, Node))
        branches[x.place] = (
            hash64(shape.to_bytes(8, "little") + tags.encode(errors="replace")),
            hash64(content.to_bytes(8, "little") + x.content.to_bytes(8, "little")),
        )
    out = [(kind, place, both[kind]) for place, both in branches.items() for kind in (BRANCH, CONTENT)]
    return sorted(out + [(LEAF, x, 0) for x in leaves])


def different_pages(pages: DataFrame) -> DataFrame:
    """(host, page, places, copies): each different page of pages (host, html) once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, packed = [], []
            for html in batch.column("html").to_pylist():
                root = parse(html or "")
                texts.append(same_text(root))
                packed.append(np.array(places(root), np.uint64).tobytes())
            page = pa.array(np.array(texts, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("host"), page, pa.array(packed, pa.binary())], ["host", "page", "places"])

    each = pages.mapInArrow(lean(read), "host string, page long, places binary")
    return each.groupBy("host", "page").agg(F.min("places").alias("places"), F.count(F.lit(1)).alias("copies"))


def seen_places(different: DataFrame) -> DataFrame:
    """(host, kind, place, value, c, r): how many different pages, and how many rows, have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in batch.column("places").to_pylist()]
            of = pa.array(np.repeat(np.arange(len(rows)), [len(x) for x in rows]))
            kind, place, value = np.concatenate([np.zeros((0, 3), np.int64), *rows]).T
            columns = [batch.column("host").take(of), pa.array(kind.astype(np.int32)), pa.array(place), pa.array(value)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("copies").take(of)], ["host", "kind", "place", "value", "copies"])

    seen = different.select("host", "places", "copies").mapInArrow(
        lean(count), "host string, kind int, place long, value long, copies long"
    )
    return seen.groupBy("host", "kind", "place", "value").agg(F.count(F.lit(1)).alias("c"), F.sum("copies").alias("r"))


def trees_of(values: DataFrame) -> DataFrame:
    """(host, place, n_pages, importance, n_rows, row_importance) of branches: over the different
    pages, and over all rows."""
    shape, content = F.col("kind") == BRANCH, F.col("kind") == CONTENT

    def entropy(which, count):
        c, m = F.when(which, F.col(count)), F.sum(F.when(which, F.col(count)))
        h = F.log(m) - F.sum(c * F.log(c)) / m
        return F.when(m > 1, F.greatest(h, F.lit(0.0)) / F.log(m)).otherwise(1.0)

    weight = F.pow(F.lit(GAMMA), F.sum(F.when(shape, 1).otherwise(0)))

    def importance(count):
        mixed = (1 - weight) * entropy(shape, count) + weight * entropy(content, count)
        return F.greatest(entropy(content, count), mixed)

    return values.where(F.col("kind") != LEAF).groupBy("host", "place").agg(
        F.sum(F.when(content, F.col("c"))).alias("n_pages"),
        importance("c").alias("importance"),
        F.sum(F.when(content, F.col("r"))).alias("n_rows"),
        importance("r").alias("row_importance"),
    )


def style_trees(pages: DataFrame) -> DataFrame:
    """trees_of the different pages among pages (host, html)."""
    return trees_of(seen_places(different_pages(pages)))


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_pages: int = LEAST_PAGES,
    enough: int = ENOUGH,
    overruling: int = OVERRULING,
    shared: float = SHARED,
    named_shared: float = NAMED_SHARED,
    sure_importance: float = SURE_IMPORTANCE,
) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), HOST, 1), F.lit("")))
    read = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host")
    )
    different = materialise(different_pages(read.select("host", "html")), "different-pages")
    hosts = materialise(different.groupBy("host").agg(F.count(F.lit(1)).alias("m")), "hosts")
    values = materialise(seen_places(different), "seen-places")
    known, sure = F.col("n_pages") >= enough, F.col("importance") < sure_importance

    def entropy_of(pages_each: float):
        return 1 - F.lit(math.log(pages_each)) / F.log("n_pages")

    low = (known & (F.col("importance") < entropy_of(shared))) | ((F.col("n_pages") >= least_pages) & sure)
    kept = (F.col("n_pages") >= overruling) & (F.col("importance") >= entropy_of(named_shared))
    weak = (F.col("m") < least_pages) & (F.col("n_rows") >= least_pages) & (F.col("row_importance") < sure_importance)
    branches = trees_of(values).join(hosts, "host").where(low | kept | weak)
    leaves = values.where(F.col("kind") == LEAF).where(F.col("c") >= least_pages).join(hosts, "host").where(F.col("c") * 2 >= F.col("m"))

    def listed(which):
        return F.sort_array(F.collect_set(F.when(which, F.col("place"))))

    lists = branches.groupBy("host").agg(listed(low).alias("low"), listed(kept).alias("kept"), listed(weak).alias("weak"))
    repeated = leaves.groupBy("host").agg(F.sort_array(F.collect_set("place")).alias("repeated"))
    by_host = hosts.join(lists, "host", "left").join(repeated, "host", "left")
    by_host = materialise(by_host.withColumn("enough", F.col("m") >= enough).drop("m"), "low-branches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, Host] = {}
            texts = []
            for k, html in enumerate(batch.column("html").to_pylist()):
                name = batch.column("host")[k].as_py()
                if name not in found:
                    lists = (unsigned(batch.column(x)[k].as_py()) for x in LISTS)
                    found[name] = Host(*lists, bool(batch.column("enough")[k].as_py()))
                texts.append(main_text(html, found[name]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    joined = read.join(by_host, "host", "left").select("page_id", "url", "html", "host", *LISTS, "enough")
    kind = read.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(lean(run), f"page_id {kind}, url string, text string, n_chars long")
