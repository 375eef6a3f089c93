"""Main text of web pages by inferred wrappers.

A host's pages come from few templates. Each page is read as a stream of tokens: block elements with their class words, and
strings. The streams of a host are aligned element by element into one union-free regular expression: elements
correspond if all around them do. Where the streams differ, a child that some lack becomes an optional (...)? group, one
that comes several times in a row of siblings a repeated (...)+ group, and strings that differ a text slot #. What an
alignment of any two wrappers needs are least and largest counts, so that their order does not matter and the alignment is an
aggregate: a host with a third of all pages is combined where its pages are read.

The expression says what each slot is: # text, #links (mostly links), #other (by the host's markup not main text) or #fixed (a
slot within main elements that holds the same strings on nine pages in ten), and after a colon the hashes of the slot's
template strings (outside of main elements, on at least half of the pages with the slot). A page is read against its
host's expression, which alone decides on the strings of every slot it has: strings of text slots stay, but for template strings.
Strings of slots that fewer than PAGES of the host's pages have are not in the expression; there the page's own markup decides.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.shared import cut, stretches

#: Distinct pages of a host that a slot must be on to be in the wrapper, and a string to be part of the template.
PAGES = 3
#: Bytes of all wrappers that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Pages and bytes of html that are read at a time.
ROWS, BYTES = 500, 8 << 20

#: HTML elements by what they mean for text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIPPED = {"script", "style", "head", "title", "nav", "footer", "aside", "form", "noscript", "template", "iframe", "svg", "math", "button", "select", "option", "textarea", "menu", "dialog", "object", "canvas", "audio", "video", "label", "fieldset", "xmp", "noembed", "noframes"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "banner", "banners", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "disqus", "disclaimer", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommendations", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "sponsors", "subscribe", "teaser", "toolbar", "topbar", "widget", "widgets"}
#: Words of a class that say nothing by themselves about what it holds.
HOLDERS = {"area", "articles", "bar", "block", "body", "box", "boxes", "btn", "button", "buttons", "col", "column", "container", "content", "entry", "form", "group", "icon", "icons", "inner", "item", "items", "link", "links", "list", "main", "outer", "panel", "posts", "row", "section", "slot", "stories", "tab", "tabs", "text", "thread", "title", "top", "bottom", "left", "right", "unit", "wrap", "wrapper", "zone"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
MAIN = {"article", "main"}
#: What holds text itself: within a main element its class words say nothing.
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
#: An open p ends where one of these begins; a list item, cell or the like where its kind begins again.
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "option", "caption"} | {"li", "dd", "dt"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_tag = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_attribute = re.compile(r"\b(class|id|role|hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_word = re.compile(r"[a-z]+")
_other = re.compile(r"[^a-z0-9-]")


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def element(name: str, attributes: str, main: bool = False) -> tuple[str, int]:
    """An element's token, and what its markup says: 3 no text, 2 boilerplate by its class, 1 perhaps boilerplate, 0 nothing; main if it is in a main element."""
    level = 3 if name in SKIPPED else 0
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return name, level
    words: list[str] = []
    for key, *values in _attribute.findall(attributes):
        key, value = key.lower(), html.unescape("".join(values)).lower()
        if key == "role":
            level = 3 if value.strip() in ROLES else level
        elif key == "hidden":
            level = 3 if not attributes[: attributes.lower().find("hidden")].rstrip().endswith(("-", "=")) else level
        else:
            words += _word.findall(value)
            if name not in ("html", "body") and not (main and name in PARAGRAPHS):
                level = max(level, *map(class_level, value.split()), 0)
    return ".".join([name, *words[:4]]), level


def class_level(token: str) -> int:
    """2 if what a class names is boilerplate, 1 if boilerplate only qualifies what it names."""
    words = _word.findall(token)
    if not any(w in WORDS for w in words):
        return 0
    named = [w for w in words if w not in HOLDERS]
    return 2 if named and named[-1] in WORDS else 1


def read_page(page: str) -> Iterator[tuple[str, str, int, bool, str]]:
    """Events of a page: kind (open, close, text, break), token, what the markup says of the place (see element), whether it is in a main element, then the text."""
    stack: list[tuple[str, str, int, bool]] = [("", "", 0, False)]  # name, token, level, main

    def pop_to(k: int) -> Iterator[tuple[str, str, int, bool, str]]:
        while len(stack) > k:
            name, token, level, main = stack.pop()
            yield "close", token, level, main, ""

    def last(names: set[str], until: set[str]) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in until:
                return 0
        return 0

    at, n = 0, len(page)
    while at < n:
        found = _tag.search(page, at) if page.find("<", at) >= 0 else None
        stop = found.start() if found else n
        if stop > at:
            yield "text", "#", stack[-1][2], stack[-1][3], html.unescape(page[at:stop])
        if not found:
            break
        at = found.end()
        closing, name, attributes = found.group(1), _other.sub("", (found.group(2) or "").lower()), found.group(3) or ""
        if not name:
            if found.group().startswith("<![CDATA["):
                yield "text", "#", stack[-1][2], stack[-1][3], found.group()[9:].removesuffix("]]>")
            continue
        if closing:
            if name == "br":
                yield "break", "br", stack[-1][2], stack[-1][3], ""
            k = last({name}, set() if name in MAIN or name in ("body", "html") else MAIN - {name})
            if k:
                yield from pop_to(k)
            continue
        if name in VOID:
            yield "break", name, stack[-1][2], stack[-1][3], ""
            continue
        if name in ENDS_P and (k := last({"p"}, BLOCKS - {"p"})):
            yield from pop_to(k)
        if name in SAME and (k := last(SAME[name], HOLDS[name])):
            yield from pop_to(k)
        if name == "body" and (k := last({"head"}, set())):
            yield from pop_to(k)
        _, _, outside, main = stack[-1]
        token, level = element(name, attributes, main)
        if name in MAIN and outside >= 2 and level < 2 and not main:
            # An article does not stand within a menu: that was left open. In an aside there may be one.
            k = next((i for i in range(1, len(stack)) if stack[i][2] >= 2), len(stack))
            if stack[k][0] in ("nav", "footer", "form", "ul", "ol", "li", "a", "p", "span", "head", "header", "title") or name == "main" and stack[k][0] in ("aside", "div", "section"):
                yield from pop_to(k)
                outside = stack[-1][2]
        own_main = main or name in MAIN or "articlebody" in token
        # A page's header is boilerplate, an article's own is not.
        level = max(outside, level, 3 * (name == "header" and not main))
        stack.append((name, token, level, own_main))
        yield "open", token, level, own_main, ""
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            end_at = end.start() if end else n
            at = end_at
    yield from pop_to(1)


class Block(NamedTuple):
    """A string of a page: its place (the block elements around it), the markup's evidence, the text and how much of it is in links."""

    place: str
    level: int
    main: bool
    text: str
    linked: int


def blocks(page: str) -> tuple[list[Block], list[tuple[str, str, int]], bool]:
    """A page's strings in order; for each place and child the number of such children, a row per element that has one; whether there is a main element."""
    out: list[Block] = []
    shape: list[tuple[str, str, int]] = []
    path: list[str] = []  # tokens of the open block elements
    children: list[dict[str, int]] = [{}]
    open_text: list[str] = []
    state, begun = ("", 0, False), False  # place, level and main where the open text begins
    links = linked = 0
    any_main = False

    def end() -> None:
        nonlocal linked, begun
        if open_text:
            if text := " ".join("".join(open_text).split()):
                out.append(Block(*state, text, min(linked, len(text))))
                children[-1]["#"] = children[-1].get("#", 0) + 1
            open_text.clear()
            linked, begun = 0, False

    for kind, token, level, main, text in read_page(page):
        name = token.partition(".")[0]
        if kind == "open":
            any_main |= main and level < 2
            links += name == "a"
            if name in BLOCKS:
                end()
                children[-1][token] = children[-1].get(token, 0) + 1
                path.append(token)
                children.append({})
        elif kind == "close":
            links -= name == "a"
            if name in BLOCKS:
                end()
                place = "/".join(path)
                shape += [(place, child, n) for child, n in children.pop().items()]
                path.pop()
        elif kind == "break":
            if name == "hr":
                end()
            elif name == "br" and open_text:
                open_text.append(" ")
        elif level < 3:
            if not begun:
                state, begun = ("/".join(path), level, main), bool(text.strip())
            open_text.append(text)
            if links:
                linked += len(" ".join(text.split()))
    end()
    return out, shape + [("", child, n) for child, n in children[0].items()], any_main


FACTS = "host string, place string, child string, text long, page long, least long, most long, held long, chars long, linked long, main boolean, has_main boolean, level long"


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_facts(url: str | None, page: str) -> list[tuple]:
    """A page's FACTS: a row per place and child with counts, and a row per place and string."""
    host, key = host_of(url), digest(page)
    found, shape, has_main = blocks(page)
    counts: dict[tuple[str, str], list[int]] = {}
    for place, child, n in shape:
        least, most, held = counts.get((place, child), (n, n, 0))
        counts[place, child] = [min(least, n), max(most, n), held + 1]
    rows = [(host, place, child, None, key, *c, 0, 0, False, has_main, 0) for (place, child), c in counts.items()]
    strings: dict[tuple[str, int, bool, int], list[int]] = {}
    for b in found:
        of = strings.setdefault((b.place, digest(b.text), b.main, b.level), [0, 0])
        of[0] += len(b.text)
        of[1] += b.linked
    return rows + [(host, place, None, text, key, 0, 0, 0, *c, main, has_main, level) for (place, text, main, level), c in strings.items()]


def expression(rows: list[tuple[str, str, int, int, int]], slots: dict[str, str] | None = None) -> str:
    """The wrapper of (place, child, least, most, held) rows as text, children in order of their names, a place's slot as slots has it."""
    below: dict[str, list] = {}
    held_by: dict[str, int] = {}
    for place, child, least, most, held in sorted(rows):
        below.setdefault(place, []).append((child, most, held))
        held_by[f"{place}/{child}" if place else child] = held
    out: list[str] = []
    todo = [("", None)]  # places to be written, and text to be written after what came before
    while todo:
        place, text = todo.pop()
        if text is not None:
            out.append(text)
            continue
        for child, most, held in reversed(below.get(place, [])):
            optional = place != "" and held < held_by.get(place, 0)
            begin, end = "(" * optional + "(" * (most > 1), ")+" * (most > 1) + ")?" * optional
            if child == "#":
                todo.append((place, begin + (slots or {}).get(place, "#") + end))
            else:
                todo += [(place, f"/{child}{end}"), (f"{place}/{child}" if place else child, None), (place, begin + child)]
    return " ".join(out)


def infer(pages: DataFrame, folder: str) -> DataFrame:
    """Wrappers by host: host, wrapper (the union-free expression), main (text is mostly in main elements).

    pages: url, html. Facts are combined before each shuffle, and repeated rows of a page count once.
    """

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FACTS.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in FACTS.split(", ")]
        for batch in batches:
            for part in stretches(batch, 1, ROWS, BYTES):
                rows = [r for url, page in zip(part.column(0).to_pylist(), part.column(1)) for r in page_facts(url, page.as_py() or "")]
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names)

    found = cut(pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(facts, FACTS), f"{folder}/facts")
    texts = found.where("child is null").groupBy("host", "place", "text", "page", "main", "has_main", "level").agg(F.max("chars").alias("chars"), F.max("linked").alias("linked"))
    texts = cut(texts, f"{folder}/texts")
    of = lambda condition: F.sum(F.when(F.expr(condition), F.col("chars")).otherwise(0))
    slots = texts.groupBy("host", "place").agg(
        F.countDistinct("page").alias("pages"), F.count("*").alias("strings"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.sum(F.col("level") * F.col("chars")).alias("levels"), of("main").alias("main_chars"), of("has_main").alias("has_chars"),
        of("main and has_main and level < 2 and 2 * linked <= chars").alias("inside"), of("has_main and level < 2 and 2 * linked <= chars").alias("plain"),
    )
    slots = cut(slots, f"{folder}/slots")
    hosts = slots.groupBy("host").agg((2 * F.sum("inside") >= F.sum("plain")).alias("main"), of("2 * linked <= chars").alias("host_chars"))
    shared = texts.groupBy("host", "place", "text").agg(F.countDistinct("page").alias("here")).where(F.col("here") >= PAGES)
    shared = shared.join(slots.select("host", "place", "pages"), ["host", "place"]).where("2 * here >= pages")
    shared = shared.groupBy("host", "place").agg(F.array_join(F.sort_array(F.collect_list(F.lower(F.hex("text")))), ",").alias("literals"), F.sum(F.expr("if(10 * here >= 9 * pages, here, 0)")).alias("same"))
    marks = slots.where(F.col("pages") >= PAGES).join(hosts, "host").join(shared, ["host", "place"], "left")
    marks = marks.withColumns({"link": F.expr("2 * linked > chars"), "inside": F.expr("2 * main_chars > chars"), "has": F.expr("2 * has_chars > chars"), "level": F.expr("round(levels / chars)")})
    # The slot with most of a host's text is its main text, whatever its class is called, if there are no main elements.
    score = "1 - level + if(has and main, if(inside, 1, -1), 0) - if(link, if(inside, 1, 2), 0) > 0 or (not has and not link and 2 * chars > host_chars)"
    marks = marks.withColumns({"kept": F.expr(score), "fixed": F.expr("inside and coalesce(10 * same >= 9 * strings, false)")})
    # Where most of a host's main text is the same, its pages are copies and tell nothing of a template.
    copies = marks.where("kept and inside").groupBy("host").agg((2 * of("fixed") >= F.sum("chars")).alias("copies"))
    marks = marks.join(copies, "host", "left").withColumn("kind", F.expr("case when not kept then if(link, 'links', 'other') when fixed and not copies then 'fixed' else '' end"))
    marks = marks.select("host", "place", F.lit("#").alias("child"), F.concat(F.lit("#"), "kind", F.expr("if(inside or literals is null, '', concat(':', literals))")).alias("mark"))
    shape = found.where("child is not null").groupBy("host", "place", "child").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("held").alias("held"), F.countDistinct("page").alias("pages"))
    shape = shape.where(F.col("pages") >= PAGES).join(marks, ["host", "place", "child"], "left")

    def write(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group[["place", "child", "least", "most", "held"]].itertuples(index=False, name=None))
        marked = group[group["child"] == "#"]
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [expression(rows, dict(zip(marked["place"], marked["mark"])))]})

    written = shape.groupBy("host").applyInPandas(write, "host string, wrapper string")
    return cut(hosts.select("host", "main").join(written, "host", "left").select("host", F.coalesce("wrapper", F.lit("")).alias("wrapper"), "main"), f"{folder}/wrappers")


_group = re.compile(r"\(|\)[+?]")


class Wrapper(NamedTuple):
    """What a host's expression says of its slots: the slot's mark and template strings by place; main as infer() has it."""

    slots: dict[str, tuple[str, frozenset[str]]] = {}
    main: bool = True

    @classmethod
    def read(cls, wrapper: str, main: bool = True) -> Wrapper:
        """The slots of an expression: a place is in its groups, optional and repeated ones, as often as a page has it."""
        slots, path = {}, []
        for token in _group.sub("", wrapper).split():
            if token.startswith("/"):
                path.pop()
            elif token.startswith("#"):
                mark, _, literals = token.partition(":")
                slots["/".join(path)] = mark, frozenset(literals.split(",")) if literals else frozenset()
            else:
                path.append(token)
        return cls(slots, main)

    def keeps(self, b: Block, has_main: bool) -> bool:
        """Whether a string is main text: by the slot it is in, or by its own markup if the wrapper has no such slot."""
        if b.place in self.slots:
            mark, literals = self.slots[b.place]
            return mark == "#" and not (literals and f"{digest(b.text) & (1 << 64) - 1:x}" in literals)
        return 1 - b.level + (has_main and self.main) * (1 if b.main else -1) > 0


def extract(page: str | None, wrapper: Wrapper = Wrapper()) -> str:
    """A page's main text by its host's wrapper."""
    found, _, has_main = blocks(page or "")
    return "\n".join(b.text for b in found if wrapper.keeps(b, has_main))


def main_text(pages: DataFrame, folder: str) -> DataFrame:
    """Main text of every page.

    pages: page_id, url, html; other columns are not read. Returns page_id, url, text (blocks in page order joined by \\n, white
    space within a block as one blank; empty if there is none or html is null) and n_chars. Repeated rows give repeated
    rows, and count once in the wrapper; a string on just half of the pages with its slot is part of the template; null page_ids stay; a null or malformed url counts as the host ""; pages of any
    length are read whole; an empty table gives no rows.
    """
    wrappers = infer(pages, folder)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    find_host = F.pandas_udf(lambda urls: urls.map(host_of, na_action=None).astype(str), "string")
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0]
    if (size or 0) <= BROADCAST_BYTES:
        wrappers = F.broadcast(wrappers)
    rows = rows.withColumn("host", find_host("url")).join(wrappers, "host", "left").select("page_id", "url", "html", "host", "wrapper", "main")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, Wrapper] = {}
        for batch in batches:
            for part in stretches(batch, 2, ROWS, BYTES):
                texts = []
                for page, host, wrapper, main in zip(part.column(2), part.column(3).to_pylist(), part.column(4), part.column(5)):
                    if host not in read:
                        if len(read) >= 1000:
                            read.clear()
                        # A host without strings has no wrapper.
                        read[host] = Wrapper.read(wrapper.as_py() or "", main.as_py() is not False)
                    texts.append(extract(page.as_py(), read[host]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
