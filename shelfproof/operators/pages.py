"""Retained pages as tables of elements.

One Arrow function reads a page into a list of its elements; everything after
it is column expressions over that list.  A page is one row, so no extraction
step shuffles, and the same code runs on a stream of pages.

``nodes`` holds the visible text nodes of a page.  An element carries the range of ``nodes`` it
covers, so the text of any element is a slice and no text is stored twice.

``idx`` leads from a token (``#id``, ``.class``, ``[hook=x]``, a tag) to the elements that carry it, in
page order, for the tokens that the selectors of a plan name.  An element is its place in
``els`` and covers the places up to its ``last``, so a selector reads a few numbers and compares
them with ranges, however many elements the page has.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfproof.functions.text import clean
from shelfproof.functions.values import cases, expr, filled, let, lit, nth
from shelfproof.rules import locale as L

SEPARATOR = "\x1f"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript"))
KEPT = ("href", "title", "src", "data-src", "alt", "aria-label", "data-a-dynamic-image",
        "data-asin", "lang", "id", "class", "action")
# Attributes that become part of an element's tokens, as [name=value].
TOKENS = ("data-hook", "data-component-type", "data-cy", "rel")
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6"
                   " header hr main nav ol p pre section table ul".split())
# Opening one of the keys ends an open one of the first set, not looking past the second.
ENDS = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}

ELEMENT = ("struct<ord: int, last: int, parent: int, tag: string, seg: string, start: int,"
           " stop: int, cells: int, cells_end: int, attrs: map<string, string>>")
#: The token of table cells of both kinds; an element knows how many of them stand in front of it and of its end.
CELL = "<cell>"
READ = ("nodes", "els", "idx")


# What a page is made of: comments and declarations, and tags with attributes.  A quote opens a value only behind "=".
MARKUP = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
#: Elements whose content is text up to their own end.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "textarea", "title")}


def _whole(markup: str) -> bool:
    """Whether a match of ``MARKUP`` is one whatever follows it: it leaves no quote open that a later one could close."""
    return MARKUP.match(markup + "\"'>").end() == len(markup)


class _Reader:
    """Collects elements and visible text of pages; closes what a page leaves open.

    Pages repeat their opening tags, so what one means is worked out once: an element is the number of
    its tag in a table of meanings (``known`` is the table's index), and Arrow looks the columns up.
    """

    def __init__(self, wanted: frozenset[str]) -> None:
        self.wanted = frozenset(t for t in wanted if not t.endswith("*"))
        # Tokens by a part of their name: "#x*" begins with x, ".*x*" contains it.
        self.parts = [(t[0], t[1:-1].lstrip("*"), t[1] == "*", t) for t in wanted if t.endswith("*")]
        self.known: dict[str, tuple] = {}
        self.closers: dict[str, str] = {}
        self.tags, self.segs, self.keys, self.items, self.attr_ends = [], [], [], [], [0]
        self.kinds, self.parents, self.starts, self.stops, self.lasts = [], [], [], [], []
        self.page_ends, self.node_ends, self.errors = [0], [0], []
        self.nodes, self.token_ends, self.tokens, self.place_ends, self.places = [], [0], [], [0], []

    def read(self, html: str | None) -> None:
        # Open elements, by number over all pages, and their tags.
        self.base, self.open, self.open_tags, self.first_node, self.hidden = len(self.kinds), [], [], len(self.nodes), 0
        self.found: dict[str, list[int]] = {}
        error = None
        try:
            self._scan(html or "")
        except Exception as problem:  # noqa: BLE001  one unreadable page must not end the pass
            error = f"{type(problem).__name__}: {problem}"
        while self.open:
            self._close()
        for token, places in self.found.items():
            self.tokens.append(token)
            self.places += places
            self.place_ends.append(len(self.places))
        self.token_ends.append(len(self.tokens))
        self.node_ends.append(len(self.nodes))
        self.errors.append(error)
        self.page_ends.append(len(self.kinds))

    def _scan(self, html: str) -> None:
        """One loop over the markup of a page; what nearly every tag needs stands in the loop itself.

        Markup met before is recognised by its text up to the next ">"; the pattern is tried where that is not known.
        """
        at, size, find, known, closers = 0, len(html), html.find, self.known, self.closers
        kinds, parents, starts, stops, lasts, nodes = self.kinds, self.parents, self.starts, self.stops, self.lasts, self.nodes
        opened, tags, places, base, first = self.open, self.open_tags, self.found, self.base, self.first_node
        while at < size:
            start = find("<", at)
            after = find(">", start) + 1 if start >= 0 else 0
            markup = html[start:after] if after else ""
            what = known.get(markup)
            tag = closers.get(markup) if what is None else None
            if what is None and tag is None:
                match = MARKUP.search(html, start) if start >= 0 else None
                if not match:
                    self._text(html[at:])
                    return
                start, after = match.span()
                end, name, rest = match.groups()
                if end:
                    tag = self._closer(name, match[0])
                elif name:
                    what = known.get(match[0]) or self._meaning(name, rest, match[0])
            if start > at and not self.hidden:
                self._text(html[at:start])
            at = after
            if what is None:
                if tag and tags and tags[-1] == tag:
                    self._close()
                elif tag in tags:
                    self._end(tag)
                continue
            kind, tag, noted, ends, special, kept, shut = what
            if ends:
                for other in ends[0]:
                    if other in tags:
                        self._end_open(*ends)
                        break
            number, here = len(kinds), len(nodes) - first
            for token in noted:
                if token in places:
                    places[token].append(number - base)
                else:
                    places[token] = [number - base]
            kinds.append(kind)
            parents.append(opened[-1] - base if opened else -1)
            starts.append(here)
            stops.append(here)
            lasts.append(number - base)
            if kept:
                opened.append(number)
                tags.append(tag)
                if special:
                    self.hidden += tag in HIDDEN
                    if tag in RAW:
                        stop = RAW[tag].search(html, at)
                        here = stop.start() if stop else size
                        if tag not in HIDDEN:
                            self._text(html[at:here])
                        at = here
                        continue
                if shut:
                    self._end(tag)

    def arrays(self) -> list[pa.Array]:
        """``nodes``, ``els``, ``idx`` and ``page_error`` of the pages read."""
        ints, texts = (lambda v: pa.array(v, pa.int32())), (lambda v: pa.array(v, pa.string()))
        attrs = pa.MapArray.from_arrays(ints(self.attr_ends), texts(self.keys), texts(self.items))
        kinds, lasts = np.array(self.kinds, dtype=np.int32), np.array(self.lasts, dtype=np.int32)
        ends = np.array(self.page_ends, dtype=np.int64)
        bases = np.repeat(ends[:-1], np.diff(ends))
        # Cells in front of an element and of its end, by counting them over all pages.
        counted = np.cumsum([0, *np.array([t in ("td", "th") for t in self.tags], dtype=np.int64)[kinds]])
        columns = {
            "ord": np.arange(len(kinds)) - bases, "last": lasts, "parent": self.parents, "start": self.starts,
            "stop": self.stops, "cells": counted[:-1] - counted[bases],
            "cells_end": counted[bases + lasts + 1] - counted[bases]}
        columns = {n: ints(np.asarray(v, dtype=np.int32)) for n, v in columns.items()}
        columns |= {n: v.take(pa.array(kinds)) for n, v in (
            ("tag", texts(self.tags)), ("seg", texts(self.segs)), ("attrs", attrs))}
        order = [f.split(":")[0].strip() for f in re.sub(r"map<.*?>", "map", ELEMENT[7:-1]).split(",")]
        elements = pa.StructArray.from_arrays([columns[n] for n in order], names=order)
        index = pa.MapArray.from_arrays(ints(self.token_ends), texts(self.tokens),
                                        pa.ListArray.from_arrays(ints(self.place_ends), ints(self.places)))
        return [pa.ListArray.from_arrays(ints(self.node_ends), texts(self.nodes)),
                pa.ListArray.from_arrays(ints(self.page_ends), elements), index, texts(self.errors)]

    def _closer(self, name: str, markup: str) -> str:
        tag = name.lower()
        if _whole(markup):
            self.closers[markup] = tag
        return tag

    def _meaning(self, name: str, rest: str, markup: str) -> tuple:
        """What an opening tag is: its number, tag, wanted tokens, effect on open elements; whether its content is raw or
        hidden, whether it stays open, whether it closes itself."""
        tag = name.lower()
        extra = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(rest)} if rest else {}
        tokens = []
        if extra.get("id"):
            tokens.append("#" + extra["id"].strip())
        tokens += ["." + token for token in extra.get("class", "").split()]
        tokens += [f"[{k}={v}]" for k, v in extra.items() if k in TOKENS]
        noted = dict.fromkeys([tag] if tag in self.wanted else [])
        for token in tokens:
            if token in self.wanted:
                noted[token] = None
            for kind, part, anywhere, whole in self.parts:
                if token[0] == kind and (part in token if anywhere else token.startswith(part, 1)):
                    noted[whole] = None
        if tag in ("td", "th") and CELL in self.wanted:
            noted[CELL] = None
        for k, v in extra.items():
            if k in KEPT:
                self.keys.append(k)
                self.items.append(v)
        self.attr_ends.append(len(self.keys))
        ends = ENDS.get(tag) or ((("p",), ("table",)) if tag in BLOCKS else None)
        what = (len(self.tags), tag, list(noted), ends, tag in RAW or tag in HIDDEN, tag not in VOID, rest.endswith("/"))
        if _whole(markup):
            self.known[markup] = what
        self.tags.append(tag)
        self.segs.append(" " + " ".join([tag, *tokens]) + " ")
        return what

    def _end(self, tag: str) -> None:
        if self.open and self.open_tags[-1] == tag:
            self._close()
        elif tag in self.open_tags:
            while self._close() != tag:
                pass

    def _text(self, data: str) -> None:
        if not self.hidden and data:
            if "&" in data:
                data = unescape(data)
            self.nodes.append(data.replace(SEPARATOR, " ") if SEPARATOR in data else data)

    def _end_open(self, ends, stop_at):
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.open_tags[depth]
            if tag in stop_at:
                return
            if tag in ends:
                while len(self.open) > depth:
                    self._close()
                if ends != ("tr", "td", "th"):
                    return

    def _close(self) -> str:
        number, tag = self.open.pop(), self.open_tags.pop()
        self.lasts[number] = len(self.kinds) - self.base - 1
        self.stops[number] = len(self.nodes) - self.first_node
        if tag in HIDDEN:
            self.hidden -= 1
        return tag


def _tokenised(batches: Iterator[pa.RecordBatch], wanted: frozenset[str], names: list[str], html: str,
               chunk_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        source = batch.column(batch.schema.get_field_index(html))
        passed = [batch.column(batch.schema.get_field_index(n)) for n in names]
        at = 0
        while at < batch.num_rows:
            reader, start, read = _Reader(wanted), at, 0
            while at < batch.num_rows and read < chunk_chars:
                text = source[at].as_py()
                reader.read(text)
                read += len(text or "")
                at += 1
            yield pa.RecordBatch.from_arrays(
                [c.slice(start, at - start) for c in passed] + reader.arrays(), names=[*names, *READ, "page_error"])


#: Source whose elements a worker holds at once.
CHUNK_CHARS = 1 << 20


def tokenise(pages: DataFrame, page: Page, html: str = "html", chunk_chars: int = CHUNK_CHARS, keep: bool = False) -> DataFrame:
    """Replace the page source by ``nodes``, ``els``, ``idx`` and ``page_error``; ``keep`` lets the source pass, too.

    ``page`` knows the tokens to index, so it is asked for all its selectors first.  Other columns
    pass through as Arrow arrays.  Output leaves whenever a
    megabyte of source is read, since the elements of a page outweigh it some thirty times.
    """
    kept = [f for f in pages.schema.fields if keep or f.name != html]
    names = [f.name for f in kept]
    wanted = frozenset(page.tokens)

    types = ("array<string>", f"array<{ELEMENT}>", "map<string, array<int>>")
    schema = T.StructType([*kept, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(READ, types, strict=True)],
                           T.StructField("page_error", T.StringType())])
    return pages.select(*names, *([] if keep else [html])).mapInArrow(
        lambda batches: _tokenised(batches, wanted, names, html, chunk_chars), schema)


# --- choosing elements ------------------------------------------------------
#
# A step is a string of tokens an element must carry: "span .a-list-item",
# "#title", "[data-hook=review]", or one token by its beginning or part: "#x*", ".*x*".  A list of steps
# descends; a tuple of step lists is an ordered choice.

NO_PLACES = "cast(array() as array<int>)"
#: The kinds of tokens, from the rarest on a page to the most frequent; a step is looked up by its rarest token.
KINDS = "#[."


def carries(e: Column, step: str) -> Column:
    out = None
    for token in step.split():
        test = e["seg"].contains(f" {token} ") if token[0] in KINDS else e["tag"] == token
        out = test if out is None else out & test
    return out


def inside(e: Column, outer: Column) -> Column:
    return (e["ord"] > outer["ord"]) & (e["ord"] <= outer["last"])


def attr(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], lit(name))


class Page:
    """Selectors over a tokenised page, and the tokens they need indexed."""

    def __init__(self, tokens: Iterable[str] = ()) -> None:
        self.tokens: set[str] = set(tokens)

    def copy(self) -> Page:
        """A page of the same tokens, to which others can be added."""
        return Page(self.tokens)

    # Elements by their places.

    def _carrying(self, step: str) -> tuple[Column, Callable[[Column], Column] | None]:
        """Places by the step's rarest token, and the test of the others."""
        tokens = sorted(step.split(), key=lambda t: KINDS.find(t[0]) if t[0] in KINDS else len(KINDS))
        self.tokens.add(tokens[0])
        rest = " ".join(tokens[1:])
        found = F.try_element_at(F.col("idx"), lit(tokens[0]))
        return found, (lambda i: carries(self.at(i), rest)) if rest else None

    def places(self, *steps: str, within: Column | None = None) -> Column:
        """Places of the elements reached by the steps, in page order."""
        found, test = self._carrying(steps[0])
        if within is not None:
            found = F.filter(found, lambda i: (i > within["ord"]) & (i <= within["last"]))
        if test is not None:
            found = F.filter(found, test)
        for step in steps[1:]:
            found = self._descend(found, step)
        return F.coalesce(found, expr(NO_PLACES))

    def _descend(self, outer: Column, step: str) -> Column:
        found, test = self._carrying(step)
        ends = F.transform(outer, lambda i: F.struct(i.alias("ord"), self.at(i)["last"].alias("last")))
        inner = let(ends, lambda os: F.filter(found, lambda i: F.exists(
            os, lambda o: (i > o["ord"]) & (i <= o["last"]))))
        return inner if test is None else F.filter(inner, test)

    def at(self, place: Column) -> Column:
        return F.get(F.col("els"), place)

    def elements(self, places: Column) -> Column:
        return F.transform(places, self.at)

    def pick(self, *steps: str, within: Column | None = None) -> Column:
        """Elements reached by the steps, in page order."""
        return self.elements(self.places(*steps, within=within))

    def first(self, *steps: str, within: Column | None = None) -> Column:
        return self.at(nth(self.places(*steps, within=within), 0))

    def places_any(self, *choices: tuple[str, ...], within: Column | None = None) -> Column:
        """Places that any of the step lists reaches, each once, by choice then page order."""
        return F.array_distinct(F.concat(*[self.places(*c, within=within) for c in choices]))

    def pick_any(self, *choices: tuple[str, ...], within: Column | None = None) -> Column:
        return self.elements(self.places_any(*choices, within=within))

    def cells(self, row: Column) -> Column:
        """The cells that are children of a table row."""
        self.tokens.add(CELL)
        mine = F.slice(F.try_element_at(F.col("idx"), lit(CELL)), row["cells"] + 1, row["cells_end"] - row["cells"])
        return F.coalesce(F.filter(self.elements(mine), lambda c: c["parent"] == row["ord"]), expr(NO_ELEMENTS))

    # Their texts.

    def own_nodes(self, e: Column) -> Column:
        return F.slice(F.col("nodes"), e["start"] + 1, e["stop"] - e["start"])

    def raw_text(self, e: Column) -> Column:
        return F.array_join(self.own_nodes(e), SEPARATOR)

    def text_of(self, e: Column) -> Column:
        return clean(F.array_join(self.own_nodes(e), " "))

    def lines_of(self, e: Column) -> Column:
        """The element's text nodes, cleaned, each distinct one once."""
        return F.array_distinct(F.filter(F.transform(self.own_nodes(e), clean), lambda t: t != ""))

    def texts_of(self, found: Column) -> Column:
        return F.filter(F.transform(found, self.text_of), lambda t: t != "")

    def first_text(self, *choices: tuple[str, ...], within: Column | None = None) -> Column:
        """Text of the first non-empty element over an ordered list of choices, else ''.

        Most choices have a text in their first element, so that one is read before any other is.
        """
        def first(places: Column) -> Column:
            some = filled(self.text_of(self.at(nth(places, 0))))
            return F.coalesce(some, F.when(F.size(places) > 1, nth(self.texts_of(self.elements(places)), 0)))

        return F.coalesce(*[let(self.places(*c, within=within), first) for c in choices], lit(""))

    def bullets(self, *steps: str) -> Column:
        """Distinct non-empty texts in page order."""
        return F.array_distinct(self.texts_of(self.pick(*steps)))


NO_ELEMENTS = f"cast(array() as array<{ELEMENT}>)"


# --- gates -------------------------------------------------------------------

def with_challenge_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Mark small pages that carry the words of a bot check.

    The length is tested first, so a full product page is never lower-cased.
    """
    text = F.col(html)
    markers = None
    for marker in L.CHALLENGE_TEXT:
        test = F.lower(text).contains(marker)
        markers = test if markers is None else markers | test
    return pages.withColumn("_challenge_text", F.when(
        F.length(text) < L.CHALLENGE_TEXT_BELOW_CHARS, markers).otherwise(lit(False)))


def challenge_reason(page: Page) -> Column:
    """Why a page is a bot check rather than content, NULL when it is content."""
    captcha = ((F.size(page.places("#captchacharacters")) > 0)
               | F.exists(page.pick("form"), lambda e: F.coalesce(attr(e, "action").contains("validateCaptcha"), lit(False)))
               | F.exists(page.pick("img"), lambda e: F.coalesce(attr(e, "src").contains("captcha"), lit(False))))
    title = F.lower(F.trim(page.first_text(("title",))))
    return cases((captcha, lit("captcha_form")),
                 (title.contains("robot check") | (title == "amazon.com"), lit("robot_check_title")),
                 (F.col("_challenge_text"), lit("challenge_text")),
                 otherwise=lit(None).cast("string"))


def gate(pages: DataFrame, html: str = "html", page: Page | None = None) -> DataFrame:
    """Tokenised pages with ``challenge`` and ``parse_failed``: no title node on a real page."""
    page = page or Page()
    reason = challenge_reason(page)
    titled = (F.size(page.places("#productTitle")) > 0) | (F.size(page.places("#title")) > 0)
    out = tokenise(with_challenge_text(pages, html), page, html).withColumn("challenge", reason)
    return out.withColumn("parse_failed", F.col("challenge").isNull() & ~titled).drop("_challenge_text")


# --- redaction ---------------------------------------------------------------

def _without_declared(html: Column, name: str, placeholder: str) -> Column:
    declared = filled(F.regexp_extract(html, rf"\b{name}\s*=\s*'([^']{{6,64}})'", 1))
    return F.when(declared.isNotNull(), F.replace(html, declared, lit(placeholder))).otherwise(html)


def redact(html: Column) -> Column:
    """Replace session, request and widget identifiers by fixed values.

    Identifiers a page declares about itself are replaced wherever they are
    echoed; the anchored patterns catch the rest.
    """
    out = html
    for name, placeholder in (("ue_sid", L.SESSION_ID), ("ue_id", L.REQUEST_ID)):
        out = _without_declared(out, name, placeholder)
    for pattern, new in (
            (r"\b\d{3}-\d{7}-\d{7}\b", L.SESSION_ID),
            (r'(data-a?rid=")[^"]{8,64}(")', "$1" + L.CORRELATION_ID + "$2"),
            (r'("|&quot;)a?rid\1\s*:\s*("|&quot;)[^"&]{8,64}\2', "$1arid$1:$2" + L.CORRELATION_ID + "$2"),
            (r'("|&quot;)ipAddress\1\s*:\s*("|&quot;)[0-9.]+\2', "$1ipAddress$1:$2\\0.0.0.0$2")):
        out = F.regexp_replace(out, pattern, new)
    return out


def redact_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumn(html, redact(F.col(html)))
