"""Readable text of HTML: blocks, lists, quotes and tables laid out in lines of a width, as Arrow functions."""

from __future__ import annotations

import re
import textwrap
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import collapse_space

#: Characters in a line; longer words are not broken.
WIDTH = 100
#: Elements that start a line of their own, those with an empty line around them, and those without text.
BLOCKS = {"address", "article", "aside", "body", "center", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "html", "legend", "main", "nav", "section", "tbody", "tfoot", "thead", "tr", "li"}
APART = {"blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "ol", "p", "pre", "table", "ul"}
SILENT = {"head", "script", "style", "template", "title", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Collects lines from the stream of tags. The prefix of a line comes from the open lists and quotes; closing tags
    that nothing opened are passed over, and open ones end with the page."""

    def __init__(self, width: int):
        super().__init__(convert_charrefs=True)
        self.width, self.lines, self.words = width, [], []
        self.open: list[str] = []
        self.lists: list[list] = []  # kind and the number of the last item
        self.marks: list[str] = []  # prefixes of open quotes and items
        self.first: str | None = None  # a bullet for the next line
        self.silent = self.pre = 0

    def flush(self) -> None:
        raw = "".join(self.words)
        self.words = []
        parts = raw.strip("\n").split("\n") if self.pre else [" ".join(p.split()) for p in raw.split("\x00")]
        if not any(p.strip() for p in parts):
            return
        indent = "".join(self.marks)
        for p in parts:
            head = indent if self.first is None else self.first
            self.first = None
            room = max(1, self.width - len(indent))
            wrapped = [p] if self.pre else textwrap.wrap(p, room, break_long_words=False, break_on_hyphens=False) or [""]
            self.lines += [((head if i == 0 else indent) + w).rstrip() for i, w in enumerate(wrapped)]

    def blank(self) -> None:
        self.flush()
        if self.lines and self.lines[-1] and self.first is None:
            self.lines.append("")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
            self.open.append(tag)
            return
        if self.silent:
            return
        if tag == "p" and "p" in self.open[-1:] or tag == "li" and "li" in self.open[-1:]:
            self.handle_endtag(tag)
        if tag == "br":
            self.words.append("\n" if self.pre else "\x00")
        elif tag == "img":
            self.words.append(dict(attrs).get("alt") or "")
        elif tag in ("td", "th"):
            self.words.append(" " if not self.words else " | ")
        elif tag in APART and not (tag in ("ul", "ol") and self.lists):
            self.blank()
        elif tag in BLOCKS or tag in APART:
            self.flush()
        if tag in ("ul", "ol"):
            start = dict(attrs).get("start") or "1"
            self.lists.append([tag, int(start) - 1 if start.isdigit() else 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            bullet = f"{kind[1]}. " if kind[0] == "ol" else "* "
            self.first = "".join(self.marks) + bullet
            self.marks.append(" " * len(bullet))
        elif tag == "blockquote":
            self.marks.append("> ")
        elif tag == "hr":
            self.lines.append("-" * self.width)
        elif tag == "pre":
            self.pre += 1
        elif tag[0] == "h" and tag[1:].isdigit():
            self.words.append("#" * int(tag[1:]) + " ")
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            now = self.open.pop()
            if now in SILENT:
                self.silent -= 1
            elif not self.silent:
                self.close_block(now)
            if now == tag:
                return

    def close_block(self, tag: str) -> None:
        if tag in APART and not (tag in ("ul", "ol") and len(self.lists) > 1):
            self.blank()
        elif tag in BLOCKS or tag in APART:
            self.flush()
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag in ("li", "blockquote") and self.marks:
            self.marks.pop()
            self.first = None
        elif tag == "pre":
            self.pre -= 1

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.words.append(data if self.pre else data.replace("\x00", " "))

    def text(self) -> str:
        self.close()
        while self.open:
            self.handle_endtag(self.open[-1])
        self.flush()
        return re.sub(r"\n{3,}", "\n\n", "\n".join(self.lines)).strip("\n")


def laid_out(html: str, width: int = WIDTH) -> str:
    page = _Page(width)
    page.feed(html)
    return page.text()


def readable(html: Column, width: int = WIDTH) -> Column:
    """The text of a page in lines of ``width`` characters: paragraphs and headings (``#``) with empty lines around them, items with bullets or numbers,
    nested ones further in, quotes behind ``>``, cells parted by bars, entities decoded, and no scripts, styles, titles or comments. Words longer
    than a line stay whole. Null stays null, and text without tags passes as a paragraph."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda h: laid_out(h, width), na_action="ignore")

    return F.pandas_udf(run, "string")(html)


def body_text(text: Column, html: Column) -> Column:
    """What is indexed of a message's body: its text part, or without one the readable text of its HTML, white space collapsed; empty if it has neither."""
    return collapse_space(F.coalesce(text, F.when(text.isNull(), readable(html)), F.lit("")))
