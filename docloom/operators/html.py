"""Sections of HTML pages, in Arrow batches: markup needs a parser with state, which no built-in expression has.

Parsing makes a flat list of marks (open, close, text) for each visible stream; a second step folds marks into sections.
Kept on purpose, because results depend on it: an end tag closes the innermost open tag whatever its name, so void tags
stay open; text inside an unclosed heading is lost; entities are decoded twice; ``code`` breaks lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags and attribute markers that decide what is text, noise or main content.
BREAKING = set("p div section article main ul ol li table thead tbody tr td th pre code blockquote br hr dl dt dd h1 h2 h3 h4 h5 h6".split())
NOISE_TAGS = set("script style noscript template nav aside header footer form button svg".split())
NOISE = "navbar sidebar breadcrumb skip-link slimsearch vp-sidebar vp-navbar color-mode-switch print-button toggle-sidebar".split()
MAIN_TAGS = {"main", "article"}
MAIN = "main-content theme-hope-content vp-page article-body doc-content markdown-body post-content content-body".split()

OPEN, CLOSE, TEXT = range(3)


class _Marks(HTMLParser):
    """Collects (kind, value) marks: of all that is visible, and of what lies in main content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.every: list[tuple[int, str]] = []
        self.main: list[tuple[int, str]] = []
        self.open: list[tuple[bool, bool]] = []  # (hidden, main) of each open tag

    def mark(self, state: tuple[bool, bool], kind: int, value: str) -> None:
        hidden, main = state
        if not hidden:
            self.every.append((kind, value))
            if main:
                self.main.append((kind, value))

    def handle_starttag(self, tag, attrs):
        values = {name.lower(): value or "" for name, value in attrs}
        blob = " ".join(values.get(name, "") for name in ("id", "class", "role", "aria-label")).lower()
        hidden, main = self.open[-1] if self.open else (False, False)
        hidden = hidden or tag in NOISE_TAGS or any(m in blob for m in NOISE)
        main = not hidden and (main or tag in MAIN_TAGS or any(m in blob for m in MAIN))
        self.open.append((hidden, main))
        self.mark((hidden, main), OPEN, tag)

    def handle_endtag(self, tag):
        if self.open:
            self.mark(self.open.pop(), CLOSE, tag)

    def handle_data(self, data):
        self.mark(self.open[-1] if self.open else (False, False), TEXT, data)


def _level(tag: str) -> int:
    return int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" else 0


def _inline(text: str) -> str:
    return re.sub(r"\s+", " ", unescape(text)).strip()


def _body(parts: list[str]) -> str:
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parts))
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", text)).strip()


def folded(marks: list[tuple[int, str]]) -> list[tuple[str, str]]:
    """(title, body) sections of a list of marks; titles are the ancestors' joined by " > "."""
    out: list[tuple[str, str]] = []
    titles: dict[int, str] = {}
    body: list[str] = []
    heading: list[str] | None = None

    def flush() -> None:
        text = _body(body)
        body.clear()
        if text:
            out.append((" > ".join(titles[k] for k in sorted(titles)), text))

    for kind, value in marks:
        level = _level(value) if kind != TEXT else 0
        if kind == TEXT:
            text = _inline(value)
            if text and heading is not None:
                heading.append(text)
            elif text:
                if body and body[-1][-1] not in "\n ":
                    body.append(" ")
                body.append(text)
        elif kind == OPEN and level:
            flush()
            heading = []
        else:
            if kind == CLOSE and level and heading is not None:
                title = _inline(" ".join(heading))
                if title:
                    for k in [k for k in titles if k >= level]:
                        del titles[k]
                    titles[level] = title
                heading = None
            if value in BREAKING and body and body[-1][-1] != "\n":
                body.append("\n")
    flush()
    return out


def page_sections(html: str) -> tuple[list[tuple[str, str]], int]:
    """(sections, characters in main content): those of main content if it has any, else all."""
    parser = _Marks()
    parser.feed(html)
    parser.close()
    main = folded(parser.main)
    return main or folded(parser.every), sum(len(b) for _, b in main)


def html_sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, sec_ord, title, body, main_text_len) of every page; a null page has no sections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("title", pa.string()), ("body", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [page_sections(x or "") for x in part.column(1).to_pylist()]
                secs = pa.array([[{"title": t, "body": b} for t, b in s] for s, _ in found], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), secs, pa.array([n for _, n in found], pa.int64())], names=["key", "secs", "main_text_len"])

    rows = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, secs array<struct<title:string,body:string>>, main_text_len long"
    out = rows.mapInArrow(run, schema).select("key", "main_text_len", F.posexplode("secs").alias("sec_ord", "s"))
    return out.select(F.col("key").alias(key), "sec_ord", "s.title", "s.body", "main_text_len")
