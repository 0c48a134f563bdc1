"""Visible text of HTML pages by a small block-level state machine, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HIDDEN = frozenset("head script style noscript template iframe svg title".split())
_BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html main nav ol p pre section table tr ul".split())
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden: list[str] = []
        self.blocks: list[str] = []
        self.current: list[str] = []
        self.bullet = False

    def flush(self) -> None:
        text = " ".join("".join(self.current).split())
        if text:
            self.blocks.append(("  • " if self.bullet else "") + text)
        self.current, self.bullet = [], False

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN and tag != "title":
            self.hidden.append(tag)
        elif tag == "title":
            self.hidden.append(tag)
        elif tag == "li":
            self.flush()
            self.bullet = True
        elif tag in _BLOCK:
            self.flush()
            if self.hidden and tag == "body":  # an unclosed head ends with the body
                self.hidden = []
        elif tag == "br":
            self.current.append("\n")
        elif tag in ("td", "th"):
            self.current.append(" ")

    def handle_startendtag(self, tag, attrs):
        if tag not in _HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        elif tag == "li" or tag in _BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.current.append(data)


_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def detect_encoding(data: bytes) -> str:
    """A byte-order mark, else UTF-8 or the declared charset if the bytes are valid in it, else 16-bit units by their zero
    bytes, else Windows-1252, which every byte has a place in."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name
    declared = [m[1].decode("ascii") for m in _CHARSET.finditer(data)]
    for name in ("utf-8", *declared):
        if b"\0" not in data and _valid(data, name):
            return name
    for name, low in (("utf-16-le", 1), ("utf-16-be", 0)):
        if data and data[low::2].count(0) > 0.4 * len(data) / 2 and _valid(data, name):
            return name
    return "cp1252"


def _valid(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except (LookupError, UnicodeDecodeError):
        return False
    return True


def decode_html(data: bytes | str | None) -> str:
    """Text of a page in whatever encoding it is found to have; bytes without a character are replaced."""
    if data is None or isinstance(data, str):
        return data or ""
    data = bytes(data)
    return data.decode(detect_encoding(data), "replace").removeprefix("\ufeff")


def extract_text(html: bytes | str | None) -> str:
    """Blocks apart by a blank line, list items on lines of their own with a bullet; empty in, empty out."""
    parser = _Text()
    parser.feed(decode_html(html))
    parser.close()
    parser.flush()
    out, before = [], False
    for block in parser.blocks:
        item = block.startswith("  • ")
        if out:
            out.append("\n" if item and before else "\n\n")
        out.append(block)
        before = item
    return "".join(out)


@F.pandas_udf(T.StringType())
def extract_text_udf(html: pd.Series) -> pd.Series:
    return html.map(extract_text)
