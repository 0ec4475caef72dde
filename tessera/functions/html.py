"""The text of a page, by a tokenizer that goes from state to state as the living standard's does."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = " \t\n\f\r"
#: Elements whose content isn't text, those whose content has entities but no tags, and those that don't part words.
RAW, ESCAPABLE = ("script", "style"), ("textarea", "title")
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time u var wbr".split())
NAME = re.compile(r"[A-Za-z][^\s/>]*")


def tag_end(page: str, at: int) -> int:
    """Where a tag ends that has attributes from ``at`` on: a > inside a quoted value doesn't end it. The page's length if nothing does."""
    n, value = len(page), False
    while at < n:
        sign = page[at]
        if sign == ">":
            return at + 1
        if value and sign in "\"'":
            at = page.find(sign, at + 1)
            if at < 0:
                return n
            value = False
        elif sign == "=":
            value = True
        elif value and sign not in SPACE:
            # an unquoted value: quotes in it mean nothing
            while at < n and page[at] not in SPACE + ">":
                at += 1
            value = False
            continue
        at += 1
    return n


def pieces(page: str):
    """(kind, text) in order: ``text``, with entities read, and ``part`` where an element parts words."""
    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            yield "text", html.unescape(page[at:begin])
        if begin == n:
            return
        following = page[begin + 1 : begin + 2]
        if page.startswith("<!--", begin):
            # <!--> and <!---> are whole comments
            end = begin + 4 if page.startswith("<!-->", begin) else begin + 5 if page.startswith("<!--->", begin) else -1
            if end < 0:
                end = page.find("-->", begin + 4)
                end = n if end < 0 else end + 2
            at = min(n, end + 1)
        elif found := NAME.match(page, begin + 1 + (following == "/")):
            name = found[0].lower()
            at = tag_end(page, found.end())
            if at == n and not page.endswith(">"):
                return  # a tag that nothing ends is no text
            if name not in INLINE:
                yield "part", name
            if following != "/" and name in RAW + ESCAPABLE:
                closing = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                end = closing.start() if closing else n
                if name in ESCAPABLE:
                    yield "text", html.unescape(page[at:end])
                at = end
        elif following in ("!", "?", "/"):
            end = page.find(">", begin)
            at = n if end < 0 else end + 1
        else:
            yield "text", "<"
            at = begin + 1


def text_of(page: str | None) -> str | None:
    """The words of a page, one space between them; null for null. Scripts, styles, comments, tags and their attributes aren't text."""
    if page is None:
        return None
    return " ".join("".join(text if kind == "text" else " " for kind, text in pieces(page)).split())


@F.pandas_udf(StringType())
def page_text(pages: pd.Series) -> pd.Series:
    return pages.map(text_of)
