"""Main text of HTML pages as light Markdown, with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content is dropped, and elements that end a block (fixed values).
SKIPPED = frozenset("script style nav footer header noscript svg form button aside".split())
BLOCKS = frozenset("p div section article main ul ol li table tr h1 h2 h3 h4 h5 h6 blockquote pre br dt dd figure figcaption hr".split())
#: Elements without an end (fixed values).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_LEVELS = {f"h{n}": n for n in range(1, 7)}


class _Collector(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, bool]] = []
        self.line: list[str] = []
        self.skip: list[str] = []
        #: Of each open main part its element, and how many of that element are open in it.
        self.main: list[list] = []
        self.title = ""
        self.in_title = False
        self.mark = ""

    def _end_block(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.line)).strip()
        if text:
            self.blocks.append((self.mark + text, bool(self.main)))
        self.line, self.mark = [], ""

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in SKIPPED:
            self.skip.append(tag)
        if tag in BLOCKS:
            self._end_block()
            if tag in _LEVELS:
                self.mark = "#" * _LEVELS[tag] + " "
            elif tag == "li":
                self.mark = "- "
        if tag == "main" or dict(attrs).get("role") == "main":
            if tag not in VOID:
                self.main.append([tag, 1])
        elif self.main and tag == self.main[-1][0]:
            self.main[-1][1] += 1

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in BLOCKS:
            self._end_block()
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
        if self.main and tag == self.main[-1][0]:
            self.main[-1][1] -= 1
            if not self.main[-1][1]:
                self._end_block()
                self.main.pop()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.line.append(data)

    def finish(self) -> None:
        self.close()
        self._end_block()


def main_text(html: str | None) -> tuple[str, str]:
    """(title, text): the title up to a bar; blocks of the main element if there is one, else of the page."""
    page = _Collector()
    page.feed(html or "")
    page.finish()
    inside = [b for b, main in page.blocks if main]
    return page.title.split("|")[0].strip(), "\n\n".join(inside or [b for b, _ in page.blocks])


_PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])


@F.pandas_udf(_PAGE)
def html_main_text(html: pd.Series) -> pd.DataFrame:
    """main_text() of each page."""
    return pd.DataFrame([main_text(h) for h in html], columns=["title", "text"])
