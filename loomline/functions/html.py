"""HTML as plain text, by batch."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements without prose, and those that end a line.
_SILENT = {"script", "style", "svg", "nav", "footer", "header"}
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "pre", "blockquote"}


class _Reader(HTMLParser):
    """Collects lines of text; tables become pipe rows, images their description."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines, self.now, self.silent, self.rows, self.cell = [], [], 0, None, None

    def flush(self) -> None:
        line = " ".join("".join(self.now).split())
        if line:
            self.lines.append(line)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []
        elif tag == "img":
            described = (dict(attrs).get("alt") or "").strip()
            if described:
                self.handle_data(f"[Image: {described}]")
        elif tag in _BREAKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()).replace("|", "\\|"))
            self.cell = None
        elif tag == "table" and self.rows is not None:
            rows, self.rows, self.cell = [r for r in self.rows if r], None, None
            wide = max(map(len, rows), default=0)
            for i, r in enumerate(rows):
                self.lines.append("| " + " | ".join(r + [""] * (wide - len(r))) + " |")
                if not i:
                    self.lines.append("| " + " | ".join(["---"] * wide) + " |")
        elif tag in _BREAKS:
            self.flush()

    def handle_data(self, data):
        if self.silent:
            return
        (self.cell if self.cell is not None else self.now).append(data)


def _plain(page: str | None) -> str | None:
    if page is None:
        return None
    reader = _Reader()
    reader.feed(page)
    reader.close()
    reader.flush()
    return "\n".join(reader.lines)


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """Text of HTML pages: lines without blanks, pipe tables, image descriptions. Null stays null."""
    return pages.map(_plain)
