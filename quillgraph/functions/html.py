"""HTML to plain text."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements that hide their content, and elements that end a line.
HIDDEN = frozenset("script style noscript iframe svg math head".split())
LINE = frozenset("p div br hr li ol ul h1 h2 h3 h4 h5 h6 table tr td th thead tbody tfoot blockquote pre section article header footer dt dd dl figcaption figure main nav aside".split())


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        if tag in LINE:
            self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag in LINE:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in HIDDEN and self.hidden > 0
        if tag in LINE:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def text_of(html: str | None) -> str | None:
    """Visible text: entities decoded, inner white space collapsed, blank lines dropped. Void tags never hide anything."""
    if html is None or not html.strip():
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line) or None


@F.pandas_udf(StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(text_of, na_action="ignore")
