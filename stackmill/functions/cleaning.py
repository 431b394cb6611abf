"""Markdown made from HTML, freed of left-over tags, by an ordered chain of native replacements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns in the order in which they are applied; the span rule runs five times, for nested spans.
CHAIN = [
    (r'<span class="[^"]*\bkbd\b[^"]*">((?:[^<]|\\<)+?)</span>', "`$1`"),
    (r'<a\s+href="[^"]*"[^>]*>([^<]+)</a>', "$1"),
    (r"</?(?:aside|article)\b[^>]*>", ""),
    *[(r"<span\b[^>]*>([^<]*)</span>", "$1")] * 5,
    (r'<span id="[^"]*"></span>', ""),
    (r"(?md)^[ \t]*</?div\b[^>]*>[ \t]*$", ""),
    (r"(?s)<figure\b[^>]*>.*?</figure>", ""),
    (r"(?s)<svg\b[^>]*>.*?</svg>", ""),
    (r"<(?:image|img)\b[^>]*/?>", ""),
    (r"(?md)^```\s*mce-root\s*$", "```"),
    (r"\n{3,}", "\n\n"),
]


def clean_markdown(text: Column) -> Column:
    """`text` without wrappers, anchors and pictures; code spans become backticks, and blank lines one. Null stays null."""
    for pattern, replacement in CHAIN:
        text = F.regexp_replace(text, pattern, replacement)
    return text
