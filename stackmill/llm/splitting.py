"""Oversized texts cut into overlapping pieces at natural boundaries, by recursive bisection."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("paragraph", "line", "word", "char")
PARAGRAPH_END, LINE_END, WORD_END = re.compile(r"\n(?:[^\S\n]*\n)+"), re.compile(r"\n"), re.compile(r"\s+")


def boundaries(text: str) -> list[tuple[list[int], list[int]]]:
    """For each kind but the last, the places right after its separators, and those right before them."""
    found = [[m.span() for m in p.finditer(text)] for p in (PARAGRAPH_END, LINE_END, WORD_END)]
    return [([b for _, b in spans], [a for a, _ in spans]) for spans in found]


def strongest(marks: list[tuple[list[int], list[int]]], lo: int, hi: int) -> tuple[int, str]:
    """The place inside of a part at which to cut it, and its kind: of the strongest kind that the part has, the nearest to the middle."""
    middle = (lo + hi) // 2
    for kind, places in zip(KINDS, marks):
        for at in places:  # after a separator, or before one where the part only has one at its end
            i, j = bisect_left(at, lo + 1), bisect_right(at, hi - 1)
            if i < j:
                k = bisect_left(at, middle)
                return min((at[x] for x in (k - 1, k) if i <= x < j), key=lambda p: (abs(p - middle), p), default=at[i]), kind
    return middle, KINDS[-1]


def bisected(text: str, size: int, overlap: int = 0, trimmed: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the start) of the pieces of a trimmed text; the first one has the kind 'start'.

    A part that is too large is cut at the strongest boundary that it has, at the one nearest to its middle, and between
    two characters only if it has none; the halves are cut on where they are still too large. Parts are at most
    `size - overlap` long, and each piece but the first then begins `overlap` earlier. With `trimmed`, a part counts
    without the white space at its ends.
    """
    if len(text) <= size:
        return [(0, len(text), "start")] if text else []
    marks = boundaries(text)
    room = size - overlap
    out, stack = [], [(0, len(text), "start")]
    while stack:
        lo, hi, kind = stack.pop()
        if hi - lo <= (size if lo == 0 else room) or (trimmed and len(text[lo:hi].strip()) <= size):
            out.append((lo, hi, kind))
            continue
        cut, how = strongest(marks, lo, hi)
        stack += [(cut, hi, how), (lo, cut, kind)]
    return [(max(0, lo - overlap) if lo else 0, hi, kind) for lo, hi, kind in out]


def finest_of(text: str, size: int) -> str:
    """The finest kind of cut that the bisection of a text makes, measured without white space at the ends of parts."""
    return max((kind for _, _, kind in bisected(text, size, trimmed=True)[1:]), key=KINDS.index, default=KINDS[0])


def pieces(texts: DataFrame, key: str = "case_id", text: str = "text", size: str = "chunk_size", overlap: str = "chunk_overlap") -> DataFrame:
    """The pieces of each text: key, piece_no (from 0), start (in the trimmed text), text, cut, finest and oversized.

    `cut` is the kind of boundary before the piece, `finest` the finest cut that the bisection makes where no overlap takes
    room and white space at the ends of parts doesn't count, so the coarsest kind that is enough for the whole text; it is
    null where nothing had to be cut. Texts are trimmed of white space at both ends; blank and null texts have no piece.
    A null size, or one below 1, is no limit; a null or negative overlap is none, and so is one that is not below the
    size, as no piece could hold it. Repeated rows count once. No two pieces have a gap between them, and every piece
    has at most `size` characters.
    """
    rows = texts.select(F.col(key).alias("case_id"), F.col(text).alias("text"), F.col(size).cast("bigint").alias("size"), F.col(overlap).cast("bigint").alias("overlap"))
    rows = rows.where(F.col("text").isNotNull()).distinct()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for case, body, limit, back in zip(pdf["case_id"], pdf["text"], pdf["size"], pdf["overlap"]):
                body = body.strip()
                limit = int(limit) if limit == limit and limit is not None and limit >= 1 else max(1, len(body))
                back = int(back) if back == back and back is not None and 0 <= back < limit else 0
                over = len(body) > limit
                finest = finest_of(body, limit) if over else None
                got += [(case, n, a, body[a:b], cut, finest, over) for n, (a, b, cut) in enumerate(bisected(body, limit, back))]
            yield pd.DataFrame(got, columns=["case_id", "piece_no", "start", "text", "cut", "finest", "oversized"])

    return rows.mapInPandas(work, "case_id bigint, piece_no bigint, start bigint, text string, cut string, finest string, oversized boolean")
