"""Garbled texts made from good ones, by hash and thus the same each time: samples for measures of text quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that stand apart, as they are written together again.
LETTERS_APART = r"(?:\b[A-Za-z] ){3,}[A-Za-z]\b"


def _chosen(piece: Column, share: float) -> Column:
    """True for the part `share` of all pieces, told by the first two digits of their md5."""
    return F.conv(F.substring(F.md5(piece), 1, 2), 16, 10).cast("int") < int(256 * share)


def letterspaced(text: Column, share: float = 0.15) -> Column:
    """The part `share` of the words of more than three characters, the same words everywhere, with their letters apart."""
    words = F.split(text, " ")
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 3) & _chosen(w, share), F.trim(F.regexp_replace(w, "([^\n])", "$1 "))).otherwise(w)), " ")


def with_marks(text: Column, share: float = 0.03) -> Column:
    """The last letter of the part `share` of the words replaced by U+FFFD, the same words everywhere."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(_chosen(w, share), F.regexp_replace(w, r"\p{L}\z", "\N{REPLACEMENT CHARACTER}")).otherwise(w)), " ")


def letters_joined(text: Column) -> Column:
    """Four or more single ASCII letters that stand apart written as one word; only for texts that are known to have them."""
    apart = F.array_distinct(F.regexp_extract_all(text, F.lit(LETTERS_APART), 0))
    longest = F.transform(F.array_sort(F.transform(apart, lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m")))), lambda s: s["m"])
    return F.aggregate(longest, text, lambda s, m: F.replace(s, m, F.replace(m, F.lit(" "), F.lit(""))))
