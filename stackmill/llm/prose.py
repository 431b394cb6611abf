"""Quality statistics of each text, and the texts that are lists, tables or junk rather than running prose.

Lines are measured by Arrow's string kernels, all lines of a batch at once: words, common words, signs, bullets, ends.
Fixed thresholds then tell for each line which rule it fails, first alone and then by its neighbours in the paragraph,
and, as column expressions, for each text; every failed rule is a recorded reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stackmill.llm.words import COMMON
from stackmill.session import spread

#: Common words that tell prose: those of one Latin letter also stand in lists and tables.
TELLING = pa.array(sorted({w for lang, words in COMMON.items() for w in words if len(w) > 1 or lang == "ru"}))
# Published thresholds for running text.
WORDS_LEAST, MEAN_LENGTH, SYMBOLS_MOST, BULLETS_MOST, ELLIPSES_MOST, ALPHABETIC_LEAST, STOP_WORDS_LEAST, LINE_ENDS_LEAST = 10, (3.0, 10.0), 0.1, 0.9, 0.3, 0.8, 2, 0.12
# Thresholds for a line, by what it must have (least) and may have (most) to be prose, as shares of its characters or words.
LINE_WORDS, LINE_LETTERS, LINE_SIGNS, LINE_FOREIGN, LINE_COMMON, SHORT_WORDS, SHORT_COMMON = 4, 0.55, 0.1, 0.15, 0.2, 3, 0.15
TABLE_LETTERS, TABLE_SIGNS, TIMES_MOST, FULL_LETTERS, FULL_CHARS = 0.4, 0.15, 3, 0.6, 30
#: Share of the characters in lines that fail from which on a text does.
NOT_PROSE = 0.5
#: What words are made of: letters, and the signs that they may have become by a wrong reading.
LETTER = r"\pL\p{No}\p{Nl}\x{FFFD}"
SPACE = r"[\s\p{Z}\x{85}\x{b}\x{1c}-\x{1f}]"
BULLET = rf"^(?:[•●▪◦‣☐☑☒*+\-–—]|\[[ xX]?\]|\(?(?:\d{{1,3}}|[A-Za-z]|[ivxIVX]{{1,5}})[.)])(?:{SPACE}|$)"
SENTENCE_END = r"[.!?…。！？][\"”’»“'）)\]]*$"
SENTENCE_BREAK = rf"[\pL\pN_\x{{FFFD}})\]”’\"][.!?][”’\")]*{SPACE}+[^\s\p{{Z}}a-zà-ÿ]"
SIGNS = r"[#\\{}<>|^_=*/~@%&\[\]+$]"
#: A formula inside a sentence.
FORMULA = r"\$\$[^$\n]{1,80}\$\$|\$[^$\n]{1,60}\$"
#: Characters of texts that are measured at once.
SLICE = 1 << 23
COUNTS = ["lines", "chars", "words", "letters", "common", "signs", "bullets", "ends", "ellipses", "lettered", "tokens", "other", "repeated", "marked"]


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    """For each line of the texts that isn't blank: `of` (the place of its text), `top` (it begins a paragraph) and its counts."""
    parts = pc.split_pattern(texts, "\n")
    of = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    t = pc.utf8_trim_whitespace(pc.list_flatten(parts))
    chars = pc.utf8_length(t).to_numpy(zero_copy_only=False)
    full = chars > 0
    before = np.concatenate([[False], full[:-1] & (of[1:] == of[:-1])]) if len(of) else full
    t, of, chars, top = t.filter(pa.array(full)), of[full], chars[full], ~before[full]
    plain = pc.replace_substring_regex(t, FORMULA, "")
    low = pc.utf8_lower(plain)
    count = lambda texts, pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    told = lambda texts, pattern: pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    per = lambda lists, which: np.bincount(pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[which], minlength=len(of))
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(low, f"[^{LETTER}]+", " ")))
    word = pc.list_flatten(words)
    tokens = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(plain))
    token = pc.list_flatten(tokens)
    letters = count(low, f"[{LETTER}]")
    same = pc.dictionary_encode(pc.utf8_lower(t)).indices.to_numpy(zero_copy_only=False).astype("i8")
    _, group, times = np.unique(of.astype("i8") * (len(of) + 1) + same, return_inverse=True, return_counts=True)
    return {
        "of": of, "top": top, "chars": chars, "told": np.maximum(1, pc.utf8_length(plain).to_numpy(zero_copy_only=False)), "letters": letters, "foreign": letters - count(low, "[a-z]"), "signs": count(plain, SIGNS),
        "words": per(words, pc.not_equal(word, "").to_numpy(zero_copy_only=False)), "common": per(words, pc.is_in(word, value_set=TELLING).to_numpy(zero_copy_only=False)),
        "tokens": per(tokens, pc.not_equal(token, "").to_numpy(zero_copy_only=False)), "lettered": per(tokens, told(token, f"[{LETTER}]")),
        "bullet": told(t, BULLET), "ends": told(t, SENTENCE_END), "breaks": told(t, SENTENCE_BREAK), "title": pc.utf8_is_title(t).to_numpy(zero_copy_only=False),
        "ellipsis": told(t, r"(?:\.\.\.|…)$"), "times": times[group] if len(of) else chars,
    }


def judged(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which lines fail, which of them as one line over and over, and which as a list, a table or code."""
    words, common, chars, letters = x["words"], x["common"], x["told"], x["letters"]
    closed, worded = x["ends"] | x["breaks"], words * 2 >= x["tokens"]
    sentence = (words >= LINE_WORDS) & (letters >= LINE_LETTERS * chars) & (x["signs"] <= LINE_SIGNS * chars) & closed & (x["foreign"] >= LINE_FOREIGN * letters)
    spoken = (common >= STOP_WORDS_LEAST) & (common >= LINE_COMMON * words) & worded
    short = (common >= 1) & (common >= SHORT_COMMON * words) & closed & (words >= SHORT_WORDS) & worded
    repeated = (words > 0) & (x["times"] > TIMES_MOST)
    listed = (letters < TABLE_LETTERS * chars) | (x["signs"] > TABLE_SIGNS * chars) | (x["bullet"] & (common == 0) & ~x["ends"])
    prose = ~repeated & (spoken | sentence | short)
    failed = repeated | (~prose & listed)
    n = len(words)
    last = np.concatenate([[False], x["of"][1:] == x["of"][:-1]]) & ~x["top"] if n else prose  # goes on from the line before
    next_ = np.concatenate([last[1:], [False]]) if n else prose
    whole = (words >= SHORT_WORDS) & (letters >= FULL_LETTERS * x["chars"]) & (x["chars"] >= FULL_CHARS) & ~x["title"]
    for _ in range(2 if n else 0):  # a line that tells nothing is prose by its neighbours
        after = last & np.concatenate([[False], prose[:-1]])
        before = next_ & np.concatenate([prose[1:], [False]])
        prose = prose | (~prose & ~failed & ((after & (x["ends"] | before)) | ((after | before) & whole)))
    return ~prose, repeated, ~repeated & failed


def counted(texts: pa.Array) -> np.ndarray:
    """COUNTS for each text, one row each; null texts have zeros."""
    out = np.zeros((len(texts), len(COUNTS)), dtype="i8")
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8")) // SLICE
    edges = [0, *(np.nonzero(np.diff(sizes))[0] + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):
        if a == b:
            continue
        x = measured(texts.slice(a, b - a))
        other, repeated, marked = judged(x)
        per = lambda v: np.bincount(x["of"], weights=v, minlength=b - a)[: b - a]  # noqa: E731, B023
        columns = [np.ones(len(other)), *(x[c] for c in ("chars", "words", "letters", "common", "signs", "bullet", "ends", "ellipsis", "lettered", "tokens")), *(x["chars"] * m for m in (other, repeated, marked))]
        out[a:b] = np.stack([per(c.astype("f8")) for c in columns], axis=1)
    return out


def with_quality(texts: DataFrame, text: str = "text", excluded: Column | None = None) -> DataFrame:
    """The rows with their statistics and `reasons`, an array of the rules that the text fails (empty if none).

    Statistics: chars, words, mean_word_length, symbol_ratio (signs of markup and code by words), bullet_share,
    line_end_share (lines that end a sentence), ellipsis_share, alphabetic_share (words with a letter), common_share,
    not_prose_share (characters of lines that fail the rules for a line), and of these repeated_share (one line over and
    over) and marked_share (lists, tables and code). `not_prose` is true if not_prose_share is above one half, with the
    reason not_prose and, where one kind of lines alone is, repeated_lines or marked_lines. Null and blank texts have null
    shares and the reason 'empty'; rows for which `excluded` holds (code) are never not_prose. Columns of the input with
    one of the new names are replaced. Rows stay where they are, unless the input has fewer splits than there are cores.
    """
    new = ["chars", "words", "mean_word_length", "symbol_ratio", "bullet_share", "line_end_share", "ellipsis_share", "alphabetic_share", "common_share", "not_prose_share", "repeated_share", "marked_share", "not_prose", "reasons"]
    rows = texts.drop(*[c for c in new if c != text])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counted(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, k]) for k in range(len(COUNTS)))], names=[*batch.schema.names, *(f"__{c}" for c in COUNTS)])

    rows = spread(rows).mapInArrow(count, StructType([*rows.schema.fields, *(StructField(f"__{c}", LongType()) for c in COUNTS)]))
    share = lambda a, b: F.try_divide(F.col(f"__{a}").cast("double"), F.col(f"__{b}"))
    rows = rows.withColumns({"chars": F.col("__chars"), "words": F.col("__words"), "mean_word_length": share("letters", "words"), "symbol_ratio": share("signs", "words"), "bullet_share": share("bullets", "lines"),
                             "line_end_share": share("ends", "lines"), "ellipsis_share": share("ellipses", "lines"), "alphabetic_share": share("lettered", "tokens"), "common_share": share("common", "words"),
                             "not_prose_share": share("other", "chars"), "repeated_share": share("repeated", "chars"), "marked_share": share("marked", "chars")})
    empty = F.col("chars") == 0
    rules = {"empty": empty, "few_words": F.col("words") < WORDS_LEAST, "word_length": ~F.col("mean_word_length").between(*MEAN_LENGTH), "symbols": F.col("symbol_ratio") > SYMBOLS_MOST,
             "bullets": F.col("bullet_share") > BULLETS_MOST, "ellipses": F.col("ellipsis_share") > ELLIPSES_MOST, "not_alphabetic": F.col("alphabetic_share") < ALPHABETIC_LEAST,
             "no_common_words": F.col("__common") < STOP_WORDS_LEAST, "line_ends": F.col("line_end_share") < LINE_ENDS_LEAST, "not_prose": F.col("not_prose_share") > NOT_PROSE,
             "repeated_lines": F.col("repeated_share") > NOT_PROSE, "marked_lines": F.col("marked_share") > NOT_PROSE}
    kept = F.lit(True) if excluded is None else ~F.coalesce(excluded, F.lit(False))
    failed = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda r: r.isNotNull())
    return rows.withColumns({"not_prose": kept & ~empty & F.coalesce(F.col("not_prose_share") > NOT_PROSE, F.lit(False)), "reasons": failed}).drop(*[f"__{c}" for c in COUNTS])
