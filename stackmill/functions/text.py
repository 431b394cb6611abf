"""Text functions as column expressions. All give null for null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that no code is taken from, extensions of code, and the language tag of an extension.
SKIPPED_FOLDERS = [".git", "target", "node_modules", "vendor", "dist", "build", ".venv", "__pycache__", ".tox"]
CODE_EXTENSIONS = "rs py js jsx ts tsx go java kt swift c h cc cpp hpp cs rb sh bash zsh sip toml yaml yml json md txt".split()
LANGUAGES = {"rust": ["rs"], "python": ["py"], "javascript": ["js", "jsx"], "typescript": ["ts", "tsx"], "go": ["go"], "java": ["java"], "kotlin": ["kt"], "swift": ["swift"], "c": ["c", "h"], "cpp": ["cc", "cpp", "hpp"],
             "sip": ["sip"], "csharp": ["cs"], "ruby": ["rb"], "shell": ["sh", "bash", "zsh"], "toml": ["toml"], "yaml": ["yaml", "yml"], "json": ["json"], "markdown": ["md"]}
KINDS = {"pdf": ["pdf"], "ebook": ["epub", "mobi", "azw3", "azw"], "html": ["html", "htm"], "markdown": ["md"], "code": ["rs", "py", "c", "cpp", "h", "hpp", "go", "js", "ts", "java"]}
LOW_VALUE = r"(?i)(index|bibliography|references|contents|cover|title-page|copyright|notation|glossary|acknowledg|about-the|half-title|list-of-)"
FRAGMENT_CHARS = 80


def extension(path: Column) -> Column:
    """The lower-case extension of a path's last part; '' if it has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def is_code_path(path: Column) -> Column:
    """No folder of the path is skipped, and its extension is one of code."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_FOLDERS))) & extension(path).isin(CODE_EXTENSIONS)


def _lookup(value: Column, table: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, exts in table.items():
        out = F.when(value.isin(exts), name).otherwise(out)
    return out


def language_of(path: Column) -> Column:
    """The language tag of a path's extension; null for an unknown one."""
    return _lookup(extension(path), LANGUAGES)


def kind_of(path: Column) -> Column:
    """pdf, ebook, html, markdown or code by extension; null for an unsupported one."""
    return _lookup(extension(path), KINDS)


def slugify(text: Column) -> Column:
    """Lower-case ASCII letters and digits, everything between them one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def norm_tokens(text: Column) -> Column:
    """Lower-case words between single spaces, with a space at both ends, so that ' word ' can be looked for; one space if there is no word."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def section_reason(name: Column, exclude: list[str], keep: list[str]) -> Column:
    """Why a section is skipped, by the first pattern to exclude that its name holds as whole words; null if it is kept.
    A pattern to keep wins over all patterns to exclude."""
    said = norm_tokens(name)
    out = F.lit(None).cast("string")
    for p in reversed(exclude):
        out = F.when(said.contains(norm_tokens(F.lit(p))), f"low-value section: {p}").otherwise(out)
    for p in keep:
        out = F.when(said.contains(norm_tokens(F.lit(p))), F.lit(None).cast("string")).otherwise(out)
    return out


def is_fragment(text: Column) -> Column:
    """Fewer than 80 characters, or a heading first."""
    return (F.length(text) < FRAGMENT_CHARS) | text.rlike(r"(?U)^\s*#")


def letterspace_runs(text: Column) -> Column:
    """Runs of four or more words of one letter each."""
    return F.regexp_count(text, F.lit(r"(?U)(?<!\S)\p{IsAlphabetic}(?:\s+\p{IsAlphabetic}(?!\S)){3,}(?!\S)"))


def per_thousand(count: Column, text: Column) -> Column:
    return count * 1000.0 / F.greatest(F.length(text), F.lit(1))


def replacement_marks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))


def garble_value(text: Column) -> Column:
    """Replacement marks and letter-space runs, each by a thousand characters, added up."""
    return per_thousand(replacement_marks(text), text) + per_thousand(letterspace_runs(text), text)


def alpha_ratio(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, r"\P{L}", "")) / F.length(text).cast("double"))


def mean_word_length(text: Column) -> Column:
    """Mean length of ASCII words of two letters or more; 0 without any."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), 0)
    return F.coalesce(F.try_divide(F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w)).cast("double"), F.size(words)), F.lit(0.0))


def symbols_per_word(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,;:!?'\"()-]", "")) / F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.lit(1)).cast("double")


def latex_imbalance(text: Column) -> Column:
    """0 for balanced markup: odd counts of $$ and of $, and the share by which opening and closing braces differ."""
    double = (F.length(text) - F.length(F.replace(text, F.lit("$$"), F.lit("")))) / 2
    single = F.length(text) - F.length(F.replace(text, F.lit("$"), F.lit(""))) - 2 * double
    opened, closed = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in "{}")
    return double % 2 + F.abs(single) % 2 + F.coalesce(F.try_divide(F.abs(opened - closed), (opened + closed).cast("double")), F.lit(0.0))


def masked(text: Column) -> Column:
    """Fenced code, formulas and table rows replaced by a space, in this order."""
    for pattern in (r"(?s)```.*?```", r"(?s)\$\$.*?\$\$", r"\$[^$\n]+\$", r"(?m)^\s*\|.*\|\s*$"):
        text = F.regexp_replace(text, pattern, " ")
    return text


def dehyphenated(text: Column) -> Column:
    """Words cut at a line end joined again, where a lower-case letter follows."""
    return F.regexp_replace(text, r"([A-Za-z])-\n([a-z])", "$1$2")


def source_token(token: Column) -> Column:
    """struct(source_id, chunk_index) of 'source#3'; only the last '#' counts and only digits may follow it."""
    number = F.regexp_extract(token, r"^(?s)(.*)#(\d+)$", 2)
    return F.struct(F.when(number != "", F.regexp_extract(token, r"^(?s)(.*)#(\d+)$", 1)).otherwise(token).alias("source_id"), F.when(number != "", number.cast("bigint")).alias("chunk_index"))


def window_of(chunk_index: Column, start: Column | None = None, end: Column | None = None, context: int = 2) -> Column:
    """struct(start, end): the given bounds, else `context` chunks around chunk_index, else the first twenty."""
    low = F.when(chunk_index.isNotNull(), F.greatest(chunk_index - context, F.lit(0))).otherwise(F.lit(0))
    high = F.when(chunk_index.isNotNull(), chunk_index + context + 1).otherwise(F.lit(20))
    return F.struct((low if start is None else F.coalesce(start, low)).cast("bigint").alias("start"), (high if end is None else F.coalesce(end, high)).cast("bigint").alias("end"))


def parsed_score(answer: Column) -> Column:
    """The first 0, 1 or 2 in a judge's answer; 0 without one."""
    found = F.regexp_extract(answer, "[012]", 0)
    return F.when(found == "", F.lit(0)).otherwise(found.cast("int"))


def breadcrumb(file: Column) -> Column:
    """'Book > Chapter' of 'shelf_Book__Chapter.md'."""
    parts = F.split(F.regexp_replace(file, r"\.md$", ""), "__")
    book = F.element_at(parts, 1)
    book = F.when(book.contains("_"), F.regexp_replace(book, "^[^_]*_", "")).otherwise(book)
    return F.regexp_replace(F.when(F.size(parts) > 1, F.concat(book, F.lit(" > "), F.element_at(parts, 2))).otherwise(book), "^[ >]+|[ >]+$", "")
