"""Scanned pages as continuous paragraphs: words cut at line ends, misread characters, letters apart, page furniture.

A vocabulary is counted over the sources that are no scans. The pages of a scan are handled in blocks of consecutive
pages, each with a few pages around it, so that no source has to fit into one task.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import pairwise

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackmill.llm.lexicon import Lexicon
from stackmill.llm.words import LETTERS, language
from stackmill.session import spread, tasks

#: Pages of a block, and pages before and after it that are read along.
BLOCK, AROUND = 64, 4
#: Least times of a word, pair or compound, and its least share of all of its kind, which bounds their number at any size.
TIMES, SHARE = 3, 1e-7
#: Least times, in two scans, from which on a word of scans is no single misreading.
RECURS = 5
#: Lines whose words tell the language that they are read in.
LINES = 40
#: Different words and pairs that a task counts before it hands them on.
HELD = 400_000
HYPHENS = "-‐¬­"
LINE_MARKS = frozenset(HYPHENS)
LINE_HYPHEN = re.compile(rf"(\S*[^\W\d_])([{HYPHENS}])\s*$")
APART = re.compile(r"(?<!\S)[^\W\d_](?:\s{1,3}[^\W\d_](?!\S)){2,}")
APART_START = re.compile(r"(?<!\S)[^\W\d_]\s")
PAGE_WORD = re.compile(r"(?i)^(?:page|pagc|p@ge|pag|seite|folio|página|pág|p|s|f)\.?$")
OF = re.compile(r"(?i)^(?:of|0f|von|de|sur|/)$")
NUMERAL = re.compile(r"(?i)^(?=[ivxlcdm1|í]+$)(?:c[cdm]?|cm|cd|d?c{0,3}|m)?(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
DIGITS = str.maketrans("lI|iíOoQSſsB@gqZz", "11111000555" + "8" + "09922")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
TOKEN = re.compile(r"[^\W_]+(?:[|@!$][^\W_]*)*|[|@!$]+[^\W_]+(?:[|@!$][^\W_]*)*|@")
SIGNS = str.maketrans({"@": "a", "|": "l", "ſ": "s", "ﬁ": "fi", "ﬂ": "fl"})
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def number(token: str) -> int | None:
    """A page number, read in spite of misread digits; a Roman one too."""
    t = token.strip("[](){}<>·•*~-–—.:,|= ")
    if re.fullmatch(r"[0-9lI|íOoQSſsBgqZz@]{1,5}", t) and re.search(r"[0-9lI|O]", t):
        n = t.translate(DIGITS)
        if n.isdigit() and (re.search(r"\d", t) or t in ("l", "I", "ll", "lO", "lOl", "lOO", "O")):
            return int(n)
    low = t.lower().replace("1", "i").replace("|", "i").replace("í", "i")
    if t and NUMERAL.match(low):
        v = [ROMAN[c] for c in low]
        return sum(-a if a < b else a for a, b in zip(v, v[1:] + [0]))
    return None


def numerals(token: str) -> set[int]:
    """All readings of a page number: 'l' may be a misread 1 or a Roman 50, 'ii' a Roman 2."""
    got = {number(token)}
    t = token.strip("[](){}<>·•*~-–—.:,|= ").lower()
    if t and re.fullmatch(r"[ivxlcdm]+", t) and NUMERAL.match(t):
        v = [ROMAN[c] for c in t]
        got.add(sum(-a if a < b else a for a, b in zip(v, v[1:] + [0])))
    return got - {None}


def is_page_number(line: str, page: float | None) -> bool:
    """True for a line that holds only a page number and what decorates it."""
    tokens = line.split()
    bare = [t for t in tokens if re.search(r"[^\W_]|\|", t)]
    if not bare or len(bare) > 4 or len(line.strip()) > 30:
        return False
    decorated = len(tokens) > len(bare) or any(t[0] in "[(<·•*~-–—" or t[-1] in "])>·•*~-–—" for t in bare)
    if PAGE_WORD.match(bare[0].strip("[](){}<>·•*~-–—")) and len(bare) > 1:
        bare, decorated = bare[1:], True
    if len(bare) == 3 and OF.match(bare[1]) and numerals(bare[2]):
        bare, decorated = bare[:1], True
    if len(bare) != 1:
        return False
    values = numerals(bare[0])
    return bool(values) and (decorated or (page is not None and int(page) in values))


def header_key(line: str, page: float | None) -> tuple[str, bool]:
    """What stays the same in a running header on other pages, in spite of misread characters; whether it holds the page number."""
    tokens = line.split()
    has = False
    for at in (0, -1):
        if len(tokens) > 1 and page is not None and int(page) in numerals(tokens[at]):
            tokens.pop(at)
            has = True
    key = "".join(tokens).lower()
    for seen, meant in (("vv", "w"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("ﬁ", "fi")):
        key = key.replace(seen, meant)
    key = key.translate(str.maketrans("1|íi0ó5ſ98h@áéctú", "llllooss" + "gbbaaeefu"))
    return re.sub(r"[\W_]+", "", key), has


class Page:
    def __init__(self, span: int, index: int, page: float | None, text: str | None, own: bool) -> None:
        self.span, self.index, self.page, self.own = span, index, page, own
        self.lines = (text or "").split("\n")
        self.kind = ["blank" if not s.strip() else "text" for s in self.lines]


def furniture(pages: list[Page], first: bool) -> None:
    """Marks the lines that are page numbers and running headers; `first` says that the source begins with pages[0]."""
    for a, b in pairwise(pages):  # pages without a number follow the one before, or come before the one after
        if b.page is None and a.page is not None:
            b.page = a.page + (b.index - a.index)
    for a, b in reversed([*pairwise(pages)]):
        if a.page is None and b.page is not None:
            a.page = b.page - (b.index - a.index)
    edges: list[list[int]] = []
    for p in pages:
        full = [i for i, k in enumerate(p.kind) if k == "text"]
        for i in dict.fromkeys(full[:2] + full[-2:]):
            if is_page_number(p.lines[i], p.page):
                p.kind[i] = "pageno"
        rest = [i for i in full if p.kind[i] == "text"]
        edges.append([*dict.fromkeys(rest[:1] + rest[-1:])])
    keys = [[(i, *header_key(p.lines[i], p.page)) for i in at] for p, at in zip(pages, edges)]
    times = Counter(k for page in keys for k in {k for _, k, _ in page if len(k) >= 4})
    often = [k for k, n in times.items() if n >= 2]
    for n, (p, page) in enumerate(zip(pages, keys)):
        for at, (i, k, has) in enumerate(page):
            line = p.lines[i].strip()
            if len(k) < 4 or APART.fullmatch(line):
                continue
            top = at == 0 and i == edges[n][0]
            title = line[-1] not in ".!?;,"
            same = times[k] >= 2 or (title and any(abs(len(k) - len(o)) <= 4 and SequenceMatcher(None, k, o, autojunk=False).ratio() >= 0.8 for o in often))
            numbered = has and title and len(line.split()) >= 2
            if (same or numbered) and not (n == 0 and first and top and not has):
                p.kind[i] = "header"


def letters_apart(line: str) -> list[tuple[int, int]]:
    """The places of words whose letters stand apart; names in the order of the alphabet are none."""
    out = []
    for m in APART.finditer(line) if APART_START.search(line) else ():
        word = "".join(m[0].split()).lower()
        if word not in ALPHABET and word[1:] not in ALPHABET:
            out.append(m.span())
    return out


def misread(part: str, lexicon: Lexicon, before: str = "", after: str = "") -> str | None:
    """What a word was misread from, or None if it is known or nothing explains it."""
    low = part.lower()
    if part == "@":
        return "a"
    if low in lexicon or len(part) < 2 or part.isdigit() or re.fullmatch(r"[A-Zvp]\d+|\d+(?:st|nd|rd|th|s)", part):
        return None
    if re.fullmatch(r"[0-9lO|I]+", part) and re.search(r"\d", part):
        return part.translate(str.maketrans("lO|I", "1011"))
    got = lexicon.readings(low, 1 if len(low) <= 3 else 2 if len(low) <= 5 else 3)
    if not got and len(low) >= 4 and low.isalpha() and low not in lexicon.often:  # no known misreading: all words within one edit or two that fit in
        got = lexicon.fitting(lexicon.nearest(low, 1), before, after) or (lexicon.fitting(lexicon.nearest(low, 2), before, after) if len(low) >= 7 else [])
    if not got:  # a sign that no word holds is misread in an unknown name too
        plain = re.sub(r"(?<=[a-z])[0159](?=[a-z])", lambda m: "olsg"["0159".index(m[0])], part.translate(SIGNS))
        return plain if plain != part and len(part) > 3 and plain.isalpha() else None
    if len(low) <= 3 and -got[0][1] < 20:
        return None
    word = lexicon.best(got, before, after)
    return word.upper() if part.isupper() and len(part) > 1 else word


def joined(left: str, mark: str, right: str, lexicon: Lexicon, compounds: set[str]) -> bool:
    """True if a word cut at a line end is one word, so that the mark must vanish."""
    a, b = left.lower(), right.lower()
    tail = re.split(r"[-‐]", a)[-1]
    if mark in "¬­":
        return True
    if f"{a}-{b}" in compounds or any(c.startswith(f"{a}-{b}-") for c in compounds if c.startswith(a)):
        return False
    if tail + b in lexicon:
        return True
    if lexicon.readings(tail + b, 2) and not (tail in lexicon and b in lexicon):
        return True
    forms = [w for _, _, w in lexicon.readings(b, 2)]
    if any(f"{a}-{w}" in compounds for w in forms):
        return False
    return not (tail in lexicon and b in lexicon and len(tail) > 2 and len(b) > 2 and lexicon.counts[tail] >= 5 and lexicon.counts[b] >= 5)


def cleaned(pages: list[Page], first: bool, lexicons: dict[str, Lexicon], compounds: set[str]) -> tuple[list[tuple[int, int, str]], list[tuple[int, str]]]:
    """(span, line, noise) of the own pages, and (span of its start, paragraph) of the paragraphs that begin on them."""
    furniture(pages, first)
    noise = [(p.span, i, k) for p in pages if p.own for i, k in enumerate(p.kind) if k in ("pageno", "header")]
    body = [(p, i) for p in pages for i, k in enumerate(p.kind) if k == "text"]
    read = [p.lines[i].lower().split() for p, i in body]
    lexicon = Lexicon({})
    carried, fixed = None, []  # carried: the part of a cut word that is waiting for its rest
    for k, (p, i) in enumerate(body):
        if k % LINES == 0:  # the language of these lines and as many around them
            seen = Counter(w for words in read[max(0, k - LINES // 2) : k + LINES + LINES // 2] for w in words)
            lexicon = max(lexicons.values(), key=lambda x: sum(map(seen.__getitem__, seen.keys() & x.counts.keys())), default=lexicon)
        line = p.lines[i]
        spaces = letters_apart(line)
        if spaces and p.own:
            noise.append((p.span, i, "letterspace"))
        chars = list(line)
        for a, b in spaces:
            chars[a:b] = " " * (b - a)
        bare = "".join(chars)
        changes: list[tuple[int, int, str]] = []
        for a, b in spaces:
            words = re.split(r"\s{2,}", line[a:b]) if re.search(r"\s{2,}", line[a:b]) and not re.fullmatch(r"\S(?:\s{2,3}\S)+", line[a:b]) else [line[a:b]]
            changes.append((a, b, " ".join("".join(w.split()) for w in words)))
        found = [*TOKEN.finditer(bare)]
        start = 0
        wrong = False
        if carried and found and found[0].start() == len(bare) - len(bare.lstrip()):
            left, (q, j), fixed_at = carried
            right = found[0][0]
            word = misread(left + right, lexicon)
            if word and (q.own or p.own):
                low, cut = (left + right).lower(), 0
                while cut < min(len(low), len(word)) and low[cut] == word[cut].lower():
                    cut += 1
                if cut < len(left) and q.own:
                    noise.append((q.span, j, "ocr"))
                if cut >= len(left) or low[len(left) :] != word.lower()[-len(right) :]:
                    wrong = True
            fixed[fixed_at] = (*fixed[fixed_at][:2], fixed[fixed_at][2] + (word or left + right) + bare[found[0].end() :][: len(bare[found[0].end() :]) - len(bare[found[0].end() :].lstrip(".,;:!?)”’\""))])
            stop = found[0].end()
            stop += len(bare[stop:]) - len(bare[stop:].lstrip(".,;:!?)”’\""))
            changes.append((0, stop, ""))
            start = 1
        carried = None
        cut = LINE_HYPHEN.search(bare) if bare.rstrip()[-1:] in LINE_MARKS else None
        last = len(found)
        if cut and k + 1 < len(body):
            q, j = body[k + 1]
            nxt = re.match(r"\s*([^\W_|@]*[^\W_]|[|@ſ][^\W_]+|[^\W_]+[|@ſ][^\W_]*)", q.lines[j])
            stem = re.search(r"[^\s—–(“\"]*$", cut[1])[0]
            if nxt and stem and (nxt[1][0].islower() or not nxt[1][0].isalpha() or stem.isupper()) and joined(stem.lstrip("“‘(\"'"), cut[2], nxt[1], lexicon, compounds):
                tail = re.split(r"[-‐]", stem)[-1]
                if p.own:
                    noise.append((p.span, i, "hyphen"))
                while last > start and found[last - 1].end() > cut.end(1) - len(tail):
                    last -= 1
                carried = (tail, (p, i), len(fixed))
                changes.append((cut.end(1) - len(tail), len(line), ""))
        lows = [m[0].lower() for m in found]
        for n in range(start, last):
            if lows[n] in lexicon.counts:
                continue
            m = found[n]
            word = misread(m[0], lexicon, lows[n - 1] if n else "", lows[n + 1] if n + 1 < len(found) else "")
            if word is not None:
                if m[0][0].isupper() and word[0].islower():
                    word = word[0].upper() + word[1:]
                wrong = True
                changes.append((*m.span(), word))
        if wrong and p.own:
            noise.append((p.span, i, "ocr"))
        out, at = [], 0
        for a, b, text in sorted(changes):
            if a >= at:
                out += [line[at:a], text]
                at = b
        fixed.append((p, i, "".join([*out, line[at:]]).rstrip() if not carried else "".join([*out, line[at:]])))
    return list(dict.fromkeys(noise)), reflowed(pages, fixed)


PARAGRAPH_END = re.compile(r"[.!?:]['”’\")]*\s*$")
COMPOUND_END = re.compile(r"\w[-‐]$")


def reflowed(pages: list[Page], fixed: list[tuple[Page, int, str]]) -> list[tuple[int, str]]:
    """Paragraphs of the repaired lines: they end at a blank line or before an indented one, and go on over page ends."""
    out: list[tuple[Page, list[str]]] = []
    last: tuple[Page, int] | None = None
    for p, i, text in fixed:
        turned = last is not None and last[0] is not p
        blank = i > 0 and p.kind[i - 1] == "blank" and any(k == "text" for k in p.kind[:i])
        indented = p.lines[i][:2].isspace()
        ended = not out or not out[-1][1] or bool(PARAGRAPH_END.search(out[-1][1][-1]))
        fresh = not out or (blank and not turned) or (indented and ended) or (turned and ended and text.strip()[:1].isupper() and len(out[-1][1][-1]) < 0.7 * max(map(len, out[-1][1])))
        if fresh:
            out.append((p, []))
        out[-1][1].append(text.strip())
        last = (p, i)
    whole = lambda parts: re.sub(r"\s+", " ", "".join(t if COMPOUND_END.search(t) else f"{t} " for t in parts if t)).strip()  # noqa: E731  a compound goes on without a blank
    return [(p.span, whole(parts)) for p, parts in out if p.own]


def scanned_sources(spans: DataFrame) -> DataFrame:
    """Sources whose spans are scanned pages: one page to a span, of many lines each."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    paged = F.when(F.col("page").isNotNull(), F.col("span_id"))
    by = spans.groupBy("source_id").agg(F.countDistinct(paged).alias("paged"), F.countDistinct("page").alias("pages"), F.avg(F.when(F.length(F.trim("text")) > 0, lines)).alias("breaks"))
    return by.where((F.col("paged") > 0) & (F.col("pages") >= 0.98 * F.col("paged")) & (F.col("breaks") >= 8)).select("source_id")


COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """kind, lang, key, n and the first and last source of the words, pairs and compounds of the rows of a task, added up as far as memory allows."""
    held: dict[tuple[str, str, str], list] = {}

    def rows() -> pd.DataFrame:
        return pd.DataFrame([(*k, *v) for k, v in held.items()], columns=["kind", "lang", "key", "n", "a", "b"])

    def add(kind: str, lang: str, found: Counter, source: str) -> None:
        for key, n in found.items():
            if (v := held.get((kind, lang, key))) is None:
                held[kind, lang, key] = [n, source, source]
            else:
                v[0] += n
                v[1], v[2] = min(v[1], source), max(v[2], source)

    for pdf in batches:
        for source, text, scan in zip(pdf["source_id"], pdf["text"], pdf["scan"]):
            low = text.lower()
            words = [w for w in LETTERS.findall(low) if len(w) < 40]
            times = Counter(words)
            if scan:
                add("scan", "", times, source)
            else:
                lang = language(times) or ""
                add("word", lang, times, source)
                add("total", lang, Counter({"": len(words)}), source)
                add("pair", "", Counter(f"{x} {y}" for x, y in pairwise(words)), source)
                if "-" in low:
                    add("compound", "", Counter(COMPOUND.findall(low)), source)
            if len(held) > HELD:
                yield rows()
                held.clear()
    yield rows()


def vocabulary(spans: DataFrame, scans: DataFrame) -> tuple[dict[str, dict[str, int]], dict[tuple[str, str], int], frozenset[str], frozenset[str]]:
    """Words of each language with their counts, pairs of neighbouring words, and compounds with hyphens, over all spans
    of sources that are no scans, rows as often as they stand there; and the words that recur in scans.

    A word must stand in two sources. What is rarer than TIMES, or than the part SHARE of its kind, is left out at every
    size, so that what the driver gets is bounded by 1 / SHARE.
    """
    texts = spans.where((F.coalesce("kind", F.lit("")) != "Code") & F.col("text").isNotNull()).select("source_id", "text")
    told = spread(texts).join(scans.withColumn("scan", F.lit(True)), "source_id", "left").withColumn("scan", F.coalesce("scan", F.lit(False)))
    counted = told.mapInPandas(_counted, "kind string, lang string, key string, n bigint, a string, b string")
    counted = counted.groupBy("kind", "lang", "key").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).persist(StorageLevel.MEMORY_AND_DISK)
    total = {r["lang"]: r["n"] for r in counted.where("kind = 'total'").collect()}
    of_lang = F.coalesce(*[F.when(F.col("lang") == lang, n) for lang, n in total.items()], F.lit(0))
    least = F.when(F.col("kind") == "word", F.greatest(F.lit(TIMES), of_lang * SHARE)).when(F.col("kind") == "scan", F.greatest(F.lit(RECURS), sum(total.values()) * F.lit(SHARE))).otherwise(F.greatest(F.lit(TIMES), sum(total.values()) * F.lit(SHARE)))
    kept = counted.where((F.col("kind") != "total") & (F.col("n") >= least) & (F.col("kind").isin("pair", "compound") | (F.col("a") != F.col("b"))))
    langs: dict[str, dict[str, int]] = defaultdict(dict)
    pairs: dict[tuple[str, str], int] = {}
    compounds, often = set(), set()
    for r in kept.select("kind", "lang", "key", "n").collect():
        if r["kind"] == "word":
            langs[r["lang"]][r["key"]] = r["n"]
        elif r["kind"] == "pair":
            pairs[tuple(r["key"].split(" "))] = r["n"]
        else:
            (compounds if r["kind"] == "compound" else often).add(r["key"])
    counted.unpersist()
    return {lang: langs[lang] for lang in sorted(langs) if lang}, pairs, frozenset(compounds), frozenset(often)


def _worked(spans: DataFrame, schema: str, pick) -> DataFrame:
    spark = spans.sparkSession
    scans = scanned_sources(spans).persist(StorageLevel.MEMORY_AND_DISK)
    scans.count()  # from here on its size is known, and Spark broadcasts it where it is small enough
    learned = spark.sparkContext.broadcast(vocabulary(spans, scans))
    pages = spans.join(scans, "source_id", "left_semi").select("source_id", "span_id", "span_index", "page", "text").dropDuplicates(["span_id"])
    block, at = (F.col("span_index") / BLOCK).cast("bigint"), F.pmod("span_index", F.lit(BLOCK))
    near = F.array_compact(F.array(block, F.when((at < AROUND) & (block > 0), block - 1), F.when(at >= BLOCK - AROUND, block + 1)))
    pages = pages.where("span_index is not null").withColumn("home", block).withColumn("block", F.explode(near))
    made: dict[str, Lexicon] = {}

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        langs, pairs, compounds, often = learned.value
        if not made:
            made.update({k: Lexicon(v, pairs, often) for k, v in langs.items()})
        pdf = pdf.sort_values(["span_index", "span_id"])
        block = int(pdf["block"].iloc[0])
        own = [Page(int(s), int(x), None if pd.isna(g) else g, t, int(h) == block) for s, x, g, t, h in zip(pdf["span_id"], pdf["span_index"], pdf["page"], pdf["text"], pdf["home"])]
        return pick(str(pdf["source_id"].iloc[0]), block, *cleaned(own, block == 0, made, compounds))

    return pages.repartition(tasks(spark), "source_id", "block").groupBy("source_id", "block").applyInPandas(work, schema)


def _spans(spans: DataFrame) -> DataFrame:
    return spans.select("span_id", "source_id", F.col("span_index").cast("bigint").alias("span_index"), "kind", "text", F.col("page").cast("double").alias("page")).where("span_id is not null and source_id is not null")


def noise(spans: DataFrame) -> DataFrame:
    """span_id, line_no (from 0) and noise for each line of a scanned source with noise of that kind.

    Null and blank texts have none. Repeated spans count once. A source without a page number has no noise, nor has one
    whose spans don't stand for pages. Extra columns are ignored; an empty table gives an empty table.
    """
    def pick(source: str, block: int, found: list, paragraphs: list) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["span_id", "line_no", "noise"])

    return _worked(_spans(spans), "span_id bigint, line_no bigint, noise string", pick)


def paragraphs(spans: DataFrame) -> DataFrame:
    """source_id, block, paragraph_no (in the block), span_id on which it begins, and text of each repaired paragraph."""
    def pick(source: str, block: int, found: list, text: list) -> pd.DataFrame:
        return pd.DataFrame([(source, block, n, s, t) for n, (s, t) in enumerate(text)], columns=["source_id", "block", "paragraph_no", "span_id", "text"])

    return _worked(_spans(spans), "source_id string, block bigint, paragraph_no bigint, span_id bigint, text string", pick)
