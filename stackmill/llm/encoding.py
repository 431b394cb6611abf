"""Text that was decoded with the wrong character encoding: found by description length, and restored.

A chain is a short list of wrong readings to be undone, such as "UTF-8 read as cp1252", twice. Every chain that changes
a sentence gives a candidate; each candidate is compressed with a zstandard dictionary of its language, made from counts
over all clean sentences of the corpus itself, and the candidate with the smallest description (its compressed bytes, what is
odd in its spelling, and the cost of its chain) is taken. Without a gain the sentence stays as it is.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackmill.llm.words import COMMON, LANGUAGES_OF, LETTERS, language
from stackmill.llm.zdict import dictionary
from stackmill.session import spread

# Encodings that UTF-8 is often read as, and pairs (read as, written in) of single-byte encodings.
UTF8_READ_AS = ["cp1252", "mac_roman", "cp1250", "cp1251", "cp437", "cp850", "cp866", "koi8_r", "iso8859_2", "iso8859_15"]
MISREAD = [("cp1252", "cp1251"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1251", "cp1252"),
           ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "koi8_r"), ("cp1251", "cp866"), ("cp1252", "cp866"), ("mac_roman", "cp1251"), ("cp437", "cp1251")]
#: Bytes that a step of a chain costs: UTF-8 hardly ever comes out of text by chance, another single-byte reading does.
UTF8_COST, MISREAD_COST, CUT_COST = 1, 4, 1
#: Bytes that a letter beyond Latin-1 costs which the clean sentences don't have, and each place where a spelling is odd.
UNKNOWN_COST, ODD_COST = 3, 2
#: A capital after a small letter, or a sign that is no letter inside of a word.
ODD = re.compile(r"(?<=[a-zß-öø-ÿ])[À-ÖØ-Þ\u0160\u017d\u0178](?=[a-zß-öø-ÿ]|\b)|(?<=[^\W\d_])[^\x00-\x7f\w“”’‘—–…‐\u00ad¬](?=[^\W\d_])")
#: Share of the clean sentences that must hold a letter beyond Latin-1 for it to be known.
KNOWN_LETTER = 1e-5
#: Share of a language's clean sentences that must hold a word for it to be frequent.
FREQUENT = 4e-3
#: Bytes that a match is long at least, and what it costs in letters of ASCII; words that a task counts before it hands them on.
MATCHED, SEQUENCE, FLUSH = 5, 5, 1 << 18
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Signs that are quoted in order to speak about them.
QUOTED = re.compile(r"(?<![^\s(])(?:" + "|".join(rf"{a}[^A-Za-z\s“”\"«»]{{1,6}}{b}" for a, b in ("“”", '""', "«»", "„“", "‘’")) + r")(?![^\s.,;:!?)])")
#: The first sign of a UTF-8 sequence shown in cp1252 of which the others were lost, and the signs that it may have begun.
CUT = re.compile(r"(?<![^\W\d_])[âÃÂ](?=\s|[a-z]+â(?!\w))|(?<=[a-z,.;])â(?!\w)")
CUT_LEAD = re.compile("[âÃÂ]")
CUT_SIGNS = {"â": "’”—", "Ã": "à", "Â": "°\u00a0"}
WORD = re.compile(r"[^\x00-\x20\x7f“”’‘—–…‐]+")
QUOTED_OR_TOKEN = re.compile(QUOTED.pattern + r"|(?P<token>[^\x00-\x20]+)")
LETTER, LATIN, CYRILLIC = re.compile(r"[^\W\d_]"), re.compile("[A-Za-z]"), re.compile("[Ѐ-ӿ]")
# Marks of a word that goes on in the next line, and letter forms of old or careful print.
WORD_SIGNS, ANY_SIGNS, LINE_MARKS, PRINT = "’‘“”…—–°±¿¡«»", "’‘“”…—–°±¿¡«»·§€£×", "¬\u00ad‐", "ﬀﬁﬂﬃﬄſ"
GONE = "\N{REPLACEMENT CHARACTER}"
#: A sign that stands in no text that was read rightly.
WIDE = re.compile("[^\x00-ÿ]")
STRANGE = re.compile(rf"[^\x00-\x7f\w{ANY_SIGNS}{LINE_MARKS}{GONE}\u2009\u00a0☐•]")


@lru_cache(maxsize=None)
def _reader(codec: str) -> tuple[re.Pattern, dict[str, int]]:
    """A pattern for UTF-8 sequences as `codec` shows them, and the byte of each character."""
    at: dict[int, str] = {}
    for b in range(0x80, 0x100):
        shown = bytes([b]).decode(codec, errors="ignore")
        at[b] = (shown if ord(shown or "a") > 127 else "") + (chr(b) if codec == "cp1252" or not shown else "")
    at[0xA0] += " " if codec == "cp1252" else ""
    some = lambda lo, hi: "[" + re.escape("".join(at[b] for b in range(lo, hi + 1))) + "]"
    rest = some(0x80, 0xBF)
    pattern = re.compile(f"{some(0xC2, 0xDF)}{rest}|{some(0xE0, 0xEF)}{rest}{{2}}|{some(0xF0, 0xF4)}{rest}{{3}}")
    return pattern, {c: b for b, chars in at.items() for c in chars}


def read_again(text: str, codec: str) -> str:
    """`text` with each UTF-8 sequence that was shown in `codec` decoded; what is no such sequence stays."""
    pattern, byte = _reader(codec)

    def one(m: re.Match) -> str:
        try:
            return bytes(byte[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return pattern.sub(one, text)


def _again(word: str, shown: str, meant: str, signs: str) -> str:
    """A word encoded in `shown` and decoded in `meant`; as it is where that fails or gives what no word is made of."""
    try:
        got = word.encode(shown).decode(meant)
    except UnicodeError:
        return word
    strange = any(c > "\x7f" and not c.isalpha() and c not in signs for c in got)
    return word if strange or (LATIN.search(got) and CYRILLIC.search(got)) else got


@lru_cache(maxsize=1 << 16)
def rewritten(token: str, k: int) -> str:
    """A token by the pair k of MISREAD: as a whole if a sign in it stands in no text, else its words of two letters or more."""
    if token[-1] in LINE_MARKS:
        return rewritten(token[:-1], k) + token[-1] if len(token) > 1 else token
    if STRANGE.search(token) and (got := _again(token, *MISREAD[k], ANY_SIGNS)) != token:
        return got
    return WORD.sub(lambda m: m[0] if m[0].isascii() or len(LETTER.findall(m[0])) < 2 else _again(m[0], *MISREAD[k], WORD_SIGNS), token)


def oddities(text: str) -> int:
    """Places where a spelling is odd, and twice those where a sequence is cut."""
    return len(ODD.findall(text)) + (2 * len(CUT.findall(text)) if CUT_LEAD.search(text) else 0)


class Describer:
    """Description length of a text: its smallest compressed size over dictionaries of languages, and its odd spellings."""

    def __init__(self, dictionaries: dict[str, bytes], alphabet: str = "", words: frozenset[str] = frozenset(), level: int = 3) -> None:
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.by, self.alphabet, self.words = {}, {*alphabet, *PRINT}, words
        for lang, d in dictionaries.items():
            known = zstandard.ZstdCompressionDict(d)
            known.precompute_compress(compression_params=params)
            self.by[lang] = zstandard.ZstdCompressor(dict_data=known, compression_params=params)
        self.latin = [c for lang, c in self.by.items() if lang != "ru"] or [*self.by.values()]
        self.cyrillic = [self.by["ru"]] if "ru" in self.by else self.latin

    def read(self, sentence: str) -> list:
        """The compressors to compare candidates of a sentence by: that of the language of its common words, else all of its script."""
        lang = language(Counter(LETTERS.findall(sentence.lower())))
        return [self.by[lang]] if lang in self.by else []

    def __call__(self, text: str, own: list = []) -> int:
        raw = text.encode("utf-8", errors="replace")
        unknown = sum(c not in self.alphabet and c.isalpha() for c in WIDE.findall(text))
        by = (self.cyrillic if CYRILLIC.search(text) else own) or self.latin
        return min(len(c.compress(raw)) for c in by) + UNKNOWN_COST * unknown + ODD_COST * oddities(text)

    def plain(self, sentence: str) -> bool:
        """True if all words of a sentence with other than ASCII letters are frequent in the clean sentences."""
        return not STRANGE.search(sentence) and all(w in self.words for w in WORD.findall(sentence) if not w.isascii() and LETTER.search(w))


def _over(text: str, change) -> str:
    """`change` applied to the text around quoted signs."""
    out, last = [], 0
    for m in QUOTED.finditer(text):
        out += [change(text[last : m.start()]), m[0]]
        last = m.end()
    return "".join([*out, change(text[last:])])


def _plainly(text: str, change) -> str:
    return change(text)


def misread(text: str) -> Iterator[tuple[int, str]]:
    """(k, reading) for each pair k of MISREAD that changes the text around quoted signs."""
    cuts, last = [], 0
    for m in QUOTED_OR_TOKEN.finditer(text):
        if m["token"] and not m["token"].isascii():
            cuts += [text[last : m.start()], m["token"]]
            last = m.end()
    rest = text[last:]
    for k in range(len(MISREAD)):
        new = [rewritten(t, k) for t in cuts[1::2]]
        if new != cuts[1::2]:
            yield k, "".join([x for pair in zip(cuts[::2], new) for x in pair]) + rest


@lru_cache(maxsize=1)
def _anything() -> re.Pattern:
    """A UTF-8 sequence as any of the encodings shows it."""
    return re.compile("|".join(_reader(codec)[0].pattern for codec in UTF8_READ_AS))


def _mostly_sequences(text: str) -> bool:
    """True if at least half of the characters outside ASCII stand in UTF-8 sequences, as they all do before such a step."""
    return 2 * sum(map(len, _anything().findall(text))) >= sum(c > "\x7f" for c in text)


def candidates(sentence: str, plain: bool = False, steps: int = 3) -> dict[str, tuple[str, int]]:
    """Every reading that at most `steps` undone steps give, with its cheapest chain and the cost of it: UTF-8 shown in
    an encoding at each step, one single-byte encoding shown in another at one of them, and cut sequences completed. Of a
    `plain` sentence no single-byte reading is tried."""
    seen, layer = {sentence: ("", 0)}, [sentence]

    def found(got: str, chain: str, cost: int, fresh: list[str]) -> None:
        if got not in seen or cost < seen[got][1]:
            if got not in seen:
                fresh.append(got)
            seen[got] = (chain.strip(), cost)

    for _ in range(steps):
        fresh: list[str] = []
        for text in layer:
            chain, cost = seen[text]
            over = _over if QUOTED.search(text) else _plainly
            sequences = SIDE_BY_SIDE.search(text) and _anything().search(text)
            if sequences and ("<" not in chain.replace("utf8<", "") or _mostly_sequences(text)):
                for codec in UTF8_READ_AS:
                    if _reader(codec)[0].search(text):
                        found(over(text, lambda t, codec=codec: read_again(t, codec)), f"{chain} utf8<{codec}", cost + UTF8_COST, fresh)
            if CUT.search(text):
                for lead, signs in CUT_SIGNS.items():
                    for sign in signs if lead in text else "":
                        found(over(text, lambda t, lead=lead, sign=sign: CUT.sub(lambda m: sign if m[0] == lead else m[0], t)), f"{chain} cut<{sign}", cost + CUT_COST, fresh)
            if not plain and (not chain or not sequences) and "<" not in chain.replace("utf8<", "").replace("cut<", ""):  # UTF-8 steps come to their end first
                for k, got in misread(text):
                    found(got, f"{chain} {MISREAD[k][1]}<{MISREAD[k][0]}", cost + MISREAD_COST, fresh)
        layer = fresh
        if not layer:
            break
    return seen


def restore(sentence: str, size: Describer) -> tuple[str, str]:
    """The sentence in its shortest description, and the chain that led to it ('' where it stays as it is)."""
    seen = candidates(sentence, size.plain(sentence))
    if len(seen) == 1:
        return sentence, ""
    own, odd = size.read(sentence), oddities(sentence)
    best = min((t for t in seen if oddities(t) <= odd), key=lambda t: (size(t, own) + seen[t][1], seen[t][1], t))  # a reading that is odder is never shorter by as much as its chain costs
    return best, seen[best][0]


def repaired(text: str, restored) -> tuple[str, str | None, bool]:
    """The text restored as far as possible; the chains used; whether something was decoded wrongly and is lost.

    `restored` gives the reading and the chain of a sentence. Lost is what a decoder gave up as U+FFFD, and what a chain
    could complete by a guess only.
    """
    out, chains, last = [], set(), 0
    lost = GONE in _over(text, lambda t: t) and GONE in QUOTED.sub("", text)
    for m in [*SENTENCE.finditer(text), None]:
        part, sep = (text[last : m.start()], m[0]) if m else (text[last:], "")
        last = m.end() if m else last
        if not part.isascii():
            part, chain = restored(part)
            if chain:
                chains.add(chain)
                lost = lost or "cut<" in chain
        out += [part, sep]
    return "".join(out), "; ".join(sorted(chains)) or None, lost


CLEAN = re.compile(r"[^\x00-\x7fäöüßéèêëàâîïôûùçñáíóú]{2}|[^\x00-\x7f“”‘’—–…¿¡«»°±µÀ-ſ]|[ÃÂÐÑ]")
RUSSIAN = re.compile(r"[Ѐ-џ\s!-/:-@\[-`{-~\d—–«»]+")
#: What every shown UTF-8 sequence begins with.
SIDE_BY_SIDE = re.compile("[^\x00-\x7f][^\x00-\x7f]|[Â-ß] ")
BEYOND = re.compile("[Ā-ɏЀ-ӿ]")
#: A sign of three bytes and what stands on both sides of it.
BESIDE = re.compile("(?=(.[\u0800-\uffff].))")


def clean_language(sentence: str) -> str | None:
    """The language of a clean sentence with two common words or more; None for any other sentence.

    A sentence is clean if no two characters outside ASCII stand side by side that are no ordinary letters, or if it is
    wholly Cyrillic.
    """
    if not sentence.isascii() and CLEAN.search(sentence) and not RUSSIAN.fullmatch(sentence):
        return None
    found: dict[str, int] = {}
    for w in LETTERS.findall(sentence.lower()):
        for lang in LANGUAGES_OF.get(w, ()):
            found[lang] = found.get(lang, 0) + 1
    lang = min(found, key=lambda lang: (-found[lang], lang), default=None)
    return lang if lang and found[lang] >= 2 else None


def dictionaries(texts: DataFrame, text: str = "text", size: int = 16384) -> tuple[dict[str, bytes], str, frozenset[str]]:
    """A zstandard dictionary for each language of the corpus; the letters beyond Latin-1 of the clean sentences; and the
    words with other than ASCII letters that are frequent in those of a language.

    All of it comes from counts over all clean sentences: of those that hold a word or a letter, and of bytes. A
    dictionary holds the words, and the signs between two others, that save most, as many as fit, and codes what it
    doesn't hold by the count of its bytes.
    """
    parts = spread(texts.select(text).where(F.length(F.trim(text)) > 0))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, spelled, few = defaultdict(Counter), defaultdict(Counter), Counter()

        def rows() -> pd.DataFrame:
            many = [(kind, lang, key, n) for kind, by in (("word", words), ("spelled", spelled)) for lang, counts in by.items() for key, n in counts.items()]
            return pd.DataFrame(many + [(*key, n) for key, n in few.items()], columns=["kind", "lang", "key", "n"])

        for pdf in batches:
            clean = defaultdict(list)
            for t in pdf[text]:
                for s in SENTENCE.split(t):
                    lang = clean_language(s)
                    if lang is None:
                        continue
                    clean[lang].append(s)
                    held = {f" {w} " for w in s.split()}
                    if not s.isascii():
                        held.update(BESIDE.findall(f" {s} "))
                        spelled[lang].update({w for w in WORD.findall(s) if not w.isascii()})
                        if BEYOND.search(s):
                            few.update({("letter", lang, c) for c in s if c > "ÿ" and c.isalpha()})
                    words[lang].update(held)
            for lang, sentences in clean.items():
                few["sentences", lang, ""] += len(sentences)
                found = np.bincount(np.frombuffer("".join(sentences).encode("utf-8", errors="replace"), np.uint8))
                few.update({("byte", lang, str(b)): int(n) for b, n in enumerate(found) if n})
            if sum(map(len, words.values())) > FLUSH:
                yield rows()
                for counts in (words, spelled, few):
                    counts.clear()
        yield rows()

    counted = parts.mapInPandas(count, "kind string, lang string, key string, n bigint").groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    sentences: dict[str, int] = {}
    letters: Counter = Counter()
    octets: dict[str, list[int]] = {}
    for r in counted.where("kind not in ('word', 'spelled')").collect():  # the alphabet and 256 bytes a language
        if r["kind"] == "sentences":
            sentences[r["lang"]] = r["n"]
        elif r["kind"] == "letter":
            letters[r["key"]] += r["n"]
        else:
            octets.setdefault(r["lang"], [0] * 256)[int(r["key"])] = r["n"]
    out, often = {}, set()
    for lang in sorted(sentences):
        of = counted.where(F.col("lang") == lang)
        length = F.octet_length("key")
        saving = F.col("n") * (2 * length - F.length("key") - SEQUENCE)  # another byte than ASCII is about as dear as two letters
        words = of.where("kind = 'word'").where(length.between(MATCHED, size) & (saving > 0))
        ranked = [some.orderBy(saving.desc(), "key").limit(size // (MATCHED - 1)) for some in (words.where(length > F.length("key")), words)]  # more don't fit
        best = [[(r["key"], r["n"]) for r in some.collect()] for some in ranked]
        out[lang] = _dictionary(*best, octets[lang], size)
        frequent = of.where("kind = 'spelled'").where(F.col("n") >= FREQUENT * sentences[lang])  # 1 / FREQUENT times the words of a sentence at most
        often |= {r["key"] for r in frequent.collect() if not ODD.search(r["key"])}
    counted.unpersist()
    least = max(1, KNOWN_LETTER * sum(sentences.values()))
    return out or {"en": b" the of and to in is "}, "".join(sorted(c for c, n in letters.items() if n >= least)), frozenset(often)


def _dictionary(other: list[tuple[str, int]], words: list[tuple[str, int]], octets: list[int], size: int) -> bytes:
    """A zstandard dictionary of the first words with other than ASCII signs, by which readings differ, in half of `size`
    bytes, of the first of all words in what is left, and of the bytes that are in none of them. A word of which a single-byte
    reading comes more often is left out: it is a misread one that stands in clean sentences."""
    count, content, rest = dict(other), b"", [*octets]
    for some, room in ((other, size // 2), (words, size)):
        for key, n in some:
            w = key.encode()
            new = w + content[1:] if content[:1] == w[-1:] == b" " else w + content  # the first words come last, where they are nearest
            if w in content or len(new) > room or (not key.isascii() and any(count.get(f" {rewritten(key.strip(), k)} ", 0) > n for k in range(len(MISREAD)))):
                continue
            content = new
            if key[0] == key[-1] == " ":
                for b in w.strip():
                    rest[b] -= n
    return dictionary(content.rjust(8), rest)


def reread(spans: DataFrame, text: str = "text") -> DataFrame:
    """Every row with `restored`, the `chain` used (null if none), `lost` (signs that cannot be told any more) and
    `affected`, true if the text was decoded wrongly, be it in one sentence.

    Null, empty and wholly ASCII texts are never affected and come back unchanged. Columns of the input keep their
    names; inputs that already have one of the new names lose it to the new one. Texts of any length are taken whole,
    sentence by sentence; a sentence that recurs in a task is compressed once. An empty table gives an empty table.
    """
    learned = dictionaries(spans, text)
    new = ["restored", "chain", "lost", "affected"]
    rows = spans.drop(*new)
    odd = F.coalesce(F.col(text).rlike(r"[^\x00-\x7f]"), F.lit(False))
    plain = rows.where(~odd).withColumns({"restored": F.col(text), "chain": F.lit(None).cast("string"), "lost": F.lit(False)})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = Describer(*learned)
        restored = lru_cache(maxsize=1 << 15)(lambda s: restore(s, size))
        for pdf in batches:
            got = [repaired(t, restored) for t in pdf[text]]
            yield pdf.assign(restored=[g[0] for g in got], chain=[g[1] for g in got], lost=[g[2] for g in got])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    done = spread(rows.where(odd)).mapInPandas(work, f"{schema}, restored string, chain string, lost boolean")
    return plain.unionByName(done).withColumn("affected", F.col("chain").isNotNull() | F.col("lost"))
