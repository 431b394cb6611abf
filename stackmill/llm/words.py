"""Common words by language, shared by the text operators."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Frequent function words.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you we were all their there been has if more when will would who so no what can how than before after its only some most although until because while under between both each few many never did does these those such then should must nor where why them".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn ob seit während diese dieser dieses dann doch schon immer wir ihr ihre wo warum zwischen kein keine häufig heute zunächst danach viele was erst möglich".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par plus sur au pas ne ce avec il sont se ou son aux cette ont mais comme on tout nous sa été même où si leur elle ces dès déjà très depuis toujours après avant sous entre sans aussi cela donc car ni là l d c s n".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está aunque así según aquí allí sería estar él ella después antes además ni nos les cada muy fue son tan porque".split(),
    "ru": "и в не на что он я с а то как это по но они мы из у за от же так для был была его к до все если или бы есть при после чем нет поэтому этого того здесь каждый будет быть только когда ещё где".split(),
}

LETTERS = re.compile(r"[^\W\d_]+")
#: The languages in which a word is common.
LANGUAGES_OF = {w: tuple(lang for lang in sorted(COMMON) if w in COMMON[lang]) for words in COMMON.values() for w in words}


def language(words: Counter) -> str | None:
    """The language that has the most common words among these; the first by name where equally many are, None where none is."""
    found: Counter = Counter()
    for w, n in words.items():
        for lang in LANGUAGES_OF.get(w, ()):
            found[lang] += n
    return min(found, key=lambda lang: (-found[lang], lang), default=None)


@F.pandas_udf(StringType())
def language_of(text: pd.Series) -> pd.Series:
    """The language of each text; null for a text without a common word and for a null one."""
    return text.map(lambda t: language(Counter(LETTERS.findall(t.lower()))), na_action="ignore")


@F.pandas_udf(StructType([StructField("lang", StringType()), StructField("words", StringType())]))
def told_words(text: pd.Series) -> pd.DataFrame:
    """The language of each text, and its words of four letters or more that are common in none, parted by blanks."""
    langs, kept = [], []
    for t in text:
        words = LETTERS.findall(t.lower()) if t else []
        langs.append(language(Counter(words)))
        kept.append(" ".join([w for w in words if len(w) >= 4 and w not in LANGUAGES_OF]))
    return pd.DataFrame({"lang": langs, "words": kept})
