import random
from collections import Counter

import pytest
import xxhash
import zstandard

from stackmill.llm.encoding import dictionaries
from stackmill.llm.zdict import code_lengths, dictionary


def _sizes(made, texts):
    known = zstandard.ZstdCompressionDict(made, dict_type=zstandard.DICT_TYPE_FULLDICT)
    packed = [zstandard.ZstdCompressor(dict_data=known).compress(t) for t in texts]
    assert [zstandard.ZstdDecompressor(dict_data=known).decompress(p) for p in packed] == texts
    return [len(p) for p in packed]


def test_dictionaries_of_any_counts_are_read_by_zstandard():
    draw = random.Random(5)
    texts = ["Où la trame s’arrête".encode(), bytes(range(256)), draw.randbytes(900), b"the house of the mouse"]
    for counts in ([0] * 256, [1 << 40] + [0] * 255, [2**n if n < 60 else 0 for n in range(256)], *([draw.choice([0, 1, 9, 1000, draw.randrange(10**9)]) for _ in range(256)] for _ in range(50))):
        assert sum(2.0**-n for n in code_lengths(counts)) == 1 and max(code_lengths(counts)) <= 11
        _sizes(dictionary(b" the house of words ", counts), texts)


def test_counted_bytes_are_cheap():
    text = b"zqxj zjqx qzxj xqjz jxzq qjzx xzjq"
    counts = [0] * 256
    for b, n in Counter(text).items():
        counts[b] = 1000 * n
    assert _sizes(dictionary(b" nothing alike ", counts), [text])[0] < _sizes(dictionary(b" nothing alike ", [0] * 256), [text])[0] - 10


@pytest.fixture(scope="module")
def sentences():
    """Sentences of which those with one word have larger hashes than nearly all others, so that no sample by hash holds them."""
    rare = [s for i in range(9000) if xxhash.xxh64_intdigest(s := f"Der Überhang und die Rechnung {i} ist das Ende.") > 0.99 * 2**64]
    assert len(rare) >= 40
    return [f"Die Prüfung Nummer {i} ist für das Haus und der Bau." for i in range(4000)] + rare


def test_all_clean_sentences_count(spark, sentences):
    by, _, words = dictionaries(spark.createDataFrame([(s,) for s in sentences], "text string"))
    assert "Überhang" in words and "Überhang".encode() in by["de"]


def test_splits_of_the_input_do_not_matter(spark, sentences):
    df = spark.createDataFrame([(s,) for s in sentences], "text string")
    assert dictionaries(df.repartition(5)) == dictionaries(df.repartition(17)) == dictionaries(df.coalesce(1))
