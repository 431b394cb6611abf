import pytest

from stackmill.llm.lexicon import MISREADINGS, Lexicon
from stackmill.llm.scans import is_page_number, letters_apart, misread, noise, number, paragraphs

SENTENCES = ["The bridge of the first harbour was closed before the winter of the long storm.", "Some of the letters must be copied twice before a reader will find the question.",
             "A well-known harbour is better than a quiet one, and the storm follows from it.", "They found that the winter and the bridge share a question about the first letter."]
SCHEMA = "span_id bigint, source_id string, span_index bigint, kind string, text string, page bigint, line_no string"


@pytest.fixture(scope="module")
def spans(spark):
    rows = [(i, f"plain{i % 5}", i, "Paragraph", " ".join(SENTENCES), None, "x") for i in range(40)]
    pages = [
        "THE BRIDGE AND THE STORM\n\nThe bridge of the first har-\nbour was c1osed before the winter of\nthe long storm. Some of the letters\nmust be copied twice before a\nreader will find the question.\nA well-\nknown harbour is better than a quiet\none, and the storm fol-",
        "58   THE BRIDGE AND THE STORM\nlows from it. They found that the\nwinter and the bridge share a\nquestion about tbe first letter.\nTake the points A B C D on the storm.\nTable 2.\n17\n285\nThe b r i d g e of the first\nharbour that",
        "3  Harbour   59\nwas closed before the winter of the\nlong storm. Some of the letters must\nbe copied twice before a reader will\nfind the question. The bridge of the\nfirst harbour was closed before the\nwinter of the long storm.\nSome of the\nletters there",
        "60   THE 8RIDGE AND THE STORM\nmust be copied twice before a reader\nwill find the question. They found\nthat the winter and the bridge share\na question about the first letter.\nThe bridge of the first harbour was\nclosed before the winter.\nSome\nof the letters",
        "3  Harbour   61\nmust be copied twice before a reader\nwill find the question. They found\nthat the winter and the bridge share\na question about the first letter.\nThe bridge of the first harbour was\nclosed before the winter.\nSome\nwinter letters",
    ]
    rows += [(100 + i, "scan", i, "Paragraph", t, 57 + i, "x") for i, t in enumerate(pages)] + [(100, "scan", 0, "Paragraph", pages[0], 57, "x"), (105, "scan", 5, "Paragraph", None, 62, "x"), (106, "scan", 6, "Paragraph", "", None, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def test_noise(spans):
    got = {(r["span_id"], r["line_no"], r["noise"]) for r in noise(spans).collect()}
    assert got == {(100, 2, "hyphen"), (100, 3, "ocr"), (100, 9, "hyphen"), (101, 0, "header"), (101, 3, "ocr"), (101, 8, "letterspace"), (102, 0, "header"), (103, 0, "header"), (104, 0, "header")}


def test_paragraphs(spans):
    text = " ".join(r["text"] for r in sorted(paragraphs(spans).collect(), key=lambda r: (r["source_id"], r["block"], r["paragraph_no"])))
    for part in ("first harbour was closed before", "a well-known harbour", "storm follows from it", "about the first letter", "The bridge of the first harbour was closed"):
        assert part.lower() in text.lower()
    assert "58" not in text and "har-" not in text


def test_empty(spark):
    assert noise(spark.createDataFrame([], SCHEMA)).count() == 0


def test_page_numbers():
    assert is_page_number("- xii -", 12) and is_page_number("Page l2", 12) and is_page_number("12", 12) and is_page_number("3 of 412", 3) and is_page_number("[98]", 98)
    assert not is_page_number("285", 12) and not is_page_number("12 boxes", 12) and not is_page_number("Table 10.", 10)
    assert number("lO2") == 102 and number("xcviii") == 98 and number("word") is None


def test_letters_apart():
    assert letters_apart("the b r i d g e is") == [(4, 15)] and letters_apart("points A B C D on") == [] and letters_apart("A C T") == [(0, 5)] and letters_apart("x y") == []


def test_lexicon_against_brute_force():
    words = {w: 1 for w in "modern modem barn bam class dass still stilt hat bat with willi".split()}
    lex = Lexicon(words)
    assert lex.readings("rnodern")[0][2] == "modern" and [w for _, _, w in lex.readings("class")] == ["dass"] and [w for _, _, w in lex.readings("vvith")] == ["with"]
    assert lex.readings("zzz") == []

    def edits(a, b):  # two letters for one that they are misread from are one edit
        d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and b[j - 1] in MISREADINGS.get(a[i - 2 : i], ()):
                    d[i][j] = min(d[i][j], d[i - 2][j - 1] + 1)
        return d[-1][-1]

    for w in ("stil", "hatt", "barm", "clas", "modeern", "wilt", "x"):
        for most in (1, 2):
            assert {x for _, _, x in lex.nearest(w, most)} == {x for x in words if 0 < edits(w, x) <= most}
    assert [w for e, _, w in lex.nearest("rnodern", 1)] == ["modern"]  # two letters for one are one edit


def test_unlisted_misreadings_are_repaired_where_they_fit():
    lex = Lexicon({"bridge": 5, "fridge": 9, "question": 4, "take": 3}, {("the", "bridge"): 4, ("bridge", "of"): 4, ("a", "question"): 3, ("question", "about"): 3, ("to", "make"): 3}, frozenset({"tame"}))
    assert misread("brodge", lex, "the", "of") == "bridge" and misread("bridqe", lex, "the", "of") == "bridge"  # substitutions
    assert misread("brxidge", lex, "the", "of") == "bridge" and misread("brdge", lex, "the", "of") == "bridge"  # a letter more, a letter less
    assert misread("qwestiom", lex, "a", "about") == "question"  # two edits
    assert misread("brodge", lex, "mister", "spoke") is None and misread("tame", lex, "the", "of") is None and misread("brodge", lex) is None


def test_context_decides():
    lex = Lexicon({"bar": 5, "har": 9}, {("the", "bar"): 4})
    assert lex.best([(1, -9, "har"), (1, -5, "bar")], "the", "was") == "bar" and lex.best([(1, -9, "har"), (1, -5, "bar")], "a", "was") == "har"


def test_readings_do_not_depend_on_earlier_ones():
    lex = Lexicon({"sillion": 3})
    assert lex.readings("5i11ion", 1) == lex.readings("5i11ion", 2) == []
    assert lex.readings("5i11ion", 3) == [(3, -3, "sillion")]
    assert lex.readings("5i11ion", 2) == []
