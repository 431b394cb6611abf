import pytest

from stackmill.operators import chunking as c

# Golden vectors of the splitter.
RECURSIVE = [
    ("alpha\n\nbeta\n\ngamma", 13, 0, ["alpha\n\nbeta", "gamma"]),
    ("one two three four five six seven eight", 15, 5, ["one two three", "four five six", "six seven", "eight"]),
    ("The quick brown fox jumps over the lazy dog near the river bank at dawn", 30, 8, ["The quick brown fox jumps over", "over the lazy dog near the", "the river bank at dawn"]),
    ("supercalifragilisticexpialidocious", 10, 2, ["supercalif", "ifragilist", "sticexpial", "alidocious"]),
    ("# Heading\n\nFirst paragraph here is short.\n\nSecond paragraph that is quite a bit longer than the first one and will need splitting.", 50, 10,
     ["# Heading\n\nFirst paragraph here is short.", "Second paragraph that is quite a bit longer than", "than the first one and will need splitting."]),
    ("line one\nline two\nline three\nline four\nline five", 20, 5, ["line one\nline two", "line three", "line four\nline five"]),
    ("", 50, 10, []),
    ("short text", 100, 10, ["short text"]),
]
HEADINGS = [
    ("testing_Effective-Software-Testing__Chapter-09-Integration.md", "# Chapter 9\n\nIntro to integration testing here.\n\n## Database tests\n\nWe submit SQL to the database and check the results returned.\n\n### DAO\n\nThe DAO class wraps the queries.", 80,
     ["Effective-Software-Testing > Chapter-09-Integration > Chapter 9\n\nIntro to integration testing here.", "Effective-Software-Testing > Chapter-09-Integration > Chapter 9 > Database tests\n\nWe submit SQL to the database and check the results returned.",
      "Effective-Software-Testing > Chapter-09-Integration > Chapter 9 > Database tests > DAO\n\nThe DAO class wraps the queries."]),
    ("misc_Some-Book__Plain.md", "Just plain text with no markdown headers at all, several sentences long to force packing into a couple of chunks perhaps.", 50,
     ["Some-Book > Plain\n\nJust plain text with no markdown headers at all,", "Some-Book > Plain\n\nat all, several sentences long to force packing", "Some-Book > Plain\n\npacking into a couple of chunks perhaps."]),
    ("lang_Some-Book__Ch1.md", "# Title\n\nIntro text here.\n\n```\n# not a header\nsome code line\n```\n\nAfter the code block.", 120, ["Some-Book > Ch1 > Title\n\nIntro text here.  \n```\n# not a header\nsome code line\n```  \nAfter the code block."]),
    ("arch_Book__Ch2.md", "# A\n\nUnder section A here.\n\n## B\n\nUnder subsection B.\n\n# C\n\nUnder section C only.", 120, ["Book > Ch2 > A\n\nUnder section A here.", "Book > Ch2 > A > B\n\nUnder subsection B.", "Book > Ch2 > C\n\nUnder section C only."]),
]


@pytest.mark.parametrize("text,size,overlap,expected", RECURSIVE)
def test_recursive(text, size, overlap, expected):
    assert c.split_recursive(text, size, overlap) == expected


@pytest.mark.parametrize("file,text,size,expected", HEADINGS)
def test_headings(file, text, size, expected):
    assert c.with_breadcrumbs(text, file, size, 10) == expected


def test_chunk_index_is_contiguous(spark):
    rows = [("s", 0, 1, "a b c d " * 30), ("s", 1, None, None), ("s", 2, 3, "x y " * 60), ("t", 0, None, "  ")]
    out = c.with_chunk_index(c.recursive_chunks(spark.createDataFrame(rows, "source_id string, span_index bigint, page bigint, text string"), 50, 10)).collect()
    assert sorted(r["chunk_index"] for r in out) == list(range(len(out))) and {r["source_id"] for r in out} == {"s"}
    assert {r["page"] for r in out if r["span_index"] == 2} == {3}


def test_line_windows():
    lines = [f"line {i}" for i in range(10)]
    assert c.line_windows(lines, 20, 1)[0] == "line 0\nline 1\nline 2"
    assert c.line_windows(["x" * 50, "y"], 10, 2) == ["x" * 50, "y"]
    assert c.line_windows(lines, 10_000, 5) == ["\n".join(lines)]


def test_blank_line_chunks_over_the_limit(spark):
    df = spark.createDataFrame([("s", 0, "a\n\n" + "\n".join(["word"] * 20)), ("s", 1, None)], "source_id string, span_index int, text string")
    out = c.blank_line_chunks(df, limit=20, overlap=1).collect()
    assert sum(r["block"] == 0 for r in out) == 1 and all(len(r["text"]) <= 20 for r in out)
