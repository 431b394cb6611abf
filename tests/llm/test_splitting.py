import re

from hypothesis import given, settings
from hypothesis import strategies as st

from stackmill.llm.splitting import KINDS, bisected, finest_of, pieces

SCHEMA = "case_id bigint, name string, text string, chunk_size bigint, chunk_overlap bigint, piece_no string"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\r.é漢", max_size=300), st.integers(1, 60), st.integers(0, 59))
def test_pieces_cover_the_text(text, size, overlap):
    text, overlap = text.strip(), min(overlap, size - 1)
    end = 0
    for n, (a, b, _) in enumerate(bisected(text, size, overlap)):
        assert 0 < b - a <= size
        assert n == 0 or end - a == min(overlap, end)
        end = b
    assert end == len(text)


def test_cuts_at_the_strongest_boundary_near_the_middle():
    text = "one two\nthree four\n\nfive six\nseven eight"
    assert [(text[a:b], k) for a, b, k in bisected(text, 30, 0)] == [("one two\nthree four\n\n", "start"), ("five six\nseven eight", "paragraph")]


def needed(text, size):
    if len(text) <= size:
        return None
    for kind, parts in (("paragraph", re.split(r"\n(?:[^\S\n]*\n)+", text)), ("line", text.split("\n")), ("word", text.split())):
        if all(len(p.strip()) <= size for p in parts):
            return kind
    return "char"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab \n\r", max_size=200), st.integers(1, 40))
def test_no_finer_cut_than_the_size_demands(text, size):
    text = text.strip()
    if kind := needed(text, size):
        assert finest_of(text, size) == kind


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="abc", min_size=1, max_size=9), min_size=1, max_size=9).map(" ".join), min_size=1, max_size=9), st.integers(10, 60), st.integers(0, 9))
def test_pieces_are_cut_no_finer_than_their_room_demands(lines, size, overlap):
    text = "\n\n".join(lines)
    cuts = [k for _, _, k in bisected(text, size, overlap)[1:]]
    if cuts:
        assert max(map(KINDS.index, cuts)) <= KINDS.index(needed(text, size - overlap))


def test_finest():
    assert finest_of("aa\n\nbb", 4) == "paragraph"
    assert finest_of("aa\r\n \r\nbb", 2) == "paragraph"
    assert finest_of("aa\nbb\n\ncc", 2) == "line"
    assert finest_of("aa bb", 2) == "word"
    assert finest_of("aaaa", 2) == "char"


def test_nulls_blanks_and_repeats(spark):
    rows = [(1, "a", None, 5, 1, "x"), (2, "b", "", 5, 1, "x"), (3, "c", "  \n", 5, 1, "x"), (4, "d", " hello ", None, None, "x"), (5, "e", "abcdef", 3, 3, "x"), (5, "e", "abcdef", 3, 3, "x"), (6, "f", "abcdef", 0, 1, "x"), (7, "g", "ab cd", 3, -1, "x"), (8, "h", "x" * 100000, 1000, 10, "x")]
    out = pieces(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in out:
        by.setdefault(r["case_id"], []).append((r["piece_no"], r["text"], r["finest"]))
    assert set(by) == {4, 5, 6, 7, 8}
    assert by[4] == [(0, "hello", None)] and by[6] == [(0, "abcdef", None)]
    assert [t for _, t, _ in sorted(by[5])] == ["abc", "def"] and by[5][0][2] == "char"
    assert "".join(t for _, t, _ in sorted(by[7])) == "ab cd"
    assert max(len(t) for _, t, _ in by[8]) <= 1000
    assert pieces(spark.createDataFrame([], SCHEMA)).count() == 0
