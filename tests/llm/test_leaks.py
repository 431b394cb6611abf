import numpy as np

from stackmill.llm.fmindex import FMIndex
from stackmill.llm.leaks import aligned, leaked, removal_spans, words_of


def test_index_against_brute_force():
    rng = np.random.default_rng(1)
    docs = [rng.integers(1, 5, rng.integers(0, 40)).tolist() for _ in range(30)]
    docs += docs[:5] + [[2] * 30]
    words = np.array([w for d in docs for w in [*d, 0]])
    index = FMIndex(words)
    patterns = rng.integers(1, 6, (200, 3))
    lo, hi = index.ranges(patterns)
    for p, a, b in zip(patterns, lo, hi):
        true = [i for i in range(len(words) - 2) if words[i : i + 3].tolist() == p.tolist()]
        assert b - a == len(true)
        if b > a:
            assert sorted(index.locate(np.arange(a, b)).tolist()) == true


def test_alignment():
    item = list(range(1, 31))
    text = np.array([99, *item[:10], 50, *item[11:20], *item[21:], 98])
    assert aligned(item, text, 0, 1, 7)[:2] == (0, 30)
    close = np.array([*item[:10], 50, *item[11:14], 51, *item[15:]])
    assert aligned(item, close, 0, 0, 7)[:2] == (0, 14)


WORDS = "In a letter to the keeper of the old bridge the third pilot wrote that no harbour would close again before the winter had ended and the last ship was home"


def test_leaks(spark):
    w = WORDS.split()
    items = spark.createDataFrame([(1, "What did the third pilot write?", WORDS, "x"), (2, None, WORDS, "x"), (3, "", None, "x"), (1, "What did the third pilot write?", WORDS, "x")], "item_id bigint, q string, passage string, doc_id string")
    docs = [
        (1, "Before. " + WORDS.upper().replace(" ", "\n> ") + ". After."),
        (2, "x " + " ".join(w[3:18]) + " y"),
        (3, "x " + " ".join(w[3:17]) + " y"),
        (4, "x " + " ".join(w[:8] + ["CHANGED"] + w[9:17]) + " y"),
        (5, "x <b>" + "</b> <i>".join(w[5:14]) + "</i>, " + " ".join(w[15:25])),
        (6, None), (7, ""), (8, "nothing of it " * 5000),
        (9, " ".join(w[:5] + ["a"] + w[6:11] + ["b"] + w[12:17] + ["c"] + w[18:])[:120]),
        (1, "Before. " + WORDS.upper().replace(" ", "\n> ") + ". After."),
    ]
    df = spark.createDataFrame([(*d, "i") for d in docs], "doc_id bigint, text string, item_id string")
    out = leaked(df, items)
    assert {(r["doc"], r["item"]) for r in out.collect()} == {(d, i) for d in (1, 2, 4, 5) for i in (1, 2)}
    text = dict(docs)
    for r in removal_spans(out).collect():
        cut = text[r["doc"]][r["first"] : r["last"]]
        assert "x " not in cut and "Before" not in cut and "pilot" in cut.lower() or r["doc"] == 4
    assert leaked(df.limit(0), items).count() == 0 and leaked(df, items.limit(0)).count() == 0


def test_passes_give_the_same(spark, monkeypatch):
    from stackmill.llm import leaks as module

    items = spark.createDataFrame([(i, None, f"{WORDS} number {i}") for i in range(6)], "item_id bigint, q string, passage string")
    docs = spark.createDataFrame([(1, WORDS), (2, "other")], "doc_id bigint, text string")
    one = {(r["doc"], r["item"]) for r in leaked(docs, items).collect()}
    monkeypatch.setattr(module, "PASS", 300)
    assert {(r["doc"], r["item"]) for r in leaked(docs, items).collect()} == one == {(1, i) for i in range(6)}


def test_merged_spans(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 9), (1, 9, 12), (1, 20, 22), (2, 1, 2)], "doc bigint, first bigint, last bigint")
    assert sorted(map(tuple, removal_spans(df).select("doc", "first", "last").collect())) == [(1, 0, 12), (1, 20, 22), (2, 1, 2)]


def test_entities(spark):
    w = WORDS.split()
    text = {
        1: "<p>" + "&nbsp;".join(w) + "&nbsp;</p>",
        2: "x <p>" + "&nbsp;".join(w[:4]) + "&#160;" + " ".join(w[4:14]) + "&rsquo; " + " ".join(w[14:20]) + "&#xA0;<b>" + "&nbsp;".join(w[20:]) + "</b>",
        3: "&nbsp;".join(w[:14]) + "&nbsp;y",
    }
    items = spark.createDataFrame([(1, None, WORDS)], "item_id bigint, q string, passage string")
    out = leaked(spark.createDataFrame(list(text.items()), "doc_id bigint, text string"), items)
    assert {r["doc"] for r in out.collect()} == {1, 2}
    for r in removal_spans(out).collect():
        cut = text[r["doc"]][r["first"] : r["last"]]
        assert cut.startswith("In&nbsp;a") and cut.endswith("home") and [x for x, _, _ in words_of(cut)] == [x.lower() for x in w]


def test_entities_keep_places():
    text = "caf&eacute; r&amp;d AT&T &amp;nbsp; &amplitude; &#x41;&#66;c &NotEqualTilde;z &#" + "9" * 5000 + ";"
    found = words_of(text)
    assert [x for x, _, _ in found[:10]] == ["café", "r", "d", "at", "t", "nbsp", "amplitude", "abc", "z", "9" * 5000]
    assert [text[a:b] for _, a, b in found[:10]] == ["caf&eacute;", "r", "d", "AT", "T", "nbsp", "amplitude", "&#x41;&#66;c", "z", "9" * 5000]
