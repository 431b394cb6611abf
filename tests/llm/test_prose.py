from pyspark.sql import functions as F

from stackmill.llm.prose import with_quality

PROSE = "The method is early, and the choice follows from it. Nobody had thought of the rule before the second edition."


def quality(spark, *texts):
    df = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "id int, text string, words string")
    return [r for r in with_quality(df).orderBy("id").collect()]


def test_prose_and_the_rest(spark):
    got = quality(spark, PROSE, "- red box\n- blue box\n- green box\n- box", "name,size\nbox,3\nlid,5\ncup,9", "wicket " * 60, "Click here to continue.\n" * 9, "tbln wtlvzpf sczxr lvxlq. rcd xmfgfg vtx.",
                  "Das Gewebe und die Zelle gehören eng zusammen, sagt Ulm.", "Здесь язык важнее, чем пример. Каждый метод меняет ответ.", "Ïîñëå ýòîãî ÿçûê ïîëó÷èë äðóãîå èìÿ, íî èñòî÷íèê íå èçìåíèëñÿ.",
                  "4.1 The method is early, and the choice\nfollows from it. Nobody had thought of\nthe rule before", "\\frac{ $$ $$ \\\\ $$ _{i ^{ & \\sum \\hline & \\alpha", PROSE + "\n\n" + "\n".join(f"{i};{i * 7}" for i in range(60)))
    assert [r["not_prose"] for r in got] == [False, True, True, True, True, True, False, False, False, False, True, True]
    assert "not_prose" in got[1]["reasons"] and got[0]["reasons"] == []


def test_nulls_blanks_long_and_empty(spark):
    got = quality(spark, None, "", " \n\t\n", PROSE * 2000)
    assert [r["not_prose"] for r in got] == [False] * 4 and [r["reasons"][:1] for r in got[:3]] == [["empty"]] * 3
    assert got[3]["words"] == 20 * 2000 and got[0]["mean_word_length"] is None
    assert with_quality(spark.createDataFrame([], "id int, text string")).count() == 0


def test_wrongly_decoded_prose_is_prose(spark):
    shown = "Каждый закон меняет закон, а метод нет.".encode().decode("latin-1")
    assert [r["not_prose"] for r in quality(spark, shown, "wicket " * 9 + "\n" + shown)] == [False, False]


def test_reasons_of_lines(spark):
    got = quality(spark, "Click here to continue.\n" * 9, "a;1\nb;2\nc;3")
    assert "repeated_lines" in got[0]["reasons"] and "marked_lines" in got[1]["reasons"] and all("not_prose" in r["reasons"] for r in got)


def test_excluded_rows(spark):
    df = spark.createDataFrame([("a = b;\nc = d;", "code"), ("a = b;\nc = d;", None)], "text string, kind string")
    assert {(r["kind"], r["not_prose"]) for r in with_quality(df, excluded=F.col("kind") == "code").collect()} == {("code", False), (None, True)}


def test_statistics(spark):
    r = quality(spark, "One two three.\n- four five")[0]
    assert (r["words"], r["line_end_share"], r["bullet_share"], r["alphabetic_share"]) == (5, 0.5, 0.5, 5 / 6)
