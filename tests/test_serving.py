import pytest
from pyspark.sql import functions as F

from stackmill.functions.answers import quotations, verbatim
from stackmill.functions import garble
from stackmill.operators import chunk_functions, embedding, gates, ingest, strategies, tables
from stackmill.operators.chunking import split_recursive
from stackmill.operators.evaluation import confidence
from stackmill.operators.search import NotFound, search_many, search_points
from stackmill.operators.state import parsed_status, wrong_slots
from stackmill.sources.config import PipelineConfig


@pytest.fixture(scope="module")
def points(spark):
    rows = [("a", "one", "s1", 0, "book", [1.0, 0.0]), ("b", "one", "s1", 1, "code", [0.6, 0.8]), ("c", "one", "s2", 0, "book", [0.0, 0.0]), ("d", "two", "s3", 0, "book", [1.0, 0.0]), ("e", "one", "s4", 0, "book", None)]
    return spark.createDataFrame(rows, "point_id string, collection string, source_id string, chunk_index bigint, content_type string, vector array<float>")


def ids(df):
    return [r["point_id"] for r in df.collect()]


def test_search_of_a_collection(points):
    assert ids(search_points(points, "one", [1.0, 0.0], 9)) == ["a", "b", "c"]
    assert ids(search_points(points, "one", [1.0, 0.0], 9, content_type="code")) == ["b"] and ids(search_points(points, "one", [1.0, 0.0], 9, source_id="s2")) == ["c"]
    assert ids(search_points(points, "one", [1.0, 0.0], 9, content_type="paper")) == []
    with pytest.raises(NotFound):
        search_points(points, "three", [1.0, 0.0], 9)
    with pytest.raises(ValueError):
        search_points(points, "one", [1.0, 0.0, 0.0], 9)


def test_search_of_a_slot(points):
    slots = points.withColumn("vectors", F.map_from_arrays(F.array(F.when(F.col("content_type") == "code", "code").otherwise("text")), F.array("vector")))
    assert ids(search_points(slots, "one", [1.0, 0.0], 9, slot="code", vector="vectors")) == ["b"]
    assert ids(search_points(slots, "one", [1.0, 0.0], 9, slot="other", vector="vectors")) == []


@pytest.mark.parametrize("block", [4096, 2])
def test_batch_search_keeps_keys_in_any_number_of_blocks(spark, points, monkeypatch, block):
    monkeypatch.setattr("stackmill.operators.search.QUERIES_A_PASS", block)
    got = {(r["query"], r["key"], r["rank"]) for r in search_many(points.unionByName(points), points, 2, "point_id", "vector").collect()}
    assert got == {("a", "d", 1), ("a", "b", 2), ("b", "a", 1), ("b", "d", 2), ("c", "a", 1), ("c", "b", 2), ("d", "a", 1), ("d", "b", 2)}
    assert search_many(points, points.limit(0), 2, "point_id", "vector").count() == 0


def test_fallback_modes_and_dimensions(spark):
    texts = spark.createDataFrame([("x",), ("y",)], "text string")

    def busy(part, mode=None):
        raise embedding.Recoverable("busy")

    def asked(part, mode):
        return [[1.0 if mode == "query" else 2.0]] * len(part)

    def broken(part, mode=None):
        raise ValueError("no")

    one = lambda **kw: embedding.embedded(texts, **kw).first()
    r = one(client=busy, fallback=asked, mode="query")
    assert r["vector"] == [1.0] and r["recovered"] and "busy" in r["primary_error"] and r["error"] is None
    assert one(client=asked, mode="document")["vector"] == [2.0] and not one(client=asked, mode="document")["recovered"]
    r = one(client=busy, fallback=broken)
    assert r["vector"] is None and not r["recovered"] and "busy" in r["error"] and "no" in r["error"]
    r = one(client=broken, fallback=asked, mode="query")
    assert r["vector"] is None and r["error"].startswith("terminal") and r["primary_error"] is None
    assert "dimension" in one(client=asked, mode="query", dim=3)["error"]
    with pytest.raises(ValueError):
        embedding.embedded(texts, asked, mode="other")


def test_chunkers_by_configuration(spark):
    text = "\n\n".join(f"block {i}" for i in range(200))
    spans = spark.createDataFrame([("s", 0, text, 3), ("s", 1, "last", None), ("t", 0, None, None)], "source_id string, span_index bigint, text string, page bigint")
    made = {c: ingest.chunked(spans, PipelineConfig(chunker=c)).orderBy("chunk_index").collect() for c in ("recursive", "blankline")}
    assert len(made["blankline"]) == 201 and [r["chunk_index"] for r in made["blankline"]] == list(range(201)) and made["blankline"][7]["text"] == "block 7" and made["blankline"][7]["page"] == 3
    assert len(made["recursive"]) < 10
    code = ingest.chunked(spans, PipelineConfig(content_type="code")).orderBy("chunk_index").collect()
    assert len(code) == 17 and code[-1]["text"] == "last"
    with pytest.raises(ValueError):
        ingest.chunked(spans, PipelineConfig(chunker="other"))


def test_payloads(spark):
    df = spark.createDataFrame([("shelf/a.b.md", 4), ("shelf/c", None)], "path string, page bigint")
    said = lambda kind: [r[0] for r in df.select(ingest.payload(kind, F.col("path"), F.col("page"))).collect()]
    assert said("book") == ['{"Book":{"title":"a.b","page":4}}', '{"Book":{"title":"c"}}']
    assert said("paper")[0] == '{"Paper":{"title":"a.b","page_start":4,"page_end":4}}' and said("code")[0] == '{"Code":{"file_path":"shelf/a.b.md"}}'


def test_a_query_without_hits_has_no_answer(spark):
    hits = spark.createDataFrame([(1, 0.9, 1, "x" * 100)], "probe_id int, score double, rn int, text string")
    got = {r["probe_id"]: r for r in confidence(hits, queries=spark.createDataFrame([(1,), (2,)], "probe_id int")).collect()}
    assert got[1]["label"] == "weak" and (got[2]["label"], got[2]["value"], got[2]["fragment_rate"]) == ("likely_no_answer", 0.0, 0.0)


def test_quotations(spark):
    long = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(f'He said "{long}" [2], and [3] "{long} more".',), ("none",)], "t string")
    assert [[(q["quote"], q["n"]) for q in r[0]] for r in df.select(quotations(F.col("t"))).collect()] == [[(long, "2"), (long + " more", "3")], []]
    assert df.select(verbatim(F.lit(long), F.lit("x One two, three four five six seven eight y"))).first()[0]


def test_rewritten_queries(spark):
    queries = spark.createDataFrame([(1, "a b"), (2, "fail"), (3, None)], "probe_id bigint, q string")

    def halves(q):
        if q == "fail":
            raise RuntimeError("down")
        return "- a\n\n2. b\nc\nd"

    got = [(r["probe_id"], r["sub"], r["query"]) for r in strategies.rewritten(queries, halves, "probe_id").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "fail")]


def health(spark, *rows):
    return spark.createDataFrame([(float(h), float(m), float(f)) for h, m, f in rows], "hit_rate double, mrr double, fragment_rate double")


def test_gates(spark, points):
    batch = spark.createDataFrame([("n1", "one", "s1", 0, "book", [1.0, 0.0]), ("n2", "one", "s9", 0, "book", [1.0, 0.0])], points.schema)
    quality = spark.createDataFrame([("s9", 3.0)], "source_id string, value double")
    good, bad = health(spark, (0.9, 0.9, 0.1), (0.9, 0.9, 0.1)), health(spark, (0.1, 0.1, 0.1))

    def run(history, after, **kw):
        left, told = gates.added(points, batch, quality, history, after, 1.0, **kw)
        return set(ids(left)), {r["source_id"]: r["action"] for r in told.collect()}

    old = set(ids(points))
    assert run(good, good.limit(1)) == ((old - {"a", "b"}) | {"n1"}, {"s1": "committed", "s9": "refused"})
    assert run(good, bad) == (old, {"s1": "rolled_back", "s9": "refused"})
    assert run(good, bad, force=True) == ((old - {"a", "b"}) | {"n1", "n2"}, {"s1": "forced", "s9": "forced"})
    assert run(good.limit(1), bad)[1]["s1"] == "committed" and run(good, bad.limit(0))[1]["s1"] == "committed"


def test_statuses(spark):
    df = spark.createDataFrame([("RecoveredViaFallback",), ("success",), ("odd",), (None,)], "s string")
    assert [r[0] for r in df.select(parsed_status(F.col("s"))).collect()] == ["recovered_via_fallback", "success", None, None]


def test_chunkers_as_table_functions(spark):
    chunk_functions.register(spark)
    spark.createDataFrame([(1, "aa bb cc"), (2, None), (3, "l1\nl2\nl3")], "id int, text string").createOrReplaceTempView("texts_to_cut")
    got = [tuple(r) for r in spark.sql("select id, piece, chunk from texts_to_cut, lateral recursive_chunks(text, 4, 0) order by id, piece").collect()]
    assert [r for r in got if r[0] == 1] == [(1, n, c) for n, c in enumerate(split_recursive("aa bb cc", 4, 0))] and not [r for r in got if r[0] == 2]
    assert [r[0] for r in spark.sql("select chunk from texts_to_cut, lateral line_windows(text, 5, 1) where id = 3 order by piece").collect()] == ["l1\nl2", "l2\nl3"]


def test_letters_apart_and_joined(spark):
    df = spark.createDataFrame([("a b c d and a b c d e, x y",), ("plain words here",), (None,)], "t string")
    assert [r[0] for r in df.select(garble.letters_joined(F.col("t"))).collect()] == ["abcd and abcde, x y", "plain words here", None]
    spaced = df.select(garble.letterspaced(F.col("t"), 1.0).alias("s"), garble.with_marks(F.col("t"), 1.0).alias("m")).collect()
    assert spaced[1]["s"] == "p l a i n w o r d s h e r e" and spaced[1]["m"].count("\N{REPLACEMENT CHARACTER}") == 3


def test_slots_of_another_length(spark):
    df = spark.createDataFrame([({"text": [1.0, 2.0], "code": [1.0]},), ({},)], "s map<string,array<float>>")
    assert [r[0] for r in df.select(wrong_slots(F.col("s"), {"text": 2, "code": 2})).collect()] == [["code"], []]


def test_the_whole_pipeline(spark, tmp_path):
    spans = spark.createDataFrame([("s", 0, "some text", None), ("t", 0, None, None)], "source_id string, span_index bigint, text string, page bigint")
    tables.run(spans, PipelineConfig(collection="c"), str(tmp_path / "points"), str(tmp_path / "outcomes"))
    assert spark.read.parquet(str(tmp_path / "points")).count() == 1 and spark.read.json(str(tmp_path / "outcomes")).where("status = 'failed'").count() == 1
