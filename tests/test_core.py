import io
import uuid
import zipfile

import numpy as np
from pyspark.sql import functions as F

from stackmill.functions import identity as ids
from stackmill.functions import text as t
from stackmill.functions.cleaning import clean_markdown
from stackmill.operators import evaluation as ev
from stackmill.operators import ingest, state, tables
from stackmill.operators.embedding import Recoverable, embedded, scored
from stackmill.operators.search import cosine, search, search_many
from stackmill.sources import config, files
from stackmill.streaming import flows
from stackmill.streaming.ratelimit import admitted, admitted_stream, refill


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_point_id_is_a_name_based_uuid(spark):
    df = spark.createDataFrame([("doc-a", 0), ("dé", 12)], "s string, i bigint")
    got = [r[0] for r in df.select(ids.point_id(F.col("s"), F.col("i"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(ids.POINT_NAMESPACE), n)) for n in ("doc-a#0", "dé#12")]


def test_cache_keys(spark):
    key = lambda h, st: one(spark, h, lambda x: ids.cache_key(x, st))
    assert len(key("h", ids.TEXT)) == 64 and key("h", ids.TEXT) != key("h", ids.CODE) and key(None, ids.TEXT) is None


def test_canonical_source_id(spark):
    assert one(spark, "/data/corpus/a/b.md", lambda x: ids.canonical_source_id(x, "/data/corpus")) == "a/b.md"
    assert one(spark, "/data/corpusX/b.md", lambda x: ids.canonical_source_id(x, "/data/corpus")) is None


def test_sections_match_whole_words(spark):
    reason = lambda n: one(spark, n, lambda x: t.section_reason(x, ["index", "cover", "glossary"], ["glossary"]))
    assert reason("Index-of-Terms") == "low-value section: index" and reason("Data-Recovery") is None and reason("Glossary") is None and reason("Chapter-04") is None


def test_letterspace_runs(spark):
    runs = lambda s: one(spark, s, t.letterspace_runs)
    assert [runs("a b c"), runs("a b c d"), runs("x a b c d e y"), runs("word a b c d word"), runs("")] == [0, 1, 1, 1, 0]


def test_cleaner(spark):
    clean = lambda s: one(spark, s, clean_markdown)
    assert clean('<span class="kbd c1">ls -l</span>') == "`ls -l`"
    assert clean("<span>a <span>b</span></span>") == "a b"
    assert clean('a\n<div class="x">\n\n\n\nb') == "a\n\nb"
    assert clean("x<figure><img src='a'/></figure>y") == "xy" and clean('<a href="u">t</a>') == "t" and clean("``` mce-root\nc\n```") == "```\nc\n```" and clean(None) is None


def test_confidence_labels(spark):
    rows = [(1, 1, 0.5, "x" * 100), (1, 2, 0.4, "x" * 100), (1, 3, 0.3, "x" * 100), (2, 1, 0.18, "x" * 100), (2, 2, 0.17, None), (3, 1, 0.6, "# short"), (4, 1, 0.9, "x" * 100)]
    got = {r["probe_id"]: r for r in ev.confidence(spark.createDataFrame(rows, "probe_id int, rn int, score double, text string")).collect()}
    assert {k: r["label"] for k, r in got.items()} == {1: "strong", 2: "likely_no_answer", 3: "weak", 4: "weak"}
    assert abs(got[1]["score_spread"] - 0.0816496580927726) < 1e-12 and got[4]["margin"] == 0.0


def test_regression_gate(spark):
    schema = "hit_rate double, mrr double, fragment_rate double"
    gate = lambda h, c: ev.regression(spark.createDataFrame(h, schema), spark.createDataFrame(c, schema)).first()["regressed"]
    assert gate([(1.0, 1.0, 0.0)], [(0.0, 0.0, 1.0)]) is None
    assert gate([(1.0, 1.0, 0.0)] * 2, [(0.995, 1.0, 0.0)]) is None
    assert gate([(1.0, 1.0, 0.0)] * 2, [(0.98, 0.5, 0.0)]) == "hit_rate" and gate([(1.0, 1.0, 0.0)] * 2, [(1.0, 1.0, 0.5)]) == "fragment_rate"


def test_health_of_nothing(spark):
    empty = spark.createDataFrame([], "probe_id int, first_rank int, frag double, top double")
    assert tuple(ev.health(empty).first()) == (0, 0.0, 0.0, 0.0, 0.0)


def test_nearest_rank(spark):
    rng = np.random.default_rng(3)
    values = rng.random(501).round(4)
    df = spark.createDataFrame([("g", float(v)) for v in values] + [(None, 0.5), ("g", None)], "g string, v double")
    got = {r["g"]: (r["p5"], r["p50"]) for r in ev.nearest_rank(df, "g", "v", [5, 50]).collect()}
    s = sorted(values)
    assert got["g"] == (s[round(0.05 * 500)], s[250]) and got[None] == (0.5, 0.5)


def test_bootstrap_interval(spark):
    df = spark.createDataFrame([(i, "a", float(i % 2)) for i in range(200)], "row int, arm string, v double")
    r = ev.bootstrap_interval(df, ["arm"], "v", "row").first()
    assert r["mean"] == 0.5 and 0.40 < r["low"] < 0.46 and 0.54 < r["high"] < 0.60


def test_state(spark):
    schema = "point_id string, source_id string, v int"
    old = spark.createDataFrame([("a", "s", 1), ("b", "s", 1), ("c", "t", 1)], schema)
    new = spark.createDataFrame([("a", "s", 2), ("d", "u", 2)], schema)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(state.upserted(old, new)) == [("a", "s", 2), ("b", "s", 1), ("c", "t", 1), ("d", "u", 2)]
    assert rows(state.replaced(old, new)) == [("a", "s", 2), ("c", "t", 1), ("d", "u", 2)]
    assert rows(state.upserted(old, new.limit(0))) == rows(old) and rows(state.deleted(old, new)) == [("c", "t", 1)]
    slots = spark.range(1).select(state.named_slots(text=F.array(F.lit(1.0)), code=F.array().cast("array<double>"), figure=F.lit(None).cast("array<double>")).alias("m")).first()["m"]
    assert slots == {"text": [1.0]}


def test_search(spark):
    df = spark.createDataFrame([("a", 0, "book", [1.0, 0.0, 0.0]), ("b", 0, "paper", [0.0, 1.0, 0.0]), ("c", 0, "paper", None), ("d", 0, "book", [1.0])], "source_id string, chunk_index int, content_type string, vector array<float>")
    assert [r["source_id"] for r in search(df, [0.9, 0.1, 0.0], 5).collect()] == ["a", "b"]
    assert [r["source_id"] for r in search(df, [0.9, 0.1, 0.0], 5, "paper").collect()] == ["b"] and search(df, [1.0, 0.0, 0.0], 5, "none").count() == 0
    assert spark.range(1).select(cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()[0] == 0.0


def test_search_many_with_ties(spark, monkeypatch):
    from stackmill.operators import search as module

    monkeypatch.setattr(module, "QUERIES_A_PASS", 3)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 4)).round(1)
    x[10:20] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0])], "id bigint, v array<double>").repartition(5)
    got = {(r["query"], r["rank"]): r["key"] for r in search_many(df, df.where("id % 10 = 0"), 4, "id", "v").collect()}
    for q in range(0, 60, 10):
        s = [(-round(float(x[q] @ x[j] / np.linalg.norm(x[q]) / np.linalg.norm(x[j])), 9), j) for j in range(60) if j != q]
        assert [got[q, r] for r in range(1, 5)] == [j for _, j in sorted(s)[:4]] or q == 0


def test_files(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "a" / ".git").mkdir(parents=True)
    (root / "a" / "x.py").write_text("print(1)\n")
    (root / "a" / ".git" / "y.py").write_text("no")
    (root / "a" / "p.html").write_text("<html><head><title>t</title></head><body><h1>Head</h1><p>One &amp; <code>two</code></p><script>bad()</script><ul><li>i</li></ul></body></html>")
    (root / "a" / "e.html").write_text(" ")
    (root / "a" / "bad.txt").write_bytes(b"\xff\xfe\x00x")
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("META-INF/container.xml", '<c xmlns="urn:x"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>')
        z.writestr("o/p.opf", '<package xmlns="urn:y"><manifest><item id="2" href="b.xhtml"/><item id="1" href="a.xhtml"/></manifest><spine><itemref idref="1"/><itemref idref="2"/></spine></package>')
        z.writestr("o/a.xhtml", "<h1>First</h1>")
        z.writestr("o/b.xhtml", "<p>Second</p>")
    (root / "a" / "b.epub").write_bytes(book.getvalue())
    (root / "a" / "b.mobi").write_bytes(b"x")
    code = files.corpus_files(spark, str(root), str(root), "code")
    assert {r["source_id"] for r in code.collect()} == {"a/x.py", "a/bad.txt"}
    spans = {r["source_id"]: r for r in files.text_spans(code, "Code").collect()}
    assert spans["a/x.py"]["text"] == "print(1)\n" and spans["a/bad.txt"]["error"] == "not UTF-8" and spans["a/bad.txt"]["text"] is None
    pages = {r["source_id"]: r for r in files.html_spans(files.corpus_files(spark, str(root), str(root), "html")).collect()}
    assert pages["a/p.html"]["text"] == "# Head\n\nOne & `two`\n\n- i" and pages["a/e.html"]["error"] == "empty"
    books = {r["source_id"]: r for r in files.ebook_spans(files.corpus_files(spark, str(root), str(root), "ebook")).collect()}
    assert books["a/b.epub"]["text"] == "# First\n\nSecond" and "no converter" in books["a/b.mobi"]["error"]
    outside = files.corpus_files(spark, str(root), str(tmp_path / "other"), "code").first()
    assert outside["source_id"] is None and outside["error"]
    pdf = files.pdf_spans(files.corpus_files(spark, str(root / "a" / "x.py"), str(root)), "cat")
    assert pdf.first()["text"] == "print(1)\n"
    failed = files.pdf_spans(files.corpus_files(spark, str(root / "a" / "x.py"), str(root)), "sh -c 'echo broken >&2; exit 1'")
    assert "broken" in failed.first()["error"]


def test_logs_and_config(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"ts": 1, "k": 5, "other": 1}\n\nbroken\n{"ts": 2}\n')
    assert sorted((r["ts"], r["k"]) for r in files.json_log(spark, str(tmp_path / "log.json"), "ts bigint, k bigint").collect()) == [(1, 5), (2, None)]
    (tmp_path / "c.toml").write_text('collection = "x"\nchunk_size = 500\n[sections]\nexclude = ["index"]\n')
    c = config.load(str(tmp_path / "c.toml"))
    assert (c.collection, c.chunk_size, c.exclude, c.chunker) == ("x", 500, ("index",), "recursive") and config.setting(None, "e", "f", "d") == "e"


def test_embedders(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id int, text string").coalesce(1)

    def broken(part):
        raise Recoverable("busy")

    def final(part):
        raise ValueError("no")

    def short(part):
        return []

    def good(part):
        return [[float(len(x))] for x in part]

    assert [r["vector"] for r in embedded(df, good, batch=2).collect()] == [[2.0]] * 5
    assert {r["error"] for r in embedded(df, broken, batch=2).collect()} == {"recoverable: busy"}
    assert [r["vector"] for r in embedded(df, broken, batch=2, fallback=good).collect()] == [[2.0]] * 5
    assert {r["error"] for r in embedded(df, final, fallback=good).collect()} == {"terminal: no"} and "0 vectors" in embedded(df, short).first()["error"]
    assert scored(df.withColumn("q", F.lit("?")), lambda q, x: "1" if x == "t1" else 1 / 0).where("answer = '1'").count() == 1


def test_ingest_invariants(spark):
    rows = [("a/Chapter-01.md", 0, "word " * 100, 1), ("a/Chapter-01.md", 1, "more " * 100, 2), ("a/Index.md", 0, "x", 1), ("a/bad.md", 0, None, 1), ("a/garbled.md", 0, "\N{REPLACEMENT CHARACTER}" * 5, 1)]
    df = spark.createDataFrame(rows, "source_id string, span_index bigint, text string, page bigint")
    c = config.PipelineConfig(chunk_size=100, chunk_overlap=10, exclude=("index",))
    points, log = ingest.staged(df, c)
    status = {(r["source_id"], r["stage"]): r["status"] for r in log.collect()}
    assert status["a/Index.md", "section"] == "skipped" and status["a/bad.md", "extract"] == "failed" and status["a/garbled.md", "quality"] == "flagged" and status["a/Chapter-01.md", "index"] == "success"
    got = points.where("source_id = 'a/Chapter-01.md'").collect()
    assert sorted(r["chunk_index"] for r in got) == list(range(len(got))) and {r["source_id"] for r in points.collect()} == {"a/Chapter-01.md", "a/garbled.md"}
    again, _ = ingest.staged(df, c, points)
    assert again.count() == 0
    left, gone = ingest.removed(points, df.where("source_id = 'a/Chapter-01.md'"))
    assert {r["source_id"] for r in left.collect()} == {"a/garbled.md"} and gone.count() == 4


def test_tables(spark, tmp_path):
    points, store = str(tmp_path / "points"), str(tmp_path / "store")
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "point_id string, collection string")
    tables.write_collections(df, points)
    first = tables.snapshot(spark, points, store, "x", "one", 1)
    tables.snapshot(spark, points, store, "x", "two", 2)
    tables.write_collections(spark.createDataFrame([("c", "x")], "point_id string, collection string"), points)
    assert {r["point_id"] for r in spark.read.parquet(points).collect()} == {"b", "c"}
    tables.restore(spark, store, first, points)
    assert {r["point_id"] for r in spark.read.parquet(points).collect()} == {"a", "b"}
    assert [r["snapshot_id"] for r in tables.prunable(spark, store, 1).collect()] == [first] and tables.prunable(spark, store, 0).count() == 0
    outs = str(tmp_path / "outs")
    tables.put_outputs(spark.createDataFrame([("abc", "t")], "cache_key string, text string"), outs, "extract")
    assert tables.missing(spark.createDataFrame([("abc",), ("def",)], "cache_key string"), spark.read.parquet(outs)).first()[0] == "def"
    log = str(tmp_path / "log")
    tables.append_json(spark.createDataFrame([(1, "secret")], "ts int, query string"), log, ("query",))
    assert spark.read.json(log).columns == ["ts"]


def test_token_bucket(spark):
    rng = np.random.default_rng(5)
    rows = [(int(u), i, int(s)) for i, (u, s) in enumerate(zip(rng.integers(0, 5, 300), np.sort(rng.integers(0, 10**6, 300))))]
    df = spark.createDataFrame(rows, "user int, event int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event"]: r["admitted"] for r in admitted(df, "user", "ts", "event", 2.0, 1 / 20000).collect()}
    held = {}
    for u, i, s in rows:
        tokens, last = held.get(u, (2.0, s))
        tokens, ok, wait = refill(tokens, s - last, 2.0, 1 / 20000)
        assert ok or wait > 0
        held[u] = (tokens, s)
        assert got[i] == ok
    assert 0 < sum(got.values()) < 300


def test_streams(spark, tmp_path):
    src = str(tmp_path / "events")
    df = spark.createDataFrame([(i, i * 60, i % 3, "error" if i % 5 == 0 else "view", 1.0, "{}") for i in range(120)], "event_id bigint, s bigint, user_id bigint, event_type string, value double, props string")
    df.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(src)
    log = flows.read_log(spark, src)
    q = flows.log_rollup(log).writeStream.outputMode("complete").format("memory").queryName("rollup").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from rollup").first()[0] == 120 and spark.sql("select sum(failed) from rollup").first()[0] == 24
    q = admitted_stream(flows.read_log(spark, src), "user_id", "ts", 2.0, 1 / 600).writeStream.outputMode("append").format("memory").queryName("bucket").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = admitted(spark.read.parquet(src), "user_id", "ts", "event_id", 2.0, 1 / 600)
    assert spark.sql("select count_if(admitted) from bucket").first()[0] == batch.where("admitted").count()
    spans = str(tmp_path / "spans")
    schema = "source_id string, span_index bigint, text string, page bigint"
    spark.createDataFrame([("a.md", 0, "word " * 50, 1)], schema).write.mode("append").parquet(spans)
    c = config.PipelineConfig(chunk_size=100, chunk_overlap=10)
    run = lambda: flows.ingest_stream(spark.readStream.schema(schema).parquet(spans), str(tmp_path / "pts"), str(tmp_path / "out"), c, str(tmp_path / "cp")).awaitTermination(120)
    run()
    n = spark.read.parquet(str(tmp_path / "pts")).count()
    spark.createDataFrame([("a.md", 0, "word " * 50, 1), ("b.md", 0, "other " * 50, 1)], schema).write.mode("append").parquet(spans)
    run()
    got = spark.read.parquet(str(tmp_path / "pts"))
    assert got.where("source_id = 'a.md'").count() == n and got.where("source_id = 'b.md'").count() > 0
    m = "source_id string, stage string, status string, attempts bigint, error string, output_ref string, updated_at bigint"
    spark.createDataFrame([("a", "x", "failed", 1, None, None, 1)], m).write.mode("append").parquet(str(tmp_path / "m"))
    flow = lambda: flows.manifest_stream(spark.readStream.schema(m).parquet(str(tmp_path / "m")), str(tmp_path / "view"), str(tmp_path / "mc")).awaitTermination(120)
    flow()
    spark.createDataFrame([("a", "x", "success", 2, None, "r", 2)], m).write.mode("append").parquet(str(tmp_path / "m"))
    flow()
    assert [r["status"] for r in spark.read.parquet(str(tmp_path / "view/1")).collect()] == ["success"]
