"""The core queries that have no SQL, against plain Python over the smallest tables."""

import gzip
import hashlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from stackmill.operators.chunking import split_recursive, with_breadcrumbs
from stackmill.streaming.ratelimit import refill, runs

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: entry.queries()[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def spans(spark):
    rows = spark.read.parquet(f"{DATA}/text_spans.parquet").select("span_id", "source_id", "span_index", "kind", "text", "page").distinct().collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["source_id"], r["span_index"])):
        by[r["source_id"]].append(r)
    return by


def test_recursive_chunks(run, spans):
    want = set()
    for source, rows in spans.items():
        chunks = [(r["page"], c) for r in rows if r["kind"] != "Code" and r["text"] and r["text"].strip(" ") for c in with_breadcrumbs(r["text"], source.rsplit("/", 1)[-1], 1000, 100)]
        want |= {(source, n, page, c) for n, (page, c) in enumerate(chunks)}
    assert {tuple(r) for r in run("chk5_recursive_chunks")} == want


def test_points_of_the_pipeline(run, spans):
    got = defaultdict(list)
    for r in run("ctl1_points"):
        got[r["source_id"]].append((r["chunk_index"], r["chunk"]))
    assert got
    for source, chunks in got.items():
        texts = [c for r in spans[source] if r["text"] and r["text"].strip(" ") for c in split_recursive(r["text"], 2000, 200)]
        assert sorted(chunks) == [(n, hashlib.md5(c.encode()).hexdigest()) for n, c in enumerate(texts)]


def test_gzip_ratios(run, spans):
    texts = {r["span_id"]: r["text"] for rows in spans.values() for r in rows}
    got = {r["span_id"]: r["ratio"] for r in run("fn8_gzip_ratio")}
    assert set(got) == {i for i, t in texts.items() if t}
    for i, ratio in got.items():
        raw = texts[i].encode()
        assert ratio == pytest.approx(len(gzip.compress(raw)) / len(raw), rel=0.1, abs=0.05)


def test_bootstrap_intervals(run, spark):
    first = {r["probe_id"]: r["first_rank"] for r in run("agg5_first_rank")}
    arms = defaultdict(list)
    for probe, rank in first.items():
        arms[probe % 4].append(float(rank is not None))
    got = {r["arm"]: r for r in run("agg15_bootstrap")}
    assert set(got) == set(arms)
    for arm, values in arms.items():
        assert got[arm]["mean"] == pytest.approx(sum(values) / len(values)) and got[arm]["low"] <= got[arm]["mean"] <= got[arm]["high"]


def test_token_buckets(run, spark):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/events.parquet").selectExpr("user_id", "event_id", "unix_micros(cast(ts as timestamp)) as us").collect():
        if r["user_id"] is not None and r["us"] is not None:
            by[r["user_id"]].append((r["us"], r["event_id"]))
    want = {}
    for user, events in by.items():
        tokens, last, rejected = 2.0, None, 0
        for us, _ in sorted(events):
            tokens, ok, _ = refill(tokens, 0.0 if last is None else (us - last) / 1e6, 2.0, 1 / 86400.0)
            last, rejected = us, rejected + (not ok)
        want[user] = (len(events), rejected)
    assert {r["user_id"]: (r["requests"], r["rejected"]) for r in run("st4_token_bucket")} == want


def test_passages_of_the_whole_source(run, spark, spans):
    hits = {r["hit_id"]: r for r in spark.read.parquet(f"{DATA}/hits.parquet").collect()}
    got = {r["hit_id"]: r for r in run("exp2_deep_read_source")}
    assert set(got) == {i for i, h in hits.items() if h["text"] is not None}
    for i, r in got.items():
        if not r["found"]:
            assert r["passage"] == hashlib.md5(hits[i]["text"].encode()).hexdigest()


def test_runs_of_one_key_go_to_many_groups(spark):
    times = [0, 5, 50, 51, 52, 1000, 1001, 70000, 70049, 70099, 70150]
    df = spark.createDataFrame([("a", i, t * 1_000_000) for i, t in enumerate(times)], "k string, i bigint, us bigint")
    got = {r["i"]: r["run"] for r in runs(df, "k", "i", 50.0).collect()}
    want, run = {}, 0
    for i, t in enumerate(times):
        run += i == 0 or t - times[i - 1] >= 50
        want[i] = run
    assert got == want
