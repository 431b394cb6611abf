import random

from stackmill.operators.expansion import expanded


def plain(text, full, pad):
    body = text.split("\n\n", 1)[-1]
    probe = body[200:360] if len(body) > 380 else body[:160]
    i = full.find(probe)
    return text if not probe or i < 0 else full[max(0, i - pad) : i + len(probe) + pad]


def test_passages_against_brute_force(spark):
    rnd = random.Random(3)
    sources, rows = {}, []
    for s in ("a", "b", "c"):
        texts = [" ".join("".join(rnd.choices("abcdeé", k=rnd.randint(1, 6))) for _ in range(rnd.choice([0, 1, 5, 60, 200]))) for _ in range(40)]
        texts[7], texts[20] = None, "漢字" * 150 + texts[20]
        texts[30] = texts[10]
        sources[s] = "\n".join(t for t in texts if t is not None)
        rows += [(s, n, n * 7 + ord(s) * 1000, t) for n, t in enumerate(texts)]
    rnd.shuffle(rows)
    hits = []
    for n in range(120):
        s = rnd.choice("abc")
        i = rnd.randrange(len(sources[s]))
        hits.append((n, s, rnd.choice(["", "Title\n\n"]) + sources[s][i : i + rnd.choice([20, 160, 500])]))
    hits += [(200, "a", "this stands nowhere in the source at all"), (201, "z", "no such source of this text"), (202, "a", ""), (203, "a", None), (204, "a", sources["a"][-90:]), (205, None, "no source"), (206, "b", "漢字" * 80)]
    out = expanded(spark.createDataFrame(hits + hits[:5], "hit_id bigint, source_id string, text string"), spark.createDataFrame(rows + rows[:9], "source_id string, span_index bigint, span_id bigint, text string"), around=300, block=700)
    got = [(r["hit_id"], r["passage"]) for r in out.collect()]
    assert len(got) == len({k for k, _ in got})
    assert dict(got) == {k: plain(t, sources.get(s, ""), 300) for k, s, t in hits if t is not None}


def test_registered_query_reads_over_neighbouring_spans(spark, tmp_path):
    import __spark_entry__ as entry

    text = "The middle span is what the hit shows and its neighbours must come with it."
    spark.createDataFrame([(1, "s", 0, "Before."), (2, "s", 1, text), (3, "s", 2, "After.")], "span_id bigint, source_id string, span_index bigint, text string").selectExpr("*", "'Paragraph' as kind", "cast(null as bigint) as page").write.parquet(str(tmp_path / "text_spans.parquet"))
    spark.createDataFrame([(5, "s", 1, text), (6, "s", 9, "Not there.")], "hit_id bigint, source_id string, chunk_index bigint, text string").write.parquet(str(tmp_path / "hits.parquet"))
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    got = {tuple(r) for r in entry.queries()["exp2_deep_read_source"](spark, str(tmp_path)).select("hit_id", "passage", "found").collect()}
    assert got == {(5, md5(f"Before.\n{text}\nAfter."), True), (6, md5("Not there."), False)}
