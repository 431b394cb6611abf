"""Queries on points, hits, the manifest and the event log: search, state, measures, windows and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackmill.functions import identity as ids
from stackmill.functions import text as t
from stackmill.operators import evaluation as ev
from stackmill.operators import state
from stackmill.operators.search import cosine, search_many
from stackmill.session import table

POINT = ["point_id", "collection", "source_id", "chunk_index", "content_type"]


def points(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "points").select(*POINT, *more).distinct()


def hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hits").distinct()


def manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest").distinct()


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Hits in their order, with whether they are relevant to the evaluation item that their probe stands for."""
    items = table(spark, d, "eval_items").select("item_id", "relevant").distinct()
    rows = hits(spark, d).withColumn("item_id", 1001 + F.col("probe_id") % 200).join(items, "item_id", "left")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("probe_id").orderBy("rank_no", "hit_id"))).withColumn("relevant_hit", F.coalesce(ev.contains_any(F.col("source_id"), F.col("relevant")), F.lit(False)))


def flt1_content_type(spark, d):
    return points(spark, d).where("content_type = 'paper'").select("point_id")


def flt3_chunk_range(spark, d):
    return points(spark, d).where("chunk_index >= 2 and chunk_index < 5").select("point_id", "source_id", "chunk_index")


def flt5_empty_queries(spark, d):
    return hits(spark, d).select("hit_id", F.when(F.coalesce("q", F.lit("")).rlike(r"\A(?U)\s*\z"), "EmptyQuery").alias("error"))


def flt7_relevant_hits(spark, d):
    return judged(spark, d).select("hit_id", "relevant_hit")


def flt8_answer_bearing(spark, d):
    items = table(spark, d, "eval_items").select("item_id", "relevant", "keywords").distinct()
    rows = hits(spark, d).withColumn("item_id", 1001 + F.col("probe_id") % 200).join(items, "item_id")
    full = ev.contains_any(F.col("source_id"), F.col("relevant")) & (F.length("text") >= 200) & F.forall("keywords", lambda k: F.contains(F.lower("text"), F.lower(k)))
    return rows.select("hit_id", F.coalesce(full, F.lit(False)).alias("answers"))


def flt9_fragments(spark, d):
    return hits(spark, d).where("text is not null").select("hit_id", t.is_fragment(F.col("text")).alias("fragment"))


def flt11_already_there(spark, d):
    there = points(spark, d).groupBy("source_id").agg(F.count("*").alias("points"))
    return table(spark, d, "sources").select("source_id").distinct().join(there, "source_id", "left").select("source_id", F.coalesce("points", F.lit(0)).alias("points"))


def top1_norms(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("cos"))


def top3_batch_search(spark, d):
    e = table(spark, d, "embeddings")
    found = search_many(e, e.where("vec_id % 100 = 0"), 10, "vec_id", "embedding")
    return found.select("query", F.col("key").alias("neighbour"), F.round("score", 6).alias("score"), "rank")


def top3_label_agreement(spark, d):
    e = table(spark, d, "embeddings")
    labels = e.select("vec_id", "label")
    found = search_many(e, e.where("vec_id % 100 = 0"), 5, "vec_id", "embedding")
    both = found.join(labels.withColumnRenamed("vec_id", "query").withColumnRenamed("label", "wanted"), "query").join(labels.withColumnRenamed("vec_id", "key"), "key")
    return both.groupBy("wanted").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("wanted")).cast("double")), 6).alias("agreement"))


def top6_extract(spark, d):
    w = Window.partitionBy("source_id").orderBy("chunk_index")
    return points(spark, d, "text").where("chunk_index >= 0 and chunk_index < 20").select("source_id", "chunk_index", F.row_number().over(w).cast("bigint").alias("place"), F.md5("text").alias("text"))


def agg1_documents(spark, d):
    return table(spark, d, "points").select("source_id").distinct()


def agg2_collections(spark, d):
    return points(spark, d).groupBy("collection").agg(F.count("*").alias("points"), F.countDistinct("source_id").alias("sources"))


def agg3_counts_by_source(spark, d):
    return points(spark, d).groupBy("source_id").agg(F.count("*").alias("points"))


def agg4_confidence(spark, d):
    out = ev.confidence(judged(spark, d))
    return out.select("probe_id", *[F.round(c, 6).alias(c) for c in ("top_score", "margin", "score_spread", "fragment_rate", "value")], "label")


def agg5_first_rank(spark, d):
    return ev.first_relevant(judged(spark, d)).select("probe_id", F.col("first_rank").cast("bigint").alias("first_rank"), F.round("frag", 6).alias("frag"), F.round("top", 6).alias("top"))


def agg6_health(spark, d):
    out = ev.health(ev.first_relevant(judged(spark, d)))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("hit_rate", "mrr", "fragment_rate", "mean_top_score")])


def agg8_judge_report(spark, d):
    x = hits(spark, d).select("content_type", "rank_no", t.parsed_score(F.coalesce("text", F.lit(""))).alias("score"))
    return x.groupBy("content_type").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.count_if(F.col("score") == 2).alias("direct"), F.round(F.avg(F.when(F.col("rank_no") <= 3, F.col("score"))), 6).alias("mean3"))


def agg11_regression(spark, d):
    first = ev.first_relevant(judged(spark, d)).withColumn("run", F.col("probe_id") % 10)
    runs = ev.health(first, ["run"])
    return ev.regression(runs.where("run < 9"), runs.where("run = 9")).select("run", "runs", F.round("mrr", 6).alias("mrr"), F.round("mrr_mean", 6).alias("mrr_mean"), F.round("mrr_dev", 6).alias("mrr_dev"), "regressed")


def agg12_status_counts(spark, d):
    return state.manifest_view(manifest(spark, d)).groupBy("stage", "status").agg(F.count("*").alias("n"))


def agg15_bootstrap(spark, d):
    per = ev.first_relevant(judged(spark, d)).withColumn("found", F.col("first_rank").isNotNull().cast("double")).withColumn("arm", F.col("probe_id") % 4)
    return ev.bootstrap_interval(per, ["arm"], "found", "probe_id")


def agg16_percentiles(spark, d):
    x = hits(spark, d).select("content_type", F.col("score").cast("double").alias("score"))
    out = ev.nearest_rank(x, "content_type", "score", [5, 50, 95])
    return out.select("content_type", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in (5, 50, 95)])


def agg20_oracle_routing(spark, d):
    per = hits(spark, d).where("content_type is not null").groupBy("probe_id", "content_type").agg(F.max(F.col("score").cast("double")).alias("best"))
    by = per.groupBy("probe_id").agg(F.max("best").alias("oracle"), F.max(F.when(F.col("content_type") == "book", F.col("best"))).alias("fixed"))
    return by.agg(F.count("*").alias("n"), F.round(F.avg("oracle"), 6).alias("oracle"), F.round(F.avg("fixed"), 6).alias("fixed"))


def agg21_log_rollup(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.coalesce(F.col("user_id").cast("string"), F.lit("anon")).alias("user"), F.col("event_type").alias("route")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_ms"), F.count_if(F.col("event_type") == "error").alias("failed"))


def agg23_separable(spark, d):
    g = table(spark, d, "garble_signals").distinct().where("value is not null and flagged is not null")
    out = g.agg(F.min(F.when(F.col("flagged"), F.col("value"))).alias("bad"), F.max(F.when(~F.col("flagged"), F.col("value"))).alias("good"))
    return out.select(F.round("bad", 6).alias("bad"), F.round("good", 6).alias("good"), (F.col("bad") > F.col("good")).alias("separable"), F.round((F.col("bad") + F.col("good")) / 2, 6).alias("threshold"))


def agg27_context_precision(spark, d):
    x = hits(spark, d).select("probe_id", "rank_no", t.parsed_score(F.coalesce("text", F.lit(""))).alias("score"))
    return x.groupBy("probe_id").agg(F.round(F.avg(F.when(F.col("rank_no") <= 8, F.col("score"))), 6).alias("precision"))


def flt6_by_status(spark, d):
    return state.manifest_view(manifest(spark, d)).where("status = 'failed'").select("source_id", "stage", F.coalesce(F.nullif("error", F.lit("")), F.lit("unknown")).alias("error"))


def flt6_outputs(spark, d):
    return state.manifest_view(manifest(spark, d)).where("stage = 'extract' and output_ref is not null").select("source_id", "output_ref")


def flt6_ingested(spark, d):
    return state.manifest_view(manifest(spark, d)).where(F.col("status").isin(state.INGESTED)).select("source_id").distinct()


def snk1_upsert(spark, d):
    old = points(spark, d).where("content_type <> 'paper'").withColumn("version", F.lit(1))
    new = points(spark, d).where("chunk_index < 3").withColumn("version", F.lit(2))
    return state.upserted(old, new).select("point_id", F.col("version").cast("bigint").alias("version"))


def snk2_replace(spark, d):
    old = points(spark, d).withColumn("version", F.lit(1))
    batch = points(spark, d).where("collection = 'serials' and chunk_index < 4").withColumn("version", F.lit(2))
    return state.replaced(old, batch).select("point_id", "source_id", F.col("version").cast("bigint").alias("version"))


def snk3_delete(spark, d):
    gone = state.manifest_view(manifest(spark, d)).where("status = 'failed' and stage = 'extract'").select("source_id")
    return state.deleted(points(spark, d), gone).select("point_id")


def snk4_named_slots(spark, d):
    p = points(spark, d, "vector")
    slots = state.named_slots(text=F.col("vector"), code=F.when(F.col("content_type") == "code", F.col("vector")))
    return p.select("point_id", F.array_join(F.array_sort(F.map_keys(slots)), ",").alias("slots")).distinct()


def snk5_manifest_latest(spark, d):
    return state.manifest_view(manifest(spark, d)).select("source_id", "stage", "status", "attempts", "updated_at")


def snk9_prune(spark, d):
    snaps = manifest(spark, d).where("output_ref is not null").groupBy("output_ref").agg(F.max("updated_at").alias("created"), F.min(F.substring_index("source_id", "/", 1)).alias("collection"))
    return state.to_prune(snaps.withColumnRenamed("output_ref", "snapshot_id"), 5).select("collection", "snapshot_id", "created")


def snk11_rekey(spark, d):
    p = points(spark, d).withColumn("new_source", F.concat(F.lit("v2/"), "source_id"))
    return p.select("point_id", ids.chunk_id(F.col("new_source"), F.col("chunk_index")).alias("new_chunk"), F.count("*").over(Window.partitionBy("new_source", "chunk_index")).alias("claims"))


def win2_margins(spark, d):
    w = Window.partitionBy("probe_id").orderBy("rank_no", "hit_id")
    x = hits(spark, d).withColumn("gap", F.col("score").cast("double") - F.lead(F.col("score").cast("double")).over(w))
    return x.select("hit_id", F.round("gap", 6).alias("gap"))


def win6_neighbours(spark, d):
    h = hits(spark, d).select("hit_id", "source_id", F.col("chunk_index").alias("at"))
    near = h.withColumn("chunk_index", F.explode(F.sequence(F.col("at") - 2, F.col("at") + 2)))  # an equi-join on the five chunks, instead of a range join
    return near.join(points(spark, d).select("source_id", "chunk_index"), ["source_id", "chunk_index"]).groupBy("hit_id").agg(F.count("*").alias("chunks"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"))


def win7_merged_windows(spark, d):
    h = hits(spark, d).select("source_id", F.greatest(F.col("chunk_index") - 2, F.lit(0)).alias("start"), (F.col("chunk_index") + 3).alias("end")).distinct()
    return ev.islands(h)


def win8_trailing_baseline(spark, d):
    runs = ev.health(ev.first_relevant(judged(spark, d)).withColumn("run", F.col("probe_id") % 10), ["run"])
    w = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # ten rows of history
    return runs.select("run", F.round("mrr", 6).alias("mrr"), F.round(F.avg("mrr").over(w), 6).alias("mean"), F.round(F.stddev_pop("mrr").over(w), 6).alias("dev"))


def win9_drift(spark, d):
    runs = ev.health(ev.first_relevant(judged(spark, d)).withColumn("run", F.col("probe_id") % 10), ["run"])
    return runs.select("run", F.round(F.col("mean_top_score") - F.lag("mean_top_score").over(Window.orderBy("run")), 6).alias("drift"))


def jn4_outputs_with_hits(spark, d):
    outs = state.manifest_view(manifest(spark, d)).where("stage = 'extract'").select("source_id", "output_ref")
    made = spans_by_source(spark, d)
    return outs.join(made, "source_id", "left").select("source_id", F.coalesce("spans", F.lit(0)).alias("spans"), (F.col("output_ref").isNull() | F.col("spans").isNull()).alias("unreadable"))


def spans_by_source(spark, d):
    return table(spark, d, "text_spans").select("source_id", "span_id").distinct().groupBy("source_id").agg(F.count("*").alias("spans"))


def jn5_new_work(spark, d):
    done = state.manifest_view(manifest(spark, d)).where((F.col("stage") == "extract") & F.col("status").isin(state.INGESTED)).select("source_id")
    return table(spark, d, "sources").select("source_id").distinct().join(done, "source_id", "left_anti")


def jn10_works(spark, d):
    s = table(spark, d, "sources").distinct().where("work_id is not null")
    return s.join(points(spark, d).select("source_id", "point_id"), "source_id").groupBy("work_id").agg(F.countDistinct("source_id").alias("members"), F.count("*").alias("points"))


def jn12_users(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return e.join(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", "left").select("user_id", "n", F.coalesce("c_name", F.lit("anon")).alias("name"))


def set1_distinct_hits(spark, d):
    first = state.latest(hits(spark, d), ["source_id", "chunk_index"], [F.asc("rank_no"), F.asc("probe_id"), F.asc("hit_id")])
    return first.select("source_id", "chunk_index", "hit_id", "rank_no")


def set2_fusion(spark, d):
    x = hits(spark, d).withColumn("topic", F.col("probe_id") % 50).withColumn("key", F.concat_ws("#", "source_id", "chunk_index"))
    return ev.fused(x, "topic", "key", "rank_no", 10).select("topic", "key", F.round("rrf", 6).alias("rrf"), F.col("place").cast("bigint").alias("place"))


def set3_backfill(spark, d):
    x = hits(spark, d).withColumn("priority", F.when(F.length("text") >= 200, 0).otherwise(1))
    w = Window.partitionBy("probe_id").orderBy("priority", "rank_no", "hit_id")
    return x.withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 3").select("probe_id", "hit_id", "place")


def fn25_payloads(spark, d):
    p = table(spark, d, "points").select("point_id", "payload_json").distinct()
    return p.select("point_id", F.map_keys(F.from_json("payload_json", "map<string,string>"))[0].alias("kind"))


def st4_token_bucket(spark, d):
    from stackmill.streaming.ratelimit import admitted

    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return admitted(e, "user_id", "ts", "event_id", capacity=2.0, per_second=1 / 86400.0).groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(~F.col("admitted")).alias("rejected"))


QUERIES = {f.__name__: f for f in (
    flt1_content_type, flt3_chunk_range, flt5_empty_queries, flt7_relevant_hits, flt8_answer_bearing, flt9_fragments, flt11_already_there, top1_norms, top3_batch_search, top3_label_agreement, top6_extract, agg1_documents, agg2_collections,
    agg3_counts_by_source, agg4_confidence, agg5_first_rank, agg6_health, agg8_judge_report, agg11_regression, agg12_status_counts, agg15_bootstrap, agg16_percentiles, agg20_oracle_routing, agg21_log_rollup, agg23_separable,
    agg27_context_precision, flt6_by_status, flt6_outputs, flt6_ingested, snk1_upsert, snk2_replace, snk3_delete, snk4_named_slots, snk5_manifest_latest, snk9_prune, snk11_rekey, win2_margins, win6_neighbours, win7_merged_windows,
    win8_trailing_baseline, win9_drift, jn4_outputs_with_hits, jn5_new_work, jn10_works, jn12_users, set1_distinct_hits, set2_fusion, set3_backfill, fn25_payloads, st4_token_bucket)}

_P = "(select distinct point_id, collection, source_id, chunk_index, content_type from points)"
_H = "(select distinct * from hits)"
_M = "(select * from (select distinct * from manifest) qualify row_number() over (partition by source_id, stage order by updated_at desc, attempts desc, status, error nulls first, output_ref nulls first) = 1)"
_FRAG = r"(case when text is null or length(text) < 80 or regexp_matches(text, '^[\s\p{Z}\x0b\x1c-\x1f\x85]*#') then 1.0::double else 0.0::double end)"
_SCORE = "coalesce(nullif(regexp_extract(coalesce(text, ''), '[012]', 0), ''), '0')::int"
_J = (f"(select h.*, row_number() over (partition by probe_id order by rank_no, hit_id) as rn, coalesce(list_bool_or(list_transform(relevant, lambda r: contains(lower(source_id), lower(r)))), false) as relevant_hit "
      f"from {_H} h left join (select distinct item_id, relevant from eval_items) i on i.item_id = 1001 + h.probe_id % 200)")
_FIRST = f"(select probe_id, min(case when relevant_hit then rn end) as first_rank, avg(case when rn <= 5 then {_FRAG} end) as frag, max(case when rn = 1 then score::double end) as top from {_J} group by probe_id)"
_RUNS = f"(select probe_id % 10 as run, count(*) as n, avg(case when first_rank is not null then 1.0::double else 0 end) as hit_rate, avg(coalesce(1.0::double / first_rank, 0)) as mrr, avg(frag) as fragment_rate, avg(top) as mean_top_score from {_FIRST} group by 1)"
_UNIT = "list_transform(embedding, lambda x: x::double)"
_NEAR = ("(select * from (select q.vec_id as query, v.vec_id as key, v.label as label, q.label as wanted, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as score from embeddings q, embeddings v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id) "
         "qualify row_number() over (partition by query order by score desc, key) <= {0})")

SQL = {
    "flt1_content_type": f"select point_id from {_P} where content_type = 'paper'",
    "flt3_chunk_range": f"select point_id, source_id, chunk_index from {_P} where chunk_index >= 2 and chunk_index < 5",
    "flt5_empty_queries": f"select hit_id, case when regexp_full_match(coalesce(q, ''), '[\\s\\p{{Z}}\\x0b\\x85]*') then 'EmptyQuery' end as error from {_H}",
    "flt7_relevant_hits": f"select hit_id, relevant_hit from {_J}",
    "flt8_answer_bearing": f"select hit_id, coalesce(list_bool_or(list_transform(relevant, lambda r: contains(lower(source_id), lower(r)))) and length(text) >= 200 and coalesce(list_bool_and(list_transform(keywords, lambda k: contains(lower(text), lower(k)))), true), false) as answers "
                           f"from {_H} h join (select distinct item_id, relevant, keywords from eval_items) i on i.item_id = 1001 + h.probe_id % 200",
    "flt9_fragments": f"select hit_id, {_FRAG} = 1 as fragment from {_H} where text is not null",
    "flt11_already_there": f"select s.source_id, count(p.point_id) as points from (select distinct source_id from sources) s left join {_P} p using (source_id) group by s.source_id",
    "top1_norms": "select vec_id, round(list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]), 6) as cos from embeddings",
    "top3_batch_search": f"select query, key as neighbour, round(score, 6) as score, row_number() over (partition by query order by score desc, key) as rank from {_NEAR.format(10)}",
    "top3_label_agreement": f"select wanted, count(*) as n, round(avg(case when label = wanted then 1.0::double else 0 end), 6) as agreement from {_NEAR.format(5)} group by wanted",
    "top6_extract": "select source_id, chunk_index, row_number() over (partition by source_id order by chunk_index) as place, md5(text) as text from (select distinct point_id, source_id, chunk_index, text from points) where chunk_index >= 0 and chunk_index < 20",
    "agg1_documents": "select distinct source_id from points",
    "agg2_collections": f"select collection, count(*) as points, count(distinct source_id) as sources from {_P} group by collection",
    "agg3_counts_by_source": f"select source_id, count(*) as points from {_P} group by source_id",
    "agg4_confidence": f"with c as (select probe_id, max(case when rn = 1 then score::double end) as top, max(case when rn = 2 then score::double end) as second, stddev_pop(score::double) as spread, avg(case when rn <= 5 then {_FRAG} end) as frag from {_J} group by probe_id), "
                       "m as (select *, coalesce(top - second, 0.0) as margin from c) select probe_id, round(top, 6) as top_score, round(margin, 6) as margin, round(spread, 6) as score_spread, round(frag, 6) as fragment_rate, round(greatest(0.0, least(1.0, top * (1 - 0.5 * frag))), 6)::double as value, "
                       "case when top < 0.25::double then 'likely_no_answer' when top >= 0.40::double and margin >= 0.03::double and frag <= 0.40::double then 'strong' else 'weak' end as label from m",
    "agg5_first_rank": f"select probe_id, first_rank, round(frag, 6) as frag, round(top, 6) as top from {_FIRST}",
    "agg6_health": f"select count(*) as n, round(avg(case when first_rank is not null then 1.0::double else 0 end), 6) as hit_rate, round(avg(coalesce(1.0::double / first_rank, 0)), 6) as mrr, round(avg(frag), 6) as fragment_rate, round(avg(top), 6) as mean_top_score from {_FIRST}",
    "agg8_judge_report": f"select content_type, count(*) as n, round(avg({_SCORE}), 6) as mean, count_if({_SCORE} = 2) as direct, round(avg(case when rank_no <= 3 then {_SCORE} end), 6) as mean3 from {_H} group by content_type",
    "agg11_regression": f"with b as (select count(*) as runs, avg(hit_rate) as hm, stddev_pop(hit_rate) as hd, avg(mrr) as mm, stddev_pop(mrr) as md, avg(fragment_rate) as fm, stddev_pop(fragment_rate) as fd from {_RUNS} where run < 9) "
                        f"select run, runs, round(mrr, 6) as mrr, round(mm, 6) as mrr_mean, round(md, 6) as mrr_dev, case when runs < 2 then null when hm - hit_rate > greatest(2 * hd, 0.01::double) then 'hit_rate' when mm - mrr > greatest(2 * md, 0.01::double) then 'mrr' when fragment_rate - fm > greatest(2 * fd, 0.01::double) then 'fragment_rate' end as regressed from {_RUNS} r, b where run = 9",
    "agg12_status_counts": f"select stage, status, count(*) as n from {_M} group by stage, status",
    "agg16_percentiles": f"with s as (select content_type, list_sort(list(score::double)) as s from {_H} group by content_type) select content_type, " + ", ".join(f"round(s[round_even({p} / 100.0::double * (len(s) - 1), 0)::int + 1], 6) as p{p}" for p in (5, 50, 95)) + " from s",
    "agg20_oracle_routing": f"with b as (select probe_id, content_type, max(score::double) as best from {_H} where content_type is not null group by 1, 2), o as (select probe_id, max(best) as oracle, max(case when content_type = 'book' then best end) as fixed from b group by 1) select count(*) as n, round(avg(oracle), 6) as oracle, round(avg(fixed), 6) as fixed from o",
    "agg21_log_rollup": "select coalesce(user_id::varchar, 'anon') as user, event_type as route, count(*) as n, round(avg(value), 6) as mean_ms, count_if(event_type = 'error') as failed from events group by 1, 2",
    "agg23_separable": "with g as (select min(case when flagged then value end) as bad, max(case when not flagged then value end) as good from (select distinct * from garble_signals) where value is not null and flagged is not null) select round(bad, 6) as bad, round(good, 6) as good, bad > good as separable, round((bad + good) / 2, 6) as threshold from g",
    "agg27_context_precision": f"select probe_id, round(avg(case when rank_no <= 8 then {_SCORE} end), 6) as precision from {_H} group by probe_id",
    "flt6_by_status": f"select source_id, stage, coalesce(nullif(error, ''), 'unknown') as error from {_M} where status = 'failed'",
    "flt6_outputs": f"select source_id, output_ref from {_M} where stage = 'extract' and output_ref is not null",
    "flt6_ingested": f"select distinct source_id from {_M} where status in ('success', 'cached', 'recovered_via_fallback')",
    "snk1_upsert": f"select point_id, case when chunk_index < 3 then 2 else 1 end::bigint as version from {_P} where content_type <> 'paper' or chunk_index < 3",
    "snk2_replace": f"with b as (select * from {_P} where collection = 'serials' and chunk_index < 4) select point_id, source_id, 1::bigint as version from {_P} where source_id not in (select source_id from b) union all select point_id, source_id, 2::bigint from b",
    "snk3_delete": f"select point_id from {_P} where source_id not in (select source_id from {_M} where status = 'failed' and stage = 'extract')",
    "snk4_named_slots": "select distinct point_id, case when vector is null or len(vector) = 0 then '' when content_type = 'code' then 'code,text' else 'text' end as slots from points",
    "snk5_manifest_latest": f"select source_id, stage, status, attempts, updated_at from {_M}",
    "snk9_prune": "with s as (select output_ref as snapshot_id, max(updated_at) as created, min(split_part(source_id, '/', 1)) as collection from (select distinct * from manifest) where output_ref is not null group by 1) select collection, snapshot_id, created from s qualify row_number() over (partition by collection order by created desc, snapshot_id desc) > 5",
    "snk11_rekey": f"select point_id, 'v2/' || source_id || '#' || chunk_index as new_chunk, count(*) over (partition by source_id, chunk_index) as claims from {_P}",
    "win2_margins": f"select hit_id, round(score::double - lead(score::double) over (partition by probe_id order by rank_no, hit_id), 6) as gap from {_H}",
    "win6_neighbours": f"select hit_id, count(*) as chunks, min(p.chunk_index) as low, max(p.chunk_index) as high from {_H} h join {_P} p on p.source_id = h.source_id and p.chunk_index between h.chunk_index - 2 and h.chunk_index + 2 group by hit_id",
    "win7_merged_windows": 'with w as (select distinct source_id, greatest(chunk_index - 2, 0) as a, chunk_index + 3 as b from hits), m as (select *, max(b) over (partition by source_id order by a, b rows between unbounded preceding and 1 preceding) as before from w), '
                           'r as (select *, sum(case when before is null or a > before then 1 else 0 end) over (partition by source_id order by a, b rows unbounded preceding) as run from m) select source_id, min(a) as start, max(b) as "end" from r group by source_id, run',
    "win8_trailing_baseline": f"select run, round(mrr, 6) as mrr, round(avg(mrr) over w, 6) as mean, round(stddev_pop(mrr) over w, 6) as dev from {_RUNS} window w as (order by run rows between unbounded preceding and 1 preceding)",
    "win9_drift": f"select run, round(mean_top_score - lag(mean_top_score) over (order by run), 6) as drift from {_RUNS}",
    "jn4_outputs_with_hits": f"with s as (select source_id, count(distinct span_id) as spans from text_spans group by 1) select m.source_id, coalesce(spans, 0) as spans, output_ref is null or spans is null as unreadable from {_M} m left join s using (source_id) where stage = 'extract'",
    "jn5_new_work": f"select distinct source_id from sources where source_id not in (select source_id from {_M} where stage = 'extract' and status in ('success', 'cached', 'recovered_via_fallback'))",
    "jn10_works": f"select work_id, count(distinct s.source_id) as members, count(*) as points from (select distinct * from sources) s join {_P} p using (source_id) where work_id is not null group by work_id",
    "jn12_users": "select e.user_id, e.n, coalesce(c_name, 'anon') as name from (select user_id, count(*) as n from events group by 1) e left join customer on c_custkey = user_id",
    "set1_distinct_hits": f"select source_id, chunk_index, hit_id, rank_no from {_H} qualify row_number() over (partition by source_id, chunk_index order by rank_no, probe_id, hit_id) = 1",
    "set2_fusion": f"with f as (select probe_id % 50 as topic, source_id || '#' || chunk_index as key, sum(1.0::double / (60 + rank_no - 1)) as rrf from {_H} group by 1, 2), p as (select *, row_number() over (partition by topic order by round(rrf, 12) desc, key) as place from f) select topic, key, round(rrf, 6) as rrf, place from p where place <= 10",
    "set3_backfill": f"select probe_id, hit_id, row_number() over (partition by probe_id order by case when length(text) >= 200 then 0 else 1 end, rank_no, hit_id) as place from {_H} qualify place <= 3",
    "fn25_payloads": "select distinct point_id, json_keys(payload_json)[1] as kind from points",
}
