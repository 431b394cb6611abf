"""Queries on the ingestion pipeline, its control decisions and the event log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stackmill.functions import answers as a
from stackmill.functions import text as t
from stackmill.operators import evaluation as ev
from stackmill.operators import ingest, state
from stackmill.operators.embedding import is_recoverable, judge_prompt
from stackmill.plans.retrieval import hits, manifest, points
from stackmill.plans.texts import EXCLUDE, KEEP, documents, sources, spans
from stackmill.session import table
from stackmill.sources.config import PipelineConfig
from stackmill.streaming import flows

CONFIG = PipelineConfig(collection="all", exclude=tuple(EXCLUDE), keep=tuple(KEEP))


def ctl1_outcomes(spark, d):
    return ingest.staged(spans(spark, d), CONFIG)[1].groupBy("stage", "status").agg(F.count("*").alias("n"))


def ctl1_points(spark, d):
    return ingest.staged(spans(spark, d), CONFIG)[0].select("point_id", "source_id", "chunk_index", F.md5("text").alias("chunk"))


def ctl3_removed(spark, d):
    gone = sources(spark, d).where("content_type is null").select("source_id")
    left, log = ingest.removed(points(spark, d), gone)
    return left.agg(F.count("*").alias("points")).crossJoin(log.agg(F.count("*").alias("entries")))  # two counts


def ctl5_undo(spark, d):
    last = manifest(spark, d).where("stage = 'index'").groupBy(F.substring_index("source_id", "/", 1).alias("shelf")).agg(F.max_by("source_id", F.struct("updated_at", "source_id")).alias("source_id"))
    return state.deleted(points(spark, d), last).groupBy("collection").agg(F.count("*").alias("points"))


def ctl7_reconciled(spark, d):
    view = state.manifest_view(manifest(spark, d))
    end = manifest(spark, d).agg(F.max("updated_at").alias("now"))
    x = view.crossJoin(end)  # one row
    return x.groupBy("stage").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if((F.col("status") == "failed") & (F.col("now") - F.col("updated_at") > 86400)).alias("stale"), F.max(F.col("now") - F.col("updated_at")).alias("oldest"))


def emb4_status_classes(spark, d):
    code = F.regexp_extract("error", r"HTTP (\d{3})", 1)
    status = F.when(code != "", code.cast("int")).when(F.col("error").contains("timeout"), 408)
    x = manifest(spark, d).where("status = 'failed'").select(F.when(status.isNull(), "unknown").when(is_recoverable(status), "recoverable").otherwise("terminal").alias("class"), "stage")
    return x.groupBy("class", "stage").agg(F.count("*").alias("n"))


def emb5_recovered(spark, d):
    x = manifest(spark, d).groupBy("source_id", "stage").agg(F.max("attempts").alias("attempts"), F.count_if(F.col("status") == "failed").alias("failures"), F.bool_or(F.col("status") == "recovered_via_fallback").alias("recovered"))
    return x.groupBy("stage").agg(F.count_if("recovered").alias("recovered"), F.count_if(~F.col("recovered") & (F.col("failures") > 0)).alias("retried"), F.max("attempts").alias("most"))


def fn3_letterspace_density(spark, d):
    return spans(spark, d).where("text is not null").select("span_id", F.round(a.letterspace_density(F.col("text")), 6).alias("density"))


def fn5_known_words(spark, d):
    words = documents(spark, d).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), 0)).alias("w"))
    per = words.groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    known = per.groupBy("w").agg(F.count("*").alias("docs")).where("docs >= 3")
    marked = per.join(known, "w", "left")
    return marked.groupBy("doc_id").agg(F.round(F.sum(F.when(F.col("docs").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("known"))


def fn8_gzip_ratio(spark, d):
    return spans(spark, d).where("text is not null and text <> ''").select("span_id", F.round(a.gzip_ratio(F.col("text")), 6).alias("ratio"))


def fn13_expected_sources(spark, d):
    kind, stem = t.kind_of(F.col("path")), t.slugify(t.file_stem(F.col("path")))
    shelf = F.substring_index("source_id", "/", 1)
    return sources(spark, d).select("source_id", F.when(kind.isin("markdown", "pdf"), F.concat(shelf, F.lit("/markdown/"), stem, F.lit("/"), stem, F.lit(".md"))).otherwise(F.concat(shelf, F.lit("/"), kind, F.lit("/"), stem, F.lit("."), t.extension(F.col("path")))).alias("expected"))


def fn16_prompts(spark, d):
    return hits(spark, d).where("q is not null and text is not null").select("hit_id", F.md5(judge_prompt(F.col("q"), F.col("text"))).alias("prompt"))


def fn18_books(spark, d):
    return points(spark, d).groupBy(F.regexp_extract("source_id", r"^[^/]*/([^_/]*)", 1).alias("work")).agg(F.count("*").alias("points"), F.countDistinct("source_id").alias("sources"))


def fn20_citations(spark, d):
    return documents(spark, d).select("doc_id", F.size(a.cited(F.col("text"))).cast("bigint").alias("cited"), F.round(a.citation_density(F.col("text")), 6).alias("density"), a.declines(F.col("text")).alias("declines"))


def fn26_composite(spark, d):
    x = F.col("text")
    marks = t.replacement_marks(x) / F.greatest(F.length(x), F.lit(1)).cast("double")
    return spans(spark, d).where("text is not null").select("span_id", F.round(a.composite_garble(a.letterspace_density(x), marks, t.latex_imbalance(x)), 6).alias("value"))


def agg7_chunk_recall(spark, d):
    items = table(spark, d, "eval_items").select("item_id", "relevant", "keywords").distinct()
    rows = hits(spark, d).withColumn("item_id", 1001 + F.col("probe_id") % 200).join(items, "item_id")
    found = ev.contains_any(F.col("source_id"), F.col("relevant")) & (F.length("text") >= 200) & F.forall("keywords", lambda k: F.contains(F.lower("text"), F.lower(k)))
    per = rows.groupBy("probe_id").agg(F.min(F.when(found, F.col("rank_no"))).alias("r"))
    return per.agg(F.round(F.avg(F.col("r").isNotNull().cast("double")), 6).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def agg14_arms(spark, d):
    x = hits(spark, d).withColumn("score2", t.parsed_score(F.coalesce("text", F.lit(""))))
    return x.groupBy("content_type", "rank_no").agg(F.count("*").alias("n"), F.round(F.avg("score2"), 6).alias("quality"), F.round(F.avg(F.length("text")), 6).alias("chars"))


def agg25_coverage(spark, d):
    s = spans(spark, d)
    per = s.groupBy("source_id").agg(F.max("page").alias("last"), F.min("page").alias("first"), F.countDistinct("page").alias("pages")).where("last is not null")
    share = F.col("pages") / (F.col("last") - F.col("first") + 1).cast("double")
    return per.select("source_id", F.round(share, 6).alias("coverage"), share.between(0.8, 1.02).alias("healthy"))


def top7_flagged(spark, d):
    g = table(spark, d, "garble_signals").distinct().where("flagged")
    return g.groupBy("source_id").agg(F.round(F.max("value"), 6).alias("value")).orderBy(F.desc("value"), "source_id")


def top8_best_arm(spark, d):
    x = agg14_arms(spark, d).where("content_type is not null")
    return x.groupBy("content_type").agg(F.max_by("rank_no", F.struct("quality", -F.col("chars"), -F.col("rank_no"))).alias("best"))


def top9_stride(spark, d):
    per = sources(spark, d).withColumn("shelf", F.substring_index("source_id", "/", 1)).select("shelf", "source_id").distinct()
    w = Window.partitionBy("shelf")
    x = per.withColumn("at", F.row_number().over(w.orderBy("source_id")) - 1).withColumn("step", F.greatest(F.lit(1), F.floor(F.count("*").over(w) / 3)))
    return x.where((F.col("at") % F.col("step") == 0) & (F.col("at") / F.col("step") < 3)).select("shelf", "source_id")  # three of each shelf is the operator's feature


def set5_cited_sources(spark, d):
    """For each probe, the sources of its hits whose places its texts cite as [n]; all its sources where none is cited."""
    h = hits(spark, d)
    said = h.where("text is not null").select("probe_id", F.explode(F.array_distinct(a.cited(F.col("text")))).alias("n")).select("probe_id", F.expr("try_cast(n as bigint)").alias("rank_no")).distinct()
    named = h.join(said, ["probe_id", "rank_no"]).groupBy("probe_id").agg(F.countDistinct("source_id").alias("cited"))
    every = h.groupBy("probe_id").agg(F.countDistinct("source_id").alias("every"))
    return every.join(named, "probe_id", "left").select("probe_id", F.coalesce("cited", "every").alias("sources"), F.coalesce("cited", F.lit(0)).alias("cited"))


def exp1_windows(spark, d):
    h = hits(spark, d).select("hit_id", "source_id", F.col("chunk_index").alias("at"))
    w = t.window_of(F.col("at"), context=1)
    near = h.withColumn("chunk_index", F.explode(F.sequence(w["start"], w["end"] - 1)))
    return near.join(points(spark, d, "text").select("source_id", "chunk_index", "text"), ["source_id", "chunk_index"]).groupBy("hit_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


def st2_log_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = flows.log_rollup(e, width="1 hour").groupBy(F.unix_seconds("window.start").alias("start"), "route").agg(F.sum("n").cast("bigint").alias("n"), F.sum("failed").cast("bigint").alias("failed"))
    return out


def st_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.sessions(e, gap="6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (ctl1_outcomes, ctl1_points, ctl3_removed, ctl5_undo, ctl7_reconciled, emb4_status_classes, emb5_recovered, fn3_letterspace_density, fn5_known_words, fn8_gzip_ratio, fn13_expected_sources, fn16_prompts, fn18_books,
                                   fn20_citations, fn26_composite, agg7_chunk_recall, agg14_arms, agg25_coverage, top7_flagged, top8_best_arm, top9_stride, set5_cited_sources, exp1_windows, st2_log_windows, st_sessions)}

from stackmill.plans import retrieval as r  # noqa: E402
from stackmill.plans import texts as x  # noqa: E402

_STEM = x._STEM.replace("path", "source_id")
_DENSITY = r"1000.0::double * len(regexp_extract_all(text, '(?:\b[A-Za-z] ){3,}[A-Za-z]\b')) / greatest(length(text), 1)"
_SLUG = f"regexp_replace(regexp_replace(lower({x._STEM}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_LATEX = "(select span_id, text, (length(text) - length(replace(text, '$$', ''))) / 2 as dd, length(text) - length(replace(text, '$', '')) as s, length(text) - length(replace(text, '{', '')) as o, length(text) - length(replace(text, '}', '')) as c from " + x._SPANS + " where text is not null)"
_M = "(select distinct * from manifest)"
_ARMS = f"(select content_type, rank_no, count(*) as n, round(avg({r._SCORE}), 6) as quality, round(avg(length(text)), 6) as chars from {r._H} group by 1, 2)"
SQL = {
    "ctl1_outcomes": f"with w as (select source_id, bool_or(text is null) as broken, sum(length(text)) as chars, sum({x._MARKS} + {x._RUNS}) as marks, {x._reason(_STEM)} as reason from {x._SPANS} group by source_id), "
                     "k as (select *, case when reason is not null then 's' when broken or coalesce(chars, 0) = 0 then 'f' else 'g' end as k from w), "
                     "e as (select 'section' as stage, 'skipped' as status from k where k = 's' union all select 'extract', 'failed' from k where k = 'f' union all select unnest(['extract', 'chunk', 'embed', 'index']), 'success' from k where k = 'g' "
                     "union all select 'quality', case when marks * 1000.0::double / greatest(chars, 1) > 1.0 then 'flagged' else 'success' end from k where k = 'g') select stage, status, count(*) as n from e group by 1, 2",
    "ctl3_removed": f"with g as (select distinct source_id from {x._SOURCES} where content_type is null) select (select count(*) from {r._P} where source_id not in (select source_id from g)) as points, (select 4 * count(*) from g) as entries",
    "ctl5_undo": f"with l as (select arg_max(source_id, (updated_at, source_id)) as source_id from {_M} where stage = 'index' group by split_part(source_id, '/', 1)) select collection, count(*) as points from {r._P} where source_id not in (select source_id from l) group by 1",
    "ctl7_reconciled": f"with n as (select max(updated_at) as now from manifest) select stage, count_if(status = 'failed') as failed, count_if(status = 'failed' and now - updated_at > 86400) as stale, max(now - updated_at) as oldest from {r._M} v, n group by stage",
    "emb4_status_classes": rf"with s as (select stage, coalesce(try_cast(nullif(regexp_extract(error, 'HTTP (\d{{3}})', 1), '') as int), case when contains(error, 'timeout') then 408 end) as st from {_M} where status = 'failed') "
                           "select case when st is null then 'unknown' when st in (408, 429) or st between 500 and 599 then 'recoverable' else 'terminal' end as class, stage, count(*) as n from s group by 1, 2",
    "emb5_recovered": f"with p as (select source_id, stage, max(attempts) as attempts, count_if(status = 'failed') as failures, bool_or(status = 'recovered_via_fallback') as recovered from {_M} group by 1, 2) select stage, count_if(recovered) as recovered, count_if(not recovered and failures > 0) as retried, max(attempts) as most from p group by 1",
    "fn3_letterspace_density": f"select span_id, round({_DENSITY}, 6) as density from {x._SPANS} where text is not null",
    "fn5_known_words": "with w as (select doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}{4,}')) as w from documents), p as (select doc_id, w, count(*) as n from w group by 1, 2), k as (select w, count(*) as docs from p group by 1 having count(*) >= 3) "
                       "select doc_id, round(sum(case when k.w is not null then n else 0 end)::double / sum(n), 6) as known from p left join k using (w) group by doc_id",
    "fn13_expected_sources": f"select source_id, case when {x._cases(t.KINDS)} in ('markdown', 'pdf') then split_part(source_id, '/', 1) || '/markdown/' || {_SLUG} || '/' || {_SLUG} || '.md' else split_part(source_id, '/', 1) || '/' || {x._cases(t.KINDS)} || '/' || {_SLUG} || '.' || {x._EXT} end as expected from {x._SOURCES}",
    "fn16_prompts": f"select hit_id, md5('Question: ' || q || chr(10) || chr(10) || 'Passage: ' || text || chr(10) || chr(10) || 'How well does the passage answer the question? Reply 0 (not), 1 (in part) or 2 (directly).') as prompt from {r._H} where q is not null and text is not null",
    "fn18_books": f"select regexp_extract(source_id, '^[^/]*/([^_/]*)', 1) as work, count(*) as points, count(distinct source_id) as sources from {r._P} group by 1",
    "fn20_citations": r"select doc_id, len(list_distinct(regexp_extract_all(text, '\[(\d+)\]', 1)))::bigint as cited, round(len(regexp_extract_all(text, '\[\d+\]')) / greatest(len(regexp_extract_all(text, '[.!?]')), 1)::double, 6) as density, "
                      + " or ".join(f"contains(lower(substr(text, 1, 160)), '{p.replace(chr(39), chr(39) * 2)}')" for p in a.DECLINES) + " as declines from documents",
    "fn26_composite": f"select span_id, round({_DENSITY} + 1000.0::double * {x._MARKS} / greatest(length(text), 1) + least(dd % 2 + abs(s - 2 * dd) % 2 + coalesce(abs(o - c) / nullif(o + c, 0)::double, 0.0), 5.0), 6) as value from {_LATEX}",
    "agg7_chunk_recall": f"with p as (select probe_id, min(case when list_bool_or(list_transform(relevant, lambda z: contains(lower(source_id), lower(z)))) and length(text) >= 200 and coalesce(list_bool_and(list_transform(keywords, lambda k: contains(lower(text), lower(k)))), true) then rank_no end) as r "
                         f"from {r._H} h join (select distinct item_id, relevant, keywords from eval_items) i on i.item_id = 1001 + h.probe_id % 200 group by 1) select round(avg(case when r is not null then 1.0::double else 0 end), 6) as recall, round(avg(coalesce(1.0::double / r, 0)), 6) as mrr from p",
    "agg14_arms": f"select * from {_ARMS}",
    "agg25_coverage": f"with p as (select source_id, max(page) as last, min(page) as first, count(distinct page) as pages from {x._SPANS} group by 1 having max(page) is not null) select source_id, round(pages / (last - first + 1)::double, 6) as coverage, pages / (last - first + 1)::double between 0.8 and 1.02 as healthy from p",
    "top7_flagged": "select source_id, round(max(value), 6) as value from (select distinct * from garble_signals) where flagged group by 1",
    "top8_best_arm": f"select content_type, arg_max(rank_no, (quality, -chars, -rank_no)) as best from {_ARMS} where content_type is not null group by 1",
    "top9_stride": "with s as (select distinct split_part(source_id, '/', 1) as shelf, source_id from sources), n as (select *, row_number() over (partition by shelf order by source_id) - 1 as at_, greatest(1, count(*) over (partition by shelf) // 3) as step from s) select shelf, source_id from n where at_ % step = 0 and at_ / step < 3",
    "set5_cited_sources": rf"with s as (select distinct probe_id, try_cast(unnest(regexp_extract_all(text, '\[(\d+)\]', 1)) as bigint) as rank_no from {r._H} where text is not null), n as (select probe_id, count(distinct source_id) as cited from {r._H} h join s using (probe_id, rank_no) group by 1), "
                          f"e as (select probe_id, count(distinct source_id) as every from {r._H} group by 1) select probe_id, coalesce(cited, every) as sources, coalesce(cited, 0) as cited from e left join n using (probe_id)",
    "exp1_windows": f"select hit_id, count(*) as chunks, sum(length(p.text))::bigint as chars from {r._H} h join (select distinct point_id, source_id, chunk_index, text from points) p on p.source_id = h.source_id and p.chunk_index >= greatest(h.chunk_index - 1, 0) and p.chunk_index < h.chunk_index + 2 group by 1",
    "st2_log_windows": "select (floor(epoch(ts))::bigint // 3600) * 3600 as start, event_type as route, count(*) as n, count_if(event_type = 'error')::bigint as failed from events group by 1, 2",
    "st_sessions": "with g as (select user_id, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 6 hours then 1 else 0 end as fresh, ts from events window w as (partition by user_id order by ts)), s as (select user_id, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g), "
                   "n as (select user_id, k, count(*) as n from s group by 1, 2) select user_id, count(*) as sessions, max(n) as longest from n group by 1",
}
