"""Queries on searching collections, asking more than once, quotations, and adding sources behind gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stackmill.functions import garble as g
from stackmill.functions import identity as ids
from stackmill.functions import text as t
from stackmill.operators import evaluation as ev
from stackmill.operators import gates, ingest, state, strategies
from stackmill.operators.search import search_many, search_points
from stackmill.plans import retrieval as r
from stackmill.plans.texts import _MARKS, _SPANS, spans
from stackmill.session import table
from stackmill.sources.config import PipelineConfig

COLLECTION, DIM = "software", 64


def _probe(spark, d) -> list[float]:
    """The vector of the collection's point with the smallest id that has one: the query that is asked."""
    good = r.points(spark, d, "vector").where((F.col("collection") == COLLECTION) & (F.size("vector") == DIM) & ~F.exists("vector", lambda x: x.isNull()))
    return [float(x) for x in good.orderBy("point_id").select("vector").first()["vector"]]


def flt2_source(spark, d):
    first = r.points(spark, d).agg(F.min("source_id").alias("source_id"))
    return r.points(spark, d).join(F.broadcast(first), "source_id").select("point_id", "source_id", "chunk_index")


def top2_collection_search(spark, d):
    found = search_points(r.points(spark, d, "vector").distinct(), COLLECTION, _probe(spark, d), 10)
    return found.select("point_id", F.round("score", 6).alias("score"))


def top2_filtered_search(spark, d):
    found = search_points(r.points(spark, d, "vector").distinct(), COLLECTION, _probe(spark, d), 10, content_type="book")
    return found.select("point_id", F.round("score", 6).alias("score"))


def top5_slot_search(spark, d):
    p = r.points(spark, d, "vector")
    p = p.withColumn("vectors", state.named_slots(text=F.col("vector"), code=F.when(F.col("content_type") == "code", F.col("vector"))))
    found = search_points(p, COLLECTION, _probe(spark, d), 10, slot="code", vector="vectors")
    return found.select("point_id", F.round("score", 6).alias("score"))


def top3_point_search(spark, d):
    """The five nearest points of the first chunk of every source, over all collections."""
    p = r.points(spark, d, "vector").where(F.size("vector") == DIM)
    found = search_many(p, p.where("chunk_index = 0"), 5, "point_id", "vector")
    return found.select("query", F.col("key").alias("neighbour"), F.round("score", 6).alias("score"), "rank")


def agg4_every_probe(spark, d):
    rows = r.judged(spark, d)
    books = rows.where("content_type = 'book'").withColumn("rn", F.row_number().over(Window.partitionBy("probe_id").orderBy("rank_no", "hit_id")))
    out = ev.confidence(books, queries=rows.select("probe_id"))
    return out.select("probe_id", *[F.round(c, 6).alias(c) for c in ("top_score", "margin", "score_spread", "fragment_rate", "value")], "label")


def _parts(spark, d):
    """Fifty questions whose parts are the probes that have the same place."""
    return r.hits(spark, d).select((F.col("probe_id") % 50).alias("topic"), F.floor(F.col("probe_id") / 50).cast("bigint").alias("sub"), "rank_no", "source_id", "chunk_index")


def ctl14_decompose(spark, d):
    return strategies.decomposed(_parts(spark, d).where("sub < 2"), "topic", ["source_id", "chunk_index"])


def ctl14_iterative(spark, d):
    parts = _parts(spark, d)
    labels = ev.confidence(r.judged(spark, d).where("probe_id < 50").withColumn("topic", F.col("probe_id") % 50), "topic").select("topic", "label")
    return strategies.iterative(parts.where("sub = 0"), parts.where("sub = 1"), labels, "topic", ["source_id", "chunk_index"])


def ctl14_fan_out(spark, d):
    x = _parts(spark, d).where("sub < 3").withColumn("key", F.concat_ws("#", "source_id", "chunk_index"))
    return ev.fused(x, "topic", "key", "rank_no", 12).select("topic", "key", F.round("rrf", 6).alias("rrf"), F.col("place").cast("bigint").alias("place"))


def _added(spark, d, threshold=0.5):
    p = r.points(spark, d)
    runs = ev.health(ev.first_relevant(r.judged(spark, d)).withColumn("run", F.col("probe_id") % 10), ["run"])
    return gates.added(p.where("collection <> 'serials'"), p.where("collection = 'serials'"), table(spark, d, "garble_signals"), runs.where("run < 9"), runs.where("run = 9"), threshold)


def ctl4_decisions(spark, d):
    return _added(spark, d)[1].groupBy("gate1", "regressed", "action").agg(F.count("*").alias("sources"))


def ctl4_points(spark, d):
    return _added(spark, d)[0].groupBy("collection").agg(F.count("*").alias("points"))


def snk10_progress(spark, d):
    return gates.progress(state.manifest_view(r.manifest(spark, d)))


def chk8_blank_line_index(spark, d):
    made = ingest.chunked(spans(spark, d).where("text is not null"), PipelineConfig(chunker="blankline"))
    return made.groupBy("source_id").agg(F.count("*").alias("chunks"), F.max("chunk_index").alias("last"))


def chk8_code_index(spark, d):
    code = spans(spark, d).where("text is not null and kind = 'Code'")
    return ingest.chunked(code, PipelineConfig(content_type="code")).groupBy("source_id").agg(F.count("*").alias("chunks"), F.max("chunk_index").alias("last"))


def chk9_payloads(spark, d):
    page = F.when(F.col("chunk_index") % 2 == 0, F.col("chunk_index"))
    made = [r.points(spark, d).where(F.col("content_type") == kind).select("point_id", ingest.payload(kind, F.col("source_id"), page).alias("payload")) for kind in ("book", "paper", "code")]
    return made[0].unionByName(made[1]).unionByName(made[2]).select("point_id", F.md5("payload").alias("payload"))


def agg27_nugget_recall(spark, d):
    """Share of an item's first three keywords that stand in the texts of its probes' hits."""
    items = table(spark, d, "eval_items").select("item_id", F.slice("keywords", 1, 3).alias("nuggets")).distinct()
    n = items.select("item_id", F.posexplode("nuggets").alias("at", "nugget"))
    texts = r.hits(spark, d).where("text is not null").select((1001 + F.col("probe_id") % 200).alias("item_id"), F.lower("text").alias("text"))
    found = n.join(texts, "item_id", "left").groupBy("item_id", "at").agg(F.coalesce(F.bool_or(F.contains("text", F.lower("nugget"))), F.lit(False)).alias("found"))
    return found.groupBy("item_id").agg(F.round(F.avg(F.col("found").cast("double")), 6).alias("recall"))


def agg20_router_accuracy(spark, d):
    """How often the content type of the best first hit is that of the best hit at all."""
    h = r.hits(spark, d).where("content_type is not null")
    best = h.groupBy("probe_id").agg(F.max_by("content_type", F.struct(F.col("score").cast("double"), "content_type")).alias("best"), F.max_by("content_type", F.struct(-F.col("rank_no"), "content_type")).alias("routed"))
    return best.agg(F.count("*").alias("n"), F.round(F.avg((F.col("best") == F.col("routed")).cast("double")), 6).alias("accuracy"))


def fn4_replacement_rate(spark, d):
    x = spans(spark, d).where("text is not null")
    return x.select("span_id", F.round(t.replacement_marks(F.col("text")) / F.greatest(F.length("text"), F.lit(1)), 6).alias("rate"))


def fn9_letters_joined(spark, d):
    return spans(spark, d).where("text is not null").select("span_id", F.md5(g.letters_joined(F.col("text"))).alias("joined"))


def fn10_garbled(spark, d):
    x = table(spark, d, "documents").where("text is not null")
    return x.select("doc_id", F.md5(g.letterspaced(F.col("text"))).alias("spaced"), F.md5(g.with_marks(F.col("text"))).alias("marked"))


def snk4_wrong_slots(spark, d):
    slots = state.named_slots(text=F.col("vector"), code=F.when(F.col("content_type") == "code", F.col("vector")))
    return r.points(spark, d, "vector").select("point_id", F.array_join(state.wrong_slots(slots, {"text": DIM, "code": 2 * DIM}), ",").alias("wrong")).distinct()


def snk11_collisions(spark, d):
    """Points by their new ids: how many there are of each shelf, and how many ids more than one point claims."""
    new = r.points(spark, d).withColumn("new_id", ids.point_id(F.concat(F.lit("v2/"), "source_id"), F.col("chunk_index")))
    claims = new.groupBy("new_id").agg(F.min("collection").alias("collection"), F.countDistinct("point_id").alias("n"))
    return claims.groupBy("collection").agg(F.count("*").alias("ids"), F.count_if(F.col("n") > 1).alias("collisions"))


def agg25_pieces(spark, d):
    """Share of each source's characters that its points hold, healthy from 80 to 102 %."""
    whole = spans(spark, d).where("text is not null").groupBy("source_id").agg(F.sum(F.length("text")).alias("whole"))
    held = r.points(spark, d, "text").distinct().groupBy("source_id").agg(F.sum(F.length("text")).alias("held"))
    share = F.coalesce("held", F.lit(0)) / F.col("whole").cast("double")
    return whole.where("whole > 0").join(held, "source_id", "left").select("source_id", F.round(share, 6).alias("coverage"), share.between(0.8, 1.02).alias("healthy"))


def fn23_statuses(spark, d):
    return r.manifest(spark, d).select(state.parsed_status(F.col("status")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def flt6_row(spark, d):
    first = r.manifest(spark, d).where("stage = 'embed'").agg(F.min("source_id").alias("source_id"))
    return state.manifest_view(r.manifest(spark, d)).where("stage = 'embed'").join(F.broadcast(first), "source_id").select("source_id", "stage", "status", "attempts", "updated_at")


QUERIES = {f.__name__: f for f in (flt2_source, top2_collection_search, top2_filtered_search, top5_slot_search, top3_point_search, agg4_every_probe, ctl14_decompose, ctl14_iterative, ctl14_fan_out, ctl4_decisions, ctl4_points, snk10_progress,
                                   chk8_blank_line_index, chk8_code_index, chk9_payloads, agg27_nugget_recall, agg20_router_accuracy, fn4_replacement_rate, fn9_letters_joined, fn10_garbled, snk4_wrong_slots, snk11_collisions, agg25_pieces, fn23_statuses, flt6_row)}

_V = f"(select distinct point_id, collection, source_id, chunk_index, content_type, vector from points where len(vector) = {DIM})"
_COS = "(select case when isnan(c) then 0 else c end from (select list_cosine_similarity({0}.vector::double[], {1}.vector::double[]) as c))"
_TOP = (f"with q as (select vector from {_V} where collection = '{COLLECTION}' order by point_id limit 1) select point_id, round({_COS.format('p', 'q')}, 6) as score "
        f"from {_V} p, q where collection = '{COLLECTION}'{{0}} order by {_COS.format('p', 'q')} desc, source_id, chunk_index limit 10")
_PARTS = f"(select probe_id % 50 as topic, probe_id // 50 as sub, rank_no, source_id, chunk_index from {r._H})"
def _confidence(key: str, rows: str) -> str:
    return (f"select {key} as k, max(case when rn = 1 then score::double end) as top, max(case when rn = 2 then score::double end) as second, stddev_pop(score::double) as spread, "
            f"avg(case when rn <= 5 then {r._FRAG} end) as frag from {rows} group by 1")


_LABEL = "case when top < 0.25::double then 'likely_no_answer' when top >= 0.40::double and coalesce(top - second, 0) >= 0.03::double and frag <= 0.40::double then 'strong' else 'weak' end"
_PLACES = "(select topic, source_id, chunk_index, row_number() over (partition by topic order by at_, source_id, chunk_index) as place from (select topic, source_id, chunk_index, min((sub, rank_no)) as at_ from {0} group by all)) where place <= 14"
_REGRESSED = (f"(select case when runs < 2 then null when hm - hit_rate > greatest(2 * hd, 0.01::double) then 'hit_rate' when mm - mrr > greatest(2 * md, 0.01::double) then 'mrr' when fragment_rate - fm > greatest(2 * fd, 0.01::double) then 'fragment_rate' end as regressed "
              f"from {r._RUNS} x, (select count(*) as runs, avg(hit_rate) as hm, stddev_pop(hit_rate) as hd, avg(mrr) as mm, stddev_pop(mrr) as md, avg(fragment_rate) as fm, stddev_pop(fragment_rate) as fd from {r._RUNS} where run < 9) b where run = 9)")
_ADDED = (f"(select s.source_id, coalesce(value <= 0.5::double, true) as gate1, regressed, case when not coalesce(value <= 0.5::double, true) then 'refused' when regressed is not null then 'rolled_back' else 'committed' end as action "
          f"from (select distinct source_id from {r._P} where collection = 'serials') s left join (select source_id, max(value) as value from garble_signals group by 1) g using (source_id), (select max(regressed) as regressed from {_REGRESSED}) w)")
_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x85]+|[\s\p{{Z}}\x0b\x1c-\x1f\x85]+$', '', 'g')"
_STEM = "regexp_replace(regexp_extract(source_id, '[^/]*$'), '(.)\\.[^.]*$', '\\1')"
SQL = {
    "flt2_source": f"select point_id, source_id, chunk_index from {r._P} where source_id = (select min(source_id) from points)",
    "top2_collection_search": _TOP.format(""),
    "top2_filtered_search": _TOP.format(" and content_type = 'book'"),
    "top5_slot_search": _TOP.format(" and content_type = 'code'"),
    "top3_point_search": f"select query, key as neighbour, round(score, 6) as score, row_number() over (partition by query order by score desc, key) as rank from (select q.point_id as query, p.point_id as key, {_COS.format('q', 'p')} as score from {_V} q, {_V} p where q.chunk_index = 0 and q.point_id <> p.point_id) qualify rank <= 5",
    "agg4_every_probe": f"with b as (select * exclude (rn), row_number() over (partition by probe_id order by rank_no, hit_id) as rn from {r._J} where content_type = 'book'), c as ({_confidence('probe_id', 'b')}) "
                        f"select probe_id, round(coalesce(top, 0), 6) as top_score, round(coalesce(top - second, 0.0), 6) as margin, round(coalesce(spread, 0), 6) as score_spread, round(coalesce(frag, 0), 6) as fragment_rate, round(greatest(0.0, least(1.0, coalesce(top * (1 - 0.5 * frag), 0))), 6)::double as value, "
                        f"case when k is null then 'likely_no_answer' else {_LABEL} end as label from (select distinct probe_id from hits) p left join c on k = probe_id",
    "ctl14_decompose": f"select topic, source_id, chunk_index, place from {_PLACES.format('(select * from ' + _PARTS + ' where sub < 2)')}",
    "ctl14_iterative": f"with l as (select k as topic, {_LABEL} as label from ({_confidence('probe_id % 50', '(select * from ' + r._J + ' where probe_id < 50)')})), x as (select * from {_PARTS} where sub = 0 union all select p.* from {_PARTS} p join l using (topic) where sub = 1 and label <> 'strong') "
                       f"select topic, source_id, chunk_index, place from {_PLACES.format('x')}",
    "ctl14_fan_out": f"with f as (select topic, source_id || '#' || chunk_index as key, sum(1.0::double / (60 + rank_no - 1)) as rrf from {_PARTS} where sub < 3 group by 1, 2), p as (select *, row_number() over (partition by topic order by round(rrf, 12) desc, key) as place from f) select topic, key, round(rrf, 6) as rrf, place from p where place <= 12",
    "ctl4_decisions": f"select gate1, regressed, action, count(*) as sources from {_ADDED} group by all",
    "ctl4_points": f"select collection, count(*) as points from (select collection from {r._P} where collection <> 'serials' and source_id not in (select source_id from {_ADDED} where action = 'committed') union all select collection from {r._P} where collection = 'serials' and source_id in (select source_id from {_ADDED} where action = 'committed')) group by 1",
    "snk10_progress": f"select source_id, concat_ws(chr(9), case when bool_or(status = 'failed') then 'fail' when bool_or(status = 'skipped') then 'skip' else 'ok' end, 'source=' || source_id, array_to_string(list_sort(list(distinct concat_ws('=', stage, status))), chr(9)), 'error=' || max(error)) as line from {r._M} group by source_id",
    "chk8_blank_line_index": f"with b as (select source_id, unnest(list_filter(list_transform(string_split(text, chr(10)||chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '')) as b from {_SPANS} where text is not null) select source_id, count(*) as chunks, count(*) - 1 as last from b group by 1",
    "chk8_code_index": r"with l as (select source_id, len(regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n')) as n from " + _SPANS + r" where text is not null and kind = 'Code' and length(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x85]', '', 'g')) > 0) "
                       "select source_id, sum(1 + greatest(0, ceil((n - 30) / 25.0)))::bigint as chunks, sum(1 + greatest(0, ceil((n - 30) / 25.0)))::bigint - 1 as last from l group by 1",
    "chk9_payloads": f"""select point_id, md5(case content_type when 'code' then '{{"Code":{{"file_path":"' || source_id || '"}}}}' when 'book' then '{{"Book":{{"title":"' || {_STEM} || '"' || case when chunk_index % 2 = 0 then ',"page":' || chunk_index else '' end || '}}}}'
else '{{"Paper":{{"title":"' || {_STEM} || '"' || case when chunk_index % 2 = 0 then ',"page_start":' || chunk_index || ',"page_end":' || chunk_index else '' end || '}}}}' end) as payload from {r._P} where content_type in ('book', 'paper', 'code')""",
    "agg27_nugget_recall": f"with n as (select item_id, unnest(range(least(len(keywords), 3))) as at_, keywords from (select distinct item_id, keywords from eval_items)), f as (select n.item_id, at_, coalesce(bool_or(contains(lower(text), lower(keywords[at_ + 1]))), false) as found from n left join (select * from {r._H} where text is not null) h on n.item_id = 1001 + h.probe_id % 200 group by 1, 2) select item_id, round(avg(found::int), 6) as recall from f group by 1",
    "agg20_router_accuracy": f"with b as (select probe_id, arg_max(content_type, (score::double, content_type)) as best, arg_max(content_type, (-rank_no, content_type)) as routed from {r._H} where content_type is not null group by 1) select count(*) as n, round(avg((best = routed)::int), 6) as accuracy from b",
    "fn4_replacement_rate": f"select span_id, round({_MARKS} / greatest(length(text), 1)::double, 6) as rate from {_SPANS} where text is not null",
    "fn9_letters_joined": rf"select span_id, md5(list_reduce(list_prepend(text, list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(text, '{g.LETTERS_APART}')), lambda m: {{'n': -length(m), 'm': m}})), lambda e: e.m)), lambda s, m: replace(s, m, replace(m, ' ', '')))) as joined from {_SPANS} where text is not null",
    "fn10_garbled": r"select doc_id, md5(array_to_string(list_transform(string_split(text, ' '), lambda w: case when length(w) > 3 and ('0x' || substr(md5(w), 1, 2))::int < 38 then trim(regexp_replace(w, '([^\n])', '\1 ', 'g'), ' ') else w end), ' ')) as spaced, "
                    r"md5(array_to_string(list_transform(string_split(text, ' '), lambda w: case when ('0x' || substr(md5(w), 1, 2))::int < 7 then regexp_replace(w, '\p{L}\z', chr(65533)) else w end), ' ')) as marked from documents where text is not null",
    "snk4_wrong_slots": f"select distinct point_id, concat_ws(',', case when content_type = 'code' and len(vector) > 0 and len(vector) <> {2 * DIM} then 'code' end, case when len(vector) > 0 and len(vector) <> {DIM} then 'text' end) as wrong from points",
    "snk11_collisions": f"with c as (select min(collection) as collection, count(distinct point_id) as n from {r._P} group by source_id, chunk_index) select collection, count(*) as ids, count_if(n > 1) as collisions from c group by 1",
    "agg25_pieces": f"with w as (select source_id, sum(length(text)) as whole from {_SPANS} where text is not null group by 1 having sum(length(text)) > 0), h as (select source_id, sum(length(text)) as held from (select distinct point_id, collection, source_id, chunk_index, content_type, text from points) group by 1) select source_id, round(coalesce(held, 0) / whole::double, 6) as coverage, coalesce(held, 0) / whole::double between 0.8 and 1.02 as healthy from w left join h using (source_id)",
    "fn23_statuses": "select case when status in (" + ", ".join(f"'{s}'" for s in state.STATUSES) + f") then status end as status, count(*) as n from (select distinct * from manifest) group by 1",
    "flt6_row": f"select source_id, stage, status, attempts, updated_at from {r._M} where stage = 'embed' and source_id = (select min(source_id) from manifest where stage = 'embed')",
}
