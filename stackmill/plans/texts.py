"""Queries on sources and texts: identities, paths, cleaning, signals and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackmill.functions import identity as ids
from stackmill.functions import text as t
from stackmill.functions.cleaning import clean_markdown
from stackmill.operators import chunking, expansion
from stackmill.operators.search import stub_vector
from stackmill.session import table

EXCLUDE, KEEP = ["lease", "index", "cover page", "all issues"], ["glossary", "chapter 09"]
ROOT = "/data/corpus"


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").distinct()


def spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_spans").select("span_id", "source_id", "span_index", "kind", "text", "page").distinct()


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def src2_code_paths(spark, d):
    return sources(spark, d).select("source_id", t.is_code_path(F.col("path")).alias("is_code"), t.extension(F.col("path")).alias("ext"))


def src3_text_spans(spark, d):
    return documents(spark, d).select("doc_id", F.lit("Paragraph").alias("kind"), F.lit(0).cast("bigint").alias("byte_start"), F.octet_length("text").cast("bigint").alias("byte_end"))


def src4_code_spans(spark, d):
    return spans(spark, d).where("kind = 'Code'").select("span_id", F.octet_length("text").cast("bigint").alias("bytes"), F.size(F.split("text", "\n")).cast("bigint").alias("lines"))


def id_canonical_source(spark, d):
    return sources(spark, d).select("path", ids.canonical_source_id(F.col("path"), ROOT).alias("canonical"), (ids.canonical_source_id(F.col("path"), ROOT) == F.col("source_id")).alias("same"))


def fn22_hashes(spark, d):
    h = ids.source_hash(F.col("text"))
    return documents(spark, d).select("doc_id", h.alias("source_hash"), ids.cache_key(h, ids.TEXT).alias("extract_key"), ids.cache_key(h, ids.STUB, ids.STUB.folded(ids.cache_key(h, ids.recursive_stage()))).alias("embed_key"))


def fn22_point_ids(spark, d):
    p = table(spark, d, "points").select("point_id", "source_id", "chunk_index").distinct()
    return p.select("point_id", ids.chunk_id(F.col("source_id"), F.col("chunk_index")).alias("chunk_id"), (ids.point_id(F.col("source_id"), F.col("chunk_index")) == F.col("point_id")).alias("same"))


def flt4_sections(spark, d):
    name = t.file_stem(F.col("path"))
    return sources(spark, d).select("source_id", name.alias("name"), t.section_reason(name, EXCLUDE, KEEP).alias("reason"))


def flt10_low_value_paths(spark, d):
    return sources(spark, d).select("source_id", F.col("path").rlike(t.LOW_VALUE).alias("low_value"))


def fn1_norm_tokens(spark, d):
    return sources(spark, d).select("source_id", t.norm_tokens(F.col("source_id")).alias("tokens"))


def fn2_letterspace_runs(spark, d):
    return spans(spark, d).where("text is not null").select("span_id", t.letterspace_runs(F.col("text")).cast("bigint").alias("runs"))


def fn4_text_signals(spark, d):
    x = F.col("text")
    return documents(spark, d).select("doc_id", F.round(t.alpha_ratio(x), 6).alias("alpha"), F.round(t.symbols_per_word(x), 6).alias("symbols"), F.round(t.mean_word_length(x), 6).alias("mean_word"))


def fn6_latex(spark, d):
    return documents(spark, d).select("doc_id", F.round(t.latex_imbalance(F.col("text")), 6).alias("imbalance"))


def fn7_masked(spark, d):
    return documents(spark, d).select("doc_id", F.md5(t.masked(F.col("text"))).alias("masked"))


def fn9_dehyphenated(spark, d):
    return spans(spark, d).where("text is not null").select("span_id", F.md5(t.dehyphenated(F.col("text"))).alias("joined"))


def fn11_slugs(spark, d):
    return sources(spark, d).select("source_id", t.slugify(t.file_stem(F.col("path"))).alias("slug"))


def fn12_kinds(spark, d):
    return sources(spark, d).select("source_id", t.kind_of(F.col("path")).alias("kind"), t.language_of(F.col("path")).alias("language"))


def fn14_source_tokens(spark, d):
    p = table(spark, d, "points").select("point_id", "source_id", "chunk_index").distinct()
    got = t.source_token(F.concat("source_id", F.lit("#"), "chunk_index"))
    return p.select("point_id", got["source_id"].alias("source_id"), got["chunk_index"].alias("chunk_index"), t.window_of(got["chunk_index"])["start"].alias("start"), t.window_of(got["chunk_index"])["end"].alias("end"))


def fn15_scores(spark, d):
    return table(spark, d, "hits").distinct().select("hit_id", t.parsed_score(F.coalesce("text", F.lit(""))).cast("bigint").alias("score"))


def fn17_previews(spark, d):
    return table(spark, d, "hits").distinct().select("hit_id", F.regexp_replace(F.substring("text", 1, 200), r"[\r\n]+", " ").alias("preview"))


def cln_clean_markdown(spark, d):
    return spans(spark, d).where("text is not null").select("span_id", F.md5(clean_markdown(F.col("text"))).alias("cleaned"))


def agg26_clean_idempotence(spark, d):
    once = clean_markdown(F.col("text"))
    return spans(spark, d).where("text is not null").agg(F.count_if(once != F.col("text")).alias("changed"), F.count_if(clean_markdown(once) != once).alias("unstable"),
                                                         F.sum(F.regexp_count("text", F.lit(r"[A-Za-z]-\n[a-z]"))).cast("bigint").alias("hyphen_breaks"))


def chk1_blank_line_chunks(spark, d):
    out = chunking.blank_line_chunks(table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit(0).alias("span_index"), "text").withColumn("source_id", F.col("source_id").cast("string")))
    return out.select(F.col("source_id").cast("bigint").alias("doc_id"), F.col("block").cast("bigint").alias("block"), F.md5("text").alias("chunk"))


def chk4_breadcrumbs(spark, d):
    return table(spark, d, "rcts_cases").select("case_id", "file").distinct().where("file is not null").select("case_id", t.breadcrumb(F.col("file")).alias("crumb"))


def chk5_recursive_chunks(spark, d):
    out = chunking.with_chunk_index(chunking.recursive_chunks(spans(spark, d).where("kind <> 'Code'"), 1000, 100, breadcrumbs=True))
    return out.select("source_id", "chunk_index", "page", "text")


def chk6_code_windows(spark, d):
    return chunking.code_windows(documents(spark, d), "doc_id").select("doc_id", "chunk_index", F.md5("text").alias("chunk"))


def chk9_payload_titles(spark, d):
    p = table(spark, d, "points").select("point_id", "content_type", "payload_json").distinct()
    j = F.from_json("payload_json", "Book struct<title:string>, Paper struct<title:string>, Code struct<file_path:string>")
    return p.select("point_id", F.coalesce(j["Book"]["title"], j["Paper"]["title"], j["Code"]["file_path"]).alias("title"))


def emb1_stub_vectors(spark, d):
    return documents(spark, d).select("doc_id", *[F.round(stub_vector(F.col("text"))[i], 6).alias(f"v{i}") for i in range(32)])


def agg10_garble_by_source(spark, d):
    whole = spans(spark, d).where("text is not null").groupBy("source_id").agg(F.sum(t.replacement_marks(F.col("text"))).alias("marks"), F.sum(t.letterspace_runs(F.col("text"))).alias("runs"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))
    kc = F.greatest(F.col("chars") + F.col("n") - 1, F.lit(1)) / 1000.0
    return whole.select("source_id", F.round(F.col("marks") / kc, 6).alias("ufffd_per_kc"), F.round(F.col("runs") / kc, 6).alias("letterspace_per_kc"), ((F.col("marks") + F.col("runs")) / kc > 1.0).alias("flagged"))


def agg17_prevalence(spark, d):
    x = spans(spark, d).where("text is not null")
    return x.groupBy(F.substring_index("source_id", "/", 1).alias("shelf")).agg(F.count("*").alias("spans"), F.count_if(t.replacement_marks(F.col("text")) > 0).alias("mojibake"), F.count_if(t.letterspace_runs(F.col("text")) > 0).alias("letterspaced"),
                                                                                F.round(F.sum(F.when(t.is_fragment(F.col("text")), F.length("text")).otherwise(0)) / F.sum(F.length("text")), 6).alias("fragment_chars"))


def agg18_length_stats(spark, d):
    n = F.length("text")
    return documents(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.percentile(n, F.lit(0.5)).alias("median"), F.min(n).cast("bigint").alias("least"), F.max(n).cast("bigint").alias("most"))


def agg19_repeated_lines(spark, d):
    lines = spans(spark, d).where("text is not null").select("span_id", F.explode(F.split("text", "\n")).alias("line")).select("span_id", F.trim("line").alias("line")).where("line <> ''")
    per = lines.groupBy("span_id", "line").count()
    return per.groupBy("span_id").agg(F.round(F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)) / F.sum("count"), 6).alias("repetition"))


def agg24_worst_segment(spark, d):
    parts = documents(spark, d).select("doc_id", F.explode(F.split("text", r"\n\s*\n")).alias("part")).where(F.length("part") > 200)
    return parts.groupBy("doc_id").agg(F.round(F.max(t.symbols_per_word(F.col("part"))), 6).alias("worst"), F.count("*").alias("segments"))


def agg22_worst_spans(spark, d):
    x = spans(spark, d).where("text is not null").withColumn("value", F.round(t.garble_value(F.col("text")), 6))
    return x.orderBy(F.desc("value"), "span_id").limit(8).select("span_id", "value")


def agg13_preview(spark, d):
    x = spans(spark, d).where("text is not null")
    chunks = x.select("source_id", F.explode(chunking.blank_line_blocks(F.col("text"))).alias("chunk"))
    per = chunks.groupBy("source_id").agg(F.count("*").alias("chunks"), F.round(F.avg(t.is_fragment(F.col("chunk")).cast("double")), 6).alias("fragment_rate"))
    garble = agg10_garble_by_source(spark, d).select("source_id", "flagged")
    return per.join(garble, "source_id").select("source_id", "chunks", "fragment_rate", (~F.col("flagged")).alias("gate1"))


def agg9_audit(spark, d):
    kept = sources(spark, d).select("source_id", t.section_reason(t.file_stem(F.col("path")), EXCLUDE, KEEP).alias("reason"))
    seen = kept.join(agg10_garble_by_source(spark, d).select("source_id", "flagged"), "source_id", "left")
    bucket = F.when(F.col("reason").isNotNull(), "low_value").when(F.col("flagged").isNull(), "unreadable").when(F.col("flagged"), "flagged").otherwise("clean")
    out = seen.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return out.select("bucket", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("percent"))


def exp2_deep_read(spark, d):
    h = table(spark, d, "hits").select("hit_id", "source_id", "chunk_index", F.substring("text", 1, 160).alias("probe")).distinct().where("probe is not null")
    whole = h.join(table(spark, d, "points").select("source_id", "chunk_index", "text").distinct(), ["source_id", "chunk_index"]).where(F.contains("text", "probe"))
    at = F.instr("text", F.col("probe"))
    return whole.select("hit_id", F.md5(F.substr("text", F.greatest(F.lit(1), at - 1500), F.lit(1660) + 1500)).alias("passage"))


def exp2_deep_read_source(spark, d):
    found = expansion.expanded(table(spark, d, "hits"), spans(spark, d))
    return found.select("hit_id", F.md5("passage").alias("passage"), "found")


QUERIES = {f.__name__: f for f in (
    src2_code_paths, src3_text_spans, src4_code_spans, id_canonical_source, fn22_hashes, fn22_point_ids, flt4_sections, flt10_low_value_paths, fn1_norm_tokens, fn2_letterspace_runs, fn4_text_signals, fn6_latex, fn7_masked,
    fn9_dehyphenated, fn11_slugs, fn12_kinds, fn14_source_tokens, fn15_scores, fn17_previews, cln_clean_markdown, agg26_clean_idempotence, chk1_blank_line_chunks, chk4_breadcrumbs, chk5_recursive_chunks, chk6_code_windows,
    chk9_payload_titles, emb1_stub_vectors, agg10_garble_by_source, agg17_prevalence, agg18_length_stats, agg19_repeated_lines, agg24_worst_segment, agg22_worst_spans, agg13_preview, agg9_audit, exp2_deep_read, exp2_deep_read_source)}

_SOURCES = "(select distinct source_id, source_hash, content_type, path, work_id from sources)"
_SPANS = "(select distinct span_id, source_id, span_index, kind, text, page from text_spans)"
_EXT = r"lower(regexp_extract(path, '[^/]\.([^./]*)$', 1))"
_STEM = r"regexp_replace(list_extract(string_split(path, '/'), -1), '(.)\.[^.]*$', '\1')"
_RUNS = r"""(list_reduce(list_prepend({'r': 0, 'n': 0}, list_transform(string_split_regex(trim(text, chr(32)||chr(9)||chr(10)||chr(13)), '[\s\p{Z}\x0b\x1c-\x1f\x85]+'), lambda w: {'r': case when regexp_full_match(w, '\p{L}') then 1 else 0 end, 'n': 0})),
   lambda a, b: {'r': case when b.r = 1 then a.r + 1 else 0 end, 'n': a.n + case when b.r = 1 and a.r = 3 then 1 else 0 end})).n"""
_MARKS = "(length(text) - length(replace(text, chr(65533), '')))"


def _norm(x: str) -> str:
    return rf"(case when trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) = '' then ' ' else ' ' || trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' end)"


def _reason(x: str) -> str:
    keep = " or ".join(f"contains({_norm(x)}, ' {p} ')" for p in KEEP)
    return f"case when {keep} then null " + " ".join(f"when contains({_norm(x)}, ' {p} ') then 'low-value section: {p}'" for p in EXCLUDE) + " end"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _cases(table_: dict[str, list[str]]) -> str:
    return "case " + " ".join(f"when {_EXT} in ({', '.join(repr(e) for e in exts)}) then '{n}'" for n, exts in table_.items()) + " end"


def _cleaned(x: str) -> str:
    from stackmill.functions.cleaning import CHAIN

    for pattern, to in CHAIN:
        flags = "g" + ("s" if pattern.startswith("(?s)") else "") + ("m" if pattern.startswith("(?md)") else "")
        body = pattern.replace("(?s)", "").replace("(?md)", "(?m)").replace("'", "''")
        x = f"regexp_replace({x}, '{body}', '{to.replace('$1', chr(92) + '1')}', '{flags.replace('m', '')}')" if "\n" not in to else f"regexp_replace({x}, '{body}', chr(10)||chr(10), 'g')"
    return x


_GARBLE = f"""select source_id, round(sum({_MARKS}) / (greatest(sum(length(text)) + count(*) - 1, 1) / 1000.0::double), 6) as ufffd_per_kc,
  round(sum({_RUNS}) / (greatest(sum(length(text)) + count(*) - 1, 1) / 1000.0::double), 6) as letterspace_per_kc,
  (sum({_MARKS}) + sum({_RUNS})) / (greatest(sum(length(text)) + count(*) - 1, 1) / 1000.0::double) > 1.0 as flagged from {_SPANS} where text is not null group by source_id"""
_FRAG = r"(length({0}) < 80 or regexp_matches({0}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x85]*#'))"
_SYMBOLS = r"(length(regexp_replace({0}, '[\p{{L}}\p{{N}}\s\x0b.,;:!?''\"()-]', '', 'g')) / greatest(len(regexp_extract_all({0}, '[^\s\x0b]+')), 1)::double)"

SQL = {
    "src2_code_paths": f"select source_id, not list_has_any(string_split(path, '/'), {_list(t.SKIPPED_FOLDERS)}) and list_contains({_list(t.CODE_EXTENSIONS)}, {_EXT}) as is_code, {_EXT} as ext from {_SOURCES}",
    "src3_text_spans": "select doc_id, 'Paragraph' as kind, 0::bigint as byte_start, strlen(text)::bigint as byte_end from documents",
    "src4_code_spans": f"select span_id, strlen(text)::bigint as bytes, len(string_split(text, chr(10)))::bigint as lines from {_SPANS} where kind = 'Code'",
    "id_canonical_source": f"select path, case when starts_with(path, '{ROOT}/') then substr(path, {len(ROOT) + 2}) end as canonical, case when starts_with(path, '{ROOT}/') then substr(path, {len(ROOT) + 2}) end = source_id as same from {_SOURCES}",
    "fn22_hashes": "with h as (select doc_id, sha256(text) as s from documents), k as (select *, sha256(s || chr(31) || 'chunker-recursive' || chr(31) || '0.1.0' || chr(31) || 'chunk_size=2000;overlap=200') as c from h) "
                   "select doc_id, s as source_hash, sha256(s || chr(31) || 'extractor-text' || chr(31) || '0.1.0' || chr(31) || 'default') as extract_key, sha256(s || chr(31) || 'embedder-stub' || chr(31) || '0.1.0' || chr(31) || 'dim=32;chunks=' || c) as embed_key from k",
    "fn22_point_ids": "select distinct point_id, source_id || '#' || chunk_index as chunk_id, true as same from points",
    "flt4_sections": f"select source_id, {_STEM} as name, {_reason(_STEM)} as reason from {_SOURCES}",
    "flt10_low_value_paths": f"select source_id, regexp_matches(path, '{t.LOW_VALUE}') as low_value from {_SOURCES}",
    "fn1_norm_tokens": f"select source_id, {_norm('source_id')} as tokens from {_SOURCES}",
    "fn2_letterspace_runs": f"select span_id, ({_RUNS})::bigint as runs from {_SPANS} where text is not null",
    "fn4_text_signals": r"select doc_id, round(case when length(text) = 0 then 0.0 else length(regexp_replace(text, '\P{L}', '', 'g')) / length(text)::double end, 6) as alpha, round(" + _SYMBOLS.format("text") + r", 6) as symbols, "
                        r"round(coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z]{2,}'), lambda w: length(w)))::double / nullif(len(regexp_extract_all(text, '[A-Za-z]{2,}')), 0), 0.0), 6) as mean_word from documents",
    "fn6_latex": "with c as (select doc_id, (length(text) - length(replace(text, '$$', ''))) / 2 as dd, length(text) - length(replace(text, '$', '')) as s, length(text) - length(replace(text, '{', '')) as o, length(text) - length(replace(text, '}', '')) as x from documents) "
                 "select doc_id, round(dd % 2 + abs(s - 2 * dd) % 2 + coalesce(abs(o - x) / nullif(o + x, 0)::double, 0.0), 6) as imbalance from c",
    "fn7_masked": r"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```.*?```', ' ', 'gs'), '\$\$.*?\$\$', ' ', 'gs'), '\$[^$\n]+\$', ' ', 'g'), '(?m)^\s*\|.*\|\s*$', ' ', 'g')) as masked from documents",
    "fn9_dehyphenated": rf"select span_id, md5(regexp_replace(text, '([A-Za-z])-\n([a-z])', '\1\2', 'g')) as joined from {_SPANS} where text is not null",
    "fn11_slugs": f"select source_id, regexp_replace(regexp_replace(lower({_STEM}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from {_SOURCES}",
    "fn12_kinds": f"select source_id, {_cases(t.KINDS)} as kind, {_cases(t.LANGUAGES)} as language from {_SOURCES}",
    "fn14_source_tokens": 'select distinct point_id, source_id, chunk_index, greatest(chunk_index - 2, 0)::bigint as start, (chunk_index + 3)::bigint as "end" from points',
    "fn15_scores": "select hit_id, coalesce(nullif(regexp_extract(coalesce(text, ''), '[012]', 0), ''), '0')::bigint as score from (select distinct hit_id, text from hits)",
    "fn17_previews": r"select hit_id, regexp_replace(substr(text, 1, 200), '[\r\n]+', ' ', 'g') as preview from (select distinct hit_id, text from hits)",
    "cln_clean_markdown": f"select span_id, md5({_cleaned('text')}) as cleaned from {_SPANS} where text is not null",
    "agg26_clean_idempotence": f"with c as (select text, {_cleaned('text')} as once from {_SPANS} where text is not null) select count_if(once <> text) as changed, count_if({_cleaned('once')} <> once) as unstable, "
                               r"sum(len(regexp_extract_all(text, '[A-Za-z]-\n[a-z]')))::bigint as hyphen_breaks from c",
    "chk1_blank_line_chunks": r"with b as (select doc_id, list_filter(list_transform(string_split(text, chr(10)||chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}\x0b\x1c-\x1f\x85]+|[\s\p{Z}\x0b\x1c-\x1f\x85]+$', '', 'g')), lambda x: x <> '') as bs from documents) "
                              "select doc_id, unnest(range(0, len(bs)))::bigint as block, md5(unnest(bs)) as chunk from b",
    "chk4_breadcrumbs": r"with f as (select distinct case_id, file, string_split(regexp_replace(file, '\.md$', ''), '__') as p from rcts_cases where file is not null) "
                        r"select case_id, regexp_replace(case when len(p) > 1 then (case when contains(p[1], '_') then regexp_replace(p[1], '^[^_]*_', '') else p[1] end) || ' > ' || p[2] else (case when contains(p[1], '_') then regexp_replace(p[1], '^[^_]*_', '') else p[1] end) end, '^[ >]+|[ >]+$', '', 'g') as crumb from f",
    "chk6_code_windows": r"with l as (select doc_id, regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n') as ls from documents where length(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x85]', '', 'g')) > 0), "
                         "w as (select doc_id, ls, unnest(range(0, 1 + greatest(0, ceil((len(ls) - 30) / 25.0)::int)))::bigint as chunk_index from l) select doc_id, chunk_index, md5(array_to_string(list_slice(ls, chunk_index * 25 + 1, chunk_index * 25 + 30), chr(10))) as chunk from w",
    "chk9_payload_titles": "select distinct point_id, coalesce(json_extract_string(payload_json, '$.Book.title'), json_extract_string(payload_json, '$.Paper.title'), json_extract_string(payload_json, '$.Code.file_path')) as title from points",
    "emb1_stub_vectors": "with h as (select doc_id, sha256(text) as h from documents) select doc_id, " + ", ".join(
        f"round(((strpos('0123456789abcdef', substr(h, {2 * i + 1}, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, {2 * i + 2}, 1)) - 1) / 127.5::double - 1.0::double, 6) as v{i}" for i in range(32)) + " from h",
    "agg10_garble_by_source": _GARBLE,
    "agg17_prevalence": f"select split_part(source_id, '/', 1) as shelf, count(*) as spans, count_if({_MARKS} > 0) as mojibake, count_if({_RUNS} > 0) as letterspaced, round(sum(case when {_FRAG.format('text')} then length(text) else 0 end)::double / sum(length(text)), 6) as fragment_chars from {_SPANS} where text is not null group by 1",
    "agg18_length_stats": "select source, count(*) as n, quantile_cont(length(text), 0.5)::double as median, min(length(text))::bigint as least, max(length(text))::bigint as most from documents group by source",
    "agg19_repeated_lines": f"with l as (select span_id, trim(unnest(string_split(text, chr(10))), ' ') as line from {_SPANS} where text is not null), p as (select span_id, line, count(*) as n from l where line <> '' group by 1, 2) "
                            "select span_id, round(sum(case when n > 1 then n else 0 end)::double / sum(n), 6) as repetition from p group by span_id",
    "agg24_worst_segment": r"with s as (select doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) as part from documents) select doc_id, round(max(" + _SYMBOLS.format("part") + "), 6) as worst, count(*) as segments from s where length(part) > 200 group by doc_id",
    "agg22_worst_spans": f"select span_id, round({_MARKS} * 1000.0::double / greatest(length(text), 1) + {_RUNS} * 1000.0::double / greatest(length(text), 1), 6) as value from {_SPANS} where text is not null order by value desc, span_id limit 8",
    "agg13_preview": rf"with c as (select source_id, unnest(list_filter(list_transform(string_split(text, chr(10)||chr(10)), lambda x: regexp_replace(x, '^[\s\p{{Z}}\x0b\x1c-\x1f\x85]+|[\s\p{{Z}}\x0b\x1c-\x1f\x85]+$', '', 'g')), lambda x: x <> '')) as chunk from {_SPANS} where text is not null), g as ({_GARBLE}) "
                     f"select c.source_id, count(*) as chunks, round(avg(case when {_FRAG.format('chunk')} then 1.0 else 0.0 end), 6) as fragment_rate, not any_value(flagged) as gate1 from c join g using (source_id) group by c.source_id",
    "agg9_audit": f"with k as (select source_id, {_reason(_STEM)} as reason from {_SOURCES}), g as ({_GARBLE}), b as (select case when reason is not null then 'low_value' when flagged is null then 'unreadable' when flagged then 'flagged' else 'clean' end as bucket from k left join g using (source_id)) "
                  "select bucket, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as percent from b group by bucket",
    "exp2_deep_read": "with h as (select distinct hit_id, source_id, chunk_index, substr(text, 1, 160) as probe from hits where text is not null), p as (select distinct source_id, chunk_index, text from points), "
                      "w as (select hit_id, p.text, strpos(p.text, probe) as place from h join p using (source_id, chunk_index) where contains(p.text, probe)) select hit_id, md5(substr(text, greatest(1, place - 1500), 3160)) as passage from w",
}
