"""Queries over logs (a line for each event), rendered texts and source text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import debugging as O
from tessera.operators import sources_text as X
from tessera.plans import code_tables as C
from tessera.plans.registry import query
from tessera.plans.tables import table, values

_NODE, _PY, _ERR = O.NODE, O.PYTHON, O.ERROR
_FRAMES = rf"""l as ({C.LOG}), t as (select *, last_value(nullif(regexp_extract(text, '{_ERR}', 1), '') ignore nulls) over (partition by log order by line rows unbounded preceding) as type, regexp_matches(text, '{_NODE}') as node from l),
    fr as (select log, line, case when node then regexp_extract(text, '{_NODE}', 2) else regexp_extract(text, '{_PY}', 1) end as file, (case when node then regexp_extract(text, '{_NODE}', 3) else regexp_extract(text, '{_PY}', 2) end)::int as at,
        nullif(case when node then regexp_extract(text, '{_NODE}', 1) else regexp_extract(text, '{_PY}', 3) end, '') as symbol, type from t where node or regexp_matches(text, '{_PY}'))"""


def frames(spark, d):
    return O.stack_frames(C.relation(spark, d, C.LOG))


@query("q67_stacktrace_parse", f"with {_FRAMES} select * from fr")
def q67(spark, d):
    """The type of an error holds for the frames below it in its log."""
    return frames(spark, d)


_LOGS = "select conv_id * 3 as log, text from conversations where turn = 0"


@query("q151_fallback_tokens", f"with {_FRAMES}, b as (select log, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda x: length(x) > 2) as w from ({_LOGS}) s where log not in (select log from fr)), o as (select log, list_filter(w, lambda x, i: list_position(w, x) = i)[1:5] as w from b) select log, (unnest(range(0, len(w))))::int as place, unnest(w) as symbol from o")
def q151(spark, d):
    """First turns of conversations, but for those whose number is that of a log with frames."""
    logs = table(spark, d, "conversations").filter("turn = 0").select((F.col("conv_id") * 3).alias("log"), "text")
    return O.fallback_tokens(logs, frames(spark, d))


@query("q152_error_context", f"with l as ({C.LOG}) select log, line, substring(trim(string_agg(text, ' ') over (partition by log order by line rows between current row and 200 following)), 1, 200) as context from l")
def q152(spark, d):
    return O.error_context(C.relation(spark, d, C.LOG))


_AGES = "(select distinct file, length(file) * 7 + ascii(substring(file, 12, 1)) - 60 as days from m)"
_SCORED = f"""m as ({C.MATCHES}), {_FRAMES}, e as (select file, min_by(type, line) filter (type is not null) as type from fr group by file), q as (select symbol, count(*) as frequency from m group by symbol),
    s as (select m.id, m.file, m.symbol, case when e.type is null then 1 else {'case e.type ' + ' '.join(f"when '{k}' then {v}" for k, v in O.SEVERITY.items()) + ' else 2 end'} end as severity, case when days < 7 then 4 when days < 30 then 3 when days < 90 then 2 else 1 end as recency, frequency,
        case when similarity is null then 0 else floor(similarity * 10 + 0.5::double)::int end as bonus from m left join e on m.file = e.file left join {_AGES} a on m.file = a.file left join q on m.symbol = q.symbol),
    sc as (select *, severity + recency + frequency + bonus as score from s)"""


def scored(spark, d):
    m = C.relation(spark, d, C.MATCHES)
    ages = m.select("file").distinct().withColumn("days", F.length("file") * 7 + F.ascii(F.substring("file", 12, 1)) - 60)
    return O.match_scores(m, frames(spark, d).filter("type is not null").withColumn("ordinal", F.col("line")), ages)


@query("q68_debug_match_rank", f"with {_SCORED}, b as (select * from sc order by score desc, id limit 20) select id, file, symbol, severity, recency, frequency, bonus, score, (row_number() over (order by score desc, id))::int as rank from b")
def q68(spark, d):
    return O.ranked_matches(scored(spark, d))


@query("q153_debug_summary", f"with {_SCORED} select (select count(*) from fr) as errors, count(*) as matches, count(distinct file) as files, (select string_agg(file || ':' || id, ',' order by score desc, id) from (select * from sc order by score desc, id limit 5) b) as top from sc")
def q153(spark, d):
    return O.debug_summary(frames(spark, d), scored(spark, d))


_ADVICE = "list_filter([" + ", ".join([f"case when list_contains(types, '{t}') then '{x}' end" for t, texts in O.ADVICE.items() for x in texts] + [f"case when similar_ > 0 then '{x}' end" for x in O.SIMILAR] + [f"case when files > 5 then '{O.SPREAD}' end", f"case when best > 50 then '{O.RECENT}' end"]) + "], lambda x: x is not null)[1:5]"


@query("q154_debug_suggestions", f"with {_FRAMES}, g as (select log, list(distinct type) filter (type is not null) as types, count(distinct file) as files from fr group by log), v as (select log, max(value) as best, count(*) filter (value > 100) as similar_ from l group by log), b as (select v.log, coalesce(types, []) as types, coalesce(files, 0) as files, best, similar_ from v left join g on v.log = g.log) select log, array_to_string({_ADVICE}, '; ') as advice from b")
def q154(spark, d):
    log = C.relation(spark, d, C.LOG)
    g = frames(spark, d).groupBy("log").agg(F.collect_set("type").alias("types"), F.count_distinct("file").alias("files"))
    v = log.groupBy("log").agg(F.max("value").alias("best"), F.count_if(F.col("value") > 100).alias("similar"))
    rows = v.join(g, "log", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>"))).fillna(0, ["files"])
    return rows.select("log", F.array_join(O.suggestions(F.col("types"), F.col("similar"), F.col("files"), F.col("best")), "; ").alias("advice"))


_HEAD = O.HEADING


@query("q155_similar_chunks", rf"with s as ({C.SIMILAR}), l as (select id, unnest(string_split(text, chr(10))) as x from s) select id, regexp_extract(x, '{_HEAD}', 1) as path, round(regexp_extract(x, '{_HEAD}', 2)::double / 100, 6) as confidence from l where regexp_matches(x, '{_HEAD}')")
def q155(spark, d):
    rows = C.relation(spark, d, C.SIMILAR).select("id", F.explode(O.similar_chunks(F.col("text"))).alias("c"))
    return rows.select("id", "c.path", F.round("c.confidence", 6).alias("confidence"))


@query("q57_markdown_facts", rf"with m as ({C.MARKDOWN}), l as (select id, text, list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x), '#')) as h from m) select id, len(h)::int as headers, array_to_string(list_transform(h, lambda x: length(regexp_extract(x, '^#+'))), ',') as levels, len(regexp_extract_all(text, '```[\s\S]*?```'))::int as code_blocks, len(regexp_extract_all(text, '\[([^\]]+)\]\(([^)]+)\)'))::int as links, len(regexp_split_to_array(text, '\s+'))::int as words from l")
def q57(spark, d):
    f = T.markdown_facts(F.col("text"))
    return C.relation(spark, d, C.MARKDOWN).select("id", f.alias("f")).select("id", "f.headers", F.array_join(F.col("f.levels").cast("array<string>"), ",").alias("levels"), "f.code_blocks", "f.links", "f.words")


@query("q58_yaml_keys", "with k as (" + C.KEYED + "), l as (select id, unnest(string_split(text, chr(10))) as x from k), s as (select id, trim(split_part(x, ':', 1)) as key from l where trim(x) <> '' and not starts_with(trim(x), '#') and contains(x, ':') and not starts_with(trim(x), '-')) select id, key, count(*) as n from s where key <> '' and not contains(key, ' ') group by all")
def q58(spark, d):
    rows = C.relation(spark, d, C.KEYED).select("id", F.explode(T.yaml_keys(F.col("text"))).alias("key"))
    return rows.groupBy("id", "key").agg(F.count("*").alias("n"))


_PARAMS = "regexp_extract(signature, '\\((.*)\\)', 1)"


@query("q156_split_parameters", f"with s as ({C.SYMBOLS}) select id, array_to_string(list_transform(string_split(replace({_PARAMS}, 'Map<K, V>', 'Map@'), ','), lambda x: replace(trim(x), 'Map@', 'Map<K, V>')), ';') as parameters from s")
def q156(spark, d):
    s = C.relation(spark, d, C.SYMBOLS)
    return s.select("id", F.array_join(X.split_parameters(F.regexp_extract("signature", r"\((.*)\)", 1)), ";").alias("parameters"))


_TS = "(1, 'f(a: TSStringKeyword): TSArrayType'), (2, 'TS(Foo)'), (3, 'x: TSTypeReference'), (4, 'plain')"


@query("q157_resolve_types", f"select id, case id when 2 then replace(replace(s, 'TS(', ''), ')', '') else replace(replace(replace(s, 'TSStringKeyword', 'string'), 'TSArrayType', 'Array'), 'TSTypeReference', 'Type') end as s from (values {_TS}) t(id, s)")
def q157(spark, d):
    return values(spark, _TS, "id, s").select("id", X.resolve_types(F.col("s")).alias("s"))


@query("q158_normalised_snippets", f"with l as ({C.LINES}) select id, case when starts_with(trim(text), '//') then '' else trim(text) end as text from l")
def q158(spark, d):
    return C.relation(spark, d, C.LINES).select("id", X.normalised_snippet(F.col("text")).alias("text"))


@query("q159_embeddable_chunks", "select doc_id, substring(text, 1, 400) as content from documents where trim(text) <> ''")
def q159(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return X.embeddable(rows, 100)


def source_files(spark, d):
    """A file for each path: its lines in order, each declaration opened and closed."""
    lines = C.relation(spark, d, C.LINES)
    text = F.when(F.col("text").endswith("{"), F.concat("text", F.lit("\n  body()\n}"))).otherwise(F.col("text"))
    rows = lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", text.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return rows.withColumn("language", F.lit("typescript"))


@query("q160_structural_chunks")
def q160(spark, d):
    return X.structural_chunks(source_files(spark, d), 400, 100, 1, 20)


@query("q161_snippets")
def q161(spark, d):
    places = C.relation(spark, d, C.LINES).filter("id % 20 = 12").select("id", "path", F.lit(5).alias("line"))
    return X.snippets(places, source_files(spark, d))
