"""Queries over symbols (one for each part): importance, inclusion, scores, duplicates, summaries, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import compaction as O
from tessera.operators import symbols as S
from tessera.plans import code_tables as C
from tessera.plans.registry import query
from tessera.plans.tables import table

_HAS = lambda c, parts: "(" + " or ".join(f"contains({c}, '{p}')" for p in parts) + ")"
_LOCAL = f"({_HAS('lower(name)', S.LOCAL)} or (length(name) <= 3 and lower(name) not in ({', '.join(repr(x) for x in S.SHORT)})) or regexp_matches(name, '[0-9]+$') or ends_with(lower(name), 'str') or ends_with(lower(name), 'obj'))"
_LINES = "case when coalesce(body, '') <> '' then len(string_split(body, chr(10))) end"
_IMPORTANCE = f"""greatest(0, case kind {' '.join(f"when '{k}' then {v}" for k, v in S.BASE.items())} else 0 end - case when kind = 'variable' and {_LOCAL} then 25 else 0 end + case when exported then 30 else 0 end
    + case when {_HAS('lower(name)', S.CENTRAL)} then 25 else 0 end + case when lower(name) in ('index', 'main', 'app', 'server') then 20 else 0 end + case when length(coalesce(doc, '')) > 10 then 10 else 0 end
    + case when is_async then 8 else 0 end + least(parameters * 2, 10) + least(relations * 3, 15) - case when {_LINES} < 2 then 5 when {_LINES} > 50 then 10 else 0 end
    - case when {_HAS('lower(name)', ('test', 'spec', 'mock'))} then 20 else 0 end - case when starts_with(name, '_') or {_HAS('lower(name)', ('internal', 'private'))} then 10 else 0 end)"""
_ONCE = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_METHODS = _ONCE(r"regexp_extract_all(body, '(?:public|private|protected)?\s*(?:static)?\s*([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\(', 1)")
_CUT = lambda n, note: f"array_to_string(string_split(body, chr(10))[1:{n}], chr(10)) || chr(10) || '{note}'"
_COMPACT = f"""case when coalesce(body, '') = '' then null when kind = 'function' and len(string_split(body, chr(10))) <= 5 then body when kind = 'function' then {_CUT(5, '  // ... (truncated)')}
    when kind = 'class' and len({_METHODS}) > 0 then 'Methods: ' || array_to_string({_METHODS}, ', ') when len(string_split(body, chr(10))) > 10 then {_CUT(5, '// ... (truncated)')} else body end"""
_S = f"s0 as ({C.SYMBOLS}), s as (select *, {_IMPORTANCE} as importance, {_COMPACT} as cbody from s0)"
_WORDS = lambda c: f"case when coalesce({c}, '') = '' then 0 else len(regexp_split_to_array({c}, '\\s+')) end"
_TOKENS = f"{_WORDS('signature')} + {_WORDS('doc')} + {_WORDS('cbody')} + 10"


def symbols(spark: SparkSession, d: str) -> DataFrame:
    rows = C.relation(spark, d, C.SYMBOLS)
    lines = F.when(F.coalesce("body", F.lit("")) != "", F.size(F.split("body", "\n")))
    c = F.col
    return rows.withColumn("importance", S.importance(c("kind"), c("name"), c("exported"), F.length(F.coalesce("doc", F.lit(""))) > 10, c("is_async"), c("parameters"), c("relations"), lines))


@query("q95_symbol_importance", f"with {_S} select id, importance from s")
def q95(spark, d):
    return symbols(spark, d).select("id", "importance")


_INCLUDED = f"""case when kind = 'variable' and {_LOCAL} then false when importance >= 30 then true when exported then true when length(coalesce(doc, '')) > 20 then true when importance >= 20 then true when importance < 8 then false
    when {_HAS('lower(name)', ('test', 'spec'))} or {_HAS('lower(file)', ('test', 'spec'))} then false else true end"""


@query("q113_symbol_inclusion", f"with {_S} select id, {_LOCAL} as local, {_INCLUDED} as included from s")
def q113(spark, d):
    return symbols(spark, d).select("id", S.likely_local(F.col("name")).alias("local"), O.included(F.col("importance")).alias("included"))


@query("q114_compact_body", f"with {_S} select id, cbody as body, {_TOKENS} as tokens from s")
def q114(spark, d):
    body = O.compact_body()
    return symbols(spark, d).select("id", body.alias("body"), O.symbol_tokens(body).alias("tokens"))


_CALLS = _ONCE(f"list_filter(regexp_extract_all(body, '([a-zA-Z_$][a-zA-Z0-9_$]*)\\s*\\(', 1), lambda x: x not in ({', '.join(map(repr, O.NO_CALLS))}))")
_TYPES = _ONCE(f"list_filter(regexp_extract_all(signature, '\\b([A-Z][a-zA-Z0-9_]*)\\b', 1), lambda x: x not in ({', '.join(map(repr, O.NO_TYPES))}))")


@query("q115_calls_types_methods", f"with {_S} select id, array_to_string({_CALLS}, ',') as calls, array_to_string({_TYPES}, ',') as types, array_to_string({_METHODS}, ',') as methods from s where body is not null")
def q115(spark, d):
    join = lambda c, n: F.array_join(c, ",").alias(n)
    return symbols(spark, d).filter("body is not null").select("id", join(O.function_calls(F.col("body")), "calls"), join(O.type_references(F.col("signature")), "types"), join(O.method_names(F.col("body")), "methods"))


_SHORT = r"regexp_replace(signature, '<[^<>]*(<[^<>]*>)*[^<>]*>', '<T>', 'g')"
_CLEAN = r"regexp_replace(regexp_replace(trim(regexp_replace(signature, '\s+', ' ', 'g')), '<[^>]*>', '<T>', 'g'), '\|\s*\w+(\s*\|\s*\w+)*', '| ...', 'g')"


@query(
    "q116_signature_forms",
    rf"""with {_S}, a as (select id, signature, {_CLEAN} as clean, {_SHORT} as x from s), b as (select *, regexp_extract(x, '\((.*)\)', 1, 's') as inner_ from a),
        c as (select *, case when length(inner_) > 100 then regexp_extract(x, '^([^(]*\().*\)', 1, 's') || (length(inner_) - length(replace(inner_, ',', '')) + 1) || ' params' || regexp_extract(x, '(\)[^)]*)$', 1, 's') else x end as y from b)
        select id, clean, case when length(y) > 150 then substring(y, 1, 147) || '...' else y end as short from c""",
)
def q116(spark, d):
    return symbols(spark, d).select("id", O.clean_signature(F.col("signature")).alias("clean"), O.shorten_signature(F.col("signature")).alias("short"))


def _normal(c: str) -> str:
    """Keywords are set aside, names replaced, keywords put back."""
    for k, word in enumerate(O.KEYWORDS):
        c = rf"regexp_replace({c}, '\b{word}\b', '@{k}@', 'g')"
    c = f"regexp_replace({c}, '[a-zA-Z_$][a-zA-Z0-9_$]*', 'VAR', 'g')"
    for k, word in enumerate(O.KEYWORDS):
        c = f"replace({c}, '@{k}@', '{word}')"
    return f"trim({c})"


_NORMAL = _normal(r"regexp_replace(signature, '\s+', ' ', 'g')")
_HASHED = f"{_S}, h as (select *, sha256(kind || '|' || signature || '|' || coalesce(body, '') || '|' || coalesce(doc, ''))[1:16] as ch, sha256({_NORMAL})[1:16] as sh from s)"


@query("q117_normalised_signature", f"with {_HASHED} select id, {_NORMAL} as normal, ch as content_hash, sh as signature_hash from h")
def q117(spark, d):
    return O.with_hashes(symbols(spark, d)).select("id", O.normalised_signature(F.col("signature")).alias("normal"), "content_hash", "signature_hash")


def _duplicates(by: str) -> str:
    order = "order by exported desc, importance desc, id"
    return f"""with {_HASHED}, c as (select *, first_value(id) over (partition by {by}ch {order}) as k1, count(*) over (partition by {by}ch) as n1 from h),
        m as (select *, n1 > 1 and k1 <> id as marked from c), g as (select *, first_value(id) over (partition by {by}sh {order}) as k2, count(*) over (partition by {by}sh) as n2, bool_or(marked) over (partition by {by}sh) as any_ from m)
        select id, case when marked then k1 when not any_ and n2 > 1 and k2 <> id then k2 end as duplicate_of, case when marked then 'content' when not any_ and n2 > 1 and k2 <> id then 'signature' end as pass from g"""


@query("q118_two_pass_dedup", _duplicates(""))
def q118(spark, d):
    return O.mark_duplicates(O.with_hashes(symbols(spark, d))).select("id", "duplicate_of", "pass")


@query("q119_dedup_within_file", _duplicates("file, "))
def q119(spark, d):
    return O.mark_duplicates(O.with_hashes(symbols(spark, d)), ["file"]).select("id", "duplicate_of", "pass")


@query(
    "q38_symbol_similarity",
    rf"""with {_HASHED}, p as (select a.id as a, b.id as b, a.ch = b.ch as c, a.sh = b.sh as sg, a.kind = b.kind as k, a.name = b.name as n, regexp_split_to_array(a.signature, '\W+') as x, regexp_split_to_array(b.signature, '\W+') as y from h a join h b on a.id % 50 = 0 and a.id <> b.id),
        v as (select a, b, round(case when c then 1.0::double when sg then 0.9::double else case when k then 0.3::double else 0 end + case when n then 0.3::double else 0 end + len(list_filter(x, lambda w: list_contains(y, w))) / greatest(len(x), len(y)) * 0.4::double end, 6) as similarity from p)
        select * from v where similarity >= 0.8""",
)
def q38(spark, d):
    """The symbols whose id 50 divides, against all others."""
    rows = O.with_hashes(symbols(spark, d))
    return O.similar_symbols(rows.filter("id % 50 = 0"), rows, 0.8)


def _rules(rules, other):
    return "case " + " ".join(f"when {_HAS('lower(name)', parts)} then '{text}'" for parts, text in rules) + f" {other} end"


_PURPOSE = f"""case when kind = 'function' then {_rules(O.PURPOSES['function'], "when contains(lower(signature), 'async') or contains(lower(name), 'async') then 'Asynchronous operation function' when contains(lower(coalesce(doc, '')), 'test') or contains(lower(name), 'test') then 'Test function' else 'Utility function'")}
    when kind = 'class' then {_rules(O.PURPOSES['class'], "else 'Business logic class'")} when kind in ('interface', 'type') then {_rules(O.PURPOSES['type'], "else 'Type definition'")}
    when kind = 'variable' then case when {_HAS('lower(name)', ('config', 'setting'))} then 'Configuration variable' when contains(lower(name), 'constant') or upper(name) = name then 'Constant value' when {_HAS('lower(name)', ('cache', 'store'))} then 'Storage variable' else 'State variable' end
    else kind || ' definition' end"""
_COMMAS = "length(signature) - length(replace(signature, ',', ''))"
_LEVEL = f"""(case when contains(signature, '(') then least(({_COMMAS} + 1) * 2, 10) else 0 end + least(relations * 3, 15) + case when coalesce(cbody, '') = '' then 0 else least(len(string_split(cbody, chr(10))), 20) end
    + case kind when 'class' then 10 when 'interface' then 5 else 0 end + case when contains(signature, 'async') then 5 else 0 end)"""
_COMPLEX = f"case when {_LEVEL} < 10 then 'low' when {_LEVEL} < 25 then 'medium' else 'high' end"
_TAG = lambda c, p, t: f"case when contains(lower({c}), '{p}') then '{t}' end"
_TAGS = _ONCE(f"list_filter([kind, case when exported then 'exported' end, {_COMPLEX}, " + ", ".join([*[_TAG("name", p, t) for p, t in (("async", "async"), ("test", "test"), ("handler", "handler"), ("util", "utility"), ("api", "api"), ("component", "component"))], *[_TAG("signature", x, x) for x in ("react", "express", "fastify")]]) + "], lambda x: x is not null)")


@query("q120_symbol_summary", f"with {_S} select id, {_PURPOSE} as purpose, {_COMPLEX} as complexity, array_to_string({_TAGS}, ',') as tags, string_split(file, '/')[-1] || ' → ' || name || case when kind in ('function', 'variable') then '' else ' → (' || kind || ')' end as breadcrumb from s")
def q120(spark, d):
    body = O.compact_body()
    return symbols(spark, d).select("id", O.purpose().alias("purpose"), O.complexity(body).alias("complexity"), F.array_join(O.tags(body), ",").alias("tags"), O.breadcrumb().alias("breadcrumb"))


_FILE_RULES = " ".join(f"when {_HAS('base', parts)} then '{text}'" for parts, text in O.FILE_PURPOSES)
_FILES = f"""{_S}, f as (select file, string_split(file, '/')[-1] as base, count(*) as symbols, count(*) filter (kind = 'function') as fn, count(*) filter (kind = 'class') as cl, count(*) filter (kind = 'interface') as it,
        bool_or(contains(name, 'Component')) as c1, bool_or(contains(name, 'Service')) as c2, bool_or(contains(name, 'Controller')) as c3, count(*) * 2 + sum(relations) + avg(importance) as score from s group by file),
    w as (select file, symbols, case {_FILE_RULES} when cl > fn then 'Class definitions' when it > 0 and fn = 0 then 'Type/interface definitions' when fn > 0 and cl = 0 then 'Utility functions' else 'Mixed functionality module' end as purpose,
        case when cl > 0 and fn = 0 then 'Object-oriented' when fn > 0 and cl = 0 then 'Functional' when c1 then 'Component-based' when c2 then 'Service-oriented' when c3 then 'MVC pattern' else 'Mixed paradigm' end as pattern,
        round(score, 6) as score, case when score < 20 then 'low' when score < 50 then 'medium' else 'high' end as complexity from f)"""


@query("q33_file_complexity", f"with {_FILES} select * from w")
def q33(spark, d):
    return O.file_summaries(symbols(spark, d))


@query(
    "q32_project_architecture_mode",
    f"with {_FILES}, t as (select count(distinct file) as files, count(*) as symbols, sum({_TOKENS})::bigint as tokens from s) select (select pattern from w group by pattern order by count(*) desc, pattern limit 1) as architecture, files, symbols, tokens, round(tokens / (tokens * 3), 6) as compression from t",
)
def q32(spark, d):
    return O.project_summary(symbols(spark, d), O.symbol_tokens(O.compact_body())).select("architecture", "files", "symbols", "tokens", "compression")


_Q = "create widget"
_QW = "['create', 'widget']"
_MATCH = f"""case when lower(name) = '{_Q}' then 1.0::double else greatest(
    case when contains(lower(name), '{_Q}') then 0.8::double else 0 end, case when contains('{_Q}', lower(name)) and length(name) > 3 then 0.7::double else 0 end, case when contains(lower(signature), '{_Q}') then 0.6::double else 0 end,
    case when contains(lower(coalesce(doc, '')), '{_Q}') then 0.5::double else 0 end, case when contains(lower(coalesce(cbody, '')), '{_Q}') then 0.4::double else 0 end,
    (greatest(length(name), {len(_Q)}) - levenshtein(lower(name), '{_Q}')) / greatest(length(name), {len(_Q)}) * 0.6::double,
    len(list_filter({_QW}, lambda w: len(list_filter(regexp_split_to_array(lower(name) || ' ' || lower(signature), '\\W+'), lambda x: length(x) > 2 and (contains(x, w) or contains(w, x)))) > 0)) / 2 * 0.5::double) end"""


@query("q40_query_match_levenshtein", f"with {_S} select id, round({_MATCH}, 6) as score from s")
def q40(spark, d):
    return symbols(spark, d).select("id", F.round(S.query_match(F.col("name"), F.col("signature"), _Q, F.col("doc"), O.compact_body()), 6).alias("score"))


_NAMED = lambda *parts: _HAS("lower(name)", parts)
_TASK = {
    "debug": f"case when {_NAMED('error', 'log', 'debug', 'validate', 'check')} then 0.9 when {_HAS('lower(signature)', ('try', 'catch', 'throw'))} then 0.8 when kind = 'function' and contains(coalesce(cbody, ''), 'console') then 0.7 else 0.3 end",
    "implement": f"case when kind = 'function' and exported and not contains(coalesce(doc, ''), '@deprecated') then 0.9 when kind in ('interface', 'type') then 0.85 when {_NAMED('create', 'build', 'make', 'setup')} then 0.8 when kind = 'class' and exported then 0.75 when {_NAMED('handler', 'processor', 'manager')} then 0.7 when exported and kind <> 'variable' then 0.65 when kind = 'function' and not starts_with(name, '_') then 0.6 else 0.3 end",
    "understand": f"case when length(coalesce(doc, '')) > 50 then 0.95 when kind in ('interface', 'type') then 0.9 when kind = 'class' and doc is not null then 0.9 when exported and relations > 3 then 0.85 when {_NAMED('main', 'index', 'init', 'config')} then 0.8 when exported then 0.75 when kind = 'class' then 0.7 when relations > 2 then 0.6 else 0.4 end",
    "refactor": "case when relations > 5 then 0.9 when kind = 'class' and contains(coalesce(cbody, ''), 'Methods:') then 0.8 when kind = 'function' and len(string_split(coalesce(cbody, ''), chr(10))) > 10 then 0.7 else 0.4 end",
    "test": f"case when {_NAMED('test', 'spec')} then 0.9 when kind = 'function' and not starts_with(name, '_') then 0.8 when kind = 'class' then 0.7 else 0.3 end",
    "document": "case when exported and doc is null then 0.9 when kind in ('class', 'interface') then 0.8 when relations > 3 then 0.7 else 0.4 end",
}


@query("q121_task_relevance", f"with {_S} select id, " + ", ".join(f"({sql})::double as {t}" for t, sql in _TASK.items()) + " from s")
def q121(spark, d):
    body = O.compact_body()
    return symbols(spark, d).select("id", *[O.task_relevance(t, body).cast("double").alias(t) for t in _TASK])


_QUALITY_N = f"(relations + case when coalesce(cbody, '') = '' then 0 else len(string_split(cbody, chr(10))) end + {_COMMAS} + 1)"
_QUALITY = f"""least(100.0::double, 15 * (case when {_QUALITY_N} < 3 then 0.3 when {_QUALITY_N} < 10 then 1.0 when {_QUALITY_N} < 20 then 0.8 when {_QUALITY_N} < 40 then 0.5 else 0.2 end)::double
    + 10 * least(1.0::double, 0.5::double + (case when length(name) between 3 and 30 then 0.2 else 0 end)::double + (case when regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') or regexp_matches(name, '^[a-z][a-z0-9_]*$') then 0.2 else 0 end)::double + (case when {_HAS('lower(name)', O.VERBS)} then 0.1 else 0 end)::double)
    + case when kind in ('interface', 'type') then 10 else 0 end + case when {_HAS('signature', ('async', 'Promise'))} then 8 else 0 end + case when {_HAS('lower(signature)', ('error', 'exception'))} or {_HAS("lower(coalesce(cbody, ''))", ('try', 'catch', 'throw', 'error'))} then 5 else 0 end + 20)"""


@query("q122_quality_score", f"with {_S} select id, round({_QUALITY}, 6) as quality from s")
def q122(spark, d):
    return symbols(spark, d).select("id", F.round(O.quality_score(O.compact_body()), 6).alias("quality"))


_CONTEXT_FILES, _CONTEXT_NAMES = ["src/core/brand1.ts", "src/api/brand7.js"], ["createRedwidget", "widget"]


def _file_context() -> str:
    parts = []
    for f in _CONTEXT_FILES:
        parts.append(f"when contains(lower(file), '{f}') or contains('{f}', lower(file)) then 1.0 when regexp_extract(lower(file), '^(.*)/[^/]*$', 1) = '{f.rsplit('/', 1)[0]}' then 0.8")
    return "(case " + " ".join(parts) + " else 0 end)::double"


_SYMBOL_CONTEXT = "greatest(" + ", ".join(f"(case when lower(name) = '{n.lower()}' then 1.0 when contains(lower(signature), '{n.lower()}') then 0.6 else 0 end)::double" for n in _CONTEXT_NAMES) + ", 0.0::double)"
_USE = f"""u as (select id, target, file_id from ({C.USES}) x), fl as (select distinct id, file from s0), x as (select distinct u.target as id, f.file from u join fl f on u.id = f.id), n as (select x.id, count(*) as n from x join s0 on x.id = s0.id where x.file <> s0.file group by x.id),
    a as (select s0.id, round(least(1.0::double, coalesce(n.n, 0) / (select count(distinct file) from s0)), 6) as across from s0 left join n on s0.id = n.id)"""


def _across(spark, d):
    rows = symbols(spark, d)
    files = rows.agg(F.count_distinct("file")).first()[0]
    own = rows.select("id", "file")
    uses = C.relation(spark, d, C.USES).select(F.col("id").alias("by"), "target").distinct()
    used = uses.join(own.withColumnRenamed("id", "by"), "by").select(F.col("target").alias("id"), "file")
    return rows, O.cross_file_use(own, used, files)


@query("q123_cross_file_importance", f"with {_S}, {_USE} select * from a")
def q123(spark, d):
    """The share of files whose symbols use a symbol."""
    return _across(spark, d)[1]


_CONTEXT = f"least(100.0::double, {_file_context()} * 25 + {_SYMBOL_CONTEXT} * 20 + least(relations * 3, 15) + across * 10)"


@query("q124_context_score", f"with {_S}, {_USE} select s.id, round({_CONTEXT.replace('relations', 's.relations')}, 6) as context from s join a on s.id = a.id")
def q124(spark, d):
    rows, across = _across(spark, d)
    return rows.join(across, "id").select("id", F.round(O.context_score(_CONTEXT_FILES, _CONTEXT_NAMES, F.col("across")), 6).alias("context"))


def _relevance(task: str) -> str:
    return f"least(100.0::double, ({_MATCH}) * 30 + ({_TASK[task]})::double * 20 + case when exported then 10 else 0 end + case when length(coalesce(doc, '')) > 20 then 8 else 0 end + case when kind in ('class') then 15 else 0 end)"


@query("q125_relevance_score", f"with {_S} select id, round({_relevance('implement')}, 6) as relevance from s")
def q125(spark, d):
    return symbols(spark, d).select("id", F.round(O.relevance_score("implement", _Q, O.compact_body(), ("class",)), 6).alias("relevance"))


_PLAIN = _relevance("implement").replace(" + case when kind in ('class') then 15 else 0 end", "")
_SCORED = f"{_S}, {_USE}, r as (select s.*, {_TOKENS} as tokens, round({_PLAIN} * 0.45::double + {_CONTEXT} * 0.25::double + {_QUALITY} * 0.15::double + importance * 0.15::double, 6) as score from s join (select id as aid, across from a) b on s.id = b.aid)"


def _scored(spark, d):
    rows, across = _across(spark, d)
    return O.score_symbols(rows.join(across, "id"), "implement", _Q, _CONTEXT_FILES, _CONTEXT_NAMES, F.col("across"))


@query("q39_relevance_score", f"with {_SCORED} select id, score, tokens from r")
def q39(spark, d):
    """Relevance, context, quality and importance, weighted for the task "implement"."""
    return _scored(spark, d).select("id", "score", "tokens")


@query("q126_filtered_result", f"with {_SCORED} select count(*) as symbols, sum(tokens)::bigint as tokens, count(distinct file) as files, round(avg(score), 6) as mean_score, (select string_agg(kind, ',' order by n desc, kind) from (select kind, count(*) as n from r group by kind order by n desc, kind limit 5)) as top_kinds from r")
def q126(spark, d):
    return O.filtered_result(_scored(spark, d))


@query(
    "q127_prompt_context",
    rf"""with {_SCORED}, p as (select *, row_number() over (partition by file order by score desc, id) as place from r), t as (select *, 2 + {_WORDS("name || ' (' || kind || ')'")} - 1 + {_WORDS('signature')} as words from p where place <= 5),
        f as (select file, sum(words) + 2 as own from t group by file), g as (select file, coalesce(sum(own) over (order by file rows between unbounded preceding and 1 preceding), 0) as start from f),
        w as (select t.file, id, words as tokens, start + 2 + coalesce(sum(words) over (partition by t.file order by place rows between unbounded preceding and 1 preceding), 0) as before from t join g on t.file = g.file where start <= 3200)
        select file, id, tokens, before::bigint as before from w where before <= 4000""",
)
def q127(spark, d):
    return O.prompt_context(_scored(spark, d))


@query("q128_related_symbols", f"with {_S}, e as (select distinct id, target from ({C.USES}) x), t as (select id as start, file from s where id % 50 = 0), r as (select start, target as id from t join e on t.start = e.id union select start, e.id from t join e on t.start = e.target union select start, s.id from t join s on t.file = s.file) select r.start, r.id from r join s on r.id = s.id where r.start <> r.id")
def q128(spark, d):
    rows = symbols(spark, d)
    edges = C.relation(spark, d, C.USES).select("id", "target").distinct()
    return O.related_symbols(rows.filter("id % 50 = 0"), rows, edges)


@query(
    "q129_compaction",
    f"""with {_HASHED}, k as (select * from h where {_INCLUDED}), c as (select *, first_value(id) over (partition by ch order by exported desc, importance desc, id) as k1, count(*) over (partition by ch) as n1 from k),
        m as (select *, n1 > 1 and k1 <> id as marked from c), g as (select *, first_value(id) over (partition by sh order by exported desc, importance desc, id) as k2, count(*) over (partition by sh) as n2, bool_or(marked) over (partition by sh) as any_ from m),
        o as (select *, {_TOKENS} as tokens, round({_relevance('understand').replace(" + case when kind in ('class') then 15 else 0 end", "")} * 0.3::double + least(relations * 3, 15) * 0.35::double + {_QUALITY} * 0.25::double + importance * 0.1::double, 6) as score from g where not (marked or (not any_ and n2 > 1 and k2 <> id))),
        t as (select id, file, name, score, tokens, sum(tokens) over (order by score desc, id rows unbounded preceding) as total from o)
        select id, file, name, score, tokens, total::bigint as total from t where total <= 2000""",
)
def q129(spark, d):
    """Included symbols, each once, by their score for the task "understand", within 2000 tokens."""
    return O.compact(symbols(spark, d), "understand", _Q, 2000)
