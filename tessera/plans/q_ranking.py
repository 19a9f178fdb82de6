"""Queries that rank symbols (one for each part) and files (one for each order) for a question."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import ranking as O
from tessera.operators import symbols as S
from tessera.plans import code_tables as C
from tessera.plans.registry import query
from tessera.plans.tables import table, values
from tessera.sources.files import glob_pattern

_ROLES = {"function": "operation", "class": "core", "interface": "interface", "variable": "config", "type": "entry", "export": "init"}
_CASE = lambda c, kv, other: f"case {c} " + " ".join(f"when '{k}' then {v!r}" for k, v in kv.items()) + f" else {other!r} end"
_CANDIDATES = f"select id, file, name, kind, exported, p_size as days, {_CASE('kind', _ROLES, '')} as role, doc from ({C.SYMBOLS}) y"
_PLAN, _QUESTION = "auth", "How does the user session create a red widget?"
_TOKENS = O.query_tokens(_QUESTION)


def _candidates(spark, d):
    rows = C.relation(spark, d, C.SYMBOLS)
    role = F.lit("")
    for k, v in _ROLES.items():
        role = F.when(F.col("kind") == k, v).otherwise(role)
    return rows.select("id", "file", "name", "kind", "exported", F.col("p_size").alias("days"), role.alias("role"), "doc")


_QUESTIONS = "(1, 'How does the user-session token work?'), (2, 'What is a db.query and when?'), (3, ''), (4, 'the THE Cache cache_key')"


@query("q130_query_tokens", f"select id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ',') as tokens from (select id, list_filter(regexp_split_to_array(lower(q), '[\\s\\-_.,?!]+'), lambda x: length(x) > 2 and x not in ({', '.join(map(repr, O.STOP_WORDS))})) as w from (values {_QUESTIONS}) t(id, q)) s")
def q130(spark, d):
    return values(spark, _QUESTIONS, "id, q").select("id", F.array_join(O.query_tokens_column(F.col("q")), ",").alias("tokens"))


_DEGREE = f"""c as ({_CANDIDATES}), g as (select a.id, count(*) as degree from c a join c b on a.file = b.file or contains(a.name, b.name) or contains(b.name, a.name) where not (a.file = b.file and a.name = b.name) group by a.id),
    dg as (select c.id, coalesce(degree, 0) as degree from c left join g on c.id = g.id)"""


@query("q131_name_graph_degree", f"with {_DEGREE} select * from dg")
def q131(spark, d):
    return O.name_degrees(_candidates(spark, d))


_EXPORTS = "e as (select name, file from c where exported and kind = 'export')"


@query("q132_candidates_in_exports", f"with c as ({_CANDIDATES}), {_EXPORTS} select id, exists (select 1 from e where e.name = c.name or e.file = c.file) as exported_ from c")
def q132(spark, d):
    c = _candidates(spark, d)
    return O.in_exports(c, c.filter("exported and kind = 'export'").select("name", "file"))


def _sum(items, base):
    return f"({base}::double + " + " + ".join(f"case when {cond} then {n}::double else 0 end" for cond, n in items) + ")"


_IN = lambda c, w: f"contains({c}, '{w}')"
_KEYS = O.domain_keywords(_PLAN)
_PATH0 = _sum([(_IN("lower(file)", w), 0.1) for w in _KEYS] + [(_IN("lower(file)", p), n) for p, n in O.FOLDERS], 0.5)
_PATH = f"""greatest(0, least(1, {_PATH0} * case when contains(lower(file), 'test') or contains(lower(file), 'spec') then 0.7::double else 1 end - case when contains(lower(file), '/scripts/') then 0.6::double else 0 end - case when contains(lower(file), 'projection_matrix') then 0.9::double else 0 end
    - case when regexp_matches(lower(file), '(benchmarks|fixtures|examples)') then 0.3::double else 0 end - case when regexp_matches(lower(file), '(metrics|telemetry|observability|worker|jobs?|queue)') then 0.4::double else 0 end))"""
_BASE = "lower(string_split(file, '/')[-1])"
_ANY = " or ".join([_IN("lower(name)", t) for t in _TOKENS] + [_IN(_BASE, t) for t in _TOKENS] + [_IN("lower(name)", w) for w in _KEYS])
_KEYWORD = f"least(1.0::double, {_sum([(_IN('lower(name)', t), 0.3) for t in _TOKENS] + [(_IN(_BASE, t), 0.15) for t in _TOKENS] + [(_IN('lower(name)', w), 0.2) for w in _KEYS], 0)} + case when ({_ANY}) and contains(lower(name), '{' '.join(_TOKENS)}') then 0.4 else 0 end)"
_SURFACE = f"least(1.0::double, 0.3::double + {_CASE('kind', O.KIND_SURFACE, 0.05)}::double + case when exists (select 1 from e where e.name = c.name or e.file = c.file) then 0.3::double else 0 end + case when contains(name, 'handle') or contains(name, 'tool') then 0.2::double else 0 end + case when regexp_matches(lower(name), '^(init|initialize|setup|start|create)') then 0.25::double else 0 end)"
_RECENCY = "case when days <= 1 then 1.0::double when days <= 7 then 0.7::double when days <= 30 then 0.5::double else 0.3::double end"
_CONTEXT = f"least(1.0::double, 0.4::double + case when doc is not null then 0.2::double + {_sum([(_IN('lower(doc)', t), 0.1) for t in _TOKENS], 0)} else 0 end + {_CASE('role', O.ROLE_CONTEXT, 0.0)}::double)"
_DOMAIN = f"least(1.0::double, {_sum([(f'''regexp_matches(lower({'name' if w == 'n' else 'file'}), '{p}')''', n) for w, p, n in O.PLAN_PATTERNS[_PLAN]], 0.4)})"
_FACTORS = {"path": _PATH, "keyword": _KEYWORD, "surface": _SURFACE, "degree": "(0.3::double + least(degree / 20, 1.0::double) * 0.4::double)", "recency": _RECENCY, "context": _CONTEXT, "domain": _DOMAIN}
_RANKED = f"with {_DEGREE}, {_EXPORTS}, f as (select c.id, c.file, c.name, {', '.join(f'{v} as {k}_factor' for k, v in _FACTORS.items())} from c join dg on c.id = dg.id), r as (select id, file, name, {', '.join(f'round({k}_factor, 6) as {k}_factor' for k in _FACTORS)}, round({' + '.join(f'{k}_factor * {w}::double' for k, w in O.WEIGHTS.items())}, 6) as score from f)"


def _ranked(spark, d):
    c = _candidates(spark, d)
    c = c.withColumn("reasons", F.when(F.col("doc").isNotNull(), F.array("doc")).otherwise(F.array().cast("array<string>")))
    return O.rank_candidates(c, c.filter("exported and kind = 'export'").select("name", "file"), _QUESTION, _PLAN)


@query("q47_candidate_weighted_score", f"{_RANKED} select * from r")
def q47(spark, d):
    """Seven factors of every symbol for a question about users and sessions."""
    return _ranked(spark, d)


@query("q45_diversity_per_file_cap", f"{_RANKED}, p as (select *, row_number() over (partition by file order by score desc, id) as place from r), t as (select * from p where place <= 3 order by score desc, id limit 20) select id, file, name, score, (row_number() over (order by score desc, id))::int as ranking from t")
def q45(spark, d):
    return O.diverse(_ranked(spark, d).select("id", "file", "name", "score"), "file")


_TERMS = ["user", "widget", "config"]
_TEXT = "lower(name || ' ' || file)"
_ALIAS = lambda t: "(" + " or ".join([_IN(_TEXT, a) for a in O.ALIASES.get(t, ())] or ["false"]) + ")"
_FUZZY = lambda t: f"(len(list_filter(regexp_split_to_array({_TEXT}, '[\\s\\-_./\\\\]'), lambda w: contains(w, '{t}') or contains('{t}', substring(w, 1, 3)))) > 0)"
_DIRECT = lambda t: f"(contains(lower(name), '{t}') or contains(lower(file), '{t}'))"
_TERM_SCORE = " * ".join(f"(case when lower(name) = '{t}' then 2.0::double when contains(lower(name), '{t}') then 1.5::double when contains(lower(file), '{t}') then 1.3::double else (case when {_ALIAS(t)} then 1.2::double else 1 end) * (case when {_FUZZY(t)} then 1.1::double else 1 end) end)" for t in _TERMS)
_TERM_COUNT = " + ".join(f"(case when {_DIRECT(t)} then 1 else {_ALIAS(t)}::int + {_FUZZY(t)}::int end)" for t in _TERMS)
_PRIOR = "case " + " ".join(f"when regexp_matches(lower(file), '{p}') then {v}::double" for p, v in S.PATH_PRIORS) + " else 1.0::double end"
_HINTS = f"""with u as (select distinct id, target from ({C.USES}) x), g as (select id, count(*)::double as n from u group by id), t as (select target as id, count(*) * 1.5::double as n from u group by target),
    y as (select s.*, s.p_size * 8 as days, coalesce(g.n, 0) + coalesce(t.n, 0) as degree from ({C.SYMBOLS}) s left join g on s.id = g.id left join t on s.id = t.id),
    h as (select id, file, name, {_PRIOR} * {_CASE('kind', O.HINT_SURFACE, 1.0)}::double * (1 + least(0.4::double, ln(degree + 1) * 0.1::double)) * (case when days < 7 then 1.2 when days < 30 then 1.15 when days < 90 then 1.1 when days < 180 then 1.05 else 1.0 end)::double
        * ({_TERM_SCORE}) * case when {_TERM_COUNT} > 1 then 1.1::double else 1 end as score from y)"""


def _hint_items(spark, d):
    edges = C.relation(spark, d, C.USES).select(F.col("id").alias("src"), F.col("target").alias("dst")).distinct()
    degree = G.degree_boost(edges).select(F.col("node").alias("id"), "degree")
    rows = C.relation(spark, d, C.SYMBOLS).join(degree, "id", "left").fillna(0.0, ["degree"])
    return rows.withColumn("days", F.col("p_size") * 8)


@query("q108_five_factor_score", f"{_HINTS} select id, round(score, 6) as score from h")
def q108(spark, d):
    """Product of path, surface, degree, recency and keywords."""
    score = O.hint_score(F.col("kind"), F.col("degree"), F.col("days"), _TERMS)
    return _hint_items(spark, d).select("id", F.round(score, 6).alias("score"))


@query("q46_ranked_hints", f"{_HINTS} select id, file, name, round(score, 6) as score, round(greatest(0.5::double, least(0.98::double, 0.5 + (least(3.0::double, greatest(0.5::double, score)) - 0.5) / 2.5 * 0.48)), 2) as confidence from h order by round(score, 9) desc, id limit 7")
def q46(spark, d):
    return O.ranked_hints(_hint_items(spark, d), _TERMS)


def _globs(globs):
    return "(" + " or ".join(f"regexp_matches(path, '{glob_pattern(g)}')" for g in globs) + ")"


_TOPICS = ("auth", "api", "components", "db")


def _topic(t: str) -> str:
    stop = [*O.NEVER, *(O.NOT_AUTH if t == "auth" else ())]
    hint = f"regexp_matches(path, '{O.TOPIC_FILES[t]}')" if t in O.TOPIC_FILES else "false"
    hint += f" or {_globs(O.AUTH_FILES)}" if t == "auth" else ""
    return f"select '{t}' as topic, id, ({hint}) as hinted from ({C.FILES}) f where not {_globs(stop)}"


@query("q133_topic_files", " union all ".join(_topic(t) for t in _TOPICS))
def q133(spark, d):
    files = C.relation(spark, d, C.FILES)
    out = None
    for t in _TOPICS:
        some = O.topic_files(files, t).select(F.lit(t).alias("topic"), "id", "hinted")
        out = some if out is None else out.unionByName(some)
    return out


@query("q134_map_confidence", "select l_partkey as id, round(least(1.0::double, avg(l_discount) * 10 * 0.6::double + avg(l_tax) * 10 * 0.3::double + 0.1::double), 6) as confidence from lineitem group by 1")
def q134(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.avg("l_discount").alias("c"), F.avg("l_tax").alias("a"))
    return rows.select("id", F.round(O.map_confidence(F.col("c") * 10, F.col("a") * 10), 6).alias("confidence"))
