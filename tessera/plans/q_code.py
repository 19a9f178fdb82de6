"""Queries over code facts, paths and findings: symbols, files and lines made from the tables, and the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import detectors as D
from tessera.operators import sources_text as X_
from tessera.operators import symbols as S
from tessera.plans import code_tables as C
from tessera.plans.registry import query
from tessera.plans.tables import table, values
from tessera.sources import files as X


def _count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, '{pattern}'))"


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '/\*[\s\S]*?\*/', '', 'g'), '(?m)//.*$', '', 'g'), '[''`](?:[^''`\\]|\\.)*[''`]', '', 'g'), '"(?:[^"\\]|\\.)*"', '', 'g')"""


@query("q56_cyclomatic_complexity", f"with s as ({C.COMPONENTS}), c as (select id, 1 + {' + '.join(_count(_CLEAN, p) for p in T.DECISIONS)} as points from s) select id, points::int as points, case when points <= 10 then 'low' when points <= 20 then 'moderate' when points <= 50 then 'high' else 'very high' end as rating from c")
def q56(spark, d):
    points = T.complexity(F.col("text"))
    return C.relation(spark, d, C.COMPONENTS).select("id", points.alias("points"), T.complexity_rating(points).alias("rating"))


_PATHS = "('/users?x=1'), ('`/v1/items/$' || '{id}`'), ('v2/a//b'), ('https://api.x.com/y'), ('http'), ('/'), ('API_BASE_URL/v1/z'), (':/v1/q'), ('/$bad'), ('users/list#top'), ('process.env.HOST/api/k'), ('')"
_RX = lambda e, p, r: f"regexp_replace({e}, '{p}', '{r}', 'g')"
_P = "regexp_replace(regexp_replace(split_part(split_part(path, '?', 1), '#', 1), '^[`''\"]', ''), '[`''\"]$', '')"


@query(
    "q61_endpoint_normalise",
    rf"""with a as (select path, {_P} as p from (values {_PATHS}) t(path)), b as (select path, p, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '\$\{{([^}}]+)\}}', ':\1', 'g'),
        'https?://(localhost|127\.0\.0\.1)(:\d+)?/?', '', 'g'), '^/?(:?[A-Z0-9_]*BASE_URL:?)', '', 'i'), '^/?process\.env\.[A-Z0-9_]+', '', 'i'), '^/:/', '/api/'), '^:/', '/api/') as i from a),
        c as (select path, p, regexp_replace(case when regexp_matches(i, '^/v[0-9]+/') then '/api' || i when regexp_matches(i, '^v[0-9]+/') then '/api/' || i else i end, '/+', '/', 'g') as i from b),
        e as (select path, p, case when i <> '' and not starts_with(i, '/') then '/' || i else i end as i from c)
        select path, case when p in ('', 'http', 'https') then '' when regexp_matches(p, '^https?://') then p when length(i) < 2 or regexp_matches(i, '^/[^a-zA-Z0-9]') then '' else i end as normal from e""",
)
def q61(spark, d):
    return values(spark, _PATHS, "path").select("path", T.endpoint_path(F.col("path")).alias("normal"))


_CALLS = "select regexp_extract(url, '^https?://[^/]+(/[a-z]+)', 1) as path, case page_id % 3 when 0 then 'GET' when 1 then 'POST' else 'PUT' end as method, regexp_extract(url, '^https?://([^/]+)', 1) as file from pages"


def _calls(spark, d):
    u = lambda p: F.regexp_extract("url", p, 1)
    method = F.when(F.col("page_id") % 3 == 0, "GET").when(F.col("page_id") % 3 == 1, "POST").otherwise("PUT")
    return table(spark, d, "pages").select(u("^https?://[^/]+(/[a-z]+)").alias("path"), method.alias("method"), u("^https?://([^/]+)").alias("file"))


@query("q62_duplicate_endpoints", f"with c as ({_CALLS}) select path, 'exact' as kind, count(*) as n from c group by path, method having count(*) > 1 union all select path, 'methods', count(distinct method) from c group by path having count(distinct method) > 1")
def q62(spark, d):
    return D.duplicate_endpoints(_calls(spark, d))


@query("q63_endpoint_usage", f"with c as ({_CALLS}) select path, method, count(distinct file) as files, case when count(distinct file) > 2 then 'STATE-001' end as finding from c group by path, method")
def q63(spark, d):
    return D.endpoint_usage(_calls(spark, d))


@query("q64_html_link_facts", "select page_id, len(regexp_extract_all(html, '<a href')) as links, len(regexp_extract_all(html, '<script')) as scripts, len(regexp_extract_all(html, '<p>')) as paragraphs, contains(html, '<h1') as has_h1 from pages")
def q64(spark, d):
    n = lambda p: F.regexp_count("html", F.lit(p))
    return table(spark, d, "pages").select("page_id", n("<a href").alias("links"), n("<script").alias("scripts"), n("<p>").alias("paragraphs"), F.col("html").contains("<h1").alias("has_h1"))


_NO = "('if', 'for', 'while', 'switch', 'catch', 'function', 'return', 'new')"
_FACT = {k: p.replace("'", "''") for k, p, _ in D.FACTS} | {"call": r"\b([A-Za-z_$][\w$]*)\s*\("}
_FACTS = f"l as ({C.LINES}), fa as (" + " union all ".join(f"select id, 1 as line, '{k}' as kind, unnest(list_filter(regexp_extract_all(text, '{_FACT[k]}', 1), lambda x: x not in {_NO if k == 'call' else '(chr(1))'})) as name from l" for k, _, _ in D.FACTS) + ")"


def facts(spark, d):
    return D.facts(C.relation(spark, d, C.LINES).select("id", "text"))


@query("q66_code_fact_extract", f"with {_FACTS} select * from fa")
def q66(spark, d):
    return facts(spark, d)


@query("q65_env_key_extract", f"with {_FACTS} select name as key, min(id) as first, count(*) as uses from fa where kind = 'env' group by name")
def q65(spark, d):
    """Each key once, with where it is seen first."""
    return facts(spark, d).filter("kind = 'env'").groupBy(F.col("name").alias("key")).agg(F.min("id").alias("first"), F.count("*").alias("uses"))


@query("q92_ast_query_dsl", f"with {_FACTS} select distinct id, line, kind, name, case kind {' '.join(f'when {k!r} then {v}::double' for k, v in D.FACT_SCORES.items())} end as score from fa where (kind = 'import' and regexp_matches(name, '^(pg|mongoose)$')) or (kind = 'route' and contains(name, '/users')) or (kind = 'call' and contains(name, 'fetch')) or (kind = 'new' and contains(name, 'Client')) or (kind = 'env' and regexp_matches(name, 'URL$'))")
def q92(spark, d):
    """Queries (kind, pattern) run as filters over the facts."""
    return D.ast_query(facts(spark, d), [("import", "/^(pg|mongoose)$/"), ("route", "/users"), ("call", "fetch"), ("new", "Client"), ("env", "/URL$/")])


@query("q170_structural_search", f"with l as ({C.LINES}) select id, 1 as line, regexp_extract(text, 'const\\s+([^,()\\s]+)\\s+=\\s+([^,()\\s]+)', 1) as \"NAME\", regexp_extract(text, 'const\\s+([^,()\\s]+)\\s+=\\s+([^,()\\s]+)', 2) as \"VALUE\" from l where regexp_matches(text, 'const\\s+([^,()\\s]+)\\s+=\\s+([^,()\\s]+)')")
def q170(spark, d):
    return D.structural_search(C.relation(spark, d, C.LINES).select("id", "text"), "const $NAME = $VALUE")


_F = f"f as ({C.FILES})"
_MIXED = "select p_partkey as id, case p_partkey % 4 when 0 then 'pkg/src/' when 1 then 'dist/' when 2 then 'lib/' else 'web/build/' end || 'm' || cast(p_partkey % 60 as string) || case p_size % 5 when 0 then '.ts' when 1 then '.tsx' when 2 then '.js' when 3 then '.jsx' else '.css' end as path from part"
_BUILT = "(" + " or ".join(f"contains(lower(path), '{b}')" for b in S.BUILD) + ")"
_RANK = f"case when src and ext = '.ts' then 1 when src and ext = '.tsx' then 2 when ext = '.ts' and not built then 3 when ext = '.tsx' and not built then 4 when src and ext in ('.js', '.jsx') then 5 when ext in ('.js', '.jsx') and not built then 6 when src and not built then 7 when not built then 8 else 9 end"


@query("q74_source_preference", f"with p as ({_MIXED}), e as (select path, regexp_replace(path, '[.][^/.]+$', '') as stem, regexp_extract(path, '([.][^./]+)$', 1) as ext, {_BUILT} as built, contains(path, '/src/') as src from p), r as (select *, row_number() over (partition by stem order by {_RANK}, length(path), path) as place, count(*) over (partition by stem) as candidates from e) select stem, path, candidates from r where place = 1")
def q74(spark, d):
    return S.prefer_sources(C.relation(spark, d, _MIXED))


@query("q75_ignore_rules", f"with {_F} select id, (contains(path, 'node_modules/') or starts_with(path, 'src/scripts/') or path like '%.md') and not contains(path, '/README') as ignored from f")
def q75(spark, d):
    rules = ["# build", "**/node_modules/**", "src/scripts/", "*.md", "!README*"]
    return C.relation(spark, d, C.FILES).select("id", X.ignored(F.col("path"), rules).alias("ignored"))


@query("q76_glob_filter", f"with {_F} select id from f where regexp_matches(path, '^(.*/)?api/[^/]*[.]ts$') or regexp_matches(path, '^src/.*/[^/]*[.]json$')")
def q76(spark, d):
    return C.relation(spark, d, C.FILES).filter(X.matches_any(F.col("path"), ["**/api/*.ts", "src/*/**/*.json", "src/*/*.json"])).select("id")


_LANG = "case regexp_extract(path, '[.]([a-z]+)$', 1) when 'ts' then 'typescript' when 'tsx' then 'typescript' when 'js' then 'javascript' when 'py' then 'python' when 'md' then 'markdown' when 'json' then 'json' else 'text' end"


@query(
    "q77_file_relevance_sort",
    f"""with {_F}, g as (select id, path, size, {_LANG} as language from f) select id, language,
        ((contains(path, 'index') or contains(path, 'main') or contains(path, 'app'))::int * 100 + contains(lower(path), 'readme')::int * 80 + contains(path, 'package.json')::int * 70 + (contains(path, 'src/') or contains(path, 'lib/'))::int * 50
        + (language in ('typescript', 'javascript'))::int * 30 + (size > 500 and size < 50000)::int * 10 - case when len(string_split(path, '/')) > 5 then len(string_split(path, '/')) else 0 end)::int as score from g""",
)
def q77(spark, d):
    f = C.relation(spark, d, C.FILES).withColumn("language", X.language(F.col("path")))
    return f.select("id", "language", S.file_relevance(F.col("path"), F.col("language"), F.col("size")).alias("score"))


_PRIOR = "case " + " ".join(f"when regexp_matches(lower(path), '{p}') then {v}::double" for p, v in S.PATH_PRIORS) + " else 1.0::double end"


@query("q96_path_prior", f"with {_F} select id, {_PRIOR} as prior from f")
def q96(spark, d):
    return C.relation(spark, d, C.FILES).select("id", S.path_prior(F.col("path")).alias("prior"))


_ROUTED = "select p_partkey as id, case when p_size % 2 = 0 then 'src/' else '' end || 'app/' || case p_partkey % 6 when 0 then '' when 1 then 'users/[id]/' when 2 then 'blog/[...slug]/' when 3 then 'files/[[...path]]/' when 4 then '(marketing)/pricing/' else '@modal/x/' end || 's' || cast(p_size as string) || case p_partkey % 3 when 0 then '/page.tsx' when 1 then '/route.ts' else '/layout.jsx' end as file from part"
_PART = "case when regexp_matches(s, '^\\[\\[\\.\\.\\.(.+)\\]\\]$') then '*' || regexp_extract(s, '^\\[\\[\\.\\.\\.(.+)\\]\\]$', 1) || '?' when regexp_matches(s, '^\\[\\.\\.\\.(.+)\\]$') then '*' || regexp_extract(s, '^\\[\\.\\.\\.(.+)\\]$', 1) when regexp_matches(s, '^\\[(.+)\\]$') then ':' || regexp_extract(s, '^\\[(.+)\\]$', 1) else s end"


@query("q97_route_paths", f"with r as ({_ROUTED}), p as (select id, list_filter(string_split(regexp_replace(regexp_replace(file, '^(src/)?app/', ''), '/(page|route|layout)\\.(tsx?|jsx?)$', ''), '/'), lambda s: s <> '' and not regexp_matches(s, '^\\(.*\\)$') and not starts_with(s, '@')) as parts from r) select id, '/' || array_to_string(list_transform(parts, lambda s: {_PART}), '/') as route from p")
def q97(spark, d):
    return C.relation(spark, d, _ROUTED).select("id", T.route_path(F.col("file")).alias("route"))


_KINDS = "case l_linenumber % 6 when 0 then 'import' when 1 then 'env' when 2 then 'sql' when 3 then 'connection' when 4 then 'sql' else 'other' end"


@query("q88_db_confidence", f"with e as (select l_orderkey as file, {_KINDS} as kind from lineitem) select file, least(1.0::double, (30 * bool_or(kind = 'import')::int + 25 * bool_or(kind = 'env')::int + 15 * bool_or(kind = 'sql')::int + 20 * bool_or(kind = 'connection')::int) / 100) as confidence from e group by file")
def q88(spark, d):
    kind = F.expr(_KINDS)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), kind.alias("kind")).groupBy("file").agg(D.db_confidence(F.col("kind")).cast("double").alias("confidence"))


_RAW = "select p_partkey as id, case p_partkey % 4 when 0 then cast(p_size as string) || '.' || cast(p_partkey % 10 as string) || '%' when 1 then '0.' || cast(p_size as string) when 2 then 'none' else cast(p_size + 50 as string) end as raw from part"


@query("q98_confidence_parse", f"with r as ({_RAW}), n as (select id, nullif(regexp_extract(raw, '([0-9]+(?:[.][0-9]+)?)', 1), '')::double as n from r) select id, round(case when n > 1 then n / 100 else n end, 6) as confidence from n")
def q98(spark, d):
    return C.relation(spark, d, _RAW).select("id", F.round(T.confidence(F.col("raw")), 6).alias("confidence"))


_QUOTAS = "select p_partkey as id, case p_partkey % 7 when 0 then cast(p_size as string) || 'GB' when 1 then cast(p_size as string) || 'mb' when 2 then cast(p_size as string) when 3 then 'abc' when 4 then cast(p_size as string) || '.5 kb' when 5 then cast(p_size as string) || 'TB' else cast(p_size as string) || 'B' end as q from part"


@query("q94_quota_parse", f"with q as ({_QUOTAS}), p as (select id, nullif(regexp_extract(upper(q), '^([0-9]+(?:[.][0-9]+)?) *(KB|MB|GB|TB|B)?$', 1), '')::double as n, regexp_extract(upper(q), '^([0-9]+(?:[.][0-9]+)?) *(KB|MB|GB|TB|B)?$', 2) as u from q) select id, case when n is null then 10737418240 else floor(n * pow(1024::double, case u when 'B' then 0 when 'KB' then 1 when 'GB' then 3 when 'TB' then 4 else 2 end))::bigint end as bytes from p")
def q94(spark, d):
    return C.relation(spark, d, _QUOTAS).select("id", T.quota_bytes(F.col("q")).alias("bytes"))


_TEMPLATE = "{kind} {name} in {file} uses {unknown}. Notes: {doc}"


@query("q171_answer_template", f"with s as ({C.SYMBOLS}), t as (select id, kind || ' ' || name || ' in ' || file || ' uses -. Notes: ' || coalesce(doc, '-') as x from s), w as (select id, x, regexp_split_to_array(x, '\\s+') as p from t) select id, case when len(p) > 12 then array_to_string(p[1:12], ' ') || '...' else x end as answer from w")
def q171(spark, d):
    s = C.relation(spark, d, C.SYMBOLS)
    return s.select("id", D.fill_template(_TEMPLATE, {n: F.col(n) for n in ("kind", "name", "file", "doc")}, 12).alias("answer"))


_NAME = "Redwidget"
_HOLDS = f"(contains(signature, '{_NAME}') or coalesce(contains(body, '{_NAME}'), false))"


@query("q172_around_symbol", f"with s as ({C.SYMBOLS}), r as (select 'usage' as relation, id from s where {_HOLDS} and not contains(lower(file), 'test') and name <> '{_NAME}' union all select 'test', id from s where {_HOLDS} and contains(lower(file), 'test') union all select 'error', id from s where coalesce(regexp_matches(body, '\\b(try|catch|throw)\\b|Error'), false) and file in (select file from s where name = '{_NAME}')), p as (select *, (row_number() over (partition by relation order by id))::int as place from r) select relation, place, id from p where place <= case relation when 'test' then 3 else 5 end")
def q172(spark, d):
    return D.around_symbol(C.relation(spark, d, C.SYMBOLS), _NAME)


@query("q173_json_structure", "select event_id as id, case when json_valid(props) then 2 end as depth, 1 + len(json_keys(props))::int as nodes, 1 as objects, 0 as arrays, array_to_string(json_keys(props), ',') as paths from events")
def q173(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("text"))
    return X_.json_structure(rows).withColumn("paths", F.array_join("paths", ","))


@query("q91_json_structure")
def q91(spark, d):
    """Keys and types of the JSON properties of events, by variant."""
    v = F.parse_json("props")
    return table(spark, d, "events").groupBy(F.schema_of_variant(v).alias("schema")).agg(F.count("*").alias("n"), F.max(F.variant_get(v, "$.k", "int")).alias("largest"))
