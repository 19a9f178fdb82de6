"""Queries over files (one for each order), lines of source (one for each part) and what they show."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import project as O
from tessera.plans import code_tables as C
from tessera.plans.registry import query
from tessera.plans.tables import table, values
from tessera.sources import files as X

_HAS = lambda c, parts: "(" + " or ".join(f"contains({c}, '{p}')" for p in parts) + ")"
_F = f"f as ({C.FILES})"
_EXT = r"regexp_extract(path, '(\.[^./]+)$', 1)"
_LANG = f"case {_EXT} when '.ts' then 'typescript' when '.tsx' then 'typescript' when '.js' then 'javascript' when '.py' then 'python' when '.md' then 'markdown' when '.json' then 'json' else 'text' end"
_FOLDER = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


def files(spark, d):
    return C.relation(spark, d, C.FILES)


def with_language(df):
    return df.withColumn("language", X.language(F.col("path")))


_IN = lambda values_: "(" + ", ".join(f"'{v}'" for v in values_) + ")"
# Exports: one for each part, with the file its symbol stands in.
_EXPORTS = f"""select id, file, case id % 16 when 0 then 'GET' when 1 then 'Button' when 2 then 'useStore' when 3 then 'render' when 4 then 'authToken' when 5 then 'createUserComponent' when 6 then 'default' when 7 then 'searchIndex' when 8 then 'verifyUser' when 9 then 'uploadFile'
    when 10 then 'POST' when 11 then 'handler' when 12 then 'parseConfig' when 13 then 'deleteItem' when 14 then 'syncCache' else 'loadProfile' end as name from ({C.SYMBOLS}) y"""
_ROUTES = "select file, name as method, '/api/' || case id % 3 when 0 then 'users' when 1 then 'search' else 'auth/x' end as path from x where name in ('GET', 'POST') and id % 32 < 16"
_ENV = "select file, case id % 5 when 0 then 'OPENAI_KEY' when 1 then 'NEXT_PUBLIC_URL' when 2 then 'REDIS_URL' when 3 then 'STRIPE_SECRET' else 'SMTP_HOST' end as key from x where id % 7 = 0"
_X = f"x as ({_EXPORTS}), rt as ({_ROUTES}), ev as ({_ENV})"


def exports(spark, d):
    return C.relation(spark, d, _EXPORTS)


def routes(spark, d):
    where = F.when(F.col("id") % 3 == 0, "users").when(F.col("id") % 3 == 1, "search").otherwise("auth/x")
    return exports(spark, d).filter("name in ('GET', 'POST') and id % 32 < 16").select("file", F.col("name").alias("method"), F.concat(F.lit("/api/"), where).alias("path"))


def env(spark, d):
    key = F.element_at(F.array(*map(F.lit, ("OPENAI_KEY", "NEXT_PUBLIC_URL", "REDIS_URL", "STRIPE_SECRET", "SMTP_HOST"))), (F.col("id") % 5 + 1).cast("int"))
    return exports(spark, d).filter("id % 7 = 0").select("file", key.alias("key"))


_CLIENT = r"""regexp_matches(path, '/components/|/(web|client|frontend)/|/(portal|viewer|modals)/|/__tests__/|\.(test|spec)\.') or (regexp_matches(path, '/app/.*\.tsx?$') and not regexp_matches(path, '/route\.tsx?$')) or (contains(path, '/pages/') and len(list_filter(string_split(path, '/pages/')[2:], lambda x: not starts_with(x, 'api'))) > 0)"""
_SERVER = O.SERVERISH


@query(
    "q135_path_predicates",
    rf"""with {_F} select id, regexp_matches(lower(path), '\.(md|txt|rst|adoc|asciidoc)$') as documentation, {_HAS('lower(path)', O.NOT_APP)} as not_app,
        regexp_matches(path, '{_SERVER}') and not regexp_matches(path, '(?i)(/|^)(__tests__|tests)/|\.(test|spec)\.|(/|^)(dist|build|out|coverage|\.next)/') as public_surface, {_CLIENT} as client,
        len(list_filter(regexp_split_to_array(path, '[/\\]'), lambda p: p in ('node_modules', '.git', 'dist', 'build', '.next', 'coverage') or starts_with(p, '.') or contains(p, '.min.') or contains(p, '.test.') or contains(p, '.spec.'))) = 0 as indexable from f""",
)
def q135(spark, d):
    p = F.col("path")
    return files(spark, d).select("id", O.is_documentation(p).alias("documentation"), O.is_not_app(p).alias("not_app"), O.is_public_surface(p).alias("public_surface"), O.is_client(p).alias("client"), O.is_indexable(p).alias("indexable"))


_GLOB = lambda p: f"regexp_matches(path, '{p.replace('.', chr(92) + '.').replace('*', '.*')}')" if "*" in p else f"contains(path, '{p}')"
_VERDICT = f"case when {' or '.join(_GLOB(p) for p in O.IGNORED)} then 'ignored' when {_EXT} not in {_IN(O.EXTENSIONS)} then 'extension' when size > 400000 then 'size' else 'supported' end"


@query("q136_discovery_counters", f"with {_F}, v as (select {_VERDICT} as v from f) select count(*) as candidates, count(*) filter (v = 'ignored') as ignored, count(*) filter (v = 'extension') as extension_filtered, count(*) filter (v = 'size') as size_filtered, least(count(*) filter (v = 'supported'), 1000) as supported from v")
def q136(spark, d):
    return O.discover(files(spark, d), 1000, largest=400_000)


@query("q137_language_filter", f"with {_F} select id, {_LANG} as language from f where {_LANG} in ('typescript', 'python')")
def q137(spark, d):
    return with_language(files(spark, d)).filter(F.col("language").isin("typescript", "python")).select("id", "language")


_SIMPLE = ["src/docs/**", "*.min.*", "src/scripts", "src/lib/db/api*"]


@query("q138_simple_ignore", f"with {_F} select id, starts_with(path, '.git') or starts_with(path, 'node_modules') or starts_with(path, 'dist') or starts_with(path, 'src/docs/') or path = 'src/docs' or regexp_matches(path, 'src/docs/.*.*') or regexp_matches(path, '.*.min..*') or path = 'src/scripts' or starts_with(path, 'src/scripts/') or regexp_matches(path, 'src/lib/db/api.*') as ignored from f")
def q138(spark, d):
    return files(spark, d).select("id", O.simply_ignored(F.col("path"), _SIMPLE).alias("ignored"))


@query("q139_public_exports", f"with {_X}, g as (select distinct file as rf from rt) select id, " + rf"""(case when lower(name) in {_IN(O.NOISE)} then not regexp_matches(file, '/(api|server|mcpServer|worker|lib|core|utils|services)/') else regexp_matches(name, '{O.ELEMENTS}') or regexp_matches(name, '{O.HOOKS}') end) as noise,
    (lower(name) in {_IN(O.GENERIC)} and not regexp_matches(file, '{_SERVER}')) or regexp_matches(name, '{O.ELEMENTS}') or regexp_matches(name, '{O.HOOKS}') or (upper(name) in {_IN(O.METHODS)} and (contains(file, '/api/') or regexp_matches(file, '/app/.*/route\.(ts|js)$'))) as excluded,
    not (upper(name) in {_IN(O.METHODS)} and (rf is not null or regexp_matches(file, 'app/.*/route\.(ts|js)$') or contains(file, '/api/'))) as listed from x left join g on x.file = rf""")
def q139(spark, d):
    x = exports(spark, d)
    listed = O.without_route_exports(x, routes(spark, d)).select(F.col("id").alias("listed_"))
    rows = x.join(listed, F.col("id") == F.col("listed_"), "left")
    return rows.select("id", O.is_noise(F.col("name"), F.col("file")).alias("noise"), O.is_excluded_export(F.col("name"), F.col("file")).alias("excluded"), F.col("listed_").isNotNull().alias("listed"))


@query(
    "q140_file_headers",
    r"""with l as (select doc_id, string_split(text, chr(10)) as l from documents) select doc_id as id, case when starts_with(trim(l[1]), '#') or starts_with(trim(l[1]), '/') then 'other' else 'code' end as type, array_to_string(l[1:15], chr(10)) as content, least(len(l), 15)::int as lines from l""",
)
def q140(spark, d):
    """Prose has no comments: its first 15 lines."""
    h = table(spark, d, "documents").select(F.col("doc_id").alias("id"), O.file_header(F.col("text")).alias("h"))
    return h.select("id", "h.type", "h.content", "h.lines")


_POWER = "least(3, case when size >= 1073741824 then 3 when size >= 1048576 then 2 when size >= 1024 then 1 else 0 end)"


@query("q141_file_sizes", f"with {_F}, s as (select id, size * (1 + id % 5000) as size from f), p as (select *, {_POWER} as p from s), t as (select *, regexp_replace(format('{{:.1f}}', floor(size / pow(1024.0::double, p) * 10 + 0.5::double) / 10), '\\.0$', '') as n from p) select id, case when size = 0 then '0 B' else n || ' ' || case p when 0 then 'B' when 1 then 'KB' when 2 then 'MB' else 'GB' end end as text from t")
def q141(spark, d):
    return files(spark, d).select("id", O.size_text(F.col("size") * (F.col("id") % 5000 + 1)).alias("text"))


_PURPOSE = " ".join(f"when {_HAS('base', parts)} then '{text}'" for parts, text, _ in O.FOLDERS)
_SURE = " ".join(f"when {_HAS('base', parts)} then {c}::double" for parts, _, c in O.FOLDERS)


@query(
    "q29_folder_hints",
    f"""with {_F}, g as (select {_FOLDER} as folder, count(*) as files, array_to_string(list_sort(list(distinct {_EXT})), ',') as types, array_to_string(list_sort(list(distinct {_LANG})), '/') as languages from f group by 1),
        b as (select *, lower(string_split(folder, '/')[-1]) as base from g where files >= 2 and folder <> '') select folder, files, types, case {_PURPOSE} else languages || ' files - ' || files || ' files' end as purpose, case {_SURE} else 0.4::double end as confidence from b""",
)
def q29(spark, d):
    return O.folder_hints(with_language(files(spark, d)))


@query(
    "q30_coverage_insights",
    f"""with {_F}, a as (select count(*) as files, count(distinct {_FOLDER}) as folders, list(distinct {_LANG}) as l, list(distinct {_EXT}) as e, count(*) filter (size > 300000) as large, ceil(epoch(max(mtime) - min(mtime)) / 86400)::bigint as days from f)
        select files, folders, len(l)::int as languages, len(e)::int as extensions, large, days, array_to_string(list_sort(list_filter(e, lambda x: x not in ('', '.lock', '.sum', '.mod', '.gitignore', '.dockerignore', '.ts', '.tsx', '.js', '.jsx', '.json', '.md', '.py', '.txt', '.yml', '.yaml'))), ',') as unexpected from a""",
)
def q30(spark, d):
    return O.coverage_insights(with_language(files(spark, d)), 300_000)


@query("q28_file_composition", f"""with {_F} select {_EXT} as extension, count(*) as "all", count(*) filter (size <= 200000) as kept, count(*) filter (size > 200000) as left_out from f group by 1""")
def q28(spark, d):
    return O.composition(files(spark, d), F.col("size") <= 200_000)


_ENGINE = "case " + " ".join("when regexp_matches(text, '{}') then '{}'".format(p.replace("'", "''"), n) for n, p in O.ENGINES) + " else 'unknown' end"
_PROOF = O.EVIDENCE.replace("'", "''")


@query("q142_database_vote", f"with l as ({C.LINES}), e as (select {_ENGINE} as engine, regexp_matches(text, '{_PROOF}')::int as n from l) select engine, sum(n)::bigint as votes from e where engine <> 'unknown' group by engine")
def q142(spark, d):
    return O.database_vote(C.relation(spark, d, C.LINES))


_FIRED = {
    "ENV-001": ("keys > 0 and not example", "keys"), "ENV-FILE": ("env_files > 0", "env_files"), "ENV-002": ("leaks > 0", "leaks"), "API-AUTH-001": ("api > 0 and not auth_files and not auth_names", "api"),
    "BUILD-001": ("built > 0", "built"), "LARGE-FILES": ("large > 0", "large"), "NO-TESTS": ("not tests and exports > 20", "exports"), "NO-TSCONFIG": ("typescript > 0 and not tsconfig", "typescript"),
}


@query(
    "q143_repository_risks",
    rf"""with {_F}, {_X}, a as (select bool_or(ends_with(path, '.env.example') or contains(path, '/env.example')) as example, count(*) filter (contains(path, '.env') and not contains(path, '.env.example') and not contains(path, '/env.example')) as env_files,
        count(*) filter (contains(path, '/api/') or regexp_matches(path, 'app/.*/route\.(ts|js)$')) as api, bool_or(regexp_matches(path, '(?i)auth|middleware|guard|verify')) as auth_files, count(*) filter ({_HAS('lower(path)', ('/dist/', '/build/', '/.next/', '/out/'))}) as built,
        count(*) filter (size > 100000) as large, bool_or(regexp_matches(path, '(?i)test|spec')) as tests, count(*) filter (regexp_matches(path, '\.tsx?$')) as typescript, bool_or(contains(path, 'tsconfig.json')) as tsconfig from f),
        b as (select (select count(*) from ev) as keys, (select count(*) from x) as exports, (select bool_or(regexp_matches(name, '(?i)auth|verify|middleware|guard')) from x) as auth_names,
            (select count(*) from f where (contains(path, '/web/') or contains(path, '/components/') or (contains(path, '/pages/') and not contains(path, '/pages/api/'))) and path in (select file from ev where not starts_with(key, 'NEXT_PUBLIC_') and not starts_with(key, 'PUBLIC_') and not starts_with(key, 'VITE_'))) as leaks)
        """ + " union all ".join(f"select '{rule}' as rule, '{O.RISKS[rule][0]}' as type, '{O.RISKS[rule][1]}' as severity, {O.RISKS[rule][2]} as points, {n} as files from a, b where {cond}" for rule, (cond, n) in _FIRED.items()),
)
def q143(spark, d):
    return O.repository_risks(files(spark, d), env(spark, d), exports(spark, d))


def _tagged(rules, column, kind, source):
    return " union all ".join(f"select '{kind}' as kind, '{t}' as tag from {source} where regexp_matches(lower({column}), '{p}')" for t, p in rules)


@query(
    "q102_capabilities",
    rf"""with {_X}, k as (select * from x where not (case when lower(name) in {_IN(O.NOISE)} then not regexp_matches(file, '/(api|server|mcpServer|worker|lib|core|utils|services)/') else regexp_matches(name, '{O.ELEMENTS}') or regexp_matches(name, '{O.HOOKS}') end)),
        t as ({_tagged(O.DOMAINS, 'name', 'domain', 'k')} union all {_tagged((('api', '/api/'), ('authentication', '/auth/'), ('user-management', '/user'), ('search', '/search'), ('files', '/file|/upload')), 'path', 'domain', 'rt')} union all {_tagged(O.OPERATIONS, 'name', 'operation', 'k')}
            union all select 'operation', lower(method) from rt union all {_tagged(O.INTEGRATIONS, 'key', 'integration', 'ev')}),
        c as (select kind, tag, count(*) as evidence from t group by 1, 2), r as (select *, row_number() over (partition by kind order by evidence desc, tag) as place from c) select kind, tag, evidence from r where place <= case kind when 'integration' then 8 else 10 end""",
)
def q102(spark, d):
    return O.capabilities(exports(spark, d), routes(spark, d), env(spark, d))


_IMPORTS = "select id, case when contains(text, 'from ''') then regexp_extract(text, 'from ''([^'']+)''', 1) else regexp_extract(text, 'from \"([^\"]+)\"', 1) end as name from l where regexp_matches(text, '^import .* from ')"


def imports(spark, d):
    l = C.relation(spark, d, C.LINES).filter(F.col("text").rlike("^import .* from "))  # noqa: E741
    return l.select("id", F.regexp_extract("text", r"from ['\"]([^'\"]+)['\"]", 1).alias("name"))


@query("q144_architecture_tags", f"with l as ({C.LINES}), i as ({_IMPORTS}), t as (" + " union all ".join(f"select '{t}' as tag from i where regexp_matches(lower(name), '{p}')" for t, p in O.ARCHITECTURE) + ") select tag, count(*) as imports from t group by tag")
def q144(spark, d):
    return O.architecture_tags(imports(spark, d))


@query("q145_collapsed_imports", f"with l as ({C.LINES}), i as ({_IMPORTS}), c as (select case when regexp_matches(name, '^(@/components/ui|shadcn/ui|lucide-react|@radix-ui)') then 'ui-kit' when regexp_matches(name, '^(react|next/|@next/)') then 'react-ecosystem' when starts_with(name, './') or name in ('pg', 'express') then name end as listed from i) select listed, count(*) as n from c where listed is not null group by listed")
def q145(spark, d):
    i = imports(spark, d).select(O.collapse_import(F.col("name")).alias("listed")).filter("listed is not null")
    return i.groupBy("listed").agg(F.count("*").alias("n"))


_KEY = f"({_HAS('path', ('index', 'main', 'app', 'server', 'config'))} or size > 10000 or regexp_matches(path, '(^|/)(package\\.json|tsconfig\\.json|Dockerfile|README\\.md)$'))"


@query("q146_file_roles", f"with {_F} select id, array_to_string(list_filter([case when regexp_matches(path, '{'|'.join(O.ENTRY)}') then 'entry' end, case when regexp_matches(path, '{'|'.join(O.CONFIG)}') then 'config' end, case when regexp_matches(path, '{O.DOCUMENTATION}') then 'documentation' end, case when {_KEY} then 'key' end], lambda x: x is not null), ',') as roles from f")
def q146(spark, d):
    return files(spark, d).select("id", F.array_join(O.file_roles(F.col("path"), F.col("size")), ",").alias("roles"))


@query("q147_repository_fingerprint", rf"with {_F} select array_to_string(list_sort(list(distinct {_LANG})), ',') as languages, (case when bool_or(ends_with(lower(path), 'package.json')) then 'node' else '' end) as frameworks, array_to_string(list_filter([case when bool_or(regexp_matches(lower(path), 'next/|app/.*/route\.(ts|js)')) then 'file_router' end, case when bool_or(contains(lower(path), 'api/')) then 'method_call_router' end], lambda x: x is not null), ',') as families from f")
def q147(spark, d):
    return O.fingerprint(with_language(files(spark, d)))


@query("q148_index_stats", "select (select count(*) from orders) as files, (select count(*) from lineitem) as chunks, (select count(*) from part) as symbols")
def q148(spark, d):
    return O.index_stats(table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part"))


@query("q149_telemetry_stats", "select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, max(value) as most from events group by event_type")
def q149(spark, d):
    t = O.telemetry_stats(table(spark, d, "events"), ["event_type"])
    return t.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95")], "most")


_RULES = "('ENV-002', 'Fix environment leaks in client code', 'high', 25), ('PERF-001', 'Load heavy components on demand', 'high', 15), ('SEC-001', 'Add security attributes to external links', 'medium', 20), ('A11Y-IMG-ALT', 'Add alt attributes to images', 'medium', 10), ('A11Y-H1', 'Give each page a heading', 'low', 5), ('A11Y-MAIN', 'Mark the main content', 'low', 4), ('STATE-001', 'Consolidate duplicate calls', 'low', 3)"
_FINDINGS = """select page_id as file, unnest(list_filter([case when len(regexp_extract_all(html, '<img\\b[^>]*>')) > len(regexp_extract_all(html, '<img\\b[^>]*\\balt=[^>]*>')) then 'A11Y-IMG-ALT' end,
    case when len(regexp_extract_all(html, '<a\\b[^>]*href="https?://[^>]*>')) > len(regexp_extract_all(html, '<a\\b[^>]*href="https?://[^>]*\\brel=[^>]*>')) then 'SEC-001' end,
    case when not contains(lower(html), '<h1') then 'A11Y-H1' end, case when not contains(lower(html), '<main') then 'A11Y-MAIN' end], lambda x: x is not null)) as rule from pages"""


@query("q150_risk_recommendations", f"with p as ({_FINDINGS}), h as (select rule, count(distinct file) as files from p group by rule), r as (select h.rule, title, priority, case priority when 'high' then 1 when 'medium' then 2 else 3 end as urgency, files, row_number() over (order by reduction desc, h.rule) <= 5 as action from h join (values {_RULES}) w(rule, title, priority, reduction) on h.rule = w.rule) select * from r")
def q150(spark, d):
    from tessera.operators.frontend import page_findings

    fired = page_findings(table(spark, d, "pages")).select(F.col("page_id").alias("file"), "rule")
    return O.risk_recommendations(fired, values(spark, _RULES, "rule, title, priority, reduction"))


@query("q197_workspace_verdicts", f"with {_F}, g as (select {_FOLDER} as folder, count(*) as files from f group by 1 union all select '/', 3 union all select 'C:', 3) select folder, case when regexp_matches(folder, '^([A-Za-z]:)?[/\\\\]?$') then 'root' when files > 150 then 'too_many_files' when regexp_matches(lower(folder), '(node_modules|dist|build|\\.git|target|bin|obj)([/\\\\]|$)') then 'inside_build' else 'ok' end as verdict from g")
def q197(spark, d):
    g = files(spark, d).groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"))
    return O.workspace_verdict(g.unionByName(values(spark, "('/', 3L), ('C:', 3L)", "folder, files")), 150)


_TWO = " ".join(f"when '.{k}' then '{v}'" for k, v in X.DISCOVERED.items())
_THREE = " ".join(f"when '.{k}' then '{v}'" for k, v in X.LANGUAGES.items())
_KINDS = "select p_partkey as id, 'src/a.' || case p_partkey % 13 when 0 then 'ts' when 1 then 'mjs' when 2 then 'h' when 3 then 'yaml' when 4 then 'htm' when 5 then 'kts' when 6 then 'zsh' when 7 then 'lua' when 8 then 'C' when 9 then 'md' when 10 then 'hxx' when 11 then 'py' else 'txt' end as path from part"


@query("q198_two_language_maps", f"with f as ({_KINDS}) select id, coalesce(case lower({_EXT}) {_TWO} end, 'unknown') as discovered, coalesce(case lower({_EXT}) {_THREE} end, 'text') as marked from f")
def q198(spark, d):
    f = C.relation(spark, d, _KINDS)
    return f.select("id", X.language(F.col("path"), "unknown", X.DISCOVERED).alias("discovered"), X.language(F.col("path")).alias("marked"))


@query("q199_rendered_rows", "select p_partkey as id, '<tr><td>' || replace(replace(p_name, '&', '&amp;'), '<', '&lt;') || '</td><td>' || p_size || '</td></tr>' as html, 'p_name=' || p_name || ' p_size=' || p_size as line from part")
def q199(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    two = p.select("p_name", "p_size")
    return p.select(F.col("p_partkey").alias("id"), X.html_row(two).alias("html"), X.compact_row(two).alias("line"))
