"""Queries over files of components (one for each part), their imports, modules and what they define."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import frontend as O
from tessera.operators import graph as G
from tessera.plans import code_tables as C
from tessera.plans.registry import query
from tessera.plans.tables import table, values

_C = f"c as ({C.COMPONENTS})"
_LINES = f"{_C}, ll as (select path, string_split(text, chr(10)) as lines from c), l as (select path, lines, unnest(lines) as text, generate_subscripts(lines, 1)::int as line from ll)"
_Q = lambda p: p.replace("'", "''")


def files(spark, d):
    return C.relation(spark, d, C.COMPONENTS)


_NEAR = "lines[greatest(1, line - 3) : line + 3]"
_NAMED = r"(regexp_matches(a, 'aria-label\s*=') or regexp_matches(a, 'aria-labelledby\s*='))"
_ID = r"""regexp_extract(a, 'id\s*=\s*["'']([^"'']+)["'']', 1)"""
_ARIA = {
    "A11Y-ICON-BUTTON-LABEL": (r"<button\s+([^>]*)>", f"not {_NAMED}"),
    "A11Y-LABEL-FOR": (r"""<input\s+([^>]*type\s*=\s*["''](?:text|email|password|search|tel|url|number)["''][^>]*)>""", f"not {_NAMED} and not ({_ID} <> '' and len(list_filter(near, lambda x: contains(x, 'for=\"' || {_ID} || '\"') or contains(x, 'for=''' || {_ID} || ''''))) > 0)"),
    "A11Y-ROLE-BUTTON": (r"""role\s*=\s*["'']button["'']\s+([^>]*)>""", f"not {_NAMED}"),
}


@query("q162_aria_findings", f"with {_LINES}, n as (select *, {_NEAR} as near from l) " + " union all ".join(f"select path, line, '{rule}' as rule, count(*)::int as found from (select path, line, near, unnest(regexp_extract_all(text, '{p}', 1)) as a from n) s where {cond} group by path, line" for rule, (p, cond) in _ARIA.items()))
def q162(spark, d):
    return O.aria_findings(files(spark, d))


_NAMES = f"list_distinct(regexp_extract_all(text, '{_Q(O.COMPONENT[0])}', 1) || regexp_extract_all(text, '{_Q(O.COMPONENT[1])}', 1))"
_USE = " or ".join([f"contains(text, '{x}')" for x in ("''use client''", '"use client"', *O.CLIENT)])
_COMPONENTS = rf"""select path, unnest({_NAMES}) as name, case when {_USE} then 'client' else 'server' end as kind, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b(use[A-Z][a-zA-Z0-9]*)\s*\(', 1))), ',') as hooks,
    regexp_matches(text, '<form|onSubmit=|type="submit"') as forms, regexp_matches(text, '<table|<Table|<DataTable') as tables, regexp_matches(text, '<Modal|<Dialog|<AlertDialog|<Sheet') as modals from c where not contains(path, '/route.')"""


@query("q163_components", f"with {_C} {_COMPONENTS}")
def q163(spark, d):
    return O.components(files(spark, d))


_DIR = lambda c: f"regexp_extract({c}, '^(.*)/[^/]*$', 1)"


@query("q164_components_by_route", f"with {_C}, k as ({_COMPONENTS}), r as (select ordinal, route, {_DIR('file')} as dir from (values {C.ROUTES}) t(ordinal, route, file) where route <> '/'), m as (select k.path, k.name, arg_min(r.route, r.ordinal) as route from k join r on starts_with({_DIR('k.path')}, r.dir) group by 1, 2) select k.path, k.name, coalesce(m.route, '/') as route from k left join m on k.path = m.path and k.name = m.name")
def q164(spark, d):
    return O.components_by_route(O.components(files(spark, d)), values(spark, C.ROUTES, "ordinal, route, file"))


_STORES = " union ".join(f"select path, unnest(regexp_extract_all(text, '{_Q(p)}', 1)) as name, '{kind}' as kind from c" for kind, p in O.STORES)


@query("q165_stores", f"with {_C} {_STORES}")
def q165(spark, d):
    return O.stores(files(spark, d))


@query("q166_store_users", f"with {_C}, s as ({_STORES}) select distinct s.name, s.path as store, c.path from s join c on contains(c.text, s.name) and contains(c.text, 'use') and c.path <> s.path")
def q166(spark, d):
    f = files(spark, d)
    return O.store_users(O.stores(f), f)


_CALL = lambda p, u, m: f"select path, line, lines, {'upper(unnest(regexp_extract_all(text, ' + chr(39) + _Q(p) + chr(39) + f', {m})))' if m else chr(39) + 'GET' + chr(39)} as method, unnest(regexp_extract_all(text, '{_Q(p)}', {u})) as url from l"


@query("q167_endpoint_calls", f"with {_LINES}, k as ({' union '.join(_CALL(*c) for c in O.CALLS)}) select path, line, method, url, nullif(regexp_extract(array_to_string(lines[greatest(1, line - 5) : line + 2], chr(10)), '{O.HOOK}', 1), '') as hook from k where starts_with(url, '/api/') or starts_with(url, 'http')")
def q167(spark, d):
    return O.endpoint_calls(files(spark, d))


@query("q101_libraries", f"with {_C} " + " union all ".join(f"select '{n}' as library, count(*) as files from c where regexp_matches(text, '{_Q(p)}') having count(*) > 0" for n, p in O.LIBRARIES))
def q101(spark, d):
    return O.libraries(files(spark, d))


@query("q100_env_leaks", rf"with l as ({C.LINES}), k as (select replace(path, 'src/', 'src/components/') as path, unnest(regexp_extract_all(text, 'process\.env\.([A-Z0-9_]+)', 1)) as key from l) select distinct path, key from k where not starts_with(key, 'NEXT_PUBLIC_') and key <> 'NODE_ENV'")
def q100(spark, d):
    lines = C.relation(spark, d, C.LINES).select(F.replace("path", F.lit("src/"), F.lit("src/components/")).alias("path"), "text")
    return O.env_leaks(lines).distinct()


_GATED = "select p_partkey as id, cast(p_partkey as string) as path, case p_partkey % 5 when 0 then 'ok {}' when 1 then 'a' || chr(1) when 2 then repeat('{', 101 + p_size) when 3 then ' ' || chr(10) else repeat('x', 1048560 + p_size) end as text from part where p_partkey % 97 < 6"


@query("q105_parser_gate", f"with f as ({_GATED}) select path, case when trim(regexp_replace(text, '\\s', '', 'g')) = '' then 'blank' when regexp_matches(text, '{O.CONTROL}') then 'control_characters' when length(text) > {O.LARGEST} then 'too_large' when abs(length(replace(text, '{{', '')) - length(replace(text, '}}', ''))) > 100 then 'unbalanced' else 'ok' end as gate from f")
def q105(spark, d):
    return O.parser_gate(C.relation(spark, d, _GATED))


@query("q103_module_graph", rf"""with {_C}, w as (select path as src, unnest(regexp_extract_all(text, 'from [''"]\./([^''"]+)[''"]', 1)) as x from c), k as (select path as dst, regexp_replace(path, '\.[^./]+$', '') as stem from c) select distinct src, dst from w join k on {_DIR('src')} || '/' || x = k.stem""")
def q103(spark, d):
    return O.module_graph(files(spark, d))


_MARKED = "select p_partkey as node from part where p_size = 1 and p_partkey < 400"


@query("q50_client_propagation", f"with recursive e as (select distinct src, dst from ({C.MODULES}) m), r(node) as ({_MARKED} union select e.dst from r join e on e.src = r.node) select node from r")
def q50(spark, d):
    """Modules that become client code through their importers, however far."""
    marked = table(spark, d, "part").filter("p_size = 1 and p_partkey < 400").select(F.col("p_partkey").alias("node"))
    return G.client_modules(marked, C.relation(spark, d, C.MODULES))


_REACHED = f"with recursive e as (select distinct src, dst from ({C.MODULES}) m), {_C}, r(node) as (select 1::bigint union select e.dst from r join e on e.src = r.node), i as (select id as node, regexp_extract(text, 'from \"([^\"]+)\"', 1) as name from c), w as (select * from (values {C.WEIGHTS}) t(name, size)), m as (select node, p_size % 4 = 0 as client from r join part on p_partkey = node)"
_USED = "u as (select w.name, w.size, count(distinct i.node) as files, count(distinct case when m.client then i.node end) as client_files from i join w on i.name = w.name or starts_with(i.name, w.name || '/') join m on m.node = i.node group by 1, 2)"


def _bundle(spark, d):
    nodes = G.reachable(values(spark, "(1L)", "node"), C.relation(spark, d, C.MODULES)).select("node")
    modules = nodes.join(table(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 4 == 0).alias("client")), "node")
    imports = files(spark, d).select(F.col("id").alias("node"), F.regexp_extract("text", 'from "([^"]+)"', 1).alias("name"))
    return modules, imports, values(spark, C.WEIGHTS, "name, size")


@query("q51_bfs_dep_weight", f"{_REACHED}, {_USED} select name, size, files, client_files, (select sum(size) from u)::bigint as total, (select coalesce(sum(size) filter (client_files > 0), 0) from u)::bigint as client_total from u order by size desc, name limit 10")
def q51(spark, d):
    """What the modules that part 1 leads to import, by weight."""
    return G.bundle(*_bundle(spark, d))


@query("q168_split_candidates", f"{_REACHED} select i.node, sum(w.size)::bigint as saves from i join w on i.name = w.name or starts_with(i.name, w.name || '/') join r on r.node = i.node where w.size > 100 group by 1 having sum(w.size) > 50")
def q168(spark, d):
    return G.split_candidates(*_bundle(spark, d))


_SYM = f"s as ({C.SYMBOLS})"
_NEARNESS = "case when here = there then 0.9 when contains(here, there) or contains(there, here) then 0.7 else 0.5 end::double"
_FIRST = f"f as (select lower(name) as key_, min(id) as id, arg_min(file, id) as at_ from s group by 1)"
_CHOSEN = f"ch as (select id, file from s where id % 50 = 0), sy as (select ch.id, ch.file, t.name from ch join (select distinct id, target from ({C.USES}) x) u on ch.id = u.id join s t on t.id = u.target)"


def _chunks(spark, d):
    s = C.relation(spark, d, C.SYMBOLS)
    uses = C.relation(spark, d, C.USES).select(F.col("id").alias("by"), "target").distinct()
    names = uses.join(s.select(F.col("id").alias("target"), "name"), "target").groupBy("by").agg(F.collect_set("name").alias("symbols"))
    chosen = s.filter("id % 50 = 0").select("id", "file").join(names, F.col("id") == F.col("by")).select("id", "file", "symbols")
    return chosen, s.select("id", "file", "name")


@query("q12_one_hop_expansion", f"with {_SYM}, {_FIRST}, {_CHOSEN}, u as (select name, arg_min(file, id) as file from sy group by name), p as (select f.id, {_DIR('u.file')} as here, {_DIR('f.at_')} as there from u join f on lower(u.name) = f.key_ where f.id not in (select id from ch)) select id, round(max({_NEARNESS}) * 0.8::double, 6) as score from p group by id")
def q12(spark, d):
    """From the symbols whose id 50 divides to the definitions of what they use, at 0.8 of their score."""
    return G.one_hop(*_chunks(spark, d))


@query("q11_anchor_enforcement", f"with {_SYM}, {_FIRST}, {_CHOSEN}, a as (select distinct name as anchor from s where id % 7 = 0), h as (select a.anchor, min(sy.id) as by_, arg_min(sy.file, sy.id) as file from a join sy on contains(sy.name, a.anchor) group by 1), p as (select h.anchor, f.id, {_DIR('h.file')} as here, {_DIR('f.at_')} as there from h join f on lower(h.anchor) = f.key_ where f.id not in (select id from ch)) select anchor, id, greatest({_NEARNESS}, 0.5::double) as score from p")
def q11(spark, d):
    """The definitions of anchors that the chosen chunks' symbols hold."""
    chosen, chunks = _chunks(spark, d)
    return G.enforce_anchors(chosen, chunks, chunks.filter("id % 7 = 0").select(F.col("name").alias("anchor")).distinct())


_DIV = lambda words: f"""regexp_matches(text, 'class(?:Name)?=["''](?:{words})') and contains(text, '<div')"""
_SEMANTIC = {
    "A11Y-SEMANTIC-HEADING": _DIV("title|heading|headline|header"), "A11Y-SEMANTIC-NAV": _DIV("nav|navigation|menu"), "A11Y-LABEL-FOR": r"len(list_filter(regexp_extract_all(text, '<label\s+([^>]*)>', 1), lambda a: not regexp_matches(a, '[fF]or\s*='))) > 0",
    "A11Y-ROLE-BUTTON-KEYS": r"""regexp_matches(text, '<[^>]*role\s*=\s*["'']button["''][^>]*>') and not regexp_matches(text, 'onKey(Down|Up|Press)\s*=')""",
}


@query("q192_semantic_findings", f"with {_LINES} " + " union all ".join(f"select path, line, '{rule}' as rule from l where {cond}" for rule, cond in _SEMANTIC.items()))
def q192(spark, d):
    return O.semantic_findings(files(spark, d))


@query("q193_heavy_imports", f"with {_C}, i as (select distinct path, unnest(regexp_extract_all(text, 'from\\s+[''\"]([^''\"]+)[''\"]', 1)) as name from c where {_USE}) select distinct path, h as library from i, (select unnest([{', '.join(repr(h) for h in O.HEAVY)}]) as h) w where name = h or starts_with(name, case when ends_with(h, '/') then h else h || '/' end)")
def q193(spark, d):
    return O.heavy_imports(files(spark, d))


_ROUTED = "select p_partkey as id, 'app/' || case p_partkey % 4 when 0 then '' when 1 then 'users/' when 2 then 'cart/' else 'docs/' end || 's' || cast(p_size % 9 as string) || case p_partkey % 3 when 0 then '/page.tsx' when 1 then '/route.ts' else '/util.ts' end as path from part"


@query("q194_route_table", f"with f as ({_ROUTED}), r as (select regexp_extract(path, '^app(/.*)/[^/]*$', 1) as route, regexp_extract(path, '(?:^|/)({'|'.join(O.PARTS)})\\.[tj]sx?$', 1) as part from f) select route, string_agg(distinct part, ',' order by part) as parts, count(*) as files from r where part <> '' group by route")
def q194(spark, d):
    from tessera.functions.text import route_path

    return O.route_table(C.relation(spark, d, _ROUTED).filter("not path like '%util%'"), route_path(F.col("path")))


@query("q195_path_candidates", f"with f as ({C.FILES}) select path, 'ComponentFile' as symbol, 0.6::double as score from f where regexp_matches(path, '(?i)\\.(tsx|jsx)$|/components/') union all select path, 'DbSchema', 0.8::double from f where regexp_matches(lower(path), '\\.(prisma|sql)$') or contains(lower(path), '/db/')")
def q195(spark, d):
    return O.path_candidates(C.relation(spark, d, C.FILES))


@query("q196_returned_symbols", f"with s as ({C.SYMBOLS}), r as (select id, regexp_extract_all(body, '\\breturn\\s+([A-Za-z_$][\\w$]*)', 1) as x from s where body is not null) select id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i)[1:5], ',') as returned from r")
def q196(spark, d):
    from tessera.operators.detectors import returned_symbols

    return C.relation(spark, d, C.SYMBOLS).filter("body is not null").select("id", F.array_join(returned_symbols(F.col("body")), ",").alias("returned"))
