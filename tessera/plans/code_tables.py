"""Relations of code made from the tables: every row of a table is a symbol, a file, a line or an edge.

Each is a SELECT that any SQL engine reads; the oracles use it as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.tables import table

_PREFIX = "case p_partkey % 14 when 0 then 'get' when 1 then 'create' when 2 then '_internal' when 3 then 'handle' when 4 then 'tmp' when 5 then 'validate' when 6 then 'main' when 7 then 'test' when 8 then 'error' when 9 then 'Service' when 10 then 'to' when 11 then 'setup' when 12 then 'MAX_' else 'Component' end"
#: Symbols: one for each part.
SYMBOLS = f"""select *,
    (case when p_size % 4 = 0 then 'async ' else '' end) || kind || ' ' || name || '(' || repeat('a: Map<K, V>,  ', p_size % 6) || 'b: Item): ' || (case when p_size % 8 = 0 then 'Promise<String>' else 'Result | null | Error' end) as signature,
    case when p_size % 7 = 0 then null else repeat('  run' || name || '(x); if (y) {{ load(z) }}' || chr(10), p_size % 14) || 'return Value' end as body,
    case when p_size % 3 = 0 then 'Returns the ' || p_name || repeat(' value', p_size % 9) end as doc
    from (select p_partkey as id, p_name, p_size, p_brand, p_retailprice,
        'src/' || case p_partkey % 5 when 0 then 'core' when 1 then 'local' when 2 then 'api' when 3 then 'tests' else 'utils' end || '/' || replace(lower(p_brand), '#', '') || case p_size % 3 when 0 then '.ts' when 1 then '.tsx' else '.js' end as file,
        case p_type when 'ECONOMY' then 'function' when 'SMALL' then 'class' when 'LARGE' then 'interface' when 'MEDIUM' then 'variable' when 'STANDARD' then 'type' else 'export' end as kind,
        {_PREFIX} || upper(substring(p_name, 1, 1)) || replace(substring(p_name, 2), ' ', '') as name,
        p_size % 2 = 0 as exported, p_size % 4 = 0 as is_async, p_size % 6 + 1 as parameters, cast((p_partkey + p_size) % 8 as int) as relations
        from part) s"""
#: What a symbol uses: one row for each line item.
USES = "select l_partkey as id, l_suppkey * 17 % 200 as target, l_orderkey as file_id from lineitem"
#: Files: one for each order.
FILES = """select o_orderkey as id, 'src/' || case o_orderkey % 11 when 0 then 'core/' when 1 then 'api/' when 2 then 'node_modules/pkg/' when 3 then 'services/auth/' when 4 then 'scripts/' when 5 then '.next/static/' when 6 then 'components/ui/' when 7 then '__tests__/' when 8 then 'docs/' when 9 then 'app/users/[id]/' else 'lib/db/' end
    || case o_orderkey % 7 when 0 then 'index' when 1 then 'userStore' when 2 then 'README' when 3 then 'config' when 4 then 'page' when 5 then 'api.test' else 'bundle.min' end || o_orderkey % 97
    || case o_orderkey % 6 when 0 then '.ts' when 1 then '.tsx' when 2 then '.md' when 3 then '.py' when 4 then '.json' else '.js' end as path,
    cast(floor(o_totalprice) as bigint) as size, o_orderdate as mtime, o_orderstatus as status, o_orderpriority as priority from orders"""
#: Lines of source: one for each part, of many kinds.
LINES = """select p_partkey as id, 'src/' || replace(lower(p_brand), '#', '') || '.ts' as path, case p_partkey % 20
    when 0 then 'import { Pool } from "pg"' when 1 then 'import React, { useState } from ''react''' when 2 then 'const db = new PrismaClient()' when 3 then 'export async function GET(req) { return db.query("SELECT 1") }'
    when 4 then 'const url = process.env.DATABASE_URL' when 5 then 'const key = process.env.NEXT_PUBLIC_KEY' when 6 then 'app.get("/users", handler)' when 7 then 'router.post(''/orders'', create)'
    when 8 then 'import mongoose from "mongoose"' when 9 then 'mongoose.connect(process.env.MONGO_URL)' when 10 then 'export const useStore = create((set) => ({}))' when 11 then 'const [a, b] = useState(0)'
    when 12 then 'export default class Item extends Base {' when 13 then 'fetch("/api/users")' when 14 then 'if (a && b) { throw new Error("x") }' when 15 then '// TODO: tidy up' when 16 then 'import express from "express"'
    when 17 then '<button onClick={go}><Icon /></button>' when 18 then 'import { helper } from "./util"' else 'return ' || p_name end as text from part"""

#: Files of components: one for each part.
COMPONENTS = """select p_partkey as id, 'app/' || case p_partkey % 4 when 0 then 'users/[id]' when 1 then '(shop)/cart' when 2 then 'api/items' else 'docs/list' end || '/' || case p_partkey % 5 when 0 then 'page' when 1 then 'Card' when 2 then 'route' when 3 then 'useThing' else 'store' end || cast(p_partkey as string) || '.tsx' as path,
    case when p_size % 4 = 0 then '"use client"' || chr(10) else '' end || 'import { Box } from "' || case p_size % 7 when 0 then '@radix-ui/react' when 1 then 'lucide-react' when 2 then 'chart.js/auto' when 3 then 'three' when 4 then './Card' || cast(p_partkey % 50 as string) when 5 then 'd3' else '@/components/ui/x' end || '"' || chr(10)
    || 'export function Part' || cast(p_partkey % 300 as string) || '(props) {' || chr(10) || case when p_size % 3 = 0 then '  const [a, b] = useState(0)' || chr(10) else '' end || case when p_size % 5 = 0 then '  const bag' || cast(p_partkey % 40 as string) || ' = create((set) => ({}))' || chr(10) else '' end
    || case when p_size % 6 = 1 then '  const q = useQuery({' || chr(10) else '' end || case when p_size % 4 = 1 then '  fetch("/api/items/' || cast(p_partkey % 9 as string) || '", { method: "post" })' || chr(10) when p_size % 4 = 2 then '  axios.get("/api/users")' || chr(10) else '' end
    || case when p_size % 8 = 3 then '  return bag' || cast(p_partkey % 40 as string) || '.use()' || chr(10) else '' end || case when p_size % 2 = 0 then '  <label for="f' || cast(p_size % 6 as string) || '">x</label>' || chr(10) || '  <hr>' || chr(10) else '' end
    || '  return <form className="flex"><button ' || case when p_size % 3 = 1 then 'aria-label="go" ' else '' end || 'onClick={go}></button>' || chr(10) || '  <input type="text" id="f' || cast(p_size % 5 as string) || '"> <div role="button" tabIndex={0}></div></form>' || chr(10) || '}' as text from part"""
#: Routes of components, and sizes of what they import.
ROUTES = "(1, '/', 'app/page.tsx'), (2, '/users/:id', 'app/users/[id]/page.tsx'), (3, '/cart', 'app/(shop)/cart/page.tsx'), (4, '/api', 'app/api/route.ts'), (5, '/do', 'app/do/page.tsx')"
WEIGHTS = "('three', 600), ('chart.js', 200), ('d3', 250), ('lucide-react', 40), ('@radix-ui/react', 60)"
#: Modules: a part imports the part that stands next to it in an order.
MODULES = "select a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1"
#: Logs: a line for each event, a log for each user.
LOG = """select user_id as log, event_id as line, case event_id % 9 when 0 then 'TypeError: x is not a function' when 1 then '    at run' || cast(event_id % 7 as string) || ' (src/local/f' || cast(event_id % 13 as string) || '.ts:' || cast(event_id % 90 + 1 as string) || ':12)'
    when 2 then '    at src/api/g' || cast(event_id % 5 as string) || '.ts:' || cast(event_id % 40 as string) || ':3' when 3 then 'ReferenceError: y' when 4 then '  File "b' || cast(event_id % 3 as string) || '.py", line ' || cast(event_id % 50 as string) || ', in go'
    when 5 then '  File "c.py", line 7' when 6 then 'SyntaxError: odd' when 7 then 'Error: ' || event_type else 'plain ' || event_type end as text, value from events"""
#: Matches: one for each line item.
MATCHES = "select l_orderkey * 10 + l_linenumber as id, 'src/local/f' || cast(l_suppkey % 17 as string) || '.ts' as file, 'run' || cast(l_partkey % 11 as string) as symbol, case when l_quantity > 10 then l_discount * 8 end as similarity from lineitem"
#: Markdown and keyed text: one for each document.
MARKDOWN = "select doc_id as id, replace(replace(replace(text, '. ', '.' || chr(10) || '## '), ', ', ' [l](u) '), 'and', '```x```') as text from documents"
KEYED = "select doc_id as id, replace(replace(text, ' ', ': '), '. ', chr(10) || '- ') as text from documents"
#: Rendered lists of similar chunks: one for each part.
SIMILAR = "select p_partkey as id, '# Result' || chr(10) || '### 1. src/' || p_type || '/a.ts (' || cast(p_size as string) || '.' || cast(p_partkey % 10 as string) || '% similar)' || chr(10) || 'text (3% similar)' || repeat(chr(10) || '### 2. lib/b.js (7.5% similar)', p_size % 3) as text from part"

_TABLE = re.compile(r"\bfrom (part|lineitem|orders|events|documents)\b")


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the above over the tables in a folder."""
    name = _TABLE.search(sql)[1]
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f"from {name}", "from {t}").replace(f"join {name}", "join {t}"), t=table(spark, sf_dir, name))
