"""Detectors over source files (path, text): accessibility, environment, libraries, modules, naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import beginnings, holding, meeting

#: Libraries of looks and what in a file shows them.
LIBRARIES = (
    ("tailwind", r"tailwindcss|className=[\"'](flex|grid|block|inline|hidden|p-|m-|w-|h-|text-|bg-|border|rounded|shadow|hover:|focus:)"), ("shadcn", "@/components/ui/|shadcn/ui"), ("radix", "@radix-ui/"), ("lucide", "lucide-react"),
    ("cva", r"class-variance-authority|cva\(|cx\("), ("variants", r"tailwind-variants|tv\("), ("css-modules", r"\.module\.(css|scss|sass)"), ("styled", r"styled-components|styled\."), ("emotion", "@emotion/(styled|react)"),
)
#: Interfaces of the browser, whose use makes a component client code.
CLIENT = (
    "useState", "useEffect", "useRef", "useLayoutEffect", "useCallback", "useMemo", "useContext", "useReducer", "useImperativeHandle", "useDebugValue", "window", "document", "localStorage", "sessionStorage", "indexedDB",
    "navigator.storage", "caches", "AsyncStorage", "SecuredStorage", "SecureStore", "addEventListener", "removeEventListener", "setTimeout", "setInterval", "onClick", "onChange", "onSubmit", "onMouse", "onKey",
)
#: How components and stores are defined: (kind, pattern).
COMPONENT = (r"(?:export\s+)?(?:const|function)\s+([A-Z][a-zA-Z0-9]*)\s*(?:\([^)]*\))?\s*(?:=>\s*)?\{", r"(?:export\s+)?const\s+([A-Z][a-zA-Z0-9]*)\s*=\s*(?:\([^)]*\)\s*=>|function)")
STORES = (
    ("zustand", r"const\s+(\w+)\s*=\s*create\s*\("), ("redux", r"const\s+(\w+)\s*=\s*configureStore\s*\("), ("slice", r"const\s+(\w+)\s*=\s*createSlice\s*\("), ("context", r"const\s+(\w+)\s*=\s*createContext\s*\("),
    ("atom", r"const\s+(\w+)\s*=\s*atom\s*\("), ("selector", r"const\s+(\w+)\s*=\s*selector\s*\("),
)
#: Calls of endpoints: (pattern, group of the address, group of the method or 0).
CALLS = (
    (r"(?i)fetch\s*\(\s*['\"`]([^'\"`]+)['\"`]\s*,\s*\{\s*method:\s*['\"`]([^'\"`]+)['\"`]", 1, 2), (r"(?i)fetch\s*\(\s*['\"`]([^'\"`]+)['\"`]\s*\)", 1, 0),
    (r"(?i)axios\.(get|post|put|patch|delete|head|options)\s*\(\s*['\"`]([^'\"`]+)['\"`]", 2, 1),
)
HOOK = r"\b(use(?:Query|Mutation|InfiniteQuery|SWR))\s*\("
#: Libraries that are heavy for a client.
HEAVY = (
    "monaco-editor", "three", "chart.js", "d3", "xlsx", "pdfjs-dist", "highlight.js", "@codemirror/", "react-ace", "recharts", "echarts", "react-pdf", "react-table", "ag-grid", "react-virtualized", "react-window", "framer-motion",
    "react-spring", "react-transition-group", "react-beautiful-dnd", "react-dnd", "react-color", "react-datepicker", "react-select", "react-draft-wysiwyg", "leaflet", "mapbox-gl", "react-leaflet", "react-map-gl", "video.js", "plyr",
    "hls.js", "react-player", "swiper", "react-slick", "react-responsive-carousel",
)
#: Files that a framework gives a part in a route.
PARTS = ("page", "layout", "route", "loading", "error", "not-found", "template", "default")
#: Largest text that is parsed, and characters that aren't in one.
LARGEST, CONTROL = 1024 * 1024, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def _numbered_lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text, lines (all of the file) of files (path, text)."""
    rows = files.select("path", F.split("text", "\n").alias("lines"))
    return rows.select("path", "lines", F.posexplode("lines").alias("p", "text")).select("path", (F.col("p") + 1).alias("line"), "text", "lines")


def aria_findings(files: DataFrame) -> DataFrame:
    """path, line, rule, found: buttons and inputs without a name, and elements in the role of a button; a label within three lines names an input."""
    rows = _numbered_lines(files.filter(F.col("path").rlike(r"\.[tj]sx$")))
    named = lambda a: a.rlike(r"aria-label\s*=") | a.rlike(r"aria-labelledby\s*=")
    each = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    near = F.slice("lines", F.greatest(F.lit(1), F.col("line") - 3), F.when(F.col("line") > 3, 7).otherwise(F.col("line") + 3))

    def labelled(a: Column) -> Column:
        i = F.regexp_extract(a, r"id\s*=\s*[\"']([^\"']+)[\"']", 1)
        return (i != "") & F.exists(near, lambda x: x.contains(F.concat(F.lit('for="'), i, F.lit('"'))) | x.contains(F.concat(F.lit("for='"), i, F.lit("'"))))

    bad = {
        "A11Y-ICON-BUTTON-LABEL": F.filter(each(r"<button\s+([^>]*)>"), lambda a: ~named(a)),
        "A11Y-LABEL-FOR": F.filter(each(r"<input\s+([^>]*type\s*=\s*[\"'](?:text|email|password|search|tel|url|number)[\"'][^>]*)>"), lambda a: ~named(a) & ~labelled(a)),
        "A11Y-ROLE-BUTTON": F.filter(each(r"role\s*=\s*[\"']button[\"']\s+([^>]*)>"), lambda a: ~named(a)),
    }
    counts = F.array(*[F.struct(F.lit(rule).alias("rule"), F.size(a).alias("found")) for rule, a in bad.items()])
    found = rows.select("path", "line", F.explode(F.filter(counts, lambda c: c["found"] > 0)).alias("c"))
    return found.select("path", "line", "c.rule", "c.found")


def component_kind(text: Column) -> Column:
    """client for marked files and those that use the browser, else server."""
    use = text.contains("'use client'") | text.contains('"use client"')
    for name in CLIENT:
        use = use | text.contains(name)
    return F.when(use, "client").otherwise("server")


def components(files: DataFrame) -> DataFrame:
    """path, name, kind, hooks, forms, tables, modals of each component in files (path, text) that handle no route."""
    names = F.array_distinct(F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in COMPONENT]))
    hooks = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(use[A-Z][a-zA-Z0-9]*)\s*\("), F.lit(1))))
    text = F.col("text")
    rows = files.filter(~F.col("path").contains("/route.")).select(
        "path", F.explode(names).alias("name"), component_kind(text).alias("kind"), F.array_join(hooks, ",").alias("hooks"), text.rlike('<form|onSubmit=|type="submit"').alias("forms"),
        text.rlike("<table|<Table|<DataTable").alias("tables"), text.rlike("<Modal|<Dialog|<AlertDialog|<Sheet").alias("modals"),
    )
    return rows


def components_by_route(found: DataFrame, routes: DataFrame) -> DataFrame:
    """path, name, route of components (path, name): the first route (ordinal, route, file) whose folder their folder begins with, else ``/``.

    Folders of components are cut into their beginnings, which meet the
    routes' folders by equality.
    """
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    dirs = found.select(folder(F.col("path")).alias("dir")).distinct()
    starts = dirs.select("dir", F.explode(beginnings(F.col("dir"))).alias("route_dir"))
    first = routes.filter("route <> '/'").groupBy(folder(F.col("file")).alias("route_dir")).agg(F.min(F.struct("ordinal", "route")).alias("r"))
    best = starts.join(first, "route_dir").groupBy("dir").agg(F.min("r")["route"].alias("route"))
    return found.withColumn("dir", folder(F.col("path"))).join(best, "dir", "left").select("path", "name", F.coalesce("route", F.lit("/")).alias("route"))


def stores(files: DataFrame) -> DataFrame:
    """path, name, kind of the stores that files (path, text) define."""

    def named(kind: str):
        return lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"))

    found = [F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), named(kind)) for kind, p in STORES]
    return files.select("path", F.explode(F.array_distinct(F.concat(*found))).alias("s")).select("path", "s.name", "s.kind")


def store_users(defined: DataFrame, files: DataFrame) -> DataFrame:
    """name, store, path: other files (path, text) that hold a store's name and the word use."""
    held = holding(files.filter(F.col("text").contains("use")).select(F.col("path").alias("id"), "text"), defined)
    stored = defined.select("name", F.col("path").alias("store")).distinct()
    return meeting(held, stored, "name").filter("id <> store").select("name", "store", F.col("id").alias("path"))


def endpoint_calls(files: DataFrame) -> DataFrame:
    """path, line, method, url, hook of calls in files (path, text): the hook is one that stands up to five lines before or two after."""
    rows = _numbered_lines(files)

    def calls(pattern: str, url: int, method: int) -> Column:
        urls = F.regexp_extract_all("text", F.lit(pattern), F.lit(url))
        methods = F.regexp_extract_all("text", F.lit(pattern), F.lit(method)) if method else F.transform(urls, lambda u: F.lit("GET"))
        return F.zip_with(urls, methods, lambda u, m: F.struct(F.upper(m).alias("method"), u.alias("url")))

    near = F.slice("lines", F.greatest(F.lit(1), F.col("line") - 5), F.when(F.col("line") > 5, 8).otherwise(F.col("line") + 2))
    hook = F.regexp_extract(F.array_join(near, "\n"), HOOK, 1)
    found = F.filter(F.array_distinct(F.concat(*[calls(*c) for c in CALLS])), lambda c: c["url"].startswith("/api/") | c["url"].startswith("http") | c["url"].contains("${") | c["url"].contains(":/"))
    return rows.select("path", "line", F.explode(found).alias("c"), F.nullif(hook, F.lit("")).alias("hook")).select("path", "line", "c.method", "c.url", "hook")


def page_findings(pages: DataFrame) -> DataFrame:
    """Accessibility and security findings of a page: images without alt, outside links without rel, no first heading, no main landmark."""
    n = lambda p: F.regexp_count("html", F.lit(p))
    images, with_alt = n(r"<img\b[^>]*>"), n(r"<img\b[^>]*\balt=[^>]*>")
    outside, safe = n(r'<a\b[^>]*href="https?://[^>]*>'), n(r'<a\b[^>]*href="https?://[^>]*\brel=[^>]*>')
    low = F.lower("html")
    rules = F.array_compact(F.array(F.when(images > with_alt, "A11Y-IMG-ALT"), F.when(outside > safe, "SEC-001"), F.when(~low.contains("<h1"), "A11Y-H1"), F.when(~low.contains("<main"), "A11Y-MAIN")))
    return pages.select("page_id", F.explode(rules).alias("rule"))


def env_leaks(files: DataFrame) -> DataFrame:
    """Environment names used in client files without the public prefix."""
    keys = F.regexp_extract_all("text", F.lit(r"process\.env\.([A-Z0-9_]+)"), F.lit(1))
    used = files.filter(F.col("text").contains("use client") | F.col("path").rlike(r"components/")).select("path", F.explode(F.array_distinct(keys)).alias("key"))
    return used.filter(~F.col("key").startswith("NEXT_PUBLIC_") & (F.col("key") != "NODE_ENV"))


def libraries(files: DataFrame) -> DataFrame:
    """Which libraries a project shows, and in how many files."""
    tags = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), n) for n, p in LIBRARIES]))
    return files.select("path", F.explode(tags).alias("library")).groupBy("library").agg(F.count_distinct("path").alias("files"))


def module_graph(files: DataFrame) -> DataFrame:
    """Import edges (src, dst): relative imports resolved against the files that there are."""
    target = F.regexp_extract_all("text", F.lit(r"""from ['"]\./([^'"]+)['"]"""), F.lit(1))
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    wanted = files.select(F.col("path").alias("src"), F.explode(F.transform(target, lambda t: F.concat(folder, t))).alias("stem"))
    known = files.select(F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"), F.col("path").alias("dst"))
    return wanted.join(known, "stem").select("src", "dst").distinct()


def unique_names(rows: DataFrame) -> DataFrame:
    """Names made unique by a number from the second on."""
    w = Window.partitionBy("name").orderBy("id")
    n = F.row_number().over(w)
    return rows.select("id", F.when(n == 1, F.col("name")).otherwise(F.concat("name", n.cast("string"))).alias("unique_name"))


def parser_gate(files: DataFrame) -> DataFrame:
    """Whether a file is safe to parse: not blank, no control characters, at most 1 MiB, braces nearly balanced."""
    text = F.col("text")
    odd = F.abs(F.regexp_count("text", F.lit(r"\{")) - F.regexp_count("text", F.lit(r"\}"))) > 100
    gate = F.when(F.trim(F.regexp_replace(text, r"\s", "")) == "", "blank").when(text.rlike(CONTROL), "control_characters").when(F.length(text) > LARGEST, "too_large").when(odd, "unbalanced").otherwise("ok")
    return files.select("path", gate.alias("gate"))


def semantic_findings(files: DataFrame) -> DataFrame:
    """path, line, rule of lines in files (path, text) that use plain elements for headings and navigation, labels for nothing, and buttons that no key reaches."""
    rows = _numbered_lines(files.filter(F.col("path").rlike(r"\.[tj]sx$")))
    text = F.col("text")
    named = lambda words: text.rlike(rf"class(?:Name)?=[\"'](?:{words})") & text.contains("<div")
    labels = F.regexp_extract_all("text", F.lit(r"<label\s+([^>]*)>"), F.lit(1))
    rules = {
        "A11Y-SEMANTIC-HEADING": named("title|heading|headline|header"), "A11Y-SEMANTIC-NAV": named("nav|navigation|menu"), "A11Y-LABEL-FOR": F.exists(labels, lambda a: ~a.rlike(r"[fF]or\s*=")),
        "A11Y-ROLE-BUTTON-KEYS": text.rlike(r"<[^>]*role\s*=\s*[\"']button[\"'][^>]*>") & ~text.rlike(r"onKey(Down|Up|Press)\s*="),
    }
    fired = F.array_compact(F.array(*[F.when(hit, rule) for rule, hit in rules.items()]))
    return rows.select("path", "line", F.explode(fired).alias("rule"))


def heavy_imports(files: DataFrame) -> DataFrame:
    """path, library: heavy libraries that client code among files (path, text) imports."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"from\s+['\"]([^'\"]+)['\"]"), F.lit(1)))
    rows = files.filter(component_kind(F.col("text")) == "client").select("path", F.explode(names).alias("name"))
    hits = F.array_compact(F.array(*[F.when(F.col("name").startswith(h) if h.endswith("/") else (F.col("name") == h) | F.col("name").startswith(h + "/"), h) for h in HEAVY]))
    return rows.select("path", F.explode(hits).alias("library")).distinct()


def route_table(files: DataFrame, route: Column) -> DataFrame:
    """route, parts, files: which parts (page, layout, ...) the files (path) of each route have."""
    part = F.regexp_extract("path", r"(?:^|/)(" + "|".join(PARTS) + r")\.[tj]sx?$", 1)
    rows = files.select(route.alias("route"), part.alias("part")).filter("part <> ''")
    return rows.groupBy("route").agg(F.array_join(F.array_sort(F.collect_set("part")), ",").alias("parts"), F.count("*").alias("files"))


def path_candidates(files: DataFrame) -> DataFrame:
    """path, symbol, score of files (path) that a question about components or schemas is likely about."""
    low = F.lower("path")
    found = F.array_compact(F.array(
        F.when(F.col("path").rlike(r"(?i)\.(tsx|jsx)$|/components/"), F.struct(F.lit("ComponentFile").alias("symbol"), F.lit(0.6).alias("score"))),
        F.when(low.rlike(r"\.(prisma|sql)$") | low.contains("/db/migrate/") | low.contains("/migrations/") | low.contains("/db/"), F.struct(F.lit("DbSchema").alias("symbol"), F.lit(0.8).alias("score"))),
    ))
    return files.select("path", F.explode(found).alias("c")).select("path", "c.symbol", "c.score")
