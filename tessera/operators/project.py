"""Projects: which files count, what they show, and what is risky about them.

Files are rows of (path, size, ...); exports of (name, file); routes of
(method, path, file); environment keys of (key, file); lines of (path, line, text).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.symbols import any_of

#: Parts of paths that are not of the application.
NOT_APP = ("/test", "/tests", "/__tests__", "/spec", ".test.", ".spec.", "/jest.", "/scripts/", "/tooling/", "/mocks/", "/fixtures/")
#: What is ignored in a discovery, and the extensions it looks for.
IGNORED = ("node_modules", ".git", "dist", "build", ".next", "__pycache__", "*.min.js", "*.bundle.js", ".env*")
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".md")
SERVERISH = r"(/|^)(api|server|mcpServer|worker|lib|core|utils|services|handlers|middleware)/"
#: Names too general for an interface, of elements, and of request methods.
GENERIC = ("default", "index", "config", "props", "children", "value", "data", "item", "element", "component", "wrapper", "container", "render")
NOISE = ("render", "handler", *GENERIC[:12])
ELEMENTS = r"(?i)^(button|card|modal|dialog|input|form|label|text|icon|image)$"
HOOKS = r"^(use[A-Z]|with[A-Z]|create[A-Z].*Component)"
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
#: What a folder is for, by its name: (parts, purpose, confidence), tried in order.
FOLDERS = (
    (("api", "route"), "API endpoints and routing logic", 0.9), (("component",), "UI components and reusable elements", 0.9), (("service",), "Business logic and external service integrations", 0.85),
    (("test", "spec"), "Test files and testing utilities", 0.95), (("util", "helper"), "Utility functions and helper modules", 0.8), (("config",), "Configuration files and settings", 0.9),
    (("model", "schema"), "Data models and schema definitions", 0.85),
)
#: Extensions that a language brings, and those that never surprise.
EXPECTED = {"typescript": (".ts", ".tsx", ".js", ".jsx", ".json", ".md"), "javascript": (".ts", ".tsx", ".js", ".jsx", ".json", ".md"), "python": (".py", ".txt", ".md", ".yml", ".yaml"), "markdown": (".md",), "json": (".json",)}
USUAL = ("", ".lock", ".sum", ".mod", ".gitignore", ".dockerignore")
#: Domains, operations and integrations, and what in a name shows them.
DOMAINS = (
    ("authentication", "auth|login|token|session"), ("search", "search|index|query|find"), ("embeddings", "embed|vector|semantic"), ("storage", "db|database|store|persist"), ("files", "file|upload|download|blob"),
    ("api", "api|endpoint|route|handler"), ("user-management", "user|account|profile"), ("configuration", "config|setting|env"), ("tools", "tool|command|action"), ("caching", "cache|memory|redis"),
)
OPERATIONS = (
    ("create", "create|add|insert|save|store"), ("read", "get|read|fetch|load|retrieve"), ("update", "update|modify|edit|change"), ("delete", "delete|remove|destroy"), ("search", "search|query|find|filter"),
    ("validation", "validate|verify|check"), ("transformation", "transform|convert|parse|format"), ("synchronization", "sync|replicate|backup"),
)
INTEGRATIONS = (
    ("ai-services", "openai|anthropic|claude"), ("backend-as-service", "supabase|firebase"), ("database", "postgres|mysql|mongo"), ("caching", "redis|cache"), ("payments", "stripe|payment"),
    ("cloud-services", "aws|azure|gcp|s3"), ("email-services", "smtp|email|sendgrid"), ("version-control", "github|gitlab|git"),
)
#: Tags of an architecture and the parts of imports that show them.
ARCHITECTURE = (
    ("express", "express"), ("fastify", "fastify"), ("nextjs", "next"), ("react", "react"), ("vue", "vue"), ("prisma", "prisma"), ("drizzle", "drizzle"), ("typeorm", "typeorm"), ("sequelize", "sequelize"),
    ("knex", "knex"), ("kysely", "kysely"), ("objection", "objection"), ("orm", "prisma|drizzle|typeorm|sequelize|knex|kysely|objection"), ("postgresql", "postgres|pg|supabase-js"), ("mongodb", "mongo|mongoose"),
    ("redis", "redis"), ("supabase", "supabase"), ("dynamodb", "dynamodb"), ("firestore", "firestore|firebase"), ("faunadb", "fauna"), ("planetscale", "planetscale"), ("cassandra", "cassandra"), ("couchdb", "couchdb|pouchdb"),
    ("graph-db", "neo4j|gremlin"), ("arangodb", "arangodb"), ("dgraph", "dgraph"), ("vector-db", "pinecone|weaviate|qdrant|chroma|milvus|meilisearch|typesense|faiss"), ("localforage", "localforage"), ("indexeddb", "dexie"),
)
#: What shows a database engine, tried in order.
ENGINES = (
    ("postgres", r"(?i)from\s+['\"]pg['\"]|import.*pg\b|from\s+['\"]postgres['\"]|import.*postgres|DATABASE_URL.*postgres|POSTGRES_URL|\.query\s*\(\s*['\"`]SELECT"),
    ("mysql", r"(?i)from\s+['\"]mysql2?['\"]|import.*mysql|MYSQL_URL|MYSQL_HOST|mysql\.createConnection"),
    ("sqlite", r"(?i)from\s+['\"](?:better-)?sqlite3?['\"]|import.*sqlite|\.sqlite|\.db['\"`]|SQLITE_"),
    ("mongodb", r"(?i)from\s+['\"]mongodb?['\"]|import.*mongo|MONGODB_URI|MONGO_URL|MongoClient|mongoose"),
    ("redis", r"(?i)from\s+['\"](?:io)?redis['\"]|import.*redis|REDIS_URL|createClient.*redis"),
    ("vector-chroma", r"(?i)from\s+['\"]chromadb['\"]|import.*chromadb|new\s+ChromaClient"),
)
#: Lines that are evidence of a database.
EVIDENCE = r"(?i)from\s+['\"](?:pg|postgres|mysql2?|mongodb|mongoose|redis)['\"]|import.*(?:pg|postgres|mysql|mongo|redis)\b|DATABASE_URL|POSTGRES_URL|MONGO_URL|REDIS_URL|\.query\s*\(|new\s+(?:pool|client|database)"
#: Patterns of entry points, configuration and documentation.
ENTRY = (r"index\.(ts|js|py)$", r"main\.(ts|js|py)$", r"app\.(ts|js|py)$", r"server\.(ts|js)$", r"__main__\.py$")
CONFIG = (r"package\.json$", r"tsconfig\.json$", r"\.env", r"config\.", r"settings\.", r"Cargo\.toml$", r"go\.mod$", r"requirements\.txt$")
DOCUMENTATION = r"(?i)README|CHANGELOG|\.md$|docs?/|CONTRIBUTING|LICENSE"
#: Risks of a repository: (rule, type, severity, points).
RISKS = {
    "ENV-001": ("security", "medium", 15), "ENV-FILE": ("security", "low", 5), "ENV-002": ("security", "high", 25), "API-AUTH-001": ("security", "medium", 20), "BUILD-001": ("maintenance", "low", 10),
    "LARGE-FILES": ("performance", "low", 10), "NO-TESTS": ("maintenance", "medium", 20), "NO-TSCONFIG": ("config", "medium", 15),
}


def extension(path: Column) -> Column:
    """With its dot, as it is written; empty where there is none."""
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def _tags(text: Column, rules, most: int | None = None) -> Column:
    found = F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in rules]))
    return F.slice(found, 1, most) if most else found


def is_documentation(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|txt|rst|adoc|asciidoc)$")


def is_not_app(path: Column) -> Column:
    return any_of(F.lower(path), NOT_APP)


def is_public_surface(path: Column) -> Column:
    """Server code, no tests, nothing built."""
    return path.rlike(SERVERISH) & ~path.rlike(r"(?i)(/|^)(__tests__|tests)/|\.(test|spec)\.|(/|^)(dist|build|out|coverage|\.next)/")


def is_client(path: Column) -> Column:
    app = path.rlike(r"/app/.*\.tsx?$") & ~path.rlike(r"/route\.tsx?$")
    pages = path.rlike(r"/pages/") & path.rlike(r"/pages/(?!api)")
    return path.rlike(r"/components/|/(web|client|frontend)/|/(portal|viewer|modals)/|/__tests__/|\.(test|spec)\.") | app | pages


def is_noise(name: Column, file: Column) -> Column:
    """Exports too general to say anything outside of server code, elements and hooks."""
    server = file.rlike(r"/(api|server|mcpServer|worker|lib|core|utils|services)/")
    return F.when(F.lower(name).isin(*NOISE), ~server).otherwise(name.rlike(ELEMENTS) | name.rlike(HOOKS))


def is_excluded_export(name: Column, file: Column) -> Column:
    """What is no public interface: general names outside of servers, elements, hooks, handlers of routes."""
    handler = F.upper(name).isin(*METHODS) & (file.contains("/api/") | file.rlike(r"/app/.*/route\.(ts|js)$"))
    return (F.lower(name).isin(*GENERIC) & ~file.rlike(SERVERISH)) | name.rlike(ELEMENTS) | name.rlike(HOOKS) | handler


def without_route_exports(exports: DataFrame, routes: DataFrame) -> DataFrame:
    """Exports (name, file) less request methods that stand in files of routes (file)."""
    files = routes.select(F.col("file").alias("route_")).distinct()
    rows = exports.join(files, F.col("file") == F.col("route_"), "left")
    routed = F.col("route_").isNotNull() | F.col("file").rlike(r"app/.*/route\.(ts|js)$") | F.col("file").contains("/api/")
    return rows.filter(~(F.upper("name").isin(*METHODS) & routed)).drop("route_")


def is_indexable(path: Column) -> Column:
    """No part of the path is of a build or a dependency, hidden, minified or a test."""
    parts = F.split(path, r"[/\\]")
    return ~F.exists(parts, lambda p: p.isin("node_modules", ".git", "dist", "build", ".next", "coverage") | p.startswith(".") | p.contains(".min.") | p.contains(".test.") | p.contains(".spec."))


def discovery_verdict(path: Column, size: Column, extensions=EXTENSIONS, largest: int = 10 * 1024 * 1024, ignored=IGNORED) -> Column:
    """ignored, extension, size or supported: why a file is taken or not."""
    skip = F.lit(False)
    for p in ignored:
        skip = skip | (path.rlike(re.escape(p).replace(r"\*", ".*")) if "*" in p else path.contains(p))
    return F.when(skip, "ignored").when(~extension(path).isin(*extensions), "extension").when(size > largest, "size").otherwise("supported")


def discover(files: DataFrame, most: int = 1000, **options) -> DataFrame:
    """One row: how many files were found, taken, and left out for each reason, in one pass; at most ``most`` are taken."""
    rows = files.select(discovery_verdict(F.col("path"), F.col("size"), **options).alias("v"))
    n = lambda v: F.count_if(F.col("v") == v)
    return rows.agg(F.count("*").alias("candidates"), n("ignored").alias("ignored"), n("extension").alias("extension_filtered"), n("size").alias("size_filtered"), F.least(n("supported"), F.lit(most)).alias("supported"))


def simply_ignored(path: Column, patterns: list[str]) -> Column:
    """Prefixes, ``folder/**``, and patterns whose ``*`` stands for anything, anywhere in the path."""
    out = path.startswith(".git") | path.startswith("node_modules") | path.startswith("dist")
    for p in patterns:
        if p.endswith("/**"):
            out = out | path.startswith(p[:-2]) | (path == p[:-3])
        if "*" in p:
            out = out | path.rlike(p.replace("*", ".*"))
        out = out | (path == p) | path.startswith(p + "/")
    return out


def file_header(text: Column) -> Column:
    """(type, content, lines): the comment a text begins with, else its first 15 lines."""
    lines = F.split(text, "\n")
    first = F.trim(lines[0])
    block = F.slice(lines, 1, 50)
    end = F.array_position(F.transform(block, lambda x: x.contains("*/")), True)
    mark = F.when(first.startswith("//"), "//").otherwise("#")
    # Comment lines and blank ones; what else stands among the first three is taken along.
    head = F.slice(lines, 1, 25)
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        comment = (F.trim(x) == "") | F.trim(x).startswith(mark)
        stop = s["done"] | (~comment & (s["n"] > 2))
        return F.struct(F.when(stop, s["n"]).otherwise(s["n"] + 1).alias("n"), stop.alias("done"))

    taken = F.aggregate(head, start, step)["n"]
    out = lambda kind, n: F.struct(F.lit(kind).alias("type"), F.array_join(F.slice(lines, 1, n), "\n").alias("content"), n.cast("int").alias("lines"))
    is_block, is_lines = first.startswith("/*") & (end > 0), (first.startswith("//") | first.startswith("#")) & (taken > 3)
    return F.when(is_block, out("comment", end)).when(is_lines, out("comment", taken)).otherwise(out("code", F.least(F.size(lines), F.lit(15))))


def size_text(size: Column) -> Column:
    """Bytes as a number with one decimal at most, and a unit."""
    power = F.least(F.when(size > 0, F.floor(F.log(1024.0, size.cast("double")) + 1e-12)).otherwise(0), F.lit(3)).cast("int")
    unit = F.get(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), power)
    number = F.regexp_replace(F.format_string("%.1f", F.floor(size / F.pow(F.lit(1024.0), power) * 10 + 0.5) / 10), r"\.0$", "")
    return F.when(size == 0, "0 B").otherwise(F.concat_ws(" ", number, unit))


def folder_hints(files: DataFrame) -> DataFrame:
    """folder, files, types, purpose, confidence of each folder with two files or more (path, language)."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = files.withColumn("folder", folder).filter("folder <> ''").groupBy("folder").agg(
        F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set(extension(F.col("path")))), ",").alias("types"), F.array_join(F.array_sort(F.collect_set("language")), "/").alias("languages")
    )
    name = F.lower(F.element_at(F.split("folder", "/"), -1))
    purpose, confidence = None, None
    for parts, text, c in FOLDERS:
        hit = any_of(name, parts)
        purpose, confidence = (F.when(hit, text), F.when(hit, c)) if purpose is None else (purpose.when(hit, text), confidence.when(hit, c))
    other = F.concat("languages", F.lit(" files - "), F.col("files").cast("string"), F.lit(" files"))
    return rows.filter("files >= 2").select("folder", "files", "types", purpose.otherwise(other).alias("purpose"), confidence.otherwise(0.4).alias("confidence"))


def coverage_insights(files: DataFrame, large: int = 1024 * 1024) -> DataFrame:
    """One row on files (path, size, mtime, language): folders, languages, extensions, large ones, days between the oldest and the newest, unexpected extensions."""
    folder, ext = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), extension(F.col("path"))
    days = F.ceil((F.unix_micros(F.max(F.col("mtime").cast("timestamp"))) - F.unix_micros(F.min(F.col("mtime").cast("timestamp")))) / 86_400_000_000)
    rows = files.agg(F.count("*").alias("files"), F.count_distinct(folder).alias("folders"), F.collect_set("language").alias("l"), F.collect_set(ext).alias("e"), F.count_if(F.col("size") > large).alias("large"), days.alias("days"))
    expected = F.array().cast("array<string>")
    for language, some in EXPECTED.items():
        expected = F.concat(expected, F.when(F.array_contains("l", language), F.array(*map(F.lit, some))).otherwise(F.array().cast("array<string>")))
    odd = F.array_sort(F.array_except(F.array_except("e", expected), F.array(*map(F.lit, USUAL))))
    return rows.select("files", "folders", F.size("l").alias("languages"), F.size("e").alias("extensions"), "large", "days", F.array_join(odd, ",").alias("unexpected"))


def composition(files: DataFrame, kept: Column) -> DataFrame:
    """Files of each extension, how many of them are kept and how many not."""
    return files.groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("all"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("left_out"))


def database_engine(text: Column) -> Column:
    """The first engine a text shows, or unknown."""
    out = None
    for name, pattern in ENGINES:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("unknown")


def database_vote(texts: DataFrame) -> DataFrame:
    """engine, votes: pieces of evidence in all texts (path, text) that show an engine; the first row is the winner."""
    rows = texts.select(database_engine(F.col("text")).alias("engine"), F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(EVIDENCE))).alias("n"))
    return rows.filter("engine <> 'unknown'").groupBy("engine").agg(F.sum("n").alias("votes")).orderBy(F.desc("votes"), "engine")


def repository_risks(files: DataFrame, env: DataFrame, exports: DataFrame) -> DataFrame:
    """rule, type, severity, points, files of each risk that fires: one aggregation of each input."""
    path, low = F.col("path"), F.lower("path")
    example = path.endswith(".env.example") | path.contains("/env.example")
    any_, n = (lambda c: F.coalesce(F.max(c), F.lit(False))), F.count_if
    web = path.contains("/web/") | path.contains("/components/") | (path.contains("/pages/") & ~path.contains("/pages/api/"))
    api = path.contains("/api/") | path.rlike(r"app/.*/route\.(ts|js)$")
    f = files.agg(
        any_(example).alias("example"), n(path.contains(".env") & ~path.contains(".env.example") & ~path.contains("/env.example")).alias("env_files"), n(api).alias("api"),
        any_(path.rlike("(?i)auth|middleware|guard|verify")).alias("auth_files"), n(any_of(low, ("/dist/", "/build/", "/.next/", "/out/"))).alias("built"), n(F.col("size") > 100_000).alias("large"),
        any_(path.rlike("(?i)test|spec")).alias("tests"), n(path.rlike(r"\.tsx?$")).alias("typescript"), any_(path.contains("tsconfig.json")).alias("tsconfig"),
    )
    server_only = ~(F.col("key").startswith("NEXT_PUBLIC_") | F.col("key").startswith("PUBLIC_") | F.col("key").startswith("VITE_"))
    leaks = files.filter(web).select("path").join(env.filter(server_only).select(F.col("file").alias("path")).distinct(), "path", "left_semi").agg(F.count("*").alias("leaks"))
    e = env.agg(F.count("*").alias("keys"))
    x = exports.agg(F.count("*").alias("exports"), any_(F.col("name").rlike("(?i)auth|verify|middleware|guard")).alias("auth_names"))
    row = f.crossJoin(leaks).crossJoin(e).crossJoin(x)  # one row each
    c = F.col
    fired = {
        "ENV-001": ((c("keys") > 0) & ~c("example"), c("keys")), "ENV-FILE": (c("env_files") > 0, c("env_files")), "ENV-002": (c("leaks") > 0, c("leaks")), "API-AUTH-001": ((c("api") > 0) & ~c("auth_files") & ~c("auth_names"), c("api")),
        "BUILD-001": (c("built") > 0, c("built")), "LARGE-FILES": (c("large") > 0, c("large")), "NO-TESTS": (~c("tests") & (c("exports") > 20), c("exports")), "NO-TSCONFIG": ((c("typescript") > 0) & ~c("tsconfig"), c("typescript")),
    }
    rows = [F.when(cond, F.struct(F.lit(rule).alias("rule"), *[F.lit(v).alias(k) for k, v in zip(("type", "severity", "points"), RISKS[rule], strict=True)], count.alias("files"))) for rule, (cond, count) in fired.items()]
    return row.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")


def capabilities(exports: DataFrame, routes: DataFrame, env: DataFrame) -> DataFrame:
    """kind, tag: at most ten domains, ten operations and eight integrations, those with the most evidence first."""
    low = F.lower("name")
    tagged = lambda df, kind, tags: df.select(F.lit(kind).alias("kind"), F.explode(tags).alias("tag"))
    kept = exports.filter(~is_noise(F.col("name"), F.col("file")))
    routed = F.array_compact(F.array(*[F.when(F.lower("path").rlike(p), t) for t, p in (("api", "/api/"), ("authentication", "/auth/"), ("user-management", "/user"), ("search", "/search"), ("files", "/file|/upload"))]))
    rows = tagged(kept, "domain", _tags(low, DOMAINS)).unionByName(tagged(routes, "domain", routed)).unionByName(tagged(kept, "operation", _tags(low, OPERATIONS)))
    rows = rows.unionByName(tagged(routes, "operation", F.array(F.lower("method")))).unionByName(tagged(env, "integration", _tags(F.lower("key"), INTEGRATIONS)))
    counted = rows.groupBy("kind", "tag").agg(F.count("*").alias("n"))
    # A few dozen tags by now.
    best = counted.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "tag"))).alias("t"))
    most = F.when(F.col("kind") == "integration", 8).otherwise(10)
    return best.select("kind", F.explode(F.slice("t", F.lit(1), most)).alias("x")).select("kind", "x.tag", (-F.col("x.m")).alias("evidence"))


def architecture_tags(imports: DataFrame) -> DataFrame:
    """tag, imports: what the imports (name) of a project show, and how many of them."""
    return imports.select(F.explode(_tags(F.lower("name"), ARCHITECTURE)).alias("tag")).groupBy("tag").agg(F.count("*").alias("imports"))


def file_roles(path: Column, size: Column) -> Column:
    """entry, config, documentation, key: what a file is to a project."""
    entry = path.rlike("|".join(ENTRY))
    config = path.rlike("|".join(CONFIG))
    key = any_of(path, ("index", "main", "app", "server", "config")) | (size > 10_000) | path.rlike(r"(^|/)(package\.json|tsconfig\.json|Dockerfile|README\.md)$")
    return F.array_compact(F.array(F.when(entry, "entry"), F.when(config, "config"), F.when(path.rlike(DOCUMENTATION), "documentation"), F.when(key, "key")))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: languages, frameworks by manifest, families of routers, of files (path, language)."""
    low = F.lower("path")
    shows = lambda c, tag: F.when(F.coalesce(F.max(c), F.lit(False)), tag)
    frameworks = [shows(low.endswith("package.json"), "node"), shows(low.rlike(r"(pyproject\.toml|requirements\.txt)$"), "python"), shows(low.endswith("go.mod"), "go"), shows(low.endswith("cargo.toml"), "rust"), shows(low.rlike(r"(pom\.xml|build\.gradle)$"), "java")]
    families = [shows(low.rlike(r"next/|app/.*/route\.(ts|js)"), "file_router"), shows(low.contains("api/"), "method_call_router")]
    text = lambda some: F.array_join(F.array_compact(F.array(*some)), ",")
    return files.agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), text(frameworks).alias("frameworks"), text(families).alias("families"))


def collapse_import(name: Column) -> Column:
    """What an import is listed as: interface kits and their ecosystem as one each, others as they are, null where they say nothing."""
    return (
        F.when(name.rlike(r"^(@/components/ui|shadcn/ui|lucide-react|@radix-ui)"), "ui-kit")
        .when(name.rlike(r"^(react|next/|@next/)"), "react-ecosystem")
        .when(name.rlike(r"^(\./|\.\./|pg|postgres|supabase|redis|ioredis|mongodb|mysql|express|fastify|koa|hapi|@anthropic|openai|claude|bullmq|agenda|node-cron|zod|joi|yup|ajv|dotenv|config)"), name)
    )


def index_stats(files: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: how many files, chunks and symbols there are."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(files, "files").crossJoin(n(chunks, "chunks")).crossJoin(n(symbols, "symbols"))


def telemetry_stats(events: DataFrame, by: list[str]) -> DataFrame:
    """Number, mean and percentiles of the values of each group."""
    q = lambda p, name: F.percentile("value", F.lit(p)).alias(name)
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), q(0.5, "p50"), q(0.95, "p95"), F.max("value").alias("most"))


def risk_recommendations(fired: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (rule, title, priority, reduction) that fired, with their number of files, by priority; and the order of the five that reduce the score most."""
    hits = fired.groupBy("rule").agg(F.count_distinct("file").alias("files"))
    rows = hits.join(rules, "rule").withColumn("urgency", F.when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3))
    top = rows.orderBy(F.desc("reduction"), "rule").limit(5).select(F.col("rule").alias("rule_"), F.lit(True).alias("top"))
    return rows.join(F.broadcast(top), F.col("rule") == F.col("rule_"), "left").select("rule", "title", "priority", "urgency", "files", F.coalesce("top", F.lit(False)).alias("action"))


def workspace_verdict(folders: DataFrame, most: int = 5000) -> DataFrame:
    """folder, verdict of folders (folder, files): a root or one with too many files is no workspace; one inside of a build is a doubtful one."""
    low = F.lower("folder")
    root = F.col("folder").rlike(r"^([A-Za-z]:)?[/\\]?$")
    built = low.rlike(r"(node_modules|dist|build|\.git|target|bin|obj)([/\\]|$)")
    return folders.select("folder", F.when(root, "root").when(F.col("files") > most, "too_many_files").when(built, "inside_build").otherwise("ok").alias("verdict"))
