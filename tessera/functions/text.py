"""Text expressions: estimators, excerpts, normalisers, rule chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decision points of cyclomatic complexity.
DECISIONS = (
    r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bwhile\s*\(", r"\bfor\s*\(", r"\bdo\s*\{", r"\bcase\s+", r"\bcatch\s*\(",
    r"&&", r"\|\|", r"\?\s*[^.\s]", r"\?\.", r"\?\?",
)
#: What is not code.
NOT_CODE = ((r"/\*[\s\S]*?\*/", ""), (r"(?m)//.*$", ""), (r"['`](?:[^'`\\]|\\.)*['`]", ""), (r'"(?:[^"\\]|\\.)*"', ""))
#: Topics and their patterns, tried in order.
TOPICS = (
    ("auth", r"\bauth(entication)?\b|login|token|session|jwt|oauth|supabase"),
    ("db", r"\b(db|database|prisma|sql|query|model)\b"),
    ("api", r"\bapi|endpoint|route|handler|controller\b"),
    ("state", r"\bstate|redux|context\s*api|use(state|reducer)\b"),
    ("components", r"\bcomponent|ui|view|page|jsx|template|sfc\b"),
    ("errors", r"\berror|exception|retry|circuit|fallback\b"),
    ("config", r"\bconfig|configuration|env|setting(s)?\b"),
)
#: Words that speak for a plan; the first of equal plans wins.
PLANS = (
    ("init-read-write", ("database", "storage", "db", "sqlite", "persist", "save", "query", "search", "index", "store", "connection", "local", "embedding")),
    ("api-route", ("api", "route", "endpoint", "handler", "controller", "server", "http", "request", "response")),
    ("auth", ("auth", "login", "session", "token", "jwt", "permission", "user", "password", "security")),
    ("error-driven", ("error", "exception", "fail", "bug", "issue", "debug", "trace", "problem")),
)
#: Words of the task types, the first type found wins.
TASKS = (("troubleshoot", ("error", "bug", "fix", "issue", "problem", "broken")), ("overview", ("overview", "structure", "architecture", "summary")))


def tokens_by_length(text: Column) -> Column:
    """A token for every four characters."""
    return F.ceil(F.length(text) / 4)


def tokens_by_words(text: Column) -> Column:
    """Words, half of the punctuation marks, and numbers."""
    words = F.regexp_count(text, F.lit(r"\w+"))
    marks = F.regexp_count(text, F.lit(r"[^\w\s]"))
    numbers = F.regexp_count(text, F.lit(r"\d+"))
    return F.ceil(words + marks / 2 + numbers)


def truncate_tokens(text: Column, tokens: int) -> Column:
    return F.when(F.length(text) > 4 * tokens, F.concat(F.substring(text, 1, 4 * tokens), F.lit("..."))).otherwise(text)


def excerpt(text: Column, width: int = 180) -> Column:
    """The first line, cut to ``width`` characters."""
    line = F.split_part(text, F.lit("\n"), F.lit(1))
    return F.when(F.length(line) <= width, line).otherwise(F.concat(F.substring(line, 1, width), F.lit("...")))


def markdown_facts(text: Column) -> Column:
    """(headers, levels, code_blocks, links, words) of a Markdown text."""
    heads = F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("#"))
    levels = F.transform(heads, lambda x: F.length(F.regexp_extract(x, "^(#+)", 1)))
    n = lambda p: F.regexp_count(text, F.lit(p))
    return F.struct(F.size(heads).alias("headers"), levels.alias("levels"), n(r"```[\s\S]*?```").alias("code_blocks"), n(r"\[([^\]]+)\]\(([^)]+)\)").alias("links"), F.size(F.split(text, r"\s+")).alias("words"))


def yaml_keys(text: Column) -> Column:
    """What stands before the first colon of each line that is no comment, list item or blank; names with spaces don't count."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#") & x.contains(":") & ~F.trim(x).startswith("-"))
    keys = F.transform(lines, lambda x: F.trim(F.split_part(x, F.lit(":"), F.lit(1))))
    return F.filter(keys, lambda k: (k != "") & ~k.contains(" "))


def complexity(code: Column) -> Column:
    """1 and the decision points outside comments and strings."""
    for pattern, put in NOT_CODE:
        code = F.regexp_replace(code, pattern, put)
    return sum((F.regexp_count(code, F.lit(p)) for p in DECISIONS), F.lit(1))


def complexity_rating(points: Column) -> Column:
    return F.when(points <= 10, "low").when(points <= 20, "moderate").when(points <= 50, "high").otherwise("very high")


def first_match(text: Column, rules, otherwise: str) -> Column:
    """The name of the first rule whose pattern the lower-case text matches."""
    low, out = F.lower(text), None
    for name, pattern in rules:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise(otherwise)


def task_type(query: Column) -> Column:
    return first_match(query, [(n, "|".join(w)) for n, w in TASKS], "understand")


def _like(pattern: str):
    return lambda word: word.rlike(pattern)


def attack_plan(query: Column) -> Column:
    """The plan that most words of a query speak for."""
    words = F.split(F.lower(query), r"\s+")
    scores = [F.size(F.filter(words, _like("|".join(kws)))) for _, kws in PLANS]
    best = F.greatest(*scores)
    out = F.when(best == 0, PLANS[0][0])
    for (name, _), s in zip(PLANS, scores, strict=True):
        out = out.when(s == best, name)
    return out


def endpoint_path(path: Column) -> Column:
    """Normalised path of an API call; empty where it is none."""
    p = F.split_part(F.split_part(path, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    p = F.regexp_replace(F.regexp_replace(p, "^[`'\"]", ""), "[`'\"]$", "")
    inner = F.regexp_replace(p, r"\$\{([^}]+)\}", ":$1")
    for pattern, put in ((r"https?://(localhost|127\.0\.0\.1)(:\d+)?/?", ""), (r"(?i)^/?(:?[A-Z0-9_]*BASE_URL:?)", ""), (r"(?i)^/?process\.env\.[A-Z0-9_]+", ""), (r"^/:/", "/api/"), (r"^:/", "/api/")):
        inner = F.regexp_replace(inner, pattern, put)
    inner = F.when(inner.rlike("^/v[0-9]+/"), F.concat(F.lit("/api"), inner)).when(inner.rlike("^v[0-9]+/"), F.concat(F.lit("/api/"), inner)).otherwise(inner)
    inner = F.regexp_replace(inner, "/+", "/")
    inner = F.when((inner != "") & ~inner.startswith("/"), F.concat(F.lit("/"), inner)).otherwise(inner)
    inner = F.when((F.length(inner) < 2) | inner.rlike("^/[^a-zA-Z0-9]"), "").otherwise(inner)
    return F.when(F.coalesce(p, F.lit("")).isin("", "http", "https"), "").when(p.rlike("^https?://"), p).otherwise(inner)


def route_path(file: Column) -> Column:
    """Route of a page file: ``[id]`` is ``:id``, ``[...s]`` is ``*s``, groups and slots are left out."""
    parts = F.split(F.regexp_replace(F.regexp_replace(file, r"^(src/)?(app|pages)/", ""), r"(^|/)(page|route|layout|index)\.(tsx?|jsx?)$", ""), "/")
    parts = F.filter(parts, lambda s: (s != "") & ~s.rlike(r"^\(.*\)$") & ~s.startswith("@"))

    def part(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^\[\[\.\.\.(.+)\]\]$"), F.concat(F.lit("*"), F.regexp_extract(s, r"^\[\[\.\.\.(.+)\]\]$", 1), F.lit("?")))
            .when(s.rlike(r"^\[\.\.\.(.+)\]$"), F.concat(F.lit("*"), F.regexp_extract(s, r"^\[\.\.\.(.+)\]$", 1)))
            .when(s.rlike(r"^\[(.+)\]$"), F.concat(F.lit(":"), F.regexp_extract(s, r"^\[(.+)\]$", 1)))
            .otherwise(s)
        )

    return F.concat(F.lit("/"), F.array_join(F.transform(parts, part), "/"))


def confidence(text: Column) -> Column:
    """"85.2%" is 0.852; numbers over 1 are per cent."""
    number = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1)
    value = F.when(number != "", number.cast("double"))
    return F.when(value > 1, value / 100).otherwise(value)


def quota_bytes(text: Column) -> Column:
    """"10GB" in bytes; MB where no unit is given, 10 GB where it can't be read."""
    number = F.regexp_extract(text, r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*(KB|MB|GB|TB|B)?$", 1)
    unit = F.upper(F.regexp_extract(text, r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*(KB|MB|GB|TB|B)?$", 2))
    power = F.when(unit == "B", 0).when(unit == "KB", 1).when(unit == "GB", 3).when(unit == "TB", 4).otherwise(2)
    return F.when(number == "", F.lit(10 * 1024**3).cast("long")).otherwise((F.expr("try_cast(0 as double)") + F.when(number != "", number.cast("double")) * F.pow(F.lit(1024.0), power)).cast("long"))
