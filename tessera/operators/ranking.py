"""Ranking of candidates for a question: weighted factors, name graphs, diversity, hints.

A candidate is a row of (id, file, name, kind) and what else a factor needs.
Names that hold one another are found by an equi-join on all parts of distinct
names, never by comparing each with each.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.symbols import any_of, path_prior
from tessera.sources.files import matches_any

#: Words that are no terms of a question.
STOP_WORDS = ("and", "the", "how", "does", "can", "will", "what", "where", "when")
#: Weights of the factors of a candidate's score.
WEIGHTS = {"path": 0.15, "keyword": 0.25, "surface": 0.2, "degree": 0.1, "recency": 0.05, "context": 0.15, "domain": 0.1}
#: Words of the domains.
DOMAINS = {
    "database": ("db", "database", "storage", "sqlite", "postgres", "mongo", "store", "persist", "save", "query", "search", "index"),
    "auth": (
        "auth", "login", "signin", "signout", "logout", "session", "token", "jwt", "cookie", "supabase", "nextauth", "oauth", "clerk", "firebase", "jose", "jsonwebtoken", "verify", "rls", "policy",
        "user", "guard", "middleware",
    ),
    "api": ("api", "route", "endpoint", "handler", "controller", "service", "rest", "graphql"),
    "search": ("search", "find", "query", "embedding", "vector", "similarity", "index", "retrieval"),
    "provider": ("provider", "client", "adapter", "wrapper", "service", "connection"),
    "config": ("config", "env", "setting", "option", "variable", "param"),
    "init": ("init", "initialize", "setup", "start", "boot", "load", "create"),
    "tool": ("tool", "command", "cli", "script", "util", "helper"),
}
#: What folders add to a path's score.
FOLDERS = (("/local/", 0.15), ("/core/", 0.1), ("/api/", 0.12), ("/db/", 0.12), ("/auth/", 0.12))
#: What kinds add to the surface, and roles to the context.
KIND_SURFACE = {"export": 0.4, "function": 0.2, "class": 0.25, "interface": 0.15, "call": 0.1}
ROLE_CONTEXT = {"interface": 0.25, "entry": 0.25, "core": 0.2, "init": 0.2, "operation": 0.15, "config": 0.1}
#: Patterns of a plan's domain in names (n) and files (f), and what each adds.
PLAN_PATTERNS = {
    "init-read-write": (("n", "(init|initialize|connect|open|create|setup)", 0.3), ("n", "(read|write|query|search|find|insert|update|delete)", 0.25), ("f", "storage|database", 0.2)),
    "api-route": (("n", "(get|post|put|delete|patch|route|handler)", 0.3), ("f", "api|route", 0.25), ("n", r"app\.|router\.", 0.2)),
    "auth": (("n", "(auth|login|verify|token|session|password)", 0.3), ("f", "auth|session", 0.25), ("n", "(middleware|guard|protect)", 0.2)),
    "error-driven": (("n", "(error|exception|catch|throw|fail)", 0.3),),
}
#: What a kind of surface is worth as a hint.
HINT_SURFACE = {"function": 1.2, "class": 1.15, "route": 1.25, "tool": 1.3, "interface": 1.05, "const": 0.95}
#: Other words for a term of a question.
ALIASES = {
    "database": ("db", "storage", "store", "repo", "repository", "persist", "save", "query"), "db": ("database", "storage", "sqlite", "postgres", "mysql", "mongo"), "storage": ("store", "persist", "save", "cache", "memory", "disk"),
    "search": ("query", "find", "filter", "lookup", "retrieve", "get", "fetch"), "query": ("search", "find", "filter", "select", "where"), "index": ("search", "catalog", "directory", "registry"),
    "auth": ("login", "token", "jwt", "session", "password", "credential", "oauth"), "login": ("auth", "signin", "authenticate", "credential"), "token": ("jwt", "auth", "bearer", "session"),
    "api": ("endpoint", "route", "handler", "controller", "service", "request"), "endpoint": ("api", "route", "url", "path", "handler"), "route": ("endpoint", "path", "url", "handler", "controller"),
    "process": ("handle", "execute", "run", "perform", "action"), "handle": ("process", "execute", "manage", "deal", "action"), "transform": ("convert", "parse", "format", "change", "modify"),
    "file": ("document", "content", "upload", "download", "attachment"), "upload": ("file", "attach", "send", "post", "submit"), "download": ("file", "get", "fetch", "retrieve", "export"),
    "user": ("account", "profile", "member", "person", "identity"), "account": ("user", "profile", "member", "credential"), "profile": ("user", "account", "info", "details"),
    "config": ("setting", "option", "preference", "parameter", "env"), "setting": ("config", "option", "preference", "parameter"), "env": ("environment", "config", "setting", "variable"),
}
#: Files that no question is about, those that a question about auth is not about, and those it is.
NEVER = (
    "**/__tests__/**", "**/__mocks__/**", "**/*.stories.*", "**/fixtures/**", "**/examples/**", "**/benchmarks/**", "**/coverage/**", "**/*.config.*", "**/*.d.ts", "**/scripts/**", "**/tests/**",
    "**/dist/**", "**/build/**", "**/projection_matrix.*", "**/*.md", "**/README*",
)
NOT_AUTH = ("**/*.md", "**/README*", "**/docs/**")
AUTH_FILES = ("**/middleware/**", "**/*auth*", "**/*Auth*", "**/services/**/auth*", "**/integration/**/auth*", "**/lib/supabase*", "**/supabase*")
#: Files that come first for a topic.
TOPIC_FILES = {"api": r"(?i)app/.*/route\.(ts|js)$|pages/api/|/api/", "components": r"(?i)\.(tsx|jsx)$|/app/components/|/components/|/pages/", "auth": "(?i)auth"}


def query_tokens(q: str) -> list[str]:
    """The terms of a question: over two letters, no stop words, each once."""
    words = re.split(r"[\s\-_.,?!]+", q.lower())
    return list(dict.fromkeys(w for w in words if len(w) > 2 and w not in STOP_WORDS))


def query_tokens_column(q: Column) -> Column:
    words = F.split(F.lower(q), r"[\s\-_.,?!]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def domain_keywords(plan: str) -> tuple[str, ...]:
    if plan == "init-read-write":
        return DOMAINS["database"] + DOMAINS["init"]
    if plan == "error-driven":
        return ("error", "exception", "fail", "catch", "throw")
    key = {"api-route": "api"}.get(plan, plan)
    return DOMAINS[key] if plan in ("api-route", "auth") else tuple(w for v in DOMAINS.values() for w in v)


def _add(condition: Column, n: float) -> Column:
    return F.when(condition, n).otherwise(0.0)


def path_score(plan: str) -> Column:
    low = F.lower("file")
    score = F.lit(0.5)
    for word in domain_keywords(plan):
        score = score + _add(low.contains(word), 0.1)
    for part, n in FOLDERS:
        score = score + _add(low.contains(part), n)
    score = F.when(any_of(low, ("test", "spec")), score * (1.1 if plan == "debug" else 0.7)).otherwise(score)
    score = score - _add(low.contains("/scripts/"), 0.6) - _add(low.contains("projection_matrix"), 0.9) - _add(low.rlike("(benchmarks|fixtures|examples)"), 0.3)
    score = score - _add(low.rlike("(metrics|telemetry|observability|worker|jobs?|queue)"), 0.4)
    return F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))


def keyword_score(tokens: list[str], plan: str) -> Column:
    name, base, file = F.lower("name"), F.lower(F.element_at(F.split("file", "/"), -1)), F.col("file")
    score, matches = F.lit(0.0), F.lit(0)
    for t in tokens:
        score = score + _add(name.contains(t), 0.3) + _add(base.contains(t), 0.15)
        matches = matches + name.contains(t).cast("int") + base.contains(t).cast("int")
    for word in domain_keywords(plan):
        score = score + _add(name.contains(word), 0.2)
        matches = matches + name.contains(word).cast("int")
    score = score + _add((matches > 0) & name.contains(" ".join(tokens)), 0.4)
    if plan == "api-route":
        score = score + _add(file.rlike(r"app/.*/route\.(ts|js)$") | file.rlike("pages/api/"), 0.3)
    if plan in ("understand", "auto") and re.search("(component|components|ui|page|jsx|sfc)", " ".join(tokens)):
        score = score + _add(file.rlike(r"(?i)\.(tsx|jsx)$") | file.rlike("(?i)/components/"), 0.2)
    return F.least(score, F.lit(1.0))


def surface_score(in_exports: Column) -> Column:
    """``in_exports``: whether an export has the candidate's name or stands in its file."""
    kind = F.lit(0.05)
    for k, v in KIND_SURFACE.items():
        kind = F.when(F.col("kind") == k, v).otherwise(kind)
    name = F.col("name")
    starts = name.rlike("(?i)^(init|initialize|setup|start|create)")
    return F.least(F.lit(0.3) + kind + _add(in_exports, 0.3) + _add(any_of(name, ("handle", "tool")), 0.2) + _add(starts, 0.25), F.lit(1.0))


def recency_score(days: Column) -> Column:
    return F.when(days <= 1, 1.0).when(days <= 7, 0.7).when(days <= 30, 0.5).when(days > 30, 0.3).otherwise(0.5)


def _holding(term: str) -> Callable[[Column], Column]:
    return lambda text: F.lower(text).contains(term)


def reasons_score(tokens: list[str], reasons: Column, role: Column) -> Column:
    """``reasons``: an array of texts; each term in each of them counts."""
    said = F.size(reasons) > 0
    hits = F.lit(0.0)
    for t in tokens:
        hits = hits + F.size(F.filter(reasons, _holding(t))) * 0.1
    by_role = F.lit(0.0)
    for k, v in ROLE_CONTEXT.items():
        by_role = F.when(role == k, v).otherwise(by_role)
    return F.least(F.lit(0.4) + F.when(said, hits + 0.2).otherwise(0.0) + by_role, F.lit(1.0))


def domain_score(plan: str) -> Column:
    name, file, score = F.lower("name"), F.lower("file"), F.lit(0.4)
    for where, pattern, n in PLAN_PATTERNS.get(plan, ()):
        score = score + _add((name if where == "n" else file).rlike(pattern), n)
    if plan == "error-driven":
        score = score + _add((F.col("kind") == "call") & name.contains("catch"), 0.25)
    return F.least(score, F.lit(1.0))


def name_degrees(candidates: DataFrame) -> DataFrame:
    """id, degree: the candidates (id, file, name) in the same file, or whose name holds or is held by the own, less those of the same file and name.

    Distinct names are cut into all their parts, and the parts meet other names
    by equality; a name of n letters has n (n + 1) / 2 parts whatever the
    number of names.
    """
    keys = candidates.groupBy("file", "name").agg(F.count("*").alias("n"))
    names = keys.groupBy("name").agg(F.sum("n").alias("n_name"))
    size = F.length("name")
    starts = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda k: F.substring("name", i, k)))
    parts = names.select(F.col("name").alias("whole"), F.explode(F.array_distinct(F.flatten(starts))).alias("name"))
    held = parts.join(names.select("name"), "name").select("whole", F.col("name").alias("part"))
    related = held.unionByName(held.select(F.col("part").alias("whole"), F.col("whole").alias("part"))).distinct()
    by_name = related.join(names.withColumnRenamed("name", "part"), "part").groupBy("whole").agg(F.sum("n_name").alias("n_related")).withColumnRenamed("whole", "name")
    both = related.join(keys.select(F.col("name").alias("part"), "file", F.col("n").alias("n_both")), "part")
    both = both.join(keys.select(F.col("name").alias("whole"), "file"), ["whole", "file"]).groupBy(F.col("whole").alias("name"), "file").agg(F.sum("n_both").alias("n_both"))
    files = keys.groupBy("file").agg(F.sum("n").alias("n_file"))
    degrees = keys.join(by_name, "name").join(both, ["name", "file"]).join(files, "file").select("file", "name", (F.col("n_file") + F.col("n_related") - F.col("n_both") - F.col("n")).alias("degree"))
    return candidates.select("id", "file", "name").join(degrees, ["file", "name"]).select("id", "degree")


def in_exports(candidates: DataFrame, exports: DataFrame) -> DataFrame:
    """id, exported_: whether some export (name, file) has a candidate's name or its file: two equi-joins for the OR."""
    names, files = (exports.select(F.col(c).alias(f"{c}_")).distinct() for c in ("name", "file"))
    rows = candidates.select("id", "name", "file").join(names, F.col("name") == F.col("name_"), "left").join(files, F.col("file") == F.col("file_"), "left")
    return rows.select("id", (F.col("name_").isNotNull() | F.col("file_").isNotNull()).alias("exported_"))


def rank_candidates(candidates: DataFrame, exports: DataFrame, question: str, plan: str) -> DataFrame:
    """Candidates (id, file, name, kind, days, reasons, role) with the seven factors and their weighted sum."""
    tokens = query_tokens(question)
    rows = candidates.join(in_exports(candidates, exports), "id").join(name_degrees(candidates), "id")
    factors = {
        "path": path_score(plan), "keyword": keyword_score(tokens, plan), "surface": surface_score(F.col("exported_")), "degree": F.lit(0.3) + F.least(F.col("degree") / 20, F.lit(1.0)) * 0.4,
        "recency": recency_score(F.col("days")), "context": reasons_score(tokens, F.col("reasons"), F.col("role")), "domain": domain_score(plan),
    }
    total = sum((factors[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return rows.select("id", "file", "name", *[F.round(v, 6).alias(f"{k}_factor") for k, v in factors.items()], F.round(total, 6).alias("score"))


def diverse(rows: DataFrame, group: str, per_group: int = 3, limit: int = 20) -> DataFrame:
    """The best rows of (id, score) with at most ``per_group`` of a group, ``limit`` in all, ranked from 1."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    best = rows.withColumn("place_", F.row_number().over(w)).filter(F.col("place_") <= per_group).orderBy(F.desc("score"), "id").limit(limit).drop("place_")
    return best.withColumn("ranking", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def topic_files(files: DataFrame, topic: str) -> DataFrame:
    """Files (path) that a topic can be about, and whether each is likely (``hinted``), for sorting the likely ones first. ``**`` crosses folders."""
    stop = list(NEVER) + (list(NOT_AUTH) if topic == "auth" else [])
    hint = F.lit(False)
    if topic in TOPIC_FILES:
        hint = F.col("path").rlike(TOPIC_FILES[topic])
        if topic == "auth":
            hint = hint | matches_any(F.col("path"), list(AUTH_FILES))
    return files.filter(~matches_any(F.col("path"), stop)).withColumn("hinted", hint)


def fuzzy_term(text: Column, term: str) -> Column:
    """Whether a word of a text holds a term, or the term the first three letters of a word; any empty word counts too."""
    if len(term) < 3:
        return F.lit(False)
    return F.exists(F.split(text, r"[\s\-_./\\]"), lambda w: w.contains(term) | F.contains(F.lit(term), F.substring(w, 1, 3)))


def hint_keywords(name: Column, file: Column, terms: list[str]) -> Column:
    """Product over the terms of what the best way they match is worth, and a tenth more for more than one match."""
    low, path, text = F.lower(name), F.lower(file), F.lower(F.concat_ws(" ", name, file))
    score, matches = F.lit(1.0), F.lit(0)
    for t in terms:
        alias, fuzzy = any_of(text, ALIASES.get(t, ())), fuzzy_term(text, t)
        direct = (low == t) | low.contains(t) | path.contains(t)
        other = F.when(alias, 1.2).otherwise(1.0) * F.when(fuzzy, 1.1).otherwise(1.0)
        score = score * F.when(low == t, 2.0).when(low.contains(t), 1.5).when(path.contains(t), 1.3).otherwise(other)
        matches = matches + F.when(direct, 1).otherwise(alias.cast("int") + fuzzy.cast("int"))
    return score * F.when(matches > 1, 1.1).otherwise(1.0)


def hint_score(kind: Column, degree: Column, days: Column, terms: list[str]) -> Column:
    """Product of path, surface, import degree, recency (days; null: none) and keywords."""
    surface = F.lit(1.0)
    for k, v in HINT_SURFACE.items():
        surface = F.when(kind == k, v).otherwise(surface)
    connected = F.lit(1.0) + F.least(F.lit(0.4), F.ln(degree + 1) * 0.1)
    recent = F.when(days < 7, 1.2).when(days < 30, 1.15).when(days < 90, 1.1).when(days < 180, 1.05).otherwise(1.0)
    keywords = hint_keywords(F.col("name"), F.col("file"), terms) if terms else F.lit(1.0)
    return path_prior(F.col("file")) * surface * connected * recent * keywords


def hint_confidence(score: Column) -> Column:
    """Scores of 0.5 to 3 mapped to 0.5 to 0.98, two decimals."""
    clamped = F.least(F.lit(3.0), F.greatest(F.lit(0.5), score))
    return F.round(F.greatest(F.lit(0.5), F.least(F.lit(0.98), F.lit(0.5) + (clamped - 0.5) / 2.5 * 0.48)), 2)


def ranked_hints(items: DataFrame, terms: list[str], most: int = 7) -> DataFrame:
    """The best items (id, file, name, kind, degree, days) with score and confidence."""
    scored = items.withColumn("score", hint_score(F.col("kind"), F.col("degree"), F.col("days"), terms))
    best = scored.orderBy(F.desc(F.round("score", 9)), "id").limit(most)
    return best.select("id", "file", "name", F.round("score", 6).alias("score"), hint_confidence(F.col("score")).alias("confidence"))


def map_confidence(coverage: Column, anchors: Column) -> Column:
    """0.6 of the coverage, 0.3 of the anchors found, and 0.1; 1 at most."""
    return F.least(F.lit(1.0), coverage * 0.6 + anchors * 0.3 + 0.1)
