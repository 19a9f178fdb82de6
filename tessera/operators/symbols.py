"""Scores of symbols and files: rule sums as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base importance of a symbol's type.
BASE = {"function": 20, "class": 30, "interface": 25, "type": 25, "variable": 10, "export": 15, "import": 5}
#: Parts of names of central symbols.
CENTRAL = ("main", "init", "setup", "handler", "controller", "service", "manager", "factory", "builder", "provider")
#: Parts of names of local variables, short names that are none.
LOCAL = (
    "starttime", "endtime", "result", "response", "data", "temp", "tmp", "elapsed", "duration", "error", "err", "value", "val", "item", "element", "index", "i", "j", "k",
    "count", "len", "length", "status", "message", "output", "input", "request", "req", "res", "ctx", "context",
)
SHORT = ("app", "api", "url", "uri", "key", "id")
#: Weights of relevance, context, quality and importance for each task.
TASK_WEIGHTS = {"understand": (0.3, 0.35, 0.25, 0.1), "implement": (0.45, 0.25, 0.15, 0.15), "debug": (0.5, 0.3, 0.1, 0.1), "": (0.4, 0.3, 0.2, 0.1)}
#: Priority of a path, the first pattern that matches.
PATH_PRIORS = (
    (r"src/(local|core|tools)/", 1.3), (r"src/api/", 1.25), (r"src/services?/", 1.2), (r"src/components?/", 1.15), (r"(index|main|app|server)\.(ts|js)$", 1.2),
    (r"config\.|\.config\.|settings\.", 1.1), (r"^src/", 1.1), (r"^[^/]*$", 1.05), (r"(test|spec|__tests__)/|\.(test|spec)\.(ts|js)$", 0.8), (r"(node_modules|dist|build|lib)/", 0.5),
)
#: Folders of build output.
BUILD = ("/dist/", "/build/", "/out/", "/.next/", "/.turbo/", "/coverage/", "/target/", "/node_modules/")


def any_of(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def likely_local(name: Column) -> Column:
    """Whether a variable's name is that of a local one. Parts count wherever they stand, single letters too."""
    low = F.lower(name)
    short = (F.length(low) <= 3) & ~low.isin(*SHORT)
    return any_of(low, LOCAL) | short | low.rlike(r"\d+$") | low.endswith("str") | low.endswith("obj")


def importance(kind: Column, name: Column, exported: Column, documented: Column, is_async: Column, parameters: Column, relations: Column, lines: Column) -> Column:
    """What a symbol is worth by its type, name, visibility and size (null lines: no body); 0 at least."""
    low = F.lower(name)
    base = F.lit(0)
    for k, v in BASE.items():
        base = F.when(kind == k, v).otherwise(base)
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    score = (
        base - points((kind == "variable") & likely_local(name), 25) + points(exported, 30) + points(any_of(low, CENTRAL), 25) + points(low.isin("index", "main", "app", "server"), 20)
        + points(documented, 10) + points(is_async, 8) + F.least(parameters * 2, F.lit(10)) + F.least(relations * 3, F.lit(15)) - F.when(lines < 2, 5).when(lines > 50, 10).otherwise(0)
        - points(any_of(low, ("test", "spec", "mock")), 20) - points(low.startswith("_") | any_of(low, ("internal", "private")), 10)
    )
    return F.greatest(F.lit(0), score)


def fuzzy(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer text."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise((longest - F.levenshtein(a, b)) / longest)


def word_overlap(query: Column, text: Column) -> Column:
    """Share of the query's words (over two letters) that hold or are held by a word of the text."""
    words = lambda c: F.filter(F.split(c, r"\W+"), lambda w: F.length(w) > 2)
    q, t = words(query), words(text)
    hit = F.filter(q, lambda w: F.exists(t, lambda x: x.contains(w) | w.contains(x)))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(hit) / F.size(q))


def query_match(name: Column, signature: Column, query: str, doc: Column | None = None, body: Column | None = None) -> Column:
    """The best of several ways in which a symbol can match a query."""
    n, sig, q = F.lower(name), F.lower(signature), F.lit(query.lower())
    holds = lambda c, score: F.when(F.coalesce(F.lower(c).contains(query.lower()), F.lit(False)), score).otherwise(0.0)
    ways = [holds(name, 0.8), F.when(F.contains(q, n) & (F.length(n) > 3), 0.7).otherwise(0.0), holds(signature, 0.6), fuzzy(n, q) * 0.6, word_overlap(q, F.concat_ws(" ", n, sig)) * 0.5]
    ways += [holds(c, score) for c, score in ((doc, 0.5), (body, 0.4)) if c is not None]
    return F.when(n == query.lower(), 1.0).otherwise(F.greatest(*ways))


def task_weights(task: str) -> tuple[float, float, float, float]:
    return TASK_WEIGHTS.get(task, TASK_WEIGHTS[""])


def path_prior(path: Column) -> Column:
    low, out = F.lower(path), None
    for pattern, value in PATH_PRIORS:
        out = F.when(low.rlike(pattern), value) if out is None else out.when(low.rlike(pattern), value)
    return out.otherwise(1.0)


def file_relevance(path: Column, language: Column, size: Column) -> Column:
    """Entry points, manuals, manifests and sources of middling size first; deep paths less."""
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    depth = F.size(F.split(path, "/"))
    return (
        points(any_of(path, ("index", "main", "app")), 100) + points(F.lower(path).contains("readme"), 80) + points(any_of(path, ("package.json", "Cargo.toml", "go.mod")), 70)
        + points(any_of(path, ("src/", "lib/")), 50) + points(language.isin("typescript", "javascript"), 30) + points((size > 500) & (size < 50000), 10) - points(depth > 5, depth)
    )


def source_rank(path: Column) -> Column:
    """1 to 9: how much a file is a source rather than something built from it."""
    ext = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    built, src = any_of(F.lower(path), BUILD), path.contains("/src/")
    js = ext.isin(".js", ".jsx")
    rules = [src & (ext == ".ts"), src & (ext == ".tsx"), (ext == ".ts") & ~built, (ext == ".tsx") & ~built, src & js, js & ~built, src & ~built, ~built]
    out = F.lit(9)
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1], k).otherwise(out)
    return out


def prefer_sources(files: DataFrame) -> DataFrame:
    """One file (path) for each stem: the most a source, then the shortest path."""
    stem = F.regexp_replace("path", r"\.[^/.]+$", "")
    key = F.struct(source_rank(F.col("path")), F.length("path"), F.col("path"))
    return files.groupBy(stem.alias("stem")).agg(F.min_by("path", key).alias("path"), F.count("*").alias("candidates"))
