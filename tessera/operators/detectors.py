"""Findings in texts: one rule table, one operator; and the scores made of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detect(texts: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """id, line, rule, match, for every match of every rule (name, pattern, group) in every line of (id, text)."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line", "s"))

    def named(rule: str):
        return lambda m: F.struct(F.lit(rule).alias("rule"), m.alias("match"))

    hits = [F.transform(F.regexp_extract_all("s", F.lit(p), F.lit(g)), named(n)) for n, p, g in rules]
    found = lines.withColumn("hits", F.concat(*hits)).filter(F.size("hits") > 0)
    return found.select("id", (F.col("line") + 1).alias("line"), F.explode("hits").alias("h")).select("id", "line", "h.rule", "h.match")


def risk_score(fired: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of the weights of the rules that fired for a subject, at most 100, with its level."""
    score = fired.select("subject", "rule").distinct().join(weights, "rule").groupBy("subject").agg(F.least(F.lit(100), F.sum("weight")).alias("score"))
    level = F.when(F.col("score") >= 70, "high").when(F.col("score") >= 40, "medium").when(F.col("score") >= 20, "low").otherwise("minimal")
    return score.withColumn("level", level)


def duplicate_endpoints(calls: DataFrame) -> DataFrame:
    """Endpoints (path, method, file) called alike more than once, or by several methods."""
    same = calls.groupBy("path", "method").agg(F.count("*").alias("n")).filter("n > 1").select("path", F.lit("exact").alias("kind"), "n")
    many = calls.groupBy("path").agg(F.count_distinct("method").alias("n")).filter("n > 1").select("path", F.lit("methods").alias("kind"), "n")
    return same.unionByName(many)


def endpoint_usage(calls: DataFrame) -> DataFrame:
    """In how many files an endpoint is used; over two is a finding."""
    use = calls.groupBy("path", "method").agg(F.count_distinct("file").alias("files"))
    return use.withColumn("finding", F.when(F.col("files") > 2, "STATE-001"))


def db_confidence(kind: Column) -> Column:
    """Share of 100 that the kinds of evidence add up to, each once."""
    weights = {"import": 30, "env": 25, "sql": 15, "connection": 20}
    total = sum((F.max(F.when(kind == k, w).otherwise(0)) for k, w in weights.items()), F.lit(0))
    return F.least(F.lit(1.0), total / 100)


def health_score(issues: Column, recommendations: Column) -> Column:
    return F.greatest(F.lit(0), 100 - issues * 20 - recommendations * 5)


def budget_breaches(retrieval_ms: Column, compose_ms: Column, coverage: Column, missed: Column) -> Column:
    """Names of the budgets that a query breaks: 500 ms, 200 ms, a tenth of coverage, five missed anchors."""
    return F.array_compact(F.array(F.when(retrieval_ms > 500, "retrieval"), F.when(compose_ms > 200, "composer"), F.when(coverage < 0.1, "coverage"), F.when(missed > 5, "anchors")))


def locate(frames: DataFrame, symbols: DataFrame) -> DataFrame:
    """The first symbol (file, start, end, symbol) that holds each frame (file, line): a range join within a file."""
    s = symbols.select(F.col("file").alias("f_"), "start", "end", "symbol")
    hit = frames.join(s, (F.col("file") == F.col("f_")) & F.col("line").between(F.col("start"), F.col("end")), "left")
    return hit.groupBy("frame", "file", "line").agg(F.min_by("symbol", "start").alias("symbol"))


#: What a fact of each kind scores in a structural query.
FACT_SCORES = {"import": 0.8, "export": 0.9, "call": 0.7, "new": 0.7, "env": 0.8, "route": 0.85}
#: Facts that lines of source show: (kind, pattern, group of the name).
FACTS = (
    ("import", r"^\s*import\s.*?from\s+['\"]([^'\"]+)['\"]", 1), ("export", r"export\s+(?:default\s+)?(?:async\s+)?(?:const|let|var|function|class|interface|type)\s+(\w+)", 1), ("new", r"\bnew\s+(\w+)\s*\(", 1),
    ("env", r"process\.env\.([A-Z0-9_]+)", 1), ("route", r"(?:app|router)\.(?:get|post|put|patch|delete)\(['\"]([^'\"]+)['\"]", 1), ("call", r"\b(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b|new\b)([A-Za-z_$][\w$]*)\s*\(", 1),
)


def facts(files: DataFrame) -> DataFrame:
    """id, line, kind, name of files (id, text)."""
    return detect(files, list(FACTS)).select("id", "line", F.col("rule").alias("kind"), F.col("match").alias("name"))


def ast_query(found: DataFrame, queries: list[tuple[str, str]], most_files: int | None = None) -> DataFrame:
    """Facts (id, line, kind, name) that some query (kind, pattern) asks for, each once, with the score of its kind.

    A pattern is searched for in the name; with ``/`` around it it is a regular
    expression, else text. ``most_files`` keeps those in the first files by id.
    """
    wanted = F.lit(False)
    for kind, pattern in queries:
        if kind not in FACT_SCORES:
            raise ValueError(f"no facts of kind {kind}")
        hit = F.col("name").rlike(pattern[1:-1]) if len(pattern) > 1 and pattern[0] == pattern[-1] == "/" else F.col("name").contains(pattern)
        wanted = wanted | ((F.col("kind") == kind) & hit)
    score = F.lit(0.0)
    for kind, n in FACT_SCORES.items():
        score = F.when(F.col("kind") == kind, n).otherwise(score)
    rows = found.filter(wanted).withColumn("score", score).distinct()
    if most_files is not None:
        rows = rows.join(rows.select("id").distinct().orderBy("id").limit(most_files), "id", "left_semi")
    return rows


def structural_pattern(pattern: str) -> tuple[str, list[str]]:
    """A regular expression for a pattern with metavariables, and their names: ``$X`` is one expression without commas or brackets, ``$$$X`` anything; white space matches any."""
    out, names = "", []
    for part in re.split(r"(\$\$\$\w*|\$[A-Z_]\w*|\s+)", pattern):
        if part.startswith("$$$"):
            names.append(part[3:] or "_")
            out += "(.*?)"
        elif part.startswith("$"):
            names.append(part[1:])
            out += r"([^,()\s]+)"
        elif part.isspace():
            out += r"\s+"
        else:
            out += re.escape(part)
    return out, names


def structural_search(files: DataFrame, pattern: str) -> DataFrame:
    """id, line, and a column for each metavariable, of each line of (id, text) that holds a pattern (its first match)."""
    rx, names = structural_pattern(pattern)
    lines = files.select("id", F.posexplode(F.split("text", "\n")).alias("p", "s")).filter(F.col("s").rlike(rx))
    return lines.select("id", (F.col("p") + 1).alias("line"), *[F.regexp_extract("s", rx, k + 1).alias(n) for k, n in enumerate(names)])


def fill_template(template: str, values: dict[str, Column], words: int = 60) -> Column:
    """A template's ``{slots}`` filled, unknown ones by a dash, and cut to a number of words."""
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.nullif(value, F.lit("")), F.lit("-")))
    text = F.regexp_replace(text, r"\{\w+\}", "-")
    parts = F.split(text, r"\s+")
    return F.when(F.size(parts) > words, F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit("..."))).otherwise(text)


def around_symbol(symbols: DataFrame, name: str, usage: int = 5, tests: int = 3, errors: int = 5) -> DataFrame:
    """relation, place, id: symbols (id, file, name, signature, body) that use a name, that test it, and that handle errors in the files that define it; a few of each, by id."""
    holds = F.col("signature").contains(name) | F.coalesce(F.col("body").contains(name), F.lit(False))
    test = F.lower("file").contains("test")
    home = symbols.filter(F.col("name") == name).select(F.col("file").alias("home_")).distinct()
    caught = F.coalesce(F.col("body").rlike(r"\b(try|catch|throw)\b|Error"), F.lit(False))
    kinds = {"usage": (symbols.filter(holds & ~test & (F.col("name") != name)), usage), "test": (symbols.filter(holds & test), tests), "error": (symbols.filter(caught).join(home, F.col("file") == F.col("home_"), "left_semi"), errors)}
    out = None
    for relation, (rows, most) in kinds.items():
        best = rows.select("id").orderBy("id").limit(most)
        best = best.select(F.lit(relation).alias("relation"), F.row_number().over(Window.orderBy("id")).alias("place"), "id")
        out = best if out is None else out.unionByName(best)
    return out


def compare_configurations(runs: DataFrame, by: str) -> DataFrame:
    """``by``, time_reduction, compression_gain, quality_gain of runs (configuration: baseline or optimised, time, compression, quality): changes as shares of the baseline's means."""
    mean = lambda c, v: F.avg(F.when(F.col("configuration") == c, F.col(v)))
    change = lambda v: (mean("optimised", v) - mean("baseline", v)) / mean("baseline", v)
    return runs.groupBy(by).agg(F.round(-change("time"), 6).alias("time_reduction"), F.round(change("compression"), 6).alias("compression_gain"), F.round(change("quality"), 6).alias("quality_gain"))


def regressions(current: DataFrame, baseline: DataFrame, by: str, threshold: float = 0.2) -> DataFrame:
    """``by``, issues of current means (time, compression, errors) against a baseline's: what got worse by more than a share."""
    b = baseline.select(by, *[F.col(c).alias(f"b_{c}") for c in ("time", "compression", "errors")])
    rows = current.join(b, by)
    slower = (F.col("time") - F.col("b_time")) / F.col("b_time") > threshold
    larger = (F.col("b_compression") - F.col("compression")) / F.col("b_compression") > threshold
    wrong = F.col("errors") > F.col("b_errors") * (1 + threshold)
    return rows.select(by, F.array_join(F.array_compact(F.array(F.when(slower, "time"), F.when(larger, "compression"), F.when(wrong, "errors"))), ",").alias("issues"))


def returned_symbols(body: Column, most: int = 5) -> Column:
    """What a body returns by name, the first few different ones."""
    return F.slice(F.array_distinct(F.regexp_extract_all(body, F.lit(r"\breturn\s+([A-Za-z_$][\w$]*)"), F.lit(1))), 1, most)
