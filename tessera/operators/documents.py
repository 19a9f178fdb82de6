"""Lexical search, facets, word frequencies, chunking, deduplication and budgets over texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Facets and the strings that speak for them.
FACETS = {
    "auth": ["Authorization", "Bearer", "JWT", "verifyAuth", "apikey", "bcrypt", "supabase", "nextauth", "clerk", "RLS", "policy", "auth.uid()", "authenticate", "login", "session", "token"],
    "routing": ["route", "handler", "Fastify", "Express", "middleware", "GET", "POST", "PUT", "DELETE", "app.use", "router", "endpoint", "api", "controller"],
    "data": ["schema", "migration", "policy", "RLS", "org_id", "auth.uid()", "prisma", "supabase", "database", "table", "model", "entity", "repository", "DAO", "query", "sql"],
    "observability": ["logger", "metrics", "traces", "OpenTelemetry", "prometheus", "datadog", "sentry", "error", "debug", "log", "monitor"],
    "build_runtime": [".env", "docker", "compose", "worker", "queue", "cron", "scheduler", "build", "deploy", "ci", "cd", "pipeline"],
    "security": ["rateLimit", "helmet", "CSP", "secret", "hash", "salt", "encrypt", "decrypt", "key", "certificate", "ssl", "tls"],
    "ui_frontend": ["AuthProvider", "ProtectedRoute", "middleware.ts", "layout.tsx", "component", "react", "vue", "angular", "jsx", "tsx", "state", "props", "hook"],
    "integrations": ["GitHubApp", "webhook", "stripe", "slack", "discord", "aws", "gcp", "azure", "api", "integration", "external", "third-party"],
    "testing_ci": ["jest", "vitest", "e2e", "playwright", "test-utils", "spec", "mock", "fixture", "coverage", "unit", "integration"],
}
#: Rows of a facet that a result may hold, and symbols that stand for a facet.
FACET_CAPS = {"auth": 6, "routing": 4, "data": 3, "observability": 2, "build_runtime": 2, "security": 2, "ui_frontend": 3, "integrations": 2, "testing_ci": 2}
ANCHORS = {
    "auth": ["verifyAuth", "verifyToken", "authenticate", "authorize", "checkAuth", "isAuthenticated", "requireAuth"],
    "routing": ["app.use", "app.get", "app.post", "app.put", "app.delete", "router", "middleware"],
    "data": ["supabase", "prisma", "createClient", "database", "query"],
}


def facet_tags(low: Column) -> Column:
    """The facets one of whose strings occurs in a lower-case text: lower it once, in a column of its own."""
    found = []
    for facet, seeds in FACETS.items():
        hit = F.lit(False)
        for seed in seeds:
            hit = hit | low.contains(seed.lower())
        found.append(F.when(hit, facet))
    return F.array_compact(F.array(*found))


def facet_matches(text: Column) -> Column:
    """How many strings of all facets occur in the text."""
    low = F.lower(text)
    return sum((low.contains(s.lower()).cast("int") for seeds in FACETS.values() for s in seeds), F.lit(0))


def query_terms(q: str) -> list[str]:
    return [t for t in q.lower().split() if len(t) > 2]


def lexical_score(low: Column, low_name: Column, length: Column, q: str, is_symbol: Column) -> Column:
    """1 for the phrase, 0.3 for each occurrence of a term, 0.5 and 1 for the name, less a penalty for length; 0.2 for symbols. Text and name are lower case."""
    score = F.when(low.contains(q.lower()), 1.0).otherwise(0.0)
    for t in query_terms(q):
        times = (F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)
        score = score + times * 0.3
        score = score + F.when(F.coalesce(low_name.contains(t), F.lit(False)), 0.5).otherwise(0.0) + F.when(F.coalesce(low_name == t, F.lit(False)), 1.0).otherwise(0.0)
    score = F.greatest(F.lit(0.0), score - F.least(length / 1000, F.lit(0.5)))
    return F.when(is_symbol & (score > 0), score + 0.2).otherwise(score)


def lexical_search(rows: DataFrame, q: str, k: int = 12) -> DataFrame:
    """The best k of rows (id, content, name, is_symbol); texts are lowered once."""
    if not query_terms(q):
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    low = rows.select("id", "is_symbol", F.length("content").alias("n_"), F.lower("content").alias("low_"), F.lower("name").alias("name_"))
    scored = low.select("id", F.round(lexical_score(F.col("low_"), F.col("name_"), F.col("n_"), q, F.col("is_symbol")), 6).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), "id").limit(k)


#: Words that are no symbols.
STOP_WORDS = ("the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has", "have", "this", "that", "with", "from")


def word_frequencies(docs: DataFrame, k: int = 50, shortest: int = 3, stop: tuple[str, ...] = (), pattern: str = "[a-z]+", lower: bool = True) -> DataFrame:
    """The k most frequent words with the documents and sources they occur in.

    Words are counted per document first, so that a shuffle sees a row for each
    pair. With case kept, short words in capitals and those that begin with
    ``_`` don't count.
    """
    text = F.lower("text") if lower else F.col("text")
    words = docs.select("doc_id", "source", F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("word")).filter(F.length("word") >= shortest)
    if stop:
        words = words.filter(~F.lower("word").isin(*stop))
    if not lower:
        words = words.filter(~F.col("word").startswith("_") & ~((F.length("word") < 4) & (F.upper("word") == F.col("word"))))
    each = words.groupBy("word", "doc_id", "source").agg(F.count("*").alias("n"))
    return each.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("documents"), F.count_distinct("source").alias("sources")).orderBy(F.desc("n"), "word").limit(k)


def fixed_line_chunks(docs: DataFrame, lines: int = 50) -> DataFrame:
    """Chunks of ``lines`` lines; a blank text is one chunk ``empty_file``."""
    rows = docs.select("doc_id", "text", F.split("text", "\n").alias("l"))
    many = F.greatest(F.lit(1), F.ceil(F.size("l") / lines)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("l", i * lines + 1, lines), "\n").alias("c")))
    rows = rows.select("doc_id", F.trim("text").alias("t"), F.size("l").alias("n"), F.explode(chunks).alias("x"))
    kind = F.when(F.col("t") == "", "empty_file").otherwise("chunk")
    return rows.select("doc_id", F.col("x.i").alias("chunk"), (F.col("x.i") * lines + 1).alias("start_line"), F.least(F.col("n"), (F.col("x.i") + 1) * lines).alias("end_line"), kind.alias("kind"), F.length("x.c").alias("chars"))


def line_chunks(text: str, size: int = 2000, overlap: int = 100) -> list[tuple[int, int, str]]:
    """(first line, last line, content): lines up to ``size`` characters; each piece repeats the last ``ceil(overlap / 50)`` lines."""
    again = -(-overlap // 50)
    lines = text.split("\n")
    out, begin, used = [], 0, 0
    for k, line in enumerate(lines):
        if k > begin and used + len(line) + 1 > size:
            out.append((begin + 1, k, "\n".join(lines[begin:k]).strip()))
            begin = max(begin + 1, k - again)
            used = sum(len(x) + 1 for x in lines[begin:k])
        used += len(line) + 1
    out.append((begin + 1, len(lines), "\n".join(lines[begin:]).strip()))
    return out


def overlap_chunks(docs: DataFrame, size: int = 2000, overlap: int = 100) -> DataFrame:
    """Line-greedy chunks of up to ``size`` characters that repeat the last ``ceil(overlap / 50)`` lines."""

    def run(batches):
        for rows in batches:
            out = [(i, n, *chunk) for i, text in zip(rows.doc_id, rows.text, strict=True) for n, chunk in enumerate(line_chunks(text or "", size, overlap))]
            yield pd.DataFrame(out, columns=["doc_id", "chunk", "start_line", "end_line", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, start_line int, end_line int, content string").filter("content <> ''")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s]+", " "))


def content_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def keep_best(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Every row with the kept row of its group (least in ``order``, then by id), the size of the group, and whether it is a duplicate.

    The best rows are found by aggregation, so that a group of any size is one row of each map task.
    """
    best = rows.groupBy(key).agg(F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], "id")).alias("best_"), F.count("*").alias("copies"))
    best = best.select(F.col(key).alias("key_"), F.col("best_.id").alias("kept"), "copies")
    return rows.join(best, F.col(key) == F.col("key_")).drop("key_").withColumn("duplicate", F.col("kept") != F.col("id"))


def duplicate_references(rows: DataFrame, key: str, most: int = 10) -> DataFrame:
    """For each kept row where else it was found, the first ``most`` places by id; a task keeps no more of a group."""
    w = Window.partitionBy(key).orderBy("id")
    others = rows.filter("duplicate").select(key, "kept", "id").withColumn("place_", F.row_number().over(w)).filter(F.col("place_") <= most)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    return others.groupBy(key, "kept").agg(listed.alias("also_found_in"))


def budget_prefix(rows: DataFrame, group: str, budget: int) -> DataFrame:
    """Rows of (id, score, tokens) in order of score until the first that doesn't fit."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("total", F.sum("tokens").over(w)).filter(F.col("total") <= budget)


def budget_greedy(rows: DataFrame, group: str, budget: int) -> DataFrame:
    """``group``, id, used: rows (id, score, tokens) in order of score that still fit, skipping those that don't, and what each group uses in all.

    What is larger than the budget goes first. A group is read in order, one
    row at a time; nothing of it is held but what is used. Only ids that are
    kept come back, of which a group has ``budget`` at most.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used = None, 0
        for b in batches:
            kept = []
            for k, (g, tokens) in enumerate(zip(b.iloc[:, 0].tolist(), b["tokens"].tolist(), strict=True)):
                if g != key:
                    key, used = g, 0
                if used + tokens <= budget:
                    used += tokens
                    kept.append(k)
            yield b.iloc[kept, [0, 1, 2]]

    kind = rows.schema[group].dataType.simpleString()
    fits = rows.filter(F.col("tokens") <= budget).select(F.col(group).alias("g"), "id", "tokens", "score")
    fits = fits.repartition("g").sortWithinPartitions("g", F.desc("score"), "id").select("g", "id", "tokens")
    kept = fits.mapInPandas(run, f"g {kind}, id long, tokens long")
    total = Window.partitionBy("g")
    return kept.select(F.col("g").alias(group), F.sum("tokens").over(total).alias("used"), "id")


def budget_two_pass(rows: DataFrame, group: str, budget: int, priority: float = 0.8) -> DataFrame:
    """As ``budget_greedy``, rows of at least ``priority`` before all others; within either part by priority times confidence where there is one."""
    key = F.col("score") * F.col("confidence") if "confidence" in rows.columns else F.col("score")
    first = F.when(F.col("score") >= priority, key + 10).otherwise(key)
    return budget_greedy(rows.withColumn("score", first), group, budget)


def context_verdicts(messages: DataFrame, group: str, system_role: str = "system", least: int = 32, least_similar: int = 10, ratio: float = 0.15) -> DataFrame:
    """``group``, system, dynamic, verdict of messages (role, text): whether what is said beside the instructions is enough, in all and as a share. Fewer tokens do where similar chunks are shown."""
    tokens = F.ceil(F.length(F.trim("text")) / 4)
    system = F.col("role") == system_role
    shown = F.col("text").contains("% similar") | F.col("text").contains("confidence") | F.col("text").contains("embedding")
    m = messages.groupBy(group).agg(
        F.coalesce(F.sum(F.when(system, tokens)), F.lit(0)).alias("system"), F.coalesce(F.sum(F.when(~system, tokens)), F.lit(0)).alias("dynamic"), F.coalesce(F.max(shown), F.lit(False)).alias("shown")
    )
    share = F.col("dynamic") / (F.col("system") + F.col("dynamic"))
    verdict = F.when(F.col("shown"), F.when(F.col("dynamic") < least_similar, "TOO_FEW_TOKENS").otherwise("ok")).when(F.col("dynamic") < least, "TOO_FEW_TOKENS").when(share < ratio, "LOW_DYNAMIC_RATIO").otherwise("ok")
    return m.select(group, "system", "dynamic", verdict.alias("verdict"))


def first_seen(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Of rows alike in their keys the first by ordinal: an aggregation, so that a frequent key is one row a task."""
    others = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(ordinal)).alias("r_"))
    return first.select(*keys, *[F.col("r_")[c].alias(c) for c in others])
