"""From a log to ranked matches: stack frames, symbols they fall in, scores, a summary, suggestions.

A log is rows of (log, line, text), an error a row of (log, line, file, at,
symbol, type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The forms of a stack frame.
NODE = r"at (?:([^\s]+)\s+)?\(?(.+):(\d+):(\d+)\)?"
PYTHON = r'File "(.+)", line (\d+)(?:, in (.+))?'
ERROR = r"^\s*([A-Za-z]*Error):"
#: What a type of error is worth; others with a type 2, none 1.
SEVERITY = {"TypeError": 5, "ReferenceError": 4, "SyntaxError": 5, "Error": 3}
#: Advice by type of error.
ADVICE = {
    "TypeError": ("Check for null/undefined values before property access", "Verify type compatibility in assignments and function calls"),
    "ReferenceError": ("Check variable declarations and import statements", "Verify spelling of variable/function names"),
    "SyntaxError": ("Check for missing semicolons, brackets, or quotes", "Verify syntax in recently modified files"),
}
SIMILAR = ("Review semantically similar code patterns found via embeddings", "Consider if the error relates to similar functionality elsewhere in the codebase")
SPREAD = "Error spans multiple files - consider architectural issues"
RECENT = "Focus on high-scoring matches as they may indicate recent changes"


def stack_frames(log: DataFrame) -> DataFrame:
    """Frames of each log; the type of an error holds for the lines below it. Windows run within a log."""
    w = Window.partitionBy("log").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    typed = F.when(F.col("text").rlike(ERROR), F.regexp_extract("text", ERROR, 1))
    rows = log.withColumn("type", F.last(typed, ignorenulls=True).over(w))
    node, x = F.col("text").rlike(NODE), lambda p, g: F.regexp_extract("text", p, g)
    pick = lambda a, b: F.when(node, x(NODE, a)).otherwise(x(PYTHON, b))
    rows = rows.filter(node | F.col("text").rlike(PYTHON))
    return rows.select("log", "line", pick(2, 1).alias("file"), pick(3, 2).cast("int").alias("at"), F.nullif(pick(1, 3), F.lit("")).alias("symbol"), "type")


def fallback_tokens(logs: DataFrame, frames: DataFrame, most: int = 5) -> DataFrame:
    """Of logs (log, text) without frames the first different words of over two letters, as symbols: log, place, symbol."""
    words = F.array_distinct(F.filter(F.split("text", "[^A-Za-z0-9_]+"), lambda t: F.length(t) > 2))
    bare = logs.join(frames.select("log").distinct(), "log", "left_anti")
    return bare.select("log", F.posexplode(F.slice(words, 1, most)).alias("place", "symbol"))


def error_context(log: DataFrame, width: int = 200) -> DataFrame:
    """log, line, context: a line and what follows it, cut to ``width`` characters. Each further line adds one at least, so no more than ``width`` lines are looked at."""
    w = Window.partitionBy("log").orderBy("line").rowsBetween(0, width)
    text = F.array_join(F.collect_list(F.substring("text", 1, width)).over(w), " ")
    return log.select("log", "line", F.substring(F.trim(text), 1, width).alias("context"))


def match_scores(matches: DataFrame, errors: DataFrame, ages: DataFrame) -> DataFrame:
    """Matches (id, file, symbol, similarity) with severity, recency, frequency, bonus and score.

    The severity is that of the first error (file, ordinal, type) in the file;
    recency that of the file (file, days); frequency how often a symbol was
    matched, counted before it is joined.
    """
    first = errors.groupBy("file").agg(F.min_by("type", "ordinal").alias("type"))
    severity = F.lit(2)
    for k, v in SEVERITY.items():
        severity = F.when(F.col("type") == k, v).otherwise(severity)
    times = matches.groupBy("symbol").agg(F.count("*").alias("frequency"))
    rows = matches.join(first, "file", "left").join(ages.select("file", "days"), "file", "left").join(times, "symbol", "left")
    recency = F.when(F.col("days") < 7, 4).when(F.col("days") < 30, 3).when(F.col("days") < 90, 2).otherwise(1)
    bonus = F.when(F.col("similarity").isNull(), 0).otherwise(F.floor(F.col("similarity") * 10 + 0.5)).cast("int")
    rows = rows.select("id", "file", "symbol", F.when(F.col("type").isNull(), 1).otherwise(severity).alias("severity"), recency.alias("recency"), F.coalesce("frequency", F.lit(1)).alias("frequency"), bonus.alias("bonus"))
    return rows.withColumn("score", F.col("severity") + F.col("recency") + F.col("frequency") + F.col("bonus"))


def ranked_matches(scored: DataFrame, most: int = 20) -> DataFrame:
    best = scored.orderBy(F.desc("score"), "id").limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def debug_summary(errors: DataFrame, scored: DataFrame, top: int = 5) -> DataFrame:
    """One row: errors, matches, different files, and the best matches as text."""
    best = scored.orderBy(F.desc("score"), "id").limit(top)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "file"))), lambda x: F.concat(x["file"], F.lit(":"), x["id"].cast("string"))), ",")
    e = errors.agg(F.count("*").alias("errors"))
    m = scored.agg(F.count("*").alias("matches"), F.count_distinct("file").alias("files"))
    return e.crossJoin(m).crossJoin(best.agg(text.alias("top")))  # one row each


def suggestions(types: Column, similar: Column, files: Column, best: Column, most: int = 5) -> Column:
    """Advice on the types of errors, similar code, files and the best score of a log, five at most."""
    rows = [F.when(F.array_contains(types, t), text) for t, texts in ADVICE.items() for text in texts]
    rows += [F.when(similar > 0, text) for text in SIMILAR] + [F.when(files > 5, SPREAD), F.when(best > 50, RECENT)]
    return F.slice(F.array_compact(F.array(*rows)), 1, most)


#: Fixed value: a heading of a rendered list of similar chunks.
HEADING = r"^### \d+\.\s+(.+)\s+\(([0-9.]+)% similar\)$"


def similar_chunks(text: Column) -> Column:
    """(path, confidence) of each heading ``### 1. path (45.4% similar)`` in a rendered text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(HEADING))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, HEADING, 1).alias("path"), (F.regexp_extract(x, HEADING, 2).cast("double") / 100).alias("confidence")))
