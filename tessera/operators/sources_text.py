"""Text of source files: snippets, parameters, imports, structural chunks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.documents import line_chunks

#: How syntax nodes are read aloud.
NODE_NAMES = {
    "TSTypeReference": "Type", "TSStringKeyword": "string", "TSNumberKeyword": "number", "TSBooleanKeyword": "boolean", "TSVoidKeyword": "void", "TSUndefinedKeyword": "undefined", "TSNullKeyword": "null",
    "TSAnyKeyword": "any", "TSUnknownKeyword": "unknown", "TSNeverKeyword": "never", "TSObjectKeyword": "object", "TSSymbolKeyword": "symbol", "TSBigIntKeyword": "bigint", "TSArrayType": "Array",
    "TSTupleType": "Tuple", "TSUnionType": "Union", "TSIntersectionType": "Intersection", "TSFunctionType": "Function",
}
#: What begins a declaration, by language: (kind, pattern with the name in a group).
DECLARATIONS = {
    "typescript": (
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
        ("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"), ("type", r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*="), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"),
        ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"),
    ),
    "python": (("function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)"), ("class", r"^\s*class\s+([A-Za-z_]\w*)")),
    "go": (("function", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"), ("type", r"^type\s+([A-Za-z_]\w*)")),
    "rust": (("function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)"), ("struct", r"^\s*(?:pub\s+)?struct\s+([A-Za-z_]\w*)"), ("trait", r"^\s*(?:pub\s+)?trait\s+([A-Za-z_]\w*)")),
    "java": (("class", r"^\s*(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+)?(?:class|interface|enum)\s+([A-Za-z_]\w*)"), ("method", r"^\s*(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\], ]+\s+([A-Za-z_]\w*)\s*\(")),
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]


def resolve_types(signature: Column) -> Column:
    """Names of syntax nodes replaced by what they mean."""
    out = signature
    for k, v in NODE_NAMES.items():
        out = F.regexp_replace(out, k, v)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"TS\((\w+)\)", "$1"), "TS", ""), "TypeType", "Type")


def split_parameters(parameters: Column) -> Column:
    """Parameters parted at commas outside of brackets: one pass over the parts between commas, counting what they open and close."""
    parts = F.split(parameters, ",")
    depth = lambda c: F.regexp_count(c, F.lit(r"[(\[{<]")) - F.regexp_count(F.regexp_replace(c, "=>", ""), F.lit(r"[)\]}>]"))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("open"), F.lit(0).alias("depth"))

    def step(s: Column, x: Column) -> Column:
        whole = F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit(","), x))
        now = s["depth"] + depth(x)
        return F.struct(F.when(now <= 0, F.concat(s["done"], F.array(F.trim(whole)))).otherwise(s["done"]).alias("done"), F.when(now <= 0, "").otherwise(whole).alias("open"), F.greatest(now, F.lit(0)).alias("depth"))

    end = F.aggregate(parts, start, step)
    every = F.when(end["open"] == "", end["done"]).otherwise(F.concat(end["done"], F.array(F.trim(end["open"]))))
    return F.filter(every, lambda p: p != "")


def declarations(text: str, language: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, first line, last line) of each declaration, lines from 1.

    A declaration lasts while brackets it opened are open (in Python: while
    lines are indented deeper than it); those inside another count too.
    """
    lines = text.split("\n")
    rules = [(kind, re.compile(p)) for kind, p in DECLARATIONS.get(language, ())]
    out: list[tuple[str, str, int, int]] = []
    found = [(k, next(((kind, m[1]) for kind, p in rules for m in [p.match(line)] if m), None)) for k, line in enumerate(lines)]
    starts = [(k, *x) for k, x in found if x]
    if language == "python":
        indent = [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]
        open_: list[tuple[int, int, str, str]] = []
        at = {k: (kind, name) for k, kind, name in starts}
        last = 0
        for k, depth in enumerate(indent):
            if depth is None:
                continue
            while open_ and depth <= open_[-1][0]:
                _, begin, kind, name = open_.pop()
                out.append((kind, name, begin + 1, last + 1))
            if k in at:
                open_.append((depth, k, *at[k]))
            last = k
        out += [(kind, name, begin + 1, last + 1) for _, begin, kind, name in open_]
        return sorted(out, key=lambda x: (x[2], -x[3]))
    depths, level = [], 0
    for line in lines:
        level += line.count("{") - line.count("}")
        depths.append(level)
    # A block ends at the first line after which as few brackets are open as before it.
    ends = list(range(len(lines)))
    close: list[tuple[int, int]] = []
    for k, d in enumerate(depths):
        while close and d <= close[-1][1]:
            ends[close.pop()[0]] = k
        if d > (depths[k - 1] if k else 0):
            close.append((k, depths[k - 1] if k else 0))
    for k, _ in close:
        ends[k] = len(lines) - 1
    return [(kind, name, k + 1, ends[k] + 1) for k, kind, name in starts]


def structural_chunks(files: DataFrame, size: int = 2000, overlap: int = 100, least_lines: int = 10, least_chars: int = 100) -> DataFrame:
    """path, chunk, start_line, end_line, symbol, kind, content of files (path, language, text).

    Declarations of more than ``least_lines`` lines or ``least_chars``
    characters are chunks; larger ones than ``size`` are cut by lines, with
    their own line numbers. Chunks are numbered by where they begin, so no two
    share a number. A file without such declarations is cut by lines whole.
    Blank files give nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, language, text in zip(rows.path, rows.language, rows.text, strict=True):
                text = text or ""
                lines = text.split("\n")
                found = []
                for kind, name, first, last in declarations(text, language or ""):
                    content = "\n".join(lines[first - 1 : last])
                    if last - first > least_lines or len(content) > least_chars:
                        pieces = [(first, last, content)] if len(content) <= size else [(first + a - 1, first + b - 1, c) for a, b, c in line_chunks(content, size, overlap)]
                        found += [(a, b, name, kind, c) for a, b, c in pieces]
                if not found:
                    found = [(a, b, None, "lines", c) for a, b, c in line_chunks(text, size, overlap)]
                found = sorted((x for x in found if x[4].strip()), key=lambda x: (x[0], -x[1]))
                out += [(path, k, *x) for k, x in enumerate(found)]
            yield pd.DataFrame(out, columns=["path", "chunk", "start_line", "end_line", "symbol", "kind", "content"])

    return files.select("path", "language", "text").mapInPandas(run, "path string, chunk int, start_line int, end_line int, symbol string, kind string, content string")


def snippet(lines: list[str], first: int, last: int, padding: int = 3) -> tuple[int, int]:
    """First and last line (from 0) of a copyable piece around lines: back to a declaration within 20, on to its closing bracket within 30, and some lines more."""
    begin = next((i for i in range(first, max(0, first - 20) - 1, -1) if re.match(r"(export\s+)?(function|class|const|let|var|interface|type)\s+|(export\s+)?(default\s+)?\{", lines[i].strip())), first)
    depth, opened, end = 0, False, min(len(lines) - 1, last + 15)
    for i in range(last, min(len(lines), last + 30)):
        for ch in lines[i]:
            depth += (ch == "{") - (ch == "}")
            opened = opened or ch == "{"
            if ch == "}" and opened and depth == 0:
                return max(0, begin - padding), min(len(lines) - 1, i + padding)
    return max(0, begin - padding), min(len(lines) - 1, end + padding)


def snippets(places: DataFrame, files: DataFrame) -> DataFrame:
    """id, start_line, end_line, content around each place (id, path, line) of files (path, text), by real line numbers.

    A file goes to Python once, with the different lines asked for, and
    snippets come back a thousand at a time; the places meet those by equality.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path_", "line_", "start_line", "end_line", "content"]
        for rows in batches:
            out = []
            for path, wanted, text in zip(rows.path_, rows.wanted_, rows.text, strict=True):
                lines = (text or "").split("\n")
                for line in wanted:
                    at = min(max(0, int(line) - 1), len(lines) - 1)
                    a, b = snippet(lines, at, at)
                    out.append((path, int(line), a + 1, b + 1, "\n".join(lines[a : b + 1])))
                    if len(out) == 1000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            yield pd.DataFrame(out, columns=columns)

    wanted = places.groupBy(F.col("path").alias("path_")).agg(F.collect_set(F.col("line").cast("long")).alias("wanted_"))
    asked = files.select("path", "text").join(wanted, F.col("path") == F.col("path_")).select("path_", "wanted_", "text")
    found = asked.mapInPandas(run, "path_ string, line_ long, start_line int, end_line int, content string")
    return places.select("id", "path", "line").join(found, (F.col("path") == F.col("path_")) & (F.col("line") == F.col("line_"))).select(F.col("id").cast("long").alias("id"), "start_line", "end_line", "content")


def normalised_snippet(text: Column) -> Column:
    """Without comment lines, placeholders and more than one blank line in a row."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike(r"^(//|/\*|\*|#(?!!))") & ~F.trim(x).rlike(r"^(\.\.\.|TODO\b)"))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n\s*\n(\s*\n)+", "\n\n"))


def embeddable(chunks: DataFrame, max_tokens: int) -> DataFrame:
    """Chunks whose text isn't blank, cut to four characters for each token."""
    return chunks.filter(F.trim("content") != "").withColumn("content", F.substring("content", 1, 4 * max_tokens))


def batches(rows: DataFrame, size: int = 64) -> DataFrame:
    """Rows with the number of their batch within their partition; no shuffle."""
    return rows.withColumn("batch", F.floor(F.monotonically_increasing_id() % (1 << 33) / size).cast("long"))


def json_structure(rows: DataFrame, deepest: int = 100) -> DataFrame:
    """id, depth, nodes, objects, arrays, paths of JSON texts (id, text): key paths with ``[]`` for the items of arrays, each once, in order. What is no JSON has a null depth."""

    def walk(value: object) -> tuple[int, int, int, int, list[str]]:
        depth = nodes = objects = arrays = 0
        paths: dict[str, None] = {}
        stack = [(value, 1, "")]
        while stack:
            v, d, path = stack.pop()
            nodes, depth = nodes + 1, max(depth, d)
            if d > deepest:
                continue
            if isinstance(v, dict):
                objects += 1
                inside = [(x, f"{path}.{k}" if path else k) for k, x in v.items()]
                paths.update(dict.fromkeys(p for _, p in inside))
            elif isinstance(v, list):
                arrays += 1
                inside = [(x, path + "[]") for x in v]
            else:
                continue
            stack += [(x, d + 1, p) for x, p in reversed(inside)]
        return depth, nodes, objects, arrays, list(paths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text in zip(b["id"], b["text"], strict=True):
                try:
                    out.append((i, *walk(json.loads(text))))
                except (TypeError, ValueError, RecursionError):
                    out.append((i, None, 0, 0, 0, []))
            frame = pd.DataFrame(out, columns=["id", "depth", "nodes", "objects", "arrays", "paths"])
            yield frame.astype({"depth": "Int32"})

    return rows.select("id", "text").mapInPandas(run, "id long, depth int, nodes int, objects int, arrays int, paths array<string>")
