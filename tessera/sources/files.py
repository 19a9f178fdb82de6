"""Files as tables: scans, manifests, filters and writers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages of file extensions, as a discovery reports them, and as chunks are marked.
DISCOVERED = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "cpp": "cpp", "c": "cpp", "h": "cpp",
    "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "md": "markdown", "json": "json", "html": "html", "htm": "html", "yaml": "json", "yml": "json",
}
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "py": "python", "go": "go", "rs": "rust", "java": "java",
    "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "c", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "csharp", "php": "php", "rb": "ruby", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala",
    "sh": "bash", "bash": "bash", "zsh": "bash", "ex": "elixir", "exs": "elixir", "hs": "haskell", "lhs": "haskell", "lua": "lua", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml",
    "html": "html", "css": "css", "sql": "sql",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column, otherwise: str = "text", languages: dict[str, str] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (languages or LANGUAGES).items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(otherwise))


def scan(spark: SparkSession, root: str, glob: str = "*", largest: int = 100_000, extensions: list[str] | None = None, most: int = 10_000) -> DataFrame:
    """path, length, modified, language and text of the files under a folder; fails where there are more than ``most``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    kept = files.filter(F.col("length") <= largest)
    if extensions:
        kept = kept.filter(extension(F.col("path")).isin([e.lower() for e in extensions]) | F.lower("path").contains("readme"))
    if kept.select("path").limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files under {root}")
    return kept.select("path", "length", F.col("modificationTime").alias("modified"), language(F.col("path")).alias("language"), F.col("content").cast("string").alias("text"))


def manifest(spark: SparkSession, root: str, largest: int = 5_000_000) -> DataFrame:
    """path, size, mtime and sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= largest)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ``**`` crosses folders, ``*`` and ``?`` don't."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """One alternation, compiled once."""
    return path.rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(False)


def ignored(path: Column, rules: list[str]) -> Column:
    """Ignore-file semantics: comments and blanks don't count, ``!`` takes back, the last match wins."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        back, body = rule.startswith("!"), rule.lstrip("!")
        body = body.rstrip("/") + "/**" if body.endswith("/") else body
        pattern = glob_pattern(body if "/" in body.rstrip("/") else f"**/{body}")
        out = F.when(path.rlike(pattern), not back).otherwise(out)
    return out


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_markdown(df: DataFrame, path: str, title: str, mode: str = "errorifexists") -> None:
    """A row as a line of a Markdown list, below a title in each part."""
    line = F.concat(F.lit("- "), F.concat_ws(", ", *[F.concat(F.lit(f"**{c}**: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]))
    df.select(line.alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def write_xml(df: DataFrame, path: str, row: str = "row", mode: str = "errorifexists") -> None:
    df.write.mode(mode).format("xml").option("rowTag", row).option("rootTag", f"{row}s").save(path)


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_row(df: DataFrame) -> Column:
    """A row as a row of an HTML table."""
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns], F.lit("</tr>"))


def compact_row(df: DataFrame) -> Column:
    """A row as ``name=value`` parts."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns])


def write_lines(df: DataFrame, line: Column, path: str, mode: str = "errorifexists") -> None:
    """One line of text for each row: ``html_row``, ``compact_row`` or another."""
    df.select(line.alias("value")).write.mode(mode).text(path)
