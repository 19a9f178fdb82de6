"""Cross-site line deduplication by distinct-site spread; DataFrame functions only.

Each line's hash gets a HyperLogLog sketch of the sites (sources) it occurs
in; partial sketches merge by aggregation before and after the shuffle, so a
line that every document holds is one row from each task.  Lines are joined
with what was found about them without bringing a frequent line's rows
together: the found side is broadcast where a count shows it to be small, and
spread over salts otherwise.  Where a sketch's
estimate is further from the threshold than its error, it decides; the lines
near the threshold get an exact distinct count.  Lines of ``min_sites`` sites
or more are boilerplate and go from every document, except (``keep_first``)
from the one with the smallest id, so that no content is lost altogether.

Lines are compared without the white space around them; blank lines are never
boilerplate.  A line goes wherever it stands in a document.

Defined results: a null text stays null and has 0 lines; a null source counts
as one site of its own; rows with null ids lose boilerplate like others but
are never the first.  Rows of the same id and text are treated alike.  Extra
columns are returned untouched by ``clean_documents`` and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few_join, materialise

#: log2 of a sketch's registers; its relative standard error is 1.04 / sqrt(2**LG_K), 1.6 %.
LG_K = 12
MIN_SITES = 5


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def _lines(docs: DataFrame, *keep: Column) -> DataFrame:
    """hash_ of each non-blank line, with the columns ``keep``."""
    lines = F.transform(F.split("text", "\n"), _trimmed)
    return docs.select(*keep, F.explode(F.filter(lines, lambda x: x != "")).alias("line_")).withColumn("hash_", F.xxhash64("line_")).drop("line_")


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source") -> DataFrame:
    """hash_, first_ (smallest document id), n_sites_ of every line in ``min_sites`` different sites or more.

    ``n_sites_`` is exact near the threshold and the sketch's estimate beyond.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("n")).alias("site_")
    lines = _lines(docs, F.col("doc_id"), site)
    spread = lines.groupBy("hash_").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site_", F.lit(LG_K))).alias("estimate_"), F.min("doc_id").alias("first_"))
    # Four standard errors, and one site for the rounding.
    margin = 1 + int(min_sites * 4 * 1.04 / 2 ** (LG_K / 2) + 1)
    maybe = materialise(spread.filter(F.col("estimate_") >= min_sites - margin), "spread-lines")
    near = maybe.filter(F.col("estimate_") <= min_sites + margin)
    exact = few_join(lines, near.select("hash_"), "hash_", F.col("site_")).select("hash_", "site_").distinct().groupBy("hash_").agg(F.count("*").alias("exact_"))
    told = maybe.join(exact, "hash_", "left").withColumn("n_sites_", F.coalesce("exact_", "estimate_"))
    return told.filter(F.col("n_sites_") >= min_sites).select("hash_", "first_", "n_sites_")


def clean_documents(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", keep_first: bool = True, counted: str = "n_removed") -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and the lines cut in a column named ``counted``, which ``docs`` may not have yet."""
    if counted in docs.columns:
        raise ValueError(f"there is a column {counted}: give another name for the number of lines cut")
    names = docs.columns
    key = F.xxhash64("doc_id", "text")
    boiler = materialise(boilerplate_lines(docs, min_sites, site_col), "boilerplate-lines")
    own = _lines(docs, F.col("doc_id"), key.alias("key_")).distinct()
    hit = few_join(own, boiler, "hash_", F.col("key_"))
    if keep_first:
        hit = hit.filter(~F.col("doc_id").eqNullSafe(F.col("first_")))
    gone = hit.groupBy("key_").agg(F.collect_set("hash_").alias("gone_"))
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row_"), F.col("text").alias("text_"), key.alias("key_"))
    both = rows.join(gone, "key_", "left")
    lines = F.split("text_", "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("gone_"), F.xxhash64(_trimmed(x))) | (_trimmed(x) == ""))
    both = both.withColumn("kept_", F.when(F.col("gone_").isNotNull(), kept))
    text = F.when(F.col("gone_").isNull(), F.col("text_")).otherwise(F.array_join("kept_", "\n"))
    n_removed = F.when(F.col("gone_").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("kept_"))
    columns = [text.alias(n) if n == "text" else F.col("row_")[n].alias(n) for n in names]
    return both.select(*columns, n_removed.cast("long").alias(counted))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", keep_first: bool = True) -> DataFrame:
    """doc_id, text (without boilerplate lines), n_removed of every row."""
    need = docs.select("doc_id", F.col(site_col).alias("source"), "text")
    return clean_documents(need, min_sites, "source", keep_first).select("doc_id", "text", "n_removed")
