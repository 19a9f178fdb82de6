"""Cutting lineage in driver loops, and joins on parts of names."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` from the checkpoint folder that the session names in ``spark.checkpoint.dir``; a local run without one gets its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoints-")
        sc.setCheckpointDir(path)
    return df.checkpoint()


def parts_of(text: Column, shortest: int = 1) -> Column:
    """All different parts of a text of at least ``shortest`` letters. A text of n letters has n (n + 1) / 2 at most."""
    size = F.length(text)
    every = F.transform(F.sequence(F.lit(1), size), lambda i: F.filter(F.transform(F.sequence(F.lit(1), size - i + 1), lambda k: F.substring(text, i, k)), lambda p: F.length(p) >= shortest))
    return F.when(size > 0, F.array_distinct(F.flatten(every))).otherwise(F.array().cast("array<string>"))


def beginnings(text: Column) -> Column:
    """All beginnings of a text, the empty one and the whole included."""
    return F.transform(F.sequence(F.lit(0), F.length(text)), lambda k: F.substring(text, F.lit(1), k))


def holding(texts: DataFrame, names: DataFrame, spread: int = 16) -> DataFrame:
    """id, name: the texts (id, text) that hold a name (name, of letters, digits, ``_``) anywhere.

    A name can only stand inside a run of such signs, so distinct runs are cut
    into parts, the parts meet the names by equality, and the runs found are
    joined back: no text is compared with all names. Both joins are merges,
    since Spark guesses the size of runs and parts from the files they are made
    of, and would send many times its limit to the driver for a broadcast. A
    part that many runs hold, such as a letter, is spread over ``spread`` tasks.
    """
    runs = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1)))).alias("run"))
    parts = runs.select("run").distinct().select("run", F.pmod(F.xxhash64("run"), F.lit(spread)).alias("by_"), F.explode(parts_of(F.col("run"))).alias("name"))
    wanted = names.select("name").distinct().select("name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("by_"))
    found = parts.hint("merge").join(wanted, ["name", "by_"]).select("run", "name")
    return runs.hint("merge").join(found, "run").select("id", "name").distinct()


def meeting(left: DataFrame, right: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """All pairs of rows of ``left`` and ``right`` alike in ``key``: the columns of both.

    The rows of a key are dealt into blocks of about ``block`` on either side,
    and each pair of blocks meets by itself, so a common key is spread over
    many tasks. Their number is fixed, since small inputs tell nothing of how
    many pairs come out.
    """
    n = lambda rows, c: rows.groupBy(key).agg(F.ceil(F.count("*") / block).alias(c))
    blocks = n(left, "left_").join(n(right, "right_"), key)
    part = lambda rows, by: F.pmod(F.xxhash64(*rows.columns), F.col(by))
    every = lambda by: F.explode(F.sequence(F.lit(0).cast("long"), F.col(by) - 1))
    pair, tasks = [key, "i_", "j_"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in right.columns if c != key]
    many = left.join(blocks, key).select(*left.columns, part(left, "left_").alias("i_"), every("right_").alias("j_")).repartition(tasks, *pair)
    held = right.join(blocks, key).select(*right.columns, every("left_").alias("i_"), part(right, "right_").alias("j_")).repartition(tasks, *pair)
    held = held.groupBy(*pair).agg(F.collect_list(F.struct(*others)).alias("in_"))
    return many.join(held, pair).select(*left.columns, F.explode("in_").alias("r_")).select(*left.columns, *[F.col(f"r_.{c}").alias(c) for c in others])
