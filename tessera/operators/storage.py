"""Administration of a chunk table: statistics, quotas, eviction, generations, synchronisation.

Chunks are rows of (project, file, chunk_index, created_at, size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that one evicted chunk of a stale generation frees.
CHUNK_BYTES = 2560


def project_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("project").agg(F.count("*").alias("total_chunks"), F.count_distinct("file").alias("total_files"))


def recent_files(files: DataFrame, chunks: DataFrame, limit: int = 50) -> DataFrame:
    """Files by their last chunk, those without chunks last."""
    by_file = chunks.groupBy("file").agg(F.max("created_at").alias("last_update"), F.count("*").alias("chunks"), F.count_distinct("chunk_index").alias("distinct_chunks"))
    rows = files.join(by_file, "file", "left").fillna(0, ["chunks", "distinct_chunks"])
    return rows.orderBy(F.col("last_update").desc_nulls_last(), "file").limit(limit)


def storage_usage(chunks: DataFrame, quota: float) -> DataFrame:
    used = F.sum("size")
    return chunks.groupBy("project").agg(F.count("*").alias("chunks"), F.count_distinct("file").alias("files"), used.alias("used"), F.round(used * 100 / quota, 6).alias("percent"), F.greatest(F.lit(0.0), quota - used).alias("remaining"))


def storage_stats(chunks: DataFrame, compact: Column, dims: int = 1536) -> DataFrame:
    """Rows in the compact (one byte) and the plain (four bytes) format, and what the former saves."""
    n = chunks.groupBy("project").agg(F.count("*").alias("total"), F.count_if(compact).alias("int8"), F.count_if(~compact | compact.isNull()).alias("float32"))
    saved = F.col("int8") * dims * 3
    return n.withColumn("saved_bytes", saved).withColumn("ratio", F.round(F.col("total") * dims * 4 / (F.col("total") * dims * 4 - saved), 6))


def stale_generations(chunks: DataFrame) -> DataFrame:
    """Files whose chunks were made on more than one day."""
    day = F.to_date("created_at")
    return chunks.groupBy("file").agg(F.count_distinct(day).alias("generations"), F.count("*").alias("chunks"), F.max(day).cast("string").alias("newest")).filter("generations > 1")


def stale_cleanup(chunks: DataFrame) -> DataFrame:
    """What deleting all but the newest generation of each file frees."""
    w = Window.partitionBy("file").orderBy(F.to_date("created_at").desc())
    rows = chunks.withColumn("generation", F.dense_rank().over(w))
    out = rows.groupBy("file").agg(F.count_if(F.col("generation") > 1).alias("deleted"), F.count_if(F.col("generation") == 1).alias("kept"))
    return out.filter("deleted > 0").withColumn("freed", F.col("deleted") * CHUNK_BYTES)


def lru_eviction(chunks: DataFrame, target: float) -> DataFrame:
    """The oldest chunks of each project until ``target`` is freed, the crossing one included."""
    w = Window.partitionBy("project").orderBy("created_at", "file", "chunk_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = chunks.withColumn("freed", F.sum("size").over(w))
    return rows.filter(F.col("freed") - F.col("size") < target)


def quota_admission(chunks: DataFrame, quota: float, new_size: float) -> DataFrame:
    """Whether a new chunk fits a project's quota, after evicting at most everything else."""
    used = chunks.groupBy("project").agg(F.sum("size").alias("used"))
    over = F.greatest(F.lit(0.0), F.col("used") + new_size - quota)
    verdict = F.when(F.col("used") + new_size <= quota, "admit").when(F.lit(new_size) <= quota, "evict").otherwise("reject")
    return used.withColumn("to_free", over).withColumn("verdict", verdict)


def latest_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Upsert semantics over an append-only table: the last version of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("version_", F.row_number().over(w)).filter("version_ = 1").drop("version_")


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` put in place of those of the same key."""
    return base.join(changes.select(*key), key, "left_anti").unionByName(changes)


def stale_against_disk(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """Stored files missing on disk, and those changed after they were stored."""
    both = stored.join(disk, "file", "left")
    state = F.when(F.col("mtime").isNull(), "missing").when(F.col("mtime") > F.col("last_update"), "stale")
    return both.withColumn("state", state).filter("state is not null")


def manifest_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Files to send: those the remote side lacks or has with another hash."""
    r = remote.select("file", F.col("hash").alias("remote_hash"))
    both = local.join(r, "file", "left")
    reason = F.when(F.col("remote_hash").isNull(), "missing").when(F.col("remote_hash") != F.col("hash"), "hash_mismatch")
    return both.withColumn("reason", reason).filter("reason is not null").select("file", "reason")


def unused(defined: DataFrame, used: DataFrame) -> DataFrame:
    """Names defined and used nowhere."""
    return defined.join(used, "name", "left_anti").distinct()


def normalised_provider(provider: Column) -> Column:
    """The provider that a label stands for: some labels are names of models."""
    low = F.lower(F.coalesce(provider, F.lit("")))
    local = low.contains("minilm") | low.contains("transformers") | low.contains("e5")
    return F.when(low.startswith("text-embedding-"), "openai").when(low.startswith("voyage-") | (low == "voyageai"), "voyageai").when(local, "local").otherwise(provider)


def provider_dimensions(chunks: DataFrame) -> DataFrame:
    """provider, dims, n: chunks (provider, dims) of each provider, normalised before they are counted."""
    return chunks.groupBy(normalised_provider(F.col("provider")).alias("provider"), "dims").agg(F.count("*").alias("n"))


def generation_lists(chunks: DataFrame) -> DataFrame:
    """file, generations: for files of several days the days, newest first, each with its chunks in order."""
    day = F.to_date("created_at").cast("string")
    each = chunks.groupBy("file", day.alias("day")).agg(F.array_sort(F.collect_list("chunk_index")).alias("chunks"))
    w = F.collect_list(F.struct("day", "chunks"))
    rows = each.groupBy("file").agg(F.reverse(F.array_sort(w)).alias("generations"))
    return rows.filter(F.size("generations") > 1)


def dimension_conflicts(chunks: DataFrame, dims: int) -> DataFrame:
    """dims, n, projects: dimensions other than ``dims`` that chunks (project, dims) have, and in which projects."""
    odd = chunks.filter(F.col("dims").isNotNull() & (F.col("dims") != dims)).groupBy("dims", "project").agg(F.count("*").alias("n"))
    return odd.groupBy("dims").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("project")), lambda p: p.cast("string")), ",").alias("projects"))


def without_conflicts(chunks: DataFrame, dims: int) -> DataFrame:
    """Chunks less those of another dimension, project by project; unknown ones stay."""
    return chunks.filter(F.col("dims").isNull() | (F.col("dims") == dims))


def active_projects(stats: DataFrame) -> DataFrame:
    """Projects (project, total_chunks, updated_at) that hold chunks, the last updated first."""
    return stats.filter("total_chunks > 0").orderBy(F.col("updated_at").desc_nulls_last(), "project")


def register(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """Projects (project, path, added_at, updated_at) with ``changes`` put in place by id; what a project was added at stays."""
    old = projects.select("project", F.col("added_at").alias("old_"))
    kept = projects.join(changes.select("project"), "project", "left_anti")
    new = changes.join(old, "project", "left").withColumn("added_at", F.coalesce("old_", "added_at")).drop("old_")
    return kept.unionByName(new)


def find_project(projects: DataFrame, project=None, path: str | None = None) -> DataFrame:
    """The project with an id, or with a path."""
    return projects.filter(F.col("project") == project) if project is not None else projects.filter(F.col("path") == path)


def with_legacy(wanted: DataFrame, stats: DataFrame) -> DataFrame:
    """project, chunks, source: the statistics (project, chunks) of each project (project, legacy), or of its legacy id where its own are missing or empty."""
    own = stats.select(F.col("project"), F.col("chunks").alias("own_"))
    old = stats.select(F.col("project").alias("legacy"), F.col("chunks").alias("old_"))
    rows = wanted.join(own, "project", "left").join(old, "legacy", "left")
    use = F.coalesce(F.col("own_"), F.lit(0)) > 0
    return rows.select("project", F.when(use, F.col("own_")).otherwise(F.coalesce("old_", F.lit(0))).alias("chunks"), F.when(use, "own").when(F.col("old_") > 0, "legacy").otherwise("none").alias("source"))


def admit(chunks: DataFrame, quota: float, new_size: float) -> DataFrame:
    """project, verdict, evicted, freed, used_after: what admitting a chunk takes, looked at again after the oldest chunks have gone."""
    plan = quota_admission(chunks, quota, new_size)
    w = Window.partitionBy("project").orderBy("created_at", "file", "chunk_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = chunks.withColumn("freed_", F.sum("size").over(w)).join(plan.select("project", "to_free"), "project")
    gone = rows.filter(F.col("freed_") - F.col("size") < F.col("to_free")).groupBy("project").agg(F.count("*").alias("evicted"), F.sum("size").alias("freed"))
    out = plan.join(gone, "project", "left").fillna(0, ["evicted", "freed"])
    may = F.col("verdict") != "reject"
    after = F.when(may, F.col("used") - F.col("freed")).otherwise(F.col("used"))
    fits = after + new_size <= quota
    return out.select("project", F.when(may & fits, F.col("verdict")).otherwise("reject").alias("verdict"), F.when(may, F.col("evicted")).otherwise(0).alias("evicted"), F.when(may, F.col("freed")).otherwise(0.0).alias("freed"), F.when(may & fits, after + new_size).otherwise(after).alias("used_after"))


def changed_against(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (file, hash) whose hash differs from the stored one; missing and unreadable ones count as changed."""
    s = stored.select("file", F.col("hash").alias("stored_"))
    return current.join(s, "file", "left").filter(F.col("hash").isNull() | ~F.col("hash").eqNullSafe(F.col("stored_"))).drop("stored_")


def newer_than_stored(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (file, mtime) modified after their last chunk (file, last_update), or without one."""
    return files.join(stored.select("file", "last_update"), "file", "left").filter(F.col("last_update").isNull() | (F.col("mtime") > F.col("last_update"))).drop("last_update")


def replace_files(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Delete-then-insert by file: all chunks of the changed files go, whatever their number, and the new ones come in."""
    return base.join(changes.select("file").distinct(), "file", "left_anti").unionByName(changes)


def changed_files(diff: DataFrame, untracked: DataFrame, everything: DataFrame, dirty: bool) -> DataFrame:
    """Files (file) to look at again: all if the tree is dirty, else those that differ and those not tracked, each once."""
    return everything.distinct() if dirty else diff.unionByName(untracked).distinct()
