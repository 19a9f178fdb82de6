"""Import graphs as edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut, holding


def degree_boost(edges: DataFrame) -> DataFrame:
    """Outgoing edges and one and a half times the incoming ones, for every node."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    both = out.join(into, "node", "full").fillna(0, ["n_out", "n_in"])
    return both.withColumn("degree", F.col("n_out") + F.col("n_in") * 1.5)


def neighbours(starts: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """Distinct nodes one edge from the starts (node), at most ``most``, by id."""
    hop = starts.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
    return hop.join(starts, "node", "left_anti").orderBy("node").limit(most)


def reachable(starts: DataFrame, edges: DataFrame, depth: int | None = None, backwards: bool = False) -> DataFrame:
    """Every node reachable from the starts (node), with its distance: breadth first, until nothing new is found or ``depth`` steps are made.

    Each round joins only the new frontier, and is written to the checkpoint
    folder, so that plans don't grow and lost executors cost one round.
    """
    a, b = ("dst", "src") if backwards else ("src", "dst")
    hops = edges.select(F.col(a).alias("from_"), F.col(b).alias("to_")).distinct()
    seen = frontier = cut(starts.select("node", F.lit(0).alias("distance")).distinct())
    k = 0
    while depth is None or k < depth:
        k += 1
        step = frontier.join(hops, F.col("node") == F.col("from_")).select(F.col("to_").alias("node")).distinct()
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(k).alias("distance")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if k % 10 == 0:
            seen = cut(seen)
    return seen


def client_modules(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules (node) that are client code: those marked, and whatever they import (edges src -> dst), however far."""
    return reachable(marked, edges).select("node")


def dependency_use(modules: DataFrame, imports: DataFrame, weights: DataFrame) -> DataFrame:
    """name, size, files, client_files: dependencies (name, size) that modules (node, client) import (node, name), by name or a path below it.

    An import is looked up by all its beginnings that end before a slash.
    """
    pieces = F.split("name", "/")
    stems = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.array_join(F.slice(pieces, F.lit(1), k), "/"))
    used = imports.select("node", F.explode(stems).alias("name")).distinct().join(weights, "name").join(modules, "node")
    return used.groupBy("name", "size").agg(F.count_distinct("node").alias("files"), F.count_distinct(F.when(F.col("client"), F.col("node"))).alias("client_files"))


def bundle(modules: DataFrame, imports: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """The heaviest dependencies of a page's modules, with the size of all of them and of those that clients use."""
    used = dependency_use(modules, imports, weights)
    total = used.agg(F.sum("size").alias("total"), F.coalesce(F.sum(F.when(F.col("client_files") > 0, F.col("size"))), F.lit(0)).alias("client_total"))
    return used.orderBy(F.desc("size"), "name").limit(k).crossJoin(total)  # one row


def split_candidates(modules: DataFrame, imports: DataFrame, weights: DataFrame, heavy: int = 100, least: int = 50) -> DataFrame:
    """node, saves: modules that could be loaded later, by the size of the heavy dependencies they import; over ``least`` only."""
    pieces = F.split("name", "/")
    stems = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.array_join(F.slice(pieces, F.lit(1), k), "/"))
    used = imports.select("node", F.explode(stems).alias("name")).distinct().join(weights.filter(F.col("size") > heavy), "name").join(modules.select("node"), "node", "left_semi")
    return used.groupBy("node").agg(F.sum("size").alias("saves")).filter(F.col("saves") > least)


def definitions(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each place a name is used at (name, file): the chunk (id, file, name it defines) with the smallest id that defines it, whatever the case, and how near it stands: 0.9 in the same folder, 0.7 above or below, else 0.5."""
    low = lambda c: F.lower(F.col(c))
    first = chunks.groupBy(low("name").alias("key_")).agg(F.min(F.struct("id", F.col("file").alias("at_")))["id"].alias("id"), F.min(F.struct("id", F.col("file").alias("at_")))["at_"].alias("at_"))
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    rows = names.join(first, low("name") == F.col("key_"))
    here, there = folder(F.col("file")), folder(F.col("at_"))
    near = F.when(here == there, 0.9).when(here.contains(there) | there.contains(here), 0.7).otherwise(0.5)
    return rows.select("name", "file", "id", near.alias("score"))


def enforce_anchors(chosen: DataFrame, chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor, id, score: for each anchor (anchor) that a chosen chunk's symbols (id, file, symbols) hold, the chunk that defines it, unless it is chosen.

    Of several chunks that hold an anchor the one with the smallest id counts.
    """
    held = holding(chosen.select("id", F.array_join("symbols", " ").alias("text")), anchors.select(F.col("anchor").alias("name")))
    first = held.join(chosen.select("id", "file"), "id").groupBy("name").agg(F.min_by("file", "id").alias("file"))
    found = definitions(first, chunks).join(chosen.select("id"), "id", "left_anti")
    return found.select(F.col("name").alias("anchor"), "id", F.greatest("score", F.lit(0.5)).alias("score"))


def one_hop(chosen: DataFrame, chunks: DataFrame, decay: float = 0.8) -> DataFrame:
    """id, score: chunks that define what the chosen ones use (id, file, symbols), not chosen themselves; each symbol is looked up once, from the chosen chunk with the smallest id."""
    used = chosen.select("id", "file", F.explode("symbols").alias("name")).groupBy("name").agg(F.min_by("file", "id").alias("file"))
    found = definitions(used, chunks).join(chosen.select("id"), "id", "left_anti")
    return found.groupBy("id").agg(F.round(F.max("score") * decay, 6).alias("score"))
