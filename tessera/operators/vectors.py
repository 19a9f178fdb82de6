"""Vector search over a table of embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V


def similarities(vectors: DataFrame, query: list[float]) -> DataFrame:
    return vectors.select("vec_id", "label", F.round(V.cosine(F.col("embedding"), V.literal(query)), 6).alias("similarity"))


def top_similar(vectors: DataFrame, query: list[float], limit: int = 10, threshold: float = 0.2) -> DataFrame:
    """The nearest vectors, in two regimes.

    Below a threshold of 0.3 the best ``limit`` rows less those of similarity
    0.05 or under; else those that reach the threshold, and if none does the
    best three.  Only the ``limit`` best rows (a TakeOrderedAndProject) are
    looked at as a group.
    """
    best = similarities(vectors, query).orderBy(F.desc("similarity"), "vec_id").limit(limit)
    if threshold < 0.3:
        return best.filter(F.col("similarity") > 0.05)
    all_rows = Window.partitionBy()
    reached = F.count_if(F.col("similarity") >= threshold).over(all_rows)
    place = F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_id"))
    best = best.withColumn("reached_", reached).withColumn("place_", place)
    return best.filter((F.col("similarity") >= threshold) | ((F.col("reached_") == 0) & (F.col("place_") <= min(3, limit)))).drop("reached_", "place_")


#: Queries that are compared with all vectors at once, vectors that a task compares at once, and what rounding can hide.
QUERIES_AT_ONCE, VECTORS_AT_ONCE, MARGIN = 2000, 1000, 3e-6


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _near(vectors: DataFrame, ids: list, units: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, embedding: of the vectors a task reads those that can be among the k nearest of a query; what is not of the queries' length is passed on."""
    width = units.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), units))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, q = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, VECTORS_AT_ONCE):
                b = batch.slice(begin, VECTORS_AT_ONCE)
                lists = b.column(1)
                fits = np.fromiter((x is not None and len(x) == width and None not in x for x in lists.to_pylist()), bool, len(lists)) if lists.null_count or (pc.list_value_length(lists).to_numpy(zero_copy_only=False) != width).any() or lists.flatten().null_count else np.ones(len(lists), bool)
                good = b.filter(pa.array(fits))
                at, which = np.nonzero(np.broadcast_to(~fits[:, None], (len(fits), len(queries))))
                if good.num_rows:
                    rows = _unit(good.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))
                    near = np.nan_to_num(rows @ q.T, nan=-2.0)
                    near[good.column(0).to_numpy(zero_copy_only=False)[:, None] == queries[None, :]] = -np.inf
                    if len(near) > k:
                        least = np.partition(near, -k, axis=0)[-k] - MARGIN
                        i, j = np.nonzero((near >= least) & np.isfinite(near))
                    else:
                        i, j = np.nonzero(np.isfinite(near))
                    at, which = np.concatenate([at, np.flatnonzero(fits)[i]]), np.concatenate([which, j])
                found = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(queries[which]), found.column(0), found.column(1)], names=["query_id", "vec_id", "embedding"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, f"query_id long, vec_id long, embedding {kind}")


def batch_top_similar(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k nearest vectors (vec_id, embedding) of each query (query_id, q), ties to the smaller id.

    All pairs are looked at, by matrix products over blocks of queries and
    vectors; what can't be among the k nearest of its task goes at once, and
    the rest is compared exactly. The queries are counted, and come in blocks of
    ``QUERIES_AT_ONCE`` on average: one pass over the vectors for each block.
    """
    blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    out = None
    for n in range(blocks):
        some = queries.select(F.col("query_id").cast("long").alias("query_id"), "q")
        some = some.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n) if blocks > 1 else some
        by_width: dict[int, list] = {}
        for row in some.filter("q is not null").collect():
            by_width.setdefault(len(row.q), []).append(row)
        for width, rows in by_width.items():
            units = _unit(np.array([[0.0 if x is None else x for x in r.q] for r in rows], np.float64).reshape(len(rows), width))
            pairs = _near(vectors, [r.query_id for r in rows], units, k).filter("vec_id <> query_id").join(F.broadcast(some), "query_id")
            pairs = pairs.select("query_id", "vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
            best = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            out = best if out is None else out.unionByName(best)
    if out is None:
        return vectors.select(F.lit(None).cast("long").alias("query_id"), F.col("vec_id").cast("long").alias("vec_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    return out


def mmr_rerank(candidates: DataFrame, limit: int = 15, weight: float = 0.3, cap: int = 3) -> DataFrame:
    """Greedy re-ranking by relevance and diversity, with at most ``cap`` rows of a facet.

    ``candidates``: query_id, vec_id, facet, score, embedding, a bounded number
    for each query.  The score of a candidate is ``weight * score +
    (1 - weight) * diversity``; diversity is the largest distance to what is
    selected, and 1 for the first.  Of equal candidates the first in order of
    score wins.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "vec_id"], ascending=[False, True]).reset_index(drop=True)
        x = np.array(rows["embedding"].tolist(), np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        distance = 1.0 - x @ x.T
        chosen: list[int] = []
        used: dict[object, int] = {}
        left = list(range(len(rows)))
        while left and len(chosen) < limit:
            best, at = -1.0, None
            for i in left:
                if used.get(rows.facet[i], 0) >= cap:
                    continue
                value = weight * rows.score[i] + (1 - weight) * (distance[i, chosen].max() if chosen else 1.0)
                if value > best + 1e-12:
                    best, at = value, i
            if at is None:
                break
            chosen.append(at)
            used[rows.facet[at]] = used.get(rows.facet[at], 0) + 1
            left.remove(at)
        out = rows.loc[chosen, ["query_id", "vec_id", "facet", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, vec_id long, facet string, score double, rank int")


def decoded_chunks(rows: DataFrame) -> DataFrame:
    """Stored rows (id, format, data, scale, symbols) with the vector decoded by its format and the symbols read from their JSON; what is no JSON gives none."""
    vector = F.when(F.col("format") == "int8", V.dequantize(F.col("data"), F.col("scale"))).otherwise(F.transform("data", lambda x: x.cast("double")))
    return rows.select("id", vector.alias("embedding"), F.coalesce(F.from_json("symbols", "array<string>"), F.array().cast("array<string>")).alias("symbols"))


def quantisation_savings(vectors: DataFrame, by: str) -> DataFrame:
    """``by``, n, plain, compact, saved_percent: the JSON bytes of vectors as they are and quantised (with scale), and what quantising saves."""
    scale = V.int8_scale(F.col("embedding"))
    rows = vectors.select(by, F.octet_length(F.to_json(F.struct("embedding"))).alias("a"), F.octet_length(F.to_json(F.struct(V.quantize_int8(F.col("embedding"), scale).alias("data"), scale.alias("scale")))).alias("b"))
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum("a").alias("plain"), F.sum("b").alias("compact"))
    return out.withColumn("saved_percent", F.round((1 - F.col("compact") / F.col("plain")) * 100, 2))
