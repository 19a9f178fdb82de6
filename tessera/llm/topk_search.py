"""Exact top-k search by inner product, with MaxScore pruning, shard by shard.

The components of a vector are its terms.  For one query and one shard, a
term's contribution lies between a least and a greatest value over the
shard's postings; the difference is the term's bound.  Terms are sorted by
bound.  The essential ones are the shortest head after which the bounds that
remain can't lift a vector over the threshold (the k-th best score so far)
by themselves; their postings are traversed for all vectors.  The others are
probed one by one, only for vectors that can still reach the threshold.
Every comparison keeps equal scores, so the result is exact.

Vectors are dealt to shards of bounded size by a hash with the row's position
in it, and queries to blocks of bounded size; each task scores one block of
queries on one shard, and the shards' best k are merged.  The first shard is
searched first: the k-th best score in it is the threshold that each query
brings to all other shards, which return only what reaches it.  Nothing is
broadcast or collected.

Defined results: rows whose id or vector is null, or whose vector holds a
null or non-finite component, take no part.  Vectors of unequal length are
filled up with zeros.  Scores beyond a long are returned as the nearest long, but
ranked by their exact value.  Queries of the same id are one query (the one whose
components come first in order); a candidate with the query's id is its own
and left out.  Repeated candidate rows each count.  Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, ship_package

SHARD_ROWS = 8192
QUERY_BLOCK = 2048
_SEED_ROWS = 256
_EXACT = 2.0**53
_LONG = 2**63 - 1


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``id_``, ``v_``: floor(scale * x) of each component, for rows that take part."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("long"))
    return df.filter(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id_"), whole.alias("v_"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def maxscore_topk(ids: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, query: np.ndarray, own: int, k: int, least_score: float = -np.inf, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best vectors of a shard for one query, best first; ties to the smaller id.

    ``columns[d]`` holds component d of all vectors (the term's postings), ``low`` and ``high`` its extremes.
    What falls short of ``least_score`` need not be found.  ``counts`` gets the numbers of postings ``read`` and ``pruned``.
    """
    n = len(ids)
    ends = np.stack([query * low, query * high])
    least, most = ends.min(axis=0), ends.max(axis=0)
    order = np.argsort(least - most, kind="stable")
    order = order[(query != 0)[order]]
    rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])  # the most that terms i, i+1, ... can give
    allowed = ids != own
    threshold = least_score
    seed = (query @ columns[:, :_SEED_ROWS])[allowed[:_SEED_ROWS]]
    if len(seed) >= k:
        threshold = max(threshold, np.partition(seed, -k)[-k])
    read = min(n, _SEED_ROWS) * len(order)
    # Essential terms: from the first on, until the others' gains over their least fall short of the threshold.
    gain = np.concatenate([np.cumsum((most - least)[order][::-1])[::-1], [0]])
    base = least[order].sum()
    essential = int(np.argmax(base + gain < threshold)) if (base + gain < threshold).any() else len(order)
    partial = np.zeros(n)
    for d in order[:essential]:
        partial += query[d] * columns[d]
    read += n * essential
    partial[~allowed] = -np.inf
    if essential == len(order):
        at = np.flatnonzero(allowed)
        partial = partial[at]
    else:
        at = np.flatnonzero(partial + rest[essential] >= threshold)
        partial = partial[at]
        if len(at) > 16 * k:
            # The most promising, scored in full, raise the threshold.
            head = np.argpartition(-partial, 8 * k)[: 8 * k]
            full = partial[head] + query[order[essential:]] @ columns[np.ix_(order[essential:], at[head])]
            threshold = max(threshold, np.partition(full, -k)[-k])
            read += len(head) * (len(order) - essential)
        for i in range(essential, len(order)):
            keep = partial + rest[i] >= threshold
            if not keep.all():
                at, partial = at[keep], partial[keep]
            d = order[i]
            partial = partial + query[d] * columns[d, at]
            read += len(at)
    if counts is not None:
        counts["read"] = counts.get("read", 0) + read
        counts["pruned"] = counts.get("pruned", 0) + n * len(order) - read
    at, partial = at[partial >= threshold], partial[partial >= threshold]
    if len(at) > k:
        edge = np.partition(partial, -k)[-k]
        keep = partial >= edge
        at, partial = at[keep], partial[keep]
    best = np.lexsort((ids[at], -partial))[:k]
    return ids[at[best]], partial[best]


def _plain_topk(ids: np.ndarray, matrix: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int, str | None]]:
    """For components so large that doubles can't hold the sums: whole numbers of any size.

    Ids, scores kept within a long, and the exact score as a text that sorts like it.
    """
    q = [int(x) for x in query]
    scored = [(-sum(a * int(b) for a, b in zip(q, row, strict=True)), int(i)) for i, row in zip(ids, matrix, strict=True) if i != own]
    return [(i, max(-_LONG - 1, min(_LONG, -s)), f"{10**59 - s:060d}") for s, i in sorted(scored)[:k]]


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def topk_search(vectors: DataFrame, queries: DataFrame, n_vectors: int, n_queries: int, k: int = 5, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of ``vectors`` (both as ``integer_vectors`` gives them).

    The two numbers of rows only set how many shards and blocks there are.
    """
    ship_package(vectors.sparkSession)
    shards, blocks = max(1, -(-n_vectors // shard_rows)), max(1, -(-n_queries // query_block))
    dealt = vectors.select("id_", "v_", F.pmod(F.xxhash64("id_", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard_"))
    if shards > 1:
        dealt = materialise(dealt, "shards")  # dealt once: both rounds see the same shards
    once = queries.groupBy("id_").agg(F.min("v_").alias("v_"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        got: list[tuple[int, int, int, str | None]] = []
        if a.num_rows and b.num_rows:
            width = max(max((len(x) for x in t.column("v_").combine_chunks()), default=0) for t in (a, b))
            va, vb = _matrix(a.column("v_"), width), _matrix(b.column("v_"), width)
            ids, own, least = a.column("id_").to_numpy(), b.column("id_").to_numpy(), b.column("least_").to_pylist()
            most = float(np.abs(va.astype(np.float64)).max(initial=0)) * float(np.abs(vb.astype(np.float64)).max(initial=0)) * max(width, 1)
            if most < _EXACT:
                columns = np.ascontiguousarray(va.T.astype(np.float64))
                low, high = columns.min(axis=1), columns.max(axis=1)
                for q, i, t in zip(vb.astype(np.float64), own, least, strict=True):
                    found, scores = maxscore_topk(ids, columns, low, high, q, i, k, -np.inf if t is None else t)
                    got += [(int(i), int(x), int(s), None) for x, s in zip(found, scores, strict=True)]
            else:
                for q, i in zip(vb, own, strict=True):
                    got += [(int(i), *x) for x in _plain_topk(ids, va, q, i, k)]
        cols = list(zip(*got, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score", "exact"), cols, kinds, strict=True)})

    def searched(rows: DataFrame, asked: DataFrame, numbers: Column) -> DataFrame:
        left = rows.withColumn("block_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = asked.select("id_", "v_", "least_", F.pmod(F.xxhash64("id_"), F.lit(blocks)).cast("int").alias("block_"), F.explode(numbers).alias("shard_"))
        return left.groupBy("block_", "shard_").cogroup(right.groupBy("block_", "shard_")).applyInArrow(run, "query_id long, vec_id long, score long, exact string")

    found = searched(dealt.filter("shard_ = 0"), once.withColumn("least_", F.lit(None).cast("double")), F.array(F.lit(0)))
    if shards > 1:
        found = materialise(_best(found, k).drop("rank"), "first-shard")
        # A score that a double may not hold is no threshold.
        bound = found.groupBy("query_id").agg(F.min("score").cast("double").alias("least_"), F.count("*").alias("n_"), F.count("exact").alias("odd_")).filter((F.col("n_") == k) & (F.col("odd_") == 0))
        asked = once.join(bound.select(F.col("query_id").alias("id_"), "least_"), "id_", "left")
        found = found.unionByName(searched(dealt.filter("shard_ > 0"), asked, F.sequence(F.lit(1), F.lit(shards - 1))))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
