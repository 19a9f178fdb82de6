"""N-gram Jaccard join by chosen paths: all links between texts whose word-shingle sets are similar.

Sets are split recursively on sampled shared tokens.  At a node of a run each
set chooses those of its tokens whose hash, keyed by the node, is below
``1 / (similarity * size)``: the same for all sets, so that similar sets
choose a common token with probability over one half, and each chosen token
leads to a child node.  Buckets of bounded size are compared by brute force;
larger ones are split once more, and what is still over ``DEEP`` sets again and
again, up to ``DEPTH`` levels, unless most of a bucket stays together in its
children (then it is a group of near copies, and splitting it is useless).  A pair at the threshold shares one node of a run on
average, so that ``runs`` = 8 independent runs miss it with a chance of exp(-8),
0.03 %, of exp(-5), 0.7 %, if every bucket they share is split once more, and
of at most exp(-4.4), 1.2 %, if all are split to the last level; more similar pairs are missed less.
What is not split is compared whole, whatever its size: its sets are dealt to
blocks by hash, and each pair of blocks is one task.  No pair is ever emitted:
a task returns for each set the number of links it found and one edge to a
representative of its component in the task.  A pair that meets in several
buckets is counted in the first of them only.

Texts with the same shingle set are one set (a class of copies) from the
start.  The result has a row for each document: the class (the smallest id of
its connected component of links) and its number of links, copies included.

Defined results: documents without words (null and empty texts too) have no
links and are their own class.  Texts of fewer than ``width`` words have one
shingle.  Rows with null ids take no part in links and have a null class.
Repeated ids with one text are one document; with different texts they are
different texts of one id, and the id's row has the smallest class of them and
the sum of their links.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, GOLDEN, few_join, materialise, mix64, shingle_hashes, ship_package, shuffle_partitions, slices, word_hashes

WIDTH, SIMILARITY, RUNS = 5, 0.8, 8
#: Sets of a bucket up to which it is compared without splitting it further.
LIMIT = 256
#: Sets of a bucket beyond which it is split on deeper levels than the first two, and how many of those there are; what is larger after them is compared as it is.
DEEP, DEPTH = 4096, 8
#: Sets, and shingles, for which a bucket gets one more block.
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(text), width))


def chosen(tokens: np.ndarray, nodes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a set that are chosen at each of several nodes: positions of nodes, and the child nodes they lead to."""
    limit = np.uint64(min(2**64 - 1, int(min(1.0, 1.0 / (similarity * len(tokens))) * 2.0**64)))
    where, child = [], []
    step = max(1, 2_000_000 // len(tokens))
    for begin in range(0, len(nodes), step):
        some = nodes[begin : begin + step, None]
        h = mix64((tokens[None, :] ^ some) * GOLDEN)
        row, column = np.nonzero(h <= limit)
        where.append(row + begin)
        child.append(mix64(h[row, column] ^ some[row, 0]))
    return np.concatenate(where), np.concatenate(child)


def paths(tokens: np.ndarray, runs: int, similarity: float) -> list[tuple[int, list[int]]]:
    """(node, children) for each distinct node of the first level, over all runs, as signed numbers."""
    first = np.unique(chosen(tokens, np.arange(1, runs + 1, dtype=np.uint64) * GOLDEN, similarity)[1])
    if not len(first):
        return []
    where, child = chosen(tokens, first, similarity)
    kids: list[list[int]] = [[] for _ in first]
    for k, c in zip(where.tolist(), child.view(np.int64).tolist(), strict=True):
        kids[k].append(c)
    return list(zip(first.view(np.int64).tolist(), kids, strict=True))


def set_table(docs: DataFrame, width: int, runs: int, similarity: float) -> DataFrame:
    """doc_id, key (of the shingle set), n (its size), paths, of every row with an id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("kids", pa.list_(pa.int64()))]))
        for batch in slices(batches):
            ids, keys, sizes, found = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, width)
                if len(s):
                    ids.append(i)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sizes.append(len(s))
                    found.append([{"a": a, "kids": kids} for a, kids in paths(s, runs, similarity)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, kind)], names=["c0", "c1", "c2", "c3"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").filter("doc_id is not null")
    return rows.mapInArrow(run, f"c0 {kind}, c1 binary, c2 bigint, c3 array<struct<a:bigint,kids:array<bigint>>>").toDF("doc_id", "key", "n", "paths")


def _sized(rows: DataFrame, *by: str) -> DataFrame:
    """Buckets of two sets or more: their number of sets, and a digest of which they are."""
    return rows.groupBy(*by, "bucket").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("key")).alias("who")).filter("m > 1")


def split(big: DataFrame, children: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole, parts): (bucket, key, m, who) of the buckets that are compared as they are, and of the others' children.

    ``children`` (parent, bucket, key) are those of the buckets ``big``, with their ``sizes``.
    Where most of the children's rows stand in children that hold half of the
    bucket or more, its sets are near copies: splitting it is useless.
    """
    of = big.groupBy("bucket").agg(F.first("m").alias("above")).withColumnRenamed("bucket", "parent")
    every = children.groupBy("parent").agg(F.count("*").alias("rows"))
    kept = sizes.join(of, "parent").groupBy("parent").agg(F.sum(F.when(F.col("m") * 2 >= F.col("above"), F.col("m")).otherwise(0)).alias("stay"))
    dense = materialise(kept.join(every, "parent").filter("stay * 2 >= rows").select("parent"), "dense-buckets")
    parts = materialise(sizes.join(dense, "parent", "left_anti").select("bucket", "m", "who"), "child-buckets")
    whole = few_join(big, dense.select(F.col("parent").alias("bucket")), "bucket", F.col("key"), "left_semi").select("bucket", "key", "m", "who")
    return whole, few_join(children.select("bucket", "key"), parts, "bucket", F.col("key")).select("bucket", "key", "m", "who")


def chosen_again(big: DataFrame, sets: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """parent, bucket, key: the children of deeper buckets, whose sets are made from their texts again.

    Twice as many tokens are chosen as on the first levels, so that the chance
    of a pair to part does not grow with the depth.
    """
    own = big.groupBy("key").agg(F.collect_list("bucket").alias("nodes"))
    own = materialise(sets.select("key", "one").join(own, "key"), "deep-sets")
    # A bucket's number is 8 bytes, a set's key 16: with few of them the texts stay where they are.
    few = own.agg(F.coalesce(F.sum(F.size("nodes")), F.lit(0))).first()[0] <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").alias("one"), "text").join(F.broadcast(own) if few else own, "one").select("key", "text", "nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple[int, int, bytes]] = []
            for key, text, nodes in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                s = shingle_set(text, width)
                if xxhash.xxh3_128_digest(s.tobytes()) == key:  # else another text of a repeated id
                    at, child = chosen(s, np.array(nodes, np.int64).view(np.uint64), similarity / 2)
                    rows += [(nodes[k], c, key) for k, c in zip(at.tolist(), child.view(np.int64).tolist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["parent", "bucket", "key"])

    return texts.mapInArrow(run, "parent long, bucket long, key binary").distinct()


def buckets(sets: DataFrame, docs: DataFrame, limit: int, width: int, similarity: float, deep: int) -> DataFrame:
    """bucket, key, m (number of sets), of every bucket with two sets or more that is to be compared.

    Only the sets of large buckets are looked at again, with their children;
    what is passed on between the steps is written, so that nothing is done twice.
    """
    one = sets.select("key", F.explode(F.transform("paths", lambda p: p["a"])).alias("bucket"))
    sized = materialise(_sized(one), "bucket-sizes")
    large = sized.filter(F.col("m") > limit)
    # Large buckets apart, so that none is one task's.
    rows = few_join(one, large.select("bucket"), "bucket", F.col("key"), "left_anti").join(sized, "bucket")
    rows = materialise(rows.unionByName(few_join(one, large, "bucket", F.col("key"))), "buckets")
    done, big = [rows.filter(F.col("m") <= limit)], rows.filter(F.col("m") > limit)
    for depth in range(1 + DEPTH):
        if big.isEmpty():
            break
        if depth == 0:
            kids = F.filter("paths", lambda p: p["a"] == F.col("parent"))[0]["kids"]
            children = big.select(F.col("bucket").alias("parent"), "key").join(sets.select("key", "paths"), "key")
            children = children.select("parent", F.explode(kids).alias("bucket"), "key")
        else:
            children = chosen_again(big, sets, docs, width, similarity)
        children = materialise(children, "children")
        whole, parts = split(big, children, materialise(_sized(children, "parent"), "children-sizes"))
        parts = materialise(parts, "buckets")
        done += [whole, parts.filter(F.col("m") <= deep)]
        big = parts.filter(F.col("m") > deep)
    rows = materialise(reduce(DataFrame.unionByName, [x.select("bucket", "key", "m", "who") for x in [*done, big]]), "buckets")
    # Buckets of the same sets are compared once.
    small, large = rows.filter(F.col("m") <= limit), rows.filter(F.col("m") > limit)
    once = lambda df: df.groupBy("m", "who").agg(F.min("bucket").alias("bucket")).select("bucket")
    kept = small.join(once(small), "bucket", "left_semi").unionByName(few_join(large, once(large), "bucket", F.col("key"), "left_semi"))
    return kept.select("bucket", "key", "m")


def merged_buckets(rows: DataFrame, limit: int) -> DataFrame:
    """Large buckets that mostly hold the sets of a larger one are taken into it.

    The runs find a group of near copies again and again; this keeps it from
    being compared as often.  A set's home is the largest of its large buckets.
    """
    large = rows.filter(F.col("m") > limit)
    if large.isEmpty():
        return rows.select("bucket", "key")
    home = large.groupBy("key").agg(F.max(F.struct("m", "bucket")).alias("h")).select("key", F.col("h.bucket").alias("home"))
    votes = large.join(home, "key").groupBy("bucket", "m", "home").agg(F.count("*").alias("v"))
    best = materialise(votes.groupBy("bucket", "m").agg(F.max(F.struct("v", "home")).alias("b")).select("bucket", "m", F.col("b.home").alias("home"), F.col("b.v").alias("v")), "bucket-homes")
    roots = best.filter("home = bucket").select(F.col("bucket").alias("home"))
    moved = best.filter("home <> bucket and v * 2 >= m").join(roots, "home", "left_semi").select("bucket", "home")
    return few_join(rows, moved, "bucket", F.col("key"), "left").select(F.coalesce("home", "bucket").alias("bucket"), "key").dropDuplicates(["bucket", "key"])


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n items' component, given links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    return label


def similar_pairs(sets: list[np.ndarray], similarity: float, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs with Jaccard similarity of at least ``similarity``; of pairs across ``split`` only, if given."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate(sets)
    _, which, count = np.unique(every, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1  # shingles of one set only can't be shared
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = count[which] > 1
    owner, column = owner[keep], number[which[keep]]
    rows = len(sets) if split is None else split
    shared = np.zeros((rows, len(sets) - (split or 0)), np.float32)
    total = int(number[-1]) + 1 if len(number) else 0
    step = max(256, 8_000_000 // max(1, len(sets)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for begin in range(0, total, step):
        lo, hi = np.searchsorted(column, [begin, begin + step])
        part = np.zeros((len(sets), min(step, total - begin)), np.float32)
        part[owner[lo:hi], column[lo:hi] - begin] = 1.0
        shared += part[:rows] @ part[(split or 0) :].T
    left, right = sizes[:rows, None], sizes[None, (split or 0) :]
    close = shared >= similarity * (left + right - shared) - 1e-6 * shared
    a, b = np.nonzero(close)
    b = b + (split or 0)
    inside = a < b
    a, b = a[inside], b[inside]
    both = shared[a, b - (split or 0)].astype(np.int64)
    exact = both >= similarity * (sizes[a] + sizes[b] - both) - 1e-9
    return a[exact], b[exact]


def compare(sets: DataFrame, homes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """key, links, root: partial counts of linked documents and edges to a representative, from all buckets."""
    sized = homes.join(sets.select("key", "n"), "key").groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    several = materialise(sized.select("bucket", F.when(F.col("m") > 2, blocks).otherwise(1).alias("blocks")).filter("blocks > 1"), "bucket-blocks")
    single = few_join(homes, several.select("bucket"), "bucket", F.col("key"), "left_anti").withColumn("blocks", F.lit(1))
    dealt = single.unionByName(few_join(homes, several, "bucket", F.col("key")))
    mine = dealt.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("bucket", "blocks"))).alias("homes"))
    tasks = sets.join(mine, "key").select("key", "n", "copies", "one", "homes")
    texts = docs.select(F.col("doc_id").alias("one"), "text").join(tasks, "one")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "i", "j", "block", "key", "copies", "homes", "members"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in slices(batches):
            rows, waiting = [], 0
            cols = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("text", "key", "copies", "homes")]
            for text, key, copies, own in zip(*cols, strict=True):
                s = shingle_set(text, width)
                if xxhash.xxh3_128_digest(s.tobytes()) != key:
                    continue  # another text of a repeated id
                data = s.tobytes()
                all_homes = [h["bucket"] for h in own]
                for h in own:
                    m = h["blocks"]
                    block = xxhash.xxh3_64_intdigest(key, seed=1) % m
                    for other in range(m):
                        rows.append((h["bucket"], min(block, other), max(block, other), block, key, copies, all_homes, data))
                        waiting += len(data)
                    if waiting > 16_000_000:
                        yield out(rows)
                        rows, waiting = [], 0
            yield out(rows)

    schema = "bucket long, i int, j int, block int, key binary, copies long, homes array<long>, members binary"
    dealt = texts.mapInArrow(deal, schema)
    parts = max(shuffle_partitions(docs.sparkSession), 12)
    grouped = dealt.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "block", "key")

    def task(group: list[tuple]) -> list[tuple[bytes, int, bytes]]:
        """Links and edges within one pair of blocks."""
        bucket, i, j = group[0][:3]
        unique = {}
        for r in group:
            unique.setdefault(r[4], r)
        group = list(unique.values())
        split = sum(r[3] == i for r in group) if i != j else None
        if len(group) < 2 or split in (0, len(group)):
            return []
        a, b = similar_pairs([np.frombuffer(r[7], np.uint64) for r in group], similarity, split)
        if not len(a):
            return []
        homes = [r[6] for r in group]
        if any(len(h) > 1 for h in homes):
            # A pair counts in the first bucket that both are in.
            first = np.ones(len(a), bool)
            sets = [set(h) for h in homes]
            earlier = [[x for x in h if x < bucket] for h in homes]
            for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                if earlier[x] and not sets[y].isdisjoint(earlier[x]):
                    first[k] = False
            counted = first
        else:
            counted = np.ones(len(a), bool)
        copies = np.array([r[5] for r in group], np.int64)
        links = np.zeros(len(group), np.int64)
        np.add.at(links, a[counted], copies[b[counted]])
        np.add.at(links, b[counted], copies[a[counted]])
        label = _components(len(group), a, b)
        return [(group[k][4], int(links[k]), group[label[k]][4]) for k in np.unique(np.concatenate([a, b])).tolist()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["key", "links", "root"])

        for batch in batches:
            done: list[tuple] = []
            cols = [batch.column(k).to_pylist() for k in range(8)]
            for row in zip(*cols, strict=True):
                if group and row[:3] != group[0][:3]:
                    done += task(group)
                    group = []
                group.append(row)
            yield out(done)
        yield out(task(group) if group else [])

    return grouped.mapInArrow(find, "key binary, links long, root binary")


def connected(edges: DataFrame) -> DataFrame:
    """key, root: the smallest key of each key's component, from edges (a, b) in both directions.

    Labels spread along edges and jump to their label's label in each round,
    until none changes; every round is written to the shared folder.
    """
    labels = materialise(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["key"]).groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near, labels["key"] == near["a"], "left").select("key", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = step.select(F.col("key").alias("k_"), F.col("root").alias("r_"))
        step = step.join(jump, step["root"] == jump["k_"], "left").select("key", "old", F.least("root", F.coalesce("r_", "root")).alias("root"))
        step = materialise(step, "labels")
        labels = step.select("key", "root")
        if step.filter("old <> root").isEmpty():
            return labels


def jaccard_join(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, runs: int = RUNS, limit: int = LIMIT, deep: int = DEEP) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    ship_package(docs.sparkSession)
    each = materialise(set_table(docs, width, runs, similarity), "sets")
    sets = materialise(each.groupBy("key").agg(F.first("n").alias("n"), F.first("paths").alias("paths"), F.min("doc_id").alias("one"), F.count_distinct("doc_id").alias("copies")), "distinct-sets")
    homes = materialise(merged_buckets(materialise(buckets(sets, docs, limit, width, similarity, deep), "buckets"), limit), "homes")
    found = materialise(compare(sets, homes, docs, width, similarity), "links")
    edges = found.filter("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b"))
    edges = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = connected(edges)
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    whole = sets.select("key", "one", "copies").join(labels, "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = whole.groupBy("root").agg(F.min("one").alias("class_id"))
    whole = whole.join(names, "root").select("key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    members = each.select("doc_id", "key").distinct().join(whole, "key").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))
    lone = docs.select("doc_id").distinct().join(members.select("doc_id"), "doc_id", "left_anti")
    return members.unionByName(lone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
