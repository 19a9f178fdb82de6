"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Every window of a text as long as a benchmark item (beyond ``EXACT`` shingles,
to within a sixteenth of its length) gets a 64-bit SimHash of its five-word shingles; the sums of all
windows of a length come from running sums, eight bits of the hash in eight
lanes of one word.  Each item has the fingerprints of its first and of its
last window.  Five blocks of a fingerprint (12 or 13 bits) index the items: of
two fingerprints within ``RADIUS`` = 18 bits some block differs in 3 bits at
most, so looking up every value within 3 bits of an item's block finds all of
them.  Only windows near a shingle of the items are looked up: without one in
common the similarity is 0.
What is within the radius is verified: the weighted Jaccard similarity of the
item's shingles and those of the aligned window must reach ``similarity``.  A
shingle weighs the logarithm of how rare it is among the items.

The items are the small side: they go to the tasks in blocks, dealt by a hash,
of ``ITEMS_AT_ONCE`` items or ``CHARS_AT_ONCE`` characters on average, one pass
over the texts for each block.  Each block gets the
weights of all shingles that several items of the benchmark have, so that no
result depends on the blocks.  Nothing of the documents is collected or shuffled.

Defined results: null and empty texts hold nothing; items without words are
never found; items of fewer than five words have one shingle.  Rows with null
or repeated ids are searched like others.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shingle_hashes, ship_package, slices, word_hashes

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 18
#: Items, and characters of items, that go to the tasks at once on average.
ITEMS_AT_ONCE, CHARS_AT_ONCE = 5000, 10_000_000
#: Shingles up to which an item's windows are just as long as it, and the steps of longer ones: within a sixteenth of its length.
EXACT, STEP = 64, 16
#: The most that a lane of eight bits counts without carrying.
_LANE = 127
_CHUNK = 32_768
_TOP = np.uint64(0x8080808080808080)
_ONES = np.uint64(0x0101010101010101)
_GATHER = np.uint64(0x0102040810204080)
#: Byte -> its bits in the lowest bits of eight lanes.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def running_sums(shingles: np.ndarray) -> np.ndarray:
    """(8, n + 1): for each byte of the hash the sums of its bits over the first shingles, in lanes (modulo 2**64)."""
    out = np.zeros((8, len(shingles) + 1), np.uint64)
    raw = np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        np.cumsum(_SPREAD[raw[:, k]], out=out[k, 1:])
    return out


def window_fingerprints(sums: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of every window of ``size`` shingles: a bit is set where more than half have it."""
    n = sums.shape[1] - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size > _LANE:
        return _long_fingerprints(sums, size, n)
    out = np.empty((n, 8), np.uint8)
    lift = _ONES * np.uint64(127 - size // 2)
    t = np.empty(n, np.uint64)
    for k in range(8):
        # A lane's count in the window is the difference of the sums: it can't carry, being below 128.
        np.subtract(sums[k, size:], sums[k, :-size], out=t)
        np.add(t, lift, out=t)
        np.bitwise_and(t, _TOP, out=t)
        np.right_shift(t, np.uint64(7), out=t)
        np.multiply(t, _GATHER, out=t)
        np.right_shift(t, np.uint64(56), out=t)
        out[:, k] = t
    return out.view(np.uint64).reshape(n)


def _long_fingerprints(sums: np.ndarray, size: int, n: int) -> np.ndarray:
    """The same where a lane can't hold the counts: they are added up, in wide integers, from parts that it can hold."""
    out = np.empty((n, 8), np.uint8)
    for k in range(8):
        counts = np.zeros((n, 8), np.int32)
        for at in range(0, size, _LANE):
            end = min(size, at + _LANE)
            counts += (sums[k, end : end + n] - sums[k, at : at + n]).view(np.uint8).reshape(n, 8)
        out[:, k] = np.packbits(counts > size // 2, axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64).reshape(n)


def class_of(n: int) -> int:
    """The length of the windows for an item of ``n`` shingles: ``n``, or the step below it."""
    size = min(n, EXACT)
    while size + size // STEP <= n and n > EXACT:
        size += size // STEP
    return size


#: First bit and width of the blocks of a fingerprint, and the bits in which one of them differs at most within ``RADIUS``.
_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_NEAR = RADIUS // len(_BLOCKS)


def _flips(width: int) -> np.ndarray:
    """What to flip in a block to reach every value within ``_NEAR`` bits."""
    return np.array([sum(1 << b for b in c) for n in range(_NEAR + 1) for c in combinations(range(width), n)], np.int64)


class HammingIndex:
    """All fingerprints within ``RADIUS`` bits of a query, by exact lookups of blocks."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = []
        for first, width in _BLOCKS:
            flips = _flips(width)
            values = (self._block(prints, first, width)[:, None] ^ flips[None, :]).ravel()
            owner = np.repeat(np.arange(len(prints), dtype=np.int32), len(flips))
            order = np.argsort(values, kind="stable")
            starts = np.zeros((1 << width) + 1, np.int32)
            np.cumsum(np.bincount(values, minlength=1 << width), out=starts[1:])
            self.tables.append((np.diff(starts) > 0, starts, owner[order]))

    @staticmethod
    def _block(prints: np.ndarray, first: int, width: int) -> np.ndarray:
        return (prints >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of queries, of prints, and distances of all pairs within the radius (some twice)."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, (some, starts, owner) in enumerate(self.tables):
            block = self._block(queries, *_BLOCKS[k])
            at = np.flatnonzero(some[block])
            value = block[at]
            first, many = starts[value], starts[value + 1] - starts[value]
            which = np.repeat(at, many)
            offset = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            item = owner[np.repeat(first, many) + offset]
            distance = np.bitwise_count(queries[which] ^ self.prints[item])
            near = distance <= RADIUS
            found.append((which[near], item[near], distance[near]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Benchmark:
    """A block of items, ready to be searched for.

    ``frequency``: the number of items of the whole benchmark and the shingles
    that more than one of them has, with their numbers of items; of the block
    itself if not given.
    """

    def __init__(self, items: list[tuple[object, str | None]], width: int = WIDTH, similarity: float = SIMILARITY, frequency: tuple[int, dict[int, int]] | None = None):
        self.width, self.similarity = width, similarity
        self.ids, self.shingles = [], []
        for i, text in items:
            s = shingle_hashes(word_hashes(text), width)
            if len(s):
                self.ids.append(i)
                self.shingles.append(s)
        every = [np.unique(s) for s in self.shingles]
        keys, df = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.uint64), np.zeros(0))
        count, shared = frequency or (len(every), dict(zip(keys[df > 1].tolist(), df[df > 1].tolist(), strict=True)))
        # What one item has, and what none has, weighs the most.
        self.rare = float(np.log1p(max(1, count)))
        self.weights = {k: float(np.log1p(count / n)) for k, n in shared.items()}
        self.keys, self.longest = keys, max(map(len, self.shingles), default=0)
        classes: dict[int, list[tuple[int, int, int]]] = {}
        for k, s in enumerate(self.shingles):
            size = class_of(len(s))
            sums = running_sums(s)
            prints = window_fingerprints(sums, size)
            # (item, where it begins before the window, fingerprint)
            classes.setdefault(size, []).append((k, 0, int(prints[0])))
            if len(s) > size:
                classes[size].append((k, len(s) - size, int(prints[-1])))
        self.classes = {size: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), HammingIndex(np.array([x[2] for x in v], np.uint64))) for size, v in sorted(classes.items())}

    def weighted_similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item's shingles and a window's, counted with repeats."""
        both = np.concatenate([self.shingles[item], window])
        keys, which = np.unique(both, return_inverse=True)
        n = len(self.shingles[item])
        a, b = np.bincount(which[:n], minlength=len(keys)), np.bincount(which[n:], minlength=len(keys))
        w = np.array([self.weights.get(x, self.rare) for x in keys.tolist()])
        return float((np.minimum(a, b) * w).sum() / (np.maximum(a, b) * w).sum())

    def search(self, texts: list[str | None]) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, Hamming distance, first shingle) of the best window of each item found in each text."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        group: list[tuple[int, np.ndarray]] = []
        size = 0
        for k, text in enumerate(texts):
            s = shingle_hashes(word_hashes(text), self.width)
            if len(s):
                group.append((k, s))
                size += len(s)
            if size >= _CHUNK:
                self._search_group(group, best)
                group, size = [], 0
        if group:
            self._search_group(group, best)
        return [(t, i, s, -d, at) for (t, i), (s, d, at) in sorted(best.items())]

    def _places(self, every: np.ndarray) -> np.ndarray:
        """Where a window may begin that is similar to an item: so near a shingle of the items that it can hold one."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        found = self.keys[np.minimum(np.searchsorted(self.keys, every), len(self.keys) - 1)] == every
        sums = np.concatenate([[0], np.cumsum(found)])
        at = np.arange(len(every))
        return np.flatnonzero(sums[np.minimum(at + self.longest, len(every))] > sums[np.maximum(at - self.longest, 0)])

    def _search_group(self, group: list[tuple[int, np.ndarray]], best: dict) -> None:
        every = np.concatenate([s for _, s in group])
        ends = np.cumsum([len(s) for _, s in group])
        places = self._places(every)
        for begin in range(0, len(places), 2 * _CHUNK):  # very long texts in parts that overlap by the longest window
            where = places[begin : begin + 2 * _CHUNK + max(self.classes)]
            part = every[where]
            sums = running_sums(part)
            tried: set[tuple[int, int, int]] = set()
            for size, (items, before, index) in self.classes.items():
                if len(part) < size:
                    continue
                prints = window_fingerprints(sums, size)
                # Windows that run across a gap between places are none.
                whole = np.flatnonzero(where[size - 1 :] - where[: len(prints)] == size - 1)
                for k, j, distance in zip(*map(np.ndarray.tolist, index.search(prints[whole])), strict=True):
                    at = int(where[whole[k]])
                    g = int(np.searchsorted(ends, at, side="right"))
                    low, high = (int(ends[g - 1]) if g else 0), int(ends[g])
                    if at + size > high:
                        continue  # the window runs into the next text
                    item = int(items[j])
                    start = at - int(before[j])
                    if (g, item, start) in tried:
                        continue
                    tried.add((g, item, start))
                    window = every[max(low, start) : min(high, start + len(self.shingles[item]))]
                    similarity = self.weighted_similarity(item, window)
                    if similarity >= self.similarity:
                        key = group[g][0], item
                        got = (similarity, -distance, max(low, start) - low)
                        if key not in best or got[:2] > best[key][:2]:
                            best[key] = got


def _frequency(texts: DataFrame) -> tuple[int, dict[int, int]]:
    """The number of items with words, and of the shingles that several items have in how many: over the whole benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                s = np.unique(shingle_hashes(word_hashes(text), WIDTH))
                if len(s):
                    # A null for the item itself.
                    yield pa.RecordBatch.from_arrays([pa.array([None, *s.view(np.int64).tolist()], pa.int64())], names=["shingle"])

    got = texts.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1 or shingle is null").toArrow()
    found = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    count = found.pop(None, 0)
    return count, {k % 2**64: n for k, n in found.items()}


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Benchmark]:
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).distinct()
    head = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    count = max(-(-head["n"] // ITEMS_AT_ONCE), -(-head["chars"] // CHARS_AT_ONCE))
    frequency = _frequency(rows.select("t")) if count > 1 else None
    for k in range(count):
        some = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k) if count > 1 else rows
        yield Benchmark([(r["i"], r["t"]) for r in some.collect()], frequency=frequency)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, similarity, distance, start (word where it begins): each item found in each document, at its best window."""
    spark = docs.sparkSession
    ship_package(spark)
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"c0 {kinds[0]}, c1 {kinds[1]}, c2 double, c3 int, c4 bigint"
    names = [id_col, item_col, "similarity", "distance", "start"]
    out = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, item_col, "text"):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in slices(batches):
                ids = batch.column(0)
                hits = b.search(batch.column(1).to_pylist())
                where = pa.array([h[0] for h in hits], pa.int64())
                arrays = [ids.take(where), pa.array([b.ids[h[1]] for h in hits], None if hits else pa.int64()), pa.array([h[2] for h in hits], pa.float64()), pa.array([h[3] for h in hits], pa.int32()), pa.array([h[4] for h in hits], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["c0", "c1", "c2", "c3", "c4"])

        out = out.unionByName(docs.select(id_col, "text").mapInArrow(run, schema))
    return out.toDF(*names)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    spark = docs.sparkSession
    ship_package(spark)
    at = docs.columns.index("text")
    for items in _blocks(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[h[0] for h in shared.value.search(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
