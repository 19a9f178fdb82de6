"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a worker-side word cache may hold before it is emptied (about 20 MB).
CACHE_ENTRIES = 120_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, once for each context.

    Nothing is shipped when the executors inherit the package's folder through
    PYTHONPATH or the working folder.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if root in [*known, os.path.abspath(os.getcwd())] or getattr(sc, "_tessera_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "tessera_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "tessera")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._tessera_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local run gets a folder of its own; on a cluster it
    is an error, since each machine would write to its own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_CACHE: dict[str, Any] = {}


def release() -> None:
    """Give free memory back to the system: workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows a thousand at a time, so that a task holds few of them as Python objects; memory goes back at the end."""
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)
    release()


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """What this worker process remembers between tasks, under one name at a time: another name empties it and gives the memory back."""
    if name not in _CACHE:
        _CACHE.clear()
        release()
        _CACHE[name] = make()
    return _CACHE[name]


#: Folders written by ``materialise`` in this process.
_WRITTEN: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(spark: SparkSession) -> int:
    """Delete what ``materialise`` has written; for when the results are written themselves."""
    jvm, gone = spark.sparkContext._jvm, 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


#: Rows of a joined side (of a few numbers each) that are broadcast, and parts a key is spread over beyond.
BROADCAST_ROWS, SALTS = 200_000, 32


def few_join(rows: DataFrame, few: DataFrame, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few`` (unique keys) where one key may hold a large part of ``rows``.

    Broadcast up to ``BROADCAST_ROWS`` rows of ``few``, by a count; else each
    key is dealt to ``SALTS`` parts by a hash of ``spread``.
    """
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), key, how)
    salted = few.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [key, "salt_"], how).drop("salt_")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as make it differ from those taken, whatever the case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as fold 0 (held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0).cast("long"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte of a lower-case text: is it part of a word, is it white space, and a random odd value."""
    word = np.zeros(256, bool)
    word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    space = np.zeros(256, bool)
    space[[*range(9, 14), *range(28, 33)]] = True
    return word, space, mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN) | np.uint64(1)


_WORD, _SPACE, _VALUE = _byte_tables()
_BASE = 0xD1342543DE82EF95
_UNBASE = pow(_BASE, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order.

    A word is what stands between white space, in lower case and without
    punctuation (of ASCII); chunks of punctuation alone are no words.  The
    hash is a polynomial in the word's bytes, so that running sums over the
    whole text give those of all its words at once.
    """
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    data = data[(_WORD | _SPACE)[data]]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of each run of ``width`` words, in order; shorter texts have one shingle of all their words, empty ones none."""
    n = len(words)
    if n == 0:
        return words
    size = min(width, n)
    acc = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        acc = (acc ^ words[k : n - size + 1 + k]) * GOLDEN
        acc ^= acc >> np.uint64(32)
    return mix64(acc)


def appended(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])
