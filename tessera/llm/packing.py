"""Best-fit packing of tokenised documents into sequences, under several capacities.

Documents become token ids plus an end id; only those longer than a sequence
are cut, at its length.  Pieces are dealt at random (by a hash that also
holds the row's position, so that no key can crowd a shard) to shards of
bounded size, and each shard runs vector best-fit decreasing: a bin is a
vector of residual tokens, residual document slots and residual attention
cost (sum of squared lengths); among the open bins that still hold the piece
under every constraint, the one with the best score wins.

``rule="dot"`` scores a bin by the weighted dot product of the piece and the
bin's residual (both as shares of the capacity), least first: what is left
along the piece's own direction is used up.  ``rule="norm"`` takes the bin
with the least weighted residual norm after placing.  With tokens as the only
scarce capacity both are the classic best fit.

Defined results: null and empty texts are one piece of just the end id; rows
with null or repeated ids are packed as rows of their own.  Full pieces fill
a sequence alone.  No row is dropped.  Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CACHE_ENTRIES, ship_package, slices, worker_cache
from tessera.llm.token_counts import byte_letters

#: Rows of the packed table for which one shard is made.
SHARD_ROWS = 16_384


#: Fixed value: the published split pattern of the word-end vocabulary.
_WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


class ChunkIds(dict):
    """White-space separated chunk -> its ids as little-endian unsigned 32-bit bytes.

    For vocabularies that fold case, drop white space and never look across
    it; the library's model merges each piece.  When full it becomes the old
    one, from which what is asked for again comes back.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.model = tokenizer.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.old: dict[str, bytes] = {}

    def _piece(self, piece: str) -> list[int]:
        spelt = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return [t.id for t in self.model.tokenize(spelt)]

    def __missing__(self, chunk: str) -> bytes:
        value = self.old.get(chunk)
        if value is None:
            value = self._encoded(chunk)
        if len(chunk) <= 64:
            if len(self) >= 4 * CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[chunk] = value
        return value

    def _encoded(self, chunk: str) -> bytes:
        # Lower case letter by letter: the library knows no final sigma.
        low = chunk.replace("\u03a3", "\u03c3").lower()
        pieces = [low] if low.isalpha() else _WORD_PIECES.findall(low)
        ids = self._piece(pieces[0]) if len(pieces) == 1 else [x for p in pieces for x in self._piece(p)]
        return struct.pack(f"<{len(ids)}I", *ids)


def _tokenizer(path: str) -> tuple:
    def make() -> tuple:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        return tok, ChunkIds(tok), special

    return worker_cache(f"tokenizer-{path}", make)


#: White space to Python that the tokeniser's engine takes for other characters.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def encode_bytes(text: str | None, path: str) -> bytes:
    """The ids of a whole text as little-endian unsigned 32-bit bytes."""
    if not text:
        return b""
    tok, known, special = _tokenizer(path)
    if _ODD_SPACE.search(text) or any(s in text for s in special):
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return b"".join(map(known.__getitem__, text.split()))


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, row_key, piece, start, length, ids (binary, little-endian unsigned 32-bit) of every piece of every document."""
    ship_package(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * max_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at: list[int] = []
            piece: list[int] = []
            ids: list[bytes] = []
            waiting = 0
            for k, text in enumerate(batch.column(2).to_pylist()):
                data = encode_bytes(text, tokenizer_path) + end
                for p, begin in enumerate(range(0, len(data), width)):
                    at.append(k)
                    piece.append(p)
                    ids.append(data[begin : begin + width])
                waiting += len(data)
                if waiting > 32_000_000:
                    yield out(batch, at, piece, ids)
                    at, piece, ids, waiting = [], [], [], 0
            yield out(batch, at, piece, ids)

    def out(batch: pa.RecordBatch, at: list[int], piece: list[int], ids: list[bytes]) -> pa.RecordBatch:
        where = pa.array(at, pa.int64())
        number = np.array(piece, np.int64)
        arrays = [batch.column(0).take(where), batch.column(1).take(where), pa.array(number), pa.array(number * max_tokens), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["c0", "c1", "c2", "c3", "c4", "c5"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("c0"), F.monotonically_increasing_id().alias("c1"), F.col(text_col).alias("c2"))
    return rows.mapInArrow(run, f"c0 {kind}, c1 bigint, c2 bigint, c3 bigint, c4 bigint, c5 binary").toDF(id_col, "row_key", "piece", "start", "length", "ids")


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "dot") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: vector best-fit decreasing over residual (tokens, documents, attention cost).

    A piece that by itself breaks a capacity of documents or attention cost can't be placed within it: ValueError.
    """
    n = len(lengths)
    cap = np.array(capacity, np.float64)
    demand = np.stack([lengths, np.ones(n), np.square(lengths, dtype=np.float64)], axis=1).astype(np.float64)
    if n and (demand > cap).any():
        raise ValueError("a piece is larger than a sequence's capacity")
    share = demand / cap * np.array(weights)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    residual = np.zeros((64, 3))
    open_ids = np.zeros(64, np.int64)
    count = made = 0
    order = np.argsort(-lengths, kind="stable")
    least = demand.min(axis=0) if n else cap
    for i in order:
        need = demand[i]
        at = -1
        if count:
            left = residual[:count]
            fits = (left[:, 0] >= need[0]) & (left[:, 1] >= need[1]) & (left[:, 2] >= need[2])
            where = np.flatnonzero(fits)
            if len(where):
                if rule == "dot":
                    score = (left[where] / cap) @ share[i]
                else:
                    score = (np.square((left[where] - need) / cap) * np.array(weights)).sum(axis=1)
                at = int(where[np.argmin(score)])
        if at < 0:
            if count == len(residual):
                residual = np.concatenate([residual, np.zeros_like(residual)])
                open_ids = np.concatenate([open_ids, np.zeros_like(open_ids)])
            at, count = count, count + 1
            residual[at], open_ids[at] = cap, made
            made += 1
        bins[i], offsets[i] = open_ids[at], int(cap[0] - residual[at, 0])
        residual[at] -= need
        if (residual[at] < least).any():  # nothing fits any more: close it
            count -= 1
            residual[at], open_ids[at] = residual[count], open_ids[count]
    return bins, offsets


def best_fit_packing(
    pieces: DataFrame, n_rows: int, max_tokens: int = 4096, max_documents: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "dot", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``pieces`` (row_key, piece, length and what else they carry) with sequence_id and offset.

    ``n_rows``: about how many rows there are, for the number of shards; more
    make larger shards, never lost rows.  The default capacities of documents
    and attention cost are those that the token capacity implies.
    """
    capacity = (max_tokens, max_documents or max_tokens, max_attention or max_tokens**2)
    shards = max(1, -(-n_rows // shard_rows))

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard_").to_numpy()[0] if table.num_rows else 0
        # The same rows in any order of arrival give the same bins.
        table = table.sort_by([("row_key", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets = best_fit(lengths, capacity, weights, rule)
        table = table.append_column("sequence_id", pa.array(bins + (np.int64(shard) << 32)))
        return table.append_column("offset", pa.array(offsets)).drop_columns(["shard_"])

    ship_package(pieces.sparkSession)
    dealt = pieces.withColumn("shard_", F.pmod(F.xxhash64("row_key", "piece"), F.lit(shards)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("shard_").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 1, with_ids: bool = True, **options) -> DataFrame:
    """Tokenise and pack: doc_id, piece, start, length, sequence_id, offset, and ids (or only their crc32)."""
    pieces = tokenize_pieces(docs, tokenizer_path, max_tokens, end_id)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    if not with_ids:
        pieces = pieces.drop("ids")
    # The number of rows comes from the footers of the files, or from one count.
    packed = best_fit_packing(pieces, docs.count(), max_tokens, **options)
    return packed.drop("row_key")
