"""Exact token counts at every prefix of a text, by prefix dynamic programming.

A byte-pair encoding is valid exactly when every two neighbouring tokens are a
*compatible* pair (encoding their concatenation gives the two tokens back).
So the encoding of the first ``i`` bytes of a piece ends in the one token
that is a suffix of those bytes and compatible with the last token of what is
before it, and its count is one more than the count there.  One pass over a
piece therefore holds the exact count at each of its prefixes; pieces (what
the pre-tokeniser cuts a text into) are counted once and remembered.

Defined results: a null text counts as empty (0 bytes, 0 tokens).  Repeated
rows each get their row.  Only ``id_col`` and ``text_col`` are read, so extra
columns of any name do no harm.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CACHE_ENTRIES, ship_package, slices, worker_cache

#: Fixed value: the published pre-tokeniser pattern of byte-level BPE vocabularies of this family.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pieces whose beginnings are not one piece, and white space that a cut can join to one.
_PARTED = ("'re", "'ve", "'ll")
_SPACES = regex.compile(r"\p{White_Space}{2,}")
#: A white-space character before a space, or a space at the end: segments then can't be counted apart.
_JOINED = re.compile(r"[\s\x1c-\x1f] |\s\Z")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in set(plain)):
        letters[chr(256 + k)] = b
    return letters


class _Segments(dict):
    """Segment of a text -> its tokens. When full it becomes the old one, from which what is asked for again comes back."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter
        self.old: dict[str, int] = {}

    def __missing__(self, segment: str) -> int:
        got = self.old.get(segment)
        if got is None:
            got = self.counter._count_pieces(segment)
        if len(segment) <= 64:
            if len(self) >= 8 * CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[segment] = got
        return got


class PrefixCounter:
    """Counts tokens of a byte-level BPE vocabulary file at every prefix of a text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_marks = special
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks[raw(a), raw(b)] = k
        known = {raw(s) for s in model["vocab"] if s not in special}
        #: Tokens that the merges reach from single bytes, with the spines their outer merges leave.
        self.tokens: set[bytes] = {t for t in known if len(t) == 1}
        none = float("inf")
        self.left: dict[bytes, list[tuple[bytes, float]]] = {t: [(t, none)] for t in self.tokens}
        self.right: dict[bytes, list[tuple[bytes, float]]] = {t: [(t, none)] for t in self.tokens}
        for (a, b), rank in self.ranks.items():
            t = a + b
            if t in known and t not in self.tokens and a in self.tokens and b in self.tokens and not self._crossed(a, b, rank):
                self.tokens.add(t)
                self.left[t] = [(t, none), (a, rank), *self.left[a][1:]]
                self.right[t] = [(t, none), (b, rank), *self.right[b][1:]]
        #: A trie: byte -> (the number of the token that ends here or 0, what follows).
        self.trie: dict[int, tuple] = {}
        self.names: list[bytes] = [b""]
        grown: dict[int, list] = {}
        for t in sorted(self.tokens):
            node = grown
            for byte in t[:-1]:
                node = node.setdefault(byte, [0, {}])[1]
            node.setdefault(t[-1], [0, {}])[0] = len(self.names)
            self.names.append(t)
        none_follow: dict[int, tuple] = {}
        freeze = lambda node: {k: (v[0], freeze(v[1])) for k, v in node.items()} if node else none_follow
        self.trie = freeze(grown)
        self.longest = max(map(len, self.names))
        self.pairs: dict[int, bool] = {}
        self.segments = _Segments(self)

    def _crossed(self, a: bytes, b: bytes, own: int = -1) -> bool:
        """Whether some merge joins the end of ``a`` with the start of ``b`` before either is complete.

        A part on the right edge of ``a`` is there until the merge that takes it in,
        and so is one on the left edge of ``b``; of equal merges the left one is first.
        """
        ranks = self.ranks
        for x, until_x in self.right[a]:
            for y, until_y in self.left[b]:
                rank = ranks.get((x, y))
                if rank is not None and rank != own and rank < until_x and rank <= until_y:
                    return True
        return False

    def _compatible(self, key: int) -> bool:
        """``key``: the left token's number times 2**20, plus the right one's."""
        if len(self.pairs) >= CACHE_ENTRIES:
            self.pairs.clear()
        got = self.pairs[key] = not self._crossed(self.names[key >> 20], self.names[key & 0xFFFFF])
        return got

    def piece_table(self, piece: str) -> list[int]:
        """Token counts of the first 0, 1, ... bytes of one piece."""
        data = piece.encode()
        n, trie, pairs = len(data), self.trie, self.pairs
        counts = [0] * (n + 1)
        last = [0] * (n + 1)
        for j in range(n):
            here, i, follow = last[j] << 20, j, trie
            for byte in data[j : j + self.longest]:
                step = follow.get(byte)
                if step is None:
                    break
                token, follow = step
                i += 1
                if token and not counts[i]:
                    if j:
                        ok = pairs.get(here | token)
                        if ok is None:
                            ok = self._compatible(here | token)
                        if not ok:
                            continue
                    counts[i], last[i] = counts[j] + 1, token
        return counts

    def _count_pieces(self, text: str) -> int:
        return sum([self.piece_table(p)[-1] for p in PIECES.findall(text)])

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Text between special strings, and the special strings (True)."""
        if self.special is None or not any(m in text for m in self.special_marks):
            if text:
                yield text, False
            return
        at = 0
        for m in self.special.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def _each(self, part: str) -> tuple[list[str], list[int]]:
        """Segments that share no piece, and the tokens of each."""
        if _JOINED.search(part):
            segments = PIECES.findall(part)
            return segments, [self.piece_table(p)[-1] for p in segments]
        first, *rest = part.split(" ")
        segments = [first, *map(" ".__add__, rest)]
        return segments, list(map(self.segments.__getitem__, segments))

    def count(self, text: str | None) -> int:
        return sum(1 if special else sum(self._each(part)[1]) for part, special in self.parts(text or ""))

    def prefixes(self, text: str) -> np.ndarray:
        """``out[i]``: tokens of the first i letters of a text without special strings, from one table for each piece.

        A piece's beginning is a piece, but for ``_PARTED``; and white space at
        the end of a cut is one piece, as long as it is.
        """
        out = np.zeros(len(text) + 1, np.int64)

        def put(at: int, piece: str, before: int) -> None:
            table = np.array(self.piece_table(piece), np.int64)
            if not piece.isascii():
                table = table[np.cumsum([0, *[len(c.encode()) for c in piece]])]
            out[at + 1 : at + len(piece) + 1] = before + table[1:]

        at = 0
        for piece in PIECES.findall(text):
            put(at, piece, total := int(out[at]))
            if piece in _PARTED:
                out[at + 2] = total + self._count_pieces(piece[:2])
            at += len(piece)
        for run in _SPACES.finditer(text):
            put(run.start(), run[0], int(out[run.start()]))
        return out

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """``out[i]``: tokens of ``text[:i]`` when encoded by itself, for every i from 0 to len(text)."""
        text = text or ""
        out = np.zeros(len(text) + 1, np.int64)
        at = begin = total = 0  # begin: of the ordinary text before a special string
        for part, special in self.parts(text):
            if not special:
                begin = at
                out[at : at + len(part) + 1] = total + self.prefixes(part)
                total += sum(self._each(part)[1])
                at += len(part)
                continue
            # Cut inside a special string: it is ordinary text until complete.
            tail = max(begin, at - sum(map(len, PIECES.findall(text[begin:at])[-3:])))
            while tail > begin and text[tail - 1].isspace():
                tail -= 1
            if any(m in part[:-1] for m in self.special_marks):
                out[at + 1 : at + len(part)] = [self.count(text[: at + k]) for k in range(1, len(part))]
            else:
                base = out[tail] if tail < at else total
                out[at + 1 : at + len(part)] = base + self.prefixes(text[tail:at] + part[:-1])[at - tail + 1 :]
            at, total = at + len(part), total + 1
            begin = at
            out[at] = total
        return out

    def _counted(self, text: str) -> list[tuple[list[str], list[int], bool]]:
        """(segments, the tokens of each, whether it is a special string) of the parts of a text."""
        return [([part], [1], True) if special else (*self._each(part), False) for part, special in self.parts(text)]

    def _fit(self, counted: list[tuple[list[str], list[int], bool]], budget: int) -> int:
        at = total = 0
        for segments, counts, special in counted:
            for k, (segment, n) in enumerate(zip(segments, counts, strict=True)):
                if total + n > budget:
                    if special:
                        return at
                    # White space before a cut is one piece.
                    back = k > 0 and segments[k - 1].isspace()
                    before, joined = (total - counts[k - 1], len(segments[k - 1])) if back else (total, 0)
                    inside = before + self.prefixes((segments[k - 1] if back else "") + segment)[joined + 1 :]
                    over = np.flatnonzero(inside > budget)
                    return at + (int(over[0]) if len(over) else len(segment) - 1)
                at, total = at + len(segment), total + n
        return at

    def fit(self, text: str | None, budget: int) -> int:
        """Characters of the longest run of whole segments, and then of characters of the next one, within ``budget`` tokens."""
        return self._fit(self._counted(text or ""), budget)

    def measure(self, text: str | None, budget: int) -> tuple[int, int]:
        """The tokens of a text, and how many of its characters are within ``budget``, from one pass."""
        counted = self._counted(text or "")
        total = sum([sum(counts) for _, counts, _ in counted])
        return total, len(text or "") if total <= budget else self._fit(counted, budget)


def counter(path: str) -> PrefixCounter:
    return worker_cache(f"counter-{path}", lambda: PrefixCounter(path))


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep_prefixes: bool = False
) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit and fit_chars (characters within ``limit`` tokens) of every row.

    ``keep_prefixes`` adds ``prefix_counts``, the count at each character prefix,
    so that later budget questions need no encoding at all.  The vocabulary
    file is read where the tasks run; it has to be there on every machine.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            size, tokens, fits, prefixes = [], [], [], []
            for t in texts:
                n, within = c.measure(t, limit)
                size.append(0 if not t else len(t) if t.isascii() else len(t.encode()))
                tokens.append(n)
                fits.append(within)
                if keep_prefixes:
                    prefixes.append(c.prefix_counts(t))
            arrays = [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(fits, pa.int64())]
            if keep_prefixes:
                arrays.append(pa.array(prefixes, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"c0 {kind}, c1 bigint, c2 bigint, c3 boolean, c4 bigint" + ", c5 array<bigint>" * keep_prefixes
    names = [id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"] + ["prefix_counts"] * keep_prefixes
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema).toDF(*names)
