"""Toxicity: class-conditional Kneser-Ney models of words, letter by letter.

Two models of order ``ORDER`` spell every word from its start mark to its end
mark, each letter given up to ``ORDER - 1`` signs before it: one counted on the
labelled toxic texts, one on the ordinary ones.  Both subtract ``DISCOUNT``
from their own counts and hand what it frees to the counts of both classes
together; and a share of each history, as large as new letters are frequent
after it in both classes, goes on to one shared model of shorter histories
(orders ``SHORTER``) made of Kneser-Ney continuation counts, in how many
different longer n-grams an n-gram stands.  So for a letter that no class has
seen after a history, and after a history that only one class knows, both
models say the same; a rare expression is smoothed by the shared counts, and
only what both classes tell apart counts.

With n_c, t_c, k_c for a class's count of an n-gram, of its history, and of the
different letters after that history, n, t, k for both classes together, D
for the discount and g = D k / t:

    P(w | h, c) = (1 - g) * (max(n_c - D, 0) + D k_c n / t) / t_c + g * Q(w | h')
    Q(w | h') = (n' - D + D k' Q(w | h'')) / t'     with continuation counts,

down to single letters, Q = n' / t'.  An n-gram's count in a class is the
number of different texts and spellings its words stand in; copies of a text
count once.

A toxic text is mostly ordinary words: its words come from the ordinary model,
or with probability ``EXPRESSIONS`` from the toxic one.  A text's score is the
difference of its log-likelihoods under that mixture and under the ordinary
model, normalised by its number of words, and then calibrated by isotonic
regression on training rows that the counts have not seen.

No n-gram is dropped: the table of those whose models differ grows with the
words of the training texts.  Up to ``MODEL_ROWS`` of them (12 bytes each) go to
the tasks as sorted arrays; a larger table stays distributed, and words are
scored by joins with it, with the same results.

Defined results: null texts count as empty; empty texts get the share of toxic
training rows.  Every row gets its score, repeated ids too; a null id counts
as held out.  Without labels of both classes every score is the base rate.
Ties and repeated rows get equal scores.  Only doc_id and text are read, so
extra columns do no harm.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.calibration import BROADCAST_LABELS, Isotonic, fit_isotonic, training_labels
from tessera.llm.common import CACHE_ENTRIES, GOLDEN, few_join, fold, materialise, mix64, ship_package, slices, worker_cache

#: Signs of an n-gram, and of those that the shared model backs off to; the discount of all counts.
ORDER, SHORTER, DISCOUNT = 8, (5, 3, 1), 0.75
#: Chance of a toxic text's word to come from the toxic model.
EXPRESSIONS = 0.01
#: N-grams up to which the table goes to the tasks (120 MB, and 40 for its index); beyond, it is joined.
MODEL_ROWS = 10_000_000
#: Letters from which on a chunk without white space is spelt from each place on as well.
LONG = 16
#: Marks of a word's start, of a start inside a word, and of the end; letters of a unit that are counted in one row.
START, INSIDE, END, PIECE = "\x02", "\x01", "\x03", 64
_MARKS = ".,;:!?\"'()[]|"
#: What a raw score is multiplied by before calibration, whose cells are finest around 0 to 1.
SCALE = 64.0


def word_of(chunk: str) -> str:
    """The letters and digits of a white-space separated chunk, in lower case."""
    low = chunk.lower()
    if low.isalnum():
        return low
    inner = low.strip(_MARKS)
    return inner if inner.isalnum() else "".join(filter(str.isalnum, low))


def units_of(chunk: str) -> list[str]:
    """What is spelt of a chunk: its word between the marks of start and end.

    In a chunk of ``LONG`` letters or more each part between other signs is a
    word; one that is as long by itself (glued, or of a script without spaces)
    gives also the letters from each later place on, as far as an n-gram
    reaches, so that an expression is spelt from its start wherever it stands.
    """
    word = word_of(chunk)
    if len(word) < LONG:
        return [START + word + END] if word else []
    low = chunk.lower()
    # Vowel signs and accents don't part words.
    parts = [word] if low.isalnum() else "".join(c if c.isalnum() else "" if unicodedata.category(c)[0] == "M" else " " for c in low).split()
    out: list[str] = []
    for p in parts:
        s = p + END
        out.append(START + s)
        if len(p) >= LONG:
            out += [INSIDE + s[k : k + ORDER - 1] for k in range(1, len(p))]
    return out


def parts_of(unit: str) -> Iterator[tuple[str, int]]:
    """Parts of ``PIECE`` letters, each after the signs that its first letter's history needs, and how many these are."""
    for begin in range(0, len(unit) - 1, PIECE):
        low = max(0, begin - ORDER + 2)
        yield unit[low : begin + PIECE + 1], begin + 1 - low


def gram_keys(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of each unit but its first sign: the hash of the n-gram that it ends, and the unit's position."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    letters = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(units)), sizes)
    starts = (np.cumsum(sizes) - sizes)[owner]
    at = np.flatnonzero(np.arange(len(letters)) > starts)
    owner, starts = owner[at], starts[at]
    h = np.full(len(at), 0x51ED270B, np.uint64)
    for back in range(ORDER - 1, -1, -1):
        place = at - back
        inside = place >= starts
        step = (h ^ letters[np.maximum(place, 0)]) * GOLDEN
        step ^= step >> np.uint64(29)
        h = np.where(inside, step, h)
    return mix64(h), owner


def unit_counts(rows: DataFrame) -> DataFrame:
    """unit, skip, ordinary, toxic: in how many texts and spellings each unit stands, from rows (text, y_).

    Units longer than ``PIECE`` letters come in parts; the first ``skip`` signs
    of a unit are history only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for b in slices(batches):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[int(y)].update(set((text or "").split()))
                if len(counts[0]) + len(counts[1]) > CACHE_ENTRIES:
                    yield from out(counts)
                    counts = Counter(), Counter()
        yield from out(counts)

    def out(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[int]] = {}
        for y, chunks in enumerate(counts):
            for chunk, n in chunks.items():
                for part in (x for unit in units_of(chunk) for x in parts_of(unit)):
                    found.setdefault(part, [0, 0])[y] += n
                if len(found) > 2 * CACHE_ENTRIES:
                    yield batch(found)
                    found = {}
        yield batch(found)

    def batch(found: dict[tuple[str, int], list[int]]) -> pa.RecordBatch:
        n = np.array(list(found.values()), np.int64).reshape(len(found), 2)
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([s for _, s in found], pa.int32()), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["unit", "skip", "ordinary", "toxic"])

    parts = rows.select("text", "y_").mapInArrow(run, "unit string, skip int, ordinary long, toxic long")
    return parts.groupBy("unit", "skip").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _grams(unit: Column, skip: Column) -> Column:
    """The n-grams of a unit, one for each sign after the first ``skip``."""
    return F.transform(F.sequence(skip + 1, F.length(unit)), lambda k: F.substring(unit, F.greatest(k - ORDER + 1, F.lit(1)), F.least(k, F.lit(ORDER))))


def _shorter(gram: Column, order: int) -> Column:
    """The end of an n-gram that the next model looks at: shorter by one sign at least; null if nothing is left."""
    size = F.least(F.length(gram) - 1, F.lit(order))
    return F.when(size > 0, F.substring(gram, F.length(gram) - size + 1, size))


def shared_backoff(grams: DataFrame) -> DataFrame:
    """gram, q: the shared model of the longest of the shorter orders, from all different n-grams (gram)."""
    levels, above = [], grams
    for order in SHORTER:
        above = materialise(above.select(_shorter(F.col("gram"), order).alias("gram")).filter("gram is not null").groupBy("gram").agg(F.count("*").alias("n")), "toxicity-orders")
        levels.append(above)
    below = None
    for k in reversed(range(len(SHORTER))):
        w = Window.partitionBy(F.substring("gram", F.lit(1), F.length("gram") - 1))
        rows = levels[k].withColumn("t", F.sum("n").over(w)).withColumn("k", F.count("*").over(w))
        if below is None:
            rows = rows.withColumn("low", F.lit(None).cast("double"))
        else:
            rows = rows.withColumn("end", _shorter(F.col("gram"), SHORTER[k + 1])).join(below.select(F.col("gram").alias("end"), F.col("q").alias("low")), "end", "left")
        # A single letter backs off to any known letter alike.
        low = F.coalesce("low", 1 / F.col("k"))
        below = rows.select("gram", ((F.col("n") - DISCOUNT + DISCOUNT * F.col("k") * low) / F.col("t")).alias("q"))
    return below


def gram_ratios(units: DataFrame) -> DataFrame:
    """gram, ratio: log P(its last sign | toxic) - log P(its last sign | ordinary), of each n-gram whose history both classes know."""
    grams = units.select(F.explode(_grams(F.col("unit"), F.col("skip"))).alias("gram"), "ordinary", "toxic")
    grams = materialise(grams.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "toxicity-grams")
    w = Window.partitionBy(F.substring("gram", F.lit(1), F.length("gram") - 1))
    rows = grams
    for c in ("ordinary", "toxic"):
        rows = rows.withColumn(f"{c}_t", F.sum(c).over(w)).withColumn(f"{c}_k", F.count_if(F.col(c) > 0).over(w))
    rows = rows.withColumn("k", F.count("*").over(w)).filter("ordinary_t > 0 and toxic_t > 0")
    low = shared_backoff(grams.select("gram"))
    rows = rows.withColumn("end", _shorter(F.col("gram"), SHORTER[0])).join(low.select(F.col("gram").alias("end"), "q"), "end")
    total = F.col("ordinary_t") + F.col("toxic_t")
    goes, both = DISCOUNT * F.col("k") / total, (F.col("ordinary") + F.col("toxic")) / total

    def p(c: str) -> Column:
        own = (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"{c}_k") * both) / F.col(f"{c}_t")
        return (1 - goes) * own + goes * F.col("q")

    return rows.select("gram", (F.log(p("toxic")) - F.log(p("ordinary"))).cast("float").alias("ratio"))


class GramModel:
    """The difference of the two class models for each n-gram where they differ, in sorted arrays.

    The keys are hashes, so the first bits of one tell where it stands.
    """

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ratios = keys[order], ratios[order]

    def _index(self) -> tuple[np.uint64, np.ndarray]:
        bits = max(1, int(np.log2(len(self.keys))))
        shift = np.uint64(64 - bits)
        starts = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((self.keys >> shift).astype(np.int64), minlength=1 << bits), out=starts[1:])
        return shift, starts

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The ratio of each key; 0 for those that the table doesn't have."""
        out = np.zeros(len(keys), np.float32)
        if not len(self.keys):
            return out
        if "index" not in self.__dict__:
            self.index = self._index()
        shift, starts = self.index
        first = (keys >> shift).astype(np.int64)
        at, end = starts[first], starts[first + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            place = at[left]
            hit = self.keys[place] == keys[left]
            out[left[hit]] = self.ratios[place[hit]]
            at[left] += 1
            left = left[~hit & (at[left] < end[left])]
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def log_ratio(self, units: list[str]) -> np.ndarray:
        """log P(unit | toxic) - log P(unit | ordinary) of each unit."""
        if not len(self.keys) or not units:
            return np.zeros(len(units))
        keys, owner = gram_keys(units)
        return np.bincount(owner, self.find(keys), len(units))


def gram_model(ratios: DataFrame) -> GramModel:
    """``ratios`` (gram, ratio) on the driver: 12 bytes for each n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column(0).to_pylist()
            keys, owner = gram_keys(grams)
            last = np.searchsorted(owner, np.arange(len(grams)), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(keys[last].view(np.int64)) if grams else pa.array([], pa.int64()), b.column(1)], names=["key", "ratio"])

    got = ratios.select("gram", "ratio").mapInArrow(run, "key long, ratio float").toArrow()
    return GramModel(got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy())


def mixed(ratio: np.ndarray) -> np.ndarray:
    """log of (1 - m) + m * P(word | toxic) / P(word | ordinary), for the mixture a toxic text's words come from."""
    return np.log1p(EXPRESSIONS * np.expm1(np.minimum(ratio, 600.0)))


def unit_weight(unit: str) -> float:
    """Units that begin inside a word overlap: each letter is in ``ORDER - 1`` of them."""
    return 1 / (ORDER - 1) if unit[0] == INSIDE else 1.0


class _Chunks(dict):
    """Chunk -> its place in two arrays: sums of its units' mixed log ratios, and of their weights. Filled for many chunks at once, emptied when full."""

    def __init__(self, model: GramModel):
        super().__init__()
        self.model = model
        self.values, self.weights = np.zeros(0), np.zeros(0)

    def learn(self, chunks: set[str]) -> None:
        new = list(chunks.difference(self))
        if len(self) + len(new) > 4 * CACHE_ENTRIES:
            self.clear()
            self.values, self.weights = np.zeros(0), np.zeros(0)
            new = list(chunks)
        # Most chunks are one short word, and many the same.
        words = list(map(word_of, new))
        short = {w: k for k, w in enumerate(dict.fromkeys(w for w in words if len(w) < LONG))}
        long = {c: k + len(short) for k, c in enumerate(c for c, w in zip(new, words, strict=True) if len(w) >= LONG)}
        spelt = list(map(units_of, long))
        units = [START + w + END for w in short] + [u for x in spelt for u in x]
        owner = np.concatenate([np.arange(len(short)), np.repeat(np.arange(len(short), len(short) + len(long)), np.fromiter(map(len, spelt), np.int64, len(spelt)))])
        got = mixed(np.concatenate([np.zeros(0), *[self.model.log_ratio(units[k : k + 20_000]) for k in range(0, len(units), 20_000)]]))
        weight = np.concatenate([np.ones(len(short)), np.fromiter(map(unit_weight, units[len(short) :]), np.float64, len(units) - len(short))])
        if "" in short:  # no word at all
            weight[short[""]] = 0.0
        which = np.fromiter((long[c] if len(w) >= LONG else short[w] for c, w in zip(new, words, strict=True)), np.int64, len(new))
        self.update(zip(new, range(len(self.values), len(self.values) + len(new)), strict=True))
        self.values = np.concatenate([self.values, np.bincount(owner, got * weight, len(short) + len(long))[which]])
        self.weights = np.concatenate([self.weights, np.bincount(owner, weight, len(short) + len(long))[which]])


def raw_of_texts(texts: list[str | None], known: _Chunks) -> np.ndarray:
    """The log-likelihood difference of each whole text, by its number of words; NaN without words."""
    out = np.full(len(texts), np.nan)
    at: list[int] = []
    group: list[list[str]] = []
    size = 0

    def done() -> None:
        if not group:
            return
        known.learn(set().union(*group))
        sizes = np.fromiter(map(len, group), np.int64, len(group))
        places = np.fromiter(map(known.__getitem__, chain.from_iterable(group)), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        value, weight = (np.add.reduceat(x[places], starts) for x in (known.values, known.weights))
        some = weight > 0
        out[np.array(at)[some]] = SCALE * value[some] / weight[some]

    for k, text in enumerate(texts):
        chunks = text.split() if text else []
        if chunks:
            at.append(k)
            group.append(chunks)
            size += len(text)
        if size > 2_000_000:
            done()
            at, group, size = [], [], 0
    done()
    return out


def raw_by_join(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """text_key, raw of every different text (text_key, text) with words, by joins with the distributed table ``ratios``."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                found = Counter((b.column(1)[k].as_py() or "").split())
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(found), pa.binary()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["text_key", "chunk", "times"])

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int64(), pa.float64(), pa.string(), pa.int32())
        for b in batches:
            rows = [(key, n, unit_weight(u), *part) for key, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, u in enumerate(units_of(c)) for part in parts_of(u)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "n", "weight", "unit", "skip"])

    # Chunks can be long: they are known by 16 bytes, and spelt once.
    found = texts.mapInArrow(chunks, "text_key binary, chunk string, times long").withColumn("key", F.unhex(F.md5("chunk")))
    found = materialise(found.dropDuplicates(["text_key", "key"]), "toxicity-chunks")
    pairs = found.select("text_key", "key", "times")
    units = found.select("key", "chunk").dropDuplicates(["key"]).mapInArrow(spelt, "key binary, n long, weight double, unit string, skip int")
    grams = units.select("key", "n", "weight", F.explode(_grams(F.col("unit"), F.col("skip"))).alias("gram"))
    ratio = few_join(grams, ratios, "gram", F.col("key"), "left").groupBy("key", "n", "weight").agg(F.sum(F.coalesce(F.col("ratio").cast("double"), F.lit(0.0))).alias("ratio"))
    value = F.log1p(EXPRESSIONS * F.expm1(F.least(F.col("ratio"), F.lit(600.0))))
    values = materialise(ratio.groupBy("key").agg(F.sum(value * F.col("weight")).alias("value"), F.sum("weight").alias("weight")), "toxicity-values")
    sums = few_join(pairs, values, "key", F.col("text_key")).groupBy("text_key").agg(F.sum(F.col("times") * F.col("value")).alias("a"), F.sum(F.col("times") * F.col("weight")).alias("b"))
    return sums.select("text_key", (SCALE * F.col("a") / F.col("b")).alias("raw"))


def text_key(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


class ToxicityScorer:
    """Scores texts: the models' table (on the tasks, or distributed), the calibration and the base rate."""

    def __init__(self, base: float):
        self.shared = self.ratios = None
        self.base, self.curve = base, Isotonic(np.zeros(0), np.zeros(0), np.zeros(0))

    def calibration(self) -> Callable[[np.ndarray], np.ndarray]:
        base, curve = self.base, self.curve
        return lambda raw: np.where(np.isnan(raw), base, curve(np.nan_to_num(raw)))

    def over(self, rows: DataFrame, out: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema) -> DataFrame:
        """``out`` of each batch of ``rows`` (which have a column text) and of its texts' raw scores (NaN: no words, or no models)."""
        names = rows.columns
        at, width = names.index("text"), len(names)
        if self.ratios is None:
            shared, name = self.shared, f"toxicity-{uuid.uuid4().hex}"

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in slices(batches):
                    if shared is None:
                        yield out(b, np.full(b.num_rows, np.nan))
                    else:
                        yield out(b, raw_of_texts(b.column(at).to_pylist(), worker_cache(name, lambda: _Chunks(shared.value))))

            return rows.mapInArrow(run, schema)
        keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row_"), text_key(F.col("text")).alias("text_key"))
        texts = rows.select(text_key(F.col("text")).alias("text_key"), "text").filter("text is not null")
        found = materialise(raw_by_join(texts, self.ratios), "toxicity-raw")
        scored = few_join(keyed, found, "text_key", F.monotonically_increasing_id(), "left")
        scored = scored.select(*[F.col("row_").getField(c).alias(f"c{k}") for k, c in enumerate(rows.columns)], F.col("raw").alias("raw_"))

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = pa.RecordBatch.from_arrays(b.columns[:width], names=names)
                yield out(own, b.column(width).to_numpy(zero_copy_only=False).astype(np.float64))

        return scored.mapInArrow(finish, schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, model_rows: int = MODEL_ROWS) -> ToxicityScorer:
    """Learn from the labelled rows of folds 1 to 4: folds 1 to 3 give the counts, fold 4 the calibration."""
    spark = docs.sparkSession
    ship_package(spark)
    marks = training_labels(labels, "toxic").filter(fold(F.col("doc_id")) != 0)
    marks = materialise(marks.withColumn("fold_", fold(F.col("doc_id"))), "toxicity-labels")
    head = marks.agg(F.count("*").alias("n"), F.avg("y_").alias("p"), F.count_if(F.expr("fold_ <> 4 and y_ = 1")).alias("toxic"), F.count_if(F.expr("fold_ <> 4 and y_ = 0")).alias("ordinary")).first()
    scorer = ToxicityScorer(head["p"] if head["n"] else 0.5)
    if not (head["toxic"] and head["ordinary"]):
        return scorer

    def labelled(some: DataFrame) -> DataFrame:
        return docs.select("doc_id", "text").join(F.broadcast(some) if head["n"] <= BROADCAST_LABELS else some, "doc_id")

    # Of texts alike in a class the one with the smallest id is counted.
    alike = labelled(marks.filter("fold_ <> 4")).groupBy(F.xxhash64("text").alias("key_"), "y_").agg(F.min("doc_id").alias("doc_id"))
    counted = labelled(materialise(alike.select("doc_id", "y_"), "toxicity-texts"))
    ratios = materialise(gram_ratios(unit_counts(counted)).filter("ratio <> 0"), "toxicity-model")
    if ratios.count() <= model_rows:
        scorer.shared = spark.sparkContext.broadcast(gram_model(ratios))
    else:
        scorer.ratios = ratios

    def raw(b: pa.RecordBatch, got: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(got, pa.float64(), from_pandas=True), b.column(1)], names=["raw", "y_"])

    scored = scorer.over(labelled(marks.filter("fold_ = 4")).select("text", "y_"), raw, "raw double, y_ double")
    scorer.curve = fit_isotonic(scored.filter("raw is not null"))
    return scorer


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, model_rows: int = MODEL_ROWS) -> DataFrame:
    """doc_id, held_out (fold 0), score, predicted of every document."""
    scorer = fit_toxicity(docs, labels, model_rows)
    calibrated = scorer.calibration()

    def score(b: pa.RecordBatch, raw: np.ndarray) -> pa.RecordBatch:
        got = calibrated(raw)
        return pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=["c0", "c1", "c2", "c3"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("text", "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"))
    return scorer.over(rows, score, f"c0 {kind}, c1 boolean, c2 double, c3 int").toDF("doc_id", "held_out", "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, model_rows: int = MODEL_ROWS) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold."""
    scorer = fit_toxicity(docs, labels, model_rows)
    calibrated = scorer.calibration()
    return scorer.over(docs, lambda b, raw: b.filter(pa.array(calibrated(raw) < threshold)), docs.schema)
