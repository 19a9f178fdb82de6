"""Document quality: random Fourier features, ridge by summed normal equations, isotonic calibration.

Each text is reduced to statistics of its characters, words and lines.  Random
Fourier features approximate a Gaussian kernel over the standardised
statistics; every partition sums its share of the normal equations, the
shares are added on the executors, and the driver solves one small system.
The ridge scores are calibrated by isotonic regression on training rows that
the system has not seen.

Defined results: a null text counts as empty; every row gets its score,
repeated ids too.  Labels are read for training ids only, and neither
language nor source nor the id enters a score.  Without labels every score is
one half.  Only doc_id and text are read, so extra columns do no harm.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.calibration import Isotonic, fit_isotonic, training_labels
from tessera.llm.common import fold, materialise, ship_package, slices

#: Number of random features, width of the kernel (in standard deviations), ridge penalty for each row.
FEATURES, WIDTH, PENALTY, SEED = 256, 3.0, 1e-4, 20240229
STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "upper", "digits", "stops", "bars",
    "bangs", "symbols", "spaces", "lines", "line_length", "distinct_lines", "beyond_ascii", "capitalised",
)

_UPPER, _DIGIT, _STOP = (np.isin(np.arange(256), np.frombuffer(s, np.uint8)) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?"))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*+/<=>@[\\]^_`{}~", np.uint8))


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``."""
    text = text or ""
    data = np.frombuffer(text.encode(), np.uint8)
    by = np.bincount(data, minlength=256)
    n = max(len(data), 1)
    words = text.split()
    w = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    lines = text.split("\n")
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        len(counts) / w, (max(counts.values()) if counts else 0) / w, float(by[_UPPER].sum()) / n, float(by[_DIGIT].sum()) / n,
        float(by[_STOP].sum()) / w, float(by[124]) / w, float(by[33]) / w, float(by[_SYMBOL].sum()) / n, float(by[32]) / n,
        float(by[10]) / w, float(np.log1p(n / len(lines))), len(set(lines)) / len(lines), float(by[128:].sum()) / n,
        sum(map(str.istitle, counts)) / max(len(counts), 1),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stats (array of double)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.float64()))], names=["c0", "c1"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"c0 {kind}, c1 array<double>").toDF(id_col, "stats")


class KernelRidge:
    """Random Fourier features and the ridge weights on them."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.directions = rng.normal(size=(len(mean), features)) / width
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -8, 8)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2.0 / len(self.phases))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return (self.features(stats) @ self.weights - 0.5) * 4.0


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def fit_kernel_ridge(rows: DataFrame) -> KernelRidge | None:
    """From rows (stats, y_), all of them; the driver gets one row for each feature."""
    sizes = range(len(STATISTICS))
    head = rows.agg(F.count("*").alias("n"), *[f(F.col("stats")[k]).alias(f"{a}{k}") for k in sizes for a, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not head or not head["n"]:
        return None
    model = KernelRidge(np.array([head[f"m{k}"] for k in sizes]), np.array([head[f"s{k}"] for k in sizes]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(model.weights), len(model.weights) + 1))
        for b in batches:
            z = model.features(_stack(b.column(0)))
            total += np.concatenate([z.T @ z, (z.T @ b.column(1).to_numpy())[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                row = row.values.to_numpy()
                total[i] = total[i] + row if i in total else row
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["i", "row"])

    schema = "i long, row array<double>"
    system = rows.select("stats", "y_").mapInArrow(sums, schema).repartition(8, "i").mapInArrow(added, schema).collect()
    matrix = np.array([r["row"] for r in sorted(system, key=lambda r: r["i"])])
    penalty = PENALTY * head["n"] * np.eye(len(matrix))
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(matrix[:, :-1] + penalty, matrix[:, -1])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Folds 1 to 3 of the ids fit the ridge weights, fold 4 the calibration;
    fold 0 is held out.
    """
    stats = materialise(document_statistics(docs).withColumn("fold_", fold(F.col("doc_id"))), "quality-statistics")
    train = stats.filter("fold_ <> 0").join(training_labels(labels, "quality"), "doc_id")
    model = fit_kernel_ridge(train.filter("fold_ <> 4"))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_stack(b.column(0)))), b.column(1)], names=["raw", "y_"])

    curve = Isotonic(np.zeros(0), np.zeros(0), np.zeros(0))
    if model is not None:
        curve = fit_isotonic(train.filter("fold_ = 4").select("stats", "y_").mapInArrow(raw, "raw double, y_ double"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _stack(b.column(2))
            got = curve(model.raw(x)) if model is not None else np.full(len(x), 0.5)
            held = pa.array(b.column(1).to_numpy(zero_copy_only=False) == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), held, pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=["c0", "c1", "c2", "c3"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", "fold_", "stats").mapInArrow(score, f"c0 {kind}, c1 boolean, c2 double, c3 int").toDF("doc_id", "held_out", "score", "predicted")
