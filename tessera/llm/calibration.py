"""Labels for training, and isotonic calibration of raw scores from bounded histograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of the histogram a calibration is fitted on, whatever the number of rows.
BINS = 4000
#: Label rows up to which the label table is broadcast (16 bytes each); larger ones are joined by a shuffle.
BROADCAST_LABELS = 2_000_000


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """``doc_id``, ``y_`` (0.0 or 1.0): one row for each labelled id.

    Null ids and labels don't count; an id labelled both ways has what most of
    its rows say, and 1 in a tie.
    """
    kept = labels.select(F.col("doc_id"), F.col(column).cast("double").alias("y_")).filter("doc_id is not null and y_ is not null")
    return kept.groupBy("doc_id").agg((F.avg("y_") >= 0.5).cast("double").alias("y_"))


def squash(raw: np.ndarray) -> np.ndarray:
    """Any number to 0..1, monotonically."""
    return 0.5 + 0.5 * raw / (1.0 + np.abs(raw))


def bin_of(raw: Column) -> Column:
    """The histogram cell of a raw score."""
    return F.floor((0.5 + 0.5 * raw / (1.0 + F.abs(raw))) * (BINS - 1)).cast("int")


class Isotonic:
    """Pool-adjacent-violators on weighted points, linear between the blocks' centres."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, positives: np.ndarray):
        blocks: list[list[float]] = []  # weighted x, weight, positives
        for a, w, p in zip(x, weight, positives, strict=True):
            blocks.append([a * w, w, p])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
                b = blocks.pop()
                for k in range(3):
                    blocks[-1][k] += b[k]
        self.x = np.array([b[0] / b[1] for b in blocks])
        # Half a count on either side keeps rates of few rows off 0 and 1.
        self.y = np.maximum.accumulate(np.array([(b[2] + 0.5) / (b[1] + 1.0) for b in blocks])) if blocks else np.zeros(0)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        u = squash(np.asarray(raw, np.float64))
        level = np.interp(u, self.x, self.y) if len(self.x) else np.full(u.shape, 0.5)
        return np.clip(0.998 * level + 0.002 * u, 0.0, 1.0)  # the small slope keeps the order within a block


def fit_isotonic(scored: DataFrame) -> Isotonic:
    """From rows (raw, y_); what reaches the driver is at most ``BINS`` rows."""
    rows = scored.groupBy(bin_of(F.col("raw")).alias("b")).agg(F.count("*").alias("n"), F.sum("y_").alias("p")).collect()
    rows = sorted((r for r in rows if r["b"] is not None), key=lambda r: r["b"])
    x = np.array([(r["b"] + 0.5) / (BINS - 1) for r in rows])
    return Isotonic(x, np.array([float(r["n"]) for r in rows]), np.array([float(r["p"]) for r in rows]))
