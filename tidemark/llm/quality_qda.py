"""Quality classifier: regularised quadratic discriminant over statistics of whole texts.

``statistics`` reads each text once and gives nine transformed counts per document. ``fit`` adds up
means and products per class over all labelled rows (Spark sums; 2 * 55 numbers come to the driver),
shrinks each class covariance towards the pooled one and a scaled identity, and factors it once.
``score`` takes the difference of the Mahalanobis log densities through the cached inverse factors.

Defined cases: a null text is empty; an empty text has the statistics of no words and gets a score as
any other; labels other than 0 and 1 and null ids are not learned from; repeated labels count each;
without any labelled row the score is 1/2, with one class only it is that class; repeated rows give a
row each; further columns are kept by ``keep_good`` and ignored by the query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import query
from .support import stage, table
from .words import FOLDED, Hasher, runs, slices, utf8

#: Rows with this remainder of crc32(doc_id) modulo FOLDS are held out (contract).
FOLDS, HELD = 5, 0
CUT = 0.3
#: Shares of the pooled covariance and of the scaled identity in each class covariance.
POOLED, ROUND = 0.1, 0.01
RATE_FLOOR = 1e-3
#: Added to the size that a rate refers to, so that a single mark in a very short text says little.
STEADY = 8

NAMES = ["words", "word_size", "symbols", "shouts", "capitals", "digits", "echoes", "points", "lines"]
D = len(NAMES)


def statistics_of(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> np.ndarray:
    """Transformed statistics of the rows of a part: logs of sizes, and logs of rates above a floor."""

    def summed(member: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(member, dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def marked(chars: str) -> np.ndarray:
        lut = np.zeros(256, bool)
        lut[[ord(c) for c in chars]] = True
        return summed(lut[data])

    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    starts, ends = runs(~space[data], offsets)
    folded = hasher.pieces(hasher.sums(FOLDED[data]), starts, ends)
    first = np.searchsorted(starts, offsets)
    same = np.zeros(len(starts) + 1, np.int64)
    if len(starts) > 1:
        same[1:-1] = folded[1:] == folded[:-1]
        inner = first[:-1][first[:-1] < len(starts)]
        same[inner] = 0  # the word before belongs to another row
    echo = np.concatenate([[0], np.cumsum(same[: len(starts)])])
    words = np.diff(first).astype(float)
    chars = summed((data & 0xC0) != 0x80)
    per_word = np.maximum(words, 1)
    upper = summed((data >= 65) & (data <= 90))
    letters = upper + summed(((data >= 97) & (data <= 122)) | (data >= 192))
    rate = lambda x, n: np.log(RATE_FLOOR + x / (n + STEADY))
    return np.column_stack([
        np.log1p(words), np.log1p(chars / per_word), rate(marked("#*$%&|<>"), words), rate(marked("!"), words),
        rate(upper, letters), rate(marked("0123456789"), chars),
        rate((echo[first[1:]] - echo[first[:-1]]).astype(float), words), rate(marked(".,;:?"), words), rate(marked("\n"), words),
    ])


def _parts(source, text: str):
    hasher = Hasher()
    for whole in source:
        for part in slices(whole, text):
            yield part, statistics_of(*utf8(part.column(text)), hasher)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the array ``x`` of statistics of each row."""

    def batches(source):
        for part, x in _parts(source, "text"):
            yield pa.record_batch([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, x array<double>")


@dataclass
class Model:
    """Class means, inverse Cholesky factors and log densities at the mean; ``known`` holds the classes seen."""

    prior: np.ndarray
    known: tuple[int, ...]
    mean: np.ndarray | None = None
    factor: np.ndarray | None = None
    offset: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.known) < 2:
            return np.full(len(x), float(self.known[0]) if self.known else 0.5)
        density = [self.offset[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30)))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from all labelled rows of the folds that are not held out."""
    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != HELD)
    x = [F.col("x")[i] for i in range(D)]
    sums = [F.sum(c) for c in x] + [F.sum(x[i] * x[j]) for i in range(D) for j in range(i + 1)]
    rows = stats.join(known, "doc_id").groupBy("quality").agg(F.count(F.lit(1)), *sums).collect()
    n, mean, cov = np.zeros(2), np.zeros((2, D)), np.zeros((2, D, D))
    for row in rows:
        k, n[row[0]] = row[0], row[1]
        mean[k] = np.array(row[2 : 2 + D]) / row[1]
        cov[k][np.tril_indices(D)] = np.array(row[2 + D :]) / row[1]
        cov[k] = cov[k] + np.tril(cov[k], -1).T - np.outer(mean[k], mean[k])
    classes = tuple(int(k) for k in (0, 1) if n[k])
    if len(classes) < 2:
        return Model(n, classes)
    pooled = (n[:, None, None] * cov).sum(axis=0) / n.sum()
    shrunk = (1 - POOLED) * cov + POOLED * pooled
    size = np.trace(shrunk, axis1=1, axis2=2) / D
    shrunk = (1 - ROUND) * shrunk + ROUND * np.maximum(size, 1e-9)[:, None, None] * np.eye(D)
    lower = np.linalg.cholesky(shrunk)
    offset = np.log(n / n.sum()) - np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)
    return Model(n, classes, mean, np.linalg.inv(lower), offset)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns kept."""
    model = fit(stage(statistics(docs), "quality-statistics"), labels)

    def batches(source):
        for part, x in _parts(source, "text"):
            yield part.filter(pa.array(model.score(x) >= cut))

    return docs.mapInArrow(batches, docs.schema)


@query("op5_quality_qda")
def op5_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stage(statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    model = fit(stats, table(spark, sf_dir, "labels"))

    def batches(source):
        for part in source:
            x = np.array(part.column("x").to_pylist(), float).reshape(-1, D)
            yield pa.record_batch([part.column("doc_id"), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD
    return stats.mapInArrow(batches, "doc_id long, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
