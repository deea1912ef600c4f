"""Quality: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text gives a row of statistics (sizes, shares of character classes, repetition of words and lines).
Random Fourier features approximate a Gaussian kernel over them (Rahimi and Recht, 2007). Every
partition sums its rows' normal equations, a second stage sums the sums, and the driver solves one
system of fixed size. Raw scores are counted in a fixed number of bins, and pooling adjacent violators
over the bins gives the calibration. All labelled rows of the training folds take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, md5_bits

FOURIER = 192
BINS = 1024
RIDGE = 1e-3
#: Tasks of the second stage of the sums, and so rows that reach the driver.
SUMMERS = 8
#: Labelled documents that ``labelled_statistics`` takes at most.
MAX_LABELLED = 100_000

# Character classes by byte.
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n\r",
    "stop": b".,;:'\"-()",
    "loud": b"!?",
}
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)  # other ASCII
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _k
_CLASS_OF[128:192] = len(_CLASSES) + 1  # continues a character
_CLASS_OF[192:] = len(_CLASSES) + 2  # starts a character beyond ASCII
N_CLASSES = len(_CLASSES) + 3
N_STATS = N_CLASSES - 1 + 9


def statistics(text: str | None) -> np.ndarray:
    """The text's statistics; all zero for null and empty texts."""
    data = (text or "").encode()
    out = np.zeros(N_STATS)
    if not data:
        return out
    count = np.bincount(_CLASS_OF[np.frombuffer(data, np.uint8)], minlength=N_CLASSES).astype(float)
    count = np.delete(count, len(_CLASSES) + 1)
    words, lines = data.split(), data.split(b"\n")
    n, chars = len(words), count.sum()
    filled = [x for x in lines if x]
    out[: N_CLASSES - 1] = np.sqrt(count / chars)
    out[N_CLASSES - 1 :] = (
        np.log1p(chars),
        np.log1p(n),
        np.log1p(len(lines)),
        len(set(words)) / n if n else 0,
        sum(map(eq, words, words[1:])) / n if n else 0,
        sum(map(eq, words, words[2:])) / n if n else 0,
        len(set(filled)) / len(filled) if filled else 0,
        np.log1p(sum(map(len, words)) / n) if n else 0,
        np.log1p(max(map(len, words))) if n else 0,
    )
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats`` (32-bit floats as binary) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()).astype("<f4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.binary())], ["doc_id", "stats"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, stats binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), N_STATS).astype(float)


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """The sum over all rows of the vectors of ``size`` numbers that ``part`` makes of each batch: by partition, then in SUMMERS tasks."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(size), False
        for batch in batches:
            if len(batch):
                total += part(batch)
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column(0):
                total += np.frombuffer(v.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    found = rows.mapInArrow(first, "v binary").repartition(SUMMERS).mapInArrow(again, "v binary").collect()
    return sum((np.frombuffer(r.v) for r in found), np.zeros(size))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / FOURIER) * np.cos(x @ self.turn + self.shift)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def isotonic(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Rising means of ``ones / total`` by pooling adjacent violators; every bin has rows."""
    blocks: list[list[float]] = []
    for n, s in zip(total.tolist(), ones.tolist(), strict=True):
        blocks.append([n, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, s2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + s2, blocks[-1][2] + k2]
    return np.repeat([s / n for n, s, _ in blocks], [int(k) for _, _, k in blocks])


def train_model(stats: DataFrame, labels: DataFrame, train: Column, seed: int = 5) -> Model:
    """The model of ``labels(doc_id, quality)`` rows that meet ``train``; ids that are labelled twice have the mean label.

    Without labelled rows every score is 1/2.
    """
    known = labels.where(train & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.avg("quality").alias("y"))
    rows = materialize(stats.join(known, F.col("doc_id") == F.col("__id")).select("stats", "y"), "quality-train")

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    sums = _summed(rows, moments, 1 + 2 * N_STATS)
    n = max(sums[0], 1.0)
    mean = sums[1 : 1 + N_STATS] / n
    scale = np.sqrt(np.maximum(sums[1 + N_STATS :] / n - mean**2, 0)) + 1e-3
    rng = np.random.default_rng(seed)
    turn = rng.standard_normal((N_STATS, FOURIER)) / np.sqrt(N_STATS)
    shift = rng.uniform(0, 2 * np.pi, FOURIER)
    plain = Model(mean, scale, turn, shift, np.zeros(FOURIER + 1), np.array([0.0]), np.array([0.5]))
    if not sums[0]:
        return plain

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z, y = plain.features(_matrix(batch.column(0))), batch.column(1).to_numpy()
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    d = FOURIER + 1
    sums = _summed(rows, equations, d * d + d)
    weights = np.linalg.solve(sums[: d * d].reshape(d, d) + RIDGE * n * np.diag([*[1 / FOURIER] * FOURIER, 1e-9]), sums[d * d :])
    ridge = Model(mean, scale, turn, shift, weights, plain.knots, plain.levels)

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        raw, y = ridge.raw(_matrix(batch.column(0))), batch.column(1).to_numpy()
        at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, raw, BINS)])

    total, ones, where = _summed(rows, binned, 3 * BINS).reshape(3, BINS)
    used = total > 0
    return Model(mean, scale, turn, shift, weights, where[used] / total[used], isotonic(total[used], ones[used]))


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for each row of ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_matrix(batch.column(1))) if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for each input row, from a model trained on the labelled rows that meet ``train``.

    Null and empty texts are scored as a row of zero statistics, very long ones by their whole text;
    repeated rows each give a row, an empty table none; other columns of ``docs`` are not looked at.
    """
    stats = materialize(document_statistics(docs, id_col, text_col), "quality-stats")
    return score_statistics(stats, train_model(stats, labels, train))


def labelled_statistics(docs: DataFrame, labels: DataFrame, train: Column, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats`` of at most ``most`` labelled documents that meet ``train``, those with the smallest hashes of their ids."""
    known = labels.where(train & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id")).distinct()
    picked = known.orderBy(md5_bits(F.col("__id").cast("string"), 60), "__id").limit(most)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.join(F.broadcast(materialize(picked, "quality-sample")), F.col("doc_id") == F.col("__id"))
    return materialize(document_statistics(rows), "quality-stats")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns and no shuffle.

    Null and empty texts are scored as a row of zero statistics; repeated rows stay repeated; an empty
    table stays empty. Only texts go to Python, and of them only scores come back.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        stats = np.array([statistics(t.as_py()).astype("<f4") for t in texts], float).reshape(len(texts), N_STATS)
        return pa.array(model.scores(stats), pa.float64())

    return docs.where(score(F.col(f"`{text_col}`")) >= threshold)
