"""Document quality: random Fourier features, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens.llm._store import importable, settle

#: Document statistics, random features, penalty per training row, calibration bins.
STATISTICS = 24
FEATURES = 256
RIDGE = 1e-4
BINS = 1024
#: Partial sums that one task adds up.
FAN_IN = 32

_CLASSES = np.zeros((256, 8))
for _i, _bytes in enumerate((b" \t\n\r\x0b\x0c", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)),
                             b".,;:'\"()-", b"#*$%&|<>", b"!?", bytes(range(128, 256)))):
    _CLASSES[list(_bytes), _i] = 1


def statistics(text: str) -> np.ndarray:
    """Statistics of a whole text; zeros where a text has no words."""
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    out = np.zeros(STATISTICS, np.float32)
    if not words:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts @ _CLASSES / len(raw)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    some = counts[counts > 0] / len(raw)
    distinct, long = len(set(words)), int(sizes.max())
    out[:8] = shares
    out[8:] = (
        np.log1p(len(raw)), np.log1p(len(words)), sizes.mean(), sizes.std(), np.log1p(long),
        distinct / len(words), np.log1p(len(words)) - np.log1p(distinct), len(set(lines)) / len(lines),
        np.log1p(len(words) / len(lines)), -(some * np.log(some)).sum(), (sizes <= 3).mean(), (sizes >= 12).mean(),
        raw.count(b"!!") / len(words), raw.count(b" | ") / len(words), raw.count(b". ") / len(words), 1.0,
    )
    return out


def _statistics_table(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["id", "x"])

    return docs.mapInArrow(run, "id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS).astype(np.float64)


class Features:
    """Standardised statistics, their constant, and cosines that approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turns = rng.normal(size=(STATISTICS, features)) / np.sqrt(STATISTICS / 2)
        self.shift = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        wave = np.cos(x @ self.turns + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([np.ones((len(x), 1)), x, wave])


def _summed(rows: DataFrame, measure, size: int) -> np.ndarray:
    """Sum of ``measure(x, y)`` (``size`` numbers) over blocks of rows: per partition, then in a tree.

    Each level adds up ``FAN_IN`` partial sums per task until at most that many reach the driver.
    """
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += measure(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for s in batch.column(0):
                total += np.frombuffer(s.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    parts = rows.rdd.getNumPartitions()
    sums = rows.mapInArrow(first, "s binary")
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        sums = sums.repartition(parts).mapInArrow(more, "s binary")
    return sum((np.frombuffer(r["s"]) for r in sums.collect()), np.zeros(size))


def isotonic(values: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing rates by pooling neighbours that violate the order; block centres and rates."""
    blocks: list[list[float]] = []
    for v, p, n in zip(values, positives, counts):
        blocks.append([v * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fold(id_col: str) -> str:
    return f"crc32(CAST(`{id_col}` AS STRING)) % 5"


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    ridge: float = RIDGE) -> DataFrame:
    """``id_col, held_out, score`` for every row of ``docs``; the score estimates the chance of quality 1.

    Only text statistics enter the score. Labels of fold 0 (crc32 of the id modulo 5) are never read; folds
    1 to 3 fit the ridge weights by summed normal equations, fold 4 the calibration. The statistics are
    computed once and kept in the checkpoint folder; what reaches the driver are sums of fixed size and
    ``BINS`` bins.

    Null and empty texts have zero statistics and are scored like others; null ids match no label and are not
    held out; repeated rows are scored each, repeated labels count once (the larger); further columns are
    left out; an empty table gives no rows. Without labels of both folds all scores are 0.5.
    """
    importable(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    stats = settle(_statistics_table(source))
    votes = (labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("quality").cast("double").alias("y"))
             .where(f"y IS NOT NULL AND {fold('id')} <> 0").groupBy("id").agg(F.max("y").alias("y")))
    labelled = settle(stats.join(votes, "id").select("x", "y", F.expr(fold("id")).alias("fold")))
    fit = labelled.where("fold < 4").select("x", "y")

    moments = _summed(fit, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * STATISTICS)
    n = moments[0]
    calibrated = None
    if n:
        mean = moments[1: 1 + STATISTICS] / n
        features = Features(mean, np.sqrt(np.maximum(moments[1 + STATISTICS:] / n - mean ** 2, 1e-9)))
        width = 1 + STATISTICS + FEATURES
        sums = _summed(fit, lambda x, y: (lambda z: np.concatenate([(z.T @ z).ravel(), z.T @ y]))(features(x)),
                       width * width + width)
        gram, target = sums[: width * width].reshape(width, width), sums[width * width:]
        penalty = np.full(width, ridge * n)
        penalty[0] = 1e-9 * n
        weights = np.linalg.solve(gram + np.diag(penalty), target)

        def raw(x: np.ndarray) -> np.ndarray:
            return np.clip(features(x) @ weights, -0.5, 1.5)

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = raw(_matrix(batch.column(0))) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum((score + 0.5) / 2 * BINS, BINS - 1).astype(np.int64)), batch.column(1)], names=["bin", "y"])

        bins = sorted(labelled.where("fold = 4").select("x", "y").mapInArrow(binned, "bin long, y double")
                      .groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect())
        if bins:
            calibrated = isotonic(np.array([(b["bin"] + 0.5) / BINS * 2 - 0.5 for b in bins]),
                                  np.array([b["y"] for b in bins]), np.array([b["n"] for b in bins], dtype=float))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if calibrated is None or not batch.num_rows:
                score = np.full(batch.num_rows, 0.5)
            else:
                score = np.clip(np.interp(raw(_matrix(batch.column(1))), *calibrated), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

    return (stats.mapInArrow(scored, "id long, score double")
            .selectExpr(f"id AS `{id_col}`", f"coalesce({fold('id')} = 0, false) AS held_out", "score"))
