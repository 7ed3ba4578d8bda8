"""Quality classifier: random Fourier features over document statistics, ridge by partition-summed normal equations.

``cos(xW + b)`` of standardised statistics x approximates a Gaussian kernel.  Each partition of the training rows sums
its normal equations, the driver adds the sums (one matrix a partition, at most FIT_PARTITIONS) and solves for ridge
scores; isotonic regression on labelled rows that the ridge did not see turns them into probabilities.

Labels: rows with a null label or id are no training rows; an id with several labels trains once for each.  Training
takes at most ``max_fit_rows`` labelled rows, chosen by a hash of the id; every row is scored.  Texts: null counts as
empty, and an empty text has the statistics zero and is scored like any other; long texts are measured whole.  Without
usable labels of both kinds every score is the share of label 1 (0.5 without any).  Only the id, text and label columns
are read.  Equal texts score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, own_columns, remainder, stage_table, text_bytes

MAX_FIT_ROWS = 200_000
FIT_PARTITIONS = 16
N_STATISTICS = 20

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_HIGH = np.arange(256) >= 128
_LEADS = (np.arange(256) < 128) | (np.arange(256) >= 192)
_SPACES = [9, 10, 11, 12, 13, 32]


def text_statistics(text: bytes | None) -> np.ndarray:
    """Twenty ratios and logarithms of a whole text, from its byte counts, words and lines."""
    out = np.zeros(N_STATISTICS)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = max(1, int(counts[_LEADS].sum()))
    words = text.split()
    n = len(words)
    lines = text.split(b"\n")
    distinct = len(set(words))
    lower = int(counts[97:123].sum())
    upper = int(counts[65:91].sum())
    w = max(1, n)
    fresh = sum(len(set(words[at : at + 200])) for at in range(0, n, 200))  # of each stretch of 200 words
    long = max(map(len, words), default=0)
    out[:] = (
        np.log1p(n),
        np.log1p(len(text) / w),
        np.log1p(long),
        distinct / w,
        fresh / w,
        sum(map(eq, words, islice(words, 1, None))) / w,
        (len(lines) - len(set(lines))) / len(lines),
        np.log1p(n / len(lines)),
        upper / max(1, upper + lower),
        counts[48:58].sum() / chars,
        sum(int(counts[c]) for c in b"#*$%&") / w,
        counts[124] / w,
        (counts[60] + counts[62]) / w,
        (counts[33] + counts[63]) / w,
        sum(int(counts[c]) for c in b".,;:") / w,
        counts[_LETTERS].sum() / chars,
        counts[_HIGH & _LEADS].sum() / chars,
        counts[_SPACES].sum() / chars,
        counts[46] / w,
        counts[[0, *range(1, 9), *range(14, 32), 127]].sum() / chars,
    )
    return out


def _vectors(flat: np.ndarray) -> pa.Array:
    n, width = flat.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(flat.ravel()))


def statistics(text: str | Column) -> Column:
    """The statistics of each text, as an array of doubles."""

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        return _vectors(np.array([text_statistics(t) for t in text_bytes(texts)]).reshape(-1, N_STATISTICS))

    return measure(text)


@dataclass(frozen=True)
class QualityModel:
    """Everything that a score needs: a few ten kilobytes, whatever the input."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # statistics x features
    phases: np.ndarray
    ridge: np.ndarray  # of the features, then the constant
    steps: np.ndarray  # ridge scores at which the calibrated probability is known, rising
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.weights + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.ridge, self.steps, self.levels)

    def column(self, vectors: str | Column) -> Column:
        """The score of each row of a column of statistics."""
        model = self

        @F.arrow_udf("double")
        def score(v: pa.Array) -> pa.Array:
            return pa.array(model.score(v.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)))

        return score(vectors)

    def text_column(self, text: str | Column) -> Column:
        """The score of each text."""
        model = self

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            return pa.array(model.score(np.array([text_statistics(t) for t in text_bytes(texts)]).reshape(-1, N_STATISTICS)))

        return score(text)


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (scores, levels), both rising, to interpolate between.  Equal scores share a level."""
    at, inverse = np.unique(scores, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, labels) / weight
    blocks: list[list[float]] = []  # mean, weight, first, last
    for i in range(len(at)):
        blocks.append([mean[i], weight[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            top = blocks[-1]
            top[0], top[1], top[3] = (top[0] * top[1] + m * w) / (top[1] + w), top[1] + w, last
    steps, levels = [], []
    for m, _, first, last in blocks:
        for i in {int(first), int(last)} if first != last else {int(first)}:
            steps.append(at[i])
            levels.append(m)
    order = np.argsort(steps, kind="stable")
    return np.array(steps)[order], np.array(levels)[order]


def _constant(level: float) -> QualityModel:
    zero = np.zeros
    return QualityModel(zero(N_STATISTICS), np.ones(N_STATISTICS), zero((N_STATISTICS, 1)), zero(1), zero(2), zero(1), np.array([level]))


def fit(
    labelled: DataFrame,
    *,
    features: int = 192,
    length_scale: float = 4.0,
    penalty: float = 1e-3,
    seed: int = 11,
    max_fit_rows: int = MAX_FIT_ROWS,
) -> QualityModel:
    """A model from a staged table (x: statistics, y: 0 or 1, fold: 0 for calibration rows, else ridge rows)."""
    seen = labelled.agg(F.count("y").alias("n"), F.avg("y").alias("level")).first()
    if not seen["n"] or not 0 < seen["level"] < 1:
        return _constant(0.5 if seen["level"] is None else float(seen["level"]))
    if seen["n"] > max_fit_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(1_000_000)) < int(1e6 * max_fit_rows / seen["n"]))
    labelled = labelled.coalesce(FIT_PARTITIONS)
    moments = labelled.agg(
        *(f(F.col("x")[i]).alias(f"{f.__name__}_{i}") for i in range(N_STATISTICS) for f in (F.avg, F.stddev_pop))
    ).first()
    mean = np.array([moments[f"avg_{i}"] for i in range(N_STATISTICS)])
    scale = np.array([moments[f"stddev_pop_{i}"] or 1.0 for i in range(N_STATISTICS)])
    random = np.random.default_rng(seed)
    weights = random.normal(0, 1 / length_scale, (N_STATISTICS, features))
    empty = np.zeros(1)
    model = QualityModel(mean, scale, weights, random.uniform(0, 2 * np.pi, features), empty, empty, empty)

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            z = model.features(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS))
            gram += z.T @ z
            moment += z.T @ batch.column("y").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_pydict({"gram": [gram.tobytes()], "moment": [moment.tobytes()]})

    parts = labelled.where("fold <> 0").select("x", F.col("y").cast("double")).mapInArrow(normal_equations, "gram binary, moment binary").collect()
    gram = sum(np.frombuffer(p["gram"]).reshape(features + 1, -1) for p in parts)
    moment = sum(np.frombuffer(p["moment"]) for p in parts)
    ridge = np.linalg.solve(gram + penalty * max(1.0, gram[-1, -1] / features) * np.eye(features + 1), moment)
    held = QualityModel(mean, scale, weights, model.phases, ridge, np.array([-1e9, 1e9]), np.array([-1e9, 1e9]))
    rows = labelled.where("fold = 0").select(held.column("x").alias("s"), F.col("y").cast("double").alias("y")).toArrow()
    s, y = (rows.column(c).to_numpy() for c in ("s", "y"))
    if not len(s):
        return _constant(float(seen["level"]))
    steps, levels = isotonic(s, y)
    return QualityModel(mean, scale, weights, model.phases, ridge, steps, levels)


def usable_labels(labels: DataFrame, *, id_col: str, label_col: str) -> DataFrame:
    """(__id, y, fold) of the labels that may train: no nulls, crc32(id) mod 5 not 0."""
    known = own_columns(labels, __id=id_col, y=label_col).where(F.col("__id").isNotNull() & F.col("y").isNotNull())
    fold = remainder("__id", 5)
    return known.select("__id", F.col("y").cast("int").alias("y"), (fold != 4).cast("int").alias("fold")).where(fold != 0)


def training_rows(measured: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Staged (x, y, fold) of the labelled rows.  measured: id_col and x."""
    known = usable_labels(labels, id_col=id_col, label_col=label_col)
    return stage_table(measured.join(known, F.col(f"`{id_col}`") == F.col("__id")).select("x", "y", "fold"), "fit")


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.  held_out: crc32(id) mod 5 is 0 (false for null)."""
    measured = stage_table(own_columns(docs, id=id_col, text=text_col).select("id", statistics("text").alias("x")), "statistics")
    model = fit(training_rows(measured, labels.select(F.col(f"`{id_col}`").alias("id"), f"`{label_col}`"), id_col="id", label_col=label_col))
    scored = measured.select("id", model.column("x").alias("score"))
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(remainder("id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def keep_predicted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with their columns, whose score is at least ``cut``; scored in place, without a join.

    Only rows with a usable label, of which a hash of the id leaves about MAX_FIT_ROWS, are measured to train.
    """
    known = stage_table(usable_labels(labels, id_col=id_col, label_col=label_col), "labels")
    n = known.count()
    if n > MAX_FIT_ROWS:
        known = known.where(F.pmod(F.xxhash64("__id", F.lit(17)), F.lit(1_000_000)) < int(1e6 * MAX_FIT_ROWS / n))
    texts = own_columns(docs, id=id_col, text=text_col).join(broadcast_if_small(known, 2 * MAX_FIT_ROWS), F.col("id") == F.col("__id"))
    model = fit(stage_table(texts.select(statistics("text").alias("x"), "y", "fold"), "fit"))
    return docs.where(model.text_column(F.col(f"`{text_col}`")) >= cut)
