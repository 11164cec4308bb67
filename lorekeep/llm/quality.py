"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Each whole text gives 32 statistics (lengths, character classes, repetition, entropy). Standardised, they pass through
``FEATURES`` random cosines, which approximate a Gaussian kernel. Partitions sum the normal equations over a sample of
labelled rows (``SAMPLE`` at most, drawn by a hash of the id); the driver solves one small ridge system. A fifth of the
sample stays out of the fit and calibrates the scores by isotonic regression over at most 2,000 bins.

Statistics are computed in Arrow batches, in one pass; scores read them. Model and sums have a fixed size.

Defined cases: null and empty texts have all-zero statistics and get a score like any other; labels that are null or
without a document are not used, several labels of one document are averaged; without any usable label the score is
0.5 and ``keep_good`` keeps every document; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import fitting
from lorekeep.llm.common import fold, materialise, read_table, ship_package

FEATURES = 384
SAMPLE = 20_000
STRENGTH = 0.1
WIDTH = 4.0  # of the kernel, over standardised statistics
ACCEPT = 0.7

_CLASS = np.zeros(256, np.int64)  # of a UTF-8 byte
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t", ".", ",", "!?", ";:'\"()-", "#$%&*@^~+=_", "|<>{}[]\\/`"), 1):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = 12
N_STATISTICS = 32


def statistics(text: str) -> np.ndarray:
    """A whole text's statistics; zeros for an empty one."""
    out = np.zeros(N_STATISTICS)
    if not text:
        return out
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=counts, minlength=13) / len(data)
    out[:13] = share
    p = counts[counts > 0] / len(data)
    out[13] = -(p * np.log2(p)).sum()
    out[14] = np.log1p(len(data))
    # one chunk after the other, so that the ratio means the same at any length
    out[15] = sum(len(zlib.compress(data[i : i + 32768], 1)) for i in range(0, len(data), 32768)) / len(data)
    words = text.split()
    if words:
        n = len(words)
        seen = Counter(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        top = [c for _, c in seen.most_common(3)]
        out[16] = np.log1p(n)
        out[17], out[18] = lengths.mean(), min(lengths.std(), 50)
        out[19] = len(seen) / n
        out[20], out[21] = top[0] / n, sum(top) / n
        out[22] = sum(map(str.__eq__, words, words[1:])) / n
        out[23] = (lengths <= 3).mean()
        out[24] = (lengths >= 15).mean()
        out[25] = sum(map(str.isupper, words)) / n
        out[26] = sum(map(str.istitle, words)) / n
        out[27] = sum(map(str.isalpha, words)) / n
        out[28] = len(set(zip(words, words[1:]))) / n
        out[29] = len(seen) / np.sqrt(n)
    lines = [x for x in text.split("\n") if x]
    if lines:
        out[30] = len(set(lines)) / len(lines)
        out[31] = np.log1p(len(text) / len(lines))
    return out


def with_statistics(docs: DataFrame, text_col: str = "text", to: str = "features") -> DataFrame:
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.withColumn(to, of(F.coalesce(F.col(text_col), F.lit(""))))


@dataclass
class Model:
    """Standardisation, cosines, ridge weights and calibration points; of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    points: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    def basis(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(20)
        w = rng.normal(0, 1 / WIDTH, (x.shape[1], FEATURES))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        return np.sqrt(2 / FEATURES) * np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ w + b)

    def raw(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.column_stack([self.basis(x), np.ones(len(x))]) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return fitting.calibrated(self.raw(x), self.points) if self.weights is not None else np.full(len(x), 0.5)


def _scored(rows: DataFrame, how, to: str) -> DataFrame:
    @F.pandas_udf("double")
    def of(features: pd.Series) -> pd.Series:
        return pd.Series(how(np.stack(features.to_numpy())) if len(features) else [])

    return rows.withColumn(to, of("features"))


def fit(labelled: DataFrame) -> Model:
    """A model from a bounded number of rows (doc_id, features, label)."""
    rows = materialise(labelled.where("label is not null").withColumn("part", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(5))))
    stats = rows.agg(*[f(F.get("features", F.lit(k))).alias(f"{n}{k}") for k in range(N_STATISTICS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, scale = (np.array([stats[f"{n}{k}"] or 0.0 for k in range(N_STATISTICS)]) for n in "ms")
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))
    if rows.isEmpty():
        return model
    model.weights = fitting.ridge(*fitting.normal_equations(rows.where("part > 0"), model.basis, FEATURES, ["label"]), STRENGTH)[:, 0]
    model.points = fitting.isotonic(*fitting.binned(_scored(rows.where("part = 0"), model.raw, "raw"), "raw", "label"))
    return model


def learnable_labels(labels: DataFrame, label_col: str) -> DataFrame:
    """(label_id, label) of the three folds that may be learned from; several labels of one document are averaged."""
    own = labels.select(F.col("doc_id").alias("label_id"), F.col(label_col).cast("double").alias("label"))
    own = own.where("label is not null and label_id is not null").where(fold(F.col("label_id"), 4) != 2)
    return own.groupBy("label_id").agg(F.avg("label").alias("label"))


def training_rows(features: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """A bounded sample of rows that may be learned from, with their label. It is drawn among the labels (about ``SAMPLE``
    of them at most), whose few ids then go to the rows, so that no row travels."""
    own = fitting.bounded_sample(learnable_labels(labels, label_col), "label_id", SAMPLE)
    return features.join(F.broadcast(own), F.col("doc_id") == F.col("label_id")).drop("label_id")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    rows = materialise(with_statistics(docs.select("doc_id", "text")).drop("text"))
    model = fit(training_rows(rows, labels, "quality"))
    scored = _scored(rows, model.score, "score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts; columns stay as they are. Texts stay where they are: the model is
    fitted first, on the labelled rows alone, and then scores each text in passing."""
    model = fit(with_statistics(training_rows(docs.select("doc_id", "text"), labels, "quality")).drop("text"))
    if model.weights is None:
        return docs

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([statistics(t) for t in texts])) >= ACCEPT if len(texts) else [], dtype=bool)

    ship_package(docs.sparkSession)
    return docs.where(good(F.coalesce(F.col("text"), F.lit(""))))


def op1_quality(spark, sf_dir):
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
