"""What the fitted operators share: bounded samples, normal equations summed by partition, isotonic calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 30


def bounded_sample(rows: DataFrame, id_col: str, bound: int) -> DataFrame:
    """About ``bound`` of the rows at most, chosen by a hash of the id alone, so equally from everywhere."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(_RANGE)) < int(_RANGE * bound / n))


def normal_equations(rows: DataFrame, basis: Callable[[np.ndarray], np.ndarray], n_basis: int, targets: list[str], partitions: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'Y over a bounded table (``features``, targets...), Z the basis of its features with a constant.

    Each partition sends its sums as one row for each basis function; Spark adds them up. Only sums reach the driver.
    """
    width = n_basis + 1 + len(targets)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_basis + 1, width))
        for batch in batches:
            if len(batch):
                z = np.column_stack([basis(np.stack(batch["features"].to_numpy()).astype(np.float64)), np.ones(len(batch))])
                total += z.T @ np.column_stack([z, batch[targets].to_numpy(np.float64)])
        yield pd.DataFrame({"i": np.arange(n_basis + 1), "sums": list(total)})

    part = rows.repartition(partitions).mapInPandas(sums, "i int, sums array<double>")
    added = part.groupBy("i").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)]) if width <= 64 else None
    if added is None:
        added = part.select("i", F.posexplode("sums").alias("k", "s")).groupBy("i", "k").agg(F.sum("s").alias("s")).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("sums"))
        table = np.array([r["sums"] for r in added.orderBy("i").collect()])
    else:
        table = np.array([[r[f"s{k}"] for k in range(width)] for r in added.orderBy("i").collect()])
    return table[:, : n_basis + 1], table[:, n_basis + 1 :]


def ridge(ztz: np.ndarray, zty: np.ndarray, strength: float) -> np.ndarray:
    """Ridge weights; the constant (last) is not penalised."""
    penalty = np.full(len(ztz), strength)
    penalty[-1] = 1e-9
    return np.linalg.solve(ztz + np.diag(penalty), zty)


def isotonic(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: increasing points (score, probability) to interpolate between."""
    if not len(scores):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    by = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of labels, sum of scores
    for s, y, w in zip(scores[by], labels[by], weights[by], strict=True):
        blocks.append([w, y * w, s * w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    x = np.array([b[2] / b[0] for b in blocks])
    # a quarter of a case of the other label keeps a block of one label away from 0 and 1
    p = np.array([min(max(b[1] / b[0], 0.25 / (b[0] + 0.5)), (b[0] + 0.25) / (b[0] + 0.5)) for b in blocks])
    return x, np.maximum.accumulate(p)


def calibrated(raw: np.ndarray, points: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probabilities: between the points in proportion, with a hundredth by rank so that equals stay ordered."""
    x, p = points
    return np.clip(0.99 * np.interp(raw, x, p) + 0.01 / (1 + np.exp(-4 * (np.clip(raw, -10, 10) - 0.5))), 0.0, 1.0)


def binned(rows: DataFrame, raw: str, label: str, bins: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean score, mean label and count by bins of the score: at most ``bins`` rows, whatever the table's size."""
    at = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col(raw))) * (bins / 3)).alias("bin")
    got = rows.groupBy(at).agg(F.avg(raw).alias("s"), F.avg(label).alias("y"), F.count(F.lit(1)).alias("n")).collect()
    return tuple(np.array([r[k] for r in got], dtype=np.float64) for k in ("s", "y", "n"))
