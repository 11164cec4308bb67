"""Language identification by string kernels.

The kernel counts the character n-grams (one to four, as 64-bit hashes, so in effect the n-grams themselves) that two
texts have in common, each once (blended-spectrum presence), normalised by both texts' own counts. ``LANDMARKS`` texts,
as many of each language as there are, give Nyström features; one-versus-rest ridge regression over them is fitted from
normal equations that partitions sum over a stratified sample: about ``SAMPLE`` rows at most, as many of each language,
and all of a rare one. Texts are scored in batches by products of their sparse rows of n-grams with the landmarks'.

What the driver holds (landmarks, sums, weights) grows with the number of languages alone. Whole texts are read.

Defined cases: a null text, and one without letters, is ``und`` with score 0; so is every text where nothing can be
learned; null languages are not learned from; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm import fitting
from lorekeep.llm.common import fold, materialise, read_table, ship_package

LANDMARKS = 128
SAMPLE = 8_000
#: Rows of a language that are always taken, however many languages there are.
LEAST_OF_EACH = 50
STRENGTH = 0.01
#: N-grams of texts that are multiplied with the landmarks at once.
BATCH = 100_000
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters[codes]


def ngrams(text: str) -> np.ndarray | None:
    """The text's distinct n-grams, hashed; None if it has no letters. What isn't a letter counts as a space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _is_letter(codes)
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    codes = np.r_[np.uint32(32), codes[letter | np.r_[False, letter[:-1]]], np.uint32(32)].astype(np.uint64)  # one space for each gap
    grams, hashed = [], np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        if len(codes) < n:
            break
        hashed = hashed[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(1)
        grams.append(hashed ^ hashed >> np.uint64(29))
    return np.unique(np.concatenate(grams))


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # those of any landmark, in order
    held: np.ndarray  # (n-gram, landmark): 1 where the landmark has it
    sizes: np.ndarray  # n-grams of each landmark
    whiten: np.ndarray  # K_mm to the power -1/2
    weights: np.ndarray | None = None

    @classmethod
    def over(cls, languages: list[str], landmarks: list[np.ndarray]) -> Model:
        grams = np.unique(np.concatenate(landmarks)) if landmarks else np.array([], np.uint64)
        held = np.zeros((len(grams), len(landmarks)), np.uint8)
        for k, own in enumerate(landmarks):
            held[np.searchsorted(grams, own), k] = 1
        model = cls(languages, grams, held, np.array([len(x) for x in landmarks], np.float64), np.eye(len(landmarks)))
        if landmarks:
            values, vectors = np.linalg.eigh(model.kernel(landmarks))
            model.whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        return model

    def kernel(self, rows: list[np.ndarray]) -> np.ndarray:
        """Kernel of each row of n-grams with each landmark: a sparse row of ones times ``held``, over the norms."""
        out = np.zeros((len(rows), len(self.sizes)))
        sizes = np.array([len(r) for r in rows], np.int64)
        first = 0
        while first < len(rows):
            last = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), BATCH, "right")) + first)
            every = np.concatenate(rows[first:last])
            at = np.minimum(np.searchsorted(self.grams, every), len(self.grams) - 1)
            on = self.grams[at] == every
            of = np.repeat(np.arange(last - first), sizes[first:last])[on]
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            if len(begin):
                out[first + of[begin]] = np.add.reduceat(self.held[at[on]], begin, axis=0, dtype=np.int32)
            first = last
        return out / np.sqrt(np.maximum(sizes, 1))[:, None] / np.sqrt(np.maximum(self.sizes, 1))

    def features(self, rows: list[np.ndarray]) -> np.ndarray:
        """Nyström features."""
        return self.kernel(rows) @ self.whiten

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.weights is None:
            return langs, scores
        for at in range(0, len(texts), 64):
            got = [(i, g) for i, t in enumerate(texts[at : at + 64], at) if (g := ngrams(t)) is not None]
            if got:
                z = self.features([g for _, g in got])
                out = np.column_stack([z, np.ones(len(z))]) @ self.weights
                soft = np.exp(6 * (out - out.max(1, keepdims=True)))
                soft /= soft.sum(1, keepdims=True)
                for (i, _), k, s in zip(got, out.argmax(1).tolist(), soft.max(1).tolist(), strict=True):
                    langs[i], scores[i] = self.languages[k], s
        return langs, scores


def stratified(rows: DataFrame) -> DataFrame:
    """About ``SAMPLE`` of the rows at most, chosen by a hash of the id: of each language as many, all where there are fewer."""
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    each = max(LEAST_OF_EACH, SAMPLE // max(1, counts.count()))
    share = F.least(F.lit(1.0), each / F.col("n"))
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(F.broadcast(counts), "lang").where(chance < share).drop("n")  # a row for each language


def fit(rows: DataFrame) -> Model:
    """A model from rows (doc_id, text, lang); a stratified sample of those with a language is used."""
    ship_package(rows.sparkSession)
    texts = F.coalesce("text", F.lit(""))
    sample = materialise(stratified(rows.where("lang is not null").where(texts.rlike(r"\p{L}")).select("doc_id", "lang", texts.alias("text"))))
    languages = [r["lang"] for r in sample.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return Model.over([], [])
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("landmark")), "doc_id")
    each = max(1, LANDMARKS // len(languages))
    picked = sample.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each).select("lang", "nth", "text").orderBy("lang", "nth").collect()
    model = Model.over(languages, [g for r in picked if (g := ngrams(r["text"])) is not None])

    @F.pandas_udf("array<double>")
    def nystrom(texts: pd.Series) -> pd.Series:
        none = np.array([], np.uint64)
        return pd.Series(list(model.features([none if (g := ngrams(t)) is None else g for t in texts]))) if len(texts) else texts

    targets = [f"is{k}" for k in range(len(languages))]
    ready = sample.select(nystrom("text").alias("features"), *[F.when(F.col("lang") == lang, 1.0).otherwise(0.0).alias(t) for t, lang in zip(targets, languages, strict=True)])
    model.weights = fitting.ridge(*fitting.normal_equations(ready, lambda x: x, len(model.sizes), targets), STRENGTH)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced)."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        langs, scores = model.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn("__li", of(F.coalesce(F.col("text"), F.lit("")))).select(*[c for c in docs.columns if c not in ("lang_pred", "score")], "__li.lang_pred", "__li.score")


def op2_language(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
