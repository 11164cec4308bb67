"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are a text's words and their first and last five letters (inflected and compound forms share them). From a
sample of labelled rows (about ``SAMPLE`` at most, drawn on the labels' side by a hash of the id, so that only those few
rows' texts travel) Spark counts the documents of each class that hold a term. Up to ``EXAMPLES`` examples of each class
are indexed with all their terms, in blocks of ``BLOCK``; for each term and block the index knows the largest weight. A
term weighs its idf, the more the better it tells the classes apart (the root of chi-square a row, plus ``BASE``); none
is left out, and a text's terms that no example holds count for its length, with the idf of a term held by one document.

Texts are looked up by the batch. Terms that few examples hold have lists of postings, which are added up first. Terms
that more hold (``DENSE``) have their postings laid out as rows of a matrix, block by block, with the block maxima beside
it: these and what the lists gave bound what any example of a block can reach. The most promising blocks are added up,
by matrix products, and then only those that could still hold one of the ``NEAREST`` best; so results are those of a
full search. Neighbours vote with weights that grow with
their cosine; the share of toxic votes, with classes weighed as in the sample, is calibrated by isotonic regression on
rows outside the index. Evidence is the neighbours' ids and cosines.

The index has a bounded number of examples and goes to each task with the code, packed (what can be worked out from
counts is worked out there); texts are scored whole, in Arrow batches.

Defined cases: null and empty texts, and texts without any term of the examples, have no neighbours and get the
calibrated score of no votes; labels that are null or without a document are not used; without usable labels the
score is 0; ties between neighbours go to the example that stands first; repeated rows each get their row; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import fitting
from lorekeep.llm.common import fold, materialise, read_table, ship_package
from lorekeep.llm.quality import learnable_labels

SAMPLE = 20_000
EXAMPLES = 2048
BLOCK = 32
#: Blocks that are added up before any is ruled out.
FIRST_BLOCKS = 8
NEAREST = 15
#: A term that more than this share of the examples hold is a row of the matrix.
DENSE = 1 / 32
#: What a term that doesn't tell the classes apart weighs, as a share of its idf; one that tells them wholly weighs 1 more.
BASE = 0.02
FLAG = 0.3
BATCH = 64
WORDS_KEPT = 300_000
_SLACK = 1e-5  # for single precision

_WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> tuple[str, ...]:
    return (word, f"{word[:5]}-", f"-{word[-5:]}") if len(word) > 5 else (word,)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo, lo + 1, ... of ranges of n each, one range after the other."""
    n = n.astype(np.int32)
    return np.repeat(lo.astype(np.int32) - np.cumsum(n, dtype=np.int32) + n, n) + np.arange(n.sum(), dtype=np.int32)


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    return x.dtype.str, zlib.compress(x.tobytes(), 6)


def _unpacked(p: tuple[str, bytes]) -> np.ndarray:
    return np.frombuffer(zlib.decompress(p[1]), p[0])


class Terms:
    """Numbers for terms: the examples' own first, then those of texts as they come (forgotten now and then)."""

    def __init__(self, own: list[str]):
        self.own = {t: k for k, t in enumerate(own)}
        self._forget()

    def _forget(self):
        self.ids = dict(self.own)
        self.words: dict[str, int] = {}
        self.table = np.full((1024, 3), -1, np.int32)

    def _number(self, word: str) -> int:
        k = self.words[word] = len(self.words)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        for j, t in enumerate(word_terms(word)):
            self.table[k, j] = self.ids.setdefault(t, len(self.ids))
        return k

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count), sorted, of all terms of the texts."""
        if len(self.words) > WORDS_KEPT:
            self._forget()
        known, numbers, times, sizes = self.words, [], [], []
        for t in texts:
            seen = Counter(_WORD.findall(t.lower()))
            numbers += [known[w] if w in known else self._number(w) for w in seen]
            times += seen.values()
            sizes.append(len(seen))
        own = self.table[np.array(numbers, np.int64)]
        key = (np.repeat(np.arange(len(texts), dtype=np.int64), sizes)[:, None] << 32) | own
        n = np.broadcast_to(np.array(times, np.int64)[:, None], own.shape)
        on = own >= 0
        key, back = np.unique(key[on], return_inverse=True)
        return key >> 32, key & 0xFFFFFFFF, np.bincount(back, weights=n[on], minlength=len(key))


class Index:
    """Examples as an inverted index with block maxima, their labels, and the calibration.

    ``terms``: in order; ``holders``, ``tf``: of each posting, by term and example; ``starts``: of each term's postings;
    ``idf``: with the term's weight, last that of terms which no example holds.
    """

    def __init__(self, terms: list[str], idf, starts, holders, tf, toxic, ids, votes):
        self.words, self.idf, self.starts, self.holders, self.tf = terms, idf, starts, holders, tf
        self.toxic, self.ids, self.votes = toxic, ids, votes
        self.points = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.ready = False

    def __getstate__(self):
        arrays = {k: _packed(getattr(self, k)) for k in ("idf", "starts", "holders", "tf", "toxic", "ids", "votes")}
        return arrays | {"words": zlib.compress("\n".join(self.words).encode(), 6), "points": self.points}

    def __setstate__(self, state):
        for k, v in state.items():
            setattr(self, k, _unpacked(v) if isinstance(v, tuple) and k != "points" else v)
        plain = zlib.decompress(self.words).decode()
        self.words = plain.split("\n") if plain else []
        self.ready = False

    def _prepare(self) -> None:
        """Weights, the matrix of frequent terms, and block maxima, from counts; where texts are looked up, not before."""
        self.ready = True
        n, sizes = len(self.toxic), np.diff(self.starts)
        self.terms = Terms(self.words)
        self.blocks = max(1, -(-n // BLOCK))
        term, who = np.repeat(np.arange(len(sizes)), sizes), self.holders.astype(np.int64)
        w = (1 + np.log(np.maximum(self.tf, 1))) * self.idf[term]
        w = (w / np.sqrt(np.bincount(who, weights=w * w, minlength=n))[who]).astype(np.float32)
        frequent = sizes > n * DENSE
        self.row = np.full(len(sizes) + 1, -1, np.int32)  # in the matrix; the last is never looked up
        self.row[:-1][frequent] = np.arange(frequent.sum())
        self.matrix = np.zeros((self.blocks, int(frequent.sum()), BLOCK), np.float32)
        on = frequent[term]
        self.matrix[who[on] // BLOCK, self.row[term[on]], who[on] % BLOCK] = w[on]
        self.matrix_max = np.ascontiguousarray(self.matrix.max(2, initial=0).T)
        self.list_who, self.list_weight = who[~on].astype(np.int32), w[~on]
        self.list_start = np.searchsorted(term[~on], np.arange(len(sizes) + 1)).astype(np.int32)

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) of the terms that examples hold; each text's whole vector has length one."""
        if not self.ready:
            self._prepare()
        who, term, n = self.terms.counts(texts)
        own = term < len(self.words)
        x = (1 + np.log(n)) * self.idf[np.where(own, term, -1)]
        length = np.sqrt(np.bincount(who, weights=x * x, minlength=len(texts)))
        return who[own], term[own], x[own] / np.maximum(length[who[own]], 1e-300)

    def _add(self, out: np.ndarray, todo: np.ndarray, dense: np.ndarray) -> None:
        """Adds to ``out`` (text, block, example) the products with the matrix of the (text, block) pairs that are marked."""
        for b in np.flatnonzero(todo.any(0)).tolist():
            of = np.flatnonzero(todo[:, b])
            out[of, b] += dense[of] @ self.matrix[b]

    def cosines(self, texts: list[str], prune: bool = True) -> np.ndarray:
        """(text, example): exact cosines with all examples that could be among a text's nearest, less than that with
        others; unless ``prune``, exact ones with all."""
        who, term, x = self.vectors(texts)
        x = x.astype(np.float32)
        frequent = self.row[term] >= 0
        dense = np.zeros((len(texts), self.matrix.shape[1]), np.float32)
        dense[who[frequent], self.row[term[frequent]]] = x[frequent]
        who, term, x = who[~frequent].astype(np.int32), term[~frequent], x[~frequent]
        n = self.list_start[term + 1] - self.list_start[term]
        at = _ranges(self.list_start[term], n)
        width = self.blocks * BLOCK
        to = np.repeat(who * np.int32(width), n) + self.list_who[at]
        lists = np.bincount(to, weights=self.list_weight[at] * np.repeat(x, n), minlength=len(texts) * width)
        out = lists.astype(np.float32).reshape(len(texts), self.blocks, BLOCK)
        if not prune:
            self._add(out, np.ones(out.shape[:2], bool), dense)
            return out.reshape(len(texts), width)
        bound = out.max(2) + dense @ self.matrix_max
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argpartition(-bound, min(FIRST_BLOCKS, self.blocks) - 1, axis=1)[:, :FIRST_BLOCKS], True, 1)
        self._add(out, first, dense)
        k = min(NEAREST, width)
        seen = np.where(first[:, :, None], out, 0).reshape(len(texts), width)
        least = np.partition(seen, width - k, axis=1)[:, width - k]
        self._add(out, (bound >= least[:, None] - _SLACK) & (bound > 0) & ~first, dense)
        return out.reshape(len(texts), width)

    def nearest(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the nearest examples and their cosines, best first, those that share no term left out."""
        none = np.array([], np.int64), np.array([])
        if not len(self.toxic):
            yield from [none] * len(texts)
            return
        for at in range(0, len(texts), BATCH):
            for cos in self.cosines(texts[at : at + BATCH]):
                k = min(NEAREST, len(cos))
                near = np.flatnonzero(cos >= max(np.partition(cos, len(cos) - k)[len(cos) - k], 1e-9))
                best = near[np.argsort(-cos[near], kind="stable")[:k]]
                yield best, cos[best].astype(np.float64)

    def raw(self, texts: list[str]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        out = []
        for best, cos in self.nearest(texts):
            if len(best):
                w = self.votes[best] / (1.05 - np.minimum(cos, 1.0))
                out.append((float((w * self.toxic[best]).sum() / w.sum() * cos.mean()), best, cos))  # votes from afar count for less
            else:
                out.append((0.0, best, cos))
        return out


def _index(examples: DataFrame, rows: DataFrame) -> Index:
    """The index over a written table (doc_id, text, label) of a bounded number of examples; document counts by class
    are those of ``rows`` (text, label), summed by task first."""

    @F.pandas_udf("words array<string>, times array<int>")
    def counted(texts: pd.Series) -> pd.DataFrame:
        got = [Counter(_WORD.findall(t.lower())) for t in texts]
        return pd.DataFrame({"words": [list(g) for g in got], "times": [list(g.values()) for g in got]})

    got = examples.withColumn("c", counted("text")).select("doc_id", "label", "c.words", "c.times").toArrow().sort_by([("label", "ascending"), ("doc_id", "ascending")])
    ids, label = (np.array(got.column(c).to_pylist(), np.int64) for c in ("doc_id", "label"))
    counts = [dict(zip(w, n, strict=True)) for w, n in zip(got.column("words").to_pylist(), got.column("times").to_pylist(), strict=True)]
    terms = sorted({t for c in counts for w in c for t in word_terms(w)})
    number = {t: k for k, t in enumerate(terms)}
    packed = zlib.compress("\n".join(terms).encode(), 6)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {t: k for k, t in enumerate(zlib.decompress(packed).decode().split("\n"))}
        n = np.zeros((2, len(own)), np.int64)
        for batch in batches:
            for text, y in zip(batch["text"], batch["label"], strict=True):
                held = {k for w in set(_WORD.findall(text.lower())) for t in word_terms(w) if (k := own.get(t)) is not None}
                n[y, np.fromiter(held, np.int64, len(held))] += 1
        at = np.flatnonzero(n.any(0))
        yield pd.DataFrame({"term": at, "b": n[0, at], "a": n[1, at]})

    a, b = np.zeros(len(terms)), np.zeros(len(terms))
    if terms:
        added = rows.select("text", "label").coalesce(8).mapInPandas(sums, "term int, b int, a int").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
        at = added.column("term").to_numpy()
        a[at], b[at] = added.column("a").to_numpy(), added.column("b").to_numpy()
    n1, n0 = (float(rows.where(F.col("label") == y).count()) for y in (1, 0))
    total = n1 + n0
    phi = np.abs(a * (n0 - b) - b * (n1 - a)) / np.sqrt(n1 * n0 * np.maximum(a + b, 1) * (total - a - b + 0.5))
    idf = np.append(np.log((total + 1) / np.maximum(a + b, 1)) * (BASE + phi), np.log(total + 1) * BASE)
    # examples that share their heaviest term stand together, which keeps block maxima tight
    held = []
    for c in counts:
        tf: Counter = Counter()
        for w, n in c.items():
            for t in word_terms(w):
                tf[number[t]] += n
        held.append((np.fromiter(tf.keys(), np.int32, len(tf)), np.fromiter(tf.values(), np.int32, len(tf))))
    del got, counts, number
    heaviest = np.array([k[np.argmax((1 + np.log(n)) * idf[k])] for k, n in held], np.int64)
    order = np.lexsort((ids, heaviest, label))
    sizes = np.array([len(held[i][0]) for i in order], np.int64)
    term, tf = (np.concatenate([held[i][k] for i in order]) for k in (0, 1))
    who = np.repeat(np.arange(len(order)), sizes)
    by = np.lexsort((who, term))
    starts = np.searchsorted(term[by], np.arange(len(terms) + 1)).astype(np.int32)
    toxic = label[order].astype(np.float64)
    per, share = {k: max(1, int((toxic == k).sum())) for k in (0, 1)}, {1: n1 / total, 0: n0 / total}
    votes = np.array([share[int(y)] / per[int(y)] for y in toxic]) * len(ids)
    return Index(terms, idf, starts, who[by].astype(np.uint16), tf[by].astype(np.uint32), toxic, ids[order], votes)


def fit(docs: DataFrame, labels: DataFrame) -> Index | None:
    """An index from documents (doc_id, text) and labels (label_id, label), see ``learnable_labels``; None where nothing
    can be learned."""
    ship_package(docs.sparkSession)
    own = labels.select("label_id", (F.col("label") > 0).cast("int").alias("label"))
    own = F.broadcast(fitting.bounded_sample(own, "label_id", SAMPLE))
    salted = lambda salt: F.xxhash64(F.col("doc_id").cast("string"), F.lit(salt))
    rows = docs.join(own, F.col("doc_id") == F.col("label_id")).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), "label", F.pmod(salted("part"), F.lit(8)).alias("part"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"), F.monotonically_increasing_id().alias("row")
    )
    rows = materialise(rows)
    # copies would make chance terms look telling: of equal texts with one label, one row stays; at most one for each label
    once = rows.groupBy("same", "label").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
    rows = materialise(rows.join(F.broadcast(once), "row").select("doc_id", "text", "label", "part"))
    learned = rows.where("part > 0")
    told = learned.where(F.col("text").rlike(r"\p{L}"))
    picked = [told.where(F.col("label") == y).select("doc_id", "label", salted("example").alias("chance")).orderBy("chance", "doc_id").limit(EXAMPLES) for y in (1, 0)]
    if any(learned.where(F.col("label") == y).isEmpty() for y in (0, 1)):
        return None
    chosen = picked[0].unionByName(picked[1]).select("doc_id", "label")
    index = _index(told.join(F.broadcast(chosen), ["doc_id", "label"]).select("doc_id", "text", "label"), learned)
    tested = score_with(rows.where("part = 0"), index, raw=True)
    index.points = fitting.isotonic(*fitting.binned(tested, "score", "label"))
    return index


def score_with(docs: DataFrame, index: Index, raw: bool = False) -> DataFrame:
    """``docs`` with score, evidence (ids of the nearest examples) and cosines (columns of these names are replaced)."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("score double, evidence array<long>, cosines array<double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        got = index.raw(texts.tolist())
        scores = np.array([g[0] for g in got])
        return pd.DataFrame({"score": scores if raw else fitting.calibrated(scores, index.points), "evidence": [index.ids[g[1]] for g in got], "cosines": [g[2] for g in got]})

    return docs.withColumn("__tx", of(F.coalesce(F.col("text"), F.lit("")))).select(*[c for c in docs.columns if c not in ("score", "evidence", "cosines")], "__tx.*")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for each document."""
    docs = docs.select("doc_id", "text")
    index = fit(docs, learnable_labels(labels, "toxic"))
    held_out = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    if index is None:
        return docs.select("doc_id", held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast("array<bigint>").alias("evidence"))
    return score_with(docs, index).select("doc_id", held_out, "score", (F.col("score") >= FLAG).cast("int").alias("predicted"), "evidence")


def op9_toxicity(spark, sf_dir):
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
