"""Vector code compression: product codes whose nearest entries are found by vantage-point trees.

Vectors become integers (``floor(256 * x)``) and are cut into ``PARTS`` equal parts. Each part position has a codebook of
at most ``ENTRIES`` entries, seeded by the vectors of the smallest ids and refined ``ROUNDS`` times: every part goes to its
nearest entry (squared Euclidean distance, ties to the lower index), every entry becomes the floor of its parts' mean.

The nearest entry comes from one vantage-point tree a part position. A node holds an entry, the radius that halves the
entries below it, and the least and greatest distance of either half. A batch of parts goes down the tree together: those
within the radius visit the inner half first and the outer one with what is left, the others the other way round. Distances
to entries are compared as integers. The floating-point square roots serve pruning alone and are rounded outwards, and a
half is visited when it could hold an entry *as near* as the best one, so ties reach the lower index and results are exact.

Vectors never leave their task: a task sends the sums and counts of its parts by (part, entry), which Spark adds up; the
driver sees one codebook (``PARTS * ENTRIES`` entries), whatever the table's size. Error sums by label are partial sums, too;
labels that hold over a thousandth of all rows are broadcast back (``join_split``), others are joined by their key.

Defined cases: rows whose vector is null or holds a null, NaN or infinite component are dropped; a null id counts as the
largest one; of rows that share an id the smallest vector seeds, all are coded; with fewer than ``ENTRIES`` ids codebooks
are smaller; vectors are padded with zeros to the longest one's length, rounded up to a multiple of ``PARTS`` (empty ones
alone give parts of no components, all at distance 0 of entry 0); components beyond ``_most`` (2^26 for vectors of up to 128)
count as that, so that no squared distance leaves 64 bits; a sum of errors that would is null; no rows give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import join_split, materialise, read_table, ship_package

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Entries that a leaf of a tree compares at once.
LEAF = 4
#: Outward rounding of distances, far above the error of a 64-bit number's square root.
_SLACK = 1e-9


# -- trees ------------------------------------------------------------------------------------------------------------


@dataclass
class Node:
    """Entries (``at``: one vantage entry, or those of a leaf) and, but for leaves, the two halves around the vantage
    entry with the least and the greatest distance from it, rounded outwards."""

    at: np.ndarray
    radius: float = 0.0
    halves: tuple[tuple[Node, float, float], ...] = ()


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("...k,...k->...", gap, gap)


def build_tree(entries: np.ndarray, at: np.ndarray | None = None) -> Node:
    """A vantage-point tree over integer entries; the vantage entry is the one farthest from the others' first."""
    at = np.arange(len(entries)) if at is None else at
    if len(at) <= LEAF:
        return Node(at)
    vantage = at[np.argmax(_squared(entries[at], entries[at[0]]))]
    rest = at[at != vantage]
    gaps = _squared(entries[rest], entries[vantage])
    order = np.argsort(gaps, kind="stable")
    rest, away = rest[order], np.sqrt(gaps[order].astype(np.float64))
    half = len(rest) // 2
    halves = tuple((build_tree(entries, rest[s]), away[s][0] * (1 - _SLACK), away[s][-1] * (1 + _SLACK)) for s in (slice(0, half), slice(half, None)))
    return Node(np.array([vantage]), float(away[half]), halves)


def nearest(tree: Node, entries: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part its nearest entry (the lower index of equally near ones) and the squared distance to it."""
    best = np.full(len(parts), np.iinfo(np.int64).max)
    code = np.zeros(len(parts), np.int64)

    def offer(rows: np.ndarray, entry: int, gap: np.ndarray) -> None:
        better = (gap < best[rows]) | ((gap == best[rows]) & (entry < code[rows]))
        best[rows[better]], code[rows[better]] = gap[better], entry

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        asked = parts[rows]
        gap = None
        for entry in node.at:
            gap = _squared(asked, entries[entry])
            offer(rows, entry, gap)
        if not node.halves:
            return
        away = np.sqrt(gap.astype(np.float64))
        (inner, *ring), (outer, *beyond) = node.halves
        first = away <= node.radius
        visit(inner, rows[first])
        visit(outer, rows[~first | _may_hold(away, *beyond, best[rows])])
        late = ~first & _may_hold(away, *ring, best[rows])
        visit(inner, rows[late])

    visit(tree, np.arange(len(parts)))
    return code, best


def _may_hold(away: np.ndarray, least: float, greatest: float, best: np.ndarray) -> np.ndarray:
    """Whether entries at ``least`` to ``greatest`` from a vantage entry may be as near as ``best`` (squared) to parts
    that are ``away`` from it: by the triangle inequality, rounded so that no such entry is missed."""
    apart = np.maximum(away * (1 - _SLACK) - greatest, least - away * (1 + _SLACK))
    return apart <= np.sqrt(best.astype(np.float64)) * (1 + _SLACK)


class Coder:
    """Codebooks (parts, entries, components) with their trees."""

    def __init__(self, codebooks: np.ndarray):
        self.codebooks = codebooks
        self.trees = [build_tree(book) for book in codebooks]

    def code(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances, both (rows, parts)."""
        parts = vectors.reshape(len(vectors), len(self.codebooks), self.codebooks.shape[2])
        codes, gaps = np.empty(parts.shape[:2], np.int64), np.empty(parts.shape[:2], np.int64)
        for p, (tree, book) in enumerate(zip(self.trees, self.codebooks, strict=True)):
            codes[:, p], gaps[:, p] = nearest(tree, book, np.ascontiguousarray(parts[:, p]))
        return codes, gaps


# -- over tables ------------------------------------------------------------------------------------------------------


def _most(width: int) -> int:
    """The largest component: ``width`` squares of twice as much stay below 2^62."""
    return 1 << ((62 - max(1, width - 1).bit_length()) // 2 - 1)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): the rows that are kept, with integer components."""
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(vector_col, lambda x: F.floor(F.least(F.greatest(x.cast("double") * 256, F.lit(-(2.0**31))), F.lit(2.0**31)))).alias("v")
    )


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as (rows, width) integers, padded with zeros and bounded."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
    most = _most(width)
    np.clip(flat, -most, most, out=flat)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def seeds(rows: DataFrame, entries: int, width: int, parts: int) -> np.ndarray:
    """The first codebooks: the parts of the vectors of the smallest ids, at most ``entries`` of them."""
    ids = [r[0] for r in rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    known = [i for i in ids if i is not None]
    chosen = F.col("vec_id").isin(known) if known else F.lit(False)
    chosen = chosen | F.col("vec_id").isNull() if None in ids else chosen
    first = rows.where(chosen).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.col("vec_id").asc_nulls_last()).toArrow()
    return np.ascontiguousarray(_matrix(first["v"], width).reshape(len(ids), parts, width // parts).transpose(1, 0, 2))


def refined(rows: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: entries become the floors of the means of the parts that are nearest to them; unused ones stay."""
    n_parts, n_entries, size = codebooks.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at = Coder(codebooks), np.arange(n_parts) * n_entries
        counts, total = np.zeros(n_parts * n_entries, np.int64), np.zeros((n_parts * n_entries, size), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0), n_parts * size)
            slots = (coder.code(vectors)[0] + at).ravel()
            counts += np.bincount(slots, minlength=len(counts))
            np.add.at(total, slots, vectors.reshape(len(slots), size))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["slot", "n", "sums"])

    partial = rows.select("v").mapInArrow(sums, "slot int, n long, sums array<long>")
    counted = partial.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(size)])
    out = codebooks.reshape(n_parts * n_entries, size).copy()
    for row in counted.collect():  # at most parts x entries rows
        out[row["slot"]] = [row[f"s{k}"] // row["n"] for k in range(size)]
    return out.reshape(codebooks.shape)


def fit_codebooks(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    codebooks = seeds(rows, entries, width, parts)
    for _ in range(rounds):
        codebooks = refined(rows, codebooks)
    return codebooks


def _label_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("label_key")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """One row per kept vector (vec_id, code: array of entry indexes, error, label_error), and the codebooks as
    (parts, entries, components)."""
    ship_package(vectors.sparkSession)
    rows = materialise(quantised(vectors, id_col, vector_col, label_col))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = -(-(longest or 0) // parts) * parts
    codebooks = np.zeros((parts, 0, width // parts), np.int64) if longest is None else fit_codebooks(rows, width, parts, entries, rounds)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(codebooks)
        for batch in batches:
            codes, gaps = coder.code(_matrix(batch.column(2), width))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * parts, pa.int32()), pa.array(codes.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed, pa.array(gaps.sum(1))], ["vec_id", "label_key", "code", "error"])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    out = materialise(rows.select("vec_id", _label_key(), "v").mapInArrow(coded, f"vec_id {id_type}, label_key string, code array<int>, error long"))
    of_label = materialise(out.groupBy("label_key").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")))
    return join_split(out, of_label, "label_key", "rows", out.count()).drop("label_key"), codebooks


def reconstructed(code: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """The vectors that codes (rows, parts) stand for, in units of 1/256."""
    return codebooks[np.arange(len(codebooks)), code].reshape(len(code), -1) / 256.0


def op11_vector_codes(spark, sf_dir):
    rows, codebooks = compress(read_table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    return rows.select(
        "vec_id", F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _assigned(books: str) -> str:
    """SQL: each part with its nearest entry of ``books`` (p, j, e) and the squared distance."""
    gap = "list_sum(list_transform(range(1, len(v.x) + 1), lambda k: (v.x[k] - e[k]) * (v.x[k] - e[k])))"
    return f"SELECT row, p, arg_min(j, (gap, j)) AS j, min(gap) AS gap FROM (SELECT v.row, v.p, b.j, {gap} AS gap FROM parts v JOIN {books} b ON v.p = b.p) GROUP BY row, p"


def _round(books: str, assigned: str) -> str:
    """SQL: the codebooks after a round; a floor of the quotient of integers, whatever their signs."""
    return f"""SELECT b.p, b.j, coalesce(list(m.c ORDER BY m.k) FILTER (m.k IS NOT NULL), any_value(b.e)) AS e FROM {books} b LEFT JOIN (
    SELECT p, j, k, ((s - ((s % n) + n) % n) // n)::BIGINT AS c FROM (SELECT p, j, k, sum(x[k])::BIGINT AS s, count(*) AS n
        FROM (SELECT a.p, a.j, v.x, unnest(range(1, len(v.x) + 1)) AS k FROM {assigned} a JOIN parts v ON v.row = a.row AND v.p = a.p) GROUP BY p, j, k)
    ) m ON m.p = b.p AND m.j = b.j GROUP BY b.p, b.j"""


#: For vectors of one length, a multiple of 16, and ids without repeats (the tables' own).
ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM kept, unnest(range(0, 16)) AS t(p)),
b0 AS MATERIALIZED (SELECT p, row - 1 AS j, x AS e FROM parts WHERE row <= {ENTRIES}),
a0 AS MATERIALIZED ({_assigned("b0")}),
b1 AS MATERIALIZED ({_round("b0", "a0")}),
a1 AS MATERIALIZED ({_assigned("b1")}),
b2 AS MATERIALIZED ({_round("b1", "a1")}),
a2 AS MATERIALIZED ({_assigned("b2")}),
c AS (SELECT row, string_agg(lpad(lower(hex(j)), 2, '0'), '' ORDER BY p) AS code, sum(gap)::BIGINT AS error FROM a2 GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, j)) AS digest FROM b2)
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, h.digest AS codebooks_sha256 FROM kept k JOIN c ON c.row = k.row, h
"""
