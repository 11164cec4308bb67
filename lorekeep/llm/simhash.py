"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: 64 bits over the XXH64 hashes of a text's word shingles; those that differ in at most ``MAX_BITS`` bits
link, and documents that links connect form a component named by its smallest doc_id.

Equal fingerprints collapse first, so exact copies (however many) are one entry from there on. Two fingerprints that
differ in at most 4 bits agree in all but four of any number of blocks of bits: in one of five, two of six, three of
seven, four of eight. Entries meet in buckets for every choice of that many blocks, so that no link can be missed; the
more fingerprints there are, the longer the keys (12 to 32 bits), so buckets stay small at any size (``scheme``). Within a
bucket entries stand in Gray-code order, in which neighbours share long bit patterns. Nodes over runs of them hold the
bits that all members share (a mask and its value). Two nodes whose shared patterns differ in more than 4 bits are pruned
with all their members; nodes that can't differ in more are joined without looking at members. The upper level of that
index is a Spark table: large buckets are sorted by Gray rank in range partitions, which may end within a bucket, and cut
into tiles of at most ``TILE`` entries, however many that makes; only pairs of tiles whose patterns pass meet in a task, so
no bucket needs to fit in one task. Entries of the largest buckets stay where they are when these are looked up
(``join_split``, ``anti_split``).

A bucket returns a star (each member to the smallest member it is connected with) instead of all pairs. Stars are
joined into components by alternating large-star and small-star rounds over written tables; no links, components or
fingerprints reach the driver. Joins on a hub, a root or a fingerprint that holds many rows keep those rows where they are
(``join_split``).

Defined cases: null and empty texts have no words and fingerprint 0, which links like any other; texts of fewer words
than a shingle hash as one; repeated rows each get their row; a component without any doc_id (all null) is null; an
empty table gives an empty table; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import anti_split, join_split, materialise, read_table, ship_package

BITS = 64
MAX_BITS = 4
#: Fingerprints that a bucket should hold on average at most; decides how many blocks there are.
BUCKET = 256
#: Entries of a bucket that meet in one task; larger buckets are cut into tiles.
TILE = 8192
#: Tiles of a large bucket that one task holds against all of the bucket's tiles.
TILES_A_TASK = 64
LEAF = 32
FANOUT = 8


# -- fingerprints -----------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int) -> int:
    """The text's 64-bit fingerprint, unsigned."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone splits
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), of(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"))


# -- the index --------------------------------------------------------------------------------------------------------


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in Gray-code order, halved so that it is never negative."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return F.shiftrightunsigned(fp, 1)


def _gray_order(fps: np.ndarray) -> np.ndarray:
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return np.argsort(rank, kind="stable")


def _hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining each a with its b: the smallest position in reach."""
    while True:
        la, lb = labels[a], labels[b]
        if not (apart := la != lb).any():
            return labels
        la, lb = la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while not np.array_equal(up := labels[labels], labels):
            labels = up


def _pairs(i: np.ndarray, j: np.ndarray, n_below: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the children of each pair of nodes; of a node with itself, each pair once."""
    c = np.arange(FANOUT)
    a = (i[:, None, None] * FANOUT + c[:, None]) + np.zeros(FANOUT, np.int64)
    b = (j[:, None, None] * FANOUT + c) + np.zeros((FANOUT, 1), np.int64)
    a, b = a.ravel(), b.ravel()
    keep = (a < n_below) & (b < n_below) & (a <= b)
    return a[keep], b[keep]


def connected(fps: np.ndarray) -> np.ndarray:
    """For distinct fingerprints in Gray order: the position of the smallest member of each one's component."""
    n = len(fps)
    labels = np.arange(n)
    levels = []  # from the leaves up: shared-pattern value, bits that vary
    starts = np.arange(0, n, LEAF)
    low, high = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
    while True:
        levels.append((low, low ^ high))
        if len(low) <= FANOUT:
            break
        starts = np.arange(0, len(low), FANOUT)
        low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
    i, j = np.triu_indices(len(low))
    span = LEAF * FANOUT ** (len(levels) - 1)
    for depth in range(len(levels) - 1, -1, -1):
        value, vary = levels[depth]
        loose = vary[i] | vary[j]
        apart = (value[i] ^ value[j]) & ~loose
        keep = np.bitwise_count(apart) <= MAX_BITS  # else no two members can be near
        i, j, apart, loose = i[keep], j[keep], apart[keep], loose[keep]
        sure = np.bitwise_count(apart | loose) <= MAX_BITS  # then all members are
        for x, y in zip(i[sure].tolist(), j[sure].tolist(), strict=True):
            own = np.r_[x * span : min(n, (x + 1) * span), y * span : min(n, (y + 1) * span)]
            labels = _hook(labels, np.full(len(own), own[0]), own)
        i, j = i[~sure], j[~sure]
        if depth:
            i, j = _pairs(i, j, len(levels[depth - 1][0]))
            span //= FANOUT
    by = np.argsort(j - i, kind="stable")  # neighbours first: what they join needn't be compared again
    i, j = i[by], j[by]
    leaf = np.arange(LEAF)
    for at in range(0, len(i), 1024):
        a, b = (np.minimum(x[at : at + 1024, None] * LEAF + leaf, n - 1) for x in (i, j))
        la, lb = labels[a], labels[b]
        todo = (la != la[:, :1]).any(1) | (lb != la[:, :1]).any(1)
        a, b = a[todo], b[todo]
        if len(a):
            p, q, r = np.nonzero(np.bitwise_count(fps[a][:, :, None] ^ fps[b][:, None, :]) <= MAX_BITS)
            labels = _hook(labels, a[p, q], b[p, r])
    return labels


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (unit, fp), sorted by unit, to links (a, b): each member and the smallest one it is connected with."""

    def of(units: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        out = []
        edges = np.flatnonzero(np.r_[True, units[1:] != units[:-1], True]) if len(units) else np.array([0])
        for lo, hi in zip(edges[:-1][np.diff(edges) > 1].tolist(), edges[1:][np.diff(edges) > 1].tolist(), strict=True):
            own = np.unique(fps[lo:hi])
            own = own[_gray_order(own)]
            labels = connected(own)
            moved = np.flatnonzero(labels != np.arange(len(own)))
            if len(moved):
                out.append((own[moved], own[labels[moved]]))
        a, b = (np.concatenate([x[k] for x in out]).view(np.int64) if out else np.array([], np.int64) for k in (0, 1))
        return pd.DataFrame({"a": a, "b": b})

    units, fps = np.array([], np.int64), np.array([], np.uint64)
    for batch in batches:
        units, fps = np.r_[units, batch["unit"].to_numpy()], np.r_[fps, batch["fp"].to_numpy().view(np.uint64)]
        if len(units):
            cut = int(np.searchsorted(units, units[-1]))  # the last unit may go on in the next batch
            yield of(units[:cut], fps[:cut])
            units, fps = units[cut:], fps[cut:]
    yield of(units, fps)


def scheme(n: int) -> list[int]:
    """Masks of the bits by which ``n`` fingerprints are put into buckets, as signed longs: one mask for each choice of
    b - 4 of b blocks, b the fewest blocks (5 to 8) with which buckets hold ``BUCKET`` fingerprints on average at most."""
    blocks = next((b for b in range(MAX_BITS + 1, 2 * MAX_BITS) if n <= BUCKET << (BITS * (b - MAX_BITS) // b)), 2 * MAX_BITS)
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << edges[k + 1] - edges[k]) - 1) << edges[k] for k in chosen) for chosen in combinations(range(blocks), blocks - MAX_BITS)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def near_links(fps: DataFrame, n: int) -> DataFrame:
    """Links (a, b) over the ``n`` distinct fingerprints (``fp``) that connect exactly those that near pairs connect."""
    masks = scheme(n)
    keys = F.array(*[F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    entries = fps.select("fp", F.explode(keys).alias("bucket"))
    large = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    large = materialise(large.withColumn("shares", F.ceil(F.col("n") / (TILE * TILES_A_TASK)).cast("int")))  # at most a row for each TILE entries
    units = entries
    if not large.isEmpty():
        units = anti_split(entries, large, "bucket", "n", n * len(masks))
    units = units.select(F.xxhash64("bucket").alias("unit"), "fp")
    if not large.isEmpty():
        hot = materialise(join_split(entries, large, "bucket", "n", n * len(masks)).withColumn("rank", gray_rank(F.col("fp"))))
        # range partitions may end within a bucket, so one of any size is cut by many tasks
        at = F.expr(f"monotonically_increasing_id() div {TILE}").alias("tile")
        tiled = materialise(hot.repartitionByRange("bucket", "rank").sortWithinPartitions("bucket", "rank").select("bucket", "shares", "fp", at))
        nodes = materialise(tiled.groupBy("bucket", "tile").agg(F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high"), F.first("shares").alias("shares")))
        # one node for each TILE entries of a large bucket: an equi-join of the index's upper level, in shares of its tiles
        left = nodes.select("bucket", F.pmod("tile", "shares").cast("int").alias("share"), F.col("tile").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"))
        right = nodes.select("bucket", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("tile").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
        loose = (F.col("low_i").bitwiseXOR(F.col("high_i"))).bitwiseOR(F.col("low_j").bitwiseXOR(F.col("high_j")))
        apart = F.bit_count((F.col("low_i").bitwiseXOR(F.col("low_j"))).bitwiseAND(F.bitwise_not(loose)))
        pairs = left.join(right, ["bucket", "share"]).where((F.col("i") <= F.col("j")) & (apart <= MAX_BITS)).select("bucket", "i", "j")
        sides = pairs.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
        units = units.unionByName(tiled.join(sides, ["bucket", "tile"]).select(F.xxhash64("bucket", "i", "j").alias("unit"), "fp"))
    return units.repartition("unit").sortWithinPartitions("unit").mapInPandas(_stars, "a long, b long")


# -- components -------------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the links (a, b), root the component's smallest node; by alternating stars.

    Each round writes its links; a hub costs one row for each neighbour, in a join that can split it.
    """
    links = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        n = links.count()
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")))
        big = materialise(join_split(both.where("b > a"), least, "a", "n", n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())  # large star
        least = materialise(big.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = join_split(big, least, "a", "n", big.count()).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = materialise(small.where("a > b").distinct())
        # stars alone are left when no node has two smaller neighbours and no root has a smaller one
        roots = after.select(F.col("b").alias("a")).distinct()
        if after.count() == after.select("a").distinct().count() and after.join(roots, "a", "left_semi").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        links = after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id."""
    marked = materialise(with_fingerprints(docs, id_col, text_col, shingle))
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    n = distinct.count()
    roots = components(near_links(distinct.select("fp"), n)).withColumnRenamed("node", "fp")
    rooted = materialise(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "rows"))
    named = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")))
    named = materialise(join_split(rooted, named, "root", "members", n).select("fp", "component_id", "rows"))
    return join_split(marked, named, "fp", "rows", marked.count()).select("doc_id", "fp", "component_id")


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The documents whose id names their component (rows that share that id all stay). Columns stay as they are.

    Only the ids that go are joined back, usually few enough to be broadcast by their size.
    """
    found = near_duplicates(docs, id_col, text_col, shingle)
    gone = materialise(
        found.groupBy(F.col("doc_id").alias("__sh_gone")).agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept")).where("not kept").select("__sh_gone")
    )
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__sh_gone"]), "left_anti").select(*docs.columns)


def op7_simhash(spark, sf_dir):
    found = near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _oracle(shingle: int) -> str:
    """The query as SQL, for small tables: XXH64 worked out in whole numbers modulo 2^64, all pairs of distinct
    fingerprints, and the closure of their links."""
    # The hash's primes.
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    low, seed = f"{(1 << 64) - 1}::UHUGEINT", 42
    mod = lambda x: f"(({x}) & {low})"
    turn = lambda x, r: f"((({x} * {1 << r}::UHUGEINT) & {low}) + ({x} >> {64 - r}::UHUGEINT))"
    step = lambda acc, lane: mod(f"{turn(mod(f'{acc} + {lane} * {p2}'), 31)} * {p1}")
    number = lambda at, n: "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::UHUGEINT"
    starts = [(seed + 11400714785074694791 + 14029467366897019727) % (1 << 64), (seed + 14029467366897019727) % (1 << 64), seed, (seed - 11400714785074694791) % (1 << 64)]
    lanes = ", ".join(f"list_reduce(list_transform(range(0, n // 32), lambda k: {number(f'32 * k + {8 * j}', 8)}), lambda v, y: {step('v', 'y')}, {v}::UHUGEINT) AS v{j}" for j, v in enumerate(starts))
    merged = mod(" + ".join(turn(f"v{j}", r) for j, r in enumerate((1, 7, 12, 18))))
    folded = f"list_reduce([v0, v1, v2, v3], lambda h, v: {mod(f'xor(h, {step("0::UHUGEINT", "v")}) * {p1} + {p4}')}, {merged})"
    eight = mod(f"{turn(f'xor(h, {step("0::UHUGEINT", "y.v")})', 27)} * {p1} + {p4}")
    four = mod(f"{turn(f'xor(h, {mod(f"y.v * {p1}")})', 23)} * {p2} + {p3}")
    one = mod(f"{turn(f'xor(h, {mod(f"y.v * {p5}")})', 11)} * {p1}")
    rest = f"""list_transform(range(n // 32 * 4, n // 8), lambda k: {{'size': 8, 'v': {number('8 * k', 8)}}})
        || CASE WHEN n % 8 >= 4 THEN [{{'size': 4, 'v': {number('n // 8 * 8', 4)}}}] ELSE [] END
        || list_transform(range(n // 4 * 4, n), lambda k: {{'size': 1, 'v': {number('k', 1)}}})"""
    counts = ", ".join(f"sum((h >> {b}::UBIGINT) & 1::UBIGINT)::BIGINT AS b{b}" for b in range(BITS))
    whole = " + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(BITS))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS row,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT row, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT row, array_to_string(w[i:i + {shingle - 1}], ' ') AS t FROM i),
u AS (SELECT t, hex(encode(t)) AS x, strlen(t) AS n FROM (SELECT DISTINCT t FROM s)),
v AS (SELECT t, n, {rest} AS rest, {lanes} FROM u),
g AS (SELECT t, list_reduce(rest, lambda h, y: CASE y.size WHEN 8 THEN {eight} WHEN 4 THEN {four} ELSE {one} END,
    {mod(f"CASE WHEN n >= 32 THEN {folded} ELSE {seed}::UHUGEINT + {p5} END + n::UHUGEINT")}) AS h FROM v),
a AS (SELECT t, {mod(f"xor(h, h >> 33::UHUGEINT) * {p2}")} AS h FROM g),
e AS (SELECT t, {mod(f"xor(h, h >> 29::UHUGEINT) * {p3}")} AS h FROM a),
z AS (SELECT t, xor(h, h >> 32::UHUGEINT)::UBIGINT AS h FROM e),
c AS (SELECT row, count(*) AS n, {counts} FROM s JOIN z USING (t) GROUP BY row),
f AS (SELECT doc_id, coalesce({whole}, 0::UHUGEINT) AS fp FROM d LEFT JOIN c USING (row)),
k AS (SELECT fp, min(doc_id) AS least FROM f GROUP BY fp),
l AS (SELECT x.fp AS a, y.fp AS b FROM k x JOIN k y ON bit_count(xor(x.fp, y.fp)::HUGEINT) <= {MAX_BITS}),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT r.a AS fp, min(least) AS component_id FROM r JOIN k ON k.fp = r.b GROUP BY r.a)
SELECT doc_id, lower(lpad(hex(fp::UBIGINT), 16, '0')) AS fingerprint, component_id FROM f JOIN m USING (fp)
"""


ORACLE_SQL = _oracle(4)
