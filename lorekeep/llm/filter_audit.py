"""Filter interaction audit: what each filter removes under every order, from one count per failure mask.

A document's failures are a mask of five bits. Every part (a source) is counted by mask once: 32 numbers, and as many for
its good and its toxic documents. The subset-zeta transform turns them into the survivors of every subset of filters: those
whose masks lie in the subset's complement, by a running sum along each of the five axes of a 2 x 2 x 2 x 2 x 2 cube. What a
filter removes after others is then the difference of two neighbouring subsets, for each of the 120 orders, without
looking at a document again; so are unique failures (all five against the other four) and Shapley sums.

Texts that occur twice are found as in exact deduplication (``exact_dedup``): rows whose hash doesn't repeat never move, the
others meet by SHA-256 and keep hot texts in place (``join_split``). Of rows only (doc_id, part, mask) counts go on, summed in
each task, and only those meet the labels; parts of any size are 32 rows a task.

Filters: A under 50 words; B under 65 distinct words of 100; C over 5 capitals A-Z of 100 code points; D any of ``#$%&*|``; E
the text of a row with a smaller id, removed or not. Words are maximal runs of other than ASCII white space.

Defined cases: a null text is empty (no words: fails A alone, and E beside another one); a null or empty source is the part
with the empty name; a null id is smaller than any other and has no label; rows that share text and id don't fail each other;
every row counts, repeated ones too; of several labels of an id one good (toxic) suffices; no documents give no rows, a
table without labels no losses; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import UPPER, join_split, materialise, read_table, ship_package
from lorekeep.llm.exact_dedup import probe, repeated_hashes

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
MEASURES = ("n", "good", "toxic")
_SPACE = r"[\x20\x09-\x0D]+"


# -- failures of documents --------------------------------------------------------------------------------------------


def own_failures(text: Column) -> dict[str, Column]:
    """The conditions that a text alone decides; ``text`` is not null."""
    words = F.array_remove(F.split(text, _SPACE), "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _bits(failures: dict[str, Column]) -> Column:
    """The sum of the bits of the conditions that hold."""
    bits = F.lit(0)
    for name, fails in failures.items():
        bits = bits + F.when(fails, F.lit(1 << FILTERS.index(name))).otherwise(F.lit(0))
    return bits


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: doc_id, part, mask."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    slim = docs.select("doc_id", "part", _bits(own_failures(text)).alias("mask"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("sha"))
    keyed = materialise(probe(slim, repeated_hashes(docs), F.col("h"), "candidate").drop("h"))
    candidates = keyed.where("candidate").drop("candidate")
    smallest = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"]  # a null id comes first
    groups = materialise(candidates.groupBy("sha").agg(smallest.alias("smallest"), F.count(F.lit(1)).alias("rows")))
    repeated = ~F.col("doc_id").eqNullSafe(F.col("smallest"))
    met = join_split(candidates, groups, "sha", "rows", candidates.count()).withColumn("mask", F.col("mask") + _bits({"E": repeated}))
    columns = ["doc_id", "part", "mask"]
    return keyed.where("not candidate").select(*columns).unionByName(met.select(*columns))


# -- counts by part and mask ------------------------------------------------------------------------------------------


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays over the 32 masks, one row a part."""
    grouped = materialise(masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    told = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("good or toxic")
    met_by = grouped.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    told = materialise(told.join(met_by, "doc_id"))
    lost = lambda name: F.when(F.col(name), F.col("n")).otherwise(F.lit(0)).alias(name)
    labelled = join_split(grouped, told, "doc_id", "rows", grouped.count()).select("part", "mask", F.lit(0).cast("long").alias("n"), lost("good"), lost("toxic"))
    zero = F.lit(0).cast("long")
    rows = grouped.select("part", "mask", "n", zero.alias("good"), zero.alias("toxic")).unionByName(labelled)
    summed = rows.groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])
    of_mask = lambda name: F.array(*[F.coalesce(F.max(F.when(F.col("mask") == m, F.col(name))), zero) for m in range(MASKS)]).alias(name)
    return summed.groupBy("part").agg(*[of_mask(m) for m in MEASURES])


# -- subsets ----------------------------------------------------------------------------------------------------------


def survivors(counts: np.ndarray) -> np.ndarray:
    """Counts by mask (..., 32) turned into those that fail no filter of a subset, by subset."""
    cube = counts.reshape(*counts.shape[:-1], *[2] * len(FILTERS))
    for axis in range(-len(FILTERS), 0):
        cube = cube.cumsum(axis)
    within = cube.reshape(counts.shape)  # by subset: those whose failures lie within it
    return within[..., ::-1]  # the complement of subset s is 31 - s


def _steps() -> pd.DataFrame:
    """The 120 orders step by step: the subset of filters applied before, and the filter's own bit."""
    rows = [("".join(order), step + 1, sum(1 << FILTERS.index(f) for f in order[:step]), 1 << FILTERS.index(order[step])) for order in permutations(FILTERS) for step in range(len(order))]
    return pd.DataFrame(rows, columns=["filter_order", "step", "before", "bit"])


_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def order_effects(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from ``mask_counts``."""
    ship_package(counts.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = _steps()
        before, bit = steps["before"].to_numpy(), steps["bit"].to_numpy()
        rest = MASKS - 1 - bit
        for batch in batches:
            for at in range(len(batch)):  # 600 rows a part
                n, good, toxic = (survivors(np.asarray(batch[m].iloc[at], np.int64)) for m in MEASURES)
                gone = lambda s, subset=before: s[subset] - s[subset | bit]
                removed = gone(n)
                failing = n[0] - n[bit]
                shapley = np.bincount(bit, weights=removed)[bit].astype(np.int64) if n[0] < 1 << 45 else np.array([removed[bit == b].sum() for b in bit])
                yield pd.DataFrame({
                    "part": batch["part"].iloc[at], "filter_order": steps["filter_order"], "step": steps["step"].astype(np.int32), "kept": n[before | bit], "removed": removed,
                    "redundant": failing - removed, "unique_fails": gone(n, rest), "good_lost": gone(good), "toxic_lost": gone(toxic), "shapley": shapley,
                })

    return counts.mapInPandas(of, _RESULT)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What every filter removes at every step of every order, by part."""
    return order_effects(mask_counts(failure_masks(docs, id_col, text_col, part_col), labels))


def op12_filter_audit(spark, sf_dir):
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


#: By definition: every document through every order.
ORACLE_SQL = """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
f AS (SELECT doc_id, part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
k AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT o, k AS step, o[k] AS own, o[1:k - 1] AS earlier FROM o, k),
m AS (SELECT d.*, s.*, fails[own] AS failing, len(list_filter(earlier, lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS sole FROM d, s),
r AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed, coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
    coalesce(sum(n) FILTER (failing AND sole), 0) AS unique_fails, coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0) AS toxic_lost
    FROM m GROUP BY part, o, step, own)
SELECT part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
