"""Exact deduplication by two passes over a Bloom filter of repeated hashes.

Pass one counts the texts' 64-bit hashes, one number a row with sums in each task first, and sets two bits of a blocked
Bloom filter for each hash that two or more rows have. Pass two probes the filter in place: a row that misses it has no
equal and passes straight through. Only the other rows (true repeats and a few false positives) are shuffled, by SHA-256.

The filter grows with the number of repeated texts, not of rows, and is always broadcast: it never exceeds ``MOST_BLOCKS``
blocks of 4 KB (256 MB). Beyond some hundred million repeated texts only its error rate rises, so that more rows are
shuffled; results are exact whatever the rate, and there is no other way to take.

``drop_duplicates_exact`` decides on hashes and ids alone which row of each group stays. A second filter, over those rows,
keeps the losing copies where they are: a text that a third of all rows share is one row that travels.

Defined cases: a null text equals the empty text; equal rows that also share their doc_id all name that doc_id as
``keep_id`` and are all ``kept`` by ``mark_duplicates`` (``drop_duplicates_exact`` keeps one of them); a null doc_id
is smaller than any other; an empty table gives an empty table; other columns are passed through untouched by
``drop_duplicates_exact`` (its own helper columns start with ``__xd_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import join_split, materialise

BLOCK_BITS = 32768  # what bitmap_construct_agg holds
#: Filter bits for each entry, and the largest filter in blocks of 4 KB.
BITS_PER_ENTRY = 16
MOST_BLOCKS = 1 << 16


def _blocks_for(entries: int) -> int:
    blocks = 1
    while blocks * BLOCK_BITS < entries * BITS_PER_ENTRY and blocks < MOST_BLOCKS:
        blocks *= 2
    return blocks


def _address(h: Column, blocks: int) -> tuple[Column, Column, Column]:
    """Block and two bits within it, from a 64-bit hash: disjoint bits of the hash each."""
    return (
        F.pmod(F.shiftrightunsigned(h, 30), F.lit(blocks)).alias("__xd_block"),
        h.bitwiseAND(F.lit(BLOCK_BITS - 1)).alias("__xd_bit1"),
        F.shiftrightunsigned(h, 15).bitwiseAND(F.lit(BLOCK_BITS - 1)).alias("__xd_bit2"),
    )


def _bit_is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2.0), bit.bitwiseAND(F.lit(7)))), F.lit(2)) == 1


def bloom_filter(hashes: DataFrame, blocks: int) -> DataFrame:
    """The filter as (``__xd_block``, ``__xd_bits``), at most ``blocks`` rows of 4 KB, over the column ``h``."""
    bits = hashes.select(*_address(F.col("h"), blocks)).select("__xd_block", F.explode(F.array("__xd_bit1", "__xd_bit2")).alias("bit"))
    return bits.distinct().groupBy("__xd_block").agg(F.bitmap_construct_agg("bit").alias("__xd_bits"))


def probe(rows: DataFrame, hashes: DataFrame, h: Column, flag: str) -> DataFrame:
    """``rows`` with a flag: false only where ``h`` is not among ``hashes`` (a written table with the column ``h``)."""
    blocks = _blocks_for(hashes.count())
    filt = F.broadcast(materialise(bloom_filter(hashes, blocks)))  # at most MOST_BLOCKS rows of 4 KB
    probed = rows.select("*", *_address(h, blocks)).join(filt, "__xd_block", "left")
    hit = F.col("__xd_bits").isNotNull() & _bit_is_set(F.col("__xd_bits"), F.col("__xd_bit1")) & _bit_is_set(F.col("__xd_bits"), F.col("__xd_bit2"))
    return probed.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__xd_block", "__xd_bit1", "__xd_bit2", "__xd_bits")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def repeated_hashes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Pass one: the hashes (``h``) that two or more rows have, written."""
    return materialise(docs.select(_text_hash(text_col).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. The largest doc_id of equal texts stays."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    slim = docs.select("doc_id", _text_hash("text").alias("__xd_h"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    keyed = materialise(probe(slim, repeated_hashes(docs), F.col("__xd_h"), "candidate").drop("__xd_h"))
    alone, candidates = keyed.where("not candidate"), keyed.where("candidate")
    groups = materialise(candidates.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    size = groups.select("text_sha256", "keep_id", "group_size", F.col("group_size").alias("rows"))
    looked_up = join_split(candidates, size, "text_sha256", "rows", candidates.count()).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    ).unionByName(looked_up)


def drop_duplicates_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text a row with a larger id repeats; columns stay as they are.

    Rows that the first filter clears keep their place. Of the others, (hash, id) alone tell which stay; those that the
    second filter lets through are shuffled, by hash and id together, and compared exactly.
    """
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    own = F.concat_ws("|", "__xd_sha", F.col(id_col).cast("string"))  # without the id's part where it is null
    flagged = probe(docs, repeated_hashes(docs, text_col), _text_hash(text_col), "__xd_candidate")
    slim = flagged.where("__xd_candidate").select(sha.alias("__xd_sha"), id_col)
    stay = slim.groupBy("__xd_sha").agg(F.max(id_col).alias(id_col)).select(own.alias("__xd_own"))
    stay = materialise(stay.select("__xd_own", F.xxhash64("__xd_own").alias("h")))
    candidates = flagged.where("__xd_candidate").withColumn("__xd_sha", sha).withColumn("__xd_own", own)
    let_through = probe(candidates, stay.select("h"), F.xxhash64("__xd_own"), "__xd_stays").where("__xd_stays")
    best = let_through.dropDuplicates(["__xd_own"]).join(stay, "__xd_own", "left_semi")
    return flagged.where("not __xd_candidate").select(*docs.columns).unionByName(best.select(*docs.columns))


def op5_exact_dedup(spark, sf_dir):
    from lorekeep.llm.common import read_table

    return mark_duplicates(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g ON d.t = g.t
"""
