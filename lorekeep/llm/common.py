"""What the training-data operators share: tables, folds, scratch tables and code shipping."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.sources.shipping import ship_package

__all__ = ["anti_split", "ascii_lower", "ascii_words", "fold", "join_split", "materialise", "read_table", "scratch_folder", "ship_package"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII characters that are neither letters nor digits (capitals are lowered before).
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(mod)).cast("int")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def ascii_words(text: Column) -> Column:
    """Words of ASCII letters, digits and all characters beyond ASCII, lower-cased in A-Z."""
    return F.array_remove(F.split(ascii_lower(text), WORD_GAP), "")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, a local one in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lorekeep.scratch", None)
    if named is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("lorekeep.scratch", named)
    return named


def join_split(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join on ``key``, of which ``right`` has one row each, with the number of left rows that it meets in ``weight``.

    Keys that hold more than a thousandth of all ``total`` left rows (so fewer than a thousand keys) are broadcast and
    their rows stay where they are; so no task of the shuffled rest gets more than a thousandth for one key.
    """
    hot = F.col(weight) * 1000 > total
    many, few = F.broadcast(right.where(hot).drop(weight)), right.where(~hot).drop(weight)
    rest = left.join(many.select(key), key, "left_anti").join(few, key)
    return left.join(many, key).unionByName(rest)


def anti_split(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """The left rows whose key ``right`` lacks, with the same split as ``join_split``: rows of hot keys go before any shuffle."""
    hot = F.col(weight) * 1000 > total
    many, few = F.broadcast(right.where(hot).select(key)), right.where(~hot).select(key)
    return left.join(many, key, "left_anti").join(few, key, "left_anti")


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet into the shared scratch folder and reads it back, which cuts its lineage.

    Lost executors then cost a re-read instead of a recomputation, and later steps prune columns.
    """
    path = f"{scratch_folder(df.sparkSession)}/lorekeep-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
