"""Parquet tables, and written intermediate tables in the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, a local one in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lorekeep.scratch", None)
    if named is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("lorekeep.scratch", named)
    return named


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the scratch folder and read back: computed once, its lineage cut."""
    path = f"{scratch_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
