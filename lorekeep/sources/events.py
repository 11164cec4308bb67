"""The event log as canonical JSON lines: sorted keys, nothing unknown, each line equal to its own re-encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.sources.logs import number_lines
from lorekeep.sources.tables import written

#: In key order, which is the canonical order.
FIELDS = ("anchor", "generation", "kind", "note_ref", "policy", "presentation", "ts")
_SCHEMA = ", ".join(f"{f} string" for f in FIELDS)


def canonical(*columns: Column) -> Column:
    """One line for the event's columns (all strings, ``ts`` in ISO form), keys sorted, nulls left out."""
    return F.to_json(F.struct(*[c.alias(f) for c, f in zip(columns, FIELDS, strict=True)]))


def to_lines(events: DataFrame) -> DataFrame:
    """(seq, line): the log's lines in append order."""
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return events.select("seq", canonical(*[ts if f == "ts" else F.col(f).cast("string") for f in FIELDS]).alias("line"))


def salvage(lines: DataFrame, superseded: Column | None = None) -> DataFrame:
    """Each line with its status: ok, corrupt (not canonical, unknown keys, missing fields) or superseded (an older
    form of anchor, by the caller's test on ``anchor``); fields are set where ok. ``lines``: line_no, line, and others."""
    parsed = lines.withColumn("e", F.from_json("line", _SCHEMA)).select("*", "e.*").drop("e")
    again = canonical(*[F.col(f) for f in FIELDS])
    unknown = F.size(F.array_except(F.json_object_keys("line"), F.array(*map(F.lit, FIELDS))))
    ok = (again == F.col("line")) & (unknown == 0) & F.col("anchor").isNotNull() & F.col("kind").isNotNull() & F.try_to_timestamp("ts").isNotNull()
    status = F.when(~F.coalesce(ok, F.lit(False)), "corrupt").when(superseded if superseded is not None else F.lit(False), "superseded").otherwise("ok")
    return parsed.withColumn("status", status)


_RECORD = "id string, query_class string, strategy_a string, strategy_b string, generation string, attribution array<struct<anchor:string,credited_to:string>>, starting_side string, is_null_comparison boolean"


def record_lines(records: DataFrame) -> DataFrame:
    """(seq, line): presentation records in append order, keys sorted."""
    names = sorted(c.split()[0] for c in _RECORD.split(", "))
    return records.select("seq", F.to_json(F.struct(*names)).alias("line"))


def salvage_records(lines: DataFrame, current: Callable[[Column], Column]) -> DataFrame:
    """Each record's line with its status: ok, corrupt, or superseded, which it is if any of its anchors is (``current``
    tests one anchor): credit by place needs them all. ``lines``: line_no, line."""
    parsed = lines.withColumn("r", F.from_json("line", _RECORD)).select("*", "r.*").drop("r")
    names = sorted(c.split()[0] for c in _RECORD.split(", "))
    ok = (F.to_json(F.struct(*names)) == F.col("line")) & F.col("id").isNotNull() & F.col("attribution").isNotNull() & F.col("is_null_comparison").isNotNull()
    whole = F.forall("attribution.anchor", current)
    status = F.when(~F.coalesce(ok, F.lit(False)), "corrupt").when(~F.coalesce(whole, F.lit(False)), "superseded").otherwise("ok")
    return parsed.withColumn("status", status)


def read_range(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events of [start, end), in append order by ``seq``."""
    return events.where((F.col("ts") >= start) & (F.col("ts") < end))


def append(events: DataFrame, path: str) -> None:
    """Appends lines as a JSON-lines directory; one file for each task, committed together."""
    to_lines(events).select(F.col("line").alias("value")).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of a log's files, numbered from 1 within each; files of any size are read block by block."""
    text = spark.read.option("lineSep", "\n").text(path)
    numbered = number_lines(text, F.element_at(F.split(F.try_url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "/"), -1))
    return numbered.select(F.col("source_key").alias("file"), (F.col("line_no") + 1).alias("line_no"), F.col("raw").alias("line"))


def faults(salvaged: DataFrame) -> DataFrame:
    """(status, n, lines): how many lines of each status there are, and where those are that aren't ok, as ``file:line``, the
    first hundred in order. ``salvaged``: file, line_no, status."""
    bad = salvaged.where("status <> 'ok'").withColumn("place", F.row_number().over(Window.partitionBy("status").orderBy("file", "line_no"))).where("place <= 100")
    listed = bad.groupBy("status").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "file", "line_no").alias("at")))), lambda x: x["at"]).alias("lines"))
    return salvaged.groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(listed, "status", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))


def prune(spark: SparkSession, path: str, to: str, superseded: Column | None = None) -> DataFrame:
    """Writes the usable lines of ``path`` to the new directory ``to`` (the old one stays as backup), in their order within
    each file, reads them back and returns ``faults``; raises if what was written is not what was kept."""
    statuses = written(salvage(read_log(spark, path), superseded))
    statuses.where("status = 'ok'").repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no").select("line").write.text(to)
    told = written(faults(statuses))
    kept = told.where("status = 'ok'").agg(F.sum("n")).first()[0] or 0
    if spark.read.text(to).count() != kept:
        raise ValueError("the pruned log does not read back")
    return told
