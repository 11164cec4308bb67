"""The event log as a data source: blocks, streams, and the same rows as salvage by the text source."""

import pytest
from pyspark.sql import functions as F

from lorekeep.sources import eventlog, events


def log(spark, n, seed=0):
    e = spark.range(seed, seed + n).select(F.col("id").alias("seq"), F.concat(F.lit("anchor-é"), F.col("id")).alias("anchor"), F.lit("opened").alias("kind"), F.lit("g").alias("generation"), F.lit(None).cast("string").alias("note_ref"), F.lit("archival").alias("policy"), F.lit("p").alias("presentation"), F.timestamp_seconds(F.col("id")).alias("ts"))
    return [r["line"] for r in events.to_lines(e).orderBy("seq").collect()]


@pytest.mark.parametrize("block", [1, 7, 64, 1000, 1 << 20])
def test_blocks_give_each_line_once(spark, tmp_path, block):
    eventlog.register(spark)
    (tmp_path / "log").mkdir()
    lines = log(spark, 12) + ["", "not json", '{"kind":"opened"}', "x" * 300]
    (tmp_path / "log" / "a.txt").write_text("\n".join(lines) + "\nhalf", encoding="utf-8")
    (tmp_path / "log" / "b.txt").write_text("one\n", encoding="utf-8")
    (tmp_path / "log" / "_SUCCESS").write_text("x\n")
    (tmp_path / "log" / "empty.txt").write_text("")
    got = spark.read.format("eventlog").option("blockBytes", block).load(str(tmp_path / "log")).orderBy("file", "position").collect()
    assert [r["line"] for r in got if r["file"] == "a.txt"] == [*lines, "half"] and [r["line"] for r in got if r["file"] == "b.txt"] == ["one"]
    raw = (tmp_path / "log" / "a.txt").read_bytes()
    assert all(raw[r["position"] :].startswith(r["line"].encode()) for r in got if r["file"] == "a.txt")
    if block == 64:
        assert spark.read.format("eventlog").option("blockBytes", block).load(f"file://{tmp_path}/log").rdd.getNumPartitions() == -(-len(raw) // 64) + 1


def test_salvage_takes_its_rows(spark, tmp_path):
    eventlog.register(spark)
    lines = log(spark, 9) + ["not json", '{"kind":"opened"}']
    (tmp_path / "log.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    told = lambda df: sorted((r["line"], r["status"], r["anchor"]) for r in events.salvage(df).collect())
    own = told(spark.read.format("eventlog").load(str(tmp_path / "log.txt")))
    assert own == told(events.read_log(spark, str(tmp_path / "log.txt"))) and [s for _, s, _ in own].count("ok") == 9


def test_a_stream_reads_each_complete_line_once(spark, tmp_path):
    eventlog.register(spark)
    folder = tmp_path / "log"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("eventlog").option("blockBytes", 100).load(str(folder))
        out = events.salvage(stream).select("file", "position", "line", "status").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
        out.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).orderBy("file", "position").collect()

    first = log(spark, 5)
    (folder / "a.txt").write_text("\n".join(first) + "\nha", encoding="utf-8")
    assert [r["line"] for r in run()] == first  # the half line waits
    with open(folder / "a.txt", "a", encoding="utf-8") as f:
        f.write("lf\n" + "\n".join(log(spark, 2, 50)) + "\n")
    (folder / "b.txt").write_text("\n".join(log(spark, 3, 90)) + "\n", encoding="utf-8")
    got = run()
    whole = events.salvage(spark.read.format("eventlog").load(str(folder))).select("file", "position", "line", "status").orderBy("file", "position").collect()
    assert got == whole and len(got) == 5 + 1 + 2 + 3 and [r["status"] for r in got].count("corrupt") == 1
    assert run() == whole


def test_a_missing_log_is_an_error(spark, tmp_path):
    eventlog.register(spark)
    with pytest.raises(Exception, match="no log at"):
        spark.read.format("eventlog").load(str(tmp_path / "none")).collect()
