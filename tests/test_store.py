"""Ingest: skip classes, increments equal to full builds under random changes, the facade end to end."""

import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import index, postings
from lorekeep.service import Service
from lorekeep.sources import events, logs, sinks
from lorekeep.streaming.ingest import Store, stream_turns, windowed_usage


@pytest.fixture(autouse=True)
def few_files(monkeypatch):
    monkeypatch.setattr(postings.Layout, "of", staticmethod(lambda n: postings.Layout(2, 1)))


def record(i, session, project="p", text=None, **over):
    text = text or f"第{i}則內容 keyword{i % 4} 共通詞"
    return {"type": "user", "uuid": f"u{i}", "sessionId": session, "timestamp": f"2024-01-01T00:{i % 60:02d}:00.5Z", "message": {"role": "user", "content": text}} | over


def write(path, records, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" if isinstance(r, dict) else r + "\n" for r in records) + tail, encoding="utf-8")


def test_skip_classes(spark, tmp_path):
    root = tmp_path / "logs"
    blocks = [{"type": "text", "text": "hello"}, {"type": "tool_use", "name": "Read", "input": {"path": "/f", "limit": 3}}, {"type": "image"}]
    results = [{"type": "tool_result", "content": "out"}]
    write(
        root / "p" / "deep" / "s.jsonl",
        [record(1, "s"), record(2, "s", type="summary"), record(3, "s", uuid=None), record(4, "s", uuid="a b"), "{no", "[1]", record(5, "s", message={"role": "user", "content": results}), record(6, "s", text=" \n "), record(7, "s", message={"role": "assistant", "content": blocks}), record(8, "s", timestamp="soon")],
        tail='{"type": "user"',
    )
    rows = logs.classify(logs.tails(logs.read_lines(spark, str(root)), spark.createDataFrame([], "source_key string, processed_lines long"))).collect()
    tally = {}
    for r in rows:
        tally[r["skip_reason"]] = tally.get(r["skip_reason"], 0) + 1
    assert tally == {None: 2, "notATurn": 1, "missingPointerField": 2, "malformedIdentifier": 1, "unparseableLine": 2, "toolResultOnly": 1, "noIndexableText": 1, "incompleteTrailingRecord": 1}
    assert next(r["text"] for r in rows if r["uuid"] == "u7") == "hello\n⟨tool Read path=/f⟩" and rows[0]["source_key"] == "p/deep/s.jsonl"


def test_types_are_strict_and_payloads_stay_out(spark):
    """One record each: what its text is, or why it is skipped."""
    block = lambda **b: [b]
    nested = {"type": "tool_result", "content": [{"type": "text", "text": "inner"}], "is_error": True}
    cases = [
        ({"content": "plain"}, "plain"), ({"content": 42}, "noIndexableText"), ({"content": block(type="text", text=5)}, "noIndexableText"), ({"content": [{"type": "text", "text": "z"}, 7]}, "noIndexableText"),
        ({"content": [nested]}, "toolResultOnly"), ({"content": [nested, {"type": "text", "text": "see"}]}, "⟨tool_result error⟩\nsee"), ({"content": [nested, {"type": "text", "text": " \n"}]}, "toolResultOnly"),
        ({"content": [{"type": "tool_result", "content": "secret"}, {"type": "tool_use", "name": "Edit", "input": {"command": "a\nb", "file_path": "/f", "path": "", "query": 3, "new_string": "payload"}}]}, "⟨tool_result ok⟩\n⟨tool Edit command=a b file_path=/f⟩"),
        ({"content": [{"type": "tool_use"}]}, "⟨tool ?⟩"), ({"content": [{"type": "tool_use", "name": "Bash", "input": {"command": "x" * 201}}]}, "⟨tool Bash command=" + "x" * 200 + "…⟩"),
        ({"content": "no role", "role": None}, "no role"), ("not an object", "notATurn"), ({"content": [{"type": "thinking", "text": "t"}]}, "noIndexableText"), ({"content": [nested, {"text": "untyped"}]}, "toolResultOnly"),
    ]
    rows = [("p/s", "p", i, json.dumps({"type": "assistant", "uuid": f"u{i}", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": m}, ensure_ascii=False)) for i, (m, _) in enumerate(cases)]
    more = [{"uuid": 7}, {"timestamp": "2024-01-01"}, {"timestamp": 5}, {"type": 3}]
    rows += [("p/s", "p", 100 + i, json.dumps(record(1, "s") | m)) for i, m in enumerate(more)]
    got = {r["line_no"]: r for r in logs.classify(spark.createDataFrame(rows, "source_key string, project string, line_no int, raw string")).collect()}
    assert [got[i]["skip_reason"] or got[i]["text"] for i in range(len(cases))] == [want for _, want in cases]
    assert got[10]["role"] == "assistant" and [got[100 + i]["skip_reason"] for i in range(4)] == ["missingPointerField"] * 3 + ["notATurn"]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    lines = [json.dumps({"n": i, "pad": "é" * (i % 50)}, ensure_ascii=False) for i in range(3000)]
    write(tmp_path / "p" / "big file+1.jsonl", lines, tail="half")
    write(tmp_path / "p" / "small.jsonl", ["one", "", "three"])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = logs.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    big = {r["line_no"]: (r["raw"], r["complete"]) for r in got if r["source_key"] == "p/big file+1.jsonl"}
    assert big == {i: (x, True) for i, x in enumerate(lines)} | {3000: ("half", False)}
    assert sorted((r["line_no"], r["raw"]) for r in got if r["source_key"] == "p/small.jsonl") == [(0, "one"), (1, ""), (2, "three")]


def _contents(store):
    chunks = {(r["project"], r["uuid"]): (r["text"], str(r["ts"]), r["source_count"]) for r in store.chunks().collect()}
    links = {(r["chunk_id"], r["source_key"], r["session_id"]) for r in store.links().collect()}
    return chunks, links, {tuple(r) for r in store.state().collect()}


def test_increments_equal_a_full_build(spark, tmp_path):
    rng = random.Random(7)
    root, files = tmp_path / "logs", {}
    grown = Store(spark, str(tmp_path / "grown"))
    for step in range(4):
        for _ in range(2):
            kind = rng.choice(["create", "append", "rewrite", "delete", "copy"]) if len(files) > 1 else "create"
            name = f"p{rng.randrange(3)}/f{step}{rng.randrange(9)}" if kind in ("create", "copy") else rng.choice(sorted(files))
            turns = [record(rng.randrange(6), name[-2:]) for _ in range(3)]
            if kind == "append":
                files[name] = files[name] + turns
            elif kind == "delete":
                del files[name]
            else:
                files[name] = list(files[rng.choice(sorted(files))]) if kind == "copy" else turns
        shutil.rmtree(root, ignore_errors=True)
        root.mkdir()
        for name, own in files.items():
            write(root / f"{name}.jsonl", own)
        grown.build(str(root))
    whole = Store(spark, str(tmp_path / "whole"))
    whole.build(str(root))
    assert _contents(grown) == _contents(whole)
    again = grown.build(str(root))
    assert set(again.actions) == {"same"} and _contents(grown) == _contents(whole)
    grown.build(str(root), full=True)
    assert _contents(grown) == _contents(whole)
    figures = index.audit(grown.chunks(), grown.links(), index.source_counts(grown.links()), grown.state())
    assert {r["n"] for r in figures.collect()} == {0}


def test_count_table_over_observations(spark):
    schema = "project string, project_fingerprint string, uuid string, source_key string, session_id string, ts timestamp, role string, text string, seq string"
    turn = lambda source, seq: ("p", "f", "t", source, "s", None, "user", "x", seq)
    once = spark.createDataFrame([turn("s1", "1"), turn("s1", "2")], schema)
    assert index.build_chunks(once).first()["source_count"] == 1
    both = once.unionByName(spark.createDataFrame([turn("s2", "3")], schema))
    assert index.build_chunks(both).first()["source_count"] == 2
    left, links = index.remove_sources(index.build_chunks(both), index.build_links(both), spark.createDataFrame([("s1",)], "source_key string"))
    assert left.first()["source_count"] == 1 and links.count() == 1


def test_facade(spark, tmp_path):
    root = tmp_path / "logs"
    write(root / "p" / "a.jsonl", [record(i, "a", text=f"the keeper of lore number {i} keeps {'lore ' * (i % 3)}") for i in range(12)])
    write(root / "q" / "b.jsonl", [record(i, "b", text=f"another keeper {i}") for i in range(20, 26)])
    s = Service(spark, str(tmp_path / "store"))
    report = s.build(str(root))
    assert report.actions == {"new": 2} and s.store.version() == 1
    found = s.query("keeper of lore", k=5, record=True)
    assert found.count() == 5 and {r["project"] for r in found.collect()} == {"p"} and found.select("presentation").distinct().count() == 1
    assert {r["band"] for r in found.collect()} <= {0, 1}  # three channels
    assert s.query("keeper", k=10, project="q").count() == 6
    lexical = lambda f: [r for r in f.collect() if "trigram" in r["channels"]]
    assert len(lexical(s.query("keeper", k=30, exclude=["a"]))) == 6 and s.query("keeper", k=3, exclude=["a"]).count() == 3
    assert not lexical(s.query("nothing like it"))
    assert {r["n"] for r in s.audit().collect()} == {0}
    number, mixed = s.compare("keeper of lore", k=6)
    assert mixed.count() == 6
    s.mark(number, 5, "pinned")
    again, _ = s.compare("keeper of lore", k=6)
    s.mark(again, 1, "opened")
    kinds = {r["kind"]: r["n"] for r in s.events().groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["pinned"] == 1 and kinds["opened"] == 1 and kinds["shown"] == 17
    levels = {r["strategy"]: r for r in s.report().where("level = 'total'").collect()}
    assert sum(r["credits"] for r in levels.values()) == 1  # the first comparison was a null comparison
    assert not {"text", "query"} & {*s.events().columns, *s.records().columns}
    block = sinks.recall_block(found)
    assert block.startswith(sinks.OPEN) and len(block) <= sinks.MOST_CHARS
    assert json.loads(sinks.json_lines(found).first()["line"])["project"] == "p" and sinks.human(found).count("\n") == 4


def test_query_takes_new_content_in_and_reads_no_future(spark, tmp_path):
    root = tmp_path / "logs"
    write(root / "p" / "a.jsonl", [record(i, "a", text=f"first words {i}") for i in range(4)])
    write(root / "p" / "b.jsonl", [record(i, "b", text=f"other words {i}") for i in range(10, 14)])
    s = Service(spark, str(tmp_path / "store"))
    assert s.query("first words", k=4, root=str(root)).where("array_contains(channels, 'segment')").count() == 4
    write(root / "p" / "a.jsonl", [record(i, "a", text=f"first words {i}") for i in range(4)] + [record(7, "a", text="first words at last")])
    write(root / "p" / "b.jsonl", [record(i, "b", text=f"rewritten words {i}") for i in range(10, 12)])
    grown = s.build(str(root), budget_seconds=60)  # with a budget, what was rewritten waits
    assert grown.actions == {"appended": 1, "rewritten": 1} and grown.unmerged == 1
    texts = lambda q: {r["snippet"] for r in s.query(q, k=20).collect() if "segment" in r["channels"]}
    assert "first words at last" in texts("first words") and texts("rewritten words") == set() and len(texts("other words")) == 4
    assert s.build(str(root), batch_chunks=1).unmerged == 0
    assert texts("rewritten words") == {"rewritten words 10", "rewritten words 11"} and texts("other words") == set()
    assert {r["n"] for r in s.audit().collect()} == {0}
    again = s.build(str(root))
    assert set(again.actions) == {"same"} and again.version == s.store.version()
    # usage of an anchor that the corpus has lost counts for nothing
    gone = spark.createDataFrame([("pinned", 12345)], "kind string, anchor long").select("kind", "anchor", F.current_timestamp().alias("ts"), F.lit("g").alias("generation"), F.lit("archival").alias("policy"), F.lit("n").alias("note_ref"), F.lit("x").alias("presentation"))
    gone.write.mode("append").parquet(f"{s.folder}/events")
    status = {r["fact"]: r["n"] for r in s.memory_status().collect()}
    assert status["orphaned anchors"] == 1 and status["events: pinned"] == 1
    ranked = s.query("first words", k=4, strategy="human-like")
    assert {"displacement", "history", "movement"} <= set(ranked.columns) and ranked.where("history is not null").isEmpty()


def test_other_vectors_are_refused(spark, tmp_path):
    from lorekeep.functions.embedding import HashingEmbedder

    root = tmp_path / "logs"
    write(root / "p" / "a.jsonl", [record(1, "a")])
    Store(spark, str(tmp_path / "s")).build(str(root))
    other = Store(spark, str(tmp_path / "s"), HashingEmbedder(8))
    with pytest.raises(ValueError, match="rebuild"):
        other.build(str(root))
    assert other.build(str(root), full=True).version == 2 and len(other.stored_chunks().first()["embedding"]) == 8


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from lorekeep.__main__ import main

    root, folder = tmp_path / "logs", str(tmp_path / "store")
    write(root / "p" / "a.jsonl", [record(i, "a", text=f"keeper of lore {i}") for i in range(3)])
    run = lambda *args: main(["--folder", folder, *args], spark)
    assert run("build", str(root), "--audit", "--quiet") == 0
    assert run("query", "keeper of lore", "--all-projects", "--k", "2", "--format", "json", "--record") == 0
    shown = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert shown["project"] == "p" and len(shown["presentation"]) == 32
    assert run("query", "keeper of lore") == 4  # the working directory's project has no logs
    assert run("query", "x", "--k", "0", "--all-projects") == 2 and run("query", "x", "--strategy", "bold", "--all-projects") == 2
    assert run("memory") == 0 and "events: shown" in capsys.readouterr().out


def test_event_log_round_trip_and_prune(spark, tmp_path):
    e = spark.createDataFrame([(1, "a1", "opened"), (2, "a2", "shown")], "seq long, anchor string, kind string")
    e = e.select("*", F.lit("g").alias("generation"), F.lit(None).cast("string").alias("note_ref"), F.lit("archival").alias("policy"), F.lit("p").alias("presentation"), F.timestamp_seconds(F.lit(1)).alias("ts"))
    path = str(tmp_path / "log")
    events.append(e, path)
    (tmp_path / "log" / "part-zz.txt").write_text('{"kind":"opened"}\nnot json\n{"anchor":"a","extra":1}\n')
    told = {r["status"]: r for r in events.prune(spark, path, str(tmp_path / "kept"), F.col("anchor") == "a2").collect()}
    assert {k: r["n"] for k, r in told.items()} == {"ok": 1, "corrupt": 3, "superseded": 1}
    assert told["corrupt"]["lines"] == [f"part-zz.txt:{n}" for n in (1, 2, 3)] and told["ok"]["lines"] == [] and len(told["superseded"]["lines"]) == 1
    assert spark.read.text(str(tmp_path / "kept")).count() == 1


def test_stream_reads_each_file_once(spark, tmp_path):
    root = tmp_path / "logs"
    write(root / "p" / "a.jsonl", [record(i, "a") for i in range(3)])
    for n in (3, 5):
        stream_turns(spark, str(root), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        write(root / "p" / "b.jsonl", [record(i, "b") for i in range(2)])


def test_windows(spark):
    e = spark.createDataFrame([("opened", "2024-01-01 00:10:00"), ("opened", "2024-01-01 00:50:00"), ("shown", "2024-01-01 01:10:00")], "kind string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in windowed_usage(e).collect()) == [1, 2]
