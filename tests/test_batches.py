"""Batches within sources, merged versions, owed audits, refused stamps, unreadable projects, and what an answer tells."""

import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.embedding import HashingEmbedder
from lorekeep.functions.words import Lexicon
from lorekeep.operators import memory, postings
from lorekeep.service import Service
from lorekeep.sources import logs
from lorekeep.streaming import ingest
from lorekeep.streaming.ingest import AuditFailed, Published, StampMismatch, Store, numbered_pieces
from tests.test_store import _contents, record, write


@pytest.fixture(autouse=True)
def few_files(monkeypatch):
    monkeypatch.setattr(postings.Layout, "of", staticmethod(lambda n: postings.Layout(2, 1)))


def _sums(store):
    p = store.published()
    stored = store.stored_chunks(p).agg(F.count(F.lit(1)), F.coalesce(F.sum("n_trigrams"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    carried = store._read("statistics", ingest._STATISTICS, p).where(F.col("v") == p.v).drop("v").first()
    return tuple(stored), tuple(carried)


def test_a_source_is_split_between_batches(spark, tmp_path):
    root = tmp_path / "logs"
    write(root / "p" / "big.jsonl", [record(i, "s", type="summary" if i % 4 == 3 else "user") for i in range(14)])  # 11 chunks among 14 lines
    write(root / "p" / "one.jsonl", [record(50, "t")])
    store, seen = Store(spark, str(tmp_path / "s")), []

    def look(text):
        if text.startswith("batch"):
            p = store.published()
            cursor = {r["source_key"]: r["processed_lines"] for r in store.state(p).collect()}
            seen.append((store.stored_chunks(p).count(), cursor))

    report = store.build(str(root), batch_chunks=5, progress=look)
    assert report.batches == 3 and [n for n, _ in seen] == [5, 10, 12]  # each batch is a readable state of at most its size more
    assert [c.get("p/big.jsonl") for _, c in seen] == [6, 13, 14] and "p/one.jsonl" not in seen[1][1]
    # a build that stopped behind the first batch goes on from the cut
    half = Store(spark, str(tmp_path / "h"))
    half.build(str(root), batch_chunks=5)
    for v in (2, 3):
        shutil.rmtree(tmp_path / "h" / "meta" / f"v={v}")
    assert half.published().v == 1 and half.build(str(root), batch_chunks=5).actions == {"appended": 1, "new": 1}
    whole = Store(spark, str(tmp_path / "w"))
    whole.build(str(root))
    assert _contents(half) == _contents(store) == _contents(whole) and _sums(half)[0] == _sums(half)[1] == _sums(whole)[0]
    assert store.audit().where("n > 0").isEmpty()


def test_random_changes_in_small_batches_equal_a_full_build(spark, tmp_path):
    rng = random.Random(5)
    root, files = tmp_path / "logs", {}
    grown = Store(spark, str(tmp_path / "grown"))
    for step in range(2):
        for _ in range(3):
            kind = rng.choice(["create", "append", "rewrite", "delete", "copy"]) if len(files) > 1 else "create"
            name = f"p{rng.randrange(2)}/f{step}{rng.randrange(9)}" if kind in ("create", "copy") else rng.choice(sorted(files))
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
        report = grown.build(str(root), batch_chunks=3, merge_after=4)
        assert _sums(grown)[0] == _sums(grown)[1]
    assert report.version > 3
    whole = Store(spark, str(tmp_path / "whole"))
    whole.build(str(root))
    assert _contents(grown) == _contents(whole) and _sums(grown) == _sums(whole)
    asked = spark.createDataFrame([(i, t, 5, None, 0) for i, t in enumerate(["共通詞", "keyword1", "keyword3", "內容"])], "qid int, text string, k int, project string, variant int")
    for channel in postings.LEXICAL:
        found = [sorted(map(tuple, postings.matches(s.search_index(), asked, channel).collect())) for s in (grown, whole)]
        assert found[0] == found[1] and (found[0] or channel == "segment")


def test_a_merge_keeps_everything_in_one_version(spark, tmp_path):
    root = tmp_path / "logs"
    store = Store(spark, str(tmp_path / "s"))
    for n in (3, 6):
        write(root / "p" / "a.jsonl", [record(i, "a") for i in range(n)])
        store.build(str(root))
    before, links = _contents(store), _sums(store)
    assert store.merge() == 3 and store.published() == Published(3, 3, postings.Layout(2, 1))
    assert _contents(store) == before and _sums(store) == links and store.audit().where("n > 0").isEmpty()
    assert store.search_index().tables["segment"].select("v").distinct().count() == 1
    assert set(store.build(str(root)).actions) == {"same"}
    write(root / "p" / "a.jsonl", [record(i, "a") for i in range(8)])
    assert store.build(str(root)).actions == {"appended": 1} and store.published().base == 3 and store.stored_chunks().count() == 8
    report = store.build(str(root), full=True, merge_after=0)
    assert report.merged and store.published().base == report.version and store.stored_chunks().count() == 8


def test_pieces_are_numbered_without_one_task_for_all(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), f"s{rng.randrange(40):02d}", k, rng.randrange(1, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "rank int, source_key string, piece long, n long").repartition(7)
    got = {(r["rank"], r["source_key"], r["piece"]): r["before"] for r in numbered_pieces(df).collect()}
    before = 0
    for rank, key, piece, n in sorted(rows):
        assert got[rank, key, piece] == before
        before += n
    assert numbered_pieces(df.where("false")).count() == 0


def test_a_failed_audit_is_owed_until_a_clean_one(spark, tmp_path):
    root = tmp_path / "logs"
    write(root / "p" / "a.jsonl", [record(i, "a") for i in range(3)])
    s = Service(spark, str(tmp_path / "store"))
    s.build(str(root), audit=True)
    assert s.store.owes_audit() is None
    s.query("keyword1", k=2)
    assert s.notice.audit_owed is None and s.notice.lines() == []
    # a count that the links don't bear out
    wrong = s.store.stored_chunks().withColumn("source_count", F.lit(7).cast("long"))
    s.store._write(wrong.cache(), "chunks", 1)
    write(root / "p" / "a.jsonl", [record(i, "a") for i in range(4)])
    with pytest.raises(AuditFailed) as failed:
        s.build(str(root), audit=True)
    assert failed.value.figures and s.store.owes_audit()
    with pytest.raises(AuditFailed):  # increments now audit first, and fail as long as it isn't clean
        s.build(str(root))
    assert s.store.version() == 1
    s.query("keyword1", k=2)
    assert s.notice.audit_owed and "an audit is owed since" in s.notice.lines()[0]
    s.build(str(root), full=True)  # from scratch, and audited because one is owed
    assert s.store.owes_audit() is None and s.store.stored_chunks().count() == 4
    s.query("keyword1", k=2)
    assert s.notice.audit_owed is None


@pytest.mark.parametrize("stamp", ["layout", "embedding", "lexicon"])
def test_each_other_stamp_is_refused_by_name(spark, tmp_path, monkeypatch, stamp):
    root = tmp_path / "logs"
    write(root / "p" / "a.jsonl", [record(1, "a", text="記憶釘選")])
    Store(spark, str(tmp_path / "s")).build(str(root))
    other = {"embedding": {"embedder": HashingEmbedder(8)}, "lexicon": {"lexicon": Lexicon.of([("記憶", 2), ("釘選", 1)])}, "layout": {}}[stamp]
    if stamp == "layout":
        monkeypatch.setattr(ingest, "LAYOUT", 99)
    store = Store(spark, str(tmp_path / "s"), **other)
    for refused in (store.version, store.search_index, lambda: store.build(str(root)), store.audit, store.merge):
        with pytest.raises(StampMismatch, match="rebuild") as e:
            refused()
        assert e.value.stamp == stamp
    assert store.build(str(root), full=True).version == 2
    if stamp == "lexicon":
        asked = spark.createDataFrame([(1, "憶釘", 5, None, 0), (2, "釘選", 5, None, 0)], "qid int, text string, k int, project string, variant int")
        assert [r["qid"] for r in postings.matches(store.search_index(), asked, "segment").collect()] == [2]


def test_projects_that_cannot_be_listed_keep_what_they_have(spark, tmp_path, monkeypatch):
    root = tmp_path / "logs"
    write(root / "open" / "a.jsonl", [record(1, "a")])
    write(root / "shut" / "deep" / "b.jsonl", [record(2, "b"), record(3, "b")])
    store = Store(spark, str(tmp_path / "s"))
    assert store.build(str(root)).unreadable == []
    plain = logs._list

    def refusing(fs, path):
        if path.getName() == "deep":
            raise PermissionError("no permission")
        return plain(fs, path)

    monkeypatch.setattr(logs, "_list", refusing)
    write(root / "open" / "a.jsonl", [record(1, "a"), record(4, "a")])
    report = store.build(str(root))
    assert report.unreadable == ["shut"] and report.actions == {"appended": 1, "kept": 1} and store.stored_chunks().count() == 4
    monkeypatch.setattr(logs, "_list", lambda fs, path: (_ for _ in ()).throw(PermissionError("no permission")))
    with pytest.raises(ValueError, match="can't be listed"):  # a root that can't be read is not an empty one
        store.build(str(root))
    assert store.stored_chunks().count() == 4
    monkeypatch.setattr(logs, "_list", plain)
    shutil.rmtree(root / "shut")
    assert store.build(str(root)).actions == {"same": 1, "vanished": 1} and store.stored_chunks().count() == 2


def test_an_answer_beside_a_running_build_says_so(spark, tmp_path):
    root = tmp_path / "logs"
    write(root / "p" / "a.jsonl", [record(i, "a") for i in range(3)])
    s = Service(spark, str(tmp_path / "store"))
    s.build(str(root))
    write(root / "p" / "a.jsonl", [record(i, "a") for i in range(5)])
    s.store._beat("another", "batch 1")
    assert s.query("keyword1", k=5, root=str(root)).count() > 0
    assert s.notice.building and s.notice.refreshed is None and s.notice.version == 1 and "a build is running" in s.notice.lines()[0]
    s.store._beat("another", "done")
    s.query("keyword1", k=5, root=str(root))
    assert not s.notice.building and s.notice.refreshed.actions == {"appended": 1} and s.notice.lines() == ["taken in: 1 appended"]
    old = spark.createDataFrame([("dead", "batch 1", "2020-01-01 00:00:00")], "build string, doing string, at string").withColumn("at", F.to_timestamp("at"))
    old.write.mode("append").parquet(f"{s.folder}/index/beats")
    assert not s.store.running()  # a build that fell silent long ago is not running


def test_pairs_that_spread_differently_are_not_compared(spark, tmp_path):
    root = tmp_path / "logs"
    write(root / "p" / "a.jsonl", [record(i, "a", text=f"keeper of lore {i}") for i in range(4)])
    s = Service(spark, str(tmp_path / "store"))
    s.build(str(root))
    with pytest.raises(ValueError, match="spread differently"):
        s.compare("keeper", "human-like", "conservative", k=3)
    for pair in (("archival", "human-like"), ("conservative", "archival")):
        assert s.compare("keeper", *pair, k=3)[1].count() == 3


def test_strengths_of_a_page_equal_those_of_the_whole_log(spark, tmp_path):
    root = tmp_path / "logs"
    write(root / "p" / "a.jsonl", [record(i, "a", text=f"keeper of lore {i}") for i in range(8)])
    s = Service(spark, str(tmp_path / "store"))
    s.build(str(root))
    ids = [r[0] for r in s.store.stored_chunks().select("chunk_id").orderBy("chunk_id").collect()]
    rng = random.Random(4)
    rows = [(rng.choice(memory.KINDS), rng.choice([*ids, 111, 222]), f"x{rng.randrange(6)}") for _ in range(120)]
    df = spark.createDataFrame(rows, "kind string, anchor long, presentation string").select("kind", "anchor", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("g").alias("generation"), F.lit("p").alias("policy"), F.lit(None).cast("string").alias("note_ref"), "presentation")
    df.write.parquet(f"{s.folder}/events")
    page = spark.createDataFrame([(i,) for i in ids[:3]], "anchor long")
    corpus = s.store.stored_chunks().select(F.col("chunk_id").alias("anchor"))
    for spreading in (0.0, 0.3):
        whole = memory.project(s.events(), F.current_timestamp(), memory.Parameters(spreading=spreading), corpus).join(page, "anchor", "left_semi")
        pick = lambda d: {r["anchor"]: (round(r["net"], 6), r["impressions"]) for r in d.collect()}
        assert pick(s._strengths(page, spreading)) == pick(whole)


def test_an_archival_query_reads_no_history(spark, tmp_path, monkeypatch):
    root = tmp_path / "logs"
    write(root / "p" / "a.jsonl", [record(i, "a", text=f"keeper of lore {i}") for i in range(4)])
    s = Service(spark, str(tmp_path / "store"))
    s.build(str(root))
    monkeypatch.setattr(Service, "events", lambda self: pytest.fail("history was read"))
    monkeypatch.setattr(Service, "_strengths", lambda *a: pytest.fail("history was read"))
    assert s.query("keeper", k=3).count() == 3


def test_command_line_tells_what_happened(spark, tmp_path, capsys):
    from lorekeep.__main__ import main

    root, folder = tmp_path / "logs", str(tmp_path / "store")
    write(root / "p" / "a.jsonl", [record(i, "a", text=f"keeper of lore {i}") for i in range(3)] + ["{broken"])
    run = lambda *args: main(["--folder", folder, *args], spark)
    assert run("query", "keeper", "--all-projects", "--root", str(root), "--format", "json") == 0
    told = capsys.readouterr()
    assert "taken in: 1 new" in told.err and "skipped: 1 unparseableLine" in told.err and json.loads(told.out.strip().splitlines()[0])["project"] == "p"
    assert run("compare", "keeper", "--all-projects", "--strategies", "human-like", "conservative") == 2
    assert run("build", str(root), "--audit", "--quiet", "--batch-chunks", "1") == 0 and "orphan" in capsys.readouterr().out


def test_a_prompt_hook_tells_a_label_and_a_text(spark, tmp_path):
    root = tmp_path / "logs"
    write(root / "p" / "a.jsonl", [record(i, "a", text=f"keeper of lore {i}") for i in range(4)])
    s = Service(spark, str(tmp_path / "store"))
    hook = lambda prompt, mode="cued": s.recall(prompt, ["keeper"], ["/cmd"], mode, k=2)
    label, why = hook("the keeper")
    assert label == "notice" and why and "\n" not in why  # there is no index yet: said, not raised
    s.build(str(root))
    assert hook("keeper of lore")[0] == "hit" and "keeper of lore" in hook("keeper of lore")[1]
    assert hook("nothing") == ("miss", "") and hook("/cmd keeper") == ("synthetic", "") and hook("keeper", "off") == ("off", "")
    assert hook("of lore", "always")[0] == "hit" and hook("of lore", "loud")[0] == "miss"
