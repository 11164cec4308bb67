"""Named queries over ingest, the store's batches, results and sinks, each with the SQL that it is held against.

Documents stand for lines of logs: a source is a log, its lines are numbered by their documents' ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as fn
from lorekeep.functions.embedding import HashingEmbedder, embedded
from lorekeep.operators import index, retrieval
from lorekeep.plans import oracles
from lorekeep.plans.catalog import QUERIES, asked, chunks, search_index, usage
from lorekeep.sources import events as event_log
from lorekeep.sources import logs, sinks
from lorekeep.sources.shipping import ship_package
from lorekeep.sources.tables import scratch_folder, table, written
from lorekeep.streaming.ingest import Batches

#: The project that can't be listed.
UNREADABLE = "p4"
#: Batches that a build is cut into, and cuts within the logs.
BATCHES, CUTS = 10, 8
#: Queries whose recall blocks fit as they are, by shorter snippets, and by fewer entries.
RECALLED = [(1, "thing", 40, None), (2, "of the", 200, None), (3, "th", 10, None), (4, "de la", 5, "p1")]


# -- ingest -----------------------------------------------------------------------------------------------------------


def _class() -> Column:
    """What has happened to a log since the last build: 0 it is new, 1 rewritten, 2 the same, else it grew."""
    return F.ascii(F.right("source", F.lit(1))) % 5


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_key, project, line_no, raw, bytes, complete, class) as ``logs.read_lines`` gives them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("text", F.lit("")).alias("raw"))
    project = F.concat(F.lit("p"), F.length("source"))
    return d.select(
        F.concat(project, F.lit("/"), "source", F.lit(".jsonl")).alias("source_key"), project.alias("project"), F.col("doc_id").alias("line_no"), "raw",
        (F.octet_length("raw") + 1).alias("bytes"), F.lit(True).alias("complete"), _class().alias("class"),
    )


def _earlier_state(lines: DataFrame) -> DataFrame:
    """Cursors of the last build: behind the first half of the ids, or all; of other texts where a log was rewritten; and
    of logs that are gone."""
    last = F.max("line_no")
    cuts = lines.where("class <> 0").groupBy("source_key", "class").agg(F.when(F.col("class") == 2, last + 1).otherwise(F.floor(last / 2) + 1).alias("cut"))
    before = lines.withColumn("raw", F.when(F.col("class") == 1, F.reverse("raw")).otherwise(F.col("raw")))
    state = written(logs.cursors_at(before, cuts.select("source_key", "cut", F.lit(0).alias("batch"))).drop("batch"))
    unmoved = cuts.where("class = 2").select("source_key")
    gone = state.join(unmoved, "source_key", "left_semi").withColumn("source_key", F.replace("source_key", F.lit("/"), F.lit("/old-")))
    return state.unionByName(gone)


def _pending(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lines, found sources, actions by source, and the lines that a build has to take in."""
    lines = log_lines(spark, sf_dir)
    state = written(_earlier_state(lines))
    found = written(logs.found_sources(lines, state))
    actions = written(index.manifest_difference(found, state, spark.createDataFrame([(UNREADABLE,)], "project string")))
    todo = actions.where("action in ('new', 'rewritten', 'appended')").select("source_key")
    done = actions.where("action = 'appended'").join(state, "source_key").select("source_key", "processed_lines")
    return lines, found, actions, logs.tails(lines.join(todo, "source_key", "left_semi"), done)


def incremental_scan(spark, sf_dir):
    """What a scan finds of each log, and how many lines of it are to be taken in, from which on (-1: none)."""
    _, found, actions, pending = _pending(spark, sf_dir)
    told = pending.groupBy("source_key").agg(F.count(F.lit(1)).alias("n_pending"), F.min("line_no").cast("long").alias("first_pending"))
    sized = actions.join(found.select("source_key", "size", F.col("lines").alias("n_lines")), "source_key", "left").join(told, "source_key", "left")
    return sized.select("source_key", "action", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("size", "n_lines", "n_pending")], F.coalesce("first_pending", F.lit(-1)).alias("first_pending"))


def batch_borders(spark, sf_dir):
    """Where batches begin and end in each log, and the cursor of logs that go on in a later batch (-1: none)."""
    lines, found, actions, pending = _pending(spark, sf_dir)
    pending = written(pending.select("source_key", "project", "line_no"))
    rank = F.when(F.col("action") == "appended", 0).when(F.col("action") == "new", 1).otherwise(2)
    todo = written(actions.where("action in ('new', 'rewritten', 'appended', 'vanished')").withColumn("rank", rank))
    batches = Batches.of(spark, pending, todo, lines, found, pending.count() // BATCHES + 1)
    placed = batches.turns.groupBy("source_key", F.col("batch").cast("int").alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").cast("long").alias("first_line"), F.max("line_no").cast("long").alias("last_line")
    )
    cuts = batches.cuts.select("source_key", F.col("batch").cast("int").alias("batch"), F.col("processed_lines").alias("cursor"))
    return placed.join(cuts, ["source_key", "batch"], "left").withColumn("cursor", F.coalesce("cursor", F.lit(-1)))


def batch_cursors(spark, sf_dir):
    """Cursors at several cuts within each log, with the additive checksums of what they cover."""
    lines = log_lines(spark, sf_dir)
    most = lines.agg(F.max("line_no")).first()[0] or 0
    cuts = lines.groupBy("source_key", F.floor(F.col("line_no") * CUTS / (most + 1)).cast("int").alias("batch")).agg((F.max("line_no") + 1).alias("cut"))
    return logs.cursors_at(lines, cuts).select("source_key", "batch", "processed_lines", "processed_bytes", "prefix_hash")


_LINES = """WITH d0 AS (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(text, '') AS t FROM documents),
d AS (SELECT doc_id, t, strlen(t) + 1 AS bytes, 'p' || length(source) AS project, 'p' || length(source) || '/' || source || '.jsonl' AS source_key, ascii(right(source, 1)) % 5 AS class FROM d0)"""
_SCAN = f"""{_LINES},
f AS (SELECT *, CASE WHEN class = 2 THEN max(doc_id) OVER w + 1 ELSE max(doc_id) OVER w // 2 + 1 END AS cut FROM d WINDOW w AS (PARTITION BY source_key)),
s AS (SELECT source_key, project, class, any_value(cut) AS cut, sum(bytes) AS size, count(*) AS n_lines, count(*) FILTER (doc_id < cut) AS covered FROM f GROUP BY ALL),
a AS (SELECT *, CASE WHEN class = 0 OR covered = 0 THEN 'new' WHEN class = 1 THEN 'rewritten' WHEN covered < n_lines THEN 'appended' ELSE 'same' END AS action FROM s),
p AS (SELECT d.source_key, doc_id, action FROM d JOIN a ON a.source_key = d.source_key WHERE t <> '' AND (action IN ('new', 'rewritten') OR action = 'appended' AND doc_id >= cut))"""


# -- results ----------------------------------------------------------------------------------------------------------


def _told_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("chunk_id")
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.pmod(i, F.lit(28))).cast("string"), 2, "0"))
    return chunks(spark, sf_dir).select("*", F.concat(F.lit("u"), i).alias("uuid"), day.alias("ts"), F.array(F.concat(F.lit("s"), F.pmod(i, F.lit(9)))).alias("sessions"))


def pointered_json(spark, sf_dir):
    """Search results as JSON lines, read back: pointers, snippets of one line, scores."""
    hits = retrieval.search(search_index(spark, sf_dir), asked(spark), channels=("trigram", "segment"))
    page = sinks.pointered(hits, _told_chunks(spark, sf_dir))
    back = F.from_json("line", "qid int, pos int, project string, uuid string, ts string, snippet string, score double, band int, channels array<string>, sessions array<string>")
    r = sinks.json_lines(page).select(back.alias("r")).select("r.*")
    return r.select("qid", "pos", "project", "uuid", "ts", "snippet", F.round("score", 9).alias("score"), "band", F.array_join("channels", ",").alias("channels"), F.array_join("sessions", ",").alias("sessions"))


def recall_blocks(spark, sf_dir):
    """The recall block of each query's results (a page of at most a thousand)."""
    hits = retrieval.search(search_index(spark, sf_dir), asked(spark, RECALLED), channels=("trigram", "segment"))
    page = written(sinks.pointered(hits, _told_chunks(spark, sf_dir), sinks.LONGEST))
    blocks = [(q[0], sinks.recall_block(page.where(F.col("qid") == q[0]))) for q in RECALLED]
    told = spark.createDataFrame(blocks, "qid int, block string")
    return told.select("qid", F.length("block").cast("long").alias("n_chars"), (F.size(F.split("block", "\n")) - 2).cast("long").alias("n_entries"), F.sha2("block", 256).alias("block_sha256"))


def sound_chunks(spark, sf_dir):
    """Chunks that a result may name: those of malformed rows may not."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        i.alias("chunk_id"), F.when(i % 7 == 0, F.concat(F.lit("bad id "), i)).when(i % 7 != 1, F.concat(F.lit("u."), i)).alias("uuid"),
        F.when(i % 11 == 0, F.lit("xyz")).otherwise(fn.fingerprint(F.col("source"))).alias("project_fingerprint"), F.when(i % 17 == 0, F.lit("  ")).otherwise(F.col("text")).alias("text"),
        F.when(i % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("s"))).alias("sessions"),
    )
    return rows.select("chunk_id", index.is_sound().alias("sound"))


def working_projects(spark, sf_dir):
    """The project that is asked of a working directory, and what a search in it would look through."""
    directory = F.concat(F.lit("/w/"), "lang", F.lit("/"), "source")
    return table(spark, sf_dir, "documents").groupBy(fn.project_of_directory(directory).alias("project")).agg(F.count(F.lit(1)).alias("n"))


def embedding_lengths(spark, sf_dir):
    """Dimension and length of each text's vector: zero without words, else one."""
    ship_package(spark)
    v = table(spark, sf_dir, "documents").select("doc_id", embedded(F.col("text"), HashingEmbedder()).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return v.select("doc_id", F.when(F.col("v").isNotNull(), F.size("v")).otherwise(0).alias("dimension"), F.coalesce(F.round(F.sqrt(square), 5), F.lit(0.0)).alias("length"))


def pruned_log(spark, sf_dir):
    """A usage log appended to, with lines that are not canonical between, pruned and read again: lines by status before
    and after."""
    e = usage(spark, sf_dir).withColumn("generation", F.lit("g1")).withColumn("policy", F.lit("archival")).withColumn("note_ref", F.lit(None).cast("string"))
    folder = f"{scratch_folder(spark)}/log-{uuid.uuid4().hex}"
    event_log.append(e.where("seq % 10 <> 0"), f"{folder}/log")
    event_log.to_lines(e.where("seq % 10 = 0")).select(F.concat("line", F.lit(" ")).alias("value")).write.mode("append").text(f"{folder}/log")
    superseded = F.col("anchor").startswith("1")
    before = event_log.prune(spark, f"{folder}/log", f"{folder}/pruned", superseded)
    after = event_log.faults(event_log.salvage(event_log.read_log(spark, f"{folder}/pruned"), superseded))
    return before.select(F.lit("before").alias("log"), "status", "n").unionByName(after.select(F.lit("after").alias("log"), "status", "n"))


_POINTERED = """SELECT o.qid, o.pos, o.k, 'p' || (d.doc_id % 5) AS project, 'u' || d.doc_id AS uuid, '2024-01-' || lpad((1 + d.doc_id % 28)::VARCHAR, 2, '0') AS ts, replace(d.text, chr(10), ' ') AS flat,
    round(score, 9) AS score, band, channels, 's' || (d.doc_id % 9) AS sessions FROM o JOIN documents d ON d.doc_id = o.chunk_id WHERE o.pos < o.k"""


STORE_QUERIES = {
    "incremental_scan": incremental_scan, "batch_borders": batch_borders, "batch_cursors": batch_cursors, "pointered_json": pointered_json, "recall_blocks": recall_blocks,
    "sound_chunks": sound_chunks, "working_projects": working_projects, "embedding_lengths": embedding_lengths, "pruned_log": pruned_log,
}

STORE_ORACLES = {
    "incremental_scan": f"""{_SCAN},
n AS (SELECT source_key, count(*) AS n_pending, min(doc_id) AS first_pending FROM p GROUP BY 1)
SELECT source_key, action, size::BIGINT AS size, n_lines, coalesce(n_pending, 0) AS n_pending, coalesce(first_pending, -1) AS first_pending FROM a LEFT JOIN n USING (source_key)
UNION ALL SELECT replace(source_key, '/', '/old-'), CASE WHEN project = '{UNREADABLE}' THEN 'kept' ELSE 'vanished' END, 0, 0, 0, -1 FROM a WHERE class = 2""",
    "batch_borders": f"""{_SCAN},
z AS (SELECT count(*) // {BATCHES} + 1 AS size FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY CASE action WHEN 'appended' THEN 0 WHEN 'new' THEN 1 ELSE 2 END, source_key, doc_id) - 1 AS nth FROM p),
b AS (SELECT *, CASE WHEN action = 'rewritten' THEN max(nth // size) OVER (PARTITION BY source_key) ELSE nth // size END AS batch FROM r, z),
g AS (SELECT source_key, action, batch::INT AS batch, count(*) AS n, min(doc_id) AS first_line, max(doc_id) AS last_line FROM b GROUP BY ALL)
SELECT source_key, batch, n, first_line, last_line, CASE WHEN batch < max(batch) OVER (PARTITION BY source_key) THEN last_line + 1 ELSE -1 END AS cursor FROM g""",
    "batch_cursors": f"""{_LINES},
m AS (SELECT max(doc_id) + 1 AS m FROM documents),
h AS (SELECT *, doc_id * {CUTS} // m AS batch, sha256(doc_id || ':' || t) AS digest FROM d, m),
g AS (SELECT source_key, batch, max(doc_id) + 1 AS cut, sum(bytes) AS bytes, sum(('0x' || digest[1:15])::BIGINT) AS a, sum(('0x' || digest[16:30])::BIGINT) AS b FROM h GROUP BY ALL)
SELECT source_key, batch::INT AS batch, cut AS processed_lines, (sum(bytes) OVER w)::BIGINT AS processed_bytes, (sum(a) OVER w)::HUGEINT || '-' || (sum(b) OVER w)::HUGEINT AS prefix_hash FROM g WINDOW w AS (PARTITION BY source_key ORDER BY batch)""",
    "pointered_json": f"""{oracles._lexical(QUERIES)}{oracles._fused("rt", "rs")}, t AS ({_POINTERED})
SELECT qid, pos, project, uuid, ts, CASE WHEN length(flat) > 160 THEN flat[1:160] || '…' ELSE flat END AS snippet, score, band, channels, sessions FROM t""",
    "recall_blocks": f"""{oracles._lexical(RECALLED)}{oracles._fused("rt", "rs")}, t AS ({_POINTERED}),
cut AS (SELECT *, CASE WHEN length(flat) > {sinks.LONGEST} THEN flat[1:{sinks.LONGEST}] || '…' ELSE flat END AS snippet FROM t),
l AS (SELECT qid, pos, size, '- [' || project || '] ' || uuid || ' ' || ts || ': ' || CASE WHEN length(snippet) <= size THEN snippet ELSE snippet[1:size - 1] || '…' END AS line FROM cut, (SELECT unnest([200, 100, 50, 25, 20]) AS size)),
u AS (SELECT *, {len(sinks.OPEN) + 1 + len(sinks.CLOSE)} + sum(length(line) + 1) OVER (PARTITION BY qid, size ORDER BY pos) AS upto FROM l),
w AS (SELECT qid, size, max(upto) <= {sinks.MOST_CHARS} AS fits FROM u GROUP BY ALL), k AS (SELECT qid, coalesce(max(size) FILTER (fits), 20) AS size FROM w GROUP BY 1),
x AS (SELECT u.qid, count(*) AS n_entries, '{sinks.OPEN}' || chr(10) || string_agg(line, chr(10) ORDER BY pos) || chr(10) || '{sinks.CLOSE}' AS block FROM u JOIN k ON k.qid = u.qid AND k.size = u.size WHERE upto <= {sinks.MOST_CHARS} GROUP BY 1),
e AS (SELECT q0.qid, coalesce(n_entries, 0) AS n_entries, coalesce(block, '{sinks.OPEN}' || chr(10) || '{sinks.CLOSE}') AS block FROM q0 LEFT JOIN x ON x.qid = q0.qid)
SELECT qid, length(block) AS n_chars, n_entries, sha256(block) AS block_sha256 FROM e""",
    "sound_chunks": "SELECT doc_id AS chunk_id, doc_id % 7 NOT IN (0, 1) AND doc_id % 11 <> 0 AND source IS NOT NULL AND doc_id % 17 <> 0 AND coalesce(trim(text), '') <> '' AND doc_id % 13 <> 0 AS sound FROM documents",
    "working_projects": "SELECT '-w-' || lang || '-' || source AS project, count(*) AS n FROM documents GROUP BY 1",
    "embedding_lengths": "SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN 64 ELSE 0 END::INT AS dimension, CASE WHEN regexp_matches(text, '\\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM documents",
    "pruned_log": oracles._USAGE
    + """, s AS (SELECT CASE WHEN seq % 10 = 0 THEN 'corrupt' WHEN anchor LIKE '1%' THEN 'superseded' ELSE 'ok' END AS status, count(*) AS n FROM e0 GROUP BY 1)
SELECT 'before' AS log, status, n FROM s UNION ALL SELECT 'after', status, n FROM s WHERE status = 'ok'""",
}
