"""Incremental ingest into a log-structured store, and streams.

A store is a folder of append-only Parquet datasets, each partitioned by build number ``v``:
``turns`` (observations), ``gone`` (sources that a build invalidated), ``state`` (cursors that a build moved), ``chunks`` (those
that a build touched, with sessions, lengths and vector), ``stale`` (chunks of earlier builds that it replaced), postings
by channel, ``statistics`` (sums, carried on from build to build), and ``meta`` (written last: a build without its meta row
never happened, and queries beside a running build read the last one). A build reads tails of what grew and files that
are new or rewritten, and writes what they touch alone. Nothing before the ``base`` that a meta row names counts any more: a
full build begins a base, and so does ``merge``, which writes what counts as one version once there are ``merge_after``.

Beside them are two logs: ``beats`` (what a build is doing, by which others see it run) and ``audits`` (whether an audit is owed).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.embedding import EmbeddingProvider, HashingEmbedder, embedded
from lorekeep.functions.words import Lexicon
from lorekeep.operators import index, postings
from lorekeep.operators.postings import Layout
from lorekeep.sources import logs
from lorekeep.sources.shipping import ship_package
from lorekeep.sources.tables import scratch_folder, written

LAYOUT = 4
#: Chunks that a batch merges at most, but for a rewritten source, which is merged whole.
BATCH_CHUNKS = 1_000_000
#: Lines that are numbered as one piece, and seconds after which a silent build no longer counts as running.
PIECE = 4096
SILENT = 900
_STATE = "source_key string, project string, prefix_hash string, processed_bytes long, processed_lines long"
_TURNS = "project string, project_fingerprint string, uuid string, source_key string, session_id string, ts timestamp, role string, text string, seq string"
_CHUNKS = "chunk_id long, project_fingerprint string, uuid string, project string, role string, text string, ts timestamp, source_count long, sessions array<string>, n_trigrams int, n_tokens int, embedding array<float>"
_STATISTICS = "n long, trigrams long, tokens long"
_META = "layout int, embedding string, lexicon string, base int, buckets int, blocks int"
_POSTINGS = "term string, chunk_id long, project string, dl int, tf int, positions array<int>, block int, bucket int"
_KEY = ["project_fingerprint", "uuid"]


class StampMismatch(ValueError):
    """The store was written for something else; ``stamp`` says what: layout, embedding or lexicon."""

    def __init__(self, stamp: str, stored: object, expected: object):
        super().__init__(f"the store's {stamp} is {stored}, not {expected}: rebuild it in full")
        self.stamp = stamp


class AuditFailed(ValueError):
    """An audit found differences; from then on one is owed. ``figures``: how many of each kind."""

    def __init__(self, figures: dict[str, int]):
        super().__init__(f"the audit found differences: {figures}; rebuild the store in full")
        self.figures = figures


@dataclass
class BuildReport:
    version: int
    actions: dict[str, int]
    skipped: dict[str, int]
    unreadable: list[str] = field(default_factory=list)
    unmerged: int = 0
    batches: int = 0
    merged: bool = False


@dataclass(frozen=True)
class Published:
    """A version that queries may read: builds ``base`` to ``v`` count."""

    v: int = 0
    base: int = 0
    layout: Layout = Layout()


class Store:
    """The index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, embedder: EmbeddingProvider | None = None, lexicon: Lexicon | None = None):
        self.spark, self.folder, self.embedder, self.lexicon = spark, folder.rstrip("/"), embedder or HashingEmbedder(), lexicon

    # -- datasets

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as missing:  # the dataset begins with the first build that has rows for it
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def _read(self, name: str, schema: str, p: Published) -> DataFrame:
        return self._table(name, f"{schema}, v int").where(F.col("v").between(p.base, p.v))

    def _write(self, df: DataFrame, name: str, v: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v={v}")

    @property
    def stamps(self) -> dict[str, object]:
        return {"layout": LAYOUT, "embedding": self.embedder.revision, "lexicon": self.lexicon.revision if self.lexicon else "none"}

    def published(self) -> Published:
        """The last version that was published (0 for an empty store); one with other stamps is refused."""
        rows = self._table("meta", f"{_META}, v int").orderBy(F.desc("v")).limit(1).collect()
        if not rows:
            return Published()
        for stamp, expected in self.stamps.items():
            if rows[0][stamp] != expected:
                raise StampMismatch(stamp, rows[0][stamp], expected)
        return Published(rows[0]["v"], rows[0]["base"], Layout(rows[0]["buckets"], rows[0]["blocks"]))

    def version(self) -> int:
        return self.published().v

    def _last(self) -> int:
        """The last version, whatever its stamps."""
        return self._table("meta", "layout int, v int").agg(F.max("v")).first()[0] or 0

    def _publish(self, p: Published) -> None:
        row = (*self.stamps.values(), p.base, p.layout.buckets, p.layout.blocks)
        self._write(self.spark.createDataFrame([row], _META), "meta", p.v)

    def state(self, p: Published | None = None) -> DataFrame:
        """Cursors: of each source that where the last build to touch it has left it."""
        p = p or self.published()
        fields = [c.split()[0] for c in _STATE.split(", ")]
        last = self._read("state", _STATE, p).groupBy("source_key").agg(F.max_by(F.struct(*fields[1:]), "v").alias("last"))
        return last.select("source_key", "last.*").where("processed_bytes is not null")

    def turns(self, p: Published | None = None) -> DataFrame:
        """Observations that count, as ``build_chunks`` takes them: those whose source no later build invalidated."""
        p = p or self.published()
        gone = self._read("gone", "source_key string", p).groupBy("source_key").agg(F.max("v").alias("since"))
        seen = self._read("turns", _TURNS, p)
        return seen.join(gone, "source_key", "left").where(F.col("since").isNull() | (F.col("v") >= F.col("since"))).drop("since", "v")

    def chunks(self) -> DataFrame:
        """Chunks worked out anew from all observations, for audits."""
        return index.build_chunks(self.turns())

    def links(self) -> DataFrame:
        return index.build_links(self.turns())

    def _stale(self, p: Published) -> DataFrame:
        return self._read("stale", "chunk_id long", p).groupBy("chunk_id").agg(F.max("v").alias("since"))

    def stored_chunks(self, p: Published | None = None, ids: list[int] | None = None) -> DataFrame:
        """Chunks as builds wrote them, each in its last state; those of ``ids`` alone, if given."""
        p = p or self.published()
        own, stale = self._read("chunks", _CHUNKS, p), self._stale(p)
        if ids is not None:
            own, stale = own.where(F.col("chunk_id").isin(ids)), stale.where(F.col("chunk_id").isin(ids))
        return own.join(stale, "chunk_id", "left").where(F.col("since").isNull() | (F.col("v") >= F.col("since"))).drop("since", "v")

    def search_index(self) -> postings.SearchIndex:
        p = self.published()
        sums = self._read("statistics", _STATISTICS, p).where(F.col("v") == p.v)
        each = lambda name: (F.col(name) / F.col("n")).alias
        statistics = sums.select("n", each("trigrams")("trigram_avgdl"), each("tokens")("segment_avgdl"))
        return postings.SearchIndex({c: self._read(f"postings/{c}", _POSTINGS, p) for c in postings.LEXICAL}, statistics, p.layout, self._stale(p), self.lexicon)

    # -- what others should know

    def _beat(self, build: str, doing: str) -> None:
        self.spark.createDataFrame([(build, doing)], "build string, doing string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.folder}/beats")

    def running(self) -> bool:
        """Whether a build that others began is at work: its last beat isn't its end, and is not older than ``SILENT`` seconds."""
        last = self._table("beats", "build string, doing string, at timestamp").groupBy("build").agg(F.max_by("doing", "at").alias("doing"), F.max("at").alias("at"))
        return not last.where((F.col("doing") != "done") & (F.col("at") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(SILENT))))).isEmpty()

    def owes_audit(self) -> str | None:
        """Since when an audit is owed, if one is: a failed audit leaves one owing, and only a clean one pays it."""
        last = self._table("audits", "owed boolean, at timestamp").orderBy(F.desc("at")).limit(1).select("owed", F.col("at").cast("string").alias("at")).collect()
        return last[0]["at"] if last and last[0]["owed"] else None

    def _owe(self, owed: bool) -> None:
        self.spark.createDataFrame([(owed,)], "owed boolean").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.folder}/audits")

    def audit(self) -> DataFrame:
        """The five figures of ``index.audit`` over what is stored: all zero on a sound store."""
        p = self.published()
        links, stored = self.links(), self.stored_chunks(p).select("chunk_id", "source_count")
        return index.audit(stored, links, index.source_counts(links), self.state(p))

    def require_audit(self) -> None:
        """Audits; differences are an error and leave an audit owing, a clean audit pays one."""
        figures = {r["figure"]: r["n"] for r in self.audit().collect()}
        owed = self.owes_audit()
        if any(figures.values()):
            if not owed:
                self._owe(True)
            raise AuditFailed({k: n for k, n in figures.items() if n})
        if owed:
            self._owe(False)

    def gate(self) -> None:
        """Refuses to go on from a store with chunks of no source or sources without a cursor."""
        p = self.published()
        index.coverage_gate(self.stored_chunks(p), self.turns(p).select("source_key"), self.state(p))

    # -- builds

    def build(
        self, root: str, full: bool = False, audit: bool = False, unreadable_projects: list[str] = (), batch_chunks: int = BATCH_CHUNKS, budget_seconds: float | None = None, merge_after: int = 16, progress: Callable[[str], None] | None = None,
    ) -> BuildReport:
        """Takes in what is new below ``root``; ``full``: everything anew. What a failed build has written is not seen and
        is written over.

        Chunks are merged in batches of ``batch_chunks``, sources that grew first, rewritten ones last; each batch is published
        by itself. A batch may end within a source, whose cursor then stands behind the last chunk that was taken. A
        rewritten source is merged whole, with the batch of its last chunk, so that it is never half there. With a budget,
        no batch begins after it, and rewritten sources wait for a build without one; ``unmerged`` counts the sources that
        are left. Projects that can't be listed, and those of ``unreadable_projects``, keep what the store has of them.

        Where an audit is owed or asked for, it comes first and must be clean; after a full build of a store that owes
        one, and after any that paid all, another decides whether it still does.
        """
        name, began, owed = uuid.uuid4().hex, time.monotonic(), self.owes_audit()
        tell = progress or (lambda text: None)
        p = Published(self._last()) if full else self.published()
        if p.v and not full:
            if audit or owed:
                self.require_audit()
            else:
                self.gate()
        self._beat(name, "reading")
        try:
            report = self._merge_all(name, root, p, full, list(unreadable_projects), batch_chunks, budget_seconds, tell, began)
            if (owed or full and audit) and not report.unmerged:
                self.require_audit()
            now = self.published()
            if now.v - now.base >= merge_after:
                report.version, report.merged = self.merge(), True
                tell(f"merged into version {report.version}")
            return report
        finally:  # failed or not, it is over
            self._beat(name, "done")

    def _merge_all(self, name: str, root: str, p: Published, full: bool, named: list[str], batch_chunks: int, budget: float | None, tell: Callable[[str], None], began: float) -> BuildReport:
        before = self.spark.createDataFrame([], _STATE) if full else self.state(p)
        paths, unreadable = logs.readable(self.spark, root)
        unreadable = sorted({*unreadable, *named})
        lines = logs.read_lines(self.spark, root, paths)
        found = written(logs.found_sources(lines, before))
        blocked = self.spark.createDataFrame([(x,) for x in unreadable], "project string")
        actions = written(index.manifest_difference(found, before, blocked))
        tally = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        report = BuildReport(p.v, tally, {}, unreadable)
        rank = F.when(F.col("action") == "appended", 0).when(F.col("action") == "new", 1).otherwise(2)
        todo = written(actions.where("action in ('new', 'rewritten', 'appended', 'vanished')").withColumn("rank", rank))
        n = todo.count()
        tell(f"{n} sources to merge, {tally.get('same', 0)} unchanged")
        if not n and p.v and not full:
            return report
        done = todo.where("action = 'appended'").join(before, "source_key").select("source_key", "processed_lines")
        pending = written(logs.classify(logs.tails(lines.join(todo.where("action <> 'vanished'").select("source_key"), "source_key", "left_semi"), done)))
        for r in logs.skip_tally(pending).collect():
            report.skipped[r["skip_reason"]] = r["n"]
        batches = Batches.of(self.spark, pending.where("skip_reason is null"), todo, lines, found, batch_chunks)
        for k in range(batches.count):
            late = budget is not None and time.monotonic() - began > budget
            if late or budget is not None and tally.get("rewritten") and batches.only_rewritten(k):
                report.unmerged = batches.left_from(k)
                break
            p = replace(p, v=p.v + 1) if p.base and not full else Published(p.v + 1, p.v + 1, Layout.of(batches.chunks))
            self._beat(name, f"batch {k + 1}")
            self._merge(p, batches.of_batch(k, budget is not None))
            full, report.version, report.batches = False, p.v, k + 1
            tell(f"batch {k + 1} of {batches.count}: version {p.v} after {time.monotonic() - began:.0f} s")
        else:
            report.unmerged = batches.rewritten() if budget is not None else 0
        return report

    def _merge(self, p: Published, own: Batch) -> None:
        """One batch as version ``p.v``."""
        v, earlier = p.v, replace(p, v=p.v - 1)
        self._write(logs.turns(own.turns), "turns", v)
        self._write(own.gone, "gone", v)
        self._write(own.cursors.select(*[c.split()[0] for c in _STATE.split(", ")]), "state", v)
        old = self._read("turns", _TURNS, earlier).join(own.gone, "source_key", "left_semi").select(*_KEY)
        touched = written(self._read("turns", _TURNS, Published(v, v)).select(*_KEY).unionByName(old).distinct())
        now = self.turns(p).join(touched, _KEY, "left_semi")
        sessions = index.sessions_per_chunk(index.build_links(now))
        self._write_chunks(index.build_chunks(now).join(sessions, "chunk_id"), v)
        stored = self._read("chunks", _CHUNKS, earlier)
        ids = touched.select(F.xxhash64(*_KEY).alias("chunk_id"))
        self._write(ids.join(stored.select("chunk_id"), "chunk_id", "left_semi").distinct(), "stale", v)
        self._write_postings(p)
        fresh = self._table("chunks", f"{_CHUNKS}, v int").where(F.col("v") == v).select("n_trigrams", "n_tokens", F.lit(1).alias("sign"))
        replaced = self.stored_chunks(earlier).join(ids, "chunk_id", "left_semi").select("n_trigrams", "n_tokens", F.lit(-1).alias("sign"))
        moved = fresh.unionByName(replaced).select(F.col("sign").cast("long").alias("n"), (F.col("sign") * F.col("n_trigrams")).alias("trigrams"), (F.col("sign") * F.col("n_tokens")).alias("tokens"))
        carried = self._read("statistics", _STATISTICS, earlier).where(F.col("v") == v - 1).select("n", "trigrams", "tokens")
        self._write(carried.unionByName(moved).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n", "trigrams", "tokens")]), "statistics", v)
        self._publish(p)

    def _write_chunks(self, chunks: DataFrame, v: int) -> None:
        ship_package(self.spark)
        measured = chunks.select("*", *postings.lengths(F.col("text"), self.lexicon), embedded(F.col("text"), self.embedder).alias("embedding"))
        self._write(measured.select(*[c.split()[0] for c in _CHUNKS.split(", ")]), "chunks", v)

    def _write_postings(self, p: Published) -> None:
        own = self._table("chunks", f"{_CHUNKS}, v int").where(F.col("v") == p.v)
        for channel in postings.LEXICAL:
            postings.write_postings(own, f"{self.folder}/postings/{channel}/v={p.v}", channel, p.layout, self.lexicon)

    def merge(self) -> int:
        """Writes all that counts as one version, in files that suit its size, and publishes it: reads no longer meet what
        builds replaced. Logs aren't read, chunks aren't worked out anew. The version's number."""
        p = self.published()
        if not p.v:
            return 0
        sums = self._read("statistics", _STATISTICS, p).where(F.col("v") == p.v).drop("v")
        new = Published(p.v + 1, p.v + 1, Layout.of(sums.first()["n"]))
        nothing = self.spark.createDataFrame([], "source_key string"), self.spark.createDataFrame([], "chunk_id long")
        for df, name in ((self.turns(p), "turns"), (nothing[0], "gone"), (self.state(p), "state"), (self.stored_chunks(p), "chunks"), (nothing[1], "stale"), (sums, "statistics")):
            self._write(df, name, new.v)
        self._write_postings(new)
        self._publish(new)
        return new.v


@dataclass
class Batch:
    turns: DataFrame
    gone: DataFrame
    cursors: DataFrame


@dataclass
class Batches:
    """Pending chunks cut into batches of equal size, in the order of (rank, source, line).

    ``sources``: source_key, action, first, last (batch). ``turns`` are written by batch. ``cuts``: cursors of sources that a
    batch ends in.
    """

    turns: DataFrame
    sources: DataFrame
    cuts: DataFrame
    found: DataFrame
    count: int
    chunks: int

    @staticmethod
    def of(spark: SparkSession, turns: DataFrame, todo: DataFrame, lines: DataFrame, found: DataFrame, size: int) -> Batches:
        chunks = turns.count()
        if chunks <= size:  # one batch: nothing to number or to cut
            cut = logs.cursors(found).select("*", F.lit(0).alias("batch")).where("false")
            return Batches(turns.withColumn("batch", F.lit(0)), todo.select("source_key", "action", F.lit(0).alias("first"), F.lit(0).alias("last")), cut, found, 1, chunks)
        ranked = turns.join(todo.select("source_key", "rank", "action"), "source_key").withColumn("piece", F.floor(F.col("line_no") / PIECE))
        pieces = numbered_pieces(ranked.groupBy("rank", "source_key", "piece").agg(F.count(F.lit(1)).alias("n")))
        nth = F.row_number().over(Window.partitionBy("source_key", "piece").orderBy("line_no")) - 1  # within a piece of a source
        batch = F.floor((F.col("before") + nth) / size).cast("int")
        own = ranked.join(pieces.select("source_key", "piece", "before"), ["source_key", "piece"]).withColumn("batch", batch)
        ends = pieces.groupBy("source_key").agg(F.floor(F.min("before") / size).cast("int").alias("first"), F.floor((F.max(F.col("before") + F.col("n")) - 1) / size).cast("int").alias("last"))
        whole = F.col("action") == "rewritten"
        sources = todo.join(ends, "source_key", "left").select("source_key", "action", F.coalesce(F.when(whole, F.col("last")).otherwise(F.col("first")), F.lit(0)).alias("first"), F.coalesce("last", F.lit(0)).alias("last"))
        sources = written(sources)
        folder = f"{scratch_folder(spark)}/batches-{uuid.uuid4().hex}"
        placed = own.join(sources.select("source_key", "last"), "source_key").withColumn("batch", F.when(whole, F.col("last")).otherwise(F.col("batch")))
        placed.select(*turns.columns, "batch").write.partitionBy("batch").parquet(folder)
        split = sources.where("first < last")
        turned = spark.read.schema(placed.select(*turns.columns, "batch").schema).parquet(folder)
        at = turned.join(split.select("source_key", "last"), "source_key").where("batch < last").groupBy("source_key", "batch").agg((F.max("line_no") + 1).alias("cut"))
        cuts = written(logs.cursors_at(lines, written(at)))
        told = sources.agg(F.max("last").alias("last")).first()["last"]
        return Batches(turned, sources, cuts, found, told + 1, chunks)

    def of_batch(self, k: int, bounded: bool) -> Batch:
        """What batch ``k`` takes in; with a budget, without rewritten sources."""
        touched = self.sources.where((F.col("first") <= k) & (F.col("last") >= k))
        touched = touched.where("action <> 'rewritten'") if bounded else touched
        ended = touched.where(F.col("last") == k)
        gone = ended.where("action in ('rewritten', 'vanished')").select("source_key")
        turns = self.turns.where(F.col("batch") == k).join(touched.select("source_key"), "source_key", "left_semi")
        whole = logs.cursors(self.found.join(ended.where("action <> 'vanished'").select("source_key"), "source_key", "left_semi"))
        cut = self.cuts.where(F.col("batch") == k).join(touched.where(F.col("last") > k).select("source_key"), "source_key", "left_semi").drop("batch")
        none = ended.where("action = 'vanished'").select("source_key", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _STATE.split(", ")[1:])])
        return Batch(turns, gone, whole.unionByName(cut).unionByName(none))

    def only_rewritten(self, k: int) -> bool:
        return self.sources.where((F.col("first") <= k) & (F.col("last") >= k) & (F.col("action") != "rewritten")).isEmpty()

    def left_from(self, k: int) -> int:
        """Sources that aren't merged whole before batch ``k``, and rewritten ones of earlier batches, which a budget leaves out."""
        return self.sources.where((F.col("last") >= k) | (F.col("action") == "rewritten")).count()

    def rewritten(self) -> int:
        return self.sources.where("action = 'rewritten'").count()


def numbered_pieces(pieces: DataFrame) -> DataFrame:
    """``pieces`` (rank, source_key, piece, n) with ``before``: the sum of n of all that come first in this order.

    Range partitions are summed by themselves; the driver adds up one number for each partition, and windows stay within
    them, so no task sees more than its range. Written.
    """
    order = ["rank", "source_key", "piece"]
    ranged = written(pieces.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before, offsets = 0, []
    for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each partition
        offsets.append((r["part"], before))
        before += r["n"]
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = F.broadcast(pieces.sparkSession.createDataFrame(offsets, "part int, offset long"))
    return written(ranged.withColumn("sum", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part").select(*order, "n", (F.col("offset") + F.col("sum")).alias("before")))


def stream_turns(spark: SparkSession, root: str, to: str, checkpoint: str):
    """Append-only logs as a stream: each new file is read once, exactly once, into Parquet turns at ``to``.

    A batch is written under its number, so a repeated batch replaces itself. ``availableNow``: reads what is there and
    stops; start it again for more.
    """
    schema = "value string"
    lines = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", 1000).text(root)
    key = logs.source_key(root, F.col("_metadata.file_path"))
    rows = lines.select(key.alias("source_key"), F.substring_index(key, "/", 1).alias("project"), F.col("value").alias("raw"))

    def save(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("line_no", F.monotonically_increasing_id())
        logs.turns(logs.classify(numbered)).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_usage(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: events by kind in event-time windows, for a stream or a table; later ones than ``late`` are out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count(F.lit(1)).alias("n"))
