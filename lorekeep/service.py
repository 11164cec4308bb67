"""The facade: build, query, compare and mark over a store, a usage log and presentation records."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import hashing
from lorekeep.functions.embedding import EmbeddingProvider
from lorekeep.functions.text import gate, query_class, strip_reminders
from lorekeep.functions.words import Lexicon
from lorekeep.operators import evaluate, index, memory, rerank, retrieval
from lorekeep.sources import sinks
from lorekeep.sources.tables import written
from lorekeep.streaming.ingest import LAYOUT, BuildReport, Store

#: Anchors that are looked for in the corpus by name; more are joined.
_NAMED_ANCHORS = 10_000
#: Characters of a prompt that are asked for.
_MOST_PROMPT = 4000
_EVENT = "kind string, anchor long, ts timestamp, generation string, policy string, note_ref string, presentation string"
_RECORD = "id string, query_class string, strategy_a string, strategy_b string, generation string, attribution array<struct<anchor:long,credited_to:string>>, starting_side string, is_null_comparison boolean"


@dataclass(frozen=True)
class Notice:
    """What should be known with an answer: the version that it comes from, whether a build is at work (its work isn't in the
    answer yet), since when an audit is owed, and what was taken in first, if anything was asked for."""

    version: int
    building: bool
    audit_owed: str | None
    refreshed: BuildReport | None = None

    def lines(self) -> list[str]:
        told = [f"a build is running; this is version {self.version}"] * self.building
        told += [f"an audit is owed since {self.audit_owed}"] if self.audit_owed else []
        if self.refreshed is not None:
            taken = {k: n for k, n in self.refreshed.actions.items() if k not in ("same", "kept")}
            told += [f"taken in: {', '.join(f'{n} {k}' for k, n in sorted(taken.items()))}"] if taken else []
            told += [f"skipped: {', '.join(f'{n} {k}' for k, n in sorted(self.refreshed.skipped.items()))}"] if self.refreshed.skipped else []
            told += [f"left to merge: {self.refreshed.unmerged}"] if self.refreshed.unmerged else []
            told += [f"unreadable: {', '.join(self.refreshed.unreadable)}"] if self.refreshed.unreadable else []
        return told


@dataclass
class Service:
    """Anchors are chunk ids. Neither events nor records hold any text of a query or a document."""

    spark: SparkSession
    folder: str
    embedder: EmbeddingProvider | None = None
    lexicon: Lexicon | None = None
    store: Store = field(init=False)
    notice: Notice | None = field(init=False, default=None)  # of the last answer
    unattributable: int = field(init=False, default=0)  # hits of the last query that had no sound chunk

    def __post_init__(self):
        self.store = Store(self.spark, f"{self.folder}/index", self.embedder, self.lexicon)

    def build(self, root: str, full: bool = False, **how) -> BuildReport:
        """See ``Store.build``."""
        return self.store.build(root, full, **how)

    def audit(self) -> DataFrame:
        return self.store.audit()

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        return self._table("events", _EVENT)

    def records(self) -> DataFrame:
        return self._table("records", _RECORD)

    def _generation(self) -> str:
        stamps = self.spark.range(1).select(hashing.generation_id(F.lit(str(LAYOUT)), F.lit(self.store.embedder.revision), F.lit(self.store.stamps["lexicon"]), F.lit(str(self.store.version()))))
        return stamps.first()[0]

    def _hits(self, text: str, k: int, project: str | None) -> DataFrame:
        asked = self.spark.createDataFrame([(1, text, k, project, self.store.embedder.vector(text))], "qid int, text string, k int, project string, embedding array<float>")
        vectors = self.store.stored_chunks().select("chunk_id", "project", "embedding")
        return written(retrieval.search(self.store.search_index(), retrieval.with_variants(asked), vectors))

    def _page(self, text: str, k: int, project: str | None, exclude: list[str]) -> tuple[DataFrame, DataFrame]:
        """The hits and their chunks; with excluded sessions, as many hits as it takes (up to 1,000) to leave k. Hits whose
        chunk is malformed or has no source are dropped."""
        if not 1 <= k <= sinks.MOST_RESULTS:
            raise ValueError(f"k must be between 1 and {sinks.MOST_RESULTS}")
        depth = k
        while True:
            hits = self._hits(text, depth, project)
            chunks = written(self.store.stored_chunks(ids=[r["chunk_id"] for r in hits.select("chunk_id").limit(sinks.MOST_RESULTS).collect()]))
            chunks = chunks.where(index.is_sound())
            left = chunks.where(F.size(F.array_except("sessions", F.array(*map(F.lit, exclude)).cast("array<string>"))) > 0) if exclude else chunks
            if not exclude or left.count() >= k or depth >= sinks.MOST_RESULTS or hits.count() < depth:
                self.unattributable = hits.join(chunks.select("chunk_id"), "chunk_id", "left_anti").count()
                order = F.row_number().over(Window.partitionBy("qid").orderBy("pos")) - 1
                return hits.join(chunks.select("chunk_id"), "chunk_id", "left_semi").withColumn("pos", order), chunks
            depth = min(4 * depth, sinks.MOST_RESULTS)

    def _refresh(self, root: str | None, seconds: float | None) -> None:
        """Takes in what is new, unless another build is at work: then the last version answers."""
        building = self.store.running()
        report = self.build(root, budget_seconds=seconds) if root is not None and not building else None
        version = self.store.version()
        if not version:
            raise ValueError("there is no index yet: build one")
        self.notice = Notice(version, building, self.store.owes_audit(), report)

    def _strengths(self, page: DataFrame, spreading: float) -> DataFrame:
        """Net strengths of the page's anchors. Of the log, events of these anchors alone are read; with spreading, those of
        their presentations and of all that was shown in these. Anchors that the corpus no longer has count for nothing:
        only those that were met are looked for in it."""
        events, anchors = self.events(), F.broadcast(page.select("anchor").distinct())  # a result page
        own = events.join(anchors, "anchor", "left_semi")
        if spreading:
            shared = events.join(own.where("presentation is not null").select("presentation").distinct(), "presentation", "left_semi")
            own = events.join(own.select("anchor").unionByName(shared.select("anchor")).distinct(), "anchor", "left_semi")
        own = written(own)
        met = own.select(F.col("anchor").alias("chunk_id")).distinct()
        ids = [r[0] for r in met.limit(_NAMED_ANCHORS + 1).collect()]
        corpus = self.store.stored_chunks(ids=ids) if len(ids) <= _NAMED_ANCHORS else self.store.stored_chunks().join(met, "chunk_id", "left_semi")
        strength = memory.project(own, F.current_timestamp(), memory.Parameters(spreading=spreading), corpus.select(F.col("chunk_id").alias("anchor")))
        return written(strength.join(anchors, "anchor", "left_semi"))

    def _ranked(self, hits: DataFrame, strategy: str, bound: int | None = None, strength: DataFrame | None = None) -> DataFrame:
        """The page re-ranked by a strategy, checked by the guard against the bound in force. A strategy that reads no
        signals reads no history."""
        own, bound = rerank.authorised(strategy, bound)
        page = hits.select("qid", F.col("chunk_id").alias("anchor"), "pos", F.col("score").alias("base_score"), "band")
        if strength is None:
            strength = self._strengths(page, own.spreading) if own.signals else self.spark.createDataFrame([], "anchor long, net double")
        ranked = written(rerank.rerank(page, strength.select("anchor", "net"), own, bound))
        after = ranked.select("qid", "anchor", F.col("new_pos").alias("pos"), "base_score", "band", "displacement", "movement", "history")
        rerank.require_sound(rerank.guard_violations(page, after, bound, own.segment == "run", strength if own.signals else None))
        return ranked

    def query(
        self, text: str, k: int = 20, project: str | None = None, strategy: str = "archival", exclude: list[str] = (), record: bool = False, root: str | None = None, refresh_seconds: float | None = None,
    ) -> DataFrame:
        """Pointered results, best first: qid, pos, project, uuid, ts, snippet, score, band, channels, sessions; with another
        strategy than archival displacement, history and movement; where recorded the presentation.

        ``root``: logs whose new content is taken in first, within ``refresh_seconds`` if given. ``notice`` says what else
        should be known of the answer.
        """
        self._refresh(root, refresh_seconds)
        hits, chunks = self._page(text, k, project, list(exclude))
        ranked = self._ranked(hits, strategy)
        placed = hits.drop("pos").join(ranked.select(F.col("anchor").alias("chunk_id"), F.col("new_pos").alias("pos"), "displacement", "history", "movement"), "chunk_id")
        kept = retrieval.exclude_sessions(placed, chunks.select("chunk_id", "sessions"), list(exclude), k) if exclude else placed.where(F.col("pos") < k)
        told = [] if strategy == "archival" else ["displacement", "history", "movement"]
        kept = written(kept.select("qid", "pos", "chunk_id").join(placed.select("chunk_id", "score", "band", "channels", *told), "chunk_id"))
        if not record:
            return sinks.pointered(kept, chunks)
        number = uuid.uuid4().hex
        self._shown(kept.select(F.col("chunk_id").alias("anchor")), strategy, number)
        return sinks.pointered(kept.withColumn("presentation", F.lit(number)), chunks)

    def recall(self, prompt: str, cues: list[str], synthetic: list[str], mode: str = "cued", k: int = 5, project: str | None = None) -> tuple[str, str]:
        """What a prompt hook says of a prompt: its label (off, synthetic, miss, hit or notice) and a text. A hit's text is the
        recall block of a recorded query; where that fails the label is ``notice`` and the text says why, in one line: a
        prompt must never wait for an error. Other labels have none."""
        label = self.spark.createDataFrame([(prompt, mode)], "prompt string, mode string").select(gate(F.col("prompt"), cues, synthetic, F.col("mode"))).first()[0]
        if label != "hit":
            return label, ""
        asked = self.spark.createDataFrame([(prompt,)], "prompt string").select(F.substring(strip_reminders(F.col("prompt")), 1, _MOST_PROMPT)).first()[0]
        try:
            return "hit", sinks.recall_block(self.query(asked, k, project, record=True))
        except Exception as failed:  # whatever it is, it is told instead of raised
            return "notice", f"recall was not done: {' '.join(str(failed).split())[:200]}"

    def _shown(self, anchors: DataFrame, policy: str, presentation: str) -> None:
        shown = anchors.select(
            F.lit("shown").alias("kind"), "anchor", F.current_timestamp().alias("ts"), F.lit(self._generation()).alias("generation"), F.lit(policy).alias("policy"), F.lit(None).cast("string").alias("note_ref"), F.lit(presentation).alias("presentation")
        )
        shown.write.mode("append").parquet(f"{self.folder}/events")

    def compare(self, text: str, a: str = "archival", b: str = "human-like", k: int = 20, project: str | None = None, root: str | None = None, refresh_seconds: float | None = None) -> tuple[str, DataFrame]:
        """One retrieval under two strategies, interleaved; recorded. Returns the presentation's id and its results. Both
        read one projection, so strategies that read history must agree on how it spreads; those that read none fit any."""
        if a == b:
            raise ValueError("two different strategies are compared")
        demands = [own for own, _ in (rerank.authorised(a), rerank.authorised(b)) if own.signals]
        if len({own.spreading for own in demands}) > 1:
            raise ValueError(f"{a} and {b} can't be compared: they read histories that spread differently")
        self._refresh(root, refresh_seconds)
        hits, chunks = self._page(text, k, project, [])
        strength = self._strengths(hits.select(F.col("chunk_id").alias("anchor")), demands[0].spreading) if demands else None
        orders = [self._ranked(hits, s, strength=strength if rerank.STRATEGIES[s].signals else None).select("qid", "anchor", F.col("new_pos").alias("pos")) for s in (a, b)]
        asked = self.spark.createDataFrame([(1, text)], "qid int, text string").select("qid", hashing.starting_side(F.col("text")).alias("side"), query_class(F.col("text")).alias("query_class"))
        mixed = written(evaluate.interleave(*orders, asked.select("qid", "side")))
        number, facts = uuid.uuid4().hex, asked.first()
        null = mixed.where("credited_to is not null").isEmpty()
        items = F.transform(F.array_sort(F.collect_list(F.struct("place", "anchor", "credited_to"))), lambda x: F.struct(x["anchor"].alias("anchor"), x["credited_to"].alias("credited_to")))
        mixed.agg(items.alias("attribution")).select(  # nobody is credited in a null comparison
            F.lit(number).alias("id"), F.lit(facts["query_class"]).alias("query_class"), F.lit(a).alias("strategy_a"), F.lit(b).alias("strategy_b"), F.lit(self._generation()).alias("generation"), "attribution", F.lit(facts["side"]).alias("starting_side"), F.lit(null).alias("is_null_comparison")
        ).write.mode("append").parquet(f"{self.folder}/records")
        self._shown(mixed.select("anchor"), "interleaved", number)
        placed = hits.drop("pos").join(mixed.select("credited_to", F.col("anchor").alias("chunk_id"), F.col("place").alias("pos")), "chunk_id")
        return number, sinks.pointered(placed.withColumn("presentation", F.lit(number)), chunks)

    def mark(self, presentation: str, rank: int, kind: str) -> None:
        """Records that the result at a rank (from 1) of a presentation was opened, cited, pinned or dismissed."""
        if kind not in memory.KINDS[1:] or rank < 1:
            raise ValueError("kind must be opened, cited, pinned or dismissed, and ranks start at 1")
        choice = self.spark.createDataFrame([(presentation, rank, kind)], "presentation string, rank int, kind string").withColumn("ts", F.current_timestamp())
        event = evaluate.marks(self.records(), choice)
        if event.isEmpty():
            raise ValueError("no such presentation or rank")
        event.select("kind", "anchor", "ts", "generation", "policy", "note_ref", "presentation").write.mode("append").parquet(f"{self.folder}/events")

    def report(self) -> DataFrame:
        """The comparison report; refused while records or events contradict each other."""
        events, records = written(self.events()), written(self.records())
        evaluate.require_usable(events, records)
        return evaluate.comparison_report(events, records)

    def memory_status(self) -> DataFrame:
        """(fact, n): events by kind, orphaned anchors, future events, and events that break the log's rules."""
        events, corpus = self.events(), self.store.stored_chunks().select(F.col("chunk_id").alias("anchor"))
        now = F.current_timestamp()
        parts = [
            events.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("events: "), "kind").alias("fact"), "n"),
            memory.orphans(events, now, corpus).agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphaned anchors").alias("fact"), "n"),
            memory.future_events(events, now).select(F.lit("future events").alias("fact"), F.col("future_events").alias("n")),
            memory.validate_events(events).agg(F.count(F.lit(1)).alias("n")).select(F.lit("unusable events").alias("fact"), "n"),
        ]
        return reduce(DataFrame.unionByName, parts)

    def prune(self, to: str) -> int:
        """Writes the events that keep the log's rules to the new folder ``to`` (what there is stays as backup); the number kept."""
        events = self.events().withColumn("row", F.monotonically_increasing_id())
        events = written(events)
        unusable = memory.validate_events(events).select("row")
        events.join(unusable, "row", "left_anti").drop("row").write.parquet(to)
        return self.spark.read.parquet(to).count()
