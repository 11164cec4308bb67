"""The lexical channels' index as tables of positional postings.

A posting is a row (term, chunk_id, project, dl, tf, positions): how often and where a term stands in a chunk, and how long the
chunk is for its channel. Terms of the trigram channel are runs of three characters of the lower-cased text, those of the segment
channel its words. A file holds chunks of one hash (block), and in it runs of postings, each sorted by a hash of the term (bucket) and
the term; blocks, buckets and files grow in number with the corpus. A query reads the pages of its own terms, as the files'
statistics tell them, and never a text: a phrase stands where its terms' positions, each less its place in the phrase, meet. Phrases of one term are
ranked from its postings as they are read, without positions; those of several terms shuffle their postings by chunk.

Beside the postings of frequent terms stands a summary by block: how many chunks hold the term, its greatest frequency in
one, and the least and greatest length of these. A phrase of one term then knows how many chunks hold it, and which blocks
can reach its depth: every block holds a chunk that scores at least as much as its greatest frequency in its longest chunk,
and none that scores more than that in its shortest. Blocks below the depth's worst case are not read. Phrases of several
terms are read in whole, since their scores ask how many chunks hold them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorekeep.functions.words import Lexicon, portions, separated, tokens
from lorekeep.sources.shipping import ship_package

LEXICAL = ("trigram", "segment")
ReadAs = Callable[[Column], Column]
#: Queries that are answered at once, and their terms that are named to the reader of postings; more are joined.
MOST_QUERIES = 10_000
MOST_NAMED = 1_000
#: A term that so many chunks hold has a summary.
FREQUENT = 1_024
#: Terms that have one at most, the most frequent ones.
MOST_SUMMARISED = 500_000
#: Chunks for each bucket and block, of which there are 64 at least; a file has four times as many.
CHUNKS_PER_FILE = 2_500
#: Occurrences of terms that a task sorts at once, in some 40 bytes each.
OCCURRENCES = 3_000_000
_ROWS = 50_000
#: While channels are written. A task has one channel's rows, and from two writers on Spark sorts all rows by channel. Texts go to
#: workers and back in batches of which a task holds some, in the JVM and in each worker.
WRITING = {"spark.sql.maxConcurrentOutputFileWriters": "2", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_SCHEMA = "term string, chunk_id long, project string, dl int, tf int, positions array<int>"
_SUMMARY = "term string, block int, n long, most int, shortest int, longest int"

# BM25's usual constants and the floor of its idf.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def lengths(text: Column, lexicon: Lexicon | None = None) -> tuple[Column, Column]:
    """How long a text is for the trigram and the segment channel."""
    return F.greatest(F.length(text) - 2, F.lit(0)).alias("n_trigrams"), F.size(tokens(text, lexicon)).alias("n_tokens")


def statistics(measured: DataFrame) -> DataFrame:
    """One row: n chunks, mean trigram count, mean token count. ``measured``: n_trigrams, n_tokens."""
    return measured.agg(F.count(F.lit(1)).alias("n"), F.avg("n_trigrams").alias("trigram_avgdl"), F.avg("n_tokens").alias("segment_avgdl"))


@dataclass(frozen=True)
class Layout:
    """How many buckets of terms and blocks of chunks there are."""

    buckets: int = 16
    blocks: int = 4

    @property
    def files(self) -> int:
        """Files of a channel: four times the chunks of a bucket's block, each file of one block (all are powers of two)."""
        return max(self.blocks, self.buckets * self.blocks // 4)

    @staticmethod
    def of(n_chunks: int) -> Layout:
        """For a corpus: the more chunks, the more of both, by turns, so that files keep their size."""
        doublings = max(0, math.ceil(math.log2(max(1, n_chunks) / (64 * CHUNKS_PER_FILE))))
        return Layout(16 << (doublings + 1) // 2, 4 << doublings // 2)

    def bucket(self, term: str) -> int:
        """The bucket of a term, as Spark's hash gives it."""
        h = xxhash.xxh64_intdigest(term.encode(), 42)
        return h % self.buckets  # a power of two, so that the sign doesn't matter


def _occurrences_of_tokens(own: pa.ListArray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of all occurrences in order: the number of the term, the terms by number, and how many occurrences each row has."""
    words = own.flatten().dictionary_encode()
    return words.indices.to_numpy(), words.dictionary.to_pylist(), np.diff(own.offsets.to_numpy())


def _occurrences_of_trigrams(own: pa.StringArray) -> tuple[np.ndarray, list[str], np.ndarray]:
    texts = own.to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters to the end of the row
    at = np.flatnonzero(left >= 3)
    numbers, keys = pd.factorize(codes[at] << np.uint64(42) | codes[at + 1] << np.uint64(21) | codes[at + 2])
    letter = lambda shift: map(chr, (keys >> np.uint64(shift) & np.uint64(0x1FFFFF)).tolist())
    return numbers, list(map("".join, zip(letter(42), letter(21), letter(0), strict=True))), np.maximum(sizes - 2, 0)


def _sorted_run(ids: pa.Array, projects: pa.Array, own: pa.Array, channel: str, layout: Layout) -> pa.RecordBatch:
    """The postings of some rows by bucket and term, then in the order of the rows."""
    numbers, terms, sizes = (_occurrences_of_trigrams if channel == "trigram" else _occurrences_of_tokens)(own)
    buckets = np.array([layout.bucket(t) for t in terms], np.int32)
    by = np.array(sorted(range(len(terms)), key=lambda i: (buckets[i], terms[i])), np.int64)  # code points sort as UTF-8 does
    rank = np.empty(len(terms), np.uint16 if len(terms) <= 1 << 16 else np.uint32)
    rank[by] = np.arange(len(terms))
    of = rank[numbers]
    del numbers
    order = np.argsort(of, kind="stable")
    of = of[order]
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    place = np.arange(len(of), dtype=np.int32)
    place -= np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    place = place[order]
    del order
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    ends = np.append(first, len(of)).astype(np.int32)
    term, chunk = by[of[first]], pa.array(row[first])
    columns = {
        "term": pa.array(terms, pa.string()).take(pa.array(term)), "chunk_id": ids.take(chunk), "project": projects.take(chunk), "dl": pa.array(sizes.astype(np.int32)).take(chunk),
        "tf": pa.array(np.diff(ends)), "positions": pa.ListArray.from_arrays(pa.array(ends), pa.array(place)), "bucket": pa.array(buckets[term]),
    }
    return pa.RecordBatch.from_pydict(columns)


def _runs(batches: Iterator[pa.RecordBatch], channel: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``most`` occurrences at once, or of one row that has more."""
    held, size = [], 0
    for batch in batches:
        own = batch.column("seen")
        sizes = (pc.utf8_length(own) if channel == "trigram" else pc.list_value_length(own)).to_numpy(zero_copy_only=False)
        lo = 0
        for hi, n in enumerate(sizes):
            if size and size + n > most:
                whole = pa.concat_batches([*held, batch.slice(lo, hi - lo)])
                held, size, lo = [], 0, hi  # gone while the rows are sorted
                yield whole
                del whole
            size += int(n)
        if lo < batch.num_rows:
            held.append(batch.slice(lo))
    if held:
        yield pa.concat_batches(held)


def _cut(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """Texts as the lexicon's words, in the task that sorts them."""
    for batch in batches:
        for lo, hi in portions(batch.column("seen")):
            ids, projects, texts = batch.slice(lo, hi - lo).columns
            cut = lexicon.arrays.tokens(texts)
            numbered = pa.ListArray.from_arrays(cut.offsets, cut.values.dictionary_encode())  # held until they are sorted, in less memory
            yield pa.RecordBatch.from_arrays([ids, projects, numbered], ["chunk_id", "project", "seen"])


def postings(chunks: DataFrame, channel: str, lexicon: Lexicon | None = None, layout: Layout | None = None, read_as: ReadAs | None = None) -> DataFrame:
    """All postings of (chunk_id, project, text) for a channel; each text is looked at once, in its own task, which sorts the
    postings of some ``OCCURRENCES`` at once by bucket and term. Nulls are told by the text, not by what it is ``read_as``, which
    would then be made before the shuffle as well."""
    ship_package(chunks.sparkSession)
    by_lexicon = channel == "segment" and lexicon is not None
    text = F.col("text") if read_as is None else read_as(F.col("text"))
    seen = F.lower(text) if channel == "trigram" else separated(text) if by_lexicon else tokens(text)
    most, layout = OCCURRENCES, layout or Layout()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(_cut(batches, lexicon) if by_lexicon else batches, channel, most):
            out = _sorted_run(rows.column("chunk_id"), rows.column("project"), rows.column("seen"), channel, layout)
            del rows
            for lo in range(0, out.num_rows, _ROWS):
                yield out.slice(lo, _ROWS)

    return chunks.where("text is not null").select("chunk_id", "project", seen.alias("seen")).mapInArrow(run, f"{_SCHEMA}, bucket int")


def _spread(chunks: DataFrame, layout: Layout) -> DataFrame:
    """Texts in the task of their file; postings, which are many times their size, are neither shuffled nor sorted by Spark."""
    return chunks.select("chunk_id", "project", "text").repartitionById(layout.files, F.pmod(F.xxhash64("chunk_id"), F.lit(layout.files)).cast("int"))


def _in_blocks(spread: DataFrame, channel: str, layout: Layout, lexicon: Lexicon | None, read_as: ReadAs | None = None) -> DataFrame:
    return postings(spread, channel, lexicon, layout, read_as).withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(layout.blocks)).cast("int"))


def _writer(rows: DataFrame) -> DataFrameWriter:
    # small pages, so that a term's rows are found without decoding its neighbours'
    return rows.write.mode("overwrite").option("parquet.page.row.count.limit", 2000).option("compression", "zstd")


def write_postings(chunks: DataFrame, folder: str, channel: str, layout: Layout = Layout(), lexicon: Lexicon | None = None) -> None:
    """Writes a channel's postings below ``folder``, over what is there."""
    _writer(_in_blocks(_spread(chunks, layout), channel, layout, lexicon)).parquet(folder)


def write_channels(chunks: DataFrame, folder: str, channels: tuple[str, ...], layout: Layout = Layout(), lexicon: Lexicon | None = None, read_as: ReadAs | None = None) -> None:
    """Writes some channels' postings, each below ``folder/channel=``, over what is there. Texts are shuffled once for all of
    them, as they are: what they are ``read_as`` is made in the task of their file."""
    spark = chunks.sparkSession
    spread = _spread(chunks, layout)
    rows = reduce(DataFrame.unionByName, [_in_blocks(spread, c, layout, lexicon, read_as).withColumn("channel", F.lit(c)) for c in channels])
    before = {key: spark.conf.get(key) for key in WRITING}
    try:
        for key, value in WRITING.items():
            spark.conf.set(key, value)
        _writer(rows).partitionBy("channel").parquet(folder)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def summarise(table: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(term, block, n, most, shortest, longest) of the terms that ``frequent`` or more chunks hold.

    Terms are counted by a short hash first: most are rare, and only those that a frequent hash may stand for are grouped."""
    short = F.hash("term").alias("short")
    often = table.groupBy(short).agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= frequent).orderBy(F.desc("all")).limit(MOST_SUMMARISED)
    held = table.select("term", "block", "tf", "dl", short).join(F.broadcast(often.select("short")), "short", "left_semi")
    each = held.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("dl").alias("shortest"), F.max("dl").alias("longest"))
    return each.withColumn("all", F.sum("n").over(Window.partitionBy("term"))).where(F.col("all") >= frequent).drop("all")


@dataclass
class SearchIndex:
    """Postings by channel (with a build number ``v`` where builds add up), statistics (one row), and what later builds
    have replaced: stale (chunk_id, since). Summaries by channel are there for an index that was built at once."""

    tables: dict[str, DataFrame]
    statistics: DataFrame
    layout: Layout = Layout()
    stale: DataFrame | None = None
    lexicon: Lexicon | None = None
    summaries: dict[str, DataFrame] = field(default_factory=dict)
    _corpus: dict | None = field(default=None, repr=False)

    @property
    def corpus(self) -> dict:
        """The statistics' one row, read once: n, trigram_avgdl, segment_avgdl."""
        if self._corpus is None:
            self._corpus = self.statistics.first().asDict()
        return self._corpus

    def add(self, other: SearchIndex) -> None:
        """Takes over the channels of another index of the same chunks."""
        self.tables.update(other.tables)
        self.summaries.update(other.summaries)
        self.corpus.update({f"{c}_avgdl": other.corpus[f"{c}_avgdl"] for c in other.tables})


def build_index(chunks: DataFrame, folder: str, lexicon: Lexicon | None = None, layout: Layout | None = None, frequent: int = FREQUENT, channels: tuple[str, ...] = LEXICAL, read_as: ReadAs | None = None) -> SearchIndex:
    """The index of (chunk_id, project, text), written below ``folder``; of some ``channels`` alone where only these are asked.
    ``read_as``: what is indexed instead of a text, which is null where the text is."""
    spark = chunks.sparkSession
    layout = layout or Layout.of(chunks.count())
    write_channels(chunks, f"{folder}/postings", channels, layout, lexicon, read_as)
    _statistics_of(chunks, folder, channels, read_as).write.mode("overwrite").parquet(f"{folder}/statistics")
    for channel in channels:
        summarise(_postings_of(spark, folder, channel), frequent).repartition(1 + layout.buckets // 16, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/summaries/{channel}")
    return open_index(spark, folder, lexicon, layout, channels)


def _statistics_of(chunks: DataFrame, folder: str, channels: tuple[str, ...], read_as: ReadAs | None) -> DataFrame:
    """Statistics for the channels that are built, null for others. Postings tell how many tokens there are: no text is cut twice."""
    means = dict.fromkeys(LEXICAL, F.lit(None).cast("double"))
    if "trigram" in channels:
        means["trigram"] = F.avg(lengths(F.col("text") if read_as is None else read_as(F.col("text")))[0])
    if "segment" in channels:
        n_tokens = _postings_of(chunks.sparkSession, folder, "segment").agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        means["segment"] = F.lit(n_tokens) / F.when(F.count("text") > 0, F.count("text"))
    return chunks.agg(F.count(F.lit(1)).alias("n"), *[mean.alias(f"{c}_avgdl") for c, mean in means.items()])


def _postings_of(spark: SparkSession, folder: str, channel: str) -> DataFrame:
    return spark.read.schema(f"{_SCHEMA}, block int, bucket int").parquet(f"{folder}/postings/channel={channel}")


def open_index(spark: SparkSession, folder: str, lexicon: Lexicon | None = None, layout: Layout = Layout(), channels: tuple[str, ...] = LEXICAL) -> SearchIndex:
    tables = {c: _postings_of(spark, folder, c) for c in channels}
    summaries = {c: spark.read.schema(_SUMMARY).parquet(f"{folder}/summaries/{c}") for c in channels}
    return SearchIndex(tables, spark.read.parquet(f"{folder}/statistics"), layout, lexicon=lexicon, summaries=summaries)


# -- a batch of queries -----------------------------------------------------------------------------------------------


@dataclass
class Phrase:
    """What a query asks of a channel: terms by their places in the phrase. ``df``: how many chunks hold it, where that is
    known; ``blocks``: those to be read, where not all are."""

    qid: int
    variant: int
    k: int
    project: str | None
    channel: str
    terms: list[tuple[int, str]]
    df: int | None = None
    blocks: list[int] | None = None


def depth(k: int) -> int:
    """How deep channels are read for k results."""
    return max(5 * k, 50)


def _covering(run: str) -> list[tuple[int, str]]:
    """Every third trigram of a run and the last one: they stand at their places only where the whole run does."""
    return [(i, run[i : i + 3]) for i in sorted({*range(0, len(run) - 2, 3), *([len(run) - 3] if len(run) >= 3 else [])})]


def phrases(index: SearchIndex, queries: DataFrame, channels: tuple[str, ...]) -> list[Phrase]:
    """The batch's phrases, by one look at the queries; a query too short for a channel has none in it."""
    trimmed = F.trim("text")
    if index.lexicon is not None:
        ship_package(queries.sparkSession)
    rows = queries.select("qid", "variant", "k", "project", F.when(F.length(trimmed) >= 3, F.lower(trimmed)).alias("run"), tokens(trimmed, index.lexicon).alias("words")).limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"at most {MOST_QUERIES} queries are answered at once")
    out = []
    for r in rows:
        own = {"trigram": _covering(r["run"] or ""), "segment": list(enumerate(r["words"] or []))}
        out += [Phrase(r["qid"], r["variant"], r["k"], r["project"], c, own[c]) for c in channels if own[c]]
    return out


def weight(tf: Column | float, dl: Column | float, avgdl: float) -> Column | float:
    """BM25 without its idf."""
    return (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def narrow(index: SearchIndex, asked: list[Phrase]) -> None:
    """Fills in ``df`` and ``blocks`` of phrases of one frequent term. A project's own depth isn't known, so it reads all."""
    for channel, summary in index.summaries.items():
        own = [p for p in asked if p.channel == channel and len(p.terms) == 1]
        terms = sorted({p.terms[0][1] for p in own})
        if not terms or len(terms) > MOST_NAMED:
            continue
        by_term: dict[str, list] = {}
        for r in summary.where(F.col("term").isin(terms)).collect():  # a row for each block of at most MOST_NAMED terms
            by_term.setdefault(r["term"], []).append(r)
        avgdl = index.corpus[f"{channel}_avgdl"]
        for p in own:
            rows = by_term.get(p.terms[0][1])
            if rows:
                p.df = sum(r["n"] for r in rows)
                if p.project is None and len(rows) > depth(p.k):
                    idf = max(LEAST_IDF, math.log((index.corpus["n"] - p.df + 0.5) / (p.df + 0.5)))
                    score = lambda tf, dl: round(idf * weight(tf, dl, avgdl), 9)  # noqa: B023, E731
                    reached = sorted((score(r["most"], r["longest"]) for r in rows), reverse=True)[depth(p.k) - 1]
                    p.blocks = sorted(r["block"] for r in rows if score(r["most"], r["shortest"]) >= reached - 2e-9)


def _named(layout: Layout, asked: list[Phrase]) -> Column:
    """What the reader of postings is told: buckets, and terms with their blocks where there are few enough."""
    wanted: dict[str, set[int] | None] = {}
    for p in asked:
        for _, t in p.terms:
            blocks = None if p.blocks is None or wanted.get(t, ()) is None else wanted.get(t, set()) | set(p.blocks)
            wanted[t] = blocks
    told = F.col("bucket").isin(sorted({layout.bucket(t) for t in wanted}))
    if len(wanted) > MOST_NAMED:
        return told
    whole = [t for t, blocks in wanted.items() if blocks is None]
    terms = [F.col("term").isin(whole)] if whole else []
    terms += [(F.col("term") == t) & F.col("block").isin(sorted(blocks)) for t, blocks in wanted.items() if blocks is not None]
    return told & reduce(Column.__or__, terms)


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's, without a job of its own."""
    typed = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in typed]
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return spark.createDataFrame(pa.table({f.name: pa.array(list(c), arrow[f.dataType.simpleString()]) for f, c in zip(typed, columns, strict=True)}), schema=typed)


def _met(index: SearchIndex, asked: list[Phrase], spark: SparkSession) -> tuple[DataFrame, list[str]]:
    """Postings of the phrases' terms in both channels, with the phrases; and the columns that name a phrase in a chunk."""
    read = []
    for channel in dict.fromkeys(p.channel for p in asked):
        read.append(index.tables[channel].where(_named(index.layout, [p for p in asked if p.channel == channel])).withColumn("channel", F.lit(channel)))
    rows = [(p.channel, p.qid, p.variant, t, i, len(p.terms), p.blocks) for p in asked for i, t in p.terms]
    terms = local(spark, rows, "channel string, qid int, variant int, term string, place int, n_terms int, blocks array<int>")
    terms = F.broadcast(terms) if len(rows) <= 10 * MOST_NAMED else terms
    own = reduce(DataFrame.unionByName, read)
    return own.join(terms, ["channel", "term"]), ["channel", "qid", "variant", "chunk_id", *(["v"] if "v" in own.columns else [])]


def _of_one_term(index: SearchIndex, asked: list[Phrase], spark: SparkSession) -> DataFrame:
    met, keys = _met(index, asked, spark)
    if any(p.blocks is not None for p in asked):
        met = met.where(F.col("blocks").isNull() | F.array_contains("blocks", F.col("block")))
    return met.select(*keys, "project", "tf", "dl")


def _of_several_terms(index: SearchIndex, asked: list[Phrase], spark: SparkSession) -> DataFrame:
    met, keys = _met(index, asked, spark)
    met = met.select(*keys, "project", "dl", "n_terms", F.transform("positions", lambda p: p - F.col("place")).alias("starts"))
    held = met.groupBy(*keys).agg(F.first("project").alias("project"), F.first("dl").alias("dl"), F.first("n_terms").alias("n_terms"), F.collect_list("starts").alias("starts"))
    common = F.aggregate(F.slice("starts", F.lit(2), F.size("starts")), F.element_at("starts", 1), F.array_intersect)
    tf = F.filter(F.array(F.size(common)), lambda n: n > 0)  # in a generator, so that it is worked out once
    return held.where(F.size("starts") == F.col("n_terms")).select(*keys, "project", "dl", F.explode(tf).alias("tf")).select(*keys, "project", "tf", "dl")


def found(index: SearchIndex, asked: list[Phrase], spark: SparkSession) -> DataFrame:
    """(channel, qid, variant, chunk_id, project, tf, dl) for each chunk that holds a phrase of the batch, in either
    channel."""
    if not asked:
        return spark.createDataFrame([], "channel string, qid int, variant int, chunk_id long, project string, tf int, dl int")
    parts = [part(index, own, spark) for part, own in ((_of_one_term, [p for p in asked if len(p.terms) == 1]), (_of_several_terms, [p for p in asked if len(p.terms) > 1])) if own]
    out = reduce(DataFrame.unionByName, parts)
    if index.stale is not None:
        out = out.join(index.stale, "chunk_id", "left").where(F.col("since").isNull() | (F.col("v") >= F.col("since")))
    return out.select("channel", "qid", "variant", "chunk_id", "project", "tf", "dl")


def matches(index: SearchIndex, queries: DataFrame, channel: str) -> DataFrame:
    """(qid, variant, chunk_id, project, tf, dl) for each chunk that holds a query's phrase. ``queries``: qid, text, k, project, variant."""
    return found(index, phrases(index, queries, (channel,)), queries.sparkSession).drop("channel")
