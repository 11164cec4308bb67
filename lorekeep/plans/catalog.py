"""Named queries over the driver's tables: how each operator is applied to them."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import hashing
from lorekeep.functions import text as fn
from lorekeep.functions.words import Lexicon, end_to_end, portions, tokens, utf8_sizes
from lorekeep.operators import evaluate, index, memory, postings, rerank, retrieval
from lorekeep.sources import events as event_log
from lorekeep.sources import logs
from lorekeep.sources.shipping import ship_package
from lorekeep.sources.tables import scratch_folder, table, written

#: qid, text, k, project
QUERIES = [(1, "thing", 10, None), (2, "of the", 10, None), (3, "und der", 10, None), (4, "de la", 5, "p1"), (5, "th", 10, None)]
INSTANT = "2024-01-25 00:00:00"
KINDS = {"view": "shown", "click": "opened", "purchase": "cited", "signup": "pinned", "error": "dismissed"}
KEY = b"key"
EXCLUDED = ["src0", "src1", "src2", "src3", "src4"]
#: A Han character for each letter: the tables hold no CJK text, so queries over words derive it from what they hold.
LETTERS, HAN = "abcdefghijklmnopqrstuvwxyz", "天地人日月山水火木金土石田禾竹米虫鱼鸟马牛羊犬龙虎龟"
#: Two-character words of such texts, by their letters, and how many words a lexicon of theirs has.
HAN_QUERIES, HAN_WORDS = ["th", "on", "de", "er", "in"], 300
#: What some letters become in texts of simplified and of traditional characters.
SIMPLE = [("th", "头发"), ("er", "发"), ("in", "后"), ("an", "干净"), ("on", "干部"), ("re", "面条现"), ("de", "皇后")]
OLD = [("th", "頭髮"), ("er", "發"), ("in", "後"), ("an", "乾淨"), ("on", "幹部"), ("re", "麵條現"), ("de", "皇后")]
ACCENTED = "éèêçàäöüñíó"
CLASSED = ["釘選", "釘選版", "釘選版本比較", "tokenizer", "FTS5 分詞", "", "  ", "!?", "かな", "한글", "記憶する", "a記"]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("p"), F.pmod("doc_id", F.lit(5))).alias("project"), "text")


_indexes: dict[tuple, postings.SearchIndex] = {}


def search_index(spark: SparkSession, sf_dir: str, channels: tuple[str, ...] = postings.LEXICAL, han: bool = False) -> postings.SearchIndex:
    """The documents' search index: a channel is built by the first query that asks for it in a session, and anew when the
    files change. ``han``: of the documents in Han characters, with their lexicon."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/documents.parquet").select("path", "modificationTime", "length")  # names and times, no content
    key = (spark.sparkContext.applicationId, sf_dir, han, files.agg(F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()[0])
    known = _indexes.get(key)
    missing = tuple(c for c in channels if known is None or c not in known.tables)
    if missing:
        lexicon = None if not han else known.lexicon if known else han_lexicon(spark, sf_dir)
        built = postings.build_index(chunks(spark, sf_dir), f"{scratch_folder(spark)}/search-{uuid.uuid4().hex}", lexicon, channels=missing, read_as=in_han if han else None)
        if known is None:
            _indexes[key] = built
        else:
            known.add(built)
    return _indexes[key]


def in_han(text: Column) -> Column:
    """A text whose small letters are Han characters, every second space between two words left out: runs to be cut."""
    letters = np.array([ord(c) for c in HAN], np.uint32)

    def portion(rows: pa.Array) -> pa.Array:
        held, ends = end_to_end(rows)
        codes = np.frombuffer(held.decode().encode("utf-32-le"), np.uint32).copy()
        small = codes - 97 < 26  # unsigned
        other = np.flatnonzero(~small)  # the last one is the space after the last text
        apart = np.diff(other, prepend=-1) > 1
        between = (codes[other] == 32) & apart & np.append(apart[1:], False)
        between[np.searchsorted(other, ends)] = False
        nth = np.arange(len(other)) - np.maximum.accumulate(np.where(between, -1, np.arange(len(other))))
        codes[small] = letters[codes[small] - 97]
        sizes = utf8_sizes(codes)
        sizes[other[between & (nth % 2 == 1)]] = 0
        sizes[ends] = 0
        borders = np.append(0, np.cumsum(sizes, dtype=np.int64)[ends])
        return pa.StringArray.from_buffers(len(rows), pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(codes[sizes > 0].tobytes().decode("utf-32-le").encode()))

    @F.arrow_udf("string")
    def of(rows: pa.Array) -> pa.Array:
        told = [portion(rows.slice(lo, hi - lo)) for lo, hi in portions(rows)]
        return pc.if_else(rows.is_valid(), pa.concat_arrays(told), None) if told else rows

    return of(text)


def han_lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    """The most frequent words of two to four small letters, in Han characters."""
    ship_package(spark)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            for lo, hi in portions(rows):
                held = np.frombuffer(end_to_end(rows.slice(lo, hi - lo))[0], np.uint8) - 96  # unsigned: small letters are 1 to 26
                other = np.append(-1, np.flatnonzero((held < 1) | (held > 26)))
                size, begin = np.diff(other) - 1, other[:-1] + 1
                begin, size = begin[(size >= 2) & (size <= 4)], size[(size >= 2) & (size <= 4)]
                number = sum(np.where(i < size, held[begin + np.minimum(i, size)], 0).astype(np.int32) * 27 ** (3 - i) for i in range(4))
                n = np.bincount(number, minlength=27**4)
                letters = np.flatnonzero(n)[:, None] // 27 ** np.arange(3, -1, -1) % 27
                borders = np.append(0, np.cumsum(np.count_nonzero(letters, axis=1)))
                words = pa.StringArray.from_buffers(len(letters), pa.py_buffer(borders.astype(np.int32)), pa.py_buffer((letters[letters > 0] + 96).astype(np.uint8)))
                yield pa.RecordBatch.from_pydict({"w": words, "n": pa.array(n[n > 0])})

    own = table(spark, sf_dir, "documents").select("text").mapInArrow(counts, "w string, n long")
    best = own.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(HAN_WORDS)  # a lexicon's size
    return Lexicon.from_table(best.select(F.translate("w", LETTERS, HAN).alias("word"), "n"))


def asked(spark: SparkSession, rows=QUERIES) -> DataFrame:
    cell = lambda x: "NULL" if x is None else repr(x)
    values = ", ".join(f"({', '.join(map(cell, r))}, 0)" for r in rows)
    return spark.sql(f"SELECT qid, text, k, CAST(project AS STRING) AS project, variant FROM VALUES {values} AS t(qid, text, k, project, variant)")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's vector is the stored one whose number its id names, modulo their count."""
    stored = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = stored.count()
    return chunks(spark, sf_dir).select("chunk_id", "project", F.pmod("chunk_id", F.lit(n)).alias("vec_id")).join(stored, "vec_id").drop("vec_id")


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    q = asked(spark).withColumn("v", (F.col("qid") * 7).cast("long"))
    return q.join(stored, "v", "left").drop("v")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as turns: equal texts are one turn seen in several sources."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("project"), fn.fingerprint(F.col("lang")).alias("project_fingerprint"), F.sha2("text", 256).alias("uuid"), F.col("source").alias("source_key"),
        F.concat(F.lit("s"), F.pmod("doc_id", F.lit(9))).alias("session_id"), F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") * 60).alias("ts"), F.lit("user").alias("role"), "text", F.col("doc_id").alias("seq"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for old, new in KINDS.items():
        kind = F.when(F.col("event_type") == old, new).otherwise(kind)
    return table(spark, sf_dir, "events").select(
        kind.alias("kind"), F.concat_ws("-", "user_id", F.pmod("event_id", F.lit(7))).alias("anchor"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("p"), _presentation_number()).alias("presentation"), F.col("event_id").alias("seq"), F.col("user_id"),
    )


def _presentation_number():
    """Ten presentations for each five users, so that there are more of them, not larger ones, in a larger table."""
    return F.floor(F.col("user_id") / 5) * 10 + F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 10


def instant():
    return F.lit(INSTANT).cast("timestamp_ntz").cast("timestamp")


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up result pages, with ties and three bands: each document is on one page of 40, so there are as many as it takes."""
    base = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 40).alias("qid"), F.col("doc_id").alias("anchor"), (F.pmod(F.col("doc_id") * 37, F.lit(11)) / F.lit(8.0)).alias("base_score"), F.pmod(F.col("doc_id") * 13, F.lit(3)).cast("int").alias("band")
    )
    order = Window.partitionBy("qid").orderBy("band", F.desc("base_score"), "anchor")
    return base.withColumn("pos", F.row_number().over(order) - 1)


def strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").where(F.pmod(d, F.lit(3)) != 0).select(d.alias("anchor"), (F.pmod(d * 7919, F.lit(17)) - 5).cast("double").alias("net"))


def _hits(df: DataFrame) -> DataFrame:
    return df.select("qid", "pos", "chunk_id", F.round("score", 9).alias("score"), "band", F.array_join("channels", ",").alias("channels"))


def fused_topk(spark, sf_dir):
    return _hits(retrieval.search(search_index(spark, sf_dir), asked(spark), channels=("trigram", "segment")))


def fused_topk_3ch(spark, sf_dir):
    return _hits(retrieval.search(search_index(spark, sf_dir), asked_vectors(spark, sf_dir), vectors(spark, sf_dir)))


def channel_subset(spark, sf_dir):
    return _hits(retrieval.search(search_index(spark, sf_dir, ("segment",)), asked_vectors(spark, sf_dir), vectors(spark, sf_dir), ("segment", "vector")))


def _lexical(channel: str):
    def run(spark, sf_dir):
        return retrieval.lexical_channel(search_index(spark, sf_dir, (channel,)), asked(spark), channel).select("qid", "chunk_id", "rank", "score")

    return run


def vector_topk(spark, sf_dir):
    return retrieval.vector_channel(vectors(spark, sf_dir), asked_vectors(spark, sf_dir)).select("qid", "chunk_id", "rank", F.round("score", 6).alias("score"))


def bm25_stats(spark, sf_dir):
    s = postings.statistics(chunks(spark, sf_dir).select(*postings.lengths(F.col("text"))))
    return s.select("n", F.round("trigram_avgdl", 6).alias("trigram_avgdl"), F.round("segment_avgdl", 6).alias("segment_avgdl"))


def scope_filter_global_idf(spark, sf_dir):
    return retrieval.lexical_channel(search_index(spark, sf_dir, ("trigram",)), asked(spark, [(1, "tion", 8, "p2"), (2, "tion", 8, None)]), "trigram").select("qid", "chunk_id", "rank", "score")


def variant_union_rank(spark, sf_dir):
    q = spark.createDataFrame([(1, "thing", 4, None, 0), (1, "tion", 4, None, 1)], "qid int, text string, k int, project string, variant int")
    return retrieval.lexical_channel(search_index(spark, sf_dir, ("trigram",)), q, "trigram").select("qid", "chunk_id", "rank")


def cjk_words(spark, sf_dir):
    """Every document in Han characters, cut into words by the lexicon of its letters."""
    ship_package(spark)
    own = table(spark, sf_dir, "documents").select("doc_id", tokens(in_han(F.col("text")), han_lexicon(spark, sf_dir)).alias("words"))
    return own.select("doc_id", F.size("words").alias("n_words"), F.sha2(F.array_join("words", "|"), 256).alias("words_sha256"))


def cjk_topk(spark, sf_dir):
    """Two-character words in an index that was cut by the lexicon: whole words alone are hits."""
    q = asked(spark, [(i, w.translate(str.maketrans(LETTERS, HAN)), 10, None) for i, w in enumerate(HAN_QUERIES)])
    return retrieval.lexical_channel(search_index(spark, sf_dir, ("segment",), han=True), q, "segment").select("qid", "chunk_id", "rank", "score")


def script_variants(spark, sf_dir):
    """Every document as a query, in simplified or traditional characters, with its variants."""
    forms = {}
    for name, entries in (("simple", SIMPLE), ("old", OLD)):
        forms[name] = F.col("text")
        for letters, han in entries:
            forms[name] = F.replace(forms[name], F.lit(letters), F.lit(han))
    q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.when(F.pmod("doc_id", F.lit(2)) == 0, forms["simple"]).otherwise(forms["old"]).alias("text"))
    return retrieval.with_variants(q).select("qid", "variant", F.sha2("text", 256).alias("text_sha256"))


def normal_forms(spark, sf_dir):
    """Texts whose accents stand apart, as combining marks, in normal form."""
    apart = F.col("text")
    for letter in ACCENTED:
        apart = F.replace(apart, F.lit(letter), F.lit(unicodedata.normalize("NFD", letter)))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(apart, 256).alias("apart_sha256"), F.sha2(fn.normal_form(apart), 256).alias("normal_sha256"))


def exclude_sessions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    per_text = docs.groupBy(F.sha2("text", 256).alias("uuid")).agg(F.array_sort(F.collect_set("source")).alias("sessions"))
    sessions = docs.select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("uuid")).join(per_text, "uuid").drop("uuid")
    enlarged = [(q, t, min(4 * k, 1000), p) for q, t, k, p in QUERIES]
    hits = retrieval.search(search_index(spark, sf_dir), asked(spark, enlarged), channels=("trigram", "segment"))
    return retrieval.exclude_sessions(hits, sessions, EXCLUDED, 10).select("qid", "pos", "chunk_id", F.round("score", 9).alias("score"), "band")


def query_class(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 100).cast("int").alias("n"), F.col("text").alias("query"))
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(CLASSED)], "n int, query string").unionByName(items)
    return rows.select("n", fn.query_class(F.col("query")).alias("query_class"))


def ident_shape(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("a"), F.col("text").alias("b"))
    return c.select("conv_id", "turn", fn.is_identifier(F.col("a")).alias("id_ok"), fn.is_identifier(F.col("b")).alias("text_ok"))


def fingerprint(spark, sf_dir):
    f = fn.fingerprint(F.col("source"))
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", f.alias("fingerprint"), fn.is_fingerprint(f).alias("ok"))


def clip_flatten(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.flatten_clip(F.col("text"), 160).alias("snippet"))


def normalise_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(fn.normalise_space(F.col("text")), 256).alias("plain_sha256"))


def anchors(spark, sf_dir):
    d = F.col("doc_id")
    lo, hi = F.pmod(d * 31, F.lit(40)), F.pmod(d * 31, F.lit(40)) + F.pmod(d, F.lit(60))
    cut = F.substring("text", lo.cast("int") + 1, (hi - lo).cast("int"))
    digest = F.when(F.pmod(d, F.lit(4)) == 0, "stale").otherwise(F.coalesce(hashing.content_hash(cut, KEY), F.lit("none")))
    turn = F.when(F.pmod(d, F.lit(10)) == 0, F.lit("gone")).otherwise(d.cast("string"))
    return table(spark, sf_dir, "documents").select(turn.alias("turn_id"), F.col("lang").alias("source"), digest.alias("content_hash"), lo.alias("lo"), hi.alias("hi"))


def span_slice_orphans(spark, sf_dir):
    held = table(spark, sf_dir, "documents").select(F.col("lang").alias("project_fingerprint"), F.col("doc_id").cast("string").alias("uuid"), "text")
    return index.resolve_anchors(anchors(spark, sf_dir), held, KEY).groupBy("orphan_reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def dedup_sources(spark, sf_dir):
    c = index.build_chunks(observed(spark, sf_dir))
    return c.select("project_fingerprint", "uuid", "project", "source_count", F.sha2("text", 256).alias("text_sha256"))


def sessions_per_chunk(spark, sf_dir):
    turns = observed(spark, sf_dir)
    links = index.build_links(turns)
    ids = turns.select(F.xxhash64("project_fingerprint", "uuid").alias("chunk_id"), "project_fingerprint", "uuid").distinct()
    return ids.join(index.sessions_per_chunk(links), "chunk_id").select("project_fingerprint", "uuid", F.array_join("sessions", ",").alias("sessions"))


def latest_per_chunk(spark, sf_dir):
    return index.build_chunks(observed(spark, sf_dir)).select("project_fingerprint", "uuid", F.unix_seconds("ts").alias("latest"))


def source_counts(spark, sf_dir):
    return index.source_counts(index.build_links(observed(spark, sf_dir)))


def _damaged(spark, sf_dir):
    """An index with known damage: some counts off, some links and chunks missing."""
    turns = observed(spark, sf_dir)
    links = index.build_links(turns)
    all_chunks = index.build_chunks(turns)
    off = F.substring("uuid", 1, 1)
    keyed = all_chunks.select("chunk_id", "uuid", (F.col("source_count") + F.when(off == "a", 1).otherwise(0)).alias("source_count"))
    kept = keyed.where(off != "b")
    left = links.join(keyed.where(off == "c").select("chunk_id"), "chunk_id", "left_anti")
    return keyed, kept, links, left


def audit_divergent(spark, sf_dir):
    keyed, _, links, _ = _damaged(spark, sf_dir)
    return index.divergent_chunks(keyed, links).join(keyed.select("chunk_id", "uuid"), "chunk_id").groupBy(F.substring("uuid", 1, 2).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.sum("source_count").alias("stored"), F.sum("real_count").alias("real"))


def audit_dangling(spark, sf_dir):
    _, kept, links, _ = _damaged(spark, sf_dir)
    return index.dangling_links(kept, links).groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))


def audit_orphan(spark, sf_dir):
    keyed, _, _, left = _damaged(spark, sf_dir)
    return index.orphan_chunks(keyed, left).join(keyed.select("chunk_id", "uuid"), "chunk_id").select("uuid")


def uncovered_sources(spark, sf_dir):
    links = index.build_links(observed(spark, sf_dir))
    state = links.select("source_key").distinct().where("source_key not like '%7'")
    return index.uncovered_sources(links, state)


def audit_figures(spark, sf_dir):
    keyed, kept, links, left = _damaged(spark, sf_dir)
    stored = index.source_counts(links).withColumn("chunk_count", F.col("chunk_count") + F.when(F.col("source_key").endswith("3"), 1).otherwise(0))
    return index.audit(kept, left, stored, links.select("source_key").distinct().where("source_key not like '%7'"))


def manifest_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 997).alias("k")).distinct()
    key = F.concat(F.lit("p"), F.col("k") % 4, F.lit("/f"), F.col("k"))
    state = o.where("k % 5 <> 0").select(key.alias("source_key"), F.sha2(F.col("k").cast("string"), 256).alias("prefix_hash"), (F.when(F.col("k") % 50 == 1, -1).otherwise(F.col("k") * 10)).cast("long").alias("processed_bytes"))
    digest = F.when(F.col("k") % 11 == 0, "other").otherwise(F.sha2(F.col("k").cast("string"), 256))
    found = o.where("k % 7 <> 0").select(key.alias("source_key"), F.concat(F.lit("p"), F.col("k") % 4).alias("project"), digest.alias("prefix_hash"), (F.col("k") * 10 + F.when(F.col("k") % 3 == 0, 5).otherwise(0) - F.when(F.col("k") % 13 == 0, 1).otherwise(0)).cast("long").alias("size"))
    return index.manifest_difference(found, state, spark.createDataFrame([("p2",)], "project string"))


def duplication_stats(spark, sf_dir):
    turns = observed(spark, sf_dir)
    return index.duplication_statistics(index.build_links(turns), turns)


def script_cooccurrence(spark, sf_dir):
    return evaluate.script_cooccurrence(table(spark, sf_dir, "documents"))


def upsert_last_writer(spark, sf_dir):
    """Stored: each customer's largest order. New: a row for each customer, and several observations of one key."""
    old = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    new = table(spark, sf_dir, "customer").select((F.col("c_custkey") + F.pmod("c_custkey", F.lit(2))).alias("k"), (-F.col("c_custkey")).alias("v"), F.col("c_custkey").alias("seq"))
    return index.upsert(old.withColumn("seq", F.lit(0).cast("long")), new, ["k"], "seq").drop("seq")


def remove_sources(spark, sf_dir):
    turns = observed(spark, sf_dir)
    gone = spark.createDataFrame([(s,) for s in EXCLUDED], "source_key string")
    left, _ = index.remove_sources(index.build_chunks(turns), index.build_links(turns), gone)
    return left.select("project_fingerprint", "uuid", "source_count", F.unix_seconds("ts").alias("latest"))


def strength_projection(spark, sf_dir):
    e = usage(spark, sf_dir)
    d = memory.direct_strength(memory.live(e, instant()), instant(), memory.Parameters())
    return d.select("anchor", F.round("reinforcement", 9).alias("reinforcement"), F.round("suppression", 9).alias("suppression"), F.round(F.col("reinforcement") - F.col("suppression"), 9).alias("net"))


def impressions_counts(spark, sf_dir):
    d = memory.direct_strength(memory.live(usage(spark, sf_dir), instant()), instant(), memory.Parameters())
    return d.select("anchor", "impressions", "opened", "cited", "pinned", "dismissed", F.date_format("last_deliberate", "yyyy-MM-dd HH:mm:ss").alias("last_deliberate"))


def future_events(spark, sf_dir):
    return memory.future_events(usage(spark, sf_dir), instant())


def spreading_projection(spark, sf_dir):
    d = memory.project(usage(spark, sf_dir), instant())
    return d.select("anchor", F.round("reinforcement", 6).alias("reinforcement"), F.round("suppression", 6).alias("suppression"), "impressions")


def _reranked(strategy: str):
    def run(spark, sf_dir):
        return rerank.rerank(page(spark, sf_dir), strengths(spark, sf_dir), strategy, 1).select("qid", "anchor", "pos", "new_pos", "displacement", "movement")

    return run


def human_like_bound3(spark, sf_dir):
    return rerank.rerank(page(spark, sf_dir), strengths(spark, sf_dir), "human-like", 3).select("qid", "anchor", "pos", "new_pos", "displacement", "movement")


def one_pass_fold(spark, sf_dir):
    return rerank.one_pass_fold(page(spark, sf_dir), strengths(spark, sf_dir), "run").select("qid", "anchor", "new_pos")


def guard_violations(spark, sf_dir):
    before = page(spark, sf_dir)
    p, n = F.col("pos"), F.count(F.lit(1)).over(Window.partitionBy("qid"))
    to = F.when(F.col("qid") % 5 == 0, n - 1 - p).otherwise(p)  # every fifth page is turned around
    after = before.withColumn("to", to).select("qid", "anchor", F.col("to").alias("pos"), "base_score", "band", (p - F.col("to")).alias("displacement"), F.lit("unmoved").alias("movement"), F.when(F.col("anchor") % 9 == 0, F.lit(1.0)).alias("history"))
    return rerank.guard_violations(before, after, 3, within_ties=True, strengths=strengths(spark, sf_dir)).groupBy("qid", "rule").agg(F.count(F.lit(1)).alias("n"))


def displacement(spark, sf_dir):
    before = page(spark, sf_dir)
    after = before.select("qid", "anchor", (F.row_number().over(Window.partitionBy("qid").orderBy("anchor")) - 1).alias("pos"))
    return rerank.displacement(before, after)


def tie_runs(spark, sf_dir):
    return rerank.tie_runs(page(spark, sf_dir)).select("qid", "anchor", "run")


def tie_stats(spark, sf_dir):
    return evaluate.tie_statistics(page(spark, sf_dir))


def tie_run_lengths(spark, sf_dir):
    return evaluate.run_lengths(page(spark, sf_dir))


def interleave_ab(spark, sf_dir):
    a = page(spark, sf_dir)
    b = a.select("qid", "anchor", (F.row_number().over(Window.partitionBy("qid").orderBy("anchor")) - 1).alias("pos"))
    sides = a.select("qid").distinct().withColumn("side", F.when(F.col("qid") % 2 == 0, "a").otherwise("b"))
    return evaluate.interleave(a.select("qid", "anchor", "pos"), b, sides)


def _presented(spark, sf_dir, generations: int):
    """Presentations p<k>: members are the anchors seen in it, credited by a hash of the anchor."""
    e = usage(spark, sf_dir)
    member = F.struct("anchor", F.when(F.length("anchor") % 2 == 0, "a").otherwise("b").alias("credited_to"))
    k = F.regexp_extract("presentation", "([0-9]+)", 1).cast("int")
    shown = e.where("kind = 'shown'").groupBy("presentation").agg(F.array_sort(F.collect_set(member)).alias("attribution"))
    p = shown.select(
        F.col("presentation").alias("id"), F.when(k % 3 == 0, "latin-alnum").when(k % 3 == 1, "mixed").otherwise("cjk-2char").alias("query_class"), F.lit("archival").alias("strategy_a"), F.lit("human-like").alias("strategy_b"),
        F.concat(F.lit("g"), k % generations).alias("generation"), "attribution", F.when(k % 2 == 0, "a").otherwise("b").alias("starting_side"), (k % 10 == 9).alias("is_null_comparison"),
    )
    own = e.withColumn("generation", F.concat(F.lit("g"), k % generations)).withColumn("policy", F.lit("interleaved"))
    return own.withColumn("presentation", F.when(F.col("seq") % 17 != 0, F.col("presentation"))), p


def comparison_report(spark, sf_dir):
    e, p = _presented(spark, sf_dir, 1)
    return evaluate.comparison_report(e, p).withColumn("rate", F.round("rate", 9))


def generation_rows(spark, sf_dir):
    e, p = _presented(spark, sf_dir, 2)
    return evaluate.comparison_report(e, p).withColumn("rate", F.round("rate", 9))


def dispositions(spark, sf_dir):
    return evaluate.skip_counts(*_presented(spark, sf_dir, 2))


def record_faults(spark, sf_dir):
    """Presentations, some of them spoilt: one strategy twice, a null comparison by name alone, ids told twice."""
    _, p = _presented(spark, sf_dir, 2)
    k = F.regexp_extract("id", "([0-9]+)", 1).cast("int")
    spoilt = p.withColumn("strategy_b", F.when(k % 7 == 0, "archival").when(k % 7 == 1, "conservative").otherwise(F.col("strategy_b"))).withColumn("is_null_comparison", k % 5 == 4)
    return evaluate.record_faults(spoilt.unionByName(spoilt.where(k % 11 == 0)))


def salvage_presentations(spark, sf_dir):
    _, p = _presented(spark, sf_dir, 2)
    k = F.regexp_extract("id", "([0-9]+)", 1).cast("int")
    lines = event_log.record_lines(p.withColumn("seq", k))
    broken = F.when(F.col("seq") % 10 == 0, F.concat("line", F.lit(" "))).when(F.col("seq") % 10 == 1, F.replace("line", F.lit('"id"'), F.lit('"key"'))).otherwise(F.col("line"))
    return event_log.salvage_records(lines.select(F.col("seq").alias("line_no"), broken.alias("line")), lambda a: ~a.endswith("-3")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def unattributable_hits(spark, sf_dir):
    """Results of pages and the chunks they point at, of which every ninth is gone."""
    hits, there = page(spark, sf_dir), chunks(spark, sf_dir).where(F.col("chunk_id") % 9 != 0)
    joined = hits.join(there.select(F.col("chunk_id").alias("anchor"), F.lit(1).alias("found")), "anchor", "left")
    return joined.groupBy("qid").agg(F.count("found").alias("attributed"), F.count_if(F.col("found").isNull()).alias("unattributable"))


def script_runs(spark, sf_dir):
    runs = fn.script_runs(F.translate("text", "xz", "選釘"))  # the tables hold no Han characters
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.when(r["is_cjk"], "c").otherwise("o"), r["run"])), "|")
    return table(spark, sf_dir, "documents").select("doc_id", runs.alias("runs")).select("doc_id", F.size("runs").alias("n_runs"), F.size(F.filter("runs", lambda r: r["is_cjk"])).alias("n_cjk"), F.sha2(told, 256).alias("runs_sha256"))


def signal_maps(spark, sf_dir):
    """Each anchor's counts by kind as a map, merged over presentations, deliberate kinds alone."""
    each = usage(spark, sf_dir).groupBy("anchor", "presentation", "kind").agg(F.count(F.lit(1)).alias("n"))
    maps = each.groupBy("anchor", "kind").agg(F.sum("n").alias("n")).groupBy("anchor").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("counts"))
    own = F.map_filter("counts", lambda k, n: k != "shown")
    return maps.select("anchor", F.to_json(own).alias("deliberate"), F.array_contains(F.map_keys(own), "pinned").alias("pinned"))


def source_union(spark, sf_dir):
    t = observed(spark, sf_dir)
    return t.where("project = 'en'").select("source_key").union(t.where("project = 'fr'").select("source_key")).distinct()


def corrected_preference(spark, sf_dir):
    o = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, "a").otherwise("b").alias("starting_side"), (F.col("value") > 50).alias("prefers_a"))
    c = evaluate.corrected_preference(o)
    return c.withColumn("pooled", F.round("pooled", 9)).withColumn("corrected", F.round("corrected", 9))


def ndcg_by_class(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("query_class"))
    channels = F.explode(F.array(F.lit("lexical"), F.lit("vector"), F.lit("fused")))
    hits = d.select("qid", channels.alias("channel"), "chunk_id", "query_class").withColumn("rank", (1 + F.pmod(F.col("qid") * 17 + F.length("channel") * 5, F.lit(31))).cast("int"))
    r = evaluate.known_item_report(d, hits)
    return r.withColumn("recall_rate", F.round("recall_rate", 9)).withColumn("mean_ndcg", F.round("mean_ndcg", 9))


def known_item_recall(spark, sf_dir):
    c = chunks(spark, sf_dir)
    items = written(evaluate.known_items(c, 42, 20).withColumn("qid", F.row_number().over(Window.orderBy("chunk_id")).cast("int")))
    stored = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 7).cast("int").alias("qid"), "vec_id", "embedding").where("vec_id % 7 = 0").drop("vec_id")
    own = written(vectors(spark, sf_dir))
    search = lambda q, channels: retrieval.search(search_index(spark, sf_dir), q, own, channels)
    r = evaluate.known_item_run(items, search, c.count(), lambda q: q.join(stored, "qid", "left"))  # a query's vector is the stored one of seven times its number
    return r.withColumn("recall_rate", F.round("recall_rate", 9)).withColumn("mean_ndcg", F.round("mean_ndcg", 9))


def latency_p95(spark, sf_dir):
    return evaluate.latency_percentile(table(spark, sf_dir, "events"), "value", "event_type")


def mark_events(spark, sf_dir):
    _, p = _presented(spark, sf_dir, 1)
    places = spark.range(1, 4).select(F.col("id").cast("int").alias("rank"))
    choices = p.select(F.col("id").alias("presentation")).crossJoin(F.broadcast(places)).withColumn("kind", F.when(F.col("rank") == 1, "pinned").otherwise("opened")).withColumn("ts", instant())
    return evaluate.marks(p, choices).select("presentation", "kind", "anchor", "policy", F.col("note_ref").isNotNull().alias("has_note"))


def _raw_lines(spark, sf_dir):
    """Conversations as raw records, every class of skip and every kind of content among them."""
    c = table(spark, sf_dir, "conversations").withColumn("r", F.pmod(F.col("conv_id") * 8 + F.col("turn"), F.lit(20)))
    when = F.concat(F.lit("2024-01-01T00:00:"), F.lpad(F.pmod("turn", F.lit(60)), 2, "0"), F.when(F.col("r") % 2 == 0, ".250Z").otherwise("Z"))
    block = lambda kind, **f: F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in f.items()])
    call = block("tool_use", name=F.lit("Read"), input=F.struct(F.concat(F.lit("/f/"), "turn").alias("path"), F.concat(F.lit("a\nb"), F.col("turn")).alias("command"), F.lit("").alias("url"), F.col("turn").alias("query"), F.col("text").alias("content")))
    result, failed = block("tool_result", content=F.col("text")), block("tool_result", content=F.array(block("text", text=F.col("text"))), is_error=F.lit(True))
    record = lambda content, **over: F.to_json(F.struct("type", "uuid", "sessionId", "timestamp", F.struct(*over.values() or [F.col("role")], content.alias("content")).alias("message")))
    both = F.concat(F.lit("["), F.to_json(failed), F.lit(","), F.to_json(block("text", text=F.col("text"))), F.lit("]"))
    mixed = lambda content: F.concat(F.lit('{"type":"'), "type", F.lit('","uuid":"'), "uuid", F.lit('","sessionId":"'), "sessionId", F.lit('","timestamp":"'), "timestamp", F.lit('","message":{"content":'), content, F.lit("}}"))
    rows = c.select(
        "conv_id", "turn", "r", "role", F.when(F.col("r") == 1, " \n ").otherwise(F.col("text")).alias("text"), F.when(F.col("r") == 2, "summary").when(F.col("role") == "assistant", "assistant").otherwise("user").alias("type"),
        F.when(F.col("r") != 3, F.when(F.col("r") == 4, "bad id!").otherwise(F.concat_ws("-", "conv_id", "turn"))).alias("uuid"), F.concat(F.lit("s"), F.col("conv_id")).alias("sessionId"), when.alias("timestamp"),
    )
    raw = (
        F.when(F.col("r") == 5, "{not json").when(F.col("r") == 6, record(F.array(call))).when(F.col("r") == 7, record(F.array(result))).when(F.col("r") == 8, F.lit(None))
        .when(F.col("r") == 9, mixed(both)).when(F.col("r") == 10, record(F.col("turn"))).when(F.col("r") == 11, mixed(F.lit('[{"type":"text","text":"z"},7]'))).otherwise(record(F.col("text")))
    )
    return rows.select(F.concat(F.lit("p/"), F.col("conv_id"), F.lit(".jsonl")).alias("source_key"), F.lit("p").alias("project"), F.col("turn").cast("int").alias("line_no"), raw.alias("raw"))


def skip_tally(spark, sf_dir):
    return logs.skip_tally(logs.classify(_raw_lines(spark, sf_dir)))


def tool_metadata(spark, sf_dir):
    return logs.classify(_raw_lines(spark, sf_dir)).where("skip_reason is null").select("uuid", "role", F.sha2("text", 256).alias("text_sha256"), F.unix_millis("ts").alias("ms"))


def event_range(spark, sf_dir):
    e = usage(spark, sf_dir)
    at = lambda d: F.lit(f"2024-01-{d:02d} 00:00:00").cast("timestamp_ntz").cast("timestamp")
    return event_log.read_range(e, at(10), at(12)).select("seq", "kind", "anchor")


def salvage_log(spark, sf_dir):
    e = usage(spark, sf_dir).withColumn("generation", F.lit("g1")).withColumn("policy", F.lit("archival")).withColumn("note_ref", F.lit(None).cast("string"))
    lines = event_log.to_lines(e)
    broken = F.when(F.col("seq") % 10 == 0, F.concat("line", F.lit(" "))).when(F.col("seq") % 10 == 1, F.replace("line", F.lit('"kind"'), F.lit('"what"'))).otherwise(F.col("line"))
    return event_log.salvage(lines.select(F.col("seq").alias("line_no"), broken.alias("line")), F.col("anchor").startswith("1")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def salvage_lines(spark, sf_dir):
    """The usage log written to files in order of their users, lines broken on the way, read back and pruned: where the
    faults are, by file and line. A file holds the users of one hundred."""
    e = usage(spark, sf_dir).withColumn("generation", F.lit("g1")).withColumn("policy", F.lit("archival")).withColumn("note_ref", F.lit(None).cast("string"))
    lines = event_log.to_lines(e).join(e.select("seq", "user_id"), "seq")
    broken = F.when(F.col("seq") % 10 == 0, F.concat("line", F.lit(" "))).when(F.col("seq") % 10 == 1, F.replace("line", F.lit('"kind"'), F.lit('"what"'))).otherwise(F.col("line"))
    folder = f"{scratch_folder(spark)}/log-{uuid.uuid4().hex}"
    hundred = F.floor(F.col("user_id") / 100).alias("hundred")
    one_file = lines.select(hundred, "seq", broken.alias("value")).repartition("hundred").sortWithinPartitions("hundred", "seq")
    one_file.select("hundred", "value").write.option("maxRecordsPerFile", 0).partitionBy("hundred").text(f"{folder}/log")
    log = spark.read.option("lineSep", "\n").text(f"{folder}/log")
    named = logs.number_lines(log, F.regexp_extract("_metadata.file_path", "hundred=([0-9]+)", 1))
    found = event_log.salvage(named.select(F.col("source_key").alias("file"), (F.col("line_no") + 1).alias("line_no"), F.col("raw").alias("line")), F.col("anchor").startswith("1"))
    return found.where("status <> 'ok'").select("file", "line_no", "status")


def prompt_gate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    prompt = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("<system-reminder>the\nthing</system-reminder>"), F.col("text"))).when(F.col("turn") % 4 == 2, F.concat(F.lit("/cmd "), F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", fn.gate(prompt, ["(?i)\\bthing\\b", "(?i)ques+"], ["/cmd", "<command"]).alias("outcome"))


def prompt_modes(spark, sf_dir):
    """The gate under each mode, by conversation; an unknown or missing mode counts as cued."""
    c = table(spark, sf_dir, "conversations")
    mode = F.get(F.array(*[F.lit(m) for m in ("cued", "always", "off", "loud", None)]), F.pmod("conv_id", F.lit(5)).cast("int"))
    prompt = F.when(F.col("turn") % 4 == 2, F.concat(F.lit("/cmd "), F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", fn.gate(prompt, ["(?i)ques+"], ["/cmd"], mode).alias("outcome"))


def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", hashing.content_hash(F.col("text"), KEY).alias("content_hash"), hashing.starting_side(F.col("text")).alias("side"))


def nested_samples(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", evaluate.sample_order(7, F.col("doc_id")).alias("chance"))
    first = d.orderBy("chance", "doc_id").limit(160)  # the samples are the feature: 10, 40 and 160
    n = F.row_number().over(Window.orderBy("chance", "doc_id"))
    return first.select("doc_id", F.when(n <= 10, 10).when(n <= 40, 40).otherwise(160).alias("smallest_sample"))


QUERIES_BY_NAME = {
    "fused_topk": fused_topk, "fused_topk_3ch": fused_topk_3ch, "trigram_topk": _lexical("trigram"), "segment_topk": _lexical("segment"), "vector_topk": vector_topk,
    "channel_subset": channel_subset, "bm25_stats": bm25_stats, "scope_filter_global_idf": scope_filter_global_idf, "variant_union_rank": variant_union_rank,
    "cjk_words": cjk_words, "cjk_topk": cjk_topk, "script_variants": script_variants, "normal_forms": normal_forms,
    "exclude_sessions": exclude_sessions, "query_class": query_class, "ident_shape": ident_shape, "fingerprint": fingerprint, "clip_flatten": clip_flatten,
    "normalise_ws": normalise_ws, "span_slice_orphans": span_slice_orphans, "dedup_sources": dedup_sources, "sessions_per_chunk": sessions_per_chunk,
    "latest_per_chunk": latest_per_chunk, "source_counts": source_counts, "audit_divergent": audit_divergent, "audit_dangling": audit_dangling, "audit_orphan": audit_orphan,
    "uncovered_sources": uncovered_sources, "audit_figures": audit_figures, "manifest_diff": manifest_diff, "duplication_stats": duplication_stats,
    "script_cooccurrence": script_cooccurrence, "upsert_last_writer": upsert_last_writer, "remove_sources": remove_sources, "strength_projection": strength_projection,
    "impressions_counts": impressions_counts, "future_events": future_events, "spreading_projection": spreading_projection, "human_like_rerank": _reranked("human-like"),
    "conservative_rerank": _reranked("conservative"), "archival_rerank": lambda s, d: rerank.rerank(page(s, d), strengths(s, d), "archival").select("qid", "anchor", "new_pos", "movement"),
    "human_like_bound3": human_like_bound3, "one_pass_fold": one_pass_fold, "guard_violations": guard_violations, "displacement": displacement, "tie_runs": tie_runs,
    "tie_stats": tie_stats, "tie_run_lengths": tie_run_lengths, "record_faults": record_faults, "salvage_presentations": salvage_presentations,
    "unattributable_hits": unattributable_hits, "script_runs": script_runs, "signal_maps": signal_maps, "source_union": source_union, "interleave_ab": interleave_ab, "comparison_report": comparison_report, "generation_rows": generation_rows, "dispositions": dispositions,
    "corrected_preference": corrected_preference, "ndcg_by_class": ndcg_by_class, "known_item_recall": known_item_recall, "latency_p95": latency_p95, "mark_events": mark_events,
    "skip_tally": skip_tally, "tool_metadata": tool_metadata, "event_range": event_range, "salvage_log": salvage_log, "salvage_lines": salvage_lines, "prompt_gate": prompt_gate, "prompt_modes": prompt_modes,
    "content_hash": content_hash, "nested_samples": nested_samples,
}
