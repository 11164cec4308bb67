"""Hybrid retrieval over a batch of queries: two lexical channels, one vector channel, rank fusion.

Queries are a batch (at most ``postings.MOST_QUERIES``) and answered at once. Lexical channels look up postings; the
vector channel multiplies vectors with the queries' matrix. ``row_number() <= depth`` trims matches in each task before
they are shuffled (Catalyst's WindowGroupLimit). Corpus statistics are always those of the whole corpus, whatever the scope.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.conversion import TO_SIMPLIFIED, TO_TRADITIONAL, Conversion, variants
from lorekeep.operators import postings
from lorekeep.operators.postings import SearchIndex
from lorekeep.sources.shipping import ship_package

# Fixed value: the fusion constant.
RRF = 60
CHANNELS = ("trigram", "segment", "vector")


def depth(k: Column) -> Column:
    return F.greatest(5 * k, F.lit(50))


def bm25(tf: Column, dl: Column, n: Column, df: Column, avgdl: Column) -> Column:
    idf = F.greatest(F.lit(postings.LEAST_IDF), F.log((n - df + 0.5) / (df + 0.5)))
    return idf * postings.weight(tf, dl, avgdl)


def lexical_channels(index: SearchIndex, queries: DataFrame, channels: tuple[str, ...] = postings.LEXICAL) -> DataFrame:
    """(qid, chunk_id, channel, rank, score): each query's best chunks in each channel, up to its depth, in one plan.

    ``queries``: qid, text, k, project (null: all), variant (0: the query itself). Variants are ranked apart and then
    concatenated in their order, the first place of a chunk counting. Scores are rounded to nine places before ranking,
    and ties end in the chunk id, so that a ranking is the same on every run.
    """
    spark = queries.sparkSession
    batch = postings.phrases(index, queries, channels)
    postings.narrow(index, batch)
    counted, uncounted = ([p for p in batch if (p.df is not None) == known] for known in (True, False))
    unknown = postings.found(index, uncounted, spark)
    found = postings.found(index, counted, spark).unionByName(unknown) if counted and uncounted else postings.found(index, counted, spark) if counted else unknown
    # counts ask for the same columns as the rows do, so that both share one pass over the postings
    counts = unknown.groupBy("channel", "qid", "variant").agg(F.count_if(F.col("tf").isNotNull() & (F.col("dl").isNotNull() | F.col("project").isNotNull())).alias("counted"))
    asked = postings.local(spark, [(p.channel, p.qid, p.variant, p.k, p.project, p.df) for p in batch], "channel string, qid int, variant int, k int, scope string, df long")
    if not uncounted:
        per_query = asked
    else:
        per_query = asked.join(counts, ["channel", "qid", "variant"], "left").withColumn("df", F.coalesce("df", "counted")).drop("counted")
    n, avgdl = index.corpus["n"], F.when(F.col("channel") == "trigram", F.lit(index.corpus["trigram_avgdl"])).otherwise(F.lit(index.corpus["segment_avgdl"]))
    scored = (
        found.join(F.broadcast(per_query), ["channel", "qid", "variant"])  # a row a phrase
        .where(F.col("scope").isNull() | (F.col("scope") == F.col("project")))
        .select("channel", "qid", "variant", "chunk_id", "k", F.round(bm25(F.col("tf"), F.col("dl"), F.lit(n), F.col("df"), avgdl), 9).alias("score"))
    )
    within = Window.partitionBy("channel", "qid", "variant").orderBy(F.desc("score"), "chunk_id")
    deepest = max((postings.depth(p.k) for p in batch), default=0)  # a constant lets each task trim its own matches
    ranked = scored.withColumn("place", F.row_number().over(within)).where(F.col("place") <= deepest).where(F.col("place") <= depth(F.col("k")))
    first = ranked.repartition("qid").groupBy("channel", "qid", "chunk_id").agg(F.min(F.struct("variant", "place", "score")).alias("m"), F.first("k").alias("k"))
    overall = Window.partitionBy("channel", "qid").orderBy("m.variant", "m.place")
    return first.withColumn("rank", F.row_number().over(overall)).where(F.col("rank") <= depth(F.col("k"))).select("qid", "chunk_id", "channel", "rank", F.col("m.score").alias("score"))


def lexical_channel(index: SearchIndex, queries: DataFrame, channel: str) -> DataFrame:
    return lexical_channels(index, queries, (channel,))


def vector_channel(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, chunk_id, channel, rank, score) by exact inner product; chunks without a vector, or of another dimension,
    are left out. ``vectors``: chunk_id, project, embedding. ``queries``: qid, k, project, embedding (may be null).

    Queries are one matrix; each Arrow batch is multiplied with it and keeps each query's best alone, so a task sends
    at most depth rows a query and batch.
    """
    asked = queries.where("embedding is not null and variant = 0").orderBy("qid").limit(postings.MOST_QUERIES + 1).collect()
    if len(asked) > postings.MOST_QUERIES:
        raise ValueError(f"at most {postings.MOST_QUERIES} queries are answered at once")
    if not asked:
        return queries.sparkSession.createDataFrame([], "qid int, chunk_id long, channel string, rank int, score double")
    dims = sorted({len(r["embedding"]) for r in asked})
    by_dim = {d: ([r for r in asked if len(r["embedding"]) == d], np.array([r["embedding"] for r in asked if len(r["embedding"]) == d], np.float64)) for d in dims}

    deepest = max(postings.depth(r["k"]) for r in asked)
    scopes = sorted({r["project"] for r in asked if r["project"] is not None})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["embedding"].map(len).to_numpy() if len(batch) else np.array([])
            for d, (rows, matrix) in by_dim.items():
                own = batch[sizes == d]
                if not len(own):
                    continue
                scores = np.round(np.stack(own["embedding"].to_numpy()).astype(np.float64) @ matrix.T, 9)
                projects = own["project"].to_numpy()
                for scope in scopes:
                    scores[np.ix_(projects != scope, [r["project"] == scope for r in rows])] = -np.inf
                least = np.partition(scores, len(own) - deepest, axis=0)[len(own) - deepest] if len(own) > deepest else np.full(len(rows), -np.inf)
                at, q = np.nonzero((scores >= least) & (scores > -np.inf))  # all that tie with the last one, too
                yield pd.DataFrame({"qid": np.array([r["qid"] for r in rows])[q], "k": np.array([r["k"] for r in rows])[q], "chunk_id": own["chunk_id"].to_numpy()[at], "score": scores[at, q]})

    local = vectors.where("embedding is not null").select("chunk_id", "project", "embedding").mapInPandas(best, "qid int, k int, chunk_id long, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth(F.col("k"))).select("qid", "chunk_id", F.lit("vector").alias("channel"), "rank", "score")


def fuse(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Reciprocal rank fusion: (qid, pos, chunk_id, score, band, channels), each query's first k.

    Band is three minus the number of channels that found a chunk, whichever channels took part. Terms are added in the
    order of ``CHANNELS``, so equal ranks give bit-equal scores. Order and cut: band, score, id.
    """
    terms = [F.coalesce(F.max(F.when(F.col("channel") == c, F.lit(1.0).cast("double") / (RRF + F.col("rank")))), F.lit(0.0).cast("double")) for c in CHANNELS]
    fused = ranked.groupBy("qid", "chunk_id").agg(
        (terms[0] + terms[1] + terms[2]).alias("score"), (3 - F.size(F.collect_set("channel"))).cast("int").alias("band"), F.array_sort(F.collect_set("channel")).alias("channels")
    )
    order = Window.partitionBy("qid").orderBy("band", F.desc("score"), "chunk_id")
    k = F.broadcast(queries.where("variant = 0").select("qid", "k"))
    return fused.join(k, "qid").withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < F.col("k")).select("qid", "pos", "chunk_id", "score", "band", "channels")


def search(index: SearchIndex, queries: DataFrame, vectors: DataFrame | None = None, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """The fused answer to a batch of queries; ``channels`` may be a subset, bands keep their meaning."""
    lexical = tuple(c for c in postings.LEXICAL if c in channels)
    ranked = [lexical_channels(index, queries, lexical)] if lexical else []
    if "vector" in channels and vectors is not None:
        ranked.append(vector_channel(vectors, queries).repartition("qid"))
    if not ranked:
        raise ValueError("no channel to search")
    return fuse(reduce(DataFrame.unionByName, ranked), queries)


def with_variants(queries: DataFrame, traditional: Conversion = TO_TRADITIONAL, simplified: Conversion = TO_SIMPLIFIED) -> DataFrame:
    """Each query with its script variants as rows of their own (variant 1, 2); the vector channel takes variant 0."""
    ship_package(queries.sparkSession)
    each = queries.select("*", F.posexplode(variants(F.col("text"), traditional, simplified)).alias("nth", "form"))
    return each.withColumn("variant", F.col("nth").cast("int")).withColumn("text", F.col("form")).drop("nth", "form")


def exclude_sessions(hits: DataFrame, sessions: DataFrame, excluded: list[str], k: int) -> DataFrame:
    """Drops hits all of whose sessions are excluded, then cuts to k. ``sessions``: chunk_id, sessions (array).
    Callers search with an enlarged k (four times, again and again up to 1,000) until k survive."""
    left = F.size(F.array_except("sessions", F.array(*map(F.lit, excluded)).cast("array<string>"))) > 0
    order = Window.partitionBy("qid").orderBy("pos")
    kept = hits.join(sessions, "chunk_id").where(left)
    return kept.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < k).select(*[c for c in hits.columns if c != "pos"], "pos")
